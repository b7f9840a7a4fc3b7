"""Features of substitutions and of predictors' scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.codes import parse
from driftlens.functions.names import literal_map
from driftlens.operators.metrics import average_rank, finite
from driftlens.operators.storage import stored

#: Hydropathy, volume and charge of the residues (others have charge 0), and two classes.
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
VOLUME = {
    "A": 88.6, "C": 108.5, "D": 111.1, "E": 138.4, "F": 189.9, "G": 60.1, "H": 153.2, "I": 166.7, "K": 168.6, "L": 166.7,
    "M": 162.9, "N": 114.1, "P": 112.7, "Q": 143.8, "R": 173.4, "S": 89.0, "T": 116.1, "V": 140.0, "W": 227.8, "Y": 193.6,
}
CHARGE = {"D": -1.0, "E": -1.0, "K": 1.0, "R": 1.0, "H": 0.1}
AROMATIC, POLAR = "FWY", "CDEHKNQRSTY"
PROPERTIES = {"hydropathy": HYDROPATHY, "volume": VOLUME, "charge": {a: CHARGE.get(a, 0.0) for a in HYDROPATHY}}
CLASSES = {"aromatic": AROMATIC, "polar": POLAR}
#: The names of the features, in order.
NAMES = [
    "mutation_count", "position_mean", "position_std", "position_min", "position_max", *(f"{p}_delta_{k}" for p in PROPERTIES for k in ("sum", "abs")),
    *(f"{c}_delta" for c in CLASSES), "proline_introduced", "glycine_introduced",
]


def biophysical(df: DataFrame, code: str = "code") -> DataFrame:
    """df with the fifteen features of a code (NAMES): all 0 for the wild type, null for an invalid code. A stop
    takes the reference's value away."""
    made = _biophysical(F.col("_m"))
    # parsed once, as a column of its own
    return df.withColumn("_m", parse(F.col(code))).select(*df.columns, *(v.alias(k) for k, v in made.items()))


def by_code(df: DataFrame, code: str, features: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with features(codes), worked out once for each distinct code, not for each row. df is read twice: a stored table."""
    return df.join(stored(features(df.select(code).distinct())), code, "left")


def _biophysical(m: Column) -> dict[str, Column]:
    places = F.transform(m, lambda x: x["pos"].cast("double"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    n = F.size(m).cast("double")
    mean = total(places) / n
    out = {
        "mutation_count": n, "position_mean": mean,
        "position_std": F.sqrt(total(F.transform(places, lambda p: (p - mean) * (p - mean))) / n),
        "position_min": F.array_min(places), "position_max": F.array_max(places),
    }
    def changed(values: dict[str, float]) -> Column:
        own = literal_map(values)
        return F.transform(m, lambda x: F.when(x["alt"] == "*", -own[x["ref"]]).otherwise(F.try_element_at(own, x["alt"]) - own[x["ref"]]))

    def within(letters: str, part: str) -> Column:
        return total(F.transform(m, lambda x: F.contains(F.lit(letters), x[part]).cast("double")))

    for name, values in PROPERTIES.items():
        out |= {f"{name}_delta_sum": total(changed(values)), f"{name}_delta_abs": total(F.transform(changed(values), F.abs))}
    for name, letters in CLASSES.items():
        out[f"{name}_delta"] = within(letters, "alt") - within(letters, "ref")
    for name, letter in (("proline", "P"), ("glycine", "G")):
        out[f"{name}_introduced"] = within(letter, "alt")
    return {k: F.when(F.size(m) == 0, 0.0).when(F.size(m) > 0, v) for k, v in out.items()}


def additive(df: DataFrame, key: list[str], code: str = "code") -> DataFrame:
    """(key, feature): the indicators position=, substitution= and mutation= of each substitution, in long form."""
    m = df.select(*key, F.explode(parse(F.col(code))).alias("m"))
    return m.select(*key, F.explode(indicators(F.col("m"))).alias("feature"))


def indicators(m: Column) -> Column:
    """The names of a substitution's three indicators."""
    place, pair = m["pos"].cast("string"), F.concat(m["ref"], F.lit(">"), m["alt"])
    return F.array(F.concat(F.lit("position="), place), F.concat(F.lit("substitution="), pair), F.concat(F.lit("mutation="), m["ref"], place, m["alt"]))


def score_shape(df: DataFrame, task: list[str], model: str, item: str, score: str, peers: int = 50) -> DataFrame:
    """For each task and model: sd, how far the top tenth stands from the median, the share missing, and the
    median rank correlation with the other models over the items both score (`peers` at least), as agreement."""
    rows = df.withColumn("_s", F.when(finite(score), F.col(score)))
    own = Window.partitionBy(*task, model)
    # exact quantiles once a group: sort places replace a join back
    edge = F.percentile("_s", F.lit(0.9)).over(own)
    shaped = rows.withColumn("_edge", edge).groupBy(*task, model).agg(
        F.stddev_pop("_s").alias("score_dispersion"), F.avg(F.when(F.round("_s", 9) >= F.round("_edge", 9), F.col("_s"))).alias("_tail"), F.median("_s").alias("_mid"),
        (1 - F.count("_s") / F.count(F.lit(1))).alias("missing_fraction"),
    )
    shaped = shaped.withColumn("score_tail_separation", F.when(F.col("score_dispersion") > 0, (F.col("_tail") - F.col("_mid")) / F.col("score_dispersion"))).drop("_tail", "_mid")
    some = rows.filter("_s IS NOT NULL").select(*task, item, F.col(model).alias("_a"), F.col("_s").alias("_x"))
    pairs = some.join(some.select(*task, item, F.col("_a").alias("_b"), F.col("_x").alias("_y")), [*task, item]).filter("_a < _b")
    both = [*task, "_a", "_b"]
    ranked = pairs.select(*both, average_rank("_x", both).alias("_rx"), average_rank("_y", both).alias("_ry"))
    spread = (F.max("_rx") > F.min("_rx")) & (F.max("_ry") > F.min("_ry"))
    found = ranked.groupBy(*both).agg(F.count(F.lit(1)).alias("_n"), spread.alias("_ok"), F.corr("_rx", "_ry").alias("_rho")).filter(F.col("_ok") & (F.col("_n") >= peers))
    each = found.select(*task, F.explode(F.array("_a", "_b")).alias(model), "_rho").groupBy(*task, model).agg(((F.median("_rho") + 1) / 2).alias("ensemble_agreement"))
    return shaped.join(each, [*task, model], "left").withColumn("ensemble_disagreement", 1 - F.col("ensemble_agreement"))


def other_family_similarity(edges: DataFrame, families: DataFrame, node: str = "protein_id", family: str = "family_id", value: str = "similarity") -> DataFrame:
    """(node, value): the largest edge(a, b, value), taken both ways, to a node of a different family; 0 if there is none."""
    both = edges.select("a", "b", value).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), value))
    own = families.select(F.col(node).alias("a"), F.col(family).alias("_own"))
    other = families.select(F.col(node).alias("b"), F.col(family).alias("_other"))
    best = both.join(own, "a").join(other, "b").filter("_own <> _other").groupBy("a").agg(F.max(value).alias(value))
    return families.select(F.col(node).alias("a")).distinct().join(best, "a", "left").select(F.col("a").alias(node), F.coalesce(value, F.lit(0.0)).alias(value))


def wide(df: DataFrame, task: list[str], model: str, models: list[str], values: list[str]) -> DataFrame:
    """One row a task, a column value__model for each; names given, so that no job looks for them."""
    return df.groupBy(*task).agg(*(F.max(F.when(F.col(model) == m, F.col(v))).alias(f"{v}__{m}") for v in values for m in models))
