"""Bootstraps by how often each draw takes a unit, in place of copies of its rows.

Draws depend on the seed, the replicate and the unit's place alone, so that all models and policies share them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.codes import draw
from driftlens.operators import positions
from driftlens.operators.crossfit import areas
from driftlens.operators.metrics import average_rank, finite, regression
from driftlens.operators.nested import limits
from driftlens.operators.storage import stored


def times(units: DataFrame, by: list[str], unit: str, repeats: int = 200, seed: int = 1, level: str = "") -> DataFrame:
    """(by, unit, _rep, _times): how often each replicate takes each unit of its group, drawn as many times as
    there are units; units that a replicate leaves out have no row."""
    own = Window.partitionBy(*by)
    numbered = units.select(*by, unit).distinct().withColumn("_i", F.row_number().over(own.orderBy(unit)) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    slots = numbered.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    name = F.concat_ws("/", *by) if by else F.lit("")
    picks = slots.select(*by, "_rep", F.pmod(draw(seed, F.lit(level), name, F.col("_rep"), F.col("_i")), F.col("_n")).cast("int").alias("_i"))
    return picks.groupBy(*by, "_rep", "_i").agg(F.count(F.lit(1)).alias("_times")).join(numbered.drop("_n"), [*by, "_i"]).drop("_i")


def nested_times(units: DataFrame, levels: list[str], repeats: int = 200, seed: int = 1) -> DataFrame:
    """(levels, _rep, _times) of the last level's units, drawn level by level, anew for each copy of the unit above.

    Each level is summed up before the next is drawn: what is held grows with the units, not with copies."""
    state = None
    for k, level in enumerate(levels):
        above = levels[:k]
        own = Window.partitionBy(*above)
        children = units.select(*above, level).distinct().withColumn("_i", F.row_number().over(own.orderBy(level)) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
        if state is None:
            slots = children.select("_n", F.col("_i").alias("_slot")).withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_copy", F.lit(1))
        else:
            slots = state.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).join(children.select(*above, "_n", F.col("_i").alias("_slot")), above)
        name = F.concat_ws("/", *above) if above else F.lit("")
        picks = slots.select(*above, "_rep", F.pmod(draw(seed, F.lit(level), name, F.col("_rep"), F.col("_copy"), F.col("_slot")), F.col("_n")).cast("int").alias("_i"))
        state = picks.groupBy(*above, "_rep", "_i").agg(F.count(F.lit(1)).alias("_times")).join(children.drop("_n"), [*above, "_i"]).drop("_i")
    return state


def policy_difference(ours: DataFrame, other: DataFrame, levels: list[str], target: str = "gain", regret: str = "regret", certainty: str = "confidence", repeats: int = 200, seed: int = 1) -> DataFrame:
    """(endpoint, point, lower, upper, above_zero): how much less area of regret, and of gains of 0 or less, over coverage
    our choices have than the other's. Both hold one row a task (the last level); unequal tasks raise."""
    task = levels[-1]
    both = ours.select(*levels, "regret", target, certainty, F.lit("ours").alias("side")).unionByName(other.select(*levels, "regret", target, certainty, F.lit("other").alias("side")))
    once = both.groupBy(task).agg(F.count_if(F.col("side") == "ours").alias("_ours"), F.count_if(F.col("side") == "other").alias("_other"))
    matched = (F.col("_ours") == 1) & (F.col("_other") == 1)
    both = both.join(once, task).withColumn("side", F.when(matched, F.col("side")).otherwise(F.raise_error(F.lit("policies must cover the same tasks once each")))).drop("_ours", "_other")
    values = {"regret_area": F.col(regret), "risk_area": (F.col(target) <= 0).cast("double")}
    order = [F.desc(certainty), F.col(task)]

    def improved(rows: DataFrame, by: list[str], count: Column | None) -> DataFrame:
        made = areas(rows, [*by, "side"], order, values, count).unpivot([*by, "side"], list(values), "endpoint", "area")
        side = lambda s: F.max(F.when(F.col("side") == s, F.col("area")))
        return made.groupBy(*by, "endpoint").agg((side("other") - side("ours")).alias("value"))

    point = improved(both, [], None).withColumnRenamed("value", "point")
    drawn = nested_times(ours.select(*levels), levels, repeats, seed)
    reps = improved(both.join(drawn, levels), ["_rep"], F.col("_times"))
    above = reps.groupBy("endpoint").agg(F.avg((F.col("value") > 0).cast("double")).alias("above_zero"))
    return point.join(limits(reps, ["endpoint"], "value").drop("p"), "endpoint").join(above, "endpoint")


def nested_external(df: DataFrame, models: tuple[str, str], protein: str = "protein_id", assay: str = "assay_id", position: str = "position", model: str = "model_id", observed: str = "observed", predicted: str = "predicted", repeats: int = 200, seed: int = 1) -> DataFrame:
    """(model, mean_spearman, bootstrap_mean, lower, upper, proteins, assays, above_zero) of both models and of their
    difference: positions drawn within assays (ranks fixed), assays within proteins, and proteins.

    Means are over assays of a protein, then over proteins; both models share every draw."""
    rows = df.filter(F.col(model).isin(*models) & finite(observed) & finite(predicted))
    one = [protein, assay, model]
    ranked = rows.select(*one, position, average_rank(observed, one).alias("_x"), average_rank(predicted, one).alias("_y"))
    sides = {f"_side{i}": (F.col(model) == m) & F.col(position).isNotNull() for i, m in enumerate(models)}
    places = positions.gathered(ranked, [protein, assay], position, sides).withColumn("_name", F.concat_ws("/", protein, assay))
    # written once, with an assay's draws in its row: means, draws of assays and counts read this
    every = stored(positions.replicates(places, [protein, assay], list(sides), repeats, f"{seed}|position", named=True))
    values = every.select(protein, assay, F.explode(F.array(*(F.struct(F.lit(m).alias(model), F.col(c).alias("_all")) for m, c in zip(models, sides, strict=True)))).alias("_m")).select(protein, assay, f"_m.{model}", F.posexplode("_m._all").alias("_rep", "_rho")).dropna(subset=["_rho"])
    assays = times(every, [protein], assay, repeats, seed, "assay").withColumnRenamed("_times", "_a")
    proteins = times(every, [], protein, repeats, seed, "protein").withColumnRenamed("_times", "_b")
    mean = lambda v, w: F.sum(F.col(v) * F.col(w)) / F.sum(w)
    per = values.join(assays, [protein, assay, "_rep"]).groupBy(protein, model, "_rep").agg(mean("_rho", "_a").alias("_v"))
    drawn = per.join(proteins, [protein, "_rep"]).groupBy(model, "_rep").agg(mean("_v", "_b").alias("value"))
    points = regression(rows, one, observed, predicted).groupBy(protein, model).agg(F.avg("spearman").alias("_v")).groupBy(model).agg(F.avg("_v").alias("value"))

    def with_difference(made: DataFrame, by: list[str]) -> DataFrame:
        side = lambda m: F.max(F.when(F.col(model) == m, F.col("value")))
        gap = made.groupBy(*by).agg((side(models[0]) - side(models[1])).alias("value")).select(F.lit(f"{models[0]}_minus_{models[1]}").alias("model"), *by, "value")
        return made.select(F.col(model).alias("model"), *by, "value").unionByName(gap)

    reps = with_difference(drawn, ["_rep"])
    sizes = every.agg(F.count_distinct(protein).alias("proteins"), F.count_distinct(assay).alias("assays"))
    made = reps.groupBy("model").agg(F.avg("value").alias("bootstrap_mean")).join(limits(reps, ["model"], "value").drop("p"), "model")
    return with_difference(points, []).withColumnRenamed("value", "mean_spearman").join(made, "model").crossJoin(sizes).withColumn("above_zero", F.col("lower") > 0)
