"""Models of selection gain that never see the family they judge: folds crossed with rows, one fit over all folds.

A row is copied once a fold with the part it plays there, every fit runs over all folds at once, and only the held
rows are predicted. Policies are chosen on such predictions alone."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.codes import draw
from driftlens.operators import boosting, linear
from driftlens.operators.intervals import hierarchical_quantile
from driftlens.operators.panels import override, priority
from driftlens.operators.storage import stored
from driftlens.operators.tables import group_folds

#: Boosting settings tried, shares of a prediction against its model's prior, and margins over the baseline.
CANDIDATES: tuple[dict, ...] = (
    {"rate": 0.05, "rounds": 250, "leaves": 15, "least": 10, "l2": 1.0},
    {"rate": 0.03, "rounds": 500, "leaves": 15, "least": 20, "l2": 1.0},
    {"rate": 0.05, "rounds": 300, "leaves": 31, "least": 20, "l2": 2.0},
)
SHRINKAGE, MARGINS = (0.5, 0.75, 1.0), (0.05, 0.075, 0.1, 0.15)
#: The error-scale model's settings.
SCALE = {"rate": 0.05, "rounds": 250, "leaves": 15, "least": 15, "l2": 1.0}


@dataclass
class Columns:
    """What the columns of a task table are called."""

    features: list[str]
    group: str = "family_id"
    task: str = "task_id"
    model: str = "model_id"
    target: str = "gain"
    neff: str = "msa_neff"
    length: str = "protein_length"
    keys: list[str] = field(default_factory=list)


def folded(df: DataFrame, by: list[str], group: str, folds: int, into: str = "fold", seed: int = 1) -> DataFrame:
    """df with the fold of each row's whole group, within `by`; groups of one `by` must be `folds` at least."""
    placed = group_folds(df, by, group, folds, seed).select(*by, group, F.col("fold").alias(into))
    return df.join(placed, [*by, group])


def crossed(df: DataFrame, own: str, folds: int, into: str) -> DataFrame:
    """Each row once a fold, with role test in its own fold and train in the others."""
    rows = df.withColumn(into, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return rows.withColumn("role", F.when(F.col(into) == F.col(own), "test").otherwise("train"))


def estimate(df: DataFrame, by: list[str], columns: Columns, estimator: str, parameters: dict, target: str | None = None, loss: str = "squared") -> DataFrame:
    """df's rows that are not of role train with `predicted` of the model fitted on those that are, by `by`."""
    target = target or columns.target
    train, rest = df.filter("role = 'train'"), df.filter("role <> 'train'")
    if estimator == "elastic_net":
        return linear.predict(rest, linear.elastic_net(train, by, columns.features, target), by, columns.features)
    if estimator == "boosted":
        return boosting.predict(rest, boosting.fit(train, by, columns.features, target, loss=loss, **parameters), by)
    raise ValueError(f"no estimator {estimator}")


def out_of_group(df: DataFrame, by: list[str], columns: Columns, folds: int = 4, estimator: str = "boosted", parameters: dict | None = None) -> DataFrame:
    """df with `predicted` from models that saw no row of its group, `prior` (its model's mean target among the rows
    they saw) and `baseline` (the model of the highest such mean; ties: least name).

    A group of `by` with fewer groups than folds raises, as does a row that no model predicts."""
    few = df.groupBy(*by).agg(F.count_distinct(columns.group).alias("_g")).agg(F.min("_g")).first()[0]
    if few is not None and few < folds:
        raise ValueError(f"{few} groups are fewer than {folds} folds")
    # a role that df has of its own comes back at the end
    kept = df.withColumnRenamed("role", "_role")
    rows = stored(crossed(folded(kept, by, columns.group, folds, "_own"), "_own", folds, "_fold"))
    inner = [*by, "_fold"]
    made = estimate(rows, inner, columns, estimator, parameters if parameters is not None else CANDIDATES[0])
    made = with_priors(made, rows.filter("role = 'train'"), inner, columns)
    made = made.withColumn("predicted", F.coalesce("predicted", F.raise_error(F.lit("a held row has no prediction")).cast("double")))
    return (made.drop("role").withColumnRenamed("_role", "role") if "role" in df.columns else made).select(*df.columns, "predicted", "prior", "baseline")


def with_priors(df: DataFrame, seen: DataFrame, by: list[str], columns: Columns) -> DataFrame:
    """df with `prior` and `baseline` from the rows seen; a model without a prior raises."""
    means = seen.groupBy(*by, columns.model).agg(F.avg(columns.target).alias("prior"))
    order = Window.partitionBy(*by).orderBy(F.desc("prior"), columns.model)
    best = means.withColumn("_i", F.row_number().over(order)).filter("_i = 1").select(*by, F.col(columns.model).alias("baseline"))
    joined = df.join(means, [*by, columns.model], "left").join(best, by) if by else df.join(means, columns.model, "left").crossJoin(best)
    return joined.withColumn("prior", F.coalesce("prior", F.raise_error(F.lit("a model has no prior")).cast("double")))


def search(df: DataFrame, by: list[str], columns: Columns, candidates: tuple[dict, ...] = CANDIDATES, folds: int = 4) -> tuple[DataFrame, DataFrame]:
    """((by, candidate, error, chosen), out-of-group predictions of every candidate): the error is the mean over folds of
    the mean over groups of the mean absolute error; the least error is chosen, the first candidate on ties."""
    made = None
    for i, parameters in enumerate(candidates):
        one = out_of_group(df, by, columns, folds, "boosted", parameters).withColumn("candidate", F.lit(i))
        made = one if made is None else made.unionByName(one)
    made = stored(made)
    places = group_folds(df, by, columns.group, folds).select(*by, columns.group, "fold")
    gap = F.abs(F.col(columns.target) - F.col("predicted"))
    errors = made.groupBy(*by, "candidate", columns.group).agg(F.avg(gap).alias("_e")).join(places, [*by, columns.group]).groupBy(*by, "candidate", "fold").agg(F.avg("_e").alias("_e")).groupBy(*by, "candidate").agg(F.avg("_e").alias("error"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("error", 12), "candidate"))
    return errors.withColumn("chosen", first == 1), made


# policies

def areas(df: DataFrame, by: list[str], order: list[Column | str], values: dict[str, Column], times: Column | None = None, steps: int = 10) -> DataFrame:
    """(by, a column a value): the area under the mean of the surest ceil(n coverage) rows over coverages 1 / steps .. 1.

    times: how often each row counts; a row's copies stand side by side, and no copies are made."""
    times = F.lit(1) if times is None else times
    own = Window.partitionBy(*by)
    rows = df.withColumn("_times", times.cast("long"))
    before = F.coalesce(F.sum("_times").over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).withColumn("_total", F.sum("_times").over(own))
    upto = [F.greatest(F.lit(1), F.ceil(F.col("_total") * F.lit(i / steps))) for i in range(1, steps + 1)]
    taken = [F.greatest(F.lit(0), F.least(F.col("_times"), k - F.col("_before"))) for k in upto]
    made = rows.groupBy(*by).agg(*((F.sum(v * t) / F.max(k)).alias(f"_{name}{i}") for name, v in values.items() for i, (k, t) in enumerate(zip(upto, taken, strict=True))))
    return made.select(*by, *(sum((F.col(f"_{name}{i}") + F.col(f"_{name}{i + 1}")) / (2 * steps) for i in range(steps - 1)).alias(name) for name in values))


def decided(df: DataFrame, by: list[str], columns: Columns, shrinkage: Column, margin: Column) -> DataFrame:
    """The row of each task that the policy takes: the highest decision if it beats the baseline's by the margin, else the
    baseline. decision = shrinkage * predicted + (1 - shrinkage) * prior; regret against the task's best target."""
    task = [*by, columns.task]
    best = F.max(columns.target).over(Window.partitionBy(*task))
    rows = df.withColumn("decision", shrinkage * F.col("predicted") + (1 - shrinkage) * F.col("prior")).withColumn("regret", best - F.col(columns.target))
    return override(rows, task, columns.model, "decision", F.col("baseline"), margin)


def _logged(c: str) -> Column:
    return F.when(F.col(c) >= 0, F.log1p(F.col(c).cast("double")))


def constants(taken: DataFrame, by: list[str], columns: Columns) -> DataFrame:
    """(by, decision_mean, decision_sd, neff_mean, neff_sd, length_mean, length_sd) over the rows taken; 0 and 1 where there are none."""
    parts = {"decision": F.col("decision"), "neff": _logged(columns.neff), "length": _logged(columns.length)}
    spread = lambda v: F.coalesce(F.when(F.stddev_pop(v) > 1e-12, F.stddev_pop(v)), F.lit(1.0))
    return taken.groupBy(*by).agg(*(x for n, v in parts.items() for x in (F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{n}_mean"), spread(v).alias(f"{n}_sd"))))


def confidence(columns: Columns) -> Column:
    own = {n: (F.col(f"{n}_mean"), F.col(f"{n}_sd")) for n in ("decision", "neff", "length")}
    return priority({"neff": F.col(columns.neff).cast("double"), "length": F.col(columns.length).cast("double"), "decision": F.col("decision")}, own)


def policy_search(predictions: DataFrame, by: list[str], columns: Columns, shrinkage: tuple[float, ...] = SHRINKAGE, margins: tuple[float, ...] = MARGINS) -> DataFrame:
    """(by, shrinkage, margin, regret_area, mean_regret, constants, chosen) of every candidate, from out-of-group
    predictions with `prior` and `baseline`: all candidates in one pass over the rows, crossed with the grid.

    Chosen is the least area of regret over coverage, then the least mean regret, the largest margin and shrinkage."""
    grid = F.array(*(F.struct(F.lit(s).alias("shrinkage"), F.lit(m).alias("margin")) for s in shrinkage for m in margins))
    rows = predictions.withColumn("_c", F.explode(grid)).select(*predictions.columns, "_c.*")
    one = [*by, "shrinkage", "margin"]
    taken = decided(rows, one, columns, F.col("shrinkage"), F.col("margin"))
    fixed = constants(taken, one, columns)
    sure = taken.join(fixed, one).withColumn("_confidence", F.round(confidence(columns), 9))
    area = areas(sure, one, [F.desc("_confidence"), F.col(columns.task)], {"regret_area": F.col("regret")})
    made = area.join(taken.groupBy(*one).agg(F.avg("regret").alias("mean_regret")), one).join(fixed, one)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("regret_area", 9), F.round("mean_regret", 9), F.desc("margin"), F.desc("shrinkage")))
    return made.withColumn("chosen", first == 1)


def selected_lower(df: DataFrame, by: list[str], columns: Columns, policy: DataFrame, coverage: float = 0.9, scale: str = "scale") -> DataFrame:
    """The rows of role test with decision, regret, selected, confidence, lower and trusted; calibrated on the rows of role
    calibration that the policy takes.

    df has predicted, prior, baseline (the policy's own) and scale; policy a row a group of `by` with shrinkage, margin and
    constants. A residual is (decision - target) / scale; its quantile gives each family equal mass and the
    rest to infinity, where the bound is null. trusted: selected with a bound above 0."""
    rows = stored((df.join(policy, by) if by else df.crossJoin(policy)).filter("role IN ('test', 'calibration')"))
    taken = decided(rows, [*by, "role"], columns, F.col("shrinkage"), F.col("margin"))
    residual = taken.filter("role = 'calibration'").withColumn("_r", (F.col("decision") - F.col(columns.target)) / F.col(scale))
    quantile = hierarchical_quantile(residual, by, columns.group, columns.task, "_r", coverage).withColumnRenamed("radius", "quantile")
    chosen = taken.filter("role = 'test'").select(*by, columns.task, columns.model, F.lit(True).alias("selected"), F.round(confidence(columns), 9).alias("confidence"))
    test = rows.filter("role = 'test'").withColumn("decision", F.col("shrinkage") * F.col("predicted") + (1 - F.col("shrinkage")) * F.col("prior"))
    out = (test.join(quantile, by, "left") if by else test.crossJoin(quantile)).join(chosen, [*by, columns.task, columns.model], "left")
    lower = F.col("decision") - F.col("quantile") * F.col(scale)
    return out.withColumns({"selected": F.coalesce("selected", F.lit(False)), "lower": lower}).withColumn("trusted", F.col("selected") & F.coalesce(F.col("lower") > 0, F.lit(False)))


def error_scale(df: DataFrame, by: list[str], columns: Columns, error: str, settings: dict | None = None) -> DataFrame:
    """The rows not of role train with `scale`: the absolute error that boosted trees with absolute loss expect from the
    train rows' `error`, at least max(0.001, 0.05 * their median positive error)."""
    rows = df.withColumn("_error", F.abs(error))
    floor = rows.filter("role = 'train'").groupBy(*by).agg(F.greatest(F.lit(1e-3), 0.05 * F.coalesce(F.median(F.when(F.col("_error") > 0, F.col("_error"))), F.lit(0.0))).alias("_floor"))
    made = estimate(rows, by, columns, "boosted", settings or SCALE, "_error", "absolute").withColumnRenamed("predicted", "scale")
    joined = made.join(floor, by) if by else made.crossJoin(floor)
    return joined.withColumn("scale", F.greatest("scale", "_floor")).drop("_floor", "_error")


def cross_fit(df: DataFrame, columns: Columns, folds: int = 5, inner: int = 4, calibration: float = 0.2, coverage: float = 0.9, estimator: str = "boosted", candidates: tuple[dict, ...] = CANDIDATES, settings: dict | None = None, seed: int = 1) -> DataFrame:
    """Every row, predicted and calibrated by models that saw neither its family nor its calibration families.

    An outer fold's other families are dealt into fit and calibration by a draw. Within the fit families, out-of-group
    predictions choose the settings, the policy and the error scale; all outer folds run in each pass.
    Adds fold, candidate, predicted, prior, scale, decision, quantile, lower, selected, confidence, trusted."""
    outer = ["outer"]
    base = folded(df.withColumn("_id", F.monotonically_increasing_id()), [], columns.group, folds, "fold", seed)
    rows = crossed(base, "fold", folds, "outer")
    units = rows.filter("role = 'train'").select("outer", columns.group).distinct()
    own = Window.partitionBy("outer")
    placed = units.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_i", F.row_number().over(own.orderBy(draw(seed, F.col("outer"), F.col(columns.group)), columns.group)))
    held = placed.filter(F.col("_i") <= F.ceil(F.col("_n") * F.lit(calibration))).select("outer", columns.group, F.lit("calibration").alias("_as"))
    rows = rows.join(held, ["outer", columns.group], "left").withColumn("role", F.when((F.col("role") == "train") & F.col("_as").isNotNull(), F.col("_as")).otherwise(F.col("role"))).drop("_as")
    rows = stored(rows)
    fit = rows.filter("role = 'train'")
    if estimator == "boosted":
        errors, made = search(fit, outer, columns, candidates, inner)
        picked = stored(errors.filter("chosen").select("outer", "candidate"))
        honest = stored(made.join(picked, ["outer", "candidate"]))
        policy = policy_search(honest, outer, columns).filter("chosen").drop("chosen", "regret_area", "mean_regret")
    else:
        picked = rows.select("outer").distinct().withColumn("candidate", F.lit(0))
        honest = stored(out_of_group(fit, outer, columns, inner, estimator, {}).withColumn("candidate", F.lit(0)))
        taken = decided(honest, outer, columns, F.lit(1.0), F.lit(0.0))
        policy = constants(taken, outer, columns).withColumns({"shrinkage": F.lit(1.0), "margin": F.lit(0.0)})
    policy = stored(policy)
    predicted = None
    for i, parameters in enumerate(candidates if estimator == "boosted" else ({},)):
        some = rows.join(picked.filter(F.col("candidate") == i), outer)
        if some.isEmpty():
            continue
        one = estimate(some, outer, columns, estimator, parameters)
        predicted = one if predicted is None else predicted.unionByName(one)
    predicted = with_priors(stored(predicted), fit, outer, columns)
    # the error that the scale learns from: the policy's decisions on families the inner models did not see
    learned = honest.join(policy.select("outer", "shrinkage"), outer).withColumn("_e", F.col("shrinkage") * F.col("predicted") + (1 - F.col("shrinkage")) * F.col("prior") - F.col(columns.target))
    scaled = error_scale(learned.select(*rows.columns, "_e").unionByName(rows.filter("role <> 'train'").withColumn("_e", F.lit(None).cast("double"))), outer, columns, "_e", settings)
    full = predicted.join(scaled.select("outer", "_id", "role", "scale"), ["outer", "_id", "role"])
    out = selected_lower(full, outer, columns, policy, coverage)
    return out.select(*df.columns, "fold", "candidate", "predicted", "prior", "baseline", "scale", "decision", "quantile", "lower", "selected", "confidence", "trusted")


# abstention scores

def abstention_scores(df: DataFrame, reference: DataFrame, by: list[str], names: tuple[str, ...] = ("gain_meta", "gain_all", "gain_shape"), regret: str = "regret", weights: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0), decimals: int = 9) -> DataFrame:
    """df with pure_regret, harm_<gain> and blend_<weight>, from predictions alone and a frozen reference.

    safety = 1 - the share of the reference's regrets up to the row's; harm: harmonic mean of the gain's share and safety;
    blend: standardised gain_all less a weight times standardised regret. Shares count values rounded to `decimals`.
    An empty reference raises."""
    made = df.withColumn("_id", F.monotonically_increasing_id())
    made = stored(made)
    out = made
    for i, c in enumerate([regret, *names]):
        # the reference's values and the rows stand in one order; a running count of the former is each row's share
        ours = made.select(*by, F.round(c, decimals).alias("_v"), "_id", F.lit(0).alias("_r"))
        theirs = reference.select(*by, F.round(c, decimals).alias("_v"), F.lit(None).cast("long").alias("_id"), F.lit(1).alias("_r"))
        own = Window.partitionBy(*by)
        upto = F.sum("_r").over(own.orderBy("_v").rangeBetween(Window.unboundedPreceding, 0))
        share = upto / F.when(F.sum("_r").over(own) > 0, F.sum("_r").over(own)).otherwise(F.raise_error(F.lit("an empty reference")).cast("long"))
        shares = ours.unionByName(theirs).withColumn(f"_p{i}", share).filter("_id IS NOT NULL").select("_id", f"_p{i}")
        out = out.join(shares, "_id")
    safety = 1 - F.col("_p0")
    added = {"pure_regret": safety} | {f"harm_{n}": 2 * F.col(f"_p{i + 1}") * safety / (F.col(f"_p{i + 1}") + safety + 1e-12) for i, n in enumerate(names)}
    at = {c: (f"_mean_{c}", f"_sd_{c}") for c in ("gain_all", regret)}
    fixed = reference.groupBy(*by).agg(*(x for c, (m, s) in at.items() for x in (F.avg(c).alias(m), F.greatest(F.stddev_pop(c), F.lit(1e-9)).alias(s))))
    out = out.join(fixed, by) if by else out.crossJoin(fixed)
    z = {c: (F.col(c) - F.col(m)) / F.col(s) for c, (m, s) in at.items()}
    added |= {f"blend_{w}".replace(".", "_"): z["gain_all"] - w * z[regret] for w in weights}
    return out.select(*df.columns, *(v.alias(k) for k, v in added.items()))
