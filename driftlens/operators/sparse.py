"""Ridge regression on sparse indicators, for all groups at once, by conjugate gradients.

Groups of up to `GATHERED` rows are dealt into buckets, and a task runs the steps of all groups of a bucket over arrays: the
rows are shuffled once, whatever the number of steps. Larger groups, whose features are never gathered, take the
same steps over long tables, two aggregations each: values of rows from weights of features, and back. Products
about the mean need no dense matrix: the columns' sums stand beside the features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.functions.codes import parse
from driftlens.operators.features import additive, by_code, indicators
from driftlens.operators.metrics import finite
from driftlens.operators.storage import discard, stored


def sparse_ridge(entries: DataFrame, rows: DataFrame, by: list[str], row: str, alpha: float = 20.0, target: str = "observed", tolerance: float = 1e-8, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """((by, feature, weight), (by, mean_target, shift)): the prediction of a row is mean_target - shift + its entries
    times weights.

    entries(by, row, feature, value): no two of a row and feature; rows(by, row, target): the train rows, also those
    without entries. Weights are penalised by alpha, the intercept is free, nothing is scaled. A group is
    done once its residual is `tolerance` of the first one; more than `most` steps raise."""
    rows = stored(rows.filter(finite(target)).select(*by, row, F.col(target).cast("double").alias("_y")))
    x = stored(entries.join(rows.select(*by, row), [*by, row], "left_semi").select(*by, row, "feature", F.col("value").cast("double").alias("_v")))
    groups = stored(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.avg("_y").alias("_mean")))
    start = x.join(rows, [*by, row]).join(groups, by)
    # the first residual is X'(y - mean), the first direction the same
    state = start.groupBy(*by, "feature").agg(F.sum(F.col("_v") * (F.col("_y") - F.col("_mean"))).alias("_r"), F.sum("_v").alias("_sum")).withColumns({"_w": F.lit(0.0), "_p": F.col("_r")})
    state = stored(state)
    norms = stored(state.groupBy(*by).agg(F.sum(F.col("_r") * F.col("_r")).alias("_rr")).withColumn("_first", F.col("_rr")))
    for _ in range(most):
        live = norms.filter((F.col("_rr") > F.col("_first") * tolerance**2) & (F.col("_rr") > 0)).select(*by, "_rr")
        if live.isEmpty():
            break
        moving = state.join(live, by)
        along = x.join(moving.select(*by, "feature", "_p"), [*by, "feature"]).groupBy(*by, row).agg(F.sum(F.col("_v") * F.col("_p")).alias("_q"))
        back = x.join(along, [*by, row]).groupBy(*by, "feature").agg(F.sum(F.col("_v") * F.col("_q")).alias("_z"))
        # the mean of q over all rows of the group, from the columns' sums
        centre = moving.groupBy(*by).agg(F.sum(F.col("_sum") * F.col("_p")).alias("_total")).join(groups, by).select(*by, (F.col("_total") / F.col("_rows")).alias("_centre"))
        turned = stored(moving.join(back, [*by, "feature"], "left").join(centre, by).withColumn("_z", F.coalesce("_z", F.lit(0.0)) - F.col("_sum") * F.col("_centre") + alpha * F.col("_p")).drop("_centre"))
        step = turned.groupBy(*by).agg((F.max("_rr") / F.sum(F.col("_p") * F.col("_z"))).alias("_step"))
        moved = turned.join(step, by).withColumns({"_w": F.col("_w") + F.col("_step") * F.col("_p"), "_r": F.col("_r") - F.col("_step") * F.col("_z")})
        moved = stored(moved.select(*by, "feature", "_w", "_r", "_p", "_sum", F.col("_rr").alias("_old")))
        left = stored(moved.groupBy(*by).agg(F.sum(F.col("_r") * F.col("_r")).alias("_new"), F.max("_old").alias("_old")))
        made = moved.join(left.select(*by, "_new"), by).withColumn("_p", F.col("_r") + F.col("_new") / F.col("_old") * F.col("_p")).select(*state.columns)
        new_state = stored(made.unionByName(state.join(live.select(*by), by, "left_anti")))
        new_norms = stored(norms.join(left.select(*by, "_new"), by, "left").select(*by, F.coalesce("_new", "_rr").alias("_rr"), "_first"))
        discard(state, norms, turned, moved, left)
        state, norms = new_state, new_norms
    else:
        raise RuntimeError(f"conjugate gradients did not settle within {most} steps")
    shift = state.groupBy(*by).agg(F.sum(F.col("_sum") * F.col("_w")).alias("_s"))
    constants = groups.join(shift, by, "left").select(*by, F.col("_mean").alias("mean_target"), (F.coalesce("_s", F.lit(0.0)) / F.col("_rows")).alias("shift"))
    return state.select(*by, "feature", F.col("_w").alias("weight")), constants


#: Rows of the largest group that one task fits, and rows that a bucket of such groups holds about.
GATHERED, BUCKET = 100_000, 100_000


def _steps(group: np.ndarray, y: np.ndarray, row: np.ndarray, feature: np.ndarray, owner: np.ndarray, groups: int, alpha: float, tolerance: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each feature, mean_target - shift of each group) of `sparse_ridge` on indicators.

    group, y: of each train row; row, feature: of each entry; owner: the group of each feature."""
    size = len(owner)
    rows = np.bincount(group, minlength=groups)
    held = np.maximum(rows, 1)
    mean = np.bincount(group, y, groups) / held
    total = np.bincount(feature, minlength=size).astype(float)
    r = np.bincount(feature, (y - mean[group])[row], size)
    w, p = np.zeros(size), r.copy()
    rr = np.bincount(owner, r * r, groups)
    first = rr.copy()
    for _ in range(most):
        live = (rr > first * tolerance**2) & (rr > 0)
        if not live.any():
            break
        p[~live[owner]] = 0.0
        q = np.bincount(row, p[feature], len(y))
        centre = np.bincount(owner, total * p, groups) / held
        z = np.bincount(feature, q[row], size) - total * centre[owner] + alpha * p
        along = np.bincount(owner, p * z, groups)
        step = np.divide(rr, along, out=np.zeros(groups), where=live)[owner]
        w += step * p
        r -= step * z
        new = np.where(live, np.bincount(owner, r * r, groups), rr)
        p = r + np.divide(new, rr, out=np.zeros(groups), where=live)[owner] * p
        rr = new
    else:
        raise RuntimeError(f"conjugate gradients did not settle within {most} steps")
    return w, mean - np.bincount(owner, total * w, groups) / held


def _gathered(rows: DataFrame, by: list[str], role: str, target: str, alpha: float, buckets: int, tolerance: float = 1e-8, most: int = 300) -> DataFrame:
    """The test rows of rows(..., _f: names of indicators) with `predicted`: a task fits all groups of a bucket."""
    names = [c for c in rows.columns if c != "_f"]
    fit = (F.col(role) == "train") & finite(target)
    dealt = rows.filter(fit | (F.col(role) == "test")).select(*names, F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("_key"), F.when(fit, F.col(target).cast("double")).alias("_y"), F.coalesce("_f", F.array().cast("array<string>")).alias("_f"), F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("_bucket"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        code = lambda a: (a.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(a.dictionary))
        flat = lambda name: table.column(name).combine_chunks()
        one = lambda a: a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
        group, groups = code(one(flat("_key")).dictionary_encode())
        y = one(flat("_y")).to_numpy(zero_copy_only=False).astype(float)
        lists = one(flat("_f"))
        own = np.repeat(np.arange(len(group)), np.diff(lists.offsets.to_numpy()))
        named, kinds = code(lists.flatten().dictionary_encode())
        known = ~np.isnan(y)
        # a feature is one of its group; what no train row has takes no part
        train = known[own]
        ids, at = np.unique(group[own[train]] * kinds + named[train], return_inverse=True)
        place = np.cumsum(known) - 1
        w, base = _steps(group[known], y[known], place[own[train]], at, ids // max(kinds, 1), groups, alpha, tolerance, most)
        base[np.bincount(group[known], minlength=groups) == 0] = np.nan
        wanted, tested = group[own[~train]] * kinds + named[~train], own[~train]
        found = np.searchsorted(ids, wanted)
        hit = found < len(ids)
        hit[hit] = ids[found[hit]] == wanted[hit]
        out = base[group] + np.bincount(tested[hit], w[found[hit]], len(group))
        kept = table.select(names).append_column("predicted", pa.array(out, mask=np.isnan(out)))
        return kept.filter(pa.array(~known))

    return dealt.groupBy("_bucket").applyInArrow(run, T.StructType([*rows.select(*names).schema.fields, T.StructField("predicted", T.DoubleType())]))


def additive_ridge(df: DataFrame, by: list[str], code: str = "code", role: str = "role", target: str = "observed", alpha: float = 20.0) -> DataFrame:
    """df's test rows with `predicted` from the additive indicators of their code, fitted on their group's train rows.

    Indicators that no train row has count for nothing; invalid codes have none. Groups without train rows give null."""
    rows = stored(df)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    # as few as the rows over GATHERED
    large = stored(sizes.filter(F.col("_n") > GATHERED).select(*by))
    none = large.isEmpty()
    small = rows if none else rows.join(F.broadcast(large), by, "left_anti")
    named = F.coalesce(F.array_distinct(F.flatten(F.transform(parse(F.col(code)), indicators))), F.array().cast("array<string>"))
    small = by_code(small, code, lambda codes: codes.withColumn("_f", named))
    made = _gathered(small, by, role, target, alpha, max(1, -(-rows.count() // BUCKET)))
    return made if none else made.unionByName(_long(rows.join(F.broadcast(large), by, "left_semi"), by, code, role, target, alpha))


def _long(df: DataFrame, by: list[str], code: str, role: str, target: str, alpha: float) -> DataFrame:
    """`additive_ridge` over long tables."""
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()))
    entries = additive(rows, [*by, "_row", role], code).distinct().withColumn("value", F.lit(1.0))
    weights, constants = sparse_ridge(entries.filter(F.col(role) == "train").drop(role), rows.filter(F.col(role) == "train"), by, "_row", alpha, target)
    test = rows.filter(F.col(role) == "test")
    score = entries.filter(F.col(role) == "test").join(weights, [*by, "feature"]).groupBy("_row").agg(F.sum("weight").alias("_score"))
    made = test.join(score, "_row", "left").join(constants, by, "left")
    return made.withColumn("predicted", F.col("mean_target") - F.col("shift") + F.coalesce("_score", F.lit(0.0))).drop("_row", "_score", "mean_target", "shift")
