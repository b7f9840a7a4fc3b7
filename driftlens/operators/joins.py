"""Joins of runs, scores, exposures and annotations, with what they must report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.names import cutoff_end
from driftlens.operators.metrics import average_rank, finite


def rank_correlation(df: DataFrame, by: list[str], left: str, right: str, least: int = 2) -> DataFrame:
    """(by, n, rho) over rows where both are finite; rho is null for fewer than `least` rows or a constant side."""
    rows = df.filter(finite(left) & finite(right))
    ranked = rows.select(*by, average_rank(left, by).alias("_a"), average_rank(right, by).alias("_b"))
    varies = (F.count(F.lit(1)) >= least) & (F.max("_a") > F.min("_a")) & (F.max("_b") > F.min("_b"))
    # a constant side has no variance to divide by
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(varies, F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b"))).alias("rho"))


def many_to_one(rows: DataFrame, one: DataFrame, on: list[str], value: str) -> DataFrame:
    """rows with `value` of the other side; `unmatched` counts nothing away: it marks rows without a partner."""
    return rows.join(one.select(*on, value), on, "left").withColumn("unmatched", F.col(value).isNull())


def flag(rows: DataFrame, other: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows with a boolean: whether their key stands in the other table. No row is dropped or repeated."""
    return rows.join(other.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def three_state(rows: DataFrame, known: DataFrame, item: str, annotation: str) -> DataFrame:
    """Each item's annotations that the known side has too: (status, overlap, shared).

    An item without annotations is `undocumented` with null overlap: missing never means clean."""
    seen = known.select(annotation).filter(F.col(annotation).isNotNull()).distinct().withColumn("_seen", F.lit(True))
    each = rows.join(seen, annotation, "left").groupBy(item).agg(F.count(annotation).alias("_n"), F.array_sort(F.collect_set(F.when(F.col("_seen"), F.col(annotation).cast("string")))).alias("_shared"))
    audited = F.col("_n") > 0
    return each.select(item, F.when(audited, "audited").otherwise("undocumented").alias("status"), F.when(audited, F.size("_shared") > 0).alias("overlap"), F.when(audited, F.array_join("_shared", ";")).alias("shared"))


def exposure(targets: DataFrame, models: DataFrame, most: int = 10_000) -> DataFrame:
    """targets(target_id, unseen, published) by models(model_id, declared, cutoff): the category of each pair.

    Models are a short stated list; more than `most` raise instead of being sent to all tasks."""
    if models.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} models")
    pairs = targets.crossJoin(F.broadcast(models)).withColumns({"_d": F.lower("declared"), "_end": cutoff_end(F.col("cutoff"))})
    dated = F.col("_end").isNotNull() & F.col("published").isNotNull()
    category = F.when(F.col("_d") == "known", "known").when(~F.col("unseen"), "possible").when(dated & (F.col("published") > F.col("_end")), "clean").when(dated, "possible").when(F.col("_d").isin("clean", "possible"), F.col("_d")).otherwise("undocumented")
    return pairs.select("target_id", "model_id", category.alias("category"))


def interval_overlap(left: DataFrame, right: DataFrame, on: list[str], least_share: float = 0.5) -> DataFrame:
    """left(on, a, b) with right(on, c, d): inclusive overlap, its share of the shorter span, and whether that suffices."""
    overlap = F.greatest(F.lit(0), F.least("b", "d") - F.greatest("a", "c") + 1)
    share = overlap / F.least(F.col("b") - F.col("a") + 1, F.col("d") - F.col("c") + 1)
    return left.join(right, on).withColumns({"overlap": overlap, "share": share}).withColumn("qualifies", F.col("share") >= least_share)


def group_pairs(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, a, b) of each item and the least item of its group: enough to connect the group, one row an item."""
    least = F.min(item).over(Window.partitionBy(group))
    return df.select(group, item).distinct().withColumn("a", least).filter(F.col(item) > F.col("a")).select(group, "a", F.col(item).alias("b"))


def region_offset(target: DataFrame, canonical: DataFrame, on: str) -> DataFrame:
    """Ungapped alignment of target(on, place, residue) to canonical(on, place, residue).

    The offset with most equal residues, ties to the smallest absolute and then the smaller one; matched
    residues, and the first and last canonical place among them."""
    pairs = target.select(on, F.col("place").alias("_t"), "residue").join(canonical.select(on, F.col("place").alias("_c"), "residue"), [on, "residue"])
    counted = pairs.groupBy(on, (F.col("_c") - F.col("_t")).alias("offset")).agg(F.count(F.lit(1)).alias("mapped"), F.min("_c").alias("first"), F.max("_c").alias("last"))
    order = Window.partitionBy(on).orderBy(F.desc("mapped"), F.abs("offset"), "offset")
    return counted.withColumn("_i", F.row_number().over(order)).filter("_i = 1").drop("_i")


def paired(df: DataFrame, key: list[str], side: str, first: str, second: str, values: list[str]) -> DataFrame:
    """Both sides of a column `side`, paired one to one by key, and second minus first of each value.

    A key that has one side only or one side twice raises when it is met."""
    ones = {s: [F.max(F.when(F.col(side) == s, F.col(v))) for v in values] for s in (first, second)}
    fits = (F.count_if(F.col(side) == first) == 1) & (F.count_if(F.col(side) == second) == 1)
    rows = df.filter(F.col(side).isin(first, second)).groupBy(*key).agg(fits.alias("_fits"), *(b.alias(f"_b{i}") for i, b in enumerate(ones[second])), *(a.alias(f"_a{i}") for i, a in enumerate(ones[first])))
    checked: Column = F.when(F.col("_fits"), F.lit(True)).otherwise(F.raise_error(F.lit("a key is not paired")).cast("boolean"))
    return rows.filter(checked).select(*key, *(c.alias(n) for i, v in enumerate(values) for n, c in ((f"{first}_{v}", F.col(f"_a{i}")), (f"{second}_{v}", F.col(f"_b{i}")), (f"{v}_delta", F.col(f"_b{i}") - F.col(f"_a{i}")))))


def align_models(source: DataFrame, stored: DataFrame, by: list[str], item: str, models: list[str]) -> DataFrame:
    """(by, items, matched, finite_<model>...): distinct items of source, those that stored holds, and those with a
    finite score of each model in any of their stored rows."""
    seen = stored.groupBy(*by, item).agg(F.lit(1).alias("_matched"), *(F.max(finite(m).cast("int")).alias(f"_finite_{m}") for m in models))
    rows = source.select(*by, item).distinct().join(seen, [*by, item], "left")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.count("_matched").alias("matched"), *(F.count_if(F.col(f"_finite_{m}") == 1).alias(f"finite_{m}") for m in models))
