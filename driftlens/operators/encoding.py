"""A fitted table of imputed values, scales and categories, and its use on rows it has not seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.operators.metrics import finite


def fit(df: DataFrame, by: list[str], numeric: list[str], categorical: list[str] | None = None) -> DataFrame:
    """(by, rows, medians, means, scales, modes, categories): one row a group, to be stored as it is.

    Medians are exact and over finite values; means and scales (population, 1 for a constant) are those of the imputed
    column; a mode is the most frequent value, the least on ties. A column without any value has median 0
    and no categories. Categories are a column's distinct values, sorted: a group must not have very many."""
    categorical = categorical or []
    number = lambda c: F.when(finite(c), F.col(c).cast("double"))
    medians = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.array(*(F.coalesce(F.median(number(c)), F.lit(0.0)) for c in numeric)).cast("array<double>").alias("medians"))
    joined = df.join(F.broadcast(medians), by) if by else df.crossJoin(F.broadcast(medians))
    filled = [F.coalesce(number(c), F.get("medians", F.lit(i))) for i, c in enumerate(numeric)]
    spread = [F.coalesce(F.stddev_pop(v), F.lit(0.0)) for v in filled]
    scales = joined.groupBy(*by).agg(
        F.array(*(F.avg(v) for v in filled)).cast("array<double>").alias("means"), F.array(*(F.when(s > 1e-12, s).otherwise(1.0) for s in spread)).cast("array<double>").alias("scales"),
    )
    state = medians.join(scales, by) if by else medians.crossJoin(scales)
    modes, levels = [], []
    for i, c in enumerate(categorical):
        counts = df.filter(F.col(c).isNotNull()).groupBy(*by, F.col(c).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        # the least value on ties: the largest of (count, place from the end) would need an order on strings turned round
        top = counts.groupBy(*by).agg(F.max("_n").alias("_top"))
        held = counts.join(top, by) if by else counts.crossJoin(top)
        own = held.groupBy(*by).agg(F.min(F.when(F.col("_n") == F.col("_top"), F.col("_v"))).alias(f"_mode{i}"), F.sort_array(F.collect_set("_v")).alias(f"_levels{i}"))
        state = state.join(own, by, "left") if by else state.join(own, F.lit(True), "left")
        modes.append(F.col(f"_mode{i}")), levels.append(F.coalesce(f"_levels{i}", F.array().cast("array<string>")))
    return state.select(*by, "rows", "medians", "means", "scales", F.array(*modes).cast("array<string>").alias("modes"), F.array(*levels).cast("array<array<string>>").alias("categories"))


def _indicators(levels: Column, own: Column) -> Column:
    return F.transform(levels, lambda x: F.coalesce((x == own).cast("double"), F.lit(0.0)))


def encoded(numeric: list[str], categorical: list[str], scale: bool) -> Column:
    """The features of a row joined with its group's state: numbers, then one indicator a category; values that were
    not seen in the fit have no indicator."""
    at = lambda name, i: F.get(name, F.lit(i))
    parts = []
    for i, c in enumerate(numeric):
        v = F.coalesce(F.when(finite(c), F.col(c).cast("double")), at("medians", i))
        parts.append((v - at("means", i)) / at("scales", i) if scale else v)
    out = F.array(*parts).cast("array<double>")
    for i, c in enumerate(categorical):
        own = F.coalesce(F.col(c).cast("string"), at("modes", i))
        out = F.concat(out, _indicators(F.get("categories", F.lit(i)), own))
    return out


def apply(df: DataFrame, state: DataFrame, by: list[str], numeric: list[str], categorical: list[str] | None = None, scale: bool = False, into: str = "features") -> DataFrame:
    """df with the encoded features of each row as one array; null for groups the state does not know."""
    added = ["rows", "medians", "means", "scales", "modes", "categories"]
    inner = df.select(F.struct(*df.columns).alias("_row"), *by, *(F.col(c) for c in dict.fromkeys([*numeric, *(categorical or [])]) if c not in by))
    joined = inner.join(state.withColumn("_known", F.lit(True)), by, "left") if by else inner.crossJoin(F.broadcast(state.withColumn("_known", F.lit(True))))
    made = joined.withColumn(into if into not in added else "_made", F.when(F.col("_known"), encoded(numeric, categorical or [], scale)))
    return made.select("_row.*", into)


def names(state_row: object, numeric: list[str], categorical: list[str] | None = None) -> list[str]:
    """The name of each encoded feature, from one row of the state."""
    return [*numeric, *(f"{c}={v}" for c, levels in zip(categorical or [], state_row["categories"], strict=True) for v in levels)]
