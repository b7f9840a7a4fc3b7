"""Roll-ups in which every protein weighs the same, distributions, resampling and multiplicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.codes import draw


def gaps(runs: DataFrame, by: list[str], split: str, metric: str, first: str, second: str) -> DataFrame:
    """Each key's metric on two splits, side by side, and their difference."""
    one, two = (F.max(F.when(F.col(split) == s, F.col(metric))) for s in (first, second))
    return runs.groupBy(*by).agg(one.alias(f"{first}_{metric}"), two.alias(f"{second}_{metric}"), (one - two).alias(f"{metric}_gap"))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.percentile(value, F.lit(0.05)).alias("p05"), F.percentile(value, F.lit(0.95)).alias("p95"), F.max(value).alias("max"))


def balanced(df: DataFrame, by: list[str], levels: list[str], value: str) -> DataFrame:
    """Mean within the first level, then over the next, and so on, so that each last one weighs the same."""
    for i in range(len(levels)):
        df = df.groupBy(*by, *levels[i:]).agg(F.avg(value).alias(value))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.avg(value).alias("mean"))


def replicates(df: DataFrame, by: list[str], unit: str, values: list[str], repeats: int = 200, seed: int = 1) -> DataFrame:
    """(by, _rep, _n, values): means over each group's units drawn with replacement; all values share the draws."""
    own = Window.partitionBy(*by)
    units = df.withColumn("_i", F.row_number().over(own.orderBy(unit)) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    slots = units.select(*by, "_n", F.col("_i").alias("_slot")).withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    drawn = slots.withColumn("_i", F.pmod(draw(seed, F.col("_rep"), F.col("_slot")), F.col("_n")).cast("int")).select(*by, "_rep", "_i", "_n")
    return drawn.join(units.select(*by, "_i", *values), [*by, "_i"]).groupBy(*by, "_rep", "_n").agg(*(F.avg(v).alias(v) for v in values))


def bootstrap_mean(df: DataFrame, by: list[str], unit: str, value: str, repeats: int = 200, seed: int = 1) -> DataFrame:
    """lower and upper 2.5 % of means over units drawn with replacement; null for fewer than two units."""
    edge = lambda q: F.when(F.max("_n") > 1, F.percentile(value, F.lit(q)))
    return replicates(df, by, unit, [value], repeats, seed).groupBy(*by).agg(edge(0.025).alias("lower"), edge(0.975).alias("upper"))


def holm(df: DataFrame, by: list[str], name: str, p: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(p, name)
    left = F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.row_number().over(order) + 1
    return df.withColumn("_a", F.least(F.lit(1.0), left * F.col(p))).withColumn("adjusted", F.max("_a").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_a")


def multi(df: DataFrame, by: list[str], unit: str, value: str) -> DataFrame:
    """Over units that weigh the same: their number, mean, median, and the share above 0."""
    units = df.groupBy(*by, unit).agg(F.avg(value).alias("_v"))
    return units.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.avg("_v").alias("mean"), F.median("_v").alias("median"), F.avg((F.col("_v") > 0).cast("double")).alias("positive_share"))


def clusters(df: DataFrame, group: str, item: str) -> DataFrame:
    """One row: groups, groups of one item, and items of the largest."""
    sizes = df.groupBy(group).agg(F.count_distinct(item).alias("_n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("_n") == 1).alias("singles"), F.max("_n").alias("largest"))
