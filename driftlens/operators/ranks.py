"""Average ranks within groups of any size, and what rests on them: no task sees a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators.metrics import finite
from driftlens.operators.storage import stored


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)), F.lit(True))


def average_ranks(df: DataFrame, by: list[str], ranks: dict[str, str], times: str | None = None) -> DataFrame:
    """df with a column for each of ranks (name -> value): ranks within by, ties sharing the mean of their places.

    Equal values are counted first, then dealt by ranges of the order; a range starts where the counts of earlier
    ones end, a table of one row a range and group. Rows without a value have no rank. times: how many rows a row stands for."""
    rows = df
    for name, value in ranks.items():
        counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("_k"))
        dealt = stored(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
        before = F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = dealt.groupBy("_part", *by).agg(F.sum("_k").alias("_size")).select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_s_{c}") for c in by), before.alias("_start"))
        upto = F.sum("_k").over(Window.partitionBy("_part", *by).orderBy(value))
        placed = dealt.withColumn("_upto", upto).join(starts, (F.col("_part") == F.col("_p")) & _same(by, [f"_s_{c}" for c in by]))
        # written: few values go to all tasks, so that no task joins all rows of one value
        own = stored(placed.select(*(F.col(c).alias(f"_r_{c}") for c in by), F.col(value).alias("_value"), (F.col("_start") + F.col("_upto") - (F.col("_k") - 1) / 2).alias(name)))
        rows = rows.join(own, _same([*by, value], [*(f"_r_{c}" for c in by), "_value"]), "left").drop("_value", *(f"_r_{c}" for c in by))
    return rows


def correlation(df: DataFrame, by: list[str], left: str, right: str, least: int = 2) -> DataFrame:
    """(by, n, rho) over rows where both are finite; rho is null for fewer than `least` rows or a constant side."""
    rows = df.filter(finite(left) & finite(right)).select(*by, F.col(left).cast("double").alias("_left"), F.col(right).cast("double").alias("_right"))
    # equal pairs are counted first: what follows grows with different pairs, and what made them runs once
    pairs = stored(rows.groupBy(*by, "_left", "_right").agg(F.count(F.lit(1)).alias("_k")))
    ranked = average_ranks(pairs, by, {"_a": "_left", "_b": "_right"}, "_k")
    n = F.sum("_k")
    about = lambda x, y: F.sum(F.col("_k") * F.col(x) * F.col(y)) - F.sum(F.col("_k") * F.col(x)) * F.sum(F.col("_k") * F.col(y)) / n
    varies = (n >= least) & (F.max("_a") > F.min("_a")) & (F.max("_b") > F.min("_b"))
    return ranked.groupBy(*by).agg(n.alias("n"), F.when(varies, F.try_divide(about("_a", "_b"), F.sqrt(about("_a", "_a") * about("_b", "_b")))).alias("rho"))


def auc(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """(by, n, positives, auc, brier, accuracy, balanced_accuracy, majority_rate) of a score for a 0/1 label.

    auc by average ranks. It and the balanced accuracy, the mean of both classes' shares called right at 0.5,
    are null for one class."""
    rows = df.filter(finite(score) & F.col(label).isNotNull()).select(*by, F.col(label).alias("_y"), F.col(score).cast("double").alias("_score"))
    y, right = F.col("_y"), ((F.col("_score") >= 0.5).cast("int") == F.col("_y")).cast("double")
    pos, neg = F.sum(y), F.sum(1 - y)
    area = F.try_divide(F.sum(F.when(y == 1, F.col("_r"))) - pos * (pos + 1) / 2, pos * neg)
    both = (F.avg(F.when(y == 1, right)) + F.avg(F.when(y == 0, right))) / 2
    return average_ranks(rows, by, {"_r": "_score"}).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), pos.alias("positives"), area.alias("auc"), F.avg(F.pow(F.col("_score") - y, 2)).alias("brier"), F.avg(right).alias("accuracy"),
        both.alias("balanced_accuracy"), F.greatest(F.avg(y.cast("double")), 1 - F.avg(y.cast("double"))).alias("majority_rate"),
    )
