"""Fits per group from sufficient statistics: one aggregation, a small solve a group, predictions by a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators import linear
from driftlens.operators.metrics import regression


def mean(df: DataFrame, by: list[str], role: str = "role", target: str = "observed") -> DataFrame:
    """df's test rows with `predicted`, the mean target of their group's train rows (null without any)."""
    fitted = df.filter(F.col(role) == "train").groupBy(*by).agg(F.avg(target).alias("predicted"))
    return df.filter(F.col(role) == "test").join(fitted, by, "left")


def ridge(df: DataFrame, by: list[str], features: list[str], role: str = "role", target: str = "observed", alpha: float = 10.0) -> DataFrame:
    """df's test rows with `predicted` from a ridge regression on standardised features of their group's train rows.

    The train rows are read once and reduced to moments; features that do not vary count as 0. Groups without
    train rows give null."""
    fitted = linear.ridge(df.filter(F.col(role) == "train"), by, features, target, alpha)
    return linear.predict(df.filter(F.col(role) == "test"), fitted, by, features)


def best_single(df: DataFrame, by: list[str], model: str, role: str = "role", observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """df's test rows of the one model that ranks its group's train rows best (ties: least name), with train_spearman.

    Groups meet by `by` alone, so that rows dealt by it stay where they are; as a key of the join, the model would
    deal all test rows anew into the few tasks of a small shuffle."""
    ranks = regression(df.filter(F.col(role) == "train"), [*by, model], observed, predicted).select(*by, model, F.round("spearman", 9).alias("train_spearman"))
    best = ranks.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("train_spearman"), model))).filter("_i = 1").select(*by, F.array(model).alias("_best"), "train_spearman")
    rows = df.filter(F.col(role) == "test")
    both = (rows.join(best, by) if by else rows.crossJoin(best)).filter(F.array_contains("_best", F.col(model)))
    return both.select(*by, model, *(c for c in df.columns if c not in (*by, model)), "train_spearman")
