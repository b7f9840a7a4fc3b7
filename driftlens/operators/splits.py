"""Leakage-safe splits: a role for each item, drawn by hash so that any cluster draws alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.codes import draw


def _chosen(units: DataFrame, by: list[str], unit: str, seed: int, number: Column) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(draw(seed, F.col(unit)), unit)
    return units.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= number).select(*by, unit)


def _placed(df: DataFrame, by: list[str], unit: str, order: list) -> DataFrame:
    """df with _i, the place of each row's unit among its group's distinct units, and _n, their number: windows
    over one partitioning, no join."""
    own = Window.partitionBy(*by)
    return df.withColumn("_i", F.dense_rank().over(own.orderBy(*order))).withColumn("_n", F.max("_i").over(own))


def random_item(df: DataFrame, by: list[str], unit: str = "code", share: float = 0.2, seed: int = 1) -> DataFrame:
    """role test for ceil(share * units) whole units of each group, train for the others."""
    rows = _placed(df, by, unit, [draw(seed, F.col(unit)), F.col(unit)])
    return rows.withColumn("role", F.when(F.col("_i") <= F.ceil(F.col("_n") * F.lit(share)), "test").otherwise("train")).drop("_i", "_n")


def position(df: DataFrame, by: list[str], unit: str = "position", share: float = 0.2, seed: int = 1) -> DataFrame:
    """Whole positions are held out: min(P - 1, max(1, round(P * share))) of each group's P."""
    number = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share), 0)))
    rows = _placed(df, by, unit, [draw(seed, F.col(unit)), F.col(unit)])
    return rows.withColumn("role", F.when(F.col("_i") <= number, "test").otherwise("train")).drop("_i", "_n")


def bridge(df: DataFrame, held: DataFrame, by: list[str], places: str = "places") -> DataFrame:
    """role of rows with an array of positions: test if all are held(by, position), train if none is.

    Rows that bridge both, and rows without positions, are excluded."""
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    met = rows.select("_row", *by, F.explode(places).alias("position")).join(held.select(*by, "position").distinct().withColumn("_held", F.lit(1)), [*by, "position"], "left")
    counts = met.groupBy("_row").agg(F.count("_held").alias("_in"), F.count(F.lit(1)).alias("_all"))
    role = F.when(F.col("_in") == F.col("_all"), "test").when(F.col("_in") == 0, "train")
    return rows.join(counts, "_row", "left").withColumn("role", F.coalesce(role, F.lit("excluded"))).drop("_row", "_in", "_all")


def held_positions(df: DataFrame, by: list[str], share: float = 0.2, seed: int = 1, unit: str = "position") -> DataFrame:
    """(by, position) of the held-out positions of each group; a group of a single position raises."""
    units = df.select(*by, unit).distinct()
    number = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share), 0)))
    several = F.when(F.col("_n") > 1, number).otherwise(F.raise_error(F.lit("a group has a single position")).cast("double"))
    return _chosen(units, by, unit, seed, several)


def group_shuffle(df: DataFrame, by: list[str], group: str, share: float = 0.25, seed: int = 1) -> DataFrame:
    """role calibration for ceil(share * groups) whole groups, fit for the others."""
    picked = _chosen(df.select(*by, group).distinct(), by, group, seed, F.ceil(F.col("_n") * F.lit(share))).withColumn("_t", F.lit(True))
    return df.join(picked, [*by, group], "left").withColumn("role", F.when(F.col("_t"), "calibration").otherwise("fit")).drop("_t")


def leave_panel(df: DataFrame, panel: str, panels: list[str]) -> DataFrame:
    """A copy of the rows for each panel left out, with the role they have in it."""
    return df.withColumn("left_out", F.explode(F.array(*map(F.lit, panels)))).withColumn("role", F.when(F.col(panel) == F.col("left_out"), "test").otherwise("train"))


def modulo(df: DataFrame, fold: int, folds: int = 5, unit: str = "position") -> DataFrame:
    return df.withColumn("role", F.when(F.col(unit) % folds == fold, "test").otherwise("train"))


def contiguous(df: DataFrame, by: list[str], fold: int, folds: int = 5, unit: str = "position") -> DataFrame:
    """A block of neighbouring observed positions is held out; the first blocks are the larger ones."""
    rows = _placed(df, by, unit, [F.col(unit)])
    small, more = F.floor(F.col("_n") / folds), F.col("_n") % folds
    in_large = F.floor((F.col("_i") - 1) / (small + 1))
    block = F.when(in_large < more, in_large).otherwise(more + F.floor(F.try_divide(F.col("_i") - 1 - more * (small + 1), small)))
    return rows.withColumn("role", F.when(block == fold, "test").otherwise("train")).drop("_i", "_n")


def leakage(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each role and the codes and positions that both roles hold."""
    def shared(unit: str) -> DataFrame:
        return df.groupBy(*by, unit).agg(F.count_distinct("role").alias("_r")).groupBy(*by).agg(F.count_if(F.col("_r") > 1).alias(f"shared_{unit}"))

    return df.groupBy(*by).agg(F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "test").alias("test_rows")).join(shared("code"), by).join(shared("position"), by)
