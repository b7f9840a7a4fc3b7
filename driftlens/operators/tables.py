"""Contracts, audits and shapes of tables: universes, digests, alignments, folds, weights, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.codes import RESIDUES, draw


def substitutions(df: DataFrame, sequence: str) -> DataFrame:
    """Every single substitution of each row's sequence: 19 codes a position."""
    letters = F.array(*map(F.lit, RESIDUES))
    places = df.withColumn("position", F.explode(F.sequence(F.lit(1), F.length(sequence)))).withColumn("ref", F.substr(F.col(sequence), F.col("position"), F.lit(1)))
    named = places.withColumn("alt", F.explode(letters)).filter("alt <> ref")
    return named.withColumn("code", F.concat("ref", F.col("position").cast("string"), "alt")).drop(sequence)


def table_digest(df: DataFrame) -> DataFrame:
    """rows and a digest of names, types and values that no order of rows or columns changes.

    A value is written with its length before it, a null as a mark of its own, so that no two rows and no
    two headers read alike."""
    names = sorted(df.columns)
    head = "".join(f"{len(c)}:{c}={t};" for c, t in sorted(df.dtypes))
    value = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    part = F.conv(F.substr(F.sha2(F.concat(F.lit(head), *map(value, names)), 256), F.lit(1), F.lit(15)), 16, 10).cast("decimal(20,0)")
    return df.select(part.alias("_part")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_part"), F.lit(0)).cast("string").alias("digest")).withColumn("head", F.sha2(F.lit(head), 256))


def align(source: DataFrame, scores: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """How well scores cover the source's items: rows of each side, repeated keys, matches and their share."""
    key = [*by, item]
    left = source.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    right = scores.groupBy(*key).agg(F.count(F.lit(1)).alias("_scores"), F.count(value).alias("_values"))
    both = left.join(right, key, "left")
    return both.groupBy(*by).agg(
        F.sum("_rows").alias("source_rows"), F.count("_scores").alias("matched"), F.count_if(F.col("_rows") > 1).alias("source_repeats"),
        F.count_if(F.col("_scores") > 1).alias("score_repeats"), (F.count_if(F.col("_values") > 0) / F.count(F.lit(1))).alias("share"),
    )


def depth_role(code: Column, train: int = 1, test: int = 5) -> Column:
    """train for up to `train` substitutions, test for up to `test`, null beyond and for the wild type."""
    depth = F.when(code == "", 0).otherwise(F.size(F.split(code, "/")))
    return F.when((depth >= 1) & (depth <= train), "train").when((depth > train) & (depth <= test), "test")


def group_folds(df: DataFrame, by: list[str], group: str, folds: int = 5, seed: int = 1) -> DataFrame:
    """A fold for each whole group: by falling size, dealt back and forth over the folds."""
    sizes = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"))
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), draw(seed, F.col(group)), group)) - 1
    placed = sizes.withColumn("_turn", turn)
    step = F.col("_turn") % folds
    back = F.floor(F.col("_turn") / folds) % 2 == 1
    return placed.withColumn("fold", F.when(back, folds - 1 - step).otherwise(step).cast("int")).drop("_turn")


def group_weights(df: DataFrame, by: list[str], group: str) -> DataFrame:
    """The weight of a row of each group, so that groups weigh the same and weights have mean 1."""
    sizes = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*by)
    return sizes.withColumn("weight", F.sum("n").over(own) / (F.count(F.lit(1)).over(own) * F.col("n")))


def covered_share(df: DataFrame, by: list[str], start: str, stop: str, length: int) -> DataFrame:
    """Intervals [start, stop] joined where they overlap or touch: their number, and the share of [1, length]."""
    clamped = df.select(*by, F.greatest(F.lit(1), start).alias("_a"), F.least(F.lit(length), stop).alias("_b")).filter("_a <= _b")
    order = Window.partitionBy(*by).orderBy("_a", "_b")
    reach = F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = clamped.withColumn("_new", F.when(F.col("_a") <= reach + 1, 0).otherwise(1))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_island").agg((F.max("_b") - F.min("_a") + 1).alias("_len"))
    return islands.groupBy(*by).agg(F.count(F.lit(1)).alias("islands"), (F.sum("_len") / length).alias("share"))
