"""Choosing a predictor for each task, and what is gained when only the surest choices are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.codes import draw


def choose(df: DataFrame, task: list[str], model: str, decision: str, gain: str) -> DataFrame:
    """Of each task the model of the highest decision value (ties: least name), its gain, and its regret
    against the best gain of the task."""
    own = Window.partitionBy(*task)
    ranked = df.withColumn("_i", F.row_number().over(own.orderBy(F.desc(decision), model))).withColumn("regret", F.max(gain).over(own) - F.col(gain))
    return ranked.filter("_i = 1").drop("_i")


def curve(chosen: DataFrame, by: list[str], item: list[str], confidence: str, gain: str = "gain", regret: str = "regret", steps: int = 10) -> DataFrame:
    """At each coverage 1 / steps, 2 / steps, ... 1: the ceil(n * coverage) surest tasks, how many of them
    gain nothing, their means and medians, the mean of their lowest fifth of gains, and the least confidence."""
    own = Window.partitionBy(*by)
    rows = chosen.withColumn("_i", F.row_number().over(own.orderBy(F.desc(confidence), *item))).withColumn("_n", F.count(F.lit(1)).over(own))
    rows = rows.withColumn("coverage", F.explode(F.array(*(F.lit(i / steps) for i in range(1, steps + 1))))).withColumn("_k", F.ceil(F.col("_n") * F.col("coverage")))
    at = Window.partitionBy(*by, "coverage").orderBy(gain, *item)
    kept = rows.filter("_i <= _k").withColumn("_low", F.row_number().over(at))
    tail = F.when(F.col("_low") <= F.ceil(F.col("_k") * F.lit(0.2)), F.col(gain))
    return kept.groupBy(*by, "coverage").agg(F.count(F.lit(1)).alias("retained"), F.avg((F.col(gain) <= 0).cast("double")).alias("failure"), F.avg(gain).alias("mean_gain"), F.avg(regret).alias("mean_regret"), F.avg(tail).alias("tail_gain"), F.median(gain).alias("median_gain"), F.median(regret).alias("median_regret"), F.min(confidence).alias("threshold"))


def area(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Area under y over x by trapezoids."""
    order = Window.partitionBy(*by).orderBy(x)
    strip = (F.col(x) - F.lag(x).over(order)) * (F.col(y) + F.lag(y).over(order)) / 2
    return points.withColumn("_strip", strip).groupBy(*by).agg(F.sum("_strip").alias("area"))


def summary(points: DataFrame, by: list[str], values: tuple[str, ...] = ("mean_regret", "failure", "mean_gain")) -> DataFrame:
    """(by, <value>_area, <value>_half): the area of each of the curve's values over coverage, and the value at the
    coverage nearest a half (the smaller one on ties)."""
    order = Window.partitionBy(*by).orderBy("coverage")
    strip = lambda v: (F.col("coverage") - F.lag("coverage").over(order)) * (F.col(v) + F.lag(v).over(order)) / 2
    rows = points.withColumns({f"_{v}": strip(v) for v in values})
    near = F.struct(F.round(F.abs(F.col("coverage") - 0.5), 9), "coverage")
    return rows.groupBy(*by).agg(*(x for v in values for x in (F.sum(f"_{v}").alias(f"{v}_area"), F.min_by(v, near).alias(f"{v}_half"))))


def policy_rows(df: DataFrame, task: list[str], model: str, target: str, highest: dict[str, tuple[str, str]], flagged: dict[str, tuple[str, str]], fixed: dict[str, str | None], best_model: str | Column, seed: int = 1) -> DataFrame:
    """(df, policy, confidence, regret): the row that each policy takes of each task, all policies in one pass.

    highest: policy -> (column of which the largest value is taken, confidence); ties by model. flagged: policy -> (flag, confidence);
    a task with another number of flagged rows than one raises. fixed: policy -> confidence (null: 0) of the rows of the
    best model; a task without it has no row. Two more are always there: `oracle` takes the best target, `random` draws the row and its confidence."""
    own = Window.partitionBy(*task)
    random = draw("row", seed, *map(F.col, [*task, model])).cast("double")
    ways = {name: (F.col(c), F.col(sure)) for name, (c, sure) in highest.items()} | {"oracle": (F.col(target), F.col(target)), "random": (random, draw("confidence", seed, *map(F.col, task)) / F.lit(2.0**32))}
    parts = [(name, F.row_number().over(own.orderBy(F.desc_nulls_last(c), model)) == 1, sure) for name, (c, sure) in ways.items()]
    for name, (flag, sure) in flagged.items():
        once = F.sum(F.col(flag).cast("int")).over(own) == 1
        parts.append((name, F.when(once, F.col(flag)).otherwise(F.raise_error(F.lit(f"{name} must take one row a task")).cast("boolean")), F.col(sure)))
    parts += [(name, F.col(model) == best_model, F.lit(0.0) if sure is None else F.col(sure)) for name, sure in fixed.items()]
    rows = df.withColumn("regret", F.max(target).over(own) - F.col(target))
    held = rows.withColumns({f"_t{i}": t for i, (_, t, _) in enumerate(parts)})
    taken = F.array(*(F.struct(F.lit(n).alias("policy"), F.col(f"_t{i}").alias("taken"), c.cast("double").alias("confidence")) for i, (n, _, c) in enumerate(parts)))
    return held.withColumn("_p", F.explode(F.filter(taken, lambda x: x["taken"]))).select(*rows.columns, "_p.policy", "_p.confidence")
