"""Metrics of observed and predicted values per group, each from windows and one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, by: list[str]) -> Column:
    """Rank in which ties share the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def finite(column: str) -> Column:
    c = F.col(column).try_cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def regression(df: DataFrame, by: list[str], observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """n, spearman (0 for a constant side), rmse, mae, r2."""
    rows = df.filter(finite(observed) & finite(predicted)).withColumn("_o", average_rank(observed, by)).withColumn("_p", average_rank(predicted, by)).withColumn("_m", F.avg(observed).over(Window.partitionBy(*by)))
    own = Window.partitionBy(*by)
    flat = (F.max(observed).over(own) - F.min(observed).over(own) < 1e-12) | (F.max(predicted).over(own) - F.min(predicted).over(own) < 1e-12)
    # a constant side has no variance to divide by: its ranks stay out of the correlation
    rows = rows.withColumn("_f", flat).withColumns({"_o": F.when(~F.col("_f"), F.col("_o")), "_p": F.when(~F.col("_f"), F.col("_p"))})
    gap = F.col(observed) - F.col(predicted)
    total = F.sum(F.pow(F.col(observed) - F.col("_m"), 2))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(F.bool_or("_f"), 0.0).otherwise(F.corr("_o", "_p")).alias("spearman"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), F.when(total > 0, 1 - F.sum(gap * gap) / total).alias("r2"))


def top_selection(df: DataFrame, by: list[str], item: str, fraction: float = 0.1, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """k, top_recall, selected_mean, gain_sd and regret_sd of the best ceil(n * fraction); ties by item."""
    own = Window.partitionBy(*by)
    rows = df.filter(finite(observed) & finite(predicted))
    rows = rows.withColumn("_k", F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(own) * F.lit(fraction))))
    rows = rows.withColumn("_s", F.row_number().over(own.orderBy(F.desc(predicted), item)) <= F.col("_k")).withColumn("_t", F.row_number().over(own.orderBy(F.desc(observed), item)) <= F.col("_k"))
    sd = F.stddev_pop(observed)
    chosen = F.when(F.col("_s"), F.col(observed))
    return rows.groupBy(*by).agg(F.max("_k").cast("long").alias("k"), (F.count_if(F.col("_s") & F.col("_t")) / F.max("_k")).alias("top_recall"), F.avg(chosen).alias("selected_mean"), F.when(sd > 1e-12, (F.avg(chosen) - F.avg(observed)) / sd).otherwise(0.0).alias("gain_sd"), F.when(sd > 1e-12, (F.max(observed) - F.max(chosen)) / sd).otherwise(0.0).alias("regret_sd"))


def ndcg(df: DataFrame, by: list[str], item: str, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """Discounted gain with relevance rank / n, over its best value."""
    own = Window.partitionBy(*by)
    rows = df.filter(finite(observed) & finite(predicted)).withColumn("_rel", F.row_number().over(own.orderBy(observed, item)) / F.count(F.lit(1)).over(own)).withColumn("_p", F.row_number().over(own.orderBy(F.desc(predicted), item))).withColumn("_b", F.row_number().over(own.orderBy(F.desc(observed), F.desc(item))))
    gain = F.pow(F.lit(2.0), F.col("_rel")) - 1
    return rows.groupBy(*by).agg((F.sum(gain / F.log2(F.col("_p") + 1)) / F.sum(gain / F.log2(F.col("_b") + 1))).alias("ndcg"))


def conformal_radius(df: DataFrame, by: list[str], item: str, coverage: float = 0.8, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """The min(n, ceil((n + 1) * coverage))-th smallest absolute residual; rows that are not finite are left out."""
    own = Window.partitionBy(*by)
    rows = df.filter(finite(observed) & finite(predicted)).withColumn("_r", F.abs(F.col(observed) - F.col(predicted))).withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_i", F.row_number().over(own.orderBy("_r", item)))
    return rows.filter(F.col("_i") == F.least(F.col("_n"), F.ceil((F.col("_n") + 1) * F.lit(coverage)))).select(*by, F.col("_r").alias("radius"))


def risk_coverage(df: DataFrame, by: list[str], item: str, uncertainty: str, fractions: list[float], observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """Mean absolute error and threshold among the ceil(n * fraction) least uncertain rows."""
    own = Window.partitionBy(*by)
    rows = df.filter(finite(observed) & finite(predicted) & finite(uncertainty)).withColumn("_i", F.row_number().over(own.orderBy(uncertainty, item))).withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("coverage", F.explode(F.array(*map(F.lit, fractions))))
    return rows.filter(F.col("_i") <= F.ceil(F.col("_n") * F.col("coverage"))).groupBy(*by, "coverage").agg(F.count(F.lit(1)).alias("retained"), F.avg(F.abs(F.col(observed) - F.col(predicted))).alias("mae"), F.max(uncertainty).alias("threshold"))


def empirical_percentile(reference: DataFrame, values: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """(by, item, percentile): the share of the reference that is at most each value, both rounded to 12 digits."""
    both = reference.select(*by, F.lit(None).cast(values.schema[item].dataType).alias(item), F.round(value, 12).alias("_v"), F.lit(1).alias("_ref")).unionByName(values.select(*by, item, F.round(value, 12).alias("_v"), F.lit(0).alias("_ref")))
    upto = F.sum("_ref").over(Window.partitionBy(*by).orderBy("_v").rangeBetween(Window.unboundedPreceding, 0))
    share = F.try_divide(upto, F.sum("_ref").over(Window.partitionBy(*by)))
    return both.withColumn("percentile", share).filter("_ref = 0").select(*by, item, "percentile")


def auc(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """(by, n, positives, auc, brier, accuracy) of a score for a 0/1 label; auc by average ranks, null for one class."""
    rows = df.filter(finite(score) & F.col(label).isNotNull()).withColumn("_r", average_rank(score, by))
    pos, neg = F.sum(label), F.sum(1 - F.col(label))
    area = (F.sum(F.when(F.col(label) == 1, F.col("_r"))) - pos * (pos + 1) / 2) / (pos * neg)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pos.alias("positives"), F.when((pos > 0) & (neg > 0), area).alias("auc"), F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"), F.avg(((F.col(score) >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"))


def training_properties(df: DataFrame, by: list[str], position: str = "position", observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """What a group's training rows look like: sizes, spread over positions, and the score's rank correlation.

    Ratios to the target's sd are null where it does not vary. The skew is corrected for the number of rows."""
    rows = df.filter(finite(observed))
    n, sd = F.count(F.lit(1)), F.stddev_pop(observed)
    skew = F.when(n > 2, F.coalesce(F.skewness(observed) * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0))).otherwise(0.0)
    whole = rows.groupBy(*by).agg(n.alias("train_rows"), sd.alias("target_sd"), (F.percentile(observed, F.lit(0.75)) - F.percentile(observed, F.lit(0.25))).alias("target_iqr"), skew.alias("target_skew"))
    sites = rows.groupBy(*by, position).agg(n.alias("_c"), F.avg(observed).alias("_mu"), sd.alias("_sd")).join(whole.select(*by, F.when(F.col("target_sd") > 1e-12, F.col("target_sd")).alias("_all")), by)
    places = sites.groupBy(*by).agg(
        F.count(F.lit(1)).alias("train_positions"), F.avg("_c").alias("per_position"), (F.stddev_pop("_c") / F.avg("_c")).alias("per_position_cv"), (F.stddev_pop("_mu") / F.max("_all")).alias("site_mean_spread"),
        F.avg((F.col("_sd") / F.col("_all") > 0.7).cast("double")).alias("variable_sites"), (F.avg("_sd") / F.max("_all")).alias("site_sd_ratio"),
    )
    made = whole.join(places, by).join(regression(rows, by, observed, predicted).select(*by, F.col("spearman").alias("score_spearman")), by, "left")
    made = made.withColumn("density", F.col("train_rows") / (F.col("train_positions") * 19))
    return made.select(*by, "train_rows", "train_positions", "density", "per_position", "per_position_cv", "target_sd", "target_iqr", "target_skew", "site_mean_spread", "variable_sites", "site_sd_ratio", "score_spearman")
