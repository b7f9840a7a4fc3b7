"""Prediction intervals with a stated coverage: pooled, per class, per group, and weighted by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators.metrics import conformal_radius, finite


def mondrian_radius(df: DataFrame, by: list[str], group: str, item: str, coverage: float = 0.8, least: int = 20, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """radius of each class of at least `least` rows from its own residuals; smaller classes take the pooled one."""
    sizes = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"))
    own = conformal_radius(df, [*by, group], item, coverage, observed, predicted).withColumnRenamed("radius", "_own")
    pooled = conformal_radius(df, by, item, coverage, observed, predicted).withColumnRenamed("radius", "_pooled")
    joined = sizes.join(own, [*by, group], "left").join(pooled, by)
    return joined.select(*by, group, "n", F.when(F.col("n") >= least, F.col("_own")).otherwise(F.col("_pooled")).alias("radius"))


def group_max_radius(df: DataFrame, by: list[str], group: str, coverage: float = 0.8, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """The radius from the largest absolute residual of each group instead of from single rows; rows that are not
    finite are left out, and groups without any other."""
    rows = df.filter(finite(observed) & finite(predicted))
    worst = rows.groupBy(*by, group).agg(F.max(F.abs(F.col(observed) - F.col(predicted))).alias("_worst"), F.lit(0.0).alias("_zero"))
    return conformal_radius(worst, by, group, coverage, "_worst", "_zero")


def hierarchical_radius(df: DataFrame, by: list[str], group: str, item: str, coverage: float = 0.8, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """`hierarchical_quantile` of the absolute residuals; rows that are not finite take no part."""
    rows = df.filter(finite(observed) & finite(predicted)).withColumn("_r", F.abs(F.col(observed) - F.col(predicted)))
    return hierarchical_quantile(rows, by, group, item, "_r", coverage)


def hierarchical_quantile(df: DataFrame, by: list[str], group: str, item: str, value: str, coverage: float = 0.8) -> DataFrame:
    """(by, radius): each of G groups has mass 1 / (G + 1), shared by its rows, and the rest lies at infinity; the first
    value at which the mass reaches the coverage, null if none does."""
    own = Window.partitionBy(*by)
    groups = df.select(*by, group).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_g"))
    sized = df.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*by, group)))
    rows = sized.join(groups, by) if by else sized.crossJoin(groups)
    mass = F.sum(1 / ((F.col("_g") + 1) * F.col("_size"))).over(own.orderBy(value, item).rowsBetween(Window.unboundedPreceding, 0))
    # sums of reciprocals miss the coverage by their last digits
    return rows.withColumn("_mass", mass).groupBy(*by).agg(F.min(F.when(F.col("_mass") >= coverage - 1e-9, F.col(value))).alias("radius"))


def interval_metrics(df: DataFrame, by: list[str], lower: str, upper: str, observed: str = "observed") -> DataFrame:
    """coverage, mean_width and median_width; a lower limit above the upper one raises."""
    crossed = F.raise_error(F.lit("a lower limit lies above its upper one")).cast("double")
    width = F.when(F.col(lower) > F.col(upper), crossed).otherwise(F.col(upper) - F.col(lower))
    inside = ((F.col(observed) >= F.col(lower)) & (F.col(observed) <= F.col(upper))).cast("double")
    return df.groupBy(*by).agg(F.avg(inside).alias("coverage"), F.avg(width).alias("mean_width"), F.median(width).alias("median_width"))


def position_coverage(df: DataFrame, by: list[str], radius: str, position: str = "position", observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """The covered share within each position: its mean, tenth percentile and least value over positions."""
    inside = (F.abs(F.col(observed) - F.col(predicted)) <= F.col(radius)).cast("double")
    shares = df.groupBy(*by, position).agg(F.avg(inside).alias("_share"))
    return shares.groupBy(*by).agg(F.count(F.lit(1)).alias("positions"), F.avg("_share").alias("mean"), F.percentile("_share", F.lit(0.1)).alias("p10"), F.min("_share").alias("min"))


def nearest_fitted(df: DataFrame, by: list[str], position: str = "position", role: str = "role") -> DataFrame:
    """Test rows' positions with the distance to the nearest position of a train row, before or after."""
    fitted = F.when(F.col(role) == "train", F.col(position))
    places = df.groupBy(*by, position).agg(F.max(fitted).alias("_fit"), F.bool_or(F.col(role) == "test").alias("_test"))
    order = Window.partitionBy(*by).orderBy(position)
    before = F.last("_fit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_fit", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = places.withColumn("distance", F.least(F.col(position) - before, after - F.col(position)))
    return near.filter("_test").select(*by, position, "distance")


def fitted_radius(df: DataFrame, by: list[str], item: str, coverage: float = 0.8, role: str = "role", observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """Test rows with lower and upper: predicted, less and plus the pooled radius of their group's train rows."""
    radius = conformal_radius(df.filter(F.col(role) == "train"), by, item, coverage, observed, predicted)
    rows = df.filter(F.col(role) == "test").join(radius, by)
    return rows.withColumns({"lower": F.col(predicted) - F.col("radius"), "upper": F.col(predicted) + F.col("radius")})


def position_gap(df: DataFrame, by: list[str], position: str = "position") -> DataFrame:
    """(by, gap): median gap between neighbouring distinct positions; 1 if there is one position."""
    steps = df.select(*by, position).distinct().withColumn("_gap", F.col(position) - F.lag(position).over(Window.partitionBy(*by).orderBy(position)))
    return steps.groupBy(*by).agg(F.coalesce(F.median("_gap"), F.lit(1.0)).alias("gap"))


def distance_scaled(df: DataFrame, by: list[str], item: str, coverage: float = 0.8, position: str = "position", role: str = "role", observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """Test rows with a half width that grows with the distance to the nearest fitted position.

    role: fit, calibration or test. Residuals of calibration rows are divided by sqrt(1 + distance / gap),
    gap being the median gap of fitted positions (1 at least), and the radius is multiplied by it again."""
    fitted = F.when(F.col(role) == "fit", F.col(position))
    order = Window.partitionBy(*by).orderBy(position)
    places = df.groupBy(*by, position).agg(F.max(fitted).alias("_fit"))
    before = F.last("_fit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_fit", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = places.select(*by, position, F.least(F.col(position) - before, after - F.col(position)).alias("_far"))
    gaps = position_gap(df.filter(F.col(role) == "fit"), by, position)
    rows = df.filter(F.col(role) != "fit").join(near, [*by, position]).join(gaps, by).withColumn("_scale", F.sqrt(1 + F.col("_far") / F.greatest(F.col("gap"), F.lit(1.0))))
    scaled = rows.filter(F.col(role) == "calibration").withColumns({"_o": (F.col(observed) - F.col(predicted)) / F.col("_scale"), "_p": F.lit(0.0)})
    radius = conformal_radius(scaled, by, item, coverage, "_o", "_p")
    return rows.filter(F.col(role) == "test").join(radius, by).withColumn("half_width", F.col("radius") * F.col("_scale")).drop("_far", "_scale", "gap", "radius")


def suite(df: DataFrame, by: list[str], item: str, group: str, coverage: float = 0.8, least: int = 20, position: str = "position", role: str = "role", observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """Test rows three times, method standard, classes or distance, with a half_width from calibration rows.

    role: fit, calibration or test. Classes that calibration rows lack take the pooled radius."""
    fitted, test = df.filter(F.col(role) == "calibration"), df.filter(F.col(role) == "test")
    pooled = conformal_radius(fitted, by, item, coverage, observed, predicted)
    own = mondrian_radius(fitted, by, group, item, coverage, least, observed, predicted).select(*by, group, F.col("radius").alias("_own"))
    standard = test.join(pooled, by).select(*df.columns, F.lit("standard").alias("method"), F.col("radius").alias("half_width"))
    classes = test.join(pooled, by).join(own, [*by, group], "left").select(*df.columns, F.lit("classes").alias("method"), F.coalesce("_own", "radius").alias("half_width"))
    distance = distance_scaled(df, by, item, coverage, position, role, observed, predicted).select(*df.columns, F.lit("distance").alias("method"), "half_width")
    return standard.unionByName(classes).unionByName(distance)


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, q: float) -> DataFrame:
    """(by, quantile): the least value up to which a share q of the group's weight lies. Equal values are one
    row before the window; null values and weights weigh nothing."""
    own = Window.partitionBy(*by)
    rows = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    rows = rows.withColumn("_upto", F.sum("_w").over(own.orderBy(value))).withColumn("_total", F.sum("_w").over(own))
    return rows.filter(F.col("_upto") >= F.col("_total") * F.lit(q) - 1e-9).groupBy(*by).agg(F.min(value).alias("quantile"))
