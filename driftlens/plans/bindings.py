"""The driver's tables as items with observed values and predictor scores; one text for both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.codes import RESIDUES

ITEMS = f"""SELECT assay_id, protein_id, family_id, position, ref, alt, concat(ref, CAST(position AS VARCHAR(9)), alt) AS code,
  median(l_extendedprice) AS observed, median(l_quantity) AS qty, median(l_discount) AS disc, median(l_tax) AS tax
FROM (SELECT *, substr('{RESIDUES}', CAST((position - 1) % 20 + 1 AS INT), 1) AS ref, substr('{RESIDUES}', CAST((position + l_linenumber) % 20 + 1 AS INT), 1) AS alt
  FROM (SELECT *, concat('A', CAST(l_suppkey AS VARCHAR(9))) AS assay_id, concat('P', CAST(l_suppkey % 40 AS VARCHAR(9))) AS protein_id,
    concat('F', CAST(l_suppkey % 40 % 15 AS VARCHAR(9))) AS family_id, l_partkey % 60 + 1 AS position FROM {{lineitem}}) x) y
WHERE alt <> ref GROUP BY assay_id, protein_id, family_id, position, ref, alt"""


_VALUES = {"observed": "l_extendedprice", "qty": "l_quantity", "disc": "l_discount", "tax": "l_tax"}


def _letter(place: Column) -> Column:
    return F.substr(F.lit(RESIDUES), place.cast("int"), F.lit(1))


def _middle(values: str) -> Column:
    """The median of a sorted array without nulls; null for an empty one."""
    n = F.size(values)
    at = lambda i: F.get(values, F.floor(i).cast("int"))
    return F.when(n % 2 == 1, at(n / 2)).when(n > 0, at(n / 2 - 1) * 0.5 + at(n / 2) * 0.5)


#: Lines of one task, about: what a task sorts and holds stays as it is when the table grows.
LINES = 100_000


def dealt_over(lines: DataFrame) -> int:
    return max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // LINES))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ITEMS says. Lines are dealt by assay once, by few and short keys, so that windows over assays need no
    further shuffle; the cells of an assay hold a few lines, whose sorted values give the medians.

    A stated number of tasks is not lowered for the small size of lines that scores, splits and ranks multiply."""
    p, n = F.col("position"), F.col("n")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tasks = dealt_over(lines)
    rows = lines.withColumns({"n": F.col("l_suppkey"), "position": F.col("l_partkey") % 60 + 1})
    rows = rows.select(F.concat(F.lit("A"), n.cast("string")).alias("assay_id"), "n", p, _letter((p + F.col("l_linenumber")) % 20 + 1).alias("alt"), *(F.col(c).cast("double").alias(k) for k, c in _VALUES.items()))
    ref = _letter((p - 1) % 20 + 1)
    cells = rows.filter(F.col("alt") != ref).repartition(tasks, "assay_id").groupBy("assay_id", "n", "position", "alt").agg(*(F.sort_array(F.collect_list(c)).alias(c) for c in _VALUES))
    protein, family = (F.concat(F.lit(k), v.cast("string")).alias(c) for k, v, c in (("P", n % 40, "protein_id"), ("F", n % 40 % 15, "family_id")))
    return cells.select("assay_id", protein, family, "position", ref.alias("ref"), "alt", F.concat(ref, p.cast("string"), "alt").alias("code"), *(_middle(c).alias(c) for c in _VALUES))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, a row for each of three predictors (model_id, predicted); they stay where their assay is."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("model_id"), (F.col(c) * 1000.0).alias("predicted")) for c in ("qty", "disc", "tax")))).alias("_s")
    return items(spark, sf_dir).select("assay_id", "protein_id", "family_id", "position", "code", "observed", each).select("*", "_s.*").drop("_s")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, code): the substitutions of each order's lines, one a position, joined by / in order of positions."""
    letter = lambda i: F.substr(F.lit(RESIDUES), (i % 20 + 1).cast("int"), F.lit(1))
    place = F.col("l_partkey") % 60 + 1
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", place.alias("position"), letter(place - 1).alias("ref"), letter(place + F.col("l_linenumber")).alias("alt")).filter("ref <> alt")
    one = rows.groupBy("l_orderkey", "position").agg(F.min(F.concat("ref", F.col("position").cast("string"), "alt")).alias("code"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", "code"))), lambda x: x["code"])
    return one.groupBy("l_orderkey").agg(F.array_join(ordered, "/").alias("code"))
