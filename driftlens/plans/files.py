"""Queries that write files from the given tables below the shared folder, read them back, and audit them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.codes import RESIDUES
from driftlens.operators.storage import shared_folder
from driftlens.plans.bindings import items
from driftlens.plans.studies import _ITEMS
from driftlens.sources import files


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _text(name: str):
    return F.col(name).cast("string")


def io_write_table(spark, d):
    path = f"{_folder(spark)}.csv.gz"
    files.write_table(_t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return files.read_table(spark, path, "s_suppkey bigint, s_name string, s_nationkey int")


def io_read_table(spark, d):
    path = f"{_folder(spark)}.jsonl"
    files.write_table(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), path)
    return files.read_table(spark, path, "c_custkey bigint, c_mktsegment string")


def io_read_measurements(spark, d):
    path, k = _folder(spark), F.col("o_orderkey")
    rows = _t(spark, d, "orders").select(F.when(k % 11 == 0, F.concat(F.lit("#"), _text("o_orderkey"))).otherwise(_text("o_orderkey")).alias("variant"), F.when(k % 5 != 0, F.concat(F.lit("A"), _text("o_orderkey"), F.lit("C"))).alias("code"), (k % 3).alias("mutations"), F.when(k % 7 == 0, "many").otherwise(_text("o_custkey")).alias("counts"))
    # the writer quotes what looks like its comment mark
    rows.write.options(header="true", comment="~").csv(path)
    return files.measurements(spark, path, "code", "mutations", "counts", {"variant"})


def _index(spark, d):
    path = _folder(spark)
    _t(spark, d, "supplier").select(F.concat(F.lit("A"), _text("s_suppkey")).alias("assay_id"), F.concat(F.lit("A"), _text("s_suppkey"), F.lit(".csv")).alias("file"), "s_nationkey").write.option("header", "true").csv(path)
    return files.unique_index(spark, path, {"s_nationkey"}, ["assay_id", "file"])


def io_read_reference(spark, d):
    return _index(spark, d).select("assay_id", "file", F.col("s_nationkey").cast("int").alias("s_nationkey"))


def io_read_assays(spark, d):
    """Files as written by tasks; the index is made from the files' own names, two thirds of them."""
    path = _folder(spark)
    items(spark, d).select("assay_id", "code", F.round("observed", 4).alias("observed")).repartition(8, "assay_id").write.option("header", "true").csv(path)
    named = spark.read.schema("assay_id string, code string, observed double").option("header", "true").csv(path).select(F.col("_metadata.file_name").alias("file")).distinct()
    return files.assays(spark, path, named.withColumn("panel", F.lit("p")), "file", "assay_id string, code string, observed double").select("assay_id", "code", "observed", "panel")


def io_read_scores(spark, d):
    path = _folder(spark)
    items(spark, d).write.option("header", "true").csv(path)
    return files.columns(spark, path, ["assay_id", "code", "tax"]).withColumn("tax", F.round(F.col("tax").cast("double"), 6))


def io_read_fold_scores(spark, d):
    path = _folder(spark)
    for i, folder in enumerate([*files.FOLD_FOLDERS, "other"]):
        items(spark, d).filter(F.col("position") % 4 == i).select("assay_id", "code", F.concat_ws("|", "assay_id", "code").alias("item")).write.option("header", "true").csv(f"{path}/{folder}")
    return files.fold_scores(spark, path, "assay_id string, code string, item string", "item").select("assay_id", "code", "split", "repeats")


def io_read_predictor_panel(spark, d):
    rows = items(spark, d).select("assay_id", F.when(F.col("position") % 6 == 0, F.concat("code", F.lit(":"), "code")).otherwise(F.col("code")).alias("mutant"), F.when(F.col("position") % 7 == 0, "NaN").otherwise(F.round("observed", 4).cast("string")).alias("score"), _text("qty").alias("qty"), F.when(F.col("position") % 5 == 0, "none").otherwise(_text("tax")).alias("tax"))
    made = files.predictor_panel(rows.withColumn("mutant", F.col("mutant")), "mutant", "score", {"assay_id"})
    return made.groupBy("mutant", "position", "model_id").agg(F.count("predicted").alias("finite"), F.round(F.sum("score"), 3).alias("total"))


def io_fasta(spark, d):
    path = _folder(spark)
    rows = _t(spark, d, "supplier").select(F.concat(F.lit(">"), "s_suppkey", F.lit(" supplier\n"), F.lit(RESIDUES.lower()), F.lit("\n"), F.substr(F.lit(RESIDUES), F.lit(1), (F.col("s_suppkey") % 20).cast("int")), F.when(F.col("s_suppkey") % 3 == 0, "*").otherwise("")))
    rows.write.text(path)
    return files.fasta(spark, path)


def io_target_table(spark, d):
    rows = _t(spark, d, "part").select(_text("p_partkey").alias("t"), F.concat(F.substr(F.lit(RESIDUES.lower()), F.lit(1), (F.col("p_partkey") % 20 + 1).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "*").otherwise("")).alias("s"))
    return files.targets(rows, "t", "s")


def io_metadata_json(spark, d):
    path, k = _folder(spark), F.col("s_suppkey")
    one = F.struct(F.when(k % 4 != 0, F.col("s_name")).alias("name"), F.struct(F.when(k % 5 == 0, "dna").otherwise("protein").alias("sequenceType"), F.concat(F.lit(RESIDUES.lower()), F.when(k % 7 == 0, "x").when(k % 3 == 0, "*").otherwise("")).alias("sequence")).alias("targetSequence"))
    genes = F.when(k % 11 == 0, F.array(one, one)).otherwise(F.array(one))
    _t(spark, d, "supplier").select(_text("s_suppkey").alias("urn"), genes.alias("targetGenes")).write.json(path)
    schema = "urn string, targetGenes array<struct<name: string, targetSequence: struct<sequenceType: string, sequence: string>>>"
    return files.metadata_targets(spark.read.schema(schema).json(path))


def io_manifest(spark, d):
    """Files of the customers against their own manifest, one size in it altered."""
    path = _folder(spark)
    _t(spark, d, "customer").select("c_custkey").repartition(4, "c_custkey").write.csv(path)
    found = files.manifest(spark, path)
    first = found.agg(F.min("file")).first()[0]
    expected = found.withColumn("bytes", F.when(F.col("file") == first, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return files.verify(expected, found).groupBy("status").agg((F.count(F.lit(1)) > 0).alias("found"))


def _outcomes(spark, d):
    k = F.col("l_orderkey")
    rows = _t(spark, d, "lineitem").select(_text("l_suppkey").alias("target"), (F.col("l_partkey") % 50).alias("variant"), F.when((k % 9 == 0) | (F.col("l_suppkey") % 10 == 0), "n/a").otherwise(_text("l_quantity")).alias("value"))
    expected = _t(spark, d, "lineitem").select(_text("l_suppkey").alias("target"), (F.col("l_partkey") % 50).alias("variant")).filter("variant < 30").distinct()
    return files.outcome_scan(rows, expected, "target", "variant", "value")


def io_outcome_scan(spark, d):
    return _outcomes(spark, d)[0]


def io_allowlist_scan(spark, d):
    return _outcomes(spark, d)[1]


def _cache(spark, d):
    n = F.substr(F.col("assay_id"), F.lit(2)).cast("int")
    expected = items(spark, d).select("assay_id", "code", "position", "tax")
    cached = expected.filter((n % 5 != 0) & ((n % 7 != 0) | (F.col("position") != 7))).withColumn("tax", F.when((n % 11 != 0) | (F.col("position") != 8), F.col("tax")))
    return expected, cached


def io_cache_audit(spark, d):
    return files.cache_audit(*_cache(spark, d), "assay_id", "code", "tax")


def io_resumable_scores(spark, d):
    """Targets whose stored scores can be reused, and the key they are stored under."""
    expected, cached = _cache(spark, d)
    keys = expected.groupBy("assay_id").agg(files.cache_key(F.lit("model"), F.sha2(F.lit(RESIDUES * 3), 256), F.collect_set("code")).alias("cache_key"))
    audit = files.cache_audit(expected, cached, "assay_id", "code", "tax")
    return audit.join(keys, "assay_id").select("assay_id", "cache_key", (F.col("status") == "valid").alias("reused"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        io_write_table, io_read_table, io_read_measurements, io_read_reference, io_read_assays, io_read_scores, io_read_fold_scores, io_read_predictor_panel, io_fasta,
        io_target_table, io_metadata_json, io_manifest, io_outcome_scan, io_allowlist_scan, io_cache_audit, io_resumable_scores,
    )
}

_TARGET = "sha256({0}) AS sequence_sha256, length({0})::INTEGER AS sequence_length"
_OUT = """WITH o AS (SELECT l_suppkey::VARCHAR AS target, l_partkey % 50 AS variant, CASE WHEN l_orderkey % 9 <> 0 AND l_suppkey % 10 <> 0 THEN l_quantity::DOUBLE END AS v FROM lineitem WHERE l_partkey % 50 < 30),
m AS (SELECT target, variant, median(v) AS effect FROM o WHERE v IS NOT NULL GROUP BY 1, 2)"""
_CACHE = f"""WITH e AS (SELECT *, substr(assay_id, 2)::INT AS n FROM ({_ITEMS})), c AS (SELECT *, n % 5 <> 0 AND (n % 7 <> 0 OR position <> 7) AS there, n % 11 <> 0 OR position <> 8 AS fine FROM e),
a AS (SELECT assay_id, count(*) AS expected_rows, count(*) FILTER (there) AS cached_rows, count(*) FILTER (NOT there OR NOT fine) AS bad, list_sort(list(DISTINCT code)) AS codes FROM c GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "io_write_table": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "io_read_table": "SELECT c_custkey, c_mktsegment FROM customer",
    "io_read_measurements": "SELECT o_orderkey::VARCHAR AS variant, CASE WHEN o_orderkey % 5 <> 0 THEN 'A' || o_orderkey || 'C' ELSE '' END AS code, (o_orderkey % 3)::INTEGER AS mutations, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey::DOUBLE END AS counts FROM orders WHERE o_orderkey % 11 <> 0",
    "io_read_reference": "SELECT 'A' || s_suppkey AS assay_id, 'A' || s_suppkey || '.csv' AS file, s_nationkey::INTEGER AS s_nationkey FROM supplier",
    "io_read_assays": f"SELECT assay_id, code, round(observed, 4) AS observed, 'p' AS panel FROM ({_ITEMS})",
    "io_read_scores": f"SELECT assay_id, code, round(tax::DOUBLE, 6) AS tax FROM ({_ITEMS})",
    "io_read_fold_scores": f"SELECT assay_id, code, CASE position % 4 WHEN 0 THEN 'random_variant' WHEN 1 THEN 'modulo_position' ELSE 'contiguous_position' END AS split, 1::BIGINT AS repeats FROM ({_ITEMS}) WHERE position % 4 < 3",
    "io_read_predictor_panel": f"""WITH i AS (SELECT * FROM ({_ITEMS}) WHERE position % 6 <> 0 AND position % 7 <> 0), x AS (SELECT code, position, 'qty' AS model_id, 1 AS ok, round(observed, 4) AS s FROM i UNION ALL SELECT code, position, 'tax', (position % 5 <> 0)::INT, round(observed, 4) FROM i)
SELECT code AS mutant, position::INTEGER AS position, model_id, count(*) FILTER (ok = 1) AS finite, round(sum(s), 3) AS total FROM x GROUP BY 1, 2, 3""",
    "io_fasta": f"WITH q AS (SELECT s_suppkey::VARCHAR AS target_id, '{RESIDUES}' || substr('{RESIDUES}', 1, (s_suppkey % 20)::INT) AS sequence FROM supplier) SELECT target_id, sequence, {_TARGET.format('sequence')} FROM q",
    "io_target_table": f"WITH q AS (SELECT p_partkey::VARCHAR AS target_id, substr('{RESIDUES}', 1, (p_partkey % 20 + 1)::INT) AS sequence FROM part) SELECT target_id, sequence, {_TARGET.format('sequence')} FROM q",
    "io_metadata_json": f"""SELECT s_suppkey::VARCHAR AS urn, '{RESIDUES}' AS sequence, sha256('{RESIDUES}') AS sequence_sha256, 20 AS sequence_length, CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE s_suppkey::VARCHAR END AS target_name, s_suppkey % 3 = 0 AS stop_removed
FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0""",
    "io_manifest": "SELECT * FROM (VALUES ('size', true), ('verified', true)) v(status, found) WHERE (SELECT count(*) FROM customer) > 0",
    "io_outcome_scan": f"{_OUT} SELECT * FROM m",
    "io_allowlist_scan": f"{_OUT}, c AS (SELECT target, count(*) AS n FROM m GROUP BY 1) SELECT target, coalesce(n, 0) AS variants, CASE WHEN n IS NULL THEN 'no_finite_outcomes' ELSE 'parsed' END AS status FROM (SELECT DISTINCT target FROM o) LEFT JOIN c USING (target)",
    "io_cache_audit": f"{_CACHE} SELECT assay_id, expected_rows, cached_rows, CASE WHEN cached_rows = 0 THEN 'missing' WHEN bad > 0 THEN 'invalid' ELSE 'valid' END AS status FROM a",
    "io_resumable_scores": f"{_CACHE} SELECT assay_id, sha256(sha256('model') || '|' || sha256('{RESIDUES * 3}') || '|' || sha256(array_to_string(codes, ','))) AS cache_key, cached_rows > 0 AND bad = 0 AS reused FROM a",
}
