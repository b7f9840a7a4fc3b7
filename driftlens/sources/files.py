"""Readers by file kind. Each is one scan that all tasks share; what a file must hold is checked by name first."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.codes import digest
from driftlens.functions.codes import RESIDUES
from driftlens.operators.metrics import finite

#: Folders of stored out-of-fold scores, and the split each stands for.
FOLD_FOLDERS = {"fold_random_5": "random_variant", "fold_modulo_5": "modulo_position", "fold_contiguous_5": "contiguous_position"}
#: Formats by the ending of a path.
FORMATS = {".csv": "csv", ".csv.gz": "csv", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet"}


def _format(path: str) -> str:
    for ending, name in FORMATS.items():
        if path.lower().endswith(ending):
            return name
    raise ValueError(f"no table format for {path}")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by the ending of its path, with a stated schema: no second scan to guess one."""
    return spark.read.schema(schema).options(**({"header": "true"} if _format(path) == "csv" else {})).format(_format(path)).load(path)


def write_table(df: DataFrame, path: str) -> None:
    options = {"header": "true", **({"compression": "gzip"} if path.lower().endswith(".gz") else {})} if _format(path) == "csv" else {}
    df.write.options(**options).format(_format(path)).save(path)


def _holding(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _csv(spark: SparkSession, path: str, required: Iterable[str], **options: str) -> DataFrame:
    return _holding(spark.read.options(header="true", **options).csv(path), required)


def measurements(spark: SparkSession, path: str, code: str, mutations: str, counts: str, required: Iterable[str] = ()) -> DataFrame:
    """CSV with # comments: a null code is the wild type "", mutations must be whole numbers (others raise),
    counts that are no numbers are null."""
    rows = _csv(spark, path, {code, mutations, counts, *required}, comment="#")
    return rows.withColumns({code: F.coalesce(code, F.lit("")), mutations: F.col(mutations).cast("double").cast("int"), counts: F.col(counts).try_cast("double")})


def unique_index(spark: SparkSession, path: str, required: Iterable[str], unique: list[str]) -> DataFrame:
    """CSV index in which each of `unique` must not repeat."""
    rows = _csv(spark, path, {*required, *unique})
    repeated = rows.select(*(F.count_distinct(c).alias(c) for c in unique), F.count(F.lit(1)).alias("_n")).first()
    for c in unique:
        if repeated[c] != repeated["_n"]:
            raise ValueError(f"{c} repeats or is null")
    return rows


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def assays(spark: SparkSession, folder: str, index: DataFrame, filename: str, schema: str) -> DataFrame:
    """All CSV files of a folder that the index names, in one scan, with the index's columns."""
    rows = spark.read.schema(schema).option("header", "true").csv(folder)
    return rows.withColumn(filename, F.col("_metadata.file_name")).join(index, filename)


def columns(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """Some columns of wide score files; the scan reads no others."""
    return _holding(spark.read.option("header", "true").csv(path), wanted).select(*wanted)


def fold_scores(spark: SparkSession, folder: str, schema: str, item: str) -> DataFrame:
    """Out-of-fold scores below folder/<split folder>/, with `split` and `file`; other folders are left out.

    `repeats` counts how often an item stands in its file: more than once is a fault."""
    rows = spark.read.schema(schema).options(header="true", recursiveFileLookup="true").csv(folder).withColumn("_path", F.col("_metadata.file_path"))
    names = F.create_map(*(F.lit(v) for pair in FOLD_FOLDERS.items() for v in pair))
    rows = rows.withColumn("split", names[F.regexp_extract("_path", "([^/]+)/[^/]+$", 1)]).withColumn("file", _name(F.col("_path"))).filter("split IS NOT NULL").drop("_path")
    times = rows.groupBy("split", "file", item).agg(F.count(F.lit(1)).alias("repeats"))
    return rows.join(times, ["split", "file", item])


def predictor_panel(df: DataFrame, code: str, outcome: str, reserved: set[str]) -> DataFrame:
    """(code, position, outcome, model_id, predicted) of single mutations with a finite outcome: every column
    that is not reserved is a predictor; what is no number is null."""
    predictors = [c for c in df.columns if c not in reserved | {code, outcome}]
    rows = df.withColumn("position", F.regexp_extract(code, "^[A-Z](\\d+)[A-Z]$", 1).try_cast("int")).filter(F.col("position").isNotNull() & finite(outcome))
    rows = rows.select(code, "position", F.col(outcome).cast("double").alias(outcome), *(F.col(c).try_cast("double").alias(c) for c in predictors))
    return rows.unpivot([code, "position", outcome], predictors, "model_id", "predicted")


def targets(df: DataFrame, target: str, sequence: str) -> DataFrame:
    """(target_id, sequence, sequence_sha256, sequence_length): upper case, without one final stop."""
    own = F.upper(F.regexp_replace(sequence, r"\*$", ""))
    return df.select(F.col(target).alias("target_id"), own.alias("sequence")).select("target_id", "sequence", digest(F.col("sequence")).alias("sequence_sha256"), F.length("sequence").alias("sequence_length"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """Targets of FASTA files: a record from each > on; the first word of its header is the id, lines are joined.

    Files split at records, so that one file may be read by many tasks."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    lines = F.split("value", "\r?\n")
    body = F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.trim), "")
    return targets(records.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("t"), body.alias("s")), "t", "s")


def metadata_targets(df: DataFrame) -> DataFrame:
    """df(urn, targetGenes) of nested records with exactly one protein target of canonical residues, one final stop removed."""
    one = F.element_at("targetGenes", 1)
    text = F.upper(one["targetSequence"]["sequence"])
    ok = (F.size("targetGenes") == 1) & (one["targetSequence"]["sequenceType"] == "protein") & F.regexp_replace(text, r"\*$", "").rlike(f"^[{RESIDUES}]+$")
    rows = df.filter(ok).select("urn", F.coalesce(one["name"], F.col("urn")).alias("target_name"), text.endswith("*").alias("stop_removed"), text.alias("s"))
    return targets(rows, "urn", "s").withColumnRenamed("target_id", "urn").join(rows.drop("s"), "urn")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of every file in a folder. A file is read by one task, as its hash demands."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(_name(F.col("path")).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(file, status): verified, missing, size, hash or unexpected."""
    other = found.select("file", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("bytes").isNull(), "unexpected").when(F.col("bytes") != F.col("_b"), "size").when(F.col("sha256") != F.col("_s"), "hash").otherwise("verified")
    return expected.join(other, "file", "full").select("file", status.alias("status"))


def outcome_scan(df: DataFrame, expected: DataFrame, target: str, variant: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Medians of finite values a (target, variant) of the expected keys, and a status row for every expected target."""
    keys = expected.select(target, variant).distinct()
    made = df.filter(finite(value)).join(keys, [target, variant], "left_semi").groupBy(target, variant).agg(F.median(F.col(value).cast("double")).alias("effect"))
    status = keys.select(target).distinct().join(made.groupBy(target).agg(F.count(F.lit(1)).alias("variants")), target, "left")
    return made, status.select(target, F.coalesce("variants", F.lit(0)).cast("long").alias("variants"), F.when(F.col("variants").isNull(), "no_finite_outcomes").otherwise("parsed").alias("status"))


def cache_audit(expected: DataFrame, cached: DataFrame, target: str, variant: str, score: str) -> DataFrame:
    """(target, expected_rows, cached_rows, status) of every expected target: missing, valid, or invalid where
    variants repeat, differ from the expected ones, or have scores that are not finite."""
    both = expected.select(target, variant).distinct().withColumn("_e", F.lit(1)).join(cached.groupBy(target, variant).agg(F.count(F.lit(1)).alias("_c"), F.count_if(finite(score)).alias("_f")), [target, variant], "full")
    made = both.groupBy(target).agg(F.count("_e").alias("expected_rows"), F.coalesce(F.sum("_c"), F.lit(0)).alias("cached_rows"), F.count_if(F.col("_e").isNull() | F.col("_c").isNull() | (F.col("_c") > 1) | (F.col("_f") < F.col("_c"))).alias("_bad"))
    status = F.when(F.col("cached_rows") == 0, "missing").when(F.col("_bad") > 0, "invalid").otherwise("valid")
    return made.filter("expected_rows > 0").select(target, "expected_rows", "cached_rows", status.alias("status"))


def cache_key(specification: Column, sequence_sha: Column, variants: Column) -> Column:
    """Content address of a target's scores: the model's specification, the sequence, and the sorted variants."""
    return F.sha2(F.concat_ws("|", F.sha2(specification, 256), sequence_sha, F.sha2(F.array_join(F.sort_array(variants), ","), 256)), 256)
