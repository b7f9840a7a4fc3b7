"""What a user's models and panels must offer, and scoring of a panel that resumes where it stopped."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.operators.storage import stored
from driftlens.sources.files import cache_key


class VariantRegressor(Protocol):
    """A model of one assay's substitution codes."""

    name: str

    def fit(self, codes: Iterable[str], target: np.ndarray) -> VariantRegressor: ...

    def predict(self, codes: Iterable[str]) -> np.ndarray: ...


class ModelAdapter(Protocol):
    """A scorer of one target's variants; it is sent to the tasks, so it must be picklable."""

    model_id: str
    model_version: str

    def score_target(self, target: dict, variants: pd.DataFrame) -> pd.DataFrame:
        """Rows (variant_id, score) for the target's variants; an exception fails this target alone."""
        ...


class PanelAdapter(Protocol):
    """A source of targets and their variants."""

    def targets(self) -> DataFrame:
        """(target_id, sequence, sequence_sha256)."""
        ...

    def variants(self) -> DataFrame:
        """(panel_id, target_id, variant_id)."""
        ...


def model_digest(adapter: ModelAdapter) -> str:
    text = json.dumps({"model_id": adapter.model_id, "model_version": adapter.model_version}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def score_panel(adapter: ModelAdapter, targets: DataFrame, variants: DataFrame, protocol: str, store: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, audit) of all targets' variants; only targets without stored scores are scored.

    store: a folder all machines share. Scores stand there under a key of the model, the sequence and the variants,
    so that a changed model, sequence or variant is scored anew. A target is scored by one task; one that fails, or
    scores a variant twice, is listed and stored nowhere, so that the next run tries it again.
    predictions: (panel_id, target_id, variant_id, score, protocol_id, model_id, model_version, status ok or missing) of targets
    that did not fail. audit: (model_id, target_id, sequence_sha256, cache_key, cache_hit, variants, coverage, status, error).
    Raises if there are targets and all fail."""
    spark = targets.sparkSession
    sequences = targets.select("target_id", "sequence", "sequence_sha256")
    own = variants.groupBy("target_id").agg(F.collect_set("variant_id").alias("_v"), F.count(F.lit(1)).alias("variants"))
    keys = sequences.join(own, "target_id", "left").select("target_id", "sequence", "sequence_sha256", F.coalesce("variants", F.lit(0)).alias("variants"), cache_key(F.lit(model_digest(adapter)), F.col("sequence_sha256"), F.coalesce("_v", F.array().cast("array<string>"))).alias("cache_key"))
    keys = stored(keys)
    schema = "cache_key string, variant_id string, score double"
    try:
        before = spark.read.schema(schema).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        before = spark.createDataFrame([], schema)
    hits = stored(before.select("cache_key").distinct().join(keys.select("cache_key"), "cache_key", "left_semi"))
    work = keys.join(hits, "cache_key", "left_anti").join(variants.select("target_id", "variant_id"), "target_id")

    def score(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        target = {c: first[c] for c in ("target_id", "sequence", "sequence_sha256")}
        try:
            made = adapter.score_target(target, rows[["variant_id"]].reset_index(drop=True))[["variant_id", "score"]]
            if made["variant_id"].duplicated().any():
                raise ValueError("a variant is scored twice")
            made = made[made["variant_id"].isin(rows["variant_id"])].assign(error=None)
            made["score"] = pd.to_numeric(made["score"], errors="coerce")
            if made.empty:  # no score at all is a result too: it is kept, so that it is not tried again
                made = pd.DataFrame({"variant_id": [None], "score": [None], "error": [None]})
        except Exception as e:  # noqa: BLE001 - one target's failure is its own
            made = pd.DataFrame({"variant_id": [None], "score": [None], "error": [f"{type(e).__name__}: {e}"]})
        return made.assign(cache_key=first["cache_key"])[["cache_key", "variant_id", "score", "error"]]

    fresh = stored(work.groupBy("target_id").applyInPandas(score, schema + ", error string"))
    fresh.filter("error IS NULL").select("cache_key", "variant_id", "score").write.mode("append").parquet(store)
    failed = fresh.filter("error IS NOT NULL").select("cache_key", "error")
    status = keys.join(hits.withColumn("cache_hit", F.lit(True)), "cache_key", "left").join(failed, "cache_key", "left").withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))
    status = stored(status)
    total, lost = status.agg(F.count(F.lit(1)), F.count("error")).first()
    if total and lost == total:
        raise RuntimeError(f"{adapter.model_id} failed on every target; first failure: {status.agg(F.min('error')).first()[0]}")
    scores = spark.read.schema(schema).parquet(store).filter("variant_id IS NOT NULL").dropDuplicates(["cache_key", "variant_id"])
    aligned = variants.join(status.filter("error IS NULL").select("target_id", "cache_key"), "target_id").join(scores, ["cache_key", "variant_id"], "left")
    whole = F.col("score").isNotNull() & ~F.isnan("score")
    aligned = stored(aligned.select("panel_id", "target_id", "variant_id", F.when(whole, F.col("score")).alias("score"), F.lit(protocol).alias("protocol_id"), F.lit(adapter.model_id).alias("model_id"), F.lit(adapter.model_version).alias("model_version"), F.when(whole, "ok").otherwise("missing").alias("status")))
    covered = aligned.groupBy("target_id").agg(F.avg((F.col("status") == "ok").cast("double")).alias("coverage"))
    audit = status.join(covered, "target_id", "left").select(F.lit(adapter.model_id).alias("model_id"), "target_id", "sequence_sha256", "cache_key", "cache_hit", "variants", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), F.coalesce("error", F.lit("")).alias("error"))
    return aligned, audit
