"""From raw documents to a tokenised training mix, a stage at a time.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of docs. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import line_dedup, mixing, ngram_join, toxicity
from driftlens.llm.common import cut, table
from driftlens.llm.queries import bpe_digests, tokenizer_path

#: Share of a source's documents above which a line is boilerplate, and documents that must hold it. At sf0.1
#: (20 sources of 500) the planted line has shares of 0.086 to 0.132, every other line 0.048 at most; at sf0.01
#: (sources of 50) other lines stand in up to 5 documents by chance.
LINE_SHARE, LINE_HOLDERS = 0.065, 6


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels not held out, does not reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.classify(docs, labels).filter("predicted = 0").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too large a share of their source's documents has."""
    out = line_dedup.drop_site_lines(docs, "source", "text", ratio=LINE_SHARE, holders=LINE_HOLDERS)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of their sources takes them."""
    return mixing.repeat(mixing.mix(docs)).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each document of the mix."""
    made = bpe_digests(docs.select("doc_id", "source", "text"), tokenizer_path())
    return made.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: The classifier cannot be written in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
