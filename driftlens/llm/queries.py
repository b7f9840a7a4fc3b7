"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.llm import ann, bpe, collocations, language_model, line_dedup, media, mixing, ngram_join, packing, repeats, resampling, toxicity, warc
from driftlens.llm.common import crc_mod, cut, table


def tokenizer_path() -> str:
    """The tokenizer file: DRIFTLENS_TOKENIZER, or the public one that is installed."""
    if own := os.environ.get("DRIFTLENS_TOKENIZER"):
        return own
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """docs, encoded and decoded, with digests in place of ids and texts."""
    made = bpe.encode_decode(docs, path)
    return made.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256), "decoded_sha256": F.sha2(F.col("decoded"), 256)}).drop("ids", "decoded")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def _damaged(record: Column, record_id: Column) -> Column:
    """A record as a second replica holds it: some with one byte changed, some cut short, so that later ones move."""
    draw = F.conv(F.substr(F.md5(F.concat(F.lit("damage|"), F.coalesce(record_id.cast("string"), F.lit("")))), F.lit(1), F.lit(8)), 16, 10).cast("long")
    part = lambda start, n: F.substr(record, start, n)  # noqa: E731
    size = F.octet_length(record)
    changed = F.concat(part(F.lit(1), size - 5), F.lit("#").cast("binary"), part(size - 3, F.lit(4)))
    return F.when(draw % 997 == 3, part(F.lit(1), size - 9)).when(draw % 101 == 7, changed).otherwise(record)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a second replica that is made from the first one's records, damaged by rule. Both are listed
    from one reading: digests and lengths are taken before records meet by file, so that no body is shuffled."""
    pages = table(spark, sf_dir, "pages")
    files = max(1, -(-pages.count() // warc.RECORDS))
    made = warc.dealt_records(pages, files).withColumn("other", _damaged(F.col("record"), F.col("record_id")))
    made = made.withColumns({"other_length": F.octet_length("other").cast("long"), "other_digest": F.sha2("other", 256)}).drop("record", "other")
    # places follow the first replica's digests; offsets are each replica's own
    both = cut(warc.placed(made))
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    second = both.select("file", "place", F.coalesce(F.sum("other_length").over(before), F.lit(0)).cast("long").alias("offset"), F.col("other_length").alias("length"), "record_id", F.col("other_digest").alias("digest"))
    return warc.audit(both.select("file", "place", "offset", "length", "record_id", "digest"), cut(second)).select("record_id", "file", "place", "offset", "length", "status")


_OP3_HEX = "('0x' || substr({}, 1, 8))::BIGINT"
OP3_SQL = f"""
WITH n AS (SELECT greatest(1, ceil(count(*) / {warc.RECORDS}.0))::BIGINT AS files FROM pages),
body AS (SELECT page_id AS record_id, url, coalesce(html, '') AS html, coalesce(CAST(page_id AS VARCHAR), '') AS id_text FROM pages),
rec AS (SELECT record_id, url, id_text, {_OP3_HEX.format("md5(id_text || coalesce('|' || url, '|'))")} % (SELECT files FROM n) AS file,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || id_text || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM body),
cutting AS (SELECT record_id, file, url, sha256(record) AS digest, strlen(record)::BIGINT AS length, {_OP3_HEX.format("md5('damage|' || id_text)")} AS draw FROM rec),
placed AS (SELECT *, length - CASE WHEN draw % 997 = 3 THEN 9 ELSE 0 END AS length2,
  row_number() OVER (PARTITION BY file ORDER BY record_id NULLS FIRST, url NULLS FIRST, digest) - 1 AS place FROM cutting),
two AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  coalesce(sum(length2) OVER (PARTITION BY file ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset2 FROM placed)
SELECT record_id, file::INTEGER AS file, place::BIGINT AS place, "offset", length,
  CASE WHEN draw % 997 = 3 OR draw % 101 = 7 THEN 'corrupt' ELSE 'moved' END AS status
FROM two WHERE draw % 997 = 3 OR draw % 101 = 7 OR "offset" <> offset2
"""


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_model.score(docs, crc_mod("doc_id", 7) != 2).withColumn("held_out", crc_mod("doc_id", 7) == 2)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = media.read_media(media.store_payload(docs))
    return made.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.sha2("tile", 256).alias("tile_sha256"),
    )  # fmt: skip


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", line_dedup.host(F.col("url")).alias("host"), line_dedup.html_lines(F.col("html")).alias("text"))
    return line_dedup.drop_site_lines(pages, "host", "text").select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_TRIM = r"regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
OP10_SQL = rf"""
WITH base AS (SELECT row_number() OVER () AS r, page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '') AS host,
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', chr(10), 'g'),
  '(?i)</?(?:{line_dedup.BLOCKS})(?:\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages),
cut AS (SELECT r, page_id, host, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_TRIM}), lambda x: x <> '') AS ls FROM base),
one AS (SELECT r, page_id, host, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM cut),
total AS (SELECT host, count(*) AS pages FROM cut GROUP BY host),
freq AS (SELECT o.host, o.line FROM one o JOIN total t ON o.host IS NOT DISTINCT FROM t.host GROUP BY o.host, o.line
  HAVING any_value(t.pages) >= {line_dedup.LEAST} AND count(DISTINCT o.r) > 1 AND count(DISTINCT o.r) > {line_dedup.RATIO}::DOUBLE * any_value(t.pages)),
kept AS (SELECT o.r, count(*) AS n, string_agg(o.line, chr(10) ORDER BY o.i) AS text FROM one o WHERE NOT EXISTS (SELECT 1 FROM freq f WHERE f.host IS NOT DISTINCT FROM o.host AND f.line = o.line) GROUP BY o.r)
SELECT c.page_id, c.host, len(c.ls)::BIGINT AS n_lines, (len(c.ls) - coalesce(k.n, 0))::BIGINT AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM cut c LEFT JOIN kept k USING (r)
"""


def byte_tokenizer_path() -> str:
    """The byte-level tokenizer file: DRIFTLENS_BYTE_TOKENIZER, or the public one that is installed."""
    if own := os.environ.get("DRIFTLENS_BYTE_TOKENIZER"):
        return own
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_tokenizer_path())


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = rf"""
WITH line AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents),
run AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM line),
gram AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM run, (VALUES (1), (2), (3)) AS v(k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS c FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND c >= {collocations.LEAST}),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM cand c, (VALUES (1), (2)) AS v(j) WHERE j < c.k),
scored AS (SELECT t.lang, t.k, t.phrase, t.a, t.j, x.c AS l, y.c AS r, (1000000::HUGEINT * t.a * t.a) // (x.c * y.c) AS score FROM cuts t
  JOIN f x ON x.lang = t.lang AND x.phrase = t.head AND x.k = t.j JOIN f y ON y.lang = t.lang AND y.phrase = t.tail AND y.k = t.k - t.j),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner2 AS (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM cand WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM cand WHERE k = 3),
kept AS (SELECT * FROM lowest o WHERE k = 3 OR NOT EXISTS (SELECT 1 FROM inner2 i WHERE i.lang = o.lang AND i.phrase = o.phrase AND 100 * i.a >= {collocations.SHARE} * o.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n AS n, score::BIGINT AS score
FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= {collocations.MOST}
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_language_model": op4_language_model,
    "op5_media": op5_media,
    "op6_ngram_join": op6_ngram_join,
    "op7_repeats": op7_repeats,
    "op8_ann": op8_ann,
    "op9_mixing": op9_mixing,
    "op10_lines": op10_lines,
    "op11_packing": op11_packing,
    "op12_resampling": op12_resampling,
    "op13_collocations": op13_collocations,
}
ORACLES = {"op3_warc": OP3_SQL, "op10_lines": OP10_SQL, "op13_collocations": OP13_SQL}
