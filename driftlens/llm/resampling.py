"""Importance resampling of documents towards a target text distribution, over hashed runs of words.

A feature is a run of 1 to `longest` consecutive words, joined by one space; its bucket is the CRC-32 of those
bytes modulo a number of buckets. A document's words are written once, one space apart, and scanned once: the
running CRC at each word's end is kept. CRCs are linear over GF(2), so the CRC of any run of words is the running
CRC at its end, XORed with the one at its start shifted by as many zero bytes as the run is long. No run's bytes
are read again.

Corpus and target counts of buckets (as many rows as there are buckets, whatever the input) give each bucket a
gain; a document's weight is the floored mean gain of its features, and a seeded Gumbel draw added to it picks
documents in proportion to their importance, without replacement.

Defined results: a null text counts as empty; without features the weight is 0. A null id draws like an empty id
and is ranked after others; rows of one id are ordered by their text's hash, rows equal in both by chance, which
changes no value. An empty table gives an empty result, an empty target counts as no features. Only the key and
the text are read, so that other columns of any name do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import cut, tidy
from driftlens.llm.spans import LOWER, Stretch, byte_class, stretches, word_spans

U = np.uint32
BUCKETS, LONGEST, SCALE = 10_000, 2, 1000
#: Letters a-z, digits and all bytes of characters beyond ASCII; A-Z are lowered first.
SOLID = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Bytes scanned side by side: the normalised text is laid out in rows of this width.
WIDTH = 1024


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ U(0xEDB88320), table >> 1).astype(np.uint32)
    return table


#: State after one byte from state 0 (the reflected CRC-32 polynomial).
STEP = _byte_table()


def _by_bytes(images: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of single bits, as four tables of 256."""
    tables = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            tables[place, (np.arange(256) >> bit) & 1 == 1] ^= images[8 * place + bit]
    return tables


def _apply(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tables[0][v & 255] ^ tables[1][(v >> 8) & 255] ^ tables[2][(v >> 16) & 255] ^ tables[3][v >> 24]


def _shifts(levels: int = 44) -> list[np.ndarray]:
    """The map "followed by 2^k zero bytes" for each k, by squaring."""
    bits = (np.ones(32, np.uint32) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    made = [_by_bytes((bits >> 8) ^ STEP[bits & 255])]
    while len(made) < levels:
        made.append(_by_bytes(_apply(made[-1], _apply(made[-1], bits))))
    return made


SHIFTS = _shifts()


def shift(states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each state after as many zero bytes as its length says."""
    out = states.astype(np.uint32, copy=True)
    most = int(lengths.max(initial=0))
    for k in range(most.bit_length()):
        at = np.flatnonzero((lengths & (1 << k)) != 0)
        out[at] = _apply(SHIFTS[k], out[at])
    return out


#: What a run's length adds to its state: the start value after as many bytes, and the final change; for short runs.
ENDS = shift(np.full(4096, 0xFFFFFFFF, np.uint32), np.arange(4096)) ^ U(0xFFFFFFFF)


def ending(lengths: np.ndarray) -> np.ndarray:
    made = ENDS[np.minimum(lengths, len(ENDS) - 1)]
    long = np.flatnonzero(lengths >= len(ENDS))
    made[long] = shift(np.full(len(long), 0xFFFFFFFF, np.uint32), lengths[long]) ^ U(0xFFFFFFFF)
    return made


def running(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The running state (from 0, no final change) after the first `at` bytes of data, for each of the sorted places.

    One scan: rows of WIDTH bytes advance together, and a row's own states are completed by the state that
    the rows above it end in."""
    rows = max(1, -(-len(data) // WIDTH))
    laid = np.zeros((rows, WIDTH), np.uint8)
    laid.reshape(-1)[: len(data)] = data
    laid = np.ascontiguousarray(laid.T)
    states = np.empty((WIDTH, rows), np.uint32)
    state = np.zeros(rows, np.uint32)
    for i in range(WIDTH):
        state = STEP[(state ^ laid[i]) & 255] ^ (state >> 8)
        states[i] = state
    carry, above, past = np.zeros(rows, np.uint32), 0, SHIFTS[WIDTH.bit_length() - 1]
    for i, own in enumerate(states[-1].tolist()):
        carry[i] = above
        above = int(past[0, above & 255] ^ past[1, (above >> 8) & 255] ^ past[2, (above >> 16) & 255] ^ past[3, above >> 24]) ^ own
    row, column = np.divmod(np.maximum(at, 1) - 1, WIDTH)
    found = shift(carry[row], column + 1) ^ states[column, row]
    return np.where(at > 0, found, U(0))


def feature_crcs(stretch: Stretch, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of each feature that ends beyond the stretch's overlap, its row, words of each row)."""
    starts, ends, row = word_spans(stretch.data, stretch.offsets, SOLID)
    rows, n = len(stretch.offsets) - 1, len(starts)
    new = np.bincount(row[stretch.overlap :], minlength=rows)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), new
    size = ends - starts
    stop = np.cumsum(size) + np.arange(n)
    begin = stop - size
    flat = np.full(int(stop[-1]), 0x20, np.uint8)
    word = np.repeat(np.arange(n), size)
    flat[np.arange(len(word)) + word] = LOWER[stretch.data[SOLID[stretch.data]]]
    after = running(flat, stop)
    # a word begins one space after the one before ends
    before = np.zeros(n, np.uint32)
    before[1:] = _apply(SHIFTS[0], after[:-1]) ^ STEP[0x20]
    crcs, of = [], []
    for k in range(min(longest, n)):
        first = np.arange(max(0, stretch.overlap - k), n - k)
        first = first[row[first] == row[first + k]]
        length = stop[first + k] - begin[first]
        own = after[first + k] ^ shift(before[first], length)
        crcs.append(own ^ ending(length))
        of.append(row[first])
    return np.concatenate(crcs), np.concatenate(of), new


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket int, n long): features of all texts by bucket; a task sends one row a bucket, whatever it read."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in stretches(batch, "text", SOLID, longest - 1):
                total += np.bincount(feature_crcs(part, longest)[0] % U(buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(there, pa.int32()), "n": pa.array(total[there])})

    made = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    return made.groupBy("bucket").agg(F.sum("n").cast("long").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's floored, scaled log ratio of smoothed shares; both tables hold one row a bucket at most."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, into in ((corpus, s), (target, t)):
        for r in counts.collect():
            into[r["bucket"]] = r["n"]
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(SCALE * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight) of each row of docs."""
    buckets = len(gain)
    kept = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kept = kept.withColumn("text_hash", F.xxhash64("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for part in stretches(batch, "text", SOLID, longest - 1):
                crcs, row, new = feature_crcs(part, longest)
                here = slice(part.first, part.first + len(new))
                words[here] += new
                features[here] += np.bincount(row, minlength=len(new))
                # sums of whole numbers far below 2^53, so exact in doubles
                total[here] += np.bincount(row, gain[crcs % U(buckets)], len(new)).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_words": pa.array(words), "n_features": pa.array(features), "weight": pa.array(weight)})

    id_type = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {id_type}, text_hash long, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int = 7) -> Column:
    """The seeded draw of an id: floor(-1000 ln(-ln u)), u from the first 32 bits of the SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-F.lit(float(SCALE)) * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Every document's (doc_id, n_words, n_features, weight, score, rank): `percent` of the documents with at least
    `least_words` words are drawn, by score; rank is null for those not drawn.

    Texts leave the scan in no shuffle. Ranks are dealt by ranges of the order, so that no task sees all rows."""
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest), buckets)
    scored = weigh(docs, gain, key, text, longest).withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long"))
    # eligible rows come first in the order, so that their ranks are places in it
    order = [F.col("n_words") < least_words, F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("text_hash"), F.col("n_features")]
    dealt = cut(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n_words") >= least_words).alias("eligible")).collect()
    starts, before = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        starts.append((r["_part"], before))
        before += r["rows"]
    drawn = percent * sum(r["eligible"] for r in sizes) // 100
    own = Window.partitionBy("_part").orderBy(*order)
    # a row a range of the order, so as small as the number of partitions
    ranked = dealt.withColumn("place", F.row_number().over(own)).join(docs.sparkSession.createDataFrame(starts, "_part int, start long"), "_part")
    place = F.col("place") + F.col("start")
    return ranked.withColumn("rank", F.when((F.col("n_words") >= least_words) & (place <= drawn), place)).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def drawn_rows(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **parameters: int) -> DataFrame:
    """The rows of docs that `resample` draws, whole, as the semi-join of their ids.

    An id that stands on several rows keeps all of them as soon as one is drawn."""
    picked = resample(docs, target, key, text, **parameters).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(picked, F.col(f"`{key}`").eqNullSafe(F.col("_drawn")), "left_semi")
