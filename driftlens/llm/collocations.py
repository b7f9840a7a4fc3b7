"""Phrase collocations from count streams that are kept sorted and merged in step.

Phrases of one to three words are counted by language. The counts then form one stream of rows, sorted by the
words of the phrase read from its start (prefix order) or from its end (suffix order), shorter phrases before the
longer ones that go on from them. In either order the phrases that a row is cut into, and the row that it extends, are
the last shorter ones before it, so one pass over the sorted rows meets them all in step: the suffix pass gives
each phrase the counts of its ends and marks phrases that are extended to the left, the prefix pass gives the counts
of its beginnings and marks those extended to the right. No table of counts is held or looked up.

Rows are dealt by ranges of the order; a range that begins within a word's phrases starts from the last shorter rows
of the ranges before it, one row each.

Counting leaves out early what cannot matter: a phrase is no more frequent than its parts. Words that reach the least
count set bits, and a phrase of two words is only counted where the bits of both are set; so do these for
three words. The bits have a fixed number, so that they may let rarer phrases through, but never hold back one that counts.

Defined results: null texts count as empty, a null language as `und`; empty tables give no rows; repeated rows count
each time; ties are ordered by count and phrase. Only the text and the language are read, so that other columns of any
name do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import cut, tidy
from driftlens.llm.hashing import mix
from driftlens.llm.spans import LOWER, byte_class, stretches, word_spans

U = np.uint64
BREAKS = [*b".,;:!?", *range(0x0A, 0x0E)]
SOLID = byte_class([*BREAKS, 0x20, 0x09], inside=False)
IS_BREAK = byte_class(BREAKS)
#: Words of the longest phrase; the least count of a candidate; what share of it (in hundredths) a longer phrase must
#: have to replace it; rows of each language.
LONGEST, LEAST, SHARE, MOST = 3, 10, 50, 2000
#: Bytes of text that are counted at a time, and bits of the filter of frequent shorter phrases (16 MB), in parts of 2^PART_BITS.
AT_ONCE, FILTER_BITS, PART_BITS = 1 << 20, 27, 15
_MULTIPLIERS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5)]


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words at these spans, lowered: all solid bytes, one word after the other."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LOWER[data[SOLID[data]]]))


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, for the filter alone."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    offsets = offsets - offsets[0]
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix((data + U(1)) * _MULTIPLIERS[0] + place * _MULTIPLIERS[1]), dtype=np.uint64)])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]])


def _together(parts: list[np.ndarray], bits: int = FILTER_BITS) -> np.ndarray:
    """Filter places of phrases, from the hashes of their language and words."""
    made = np.zeros(len(parts[0]), np.uint64)
    for i, h in enumerate(parts):
        made = mix(made + h * _MULTIPLIERS[i % 4] + U(i))
    return (made >> U(64 - bits)).astype(np.int64)


def _counted(codes: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples of codes and how often each stands there, by sorting."""
    if np.prod([float(max(s, 1)) for s in sizes]) >= 2**62:  # the first two made dense
        pair, back = np.unique(codes[0] * max(sizes[1], 1) + codes[1], return_inverse=True)
        found, n = _counted([back, *codes[2:]], [len(pair), *sizes[2:]])
        return [*np.divmod(pair[found[0]], max(sizes[1], 1)), *found[1:]], n
    key = np.zeros(len(codes[0]), np.int64)
    for c, s in zip(codes, sizes, strict=True):
        key = key * max(s, 1) + c
    key, n = np.unique(key, return_counts=True)
    made = []
    for s in reversed(sizes[1:]):
        key, last = np.divmod(key, max(s, 1))
        made.append(last)
    return [key, *reversed(made)], n


def counts(docs: DataFrame, text: str, lang: str, k: int, known: list | None = None) -> DataFrame:
    """(lang, phrase, n) of the phrases of k words, words joined by one blank.

    known: the filter of frequent phrases of k - 1 words - phrases that begin or end with another are left out."""
    kept = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    packed = docs.sparkSession.sparkContext.broadcast(known) if known else None

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = None if packed is None else np.concatenate([np.frombuffer(p, np.uint8) for p in packed.value])
        for batch in batches:
            langs = batch.column("lang").cast(pa.large_string()).dictionary_encode()
            lang_code, lang_words = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary
            lang_hash = _hashes(lang_words) if len(lang_words) else None
            for part in stretches(batch, "text", SOLID, k - 1, AT_ONCE):
                starts, ends, row = word_spans(part.data, part.offsets, SOLID)
                n = len(starts)
                if n < k:
                    continue
                table = _strings(part.data, starts, ends).dictionary_encode()
                code = table.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                speech = lang_code[part.first + row].astype(np.int64)
                ok = np.ones(n - k + 1, bool)
                if k > 1:
                    # a phrase goes on while no break and no other row comes between its words
                    breaks = np.cumsum(IS_BREAK[part.data], dtype=np.int32)
                    joined = (row[1:] == row[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1] - 1])
                    for j in range(k - 1):
                        ok &= joined[j : j + len(ok)]
                    del breaks, joined
                del starts, ends, row
                ok[: max(0, part.overlap - k + 1)] = False
                if flags is not None:
                    hashed = _hashes(table.dictionary)
                    for j in range(2):
                        at = np.flatnonzero(ok)
                        bit = _together([lang_hash[speech[at]], *(hashed[code[at + j + i]] for i in range(k - 1))])
                        ok[at] = (flags[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                found, times = _counted([speech[at], *(code[at + j] for j in range(k))], [len(lang_words), *[len(table.dictionary)] * k])
                for i in range(0, len(times), 1 << 15):
                    words = [table.dictionary.take(pa.array(c[i : i + (1 << 15)])) for c in found[1:]]
                    phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if k > 1 else words[0]
                    yield pa.RecordBatch.from_pydict({"lang": lang_words.take(pa.array(found[0][i : i + (1 << 15)])).cast(pa.string()), "phrase": phrase.cast(pa.string()), "n": pa.array(times[i : i + (1 << 15)].astype(np.int64))})

    return kept.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").cast("long").alias("n"))


def phrase_filter(phrases: DataFrame, k: int) -> list:
    """The bits of the filter places of phrases of k words, in parts: 2^FILTER_BITS bits, however many phrases there are."""
    size = 1 << PART_BITS

    @tidy
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _together([_hashes(batch.column(i).cast(pa.large_string())) for i in range(k + 1)]) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"part": pa.array((bit >> (PART_BITS + 3)).astype(np.int32)), "bit": pa.array((bit & (size * 8 - 1)).astype(np.int32))})

    def gather(key: tuple, found: pa.Table) -> pa.Table:
        flags = np.zeros(size * 8, np.uint8)
        flags[found.column("bit").to_numpy()] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    words = [F.col(f"w{i + 1}") for i in range(k)]
    # equal places collapse before they meet, so that a part's task gets 2^(PART_BITS + 3) rows at most
    rows = phrases.select("lang", *words).mapInArrow(places, "part int, bit int").distinct().groupBy("part").applyInArrow(gather, "part int, bits binary").collect()
    parts = [bytes(size)] * (1 << (FILTER_BITS - PART_BITS - 3))
    for r in rows:
        parts[r["part"]] = bytes(r["bits"])
    return parts


def in_step(stream: DataFrame, key: list[str], beginnings: str, extended: str, share: int) -> DataFrame:
    """Rows of phrases, read in the order of their key words, with the counts of all their beginnings in that order.

    beginnings: prefix of the new columns, {beginnings}1 for the first word and so on (0 where the phrase is not
    longer). extended: a flag column, set where a phrase that goes on from the row has share hundredths of its count."""
    k = len(key)
    # a phrase and those that add one word to it stay in one range; shorter beginnings are carried into it
    order = [F.col("lang"), *map(F.col, key)]
    dealt = stream.repartitionByRange(*order[:k]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt)
    words = F.array_size(F.filter(F.array(*key), lambda w: w != ""))
    lasts = [dealt.filter(words == j).groupBy("_part").agg(F.max_by(F.col("n"), F.struct(*order)).alias("n"), F.max(F.struct(*order)).alias("at")).collect() for j in range(1, k - 1)]
    # one row a range and length; a range starts from the last such row of those before it
    carried: dict[int, list[tuple[int, int]]] = {j + 1: sorted((r["_part"], r["n"]) for r in rows) for j, rows in enumerate(lasts)}
    columns = [c for c in stream.columns if c not in (extended,)]
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields if f.name in columns) + "".join(f", {beginnings}{j} long" for j in range(1, k)) + f", {extended} boolean"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        last = [0] * k  # counts of the phrases of 1 .. k - 1 words that are open
        held: dict[int, pa.RecordBatch] = {}  # the open rows themselves, as their flag may still change
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column("_part")[0].as_py()
                for j, rows in carried.items():
                    last[j] = max(((p, n) for p, n in rows if p < part), default=(0, 0))[1]
            rows = batch.num_rows
            n = batch.column("n").to_numpy()
            filled = [(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) > 0) for c in key]
            size = np.sum(filled, axis=0)
            flag = batch.column(extended).to_numpy(zero_copy_only=False).astype(bool)
            made, late = {}, {}
            for j in range(1, k):
                at = np.where(size == j, np.arange(rows), -1)
                at = np.maximum.accumulate(at)
                stem = np.where(at >= 0, n[np.maximum(at, 0)], last[j])
                made[j] = np.where(size > j, stem, 0)
                # a phrase of one word more that goes on from this row (or from the held one) and is frequent enough
                hit = (size == j + 1) & (100 * n >= share * stem)
                flag[at[hit & (at >= 0)]] = True
                late[j] = bool((hit & (at < 0)).any())
                stays = np.flatnonzero(size <= j)
                closed = len(stays) > 0
                if j in held and late[j]:
                    held[j] = held[j].set_column(held[j].schema.get_field_index(extended), extended, pa.array([True]))
                if closed and j in held:
                    yield held.pop(j)
                if len(at) and at[-1] >= 0:
                    last[j] = int(n[at[-1]])
            whole = {c: batch.column(c) for c in columns} | {f"{beginnings}{j}": pa.array(made[j].astype(np.int64)) for j in range(1, k)} | {extended: pa.array(flag)}
            whole = pa.RecordBatch.from_pydict(whole)
            keep = np.ones(rows, bool)
            for j in range(1, k):
                at = np.flatnonzero(size == j)
                if len(at) and not (size[at[-1] + 1 :] <= j).any():
                    held[j] = whole.slice(int(at[-1]), 1)
                    keep[at[-1]] = False
            yield whole.filter(pa.array(keep))
        yield from held.values()

    return dealt.mapInArrow(run, out_schema)


def _scores(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """floor(1000000 a a / (l r)), exact: in 64 bits where all products fit, else in Python's whole numbers."""
    small = (a < 3_000_000) & (left < 3_000_000_000) & (right < 3_000_000_000)
    out = np.zeros(len(a), np.int64)
    out[small] = 1_000_000 * a[small] * a[small] // np.maximum(left[small] * right[small], 1)
    for i in np.flatnonzero(~small).tolist():
        out[i] = 1_000_000 * int(a[i]) ** 2 // (int(left[i]) * int(right[i]))
    return out


def _top(made: pa.Table, most: int) -> pa.Table:
    """The first `most` rows of each language."""
    made = made.sort_by([("lang", "ascending"), ("score", "descending"), ("a", "descending"), ("phrase", "ascending")])
    codes = made.column("lang").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
    place = np.arange(len(codes)) - np.repeat(first[:-1], np.diff(first))
    return made.filter(pa.array(place < most))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `most` phrases of two and three words of each language."""
    names = [f"w{i + 1}" for i in range(LONGEST)]
    word = lambda i: F.coalesce(F.get(F.split("phrase", " "), F.lit(i)), F.lit("")).alias(f"w{i + 1}")
    split = lambda df: df.filter(F.col("n") >= least).select("lang", *(word(i) for i in range(LONGEST)), "n")
    # numbers of words by language need all words, also the rare ones
    words = cut(counts(docs, text, lang, 1))
    totals = words.groupBy("lang").agg(F.sum("n").cast("long").alias("total"))
    one = split(words)
    two = cut(split(counts(docs, text, lang, 2, phrase_filter(one, 1))))
    three = split(counts(docs, text, lang, 3, phrase_filter(two, 2)))
    stream = one.unionByName(two).unionByName(three).withColumn("extended", F.lit(False))
    # suffix order: words from the end, so that w1 is the last one
    backwards = F.reverse(F.filter(F.array(*names), lambda w: w != ""))
    turned = stream.select("lang", *(F.coalesce(F.get(backwards, F.lit(i)), F.lit("")).alias(f"e{i + 1}") for i in range(LONGEST)), *names, "n", "extended")
    ends = in_step(turned, ["e1", "e2", "e3"], "end", "extended", share)
    both = in_step(ends.select("lang", *names, "n", "extended", "end1", "end2"), names, "begin", "extended", share)
    best = both.filter("w2 <> '' AND NOT extended").select("lang", *names, "n", "begin1", "begin2", "end1", "end2")

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b1, b2, e1, e2 = (batch.column(c).to_numpy() for c in ("n", "begin1", "begin2", "end1", "end2"))
            two = b2 == 0  # two words: one cut; three: after the first word or after the second
            first, second = _scores(a, b1, np.where(two, e1, e2)), _scores(a, np.where(two, b1, b2), e1)
            late = second < first
            w = [batch.column(c) for c in names]
            phrase = pc.if_else(pa.array(two), pc.binary_join_element_wise(w[0], w[1], " "), pc.binary_join_element_wise(*w, " "))
            l, r = np.where(late & ~two, b2, b1), np.where(late | two, e1, e2)
            made = pa.Table.from_pydict({"lang": batch.column("lang"), "phrase": phrase, "a": a, "l": l, "r": r, "score": np.minimum(first, second)})
            kept = _top(made if kept is None else pa.concat_tables([kept, made]), most)
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    # a task's best, then the best of groups of tasks, then all: no task gets more than `most` rows of each of some others
    made = best.mapInArrow(score, "lang string, phrase string, a long, l long, r long, score long")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = made.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
