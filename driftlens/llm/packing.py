"""Packing of tokenised documents into sequences by vector best-fit.

A sequence offers three capacities: tokens, documents and attention cost (each piece costs the square of its
length). A piece goes into the open sequence that every capacity allows and that scores best: least weighted norm
of what would be left (`norm`), or largest weighted dot product of piece and residual (`dot`). Longest pieces first.

A piece's demands follow from its length alone, so the packing is solved once for all rows on the histogram of
lengths, which has at most as many entries as a sequence has tokens: equal pieces meet equal sequences in classes.
Each piece is then placed by its rank among the pieces of its length. Ranks come from counts by task and length,
so that a hot length or document needs no common task, and no piece is compared with another.

Defined results: a null text counts as empty and is a piece of the end token alone; a document longer than a
sequence is cut, its first piece takes the remainder. Null ids and repeated rows are packed like any other; an
empty table gives no pieces. Only the key and the text are read, so that other columns of any name do not matter.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.bpe import byte_letters
from driftlens.llm.common import cut, tidy
from driftlens.llm.hashing import pieces

TOKENS, END_ID = 1024, 2
#: The split of byte-level vocabularies (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are encoded at a time, and a place where every split begins anew: a blank after a non-blank.
AT_ONCE, SAFE = 1 << 20, re.compile(r"(?<=[^\s\x1c-\x1f]) ")
_READY: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizer file. Files with other steps, whose ids would differ, are refused."""
    if path not in _READY:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec["normalizer"]
        byte = {letter: i for i, letter in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}
        made = [ranks.get(bytes(byte[c] for c in "".join(pair if isinstance(pair, list) else pair.split(" ")))) for pair in model["merges"]]
        if not plain or None in made or made != sorted(made):
            raise ValueError(f"{path}: not a plain byte-level vocabulary in merge order")
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        _READY[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={t: i for t, i in ranks.items() if i not in special.values()}, special_tokens=special)
    return _READY[path]


def encode(own: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a whole text; a long one is encoded in parts that end where no token can go on."""
    made, start = [], 0
    while len(text) - start > AT_ONCE:
        found = SAFE.search(text, start + AT_ONCE)
        if not found:
            break
        made.append(own.encode_to_numpy(text[start : found.start()], allowed_special="all"))
        start = found.start()
    made.append(own.encode_to_numpy(text[start:] if start else text, allowed_special="all"))
    return np.concatenate(made).astype("<u4")


def tokenise(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokens: int = TOKENS, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], task, place): the pieces of all documents; place counts a
    task's pieces of one length from 0."""
    kept = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, task = encoding(path), np.zeros(tokens + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                row, piece, start, length, crc, place, lists = [], [], [], [], [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    all_ids = np.append(encode(own, t), np.array(end_id, "<u4")).astype("<u4")
                    n = len(all_ids)
                    stops = range((n - 1) % tokens + 1, n + 1, tokens)
                    a = 0
                    for k, b in enumerate(stops):
                        row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(all_ids[a:b].tobytes())), place.append(int(seen[b - a]))
                        seen[b - a] += 1
                        if ids:
                            lists.append(all_ids[a:b].astype(np.int32))
                        a = b
                made = {"doc_id": part.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if ids:
                    made["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_pydict(made | {"task": pa.array(np.full(len(row), task), pa.int32()), "place": pa.array(place, pa.int64())})

    id_type = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long{', ids array<int>' if ids else ''}, task int, place long")


class Bins:
    """Open sequences in classes of equal residuals; each class holds runs of sequence numbers."""

    def __init__(self, capacity: tuple[int, int, int], weights: tuple[float, float, float], measure: str):
        self.capacity, self.weights, self.measure = np.array(capacity, np.float64), np.array(weights, np.float64), measure
        self.full = capacity
        self.open: dict[tuple[int, int, int], list[list[int]]] = {}
        self.made = 0

    def best(self, item: tuple[int, int, int]) -> tuple[int, int, int] | None:
        """The class that an item of these demands goes to, if one can take it; ties by the smaller residual."""
        states = [s for s in self.open if all(left >= need for left, need in zip(s, item, strict=True))]
        if not states:
            return None
        left, need = np.array(states, np.float64) / self.capacity, np.array(item, np.float64) / self.capacity
        score = (self.weights * (left - need) ** 2).sum(1) if self.measure == "norm" else -(self.weights * left * need).sum(1)
        return min(zip(score.tolist(), states, strict=True))[1]

    def fits(self, state: tuple[int, int, int], item: tuple[int, int, int]) -> int:
        """How many such items one sequence of a class can take."""
        return min(left // need for left, need in zip(state, item, strict=True) if need)

    def take(self, state: tuple[int, int, int], n: int) -> list[list[int]]:
        """n sequences out of a class, as runs (first, number)."""
        if state == self.full:
            self.made += n
            return [[self.made - n, n]]
        runs, out = self.open[state], []
        while n:
            first, size = runs[-1]
            used = min(size, n)
            out.append([first, used])
            n -= used
            if used == size:
                runs.pop()
            else:
                runs[-1] = [first + used, size - used]
        if not runs:
            del self.open[state]
        return out

    def has(self, state: tuple[int, int, int]) -> int:
        return sum(n for _, n in self.open[state])


def plan(histogram: dict[int, int], tokens: int = TOKENS, documents: int | None = None, cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), measure: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank from, rank to, first sequence, pieces a sequence, offset): where the pieces of each length go.

    A length's piece of rank r in from .. to - 1 goes to sequence first + (r - from) // pieces, at the offset plus
    (r - from) % pieces lengths. The work depends on the number of lengths, not of pieces."""
    capacity = (tokens, documents if documents is not None else tokens, cost if cost is not None else tokens * tokens)
    bins, out = Bins(capacity, weights, measure), []
    for length in sorted(histogram, reverse=True):
        item, left, rank = (length, 1, length * length), histogram[length], 0
        if bins.fits(capacity, item) < 1:
            raise ValueError(f"a piece of {length} tokens fits into no empty sequence")
        while left:
            state = bins.best(item) or capacity
            most = bins.fits(state, item)
            there = left if state == capacity else bins.has(state)
            # whole sequences with as many pieces as fit, or one with the rest
            each = min(most, left)
            used = min(there, left // each)
            for first, n in bins.take(state, used):
                out.append((length, rank, rank + n * each, first, each, tokens - state[0]))
                rank += n * each
                after = tuple(a - each * b for a, b in zip(state, item, strict=True))
                if after[0] > 0 and after[1] > 0 and after[2] > 0:
                    bins.open.setdefault(after, []).append([first, n])
            left -= used * each
    return out


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokens: int = TOKENS, end_id: int = END_ID, documents: int | None = None, cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), measure: str = "norm", ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece with its place.

    documents, cost: most pieces and largest sum of squared lengths of a sequence; None leaves them to the tokens."""
    made = cut(tokenise(docs, path, key, text, tokens, end_id, ids))
    counts = cut(made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    # at most `tokens` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("ranks_before"))
    where = docs.sparkSession.createDataFrame(plan(histogram, tokens, documents, cost, weights, measure), "length long, rank_from long, rank_to long, first long, each long, at long")
    rank = F.col("place") + F.col("ranks_before")
    nth = F.col("rank") - F.col("rank_from")
    ranked = made.join(starts, ["length", "task"]).withColumn("rank", rank)
    # a few rows a length, so bounded by the sequence's tokens and not by the input
    placed = ranked.join(F.broadcast(where), (ranked["length"] == where["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))).drop(where["length"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else []), (F.col("first") + F.expr("(rank - rank_from) div each")).alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"))
