"""A hierarchical Pitman-Yor language model over words, and its log10 probabilities of texts.

Three levels: a word is drawn in the restaurant of its preceding word, whose parent is the restaurant of a
class of preceding words, whose parent is the restaurant of single words. That one's own parent gives one half
to words not seen in training, taken together, and one half evenly to the known ones. Preceding words are
told apart by hash into a number of restaurants that grows with the input, one for each CONTEXT_BYTES of text
up to MOST_CONTEXTS, so that a frequent word has one to itself but for some rare ones; the start of a text has
its own. Seating is sampled by Gibbs sweeps: given how many tables every restaurant had after the last sweep,
the tables of each (context, word) are drawn anew by seating its customers one after another, and each table
sends one customer to the parent, level by level. The probabilities of the sweeps after burn-in are averaged.

Words travel as 64-bit hashes in columnar blocks. The vocabulary is dealt into buckets by hash, in
number proportional to the input, so that one bucket fits a task whatever the size of the corpus; a bucket
with very common words is scored by several tasks, each for some of the pieces. What meets on the driver and
goes to all tasks is the table totals of the restaurants, MOST_CONTEXTS numbers a sweep at most. A sweep is
replayed from these totals and seeds, so that it is the same on every executor and after a loss.

Null texts are empty; every text ends with one end mark, which is a token; null ids count as an empty
id in the choice of training rows and are kept; repeated rows are texts of their own; without training
rows every token is unknown; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import parts, stored, tidy
from driftlens.llm.hashing import pieces, word_hashes

#: Restaurants of classes of preceding words; text bytes for each restaurant of preceding words, and the most of these.
CLASSES, CONTEXT_BYTES, MOST_CONTEXTS = 256, 16 << 10, 1 << 20
SWEEPS, BURN_IN, STRENGTH = 6, 2, 1.0
#: Numbers of a vector of totals that travel as one row.
CHUNK = 4096
#: Text bytes for each bucket of the vocabulary, and bytes of text that one block stands for, about.
BUCKET_BYTES, PIECE_BYTES = 16 << 20, 4 << 20
END = np.uint64(0xE0D0C0B0A0908070)


def restaurants(size: int) -> int:
    """Restaurants of preceding words for so many bytes of text: a power of two."""
    return min(MOST_CONTEXTS, max(CLASSES, 1 << (size // CONTEXT_BYTES).bit_length()))


def tokens(texts: pa.Array, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, row) of every token of the texts, the end mark included."""
    found, counts = word_hashes(texts)
    rows = len(counts)
    ends = np.cumsum(counts + 1) - 1
    word = np.empty(len(found) + rows, np.uint64)
    is_end = np.zeros(len(word), bool)
    is_end[ends] = True
    word[is_end], word[~is_end] = END, found
    context = np.empty(len(word), np.int64)
    context[1:] = 1 + ((word[:-1] >> np.uint64(17)) % np.uint64(contexts - 1)).astype(np.int64)
    context[ends - counts] = 0
    return word, context, np.repeat(np.arange(rows), counts + 1)


def bucket_of(word: np.ndarray, buckets: int) -> np.ndarray:
    return ((word >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _bytes(x: np.ndarray, kind: type) -> bytes:
    return x.astype(kind).tobytes()


def _narrow(x: np.ndarray) -> bytes:
    """Numbers of 0 or more in the fewest bytes that hold all of them, that width before them."""
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


COUNT_SCHEMA = "bucket int, words binary, sizes binary, contexts binary, counts binary"
_COUNT_ARROW = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("contexts", pa.binary()), ("counts", pa.binary())])


def _merge(word: np.ndarray, context: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts summed by (word, context): distinct words, contexts of each, contexts, counts."""
    words, which = np.unique(word, return_inverse=True)
    key, where = np.unique(which * MOST_CONTEXTS + context, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, where, count)
    return words, np.bincount(key // MOST_CONTEXTS, minlength=len(words)), key % MOST_CONTEXTS, total


def _split(merged: tuple[np.ndarray, ...], buckets: int) -> pa.RecordBatch:
    words, sizes, contexts, counts = merged
    bucket = bucket_of(words, buckets)
    of_pair = np.repeat(bucket, sizes)
    order, pair_order = bucket.argsort(kind="stable"), of_pair.argsort(kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    cuts, pair_cuts = [*first.tolist(), len(order)], [*np.searchsorted(of_pair[pair_order], used).tolist(), len(pair_order)]
    rows = {n: [] for n in _COUNT_ARROW.names}
    for i, b in enumerate(used.tolist()):
        own, pairs = order[cuts[i] : cuts[i + 1]], pair_order[pair_cuts[i] : pair_cuts[i + 1]]
        for name, value in zip(_COUNT_ARROW.names, (b, _bytes(words[own], np.uint64), _narrow(sizes[own]), _narrow(contexts[pairs]), _narrow(counts[pairs])), strict=True):
            rows[name].append(value)
    return pa.RecordBatch.from_pydict(rows, schema=_COUNT_ARROW)


def _unpack(row: dict) -> tuple[np.ndarray, ...]:
    return np.frombuffer(row["words"], np.uint64), _wide(row["sizes"]), _wide(row["contexts"]), _wide(row["counts"])


def count(train: DataFrame, text: str, buckets: int, contexts: int = CLASSES) -> DataFrame:
    """One row a bucket: the counts of its words by context, over all rows of `train`."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                word, context, _ = tokens(part.column("text"), contexts)
                yield _split(_merge(word, context, np.ones(len(word), np.int64)), buckets)

    def gather(group: pa.Table) -> pa.Table:
        merged = None
        for batch in group.select(["words", "sizes", "contexts", "counts"]).to_batches(max_chunksize=64):
            rows = [_unpack(r) for r in batch.to_pylist()]
            if merged is not None:
                rows.append(merged)
            word = np.concatenate([np.repeat(w, s) for w, s, _, _ in rows])
            merged = _merge(word, np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows]))
        words, sizes, at, counts = merged
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "words": [_bytes(words, np.uint64)], "sizes": [_narrow(sizes)], "contexts": [_narrow(at)], "counts": [_narrow(counts)]}, schema=_COUNT_ARROW)

    return train.select(F.col(text).alias("text")).mapInArrow(run, COUNT_SCHEMA).groupBy("bucket").applyInArrow(gather, COUNT_SCHEMA)


def draw_tables(customers: np.ndarray, discount: float, new: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables that so many customers of one dish take, one after another; `new` weighs a new table.

    The first 64 are seated singly, later ones in growing runs with the weight at the middle of a run."""
    order = (-customers).argsort(kind="stable")
    c, a = customers[order], new[order]
    t = np.minimum(c, 1).astype(np.float64)
    for i in range(1, 64):
        n = int(np.searchsorted(-c, -i, "left"))
        if not n:
            break
        t[:n] += rng.random(n) * (a[:n] + i - discount * t[:n]) < a[:n]
    i = 64
    while (n := int(np.searchsorted(-c, -i, "left"))) > 0:
        run = np.minimum(c[:n] - i, i // 2)
        t[:n] += rng.binomial(run, np.clip(a[:n] / (a[:n] + i + run / 2 - discount * t[:n]), 0, 1))
        i += i // 2
    out = np.empty_like(t)
    out[order] = t
    return out


class Bucket:
    """The words of one bucket and their seating after each sweep of `history`.

    history: the totals after each sweep, beginning with the first seating, in which every word has one
    table in each restaurant where it is known. One array a sweep: tables of each context's restaurant,
    customers and tables of each class's, customers and tables of the restaurant of single words."""

    def __init__(self, row: dict, shape: dict):
        self.words, sizes, self.contexts, self.counts = _unpack(row)
        self.of = np.repeat(np.arange(len(self.words)), sizes)
        self.bucket, self.shape, self.size = row["bucket"], shape, shape["contexts"]
        self.known = np.bincount(self.of, self.counts, len(self.words))
        # (word, class) of each (word, context)
        self.mid_keys, self.mid = np.unique(self.of * CLASSES + self.contexts % CLASSES, return_inverse=True)
        self.mid_of, self.classes = self.mid_keys // CLASSES, self.mid_keys % CLASSES

    def first(self) -> tuple[np.ndarray, ...]:
        low = np.ones(len(self.of))
        return low, np.bincount(self.mid, minlength=len(self.mid_keys)).astype(np.float64), np.ones(len(self.mid_keys)), np.bincount(self.mid_of, minlength=len(self.words)).astype(np.float64), np.ones(len(self.words))

    def parts(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        """Tables of contexts, customers and tables of classes, customers and tables of single words."""
        n = self.size
        return totals[:n], totals[n : n + CLASSES], totals[n + CLASSES : n + 2 * CLASSES], totals[-2], totals[-1]

    def single(self, state: tuple[np.ndarray, ...], totals: np.ndarray) -> np.ndarray:
        """Probability of each word in the restaurant of single words."""
        d, even, (*_, m, t) = self.shape["d0"], 0.5 / self.shape["types"], self.parts(totals)
        return (state[3] - d * state[4] + (STRENGTH + d * t) * even) / (STRENGTH + m)

    def middle(self, state: tuple[np.ndarray, ...], totals: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Probability of each word in each class it is known in."""
        d, (_, m, t, *_) = self.shape["d1"], self.parts(totals)
        return (state[1] - d * state[2] + (STRENGTH + d * t[self.classes]) * single[self.mid_of]) / (STRENGTH + m[self.classes])

    def seatings(self, history: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """Seating (tables by pair; customers and tables by word and class; the same by word) after each sweep."""
        state = self.first()
        d0, d1, d2 = self.shape["d0"], self.shape["d1"], self.shape["d2"]
        for s, totals in enumerate(history):
            rng = np.random.default_rng((self.bucket, s))
            low, _, mid, *_, top = self.parts(totals)
            single = self.single(state, totals)
            tables = draw_tables(self.counts, d2, (STRENGTH + d2 * low[self.contexts]) * self.middle(state, totals, single)[self.mid], rng)
            m = np.bincount(self.mid, tables, len(self.mid_keys))
            t = draw_tables(m.astype(np.int64), d1, (STRENGTH + d1 * mid[self.classes]) * single[self.mid_of], rng)
            m0 = np.bincount(self.mid_of, t, len(self.words))
            state = tables, m, t, m0, draw_tables(m0.astype(np.int64), d0, np.full(len(m0), (STRENGTH + d0 * top) * 0.5 / self.shape["types"]), rng)
            yield state

    def totals(self, state: tuple[np.ndarray, ...]) -> np.ndarray:
        return np.concatenate([np.bincount(self.contexts, state[0], self.size), np.bincount(self.classes, state[1], CLASSES), np.bincount(self.classes, state[2], CLASSES), [state[3].sum(), state[4].sum()]])


def _sums(counts: DataFrame, of_row) -> np.ndarray:
    """The sum over all buckets of an array of fixed length made from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                value = of_row(row)
                total = value.astype(float) if total is None else total + value
        if total is not None:
            chunks = [total[i : i + CHUNK] for i in range(0, len(total), CHUNK)]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(chunks)), pa.int32()), "numbers": pa.array([x.tobytes() for x in chunks], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x, np.float64) for x in sorted(group.column("numbers").to_pylist()))
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "numbers": pa.array([whole.tobytes()], pa.binary())})

    # a task sums some buckets before its sums are sent
    made = counts.coalesce(max(16, parts(counts.sparkSession) // 4)).mapInArrow(run, "chunk int, numbers binary")
    rows = made.groupBy("chunk").applyInArrow(add, "chunk int, numbers binary").orderBy("chunk").toArrow()
    return np.concatenate([np.zeros(0), *(np.frombuffer(x, np.float64) for x in rows.column("numbers").to_pylist())])


def train(counts: DataFrame, contexts: int = CLASSES) -> dict:
    """Discounts, totals and the history of sweeps; their size is that of the restaurants."""

    def basics(row: dict) -> np.ndarray:
        words, sizes, at, c = _unpack(row)
        of = np.repeat(np.arange(len(words)), sizes)
        mid, many = np.unique(of * CLASSES + at % CLASSES, return_counts=True)
        several = np.bincount(mid // CLASSES, minlength=len(words))
        ones = [((x == 1).sum(), (x == 2).sum()) for x in (several, many, c)]
        return np.concatenate([np.bincount(at, c, contexts), np.bincount(at, minlength=contexts), np.bincount(mid % CLASSES, many, CLASSES), np.bincount(mid % CLASSES, minlength=CLASSES), *ones, [len(words)]])

    b = _sums(counts, basics)
    if not len(b):
        return {"contexts": contexts, "types": 0, "tokens": 0, "d0": 0.5, "d1": 0.5, "d2": 0.5, "customers": np.zeros(contexts), "history": []}
    share = lambda one, two: float(np.clip(one / max(1.0, one + 2 * two), 0.1, 0.95))
    *pairs, types = b[2 * contexts + 2 * CLASSES :]
    discounts = {f"d{i}": share(*pairs[2 * i : 2 * i + 2]) for i in range(3)}
    shape = {"contexts": contexts, "types": int(types), "tokens": int(b[:contexts].sum()), "customers": b[:contexts], **discounts}
    middle = b[2 * contexts : 2 * contexts + 2 * CLASSES]
    history = [np.concatenate([b[contexts : 2 * contexts], middle, [middle[CLASSES:].sum(), types]])]
    spark = counts.sparkSession
    for _ in range(SWEEPS):
        past = spark.sparkContext.broadcast((shape, list(history)))

        def sweep(row: dict, past=past) -> np.ndarray:
            own = Bucket(row, past.value[0])
            for state in own.seatings(past.value[1]):
                pass
            return own.totals(state)

        history.append(_sums(counts, sweep))
        past.unpersist()
    return shape | {"history": history}


class Predictor:
    """Averaged predictive probabilities of one bucket's words."""

    def __init__(self, row: dict | None, model: dict):
        self.model, self.samples, self.bucket = model, [], None
        history = model["history"]
        self.words = np.zeros(0, np.uint64)
        if row is not None:
            b = self.bucket = Bucket(row, model)
            self.words, self.known = b.words, b.known
            self.keys = b.of * model["contexts"] + b.contexts
            for s, state in enumerate(b.seatings(history[:-1])):
                if s >= BURN_IN:
                    single = b.single(state, history[s + 1])
                    self.samples.append((np.maximum(b.counts - model["d2"] * state[0], 0).astype(np.float32), b.middle(state, history[s + 1], single), single, history[s + 1]))

    def unknown(self, totals: np.ndarray) -> float:
        d = self.model["d0"]
        return (STRENGTH + d * totals[-1]) * (0.5 if self.model["types"] else 1.0) / (STRENGTH + totals[-2])

    @staticmethod
    def _find(have: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of wanted in the sorted `have`, and whether they are there."""
        at = np.searchsorted(have, wanted)
        at[at == len(have)] = 0
        return at, have[at] == wanted if len(have) else np.zeros(len(wanted), bool)

    def log10(self, words: np.ndarray, which: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For tokens (words[which], contexts): log10 probability; and the training count of each of `words`."""
        at, seen = self._find(self.words, words)
        count = np.where(seen, self.known[at], 0) if len(self.words) else np.zeros(len(words))
        n = self.model["contexts"]
        if not self.model["history"]:
            return np.zeros(len(which)), count
        d1, d2 = self.model["d1"], self.model["d2"]
        classes, total = contexts % CLASSES, np.zeros(len(which))
        if len(self.words):
            known = seen[which]
            pair, met = self._find(self.keys, at[which] * n + contexts)
            mid, near = self._find(self.bucket.mid_keys, at[which] * CLASSES + classes)
            met, near = met & known, near & known
        samples = self.samples or [(None, None, None, t) for t in self.model["history"][1 + BURN_IN :]]
        for own, middle, single, totals in samples:
            base = np.full(len(words), self.unknown(totals))
            if own is not None:
                base[seen] = single[at[seen]]
            customers, tables = totals[n : n + CLASSES], totals[n + CLASSES : n + 2 * CLASSES]
            up = (STRENGTH + d1 * tables[classes]) * base[which] / (STRENGTH + customers[classes])
            if own is not None:
                up = np.where(near, middle[mid], up)
            mass = (STRENGTH + d2 * totals[contexts]) * up
            total += ((np.where(met, own[pair], 0) if own is not None else 0) + mass) / (STRENGTH + self.model["customers"][contexts])
        return np.log10(total / len(samples)), count


BLOCK_SCHEMA = "bucket int, piece bigint, ids array<bigint>, lengths binary, words binary, sizes binary, rows binary, contexts binary, counts binary"
SUM_SCHEMA = "piece bigint, ids array<bigint>, lengths binary, known binary, base binary, score binary"


def blocks(docs: DataFrame, buckets: int, contexts: int) -> DataFrame:
    """docs(id, text) as blocks: the distinct (word, context, row) of a piece that fall into a bucket.

    A piece's ids and lengths go with one of its blocks, another bucket's for each piece."""
    schema = pa.schema([("bucket", pa.int32()), ("piece", pa.int64()), ("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("lengths", "words", "sizes", "rows", "contexts", "counts"))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                word, context, row = tokens(part.column("text"), contexts)
                words, which = np.unique(word, return_inverse=True)
                n = part.num_rows
                key, times = np.unique((which * contexts + context) * n + row, return_counts=True)
                which = key // n // contexts
                lead = number % buckets
                bucket = bucket_of(words, buckets)
                order, key_order = bucket.argsort(kind="stable"), bucket[which].argsort(kind="stable")
                used = np.union1d(bucket, [lead])
                edges, key_edges = (np.column_stack([np.searchsorted(x, used), np.searchsorted(x, used, "right")]) for x in (bucket[order], bucket[which][key_order]))
                sizes = np.bincount(which, minlength=len(words))
                rows = {x: [] for x in schema.names}
                for b, edge, key_edge in zip(used.tolist(), edges, key_edges, strict=True):
                    own, keys = order[slice(*edge)], key_order[slice(*key_edge)]
                    whole = b == lead
                    values = (b, (task << 24) + number, part.column("id").to_pylist() if whole else None, _bytes(np.bincount(row, minlength=n), np.uint32) if whole else None, _bytes(words[own], np.uint64), _narrow(sizes[own]), _narrow(key[keys] % n), _narrow(key[keys] // n % contexts), _narrow(times[keys]))
                    for name, value in zip(schema.names, values, strict=True):
                        rows[name].append(value)
                number += 1
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"bucket": batch.column("bucket"), "n": pa.array([int(_wide(x.as_py()).sum()) for x in batch.column("counts")], pa.int64())})


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    training: which rows the model learns from. base_score: add-one unigram, in log10."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = max(parts(docs.sparkSession), -(-size // BUCKET_BYTES))
    contexts = restaurants(size)
    counts = stored(count(docs.filter(training), text, buckets, contexts))
    model = train(counts, contexts)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    made = blocks(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), buckets, contexts)
    arrow = pa.schema([("piece", pa.int64()), ("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("lengths", "known", "base", "score"))])

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        m = sent.value
        predictor = Predictor(next(iter(right.to_pylist()), None), m)
        rows = {x: [] for x in arrow.names}
        floor = np.log10(m["tokens"] + m["types"] + 1.0)
        for batch in left.to_batches(max_chunksize=16):
            for r in batch.to_pylist():
                words, sizes = np.frombuffer(r["words"], np.uint64), _wide(r["sizes"])
                at, which, row, times = _wide(r["contexts"]), np.repeat(np.arange(len(words)), sizes), _wide(r["rows"]), _wide(r["counts"])
                got, known = predictor.log10(words, which, at)
                n = int(row.max()) + 1 if len(row) else 0
                base = np.log10(known + 1.0) - floor
                values = (r["piece"], r["ids"], r["lengths"], _bytes(np.bincount(row, times * (known > 0)[which], n), np.uint32), np.bincount(row, times * base[which], n).tobytes(), np.bincount(row, times * got, n).tobytes())
                for name, value in zip(arrow.names, values, strict=True):
                    rows[name].append(value)
        return pa.table(rows, schema=arrow)

    def add_up(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        whole = next(r for r in rows if r["lengths"] is not None)
        lengths = np.frombuffer(whole["lengths"], np.uint32)
        out = [np.zeros(len(lengths)) for _ in range(3)]
        for r in sorted(rows, key=lambda r: (len(r["score"]), r["score"])):
            for total, value in zip(out, (np.frombuffer(r["known"], np.uint32), np.frombuffer(r["base"]), np.frombuffer(r["score"])), strict=True):
                total[: len(value)] += value
        return pa.table({"id": pa.array(whole["ids"], pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "n_known": pa.array(out[0].astype(np.int64)), "base_score": pa.array(out[1]), "score": pa.array(out[2])})

    # a bucket with more than its share of all tokens, as common words make it, is scored in several parts
    tokens_in = counts.mapInArrow(_sizes, "bucket int, n bigint")
    share = max(1, model["tokens"] // buckets)
    # written, so that its few rows have their true size when Spark chooses the join
    salts = stored(tokens_in.select("bucket", F.ceil(F.col("n") / (2 * share)).cast("int").alias("salts")).filter("salts > 1"))
    dealt = made.join(salts, "bucket", "left").withColumn("salt", F.pmod(F.xxhash64("piece"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = counts.join(salts, "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    sums = dealt.groupBy("bucket", "salt").cogroup(copies.groupBy("bucket", "salt")).applyInArrow(look_up, SUM_SCHEMA)
    done = sums.groupBy("piece").applyInArrow(add_up, "id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return done.select(F.col("id").alias(key), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
