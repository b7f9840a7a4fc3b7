"""Toxicity by a string-kernel support vector machine.

The kernel between two strings counts common subsequences of three letters, each weighted by
DECAY ** (letters spanned), gaps included, and is normalised. Nyström landmarks turn it into a finite
feature space in which a linear SVM (squared hinge) is fitted. As a subsequence of three letters is one
of 32 ** 3, the fitted combination of landmarks folds into one weight per subsequence, so that scoring
costs the same however many landmarks there are.

Strings are the units of a sentence: its words without marks and accents, common look-alike signs read
as letters, runs of single letters put together, and very long words in overlapping windows, so that
split, gapped and stuffed spellings stay close to the plain one. A document's score is a logistic
function of its two highest unit margins.

Null and empty texts have no units and get the score of a text without any suspicious unit; labels that
are null are ignored; repeated labels count repeatedly; without labelled documents of both classes
the score is the share of toxic labels (0 without any) and nothing is predicted toxic above it;
tables may be empty; input columns that the operator adds anew are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.llm.common import crc_mod, tidy
from driftlens.llm.hashing import pieces

DECAY, LETTERS, WINDOW = 0.6, 32, 16
#: Labelled documents to learn from, at most, of each class; the others are not read for fitting.
MAX_TOXIC, MAX_CLEAN = 4000, 8000
LANDMARKS, POSITIVES, NEGATIVES, HARD = 256, 800, 4000, 1500
#: Margin of a text without units.
LOWEST = -2.0
THRESHOLD = 0.7

# Letters with marks by their plain letter, and signs that stand for letters.
PLAIN = {"a": "àáâãäåæāą@4", "c": "çćč", "d": "ďđ", "e": "èéêëēęě3€", "g": "ğ", "i": "ìíîïīı1!|", "l": "ł", "n": "ñńň", "o": "òóôõöøōœ0", "r": "ř", "s": "śşšß5$", "t": "ţť7", "u": "ùúûüūůµ", "y": "ýÿ", "z": "źżž"}
FOLD = {ord(x): plain for plain, marked in PLAIN.items() for x in marked}
SPLIT_LETTERS = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
OTHER = re.compile(r"[^a-z]")
LETTER = re.compile(r"[^\W\d_]")


def plain(token: str) -> str:
    """A token's letters, lower case, without marks; empty if it has no letter of its own."""
    return OTHER.sub("", token.lower().translate(FOLD)) if LETTER.search(token) else ""


def units(text: str | None) -> set[str]:
    """The distinct raw units of a text: its tokens, and runs of single letters put together."""
    if not text:
        return set()
    found = set(text.split())
    found.update("".join(x.split()) for x in SPLIT_LETTERS.findall(text))
    return found


def windows(letters: str) -> list[str]:
    if len(letters) <= WINDOW:
        return [letters] if len(letters) >= 3 else []
    return [letters[i : i + WINDOW] for i in range(0, len(letters) - WINDOW // 2, WINDOW // 2)]


def _codes(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode(), np.uint8).reshape(len(strings), -1).astype(np.int64) - 97


def norms(codes: np.ndarray) -> np.ndarray:
    """Square root of each string's kernel with itself, by the usual recursion over prefixes."""
    n, size = codes.shape
    same = codes[:, :, None] == codes[:, None, :]
    before = np.ones((n, size + 1, size + 1))
    for _ in range(2):
        now = np.zeros_like(before)
        for i in range(1, size + 1):
            run = np.zeros(n)
            for j in range(1, size + 1):
                run = DECAY * run + np.where(same[:, i - 1, j - 1], DECAY * DECAY * before[:, i - 1, j - 1], 0.0)
                now[:, i, j] = DECAY * now[:, i - 1, j] + run
        before = now
    return np.sqrt(np.maximum((np.where(same, before[:, :-1, :-1], 0.0)).sum((1, 2)) * DECAY * DECAY, 1e-300))


def against(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over all subsequences of three letters of DECAY ** span times the row of `weights` for it."""
    n, size = codes.shape
    out = np.zeros((n, *weights.shape[1:]))
    for i in range(size - 2):
        for j in range(i + 1, size - 1):
            pair = (codes[:, i] * LETTERS + codes[:, j]) * LETTERS
            for k in range(j + 1, size):
                out += DECAY ** (k - i + 1) * weights[pair + codes[:, k]]
    return out


def by_length(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes) of the strings of each length."""
    sizes = np.array([len(s) for s in strings])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for part in np.array_split(at, -(-len(at) // 4096)):
            yield part, _codes([strings[i] for i in part])


def features(strings: list[str], weights: np.ndarray) -> np.ndarray:
    """Normalised kernel sums of each string against each column of `weights`."""
    out = np.zeros((len(strings), *weights.shape[1:]))
    for at, codes in by_length(strings):
        scale = norms(codes)
        out[at] = against(codes, weights) / (scale[:, None] if weights.ndim > 1 else scale)
    return out


def expand(strings: list[str]) -> np.ndarray:
    """Each string's normalised vector of subsequence weights, a column each."""
    out = np.zeros((LETTERS**3, len(strings)))
    for c, s in enumerate(strings):
        codes = _codes([s])
        size = codes.shape[1]
        for i in range(size - 2):
            for j in range(i + 1, size - 1):
                for k in range(j + 1, size):
                    out[(codes[0, i] * LETTERS + codes[0, j]) * LETTERS + codes[0, k], c] += DECAY ** (k - i + 1)
        out[:, c] /= norms(codes)[0]
    return out


def fit_svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 30.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps on the rows inside the margin."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-6

    def loss(v: np.ndarray) -> float:
        return v @ keep @ v / 2 + cost * (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()

    for _ in range(steps):
        inside = np.flatnonzero(y * (x @ w) < 1)
        xi = x[inside]
        slope = keep @ w - 2 * cost * xi.T @ (weight[inside] * (y[inside] - xi @ w))
        step = np.linalg.solve(keep + 2 * cost * (xi.T * weight[inside]) @ xi, slope)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(slope).max() < 1e-8 * len(x):
            break
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-12)) @ x + keep, x.T @ (p - y) + keep @ w)
        w = w - step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    """weights: one a subsequence; bias: of the margin; link: logistic weights of the two highest margins."""

    weights: np.ndarray | None
    bias: float = 0.0
    link: np.ndarray | None = None
    share: float = 0.0

    def margins(self, raw: list[str]) -> list[float]:
        """The highest margin among each unit's windows."""
        parts = [windows(plain(u)) for u in raw]
        flat = [s for p in parts for s in p]
        got = features(flat, self.weights) + self.bias if flat else np.zeros(0)
        out, at = [], 0
        for p in parts:
            out.append(float(max(LOWEST, got[at : at + len(p)].max())) if p else LOWEST)
            at += len(p)
        return out


class Scorer:
    """Scores texts; holds a bounded store of unit margins."""

    def __init__(self, model: Model, store: int = 150_000):
        self.model, self.store, self.known = model, store, {}

    def top(self, texts: list[str | None]) -> np.ndarray:
        """The two highest unit margins of each text."""
        found = [units(t) for t in texts]
        out = np.full((len(texts), 2), LOWEST)
        known = self.known
        new = list({u for f in found for u in f if u not in known})
        if len(known) + len(new) > self.store:
            known.clear()
            new = list({u for f in found for u in f})
        known.update(zip(new, self.model.margins(new), strict=True))
        for i, f in enumerate(found):
            if f:
                best = sorted(map(known.__getitem__, f))[-2:]
                out[i, : len(best)] = best[::-1]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model.weights is None or self.model.link is None:
            return np.full(len(texts), self.model.share)
        top = self.top(texts)
        return 1 / (1 + np.exp(-np.clip(top @ self.model.link[:2] + self.model.link[2], -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(text, label) of the labelled rows to learn from: of each class those of least hash, up to the bounds."""
    picked = None
    for value, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        own = labels.filter(F.col(label) == value).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).distinct().orderBy(F.xxhash64(F.lit(11), F.col("_key")), "_key").limit(most)
        picked = own if picked is None else picked.unionByName(own)
    # at most MAX_TOXIC + MAX_CLEAN rows of two numbers
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), "_key").select("_text", "_label")


def _unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, toxic, clean): documents of each class that hold a plain unit."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, "_text", 1 << 20)):
            count: dict[str, list[int]] = {}
            for t, y in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist(), strict=True):
                for u in {w for x in units(t) for w in windows(plain(x))}:
                    count.setdefault(u, [0, 0])[1 - y] += 1
            yield pa.RecordBatch.from_pydict({"unit": pa.array(list(count), pa.string()), "toxic": pa.array([c[0] for c in count.values()], pa.int64()), "clean": pa.array([c[1] for c in count.values()], pa.int64())})

    return sample.mapInArrow(run, "unit string, toxic bigint, clean bigint").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _spread(strings: list[str], n: int) -> list[str]:
    return strings if len(strings) <= n else [strings[int(i * len(strings) / n)] for i in range(n)]


def _machine(positive: list[str], negative: list[str], strength: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias from units of both classes."""
    first, rest = positive[: LANDMARKS // 4], positive[LANDMARKS // 4 :]
    marks = first + _spread(rest, LANDMARKS // 4) + _spread(negative, LANDMARKS // 2)
    base = expand(marks)
    values, vectors = np.linalg.eigh(base.T @ base)
    use = values > 1e-8 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])
    z = features(positive + negative, base) @ root
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    weight = np.concatenate([strength / strength.sum(), np.full(len(negative), 1 / len(negative))]) * 100
    w, b = fit_svm(z, y, weight)
    return base @ (root @ w), b


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of labelled texts. What reaches the driver is bounded by the constants above."""
    spark = docs.sparkSession
    share = labels.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    sample = _sample(docs, labels, key, text, label).persist()
    try:
        sizes = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
        if not sizes.get(1) or not sizes.get(0):
            return Model(None, share=share)
        counts = _unit_counts(sample).persist()
        # units of toxic documents, by how far their count there exceeds what clean ones lead to expect
        rate = sizes[1] / sizes[0]
        excess = (F.col("toxic") - F.col("clean") * rate) / F.sqrt(F.col("toxic") + F.col("clean") * rate + 1)
        # so many toxic documents and no clean one come about by chance once in ten thousand units
        least = max(2, math.ceil(math.log(1e-4) / math.log(sizes[1] / (sizes[0] + sizes[1]))))
        rows = []
        while len(rows) < 5 and least > 0:
            rows = counts.filter(F.col("toxic") >= least).filter(F.col("toxic") > 10 * rate * F.col("clean")).orderBy(excess.desc(), "unit").limit(POSITIVES).collect()
            least -= 1
        if not rows:
            return Model(None, share=share)
        # a unit of few documents may be there by chance: the count tells how much it weighs
        positive, strength = [r["unit"] for r in rows], np.array([float(r["toxic"]) for r in rows])
        order = F.xxhash64(F.lit(5), F.col("unit"))
        negative = [r["unit"] for r in counts.filter("clean > 0 AND toxic <= clean").orderBy(order, "unit").limit(NEGATIVES).collect()]
        if not negative:
            return Model(None, share=share)
        weights, bias = _machine(positive, negative, strength)
        for _ in range(2):  # add the clean units that look most toxic, fit again
            rough = spark.sparkContext.broadcast(Model(weights, bias))

            @tidy
            def margins(batches: Iterator[pa.RecordBatch], rough=rough) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    u = batch.column("unit").to_pylist()
                    yield pa.RecordBatch.from_pydict({"unit": batch.column("unit"), "margin": pa.array(rough.value.margins(u), pa.float64())})

            clean = counts.filter("clean > 0 AND toxic <= clean").select("unit").mapInArrow(margins, "unit string, margin double")
            hard = [r["unit"] for r in clean.orderBy(F.desc("margin"), "unit").limit(HARD).collect()]
            seen = set(negative)
            negative = negative + [u for u in hard if u not in seen]
            weights, bias = _machine(positive, negative, strength)
        model = Model(weights, bias, share=share)
        sent = spark.sparkContext.broadcast(model)

        @tidy
        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(sent.value)
            for batch in (part for whole in batches for part in pieces(whole, "_text", 1 << 20)):
                top = scorer.top(batch.column("_text").to_pylist())
                yield pa.RecordBatch.from_pydict({"a": pa.array(top[:, 0]), "b": pa.array(top[:, 1]), "y": batch.column("_label")})

        got = np.array([tuple(r) for r in sample.mapInArrow(tops, "a double, b double, y int").collect()], float)
        model.link = fit_logistic(got[:, :2], got[:, 2])
        counts.unpersist()
        return model
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the toxicity of each whole text, 0 to 1, in `into`."""
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != into), T.StructField(into, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in pieces(batch, text, 1 << 20):
                got = pa.array(scorer.score(part.column(text).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_pydict({f.name: got if f.name == into else part.column(f.name) for f in schema.fields})

    return docs.mapInArrow(run, schema)


def training_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The labels that may be learned from; the others are held out."""
    return labels.filter(crc_mod(key, 3) != 1)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with held_out, score and predicted, from a model of the labels not held out."""
    model = fit(docs, training_labels(labels, key), key, text)
    scored = score(docs, model, text)
    return scored.withColumns({"held_out": crc_mod(key, 3) == 1, "predicted": (F.col("score") >= THRESHOLD).cast("int")})
