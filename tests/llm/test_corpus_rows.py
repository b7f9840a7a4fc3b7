"""Packing, resampling and collocations against plain Python, with odd rows in every table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from driftlens.llm import collocations, packing, queries, resampling, spans

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "One"), (9005, "one two"), (9006, "word " * 3000), (None, "no id here, at all. " * 5), (9007, "x" * 9000), (9008, "İSTANBUL ΣΑΣ it's <|endoftext|> 日本語 😀 " * 40)]


def prose(seed, n, words=60, longest=150):
    r = random.Random(seed)
    lexicon = ["".join(r.choice("aeioustnrlé") for _ in range(r.randint(1, 8))) for _ in range(words)]
    pick = lambda: r.choice(lexicon[: r.randint(1, words)])
    return ["".join(pick() + r.choice([" ", " ", " ", " ", ", ", ". ", "\n", "\t", " - "]) for _ in range(r.randint(1, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    rows = list(enumerate(prose(1, 90)))
    return rows + [(500 + i, rows[5][1]) for i in range(25)] + [(3, rows[3][1]), (3, "another text of the id three")] + ODD


@pytest.fixture(scope="module")
def frame(spark, docs):
    # columns whose names the operators use themselves
    return spark.createDataFrame([(i, t, "a", 1.5, 7) for i, t in docs], "doc_id long, text string, score string, rank double, length long").repartition(5)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_packing_equals_the_library_and_fills_sequences(spark, frame, docs):
    from tokenizers import Tokenizer

    path = queries.byte_tokenizer_path()
    own = Tokenizer.from_file(path)
    got = rows_of(packing.pack(frame, path, ids=True))
    want = Counter()
    for i, t in docs:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        head = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 1024) + 1
    assert packing.pack(frame.limit(0), path).count() == 0


def test_long_texts_are_encoded_in_parts(monkeypatch):
    own = packing.encoding(queries.byte_tokenizer_path())
    text = "  Some   words, don't 12 \n\n and　more\x1c <|endoftext|> ééé " * 30
    whole = packing.encode(own, text).tolist()
    for size in (1, 7, 50):
        monkeypatch.setattr(packing, "AT_ONCE", size)
        assert packing.encode(own, text).tolist() == whole


@pytest.mark.parametrize("measure", ["norm", "dot"])
@pytest.mark.parametrize(("documents", "cost"), [(None, None), (3, None), (6, 500_000), (None, 1_100_000)])
def test_plan_keeps_every_capacity(measure, documents, cost):
    r = random.Random(4)
    histogram = Counter(min(1024 if cost is None or cost > 2**20 else 700, max(1, int(r.lognormvariate(5, 1.3)))) for _ in range(4000))
    bins, seen = defaultdict(list), Counter()
    for length, first, stop, bin_, each, at in packing.plan(histogram, 1024, documents, cost, measure=measure):
        assert first == seen[length]
        seen[length] = stop
        for k in range(stop - first):
            bins[bin_ + k // each].append((at + k % each * length, length))
    assert seen == histogram
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= 1024
        assert documents is None or len(held) <= documents
        assert cost is None or sum(n * n for _, n in held) <= cost
    with pytest.raises(ValueError, match="fits into no"):
        packing.plan({800: 1}, 1024, None, 600_000)


def test_a_plan_follows_best_fit_piece_by_piece():
    # where each class step is one piece, the plan is plain best-fit decreasing
    r = random.Random(8)
    lengths = sorted(r.sample(range(1, 1025), 300), reverse=True)
    left = []
    for n in lengths:
        fit = [(x - n, i) for i, x in enumerate(left) if x >= n]
        if fit:
            left[min(fit)[1]] -= n
        else:
            left.append(1024 - n)
    made = packing.plan(dict.fromkeys(lengths, 1), weights=(1.0, 0.0, 0.0))
    assert len({row[3] for row in made}) == len(left)


WORDS12 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    ws = WORDS12.findall((text or "").translate(LOWER))
    return ws, [zlib.crc32(x.encode()) % 10000 for x in ws + [" ".join(p) for p in zip(ws, ws[1:])]]


def test_resampling_equals_brute_force(spark, frame, docs):
    target = prose(1, 12) + [None, "", "Unseen words here"]
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    want = []
    for i, x in docs:
        ws, fs = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(ws), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is None, w[0]))
    drawn = able[: 25 * len(able) // 100]
    got = rows_of(resampling.resample(frame, spark.createDataFrame([(x,) for x in target], "text string")))
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(map(tuple, want))
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [(r["rank"], r["doc_id"], r["score"]) for r in ranked] == [(k + 1, w[0], w[4]) for k, w in enumerate(drawn)]
    assert resampling.resample(frame.limit(0), frame.limit(0)).count() == 0
    rows = resampling.drawn_rows(frame, spark.createDataFrame([(x,) for x in target], "text string"))
    assert rows.columns == frame.columns and {r["doc_id"] for r in rows.collect()} == {w[0] for w in drawn}


@pytest.mark.parametrize("size", [4 << 20, 700, 64])
def test_run_crcs_come_from_two_prefixes(docs, size):
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in docs])})
    got, words = defaultdict(Counter), Counter()
    for part in spans.stretches(batch, "text", resampling.SOLID, 2, size):
        crcs, row, new = resampling.feature_crcs(part, 3)
        for i, n in enumerate(new.tolist()):
            words[part.first + i] += n
        for c, i in zip(crcs.tolist(), row.tolist(), strict=True):
            got[part.first + i][c] += 1
    for i, (_, t) in enumerate(docs):
        ws = WORDS12.findall((t or "").translate(LOWER))
        assert words[i] == len(ws)
        assert got[i] == Counter(zlib.crc32(" ".join(ws[a : a + k]).encode()) for k in (1, 2, 3) for a in range(len(ws) - k + 1))


def phrases(rows, least, share, most):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in (1, 2, 3):
                count[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in count.items():
        able = {p for p, n in f.items() if len(p) > 1 and n >= least}
        scored = []
        for p in able:
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * f[q] >= share * f[p] for q in able):
                continue
            s, _, l, r = min((10**6 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-s, -f[p], " ".join(p), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2].encode()))[:most]):
            out.append((lang, i + 1, p, -a, l, r, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("least", "most", "parts"), [(10, 2000, 4), (2, 40, 7)])
def test_collocations_equal_brute_force(spark, monkeypatch, docs, least, most, parts):
    langs = ["en", "en", "fr", None]
    rows = [(langs[k % 4], t) for k, (_, t) in enumerate(docs)]
    frame = spark.createDataFrame([(a, t, "x", 1) for a, t in rows], "lang string, text string, phrase string, n long").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # phrases of one word lie in many batches
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = collocations.collocations(frame, least=least, most=most).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == phrases(rows, least, 50, most)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_scores_beyond_64_bits_are_exact():
    r = random.Random(5)
    a = [r.randrange(1, 10 ** r.randint(1, 12)) for _ in range(500)]
    left, right = [x + r.randrange(10**r.randint(1, 12)) for x in a], [x + r.randrange(10 ** r.randint(1, 12)) for x in a]
    assert collocations._scores(*(np.array(x, np.int64) for x in (a, left, right))).tolist() == [10**6 * x * x // (y * z) for x, y, z in zip(a, left, right)]
