"""Operators against brute force, exact round trips and held-out accuracy, with odd rows in every table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftlens.llm import ann, bpe, language_model, line_dedup, media, mixing, ngram_join, queries, repeats, toxicity, warc
from driftlens.llm.common import crc_mod
from driftlens.operators import graph

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "One"), (9005, "one"), (9006, "word " * 3000), (None, "no id here at all"), (9007, "x" * 4000)]


def prose(seed, n, words=400):
    r = random.Random(seed)
    lexicon = ["".join(r.choice("aeioustnrl") for _ in range(r.randint(1, 8))) for _ in range(words)]
    return [" ".join(r.choice(lexicon) for _ in range(r.randint(1, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    r = random.Random(3)
    rows = list(enumerate(prose(1, 80)))
    for i, t in list(rows):
        w = t.split()
        if len(w) > 30:
            for k in range(r.randint(0, 4)):
                v = list(w)
                for _ in range(r.randint(0, 4)):
                    v[r.randrange(len(v))] = "zz" + str(r.randrange(9))
                rows.append((100 + len(rows), " ".join(v)))
    rows += [(8000 + i, rows[5][1]) for i in range(30)]
    return rows + ODD


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, score string, n double").repartition(3)


def test_bpe_equals_the_library_and_comes_back(spark, frame, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own = Tokenizer.from_file(path)
    own.no_padding()
    own.no_truncation()
    extra = [(1, "İSTANBUL ΣΑΣ it's they'LL 12345 ½ é <|endoftext|>x 日本語 😀"), (2, "".join(random.Random(1).choice("abcdefgh") for _ in range(3000)))]
    got = bpe.encode_decode(frame.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")), path).collect()
    assert len(got) == len(docs) + 2
    for r in got:
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == own.decode(ids, skip_special_tokens=False)
    apart = bpe.decode(bpe.encode(frame, path), path, plain=True).filter("doc_id = 9004").first()
    assert apart["decoded"] == "one " and apart["score"] == "x"
    assert bpe.encode(frame.limit(0), path).count() == 0


def test_bpe_streams_in_bounded_memory():
    from tokenizers import Tokenizer

    encoder, decoder = bpe.ready(queries.tokenizer_path())
    own = Tokenizer.from_file(queries.tokenizer_path())
    own.no_truncation()
    for n in (1, 7, 41, 300, 9000, 40000):
        text = "".join(random.Random(n).choice("theinar") for _ in range(n))
        read = 0

        def letters(text=text):
            nonlocal read
            for at in range(0, len(text), 50):
                read = at
                yield text[at : at + 50]

        out = encoder.stream(letters())
        first = next(out)
        assert read <= 2 * encoder.m.lookahead + 50  # a stable token leaves before more is read
        assert [first, *out] == own.encode(text, add_special_tokens=False).ids
    pieces = list(decoder.text(encoder.encode("é" * 900), step=1))
    assert "".join(pieces).strip() == "é" * 900


def test_toxicity_finds_bent_insults(spark):
    clean = prose(7, 240)
    r = random.Random(5)
    rows, labels = [], []
    for i, t in enumerate(clean):
        toxic = i % 4 == 0
        w = t.split()
        if toxic:
            for insult in r.sample(["idiot", "moron", "stupid", "loser"], 3):
                w.insert(r.randrange(len(w) + 1), insult)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(7000, "you idxiot and m o r o n you stu-pid lo.ser"), *((i, t) for i, t in ODD if i)]
    labels += [(None, 1), (3, None), (5, 0), (5, 0)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.classify(docs, known).collect()}
    assert len(got) == len(rows)
    held = [x for i, x in got.items() if x["held_out"] and i < 240]
    truth = dict(labels[:240])
    assert np.mean([x["predicted"] == truth[x["doc_id"]] for x in held]) > 0.95
    assert got[7000]["predicted"] == 1 and got[9002]["predicted"] == 0 and 0 <= got[9001]["score"] <= 1
    assert toxicity.classify(docs, known.limit(0)).filter("predicted = 1").count() == 0


def test_kernel_equals_its_definition():
    from itertools import combinations

    def kernel(s, t):
        total = 0.0
        for a in combinations(range(len(s)), 3):
            for b in combinations(range(len(t)), 3):
                if all(s[x] == t[y] for x, y in zip(a, b)):
                    total += toxicity.DECAY ** (a[2] - a[0] + 1 + b[2] - b[0] + 1)
        return total

    words = ["idiot", "idxiot", "stupid", "aabba", "abc"]
    got = toxicity.features(words, toxicity.expand(words))
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            assert got[i, j] == pytest.approx(kernel(s, t) / np.sqrt(kernel(s, s) * kernel(t, t)))


def test_warc_audit_locates_damage(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "b" * (i % 50)) for i in range(600)] + [(None, None, None), (7, "http://h/7", "same"), (7, "http://h/7", "same")], "page_id long, url string, html string")
    first = warc.write_records(pages, 3).cache()
    assert warc.audit(first, first).count() == 0
    hurt = first.withColumn("digest", F.when(F.col("record_id") == 333, "0").otherwise(F.col("digest")))
    found = warc.audit(first, hurt).collect()
    assert [(r["record_id"], r["status"]) for r in found] == [(333, "corrupt")]
    lost = first.filter("NOT (file = 1 AND place = 150)")
    place = first.filter("file = 1 AND place = 150").first()
    assert {(r["file"], r["place"], r["status"], r["record_id"]) for r in warc.audit(first, lost).collect()} == {(1, 150, "missing", place["record_id"])}
    assert {r["status"] for r in warc.audit(first.filter("file <> 2"), first).collect()} == {"extra"}
    total = first.groupBy("file").agg(F.max(F.col("offset") + F.col("length")).alias("a"), F.sum("length").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in total)


def test_language_model(spark, frame, docs):
    train = crc_mod("doc_id", 7) != 2
    got = language_model.score(frame, train).collect()
    assert len(got) == len(docs)
    tokens = [(i, WORD.findall((t or "").translate(LOWER)) + ["\0"]) for i, t in docs]
    count = Counter(w for i, ws in tokens if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((i or -1, len(ws), sum(count[w] > 0 for w in ws), round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    again = language_model.score(frame.repartition(5), train).collect()
    assert sorted((r["doc_id"] or -1, round(r["score"], 8)) for r in got) == sorted((r["doc_id"] or -1, round(r["score"], 8)) for r in again)
    assert language_model.score(frame.limit(0), train).count() == 0
    assert language_model.score(frame, F.lit(False)).filter("score = 0").count() == len(docs)


def test_language_model_probabilities_sum_to_one(frame):
    counts = language_model.count(frame, "text", 1)
    model = language_model.train(counts)
    row = counts.first().asDict()
    p = language_model.Predictor(row, model)
    words = np.append(p.words, np.uint64(12345))
    for context in (0, 7, 200):
        got, _ = p.log10(words, np.arange(len(words)), np.full(len(words), context))
        assert (10**got).sum() == pytest.approx(1)


def test_seating_follows_the_restaurant():
    rng = np.random.default_rng(1)
    got = language_model.draw_tables(np.full(20000, 3), 0.5, np.full(20000, 1.0), rng)
    # second customer: 1 / 1.5; third: 1 / 2 after two tables, 1 / 2.5 after one
    assert got.mean() == pytest.approx(1 + 1 / 1.5 + (1 / 1.5) * (1 / 2.0) + (0.5 / 1.5) * (1 / 2.5), abs=0.02)
    assert language_model.draw_tables(np.array([10**6]), 0.5, np.array([1.0]), rng)[0] == pytest.approx(20, abs=12)


@pytest.mark.parametrize("write", [media.write_bmp, media.write_pgm])
def test_media_round_trip(write):
    image = np.arange(7 * 5, dtype=np.uint8).reshape(7, 5)
    assert (media.decode_image(write(image)) == image).all()


def test_media(spark, frame, docs):
    assert (media.read_netpbm(b"P3 # c\n2 1\n255\n1 2 3 4 5 6\n") == [[[1, 2, 3], [4, 5, 6]]]).all()
    assert (media.read_netpbm(b"P1\n3 1\n1 0 1") == [[0, 255, 0]]).all()
    colours = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (media.decode_image(media.write_bmp(colours)) == colours).all()
    assert media.decode_image(b"P5 garbage") is None and media.decode_image(None) is None
    image = np.arange(48, dtype=float).reshape(6, 8)
    assert np.allclose(media.area_resize(image, 3, 4), image.reshape(3, 2, 4, 2).mean((1, 3)))
    assert media.area_resize(image, 5, 3).mean() == pytest.approx(image.mean())
    got = media.read_media(media.store_payload(frame)).collect()
    assert len(got) == len(docs)
    for r in got:
        data = (r["text"] or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        assert bytes(r["payload"]) == padded and r["n_bytes"] == len(data) and len(r["feature"]) == 16 and r["score"] == "x"


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join_equals_brute_force(spark, docs):
    own = [(i, t) for i, t in docs if i is not None]
    r = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    for k in range(60):  # a dense group of near copies on both sides of the threshold
        v = list(base)
        for _ in range(r.randint(0, 3)):
            v[r.randrange(60)] = f"y{k}"
        own.append((500 + k, " ".join(v)))
    for k in range(2, 20):  # small sets
        own += [(600 + 2 * k, " ".join(f"s{j}" for j in range(k))), (601 + 2 * k, " ".join(f"s{j}" for j in range(k + 1)))]
    got = ngram_join.join(spark.createDataFrame([(*x, 1) for x in own], "doc_id long, text string, cls int")).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_components(own)
    kept = ngram_join.keep_one(spark.createDataFrame(own, "doc_id long, text string"))
    assert kept.count() == len({c for _, c in brute_components(own).values()})
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_judges_rows_by_their_own_text(spark):
    a, b = "one two three four five six seven", "other words that stand here and link with nothing at all"
    rows = [(1, a, 5), (7, a, 6), (7, b, 7), (None, a, 8), (9, None, 9), (None, None, 10)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, cls int"))
    assert sorted((r["cls"] for r in kept.collect())) == [5, 7, 8, 9, 10] and kept.columns == ["doc_id", "text", "cls"]


def test_ngram_join_tiles(spark, monkeypatch, docs):
    own = [(i, t) for i, t in docs if i is not None]
    monkeypatch.setattr(ngram_join, "TILE", 3)
    got = ngram_join.join(spark.createDataFrame(own, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: c for i, (_, c) in brute_components(own).items()}


def test_ngram_join_names_an_owner_once_a_run_and_sorts_in_slices(spark, monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh") + str(r.randrange(900)) for _ in range(n)) for n in [400] * 30 + [9000]]
    texts += [t.replace("a1", "b2") for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    told = lambda: {(x["gid"], x["cls"]): (x["size"], x["times"]) for x in ngram_join.groups(rows, "text", 8).collect()}
    want = told()
    assert want
    monkeypatch.setattr(ngram_join, "SORTED_ROWS", 50)
    assert told() == want
    kept = ngram_join.dealt(rows, "text", 8).select("bucket", *(F.octet_length(c).alias(c) for c in ("low", "high", "owners", "times"))).collect()
    n = sum(x["low"] for x in kept) / 4
    assert n == sum(len(ngram_join.signatures(s)) for s in (ngram_join.shingle_sets(pa.array([t]))[0] for t in texts))
    # 8 bytes of an owner for each fragment made 16
    assert sum(x["low"] + x["high"] + x["owners"] + x["times"] for x in kept) < 7 * n


def test_ngram_join_components_of_a_long_chain(spark):
    order = [int(x) for x in np.random.default_rng(4).permutation(500)]
    nodes = spark.createDataFrame([(i,) for i in order], "cls long")
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {(r["cls"], r["component"]) for r in graph.components(nodes, edges, "cls").collect()} == {(i, 0) for i in order}


def brute_repeats(docs):
    seen, out = {}, {}
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        d = (t or "").encode()
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - 99):
            if seen.setdefault(d[s : s + 100], (i, s)) != (i, s):
                gone[s : s + 100] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out[i] = (len(d), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(d, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("scanned", [48, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, docs, scanned):
    monkeypatch.setattr(repeats, "SCANNED", scanned)
    r = random.Random(5)
    base = ["".join(r.choice("abcdef \né") for _ in range(700)) for _ in range(4)]
    own = list(docs)
    for i in range(120):
        text = ""
        for _ in range(r.randint(0, 4)):
            b = r.choice(base)
            a = r.randint(0, 600)
            text += b[a : a + r.randint(20, 400)] if r.random() < 0.6 else "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 120)))
        own.append((2000 + i, text))
    got = repeats.dedup(spark.createDataFrame([(*x, 1) for x in own], "doc_id long, text string, kind int").repartition(3)).collect()
    have = {x["doc_id"]: (x["n_bytes"], sum(s["stop"] - s["start"] for s in x["spans"]), len(x["spans"]), bytes(x["kept"])) for x in got}
    assert have == brute_repeats(own)
    assert repeats.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", [None, 7])
def test_repeats_of_one_id_with_different_texts(spark, name):
    """What two texts of one id share goes from one of them; neither loses anything else, a copy loses nothing."""
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    shared, own, other = word(150), word(400), word(900)
    texts = [own[:200] + shared + own[200:], other[:600] + shared + other[600:]]
    rows = [(name, texts[0]), (name, texts[1]), (name, texts[1]), (9, shared)]
    got = [(x["doc_id"], bytes(x["kept"]).decode()) for x in repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    kept = sorted(t for i, t in got if i == name)
    assert dict(got)[9] == "" and len(got) == 4
    assert kept in (sorted([own, texts[1], texts[1]]), sorted([texts[0], other, other]))


def test_maximal_repeats_name_all_occurrences():
    texts = [b"xxHELLOWORLDaa", b"yxHELLOWORLDab", b"zzHELLOWORLDcc"]
    at = 5
    right = np.zeros((3, 16), np.uint8)
    left = np.zeros((3, 16), np.uint8)
    for i, t in enumerate(texts):
        right[i, : len(t) - at] = list(t[at:])
        left[i, :at] = list(t[:at][::-1])
    found = {(d, b, tuple(sorted(m.tolist()))) for d, b, m in repeats.maximal_repeats(right, np.full(3, 9), left, np.full(3, 5), 8)}
    assert (7, 3, (0, 1, 2)) in found and (8, 4, (0, 1)) in found


def nearest_by_brute_force(ids, matrix, q, k=10):
    dist = ann.distance(matrix, matrix[list(ids).index(q)])
    return [int(ids[i]) for i in np.lexsort((ids, dist)) if ids[i] != q][:k]


@pytest.mark.parametrize(("common", "size"), [(0.0, 1e22), (0.0, 1e200), (1e6, 1e-4)])
def test_ann_of_large_and_close_values(spark, common, size):
    x = common + np.random.default_rng(6).normal(size=(300, 8)) * size
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for g in sorted(ann.search(frame, frame.filter("vec_id % 100 = 0")).collect(), key=lambda g: g["rank"]):
        got.setdefault(g["query_id"], []).append(g["vec_id"])
    hits = [len(set(found) & set(nearest_by_brute_force(np.arange(300), x, q))) for q, found in got.items()]
    assert sorted(got) == [0, 100, 200] and sum(hits) >= 27


def test_ann_recall_on_the_embeddings(spark):
    """One shard of all 2,000 vectors: recall at 10 against brute force, and the share of nodes met."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter(ann.usable(F.col("embedding")))
    own = {r["vec_id"]: r["embedding"] for r in rows.collect()}
    ids, matrix = np.array(list(own)), np.array(list(own.values()), float)
    got = {}
    for g in ann.search(rows, rows.filter("vec_id % 100 = 0")).collect():
        got.setdefault(g["query_id"], set()).add(g["vec_id"])
    hits = sum(len(found & set(nearest_by_brute_force(ids, matrix, q))) for q, found in got.items())
    assert len(got) >= 15 and hits >= 0.9 * 10 * len(got)


def test_every_node_of_a_graph_is_reached():
    x = np.vstack([np.random.default_rng(1).normal(size=(40, 4)) + 1000 * i for i in range(12)])
    assert sorted(next(ann.Graph(x, degree=4, beam=8).nearest(x[:1], beam=len(x)))[1].tolist()) == list(range(len(x)))


def test_ann_recall_and_order(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[100].tolist()) for i in range(30)]
    rows += [(6000, None), (6001, [0.0] * 16), (6002, [float("nan")] * 16), (6003, [None] * 16), (6100, [1.0, 2.0]), (None, x[3].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    got = ann.search(frame, frame.filter("vec_id % 100 = 0"), shard=400).collect()
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and i not in (6000, 6001, 6002, 6003, 6100)}
    ids, matrix = np.array(list(good)), np.array(list(good.values()))
    hits = total = 0
    by = {}
    for g in got:
        by.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    assert set(by) == {i for i in good if i % 100 == 0}
    for q, found in by.items():
        dist = np.sqrt(((matrix - good[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, dist)) if ids[i] != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(ids[order].tolist()))
        total += 10
    assert hits / total >= 0.95
    assert ann.search(frame.limit(0), frame.limit(0)).count() == 0


def test_mixing_meets_targets(spark, frame):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), f"s{i % 7}" if i % 11 else None) for i in range(900)] + [(1000, None, "s1"), (1001, "", "tiny"), (1002, "a b", "tiny"), (5, "dup", "s0"), (5, "dup", "s0")]
    out = mixing.mix(spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, source string, size int")).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    want, free, left = {}, list(order), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
            free.remove(s)
    want |= {s: weight[s] * level for s in free}
    taken = Counter()
    for x in out:
        assert x["size"] == len((x["text"] or "").split()) and x["source_size"] == sizes[x["source"]]
        assert x["target"] == pytest.approx(want[x["source"]]) and 0 <= x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 130, (s, taken[s], want[s])
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert mixing.repeat(mixed).count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_mixing_solves_all_sources_in_one_job(spark):
    r = random.Random(8)
    cells = [(False, f"s{s}", size, float(r.randint(1, 5))) for s in range(6) for size in r.sample(range(1, 400), 50)]
    cells = [(m, s, size, n, size * sum(c[3] for c in cells if c[1] == s) / sum(c[2] * c[3] for c in cells if c[1] == s)) for m, s, size, n in cells]
    sizes = {s: sum(c[2] * c[3] for c in cells if c[1] == s) for s in {c[1] for c in cells}}
    share = {"s0": 0.0, "s1": 0.1, "s2": 0.7, "s3": 1.0, "s4": 2.9, "s5": 3.0}
    goals = [(False, s, float(sizes[s]), share[s] * sizes[s]) for s in sizes] + [(True, "", 0.0, 0.0)]
    tables = spark.createDataFrame(cells, "missing boolean, name string, size long, n double, z double"), spark.createDataFrame(goals, "missing boolean, name string, source_size double, target double")
    spark.sparkContext.setJobGroup("balance", "")
    made = mixing.balance(*tables)
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("balance"))
    spark.sparkContext.setJobGroup("other", "")
    lam = {x["name"]: x["lam"] for x in made.collect()}
    assert len(lam) == len(goals)
    for s, total in sizes.items():
        got = sum(n * size * (3.0 if lam[s] * z >= math.log(3.0) else math.exp(lam[s] * z)) for _, name, size, n, z in cells if name == s)
        assert got == pytest.approx(share[s] * total, rel=1e-8, abs=1e-8)


def test_mixing_and_lines_keep_clashing_names(spark):
    names = ["part", "offset", "name", "rank", "salt", "missing", "row", "sum", "n", "_lines", "_known", "_site", "_salt", "a.b"]
    rows = [(i, "w " * (i % 5 + 1) + "\nmenu", "s", *(f"{n}{i}" for n in names)) for i in range(12)]
    frame = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for out in (mixing.mix(frame), line_dedup.drop_site_lines(frame, "source", "text", ratio=0.5)):
        assert [c for c in out.columns if c in names] == names
        assert {r["doc_id"]: tuple(r[n] for n in names) for r in out.collect()} == {r[0]: r[3:] for r in rows}


def test_lines_by_site(spark):
    rows = [(i, "a", f"menu\nbody {i}\n menu \nlast{i % 3}") for i in range(10)] + [(i, None, f"menu {i % 2}\nx{i}") for i in range(20, 30)] + [(40, "b", "menu\nonly"), (41, "b", None), (42, "c", ""), (1, "a", "menu\nbody 1")]
    got = line_dedup.drop_site_lines(spark.createDataFrame([(*x, "k") for x in rows], "id long, site string, text string, n_lines string"), "site", "text", ratio=0.4).collect()
    assert len(got) == len(rows)
    kept = {(r["id"], r["n_lines"]): r["text"] for r in got}
    assert kept[(0, 4)] == "body 0\nlast0" and kept[(20, 2)] == "x20" and kept[(40, 2)] == "menu\nonly" and kept[(41, 0)] == ""
    assert line_dedup.drop_site_lines(spark.createDataFrame([], "id long, site string, text string"), "site", "text").count() == 0
    one = spark.createDataFrame([("HTTPS://Ex.com:80/x", "<p>a<br>b</p><script>x</script>")], "u string, h string").select(line_dedup.host(F.col("u")), F.array_join(line_dedup.lines(line_dedup.html_lines(F.col("h"))), "|")).first()
    assert tuple(one) == ("ex.com", "a|b")


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    base = prose(11, 60)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)] + [(100 + i, base[9], "en", "s0", 1) for i in range(3)] + [(200, None, None, None, None), (201, "", "en", "s1", 0)]
    rows = [(i, f"{t}\nsame footer line" if t and len(t) > 10 else t, la, s, n) for i, t, la, s, n in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "line_dedup":
            assert now.filter("text LIKE '%footer%'").count() == 0 and now.count() == len(rows)
        if name == "ngram_join":
            assert now.filter("doc_id BETWEEN 100 AND 104").count() == 0 and now.filter("doc_id IN (9, 200, 201)").count() == 3
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count() > 0


def test_pipeline_drops_a_line_of_a_tenth_of_a_source(spark):
    import corpus_pipeline

    # the planted line stands in 40 of 400, a line of prose in 18 (0.045); in a source of 50 one of prose in 5
    rows = [(i, "\n".join([f"own {i}"] + ["planted"] * (i % 10 == 0) + ["prose"] * (i < 18)), "big") for i in range(400)]
    rows += [(1000 + i, "\n".join([f"own {i}"] + ["prose"] * (i < 5)), "small") for i in range(50)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()}
    assert got == {i: t.replace("\nplanted", "") for i, t, _ in rows}


def test_digests(spark, frame):
    row = queries.bpe_digests(frame.filter("doc_id = 9004").select("doc_id", "text"), queries.tokenizer_path()).first()
    ids = bpe.ready(queries.tokenizer_path())[0].encode("One")
    assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
