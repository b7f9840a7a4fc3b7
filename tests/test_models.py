"""Fits, cross-fitting, policies and resampling against plain NumPy and Python."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftlens.operators import boosting, contracts, crossfit, encoding, intervals, linear, resampling, sparse

X = ["a", "b", "c"]


def table(seed=1, n=200, groups=("g", "h")):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = r.normal(1e4, 3), r.integers(0, 4), r.exponential()
        y = 0.3 * (a - 1e4) + (b == 2) * 1.5 - 0.2 * c + r.normal(0, 0.3)
        rows.append((groups[i % len(groups)], i, float(a), float(b), float(c), float(y), float(r.random() + 0.5), int(y > 0.4)))
    return pd.DataFrame(rows, columns=["grp", "row", "a", "b", "c", "y", "w", "label"])


@pytest.fixture(scope="module")
def data():
    return table()


@pytest.fixture(scope="module")
def frame(spark, data):
    odd = [("g", 900, None, 1.0, 1.0, 1.0, 1.0, 1), ("g", 901, float("nan"), 1.0, 1.0, 1.0, 1.0, 0), ("g", 902, 1.0, 1.0, 1.0, None, 1.0, None), ("none", 903, 1.0, 2.0, 3.0, None, 1.0, None)]
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in data.itertuples(index=False)] + odd
    return spark.createDataFrame(rows, "grp string, row int, a double, b double, c double, y double, w double, label int").repartition(5)


def fitted(df):
    return {r["grp"]: (np.array(r["_coef"]), r["_intercept"]) for r in df.collect()}


def test_weighted_ridge_equals_the_closed_form(data, frame):
    made = fitted(linear.ridge(frame, ["grp"], X, "y", 10.0, "w"))
    assert set(made) == {"g", "h"}
    for g, own in data.groupby("grp"):
        x, y, w = own[X].to_numpy(), own["y"].to_numpy(), own["w"].to_numpy()
        w = w / w.mean()
        z = (x - x.mean(0)) / x.std(0)
        zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
        coef = np.linalg.solve((zc * w[:, None]).T @ zc + 10 * np.eye(3), (zc * w[:, None]).T @ yc) / x.std(0)
        assert np.allclose(made[g][0], coef, rtol=1e-9)
        assert math.isclose(made[g][1], np.average(y, weights=w) - coef @ np.average(x, axis=0, weights=w), rel_tol=1e-9)
    odd = {r["row"]: r["predicted"] for r in linear.predict(frame, linear.ridge(frame, ["grp"], X, "y"), ["grp"], X).filter("row >= 900").collect()}
    assert odd[900] is None and odd[901] is None and odd[902] is not None and odd[903] is None


def test_moments_are_handed_on_and_merged(frame, data, monkeypatch):
    whole = {r["grp"]: np.array(r["_scatter"]) for r in linear.moments(frame, ["grp"], X, "y").collect()}
    monkeypatch.setattr(linear, "HELD", 1)
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = {r["grp"]: np.array(r["_scatter"]) for r in linear.moments(frame, ["grp"], X, "y").collect()}
    finally:
        frame.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in ("g", "h"):
        own = data[data["grp"] == g][[*X, "y"]].to_numpy()
        assert np.allclose(whole[g].reshape(4, 4), (own - own.mean(0)).T @ (own - own.mean(0)))
        assert np.allclose(whole[g], parts[g])


def test_elastic_net_meets_its_conditions(data, frame):
    alpha, l1 = 0.05, 0.2
    made = fitted(linear.elastic_net(frame, ["grp"], X, "y", alpha, l1))
    for g, own in data.groupby("grp"):
        x, y = own[X].to_numpy(), own["y"].to_numpy()
        z, w = (x - x.mean(0)) / x.std(0), made[g][0] * x.std(0)
        slope = z.T @ (y - y.mean() - z @ w) / len(y) - alpha * (1 - l1) * w
        assert np.allclose(slope[w != 0], alpha * l1 * np.sign(w[w != 0]), atol=1e-8)
        assert (np.abs(slope[w == 0]) <= alpha * l1 + 1e-8).all()


def test_logistic_steps_equal_numpy(data, frame):
    got = {r["grp"]: r for r in linear.logistic(frame, ["grp"], X, "label").collect()}
    for g, own in data.groupby("grp"):
        x, y = own[X].to_numpy(), own["label"].to_numpy()
        z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
        s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        w, penalty = np.zeros(4), np.array([1, 1, 1, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            w = w - np.linalg.solve((z * (s * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (s * (p - y)) + penalty * w)
        assert np.allclose(got[g]["_scaled"], w[:3], rtol=1e-6)
        assert math.isclose(got[g]["_intercept"], w[3] - (w[:3] / x.std(0)) @ x.mean(0), rel_tol=1e-6)
    assert linear.logistic(frame.filter("label = 1"), ["grp"], X, "label").count() == 0


def test_geometry_equals_numpy(spark):
    r = np.random.default_rng(3)
    m = r.normal(size=(60, 5)) @ r.normal(size=(5, 5)) + 100
    rows = [("g", *map(float, v)) for v in m] + [("h", *map(float, v[:4]), 2.0) for v in m]
    got = {x["grp"]: x for x in linear.geometry(spark.createDataFrame(rows, "grp string, a double, b double, c double, d double, e double"), ["grp"], list("abcde")).collect()}
    for g, x in (("g", m), ("h", m[:, :4])):
        values = np.linalg.eigvalsh(np.corrcoef(x.T))[::-1]
        share = values / values.sum()
        for t, name in ((0.8, "pcs_80pct"), (0.9, "pcs_90pct"), (0.95, "pcs_95pct")):
            assert got[g][name] == np.searchsorted(np.cumsum(share), t) + 1
        assert math.isclose(got[g]["effective_rank"], np.exp(-(share * np.log(share + 1e-15)).sum()), rel_tol=1e-9)


def test_additive_ridge_equals_the_dense_form(spark):
    r = random.Random(2)
    rows = []
    for g in ("g", "h"):
        for i in range(120):
            places = sorted(r.sample(range(1, 9), r.choice([1, 1, 2])))
            code = "/".join("ACDEFGHIK"[p] + str(p) + r.choice("LMNP") for p in places)
            rows.append((g, code, r.gauss(5, 1), "test" if i % 4 == 0 else "train"))
    rows += [("g", "A99C", 1.0, "test"), ("g", "bad", 1.0, "test"), ("g", "A1C", float("nan"), "train"), ("z", "A1C", 1.0, "test")]
    made = sparse.additive_ridge(spark.createDataFrame(rows, "grp string, code string, observed double, role string"), ["grp"]).collect()
    got = defaultdict(list)
    for x in made:
        got[x["grp"], x["code"]].append(x["predicted"])

    def parts(code):
        out = set()
        for m in code.split("/"):
            if len(m) >= 3 and m[1:-1].isdigit():
                out |= {f"position={m[1:-1]}", f"substitution={m[0]}>{m[-1]}", f"mutation={m}"}
        return out

    for g in ("g", "h"):
        train = [(c, y) for k, c, y, role in rows if k == g and role == "train" and not math.isnan(y)]
        names = sorted(set().union(*(parts(c) for c, _ in train)))
        x = np.array([[n in parts(c) for n in names] for c, _ in train], float)
        y = np.array([v for _, v in train])
        w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + 20 * np.eye(len(names)), (x - x.mean(0)).T @ (y - y.mean()))
        for k, c, _, role in rows:
            if k == g and role == "test":
                want = y.mean() + (np.array([n in parts(c) for n in names], float) - x.mean(0)) @ w
                assert all(math.isclose(v, want, rel_tol=1e-6) for v in got[g, c])
    assert got["z", "A1C"] == [None]
    assert len(made) == sum(role == "test" for *_, role in rows)


def twin(x, y, w, loss, rounds, rate, leaves, least, l2, bins, depth):
    """Boosting on one group in plain Python, with rank-based edges and level-wise growth pruned best-first."""
    n, p = x.shape
    edges = []
    for j in range(p):
        s = np.sort(x[:, j])
        edges.append(sorted({s[max(0, math.ceil(i / bins * n) - 1)] for i in range(1, bins)}))
    b = np.array([[sum(v > e for e in edges[j]) for j, v in enumerate(row)] for row in x])
    w = w / w.mean()
    base = np.median(y) if loss == "absolute" else (w @ y) / w.sum() if loss == "squared" else math.log((w @ y) / w.sum() / (1 - (w @ y) / w.sum()))
    f = np.full(n, base)
    ensemble = []
    for _ in range(rounds):
        if loss == "squared":
            g, h = (f - y) * w, w
        elif loss == "absolute":
            g, h = np.sign(f - y) * w, w
        else:
            s = 1 / (1 + np.exp(-f))
            g, h = (s - y) * w, s * (1 - s) * w
        node, splits = np.zeros(n, int), {}
        for level in range(depth):
            for i in range(2**level - 1, 2 ** (level + 1) - 1):
                at = node == i
                best = None
                for j in range(p):
                    for k in sorted(set(b[at, j])):
                        left = at & (b[:, j] <= k)
                        right = at & ~left
                        if left.sum() < least or right.sum() < least:
                            continue
                        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
                        gain = round(part(left) + part(right) - part(at), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, j, k)
                if best:
                    splits[i] = best
                    node[at] = 2 * i + 1 + (b[at, best[1]] > best[2])
        if not splits:
            break
        tree, frontier = {}, {0}
        while len(tree) + 1 < leaves and any(i in splits for i in frontier):
            i = min((-splits[i][0], i) for i in frontier if i in splits)[1]
            tree[i], frontier = splits[i], (frontier - {i}) | {2 * i + 1, 2 * i + 2}

        def leaf(rows, tree=tree):
            at = np.zeros(len(rows), int)
            for i in sorted(tree):
                here = at == i
                at[here] = 2 * i + 1 + (rows[here, tree[i][1]] > tree[i][2])
            return at

        own = leaf(b)
        values = {i: rate * (np.median((y - f)[own == i]) if loss == "absolute" else -g[own == i].sum() / (h[own == i].sum() + l2)) for i in set(own.tolist())}
        f = f + np.array([values[i] for i in own])
        ensemble.append((leaf, values))
    return f if loss != "logistic" else 1 / (1 + np.exp(-f))


@pytest.mark.parametrize(("loss", "target", "weight", "keep"), [("squared", "y", "w", 2), ("absolute", "y", None, 10), ("logistic", "label", None, 10)])
def test_boosting_equals_its_twin(data, frame, loss, target, weight, keep):
    settings = {"rounds": 4, "rate": 0.3, "leaves": 5, "least": 7, "l2": 1.0, "bins": 16, "depth": 3}
    model = boosting.fit(frame.filter("row < 900"), ["grp"], X, target, weight, loss=loss, keep=keep, **settings)
    got = {r["row"]: r["predicted"] for r in boosting.predict(frame, model, ["grp"]).collect()}
    for _, own in data.groupby("grp"):
        w = own[weight].to_numpy() if weight else np.ones(len(own))
        want = twin(own[X].to_numpy(), own[target].to_numpy().astype(float), w, loss, **settings)
        assert np.allclose([got[r] for r in own["row"]], want, rtol=1e-9)
    assert got[900] is None and got[903] is None and len(got) == len(data) + 4
    with pytest.raises(ValueError, match="no weights"):
        boosting.fit(frame, ["grp"], X, "y", "w", loss="absolute")


def test_forests_equal_their_twin(spark, data):
    import hashlib

    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in data[["row", "a", "b", "c", "y", "w"]].itertuples(index=False)]
    df = spark.createDataFrame(rows, "row int, a double, b double, c double, y double, w double").repartition(3)
    settings = {"trees": 3, "share": 0.67, "least": 6, "depth": 3, "bins": 16}
    got = {r["row"]: r["predicted"] for r in boosting.forest(df, df, [], X, "y", "w", **settings).collect()}
    x, y, w = data[X].to_numpy(), data["y"].to_numpy(), data["w"].to_numpy() / data["w"].mean()
    edges = []
    for j in range(3):
        s = np.sort(x[:, j])
        edges.append(sorted({s[max(0, math.ceil(i / 16 * len(s)) - 1)] for i in range(1, 16)}))
    b = np.array([[sum(v > e for e in edges[j]) for j, v in enumerate(row)] for row in x])
    hit = lambda *v: int(hashlib.md5("|".join(map(str, (1, *v))).encode()).hexdigest()[:8], 16) / 2**32
    base = (w @ y) / w.sum()
    g = (base - y) * w
    total = np.zeros(len(y))
    for m in range(3):
        node, leaf = np.zeros(len(y), int), np.zeros(len(y))
        for level in range(3):
            for i in range(2**level - 1, 2 ** (level + 1) - 1):
                at, best = node == i, None
                if not at.any():
                    continue
                order = sorted(range(3), key=lambda j: (hit("feature", m, i, j), j))[:2]
                for j in sorted(order):
                    low, high = b[at, j].min(), b[at, j].max()
                    k = max(v for v in set(b[at, j]) if v <= low + hit("cut", m, i, j) * (high - low))
                    left = at & (b[:, j] <= k)
                    right = at & ~left
                    if left.sum() < 6 or right.sum() < 6:
                        continue
                    gain = round(g[left].sum() ** 2 / w[left].sum() + g[right].sum() ** 2 / w[right].sum() - g[at].sum() ** 2 / w[at].sum(), 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, j, k)
                if best:
                    node[at] = 2 * i + 1 + (b[at, best[1]] > best[2])
        for i in set(node.tolist()):
            at = node == i
            leaf[at] = -g[at].sum() / w[at].sum()
        total += base + leaf
    assert np.allclose([got[r] for r in data["row"]], total / 3, rtol=1e-9)


def test_encoding_learns_from_train_rows_only(spark):
    rows = [("t", 1.0, "x", "p"), ("t", 2.0, "y", "p"), ("t", None, "y", None), ("t", 9.0, "x", "q"), ("s", 1e9, "new", "z"), ("s", None, None, None), ("s", float("nan"), "x", "p")]
    df = spark.createDataFrame(rows, "role string, n double, k string, m string")
    state = encoding.fit(df.filter("role = 't'"), [], ["n"], ["k", "m"])
    kept = state.first()
    assert kept["medians"] == [2.0] and kept["modes"] == ["x", "p"] and kept["categories"] == [["x", "y"], ["p", "q"]]
    assert encoding.names(kept, ["n"], ["k", "m"]) == ["n", "k=x", "k=y", "m=p", "m=q"]
    got = {(r["n"] if r["n"] == r["n"] else "nan", r["k"]): r["features"] for r in encoding.apply(df, state, [], ["n"], ["k", "m"]).filter("role = 's'").collect()}
    assert got == {(1e9, "new"): [1e9, 0, 0, 0, 0], (None, None): [2.0, 1, 0, 1, 0], ("nan", "x"): [2.0, 1, 0, 1, 0]}
    values = np.array([1, 2, 2, 9.0])
    scaled = [r["features"][0] for r in encoding.apply(df, state, [], ["n"], ["k"], scale=True).filter("role = 't' AND n = 9").collect()]
    assert np.allclose(scaled, (9 - values.mean()) / values.std())


TASKS = crossfit.Columns(["f1", "f2"])


@pytest.fixture(scope="module")
def tasks(spark):
    r = random.Random(6)
    rows = []
    for t in range(60):
        for m in ("m1", "m2", "m3"):
            f1, f2 = r.gauss(0, 1), r.gauss(0, 1)
            rows.append((f"F{t % 12}", f"T{t:02d}", m, f1, f2, 0.4 * f1 + r.gauss(0.2 * (m == "m2"), 0.3), None if t % 9 == 0 else r.uniform(1, 50), float(r.randint(50, 900))))
    return spark.createDataFrame(rows, "family_id string, task_id string, model_id string, f1 double, f2 double, gain double, msa_neff double, protein_length double")


def test_no_group_is_in_the_fit_that_predicts_it(tasks, monkeypatch):
    seen = []
    keep = crossfit.estimate

    def watched(df, by, *args, **more):
        train = df.filter("role = 'train'").select(*by, "family_id").distinct()
        held = df.filter("role <> 'train'").select(*by, "family_id").distinct()
        seen.append(train.intersect(held).count())
        return keep(df, by, *args, **more)

    monkeypatch.setattr(crossfit, "estimate", watched)
    made = crossfit.out_of_group(tasks, [], TASKS, 4, "elastic_net", {})
    assert made.count() == 180 and made.filter("predicted IS NULL").isEmpty()
    small = ({"rounds": 2, "leaves": 3, "least": 5, "depth": 2}, {"rounds": 3, "rate": 0.2, "leaves": 3, "least": 5, "depth": 2})
    full = crossfit.cross_fit(tasks, TASKS, folds=3, inner=3, candidates=small, settings=small[0]).collect()
    assert seen and not any(seen)
    assert len(full) == 180 and all(r["predicted"] is not None and r["scale"] >= 1e-3 for r in full)
    assert sum(r["selected"] for r in full) == 60 and len({r["task_id"] for r in full if r["selected"]}) == 60
    assert all(r["selected"] and r["lower"] > 0 for r in full if r["trusted"])
    with pytest.raises(ValueError, match="fewer than"):
        crossfit.out_of_group(tasks.filter("family_id < 'F1'"), [], TASKS, 4, "elastic_net", {})


def test_search_takes_the_least_error(tasks):
    small = ({"rounds": 1, "rate": 0.01, "leaves": 2, "least": 5, "depth": 1}, {"rounds": 6, "rate": 0.3, "leaves": 4, "least": 5, "depth": 2})
    errors, made = crossfit.search(tasks, [], TASKS, small, 3)
    found = {r["candidate"]: r for r in errors.collect()}
    rows = made.toPandas()
    folds = {r["family_id"]: r["fold"] for r in crossfit.group_folds(tasks, [], "family_id", 3).collect()}
    for c, own in rows.groupby("candidate"):
        per = (own["gain"] - own["predicted"]).abs().groupby(own["family_id"]).mean()
        assert math.isclose(found[c]["error"], per.groupby(per.index.map(folds)).mean().mean(), rel_tol=1e-9)
    assert found[1]["chosen"] and not found[0]["chosen"]


def test_areas_count_copies(spark):
    r = random.Random(9)
    rows = [(g, i, r.random(), r.gauss(0, 1), r.randint(0, 3)) for g in "xy" for i in range(17)]
    got = {x["g"]: x["v"] for x in crossfit.areas(spark.createDataFrame(rows, "g string, i int, s double, v double, n int"), ["g"], [F.desc("s"), F.col("i")], {"v": F.col("v")}, F.col("n")).collect()}
    for g in "xy":
        copies = [v for _, i, s, v, n in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1])) for _ in range(n)]
        means = [np.mean(copies[: max(1, math.ceil(len(copies) * (k / 10)))]) for k in range(1, 11)]
        assert math.isclose(got[g], sum((a + b) / 20 for a, b in itertools.pairwise(means)), rel_tol=1e-9)


def test_policy_search_equals_plain_python(tasks):
    made = crossfit.out_of_group(tasks, [], TASKS, 4, "elastic_net", {}).cache()
    rows = made.toPandas()
    got = {(r["shrinkage"], r["margin"]): r for r in crossfit.policy_search(made, [], TASKS).collect()}
    keys = {}
    for lam, margin in itertools.product(crossfit.SHRINKAGE, crossfit.MARGINS):
        taken = []
        for t, own in rows.sort_values("model_id").groupby("task_id"):
            d = lam * own["predicted"] + (1 - lam) * own["prior"]
            top, base = d.idxmax(), own.index[own["model_id"] == own["baseline"]][0]
            at = top if d[top] - d[base] > margin else base
            neff = rows["msa_neff"][at]
            taken.append([t, d[at], own["gain"].max() - rows["gain"][at], math.log1p(neff) if neff == neff and neff is not None else math.nan, math.log1p(rows["protein_length"][at])])
        v = pd.DataFrame(taken, columns=["t", "d", "regret", "neff", "length"])
        z = {c: ((v[c].fillna(v[c].mean())) - v[c].mean()) / v[c].std(ddof=0) for c in ("d", "neff", "length")}
        v["sure"] = (z["neff"] + 0.5 * z["length"] + 0.25 * z["d"]).round(9)
        v = v.sort_values(["sure", "t"], ascending=[False, True])
        means = [v["regret"].iloc[: math.ceil(len(v) * (k / 10))].mean() for k in range(1, 11)]
        keys[lam, margin] = (round(sum((a + b) / 20 for a, b in itertools.pairwise(means)), 9), round(v["regret"].mean(), 9), -margin, -lam)
        assert math.isclose(got[lam, margin]["regret_area"], keys[lam, margin][0], abs_tol=1e-8)
        assert math.isclose(got[lam, margin]["mean_regret"], keys[lam, margin][1], abs_tol=1e-8)
    assert [k for k, r in got.items() if r["chosen"]] == [min(keys, key=keys.get)]


def test_abstention_scores(spark):
    r = random.Random(11)
    names = ["regret", "gain_meta", "gain_all", "gain_shape"]
    ref = [[round(r.gauss(0, 1), 1) for _ in names] for _ in range(40)]
    rows = [[round(r.gauss(0, 1), 1) for _ in names] for _ in range(25)]
    schema = ", ".join(f"{n} double" for n in names)
    got = crossfit.abstention_scores(spark.createDataFrame([(i, *v) for i, v in enumerate(rows)], "i int, " + schema), spark.createDataFrame(ref, schema), []).toPandas().sort_values("i")
    ref, rows = np.array(ref), np.array(rows)
    share = lambda j: np.array([(ref[:, j] <= v).mean() for v in rows[:, j]])
    safety = 1 - share(0)
    assert np.allclose(got["pure_regret"], safety)
    for j, n in enumerate(names[1:], 1):
        assert np.allclose(got[f"harm_{n}"], 2 * share(j) * safety / (share(j) + safety + 1e-12))
    z = lambda j: (rows[:, j] - ref[:, j].mean()) / ref[:, j].std()
    assert np.allclose(got["blend_1_5"], z(2) - 1.5 * z(0))
    with pytest.raises(Exception, match="empty reference"):
        crossfit.abstention_scores(spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0)], "i int, " + schema), spark.createDataFrame([], schema), []).collect()


def test_nested_draws_keep_their_numbers(spark):
    rows = [(f"F{i % 3}", f"P{i % 7}", f"A{i}", f"T{i}") for i in range(40)]
    units = spark.createDataFrame(rows, "f string, p string, a string, t string").distinct()
    made = resampling.nested_times(units, ["f", "p", "a", "t"], 30).toPandas()
    # a family of many copies draws proteins for each: the tree of counts is consistent
    families = resampling.nested_times(units, ["f"], 30).toPandas()
    assert (families.groupby("_rep")["_times"].sum() == 3).all()
    two = resampling.nested_times(units, ["f", "p"], 30).toPandas()
    sizes = {f: len({p for g, p, *_ in rows if g == f}) for f in ("F0", "F1", "F2")}
    want = families.assign(n=families["_times"] * families["f"].map(sizes)).groupby("_rep")["n"].sum()
    assert (two.groupby("_rep")["_times"].sum() == want).all()
    assert set(map(tuple, made[["f", "p", "a", "t"]].to_numpy())) <= set(rows)
    assert made.groupby("_rep")["_times"].sum().std() > 0


def test_policy_difference(spark):
    r = random.Random(12)
    ours, other = [], []
    for i in range(30):
        key = (f"F{i % 5}", f"P{i % 10}", f"A{i % 15}", f"T{i}")
        ours.append((*key, r.gauss(0.3, 1), r.random(), r.random()))
        other.append((*key, r.gauss(0, 1), r.random() + 0.3, r.random()))
    schema = "f string, p string, a string, t string, gain double, regret double, confidence double"
    one, two = spark.createDataFrame(ours, schema), spark.createDataFrame(other, schema)
    got = {x["endpoint"]: x for x in resampling.policy_difference(one, two, ["f", "p", "a", "t"], repeats=40).collect()}

    def area(rows, value):
        v = [value(x) for x in sorted(rows, key=lambda x: (-x[6], x[3]))]
        means = [np.mean(v[: max(1, math.ceil(len(v) * (k / 10)))]) for k in range(1, 11)]
        return sum((a + b) / 20 for a, b in itertools.pairwise(means))

    assert math.isclose(got["regret_area"]["point"], area(other, lambda x: x[5]) - area(ours, lambda x: x[5]), rel_tol=1e-9)
    assert math.isclose(got["risk_area"]["point"], area(other, lambda x: x[4] <= 0) - area(ours, lambda x: x[4] <= 0), rel_tol=1e-9, abs_tol=1e-12)
    assert got["regret_area"]["lower"] < got["regret_area"]["point"] < got["regret_area"]["upper"] and 0 <= got["risk_area"]["above_zero"] <= 1
    with pytest.raises(Exception, match="same tasks"):
        resampling.policy_difference(one.filter("t <> 'T3'"), two, ["f", "p", "a", "t"], repeats=2).collect()


def test_intervals_leave_out_what_is_not_finite(spark):
    rows = [("t", "a", 1, 1.0, 0.0), ("t", "a", 2, float("nan"), 0.0), ("t", "b", 3, 3.0, None), ("t", "c", 4, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "task string, g string, item int, observed double, predicted double")
    assert intervals.group_max_radius(df, ["task"], "g").first()["radius"] == 2.0
    assert intervals.hierarchical_radius(df, ["task"], "g", "item", 0.6).first()["radius"] == 2.0
    with pytest.raises(Exception, match="above its upper"):
        intervals.interval_metrics(df.select("task", "observed", F.lit(2.0).alias("lo"), F.lit(1.0).alias("hi")), ["task"], "lo", "hi").collect()


def test_a_sample_of_one(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 7)], "g string, i int")
    assert sorted((r["g"], r["i"]) for r in contracts.linspace_sample(df, ["g"], "i", 1).collect()) == [("a", 0), ("b", 7)]
    assert sorted(r["i"] for r in contracts.linspace_sample(df, ["g"], "i", 3).filter("g = 'a'").collect()) == [0, 2, 4]


def test_columns_of_unknown_tables_are_found(spark):
    from driftlens.operators import discovery

    rows = [("t1", "A1C", "3", "1.5", "7"), ("t1", "p.Cys2Asp", "2", "2.5", "7"), ("t1", "A1C", "1", "3.5", "7"), ("t1", "C2C", "4", "x", "7"), ("t2", "zz", "1", "1", "7"), ("t3", "A1D", "1", "NaN", "7"), ("t3", "A1C", "1", None, "7")]
    df = spark.createDataFrame([(*r, "ACD", -1) for r in rows], "t string, mut string, position string, `my value` string, same string, seq string, sign int")
    columns = ["mut", "position", "my value", "same"]
    chosen = discovery.choose_columns(df, ["t"], columns, "seq", "t")
    assert {r["t"]: tuple(r)[1:] for r in chosen.collect()} == {
        "t1": ("mut", "my value", None), "t2": (None, None, "no column of single substitutions"), "t3": ("mut", None, "no finite outcome that varies"),
    }
    got = {tuple(r) for r in discovery.canonical(df, chosen, ["t"], columns, "seq", "sign").collect()}
    assert got == {("t1", "A1C", -2.5, 2), ("t1", "C2D", -2.5, 1)}


def test_scoring_resumes(spark, tmp_path):
    from driftlens.operators import adapters

    class Counting:
        model_id, model_version = "counting", "1"

        def __init__(self, folder, bad=(), twice=()):
            self.folder, self.bad, self.twice = folder, bad, twice

        def score_target(self, target, variants):
            (self.folder / f"{target['target_id']}-{random.random()}").touch()
            if target["target_id"] in self.bad:
                raise RuntimeError("down")
            made = variants.assign(score=[len(v) * 1.0 if v != "A9C" else None for v in variants["variant_id"]])
            return pd.concat([made, made]) if target["target_id"] in self.twice else made

    targets = spark.createDataFrame([(f"t{i}", "ACD", f"sha{i}") for i in range(4)], "target_id string, sequence string, sequence_sha256 string")
    variants = spark.createDataFrame([("p", f"t{i}", v) for i in range(4) for v in ("A1C", "C12D", "A9C")], "panel_id string, target_id string, variant_id string")
    seen = tmp_path / "seen"
    seen.mkdir()
    store = str(tmp_path / "store")
    count = lambda: len(list(seen.iterdir()))
    made, audit = adapters.score_panel(Counting(seen, bad=("t2",), twice=("t3",)), targets, variants, "x", store)
    first = {r["target_id"]: r for r in audit.collect()}
    assert count() == 4 and {k: (r["cache_hit"], r["status"], r["coverage"]) for k, r in first.items()} == {"t0": (False, "ok", 2 / 3), "t1": (False, "ok", 2 / 3), "t2": (False, "failed", 0.0), "t3": (False, "failed", 0.0)}
    assert first["t2"]["error"] == "RuntimeError: down" and "twice" in first["t3"]["error"] and made.count() == 6
    made, audit = adapters.score_panel(Counting(seen), targets, variants, "x", store)
    assert count() == 6 and sorted(r["target_id"] for r in audit.filter("cache_hit").collect()) == ["t0", "t1"]
    made, audit = adapters.score_panel(Counting(seen), targets, variants, "x", store)
    assert count() == 6 and audit.filter("NOT cache_hit").count() == 0 and made.filter("status = 'ok'").count() == 8
    adapters.score_panel(Counting(seen), targets, variants.filter("variant_id <> 'A1C' OR target_id <> 't1'"), "x", store)
    assert count() == 7
    with pytest.raises(RuntimeError, match="failed on every target"):
        adapters.score_panel(Counting(seen, bad=("t0",)), targets.filter("target_id = 't0'"), variants, "x", str(tmp_path / "other"))


def test_families_of_a_chain(spark):
    import hashlib

    from driftlens.operators import graph

    nodes = spark.createDataFrame([(i,) for i in range(8)], "node int")
    edges = [(0, 1, 0.9, 0.9, 0.9), (2, 1, 0.9, 0.8, 0.8), (2, 3, 0.9, 0.9, 0.7), (4, 5, 0.5, 1.0, 1.0), (3, 6, None, 1.0, 1.0), (6, 7, 0.6, 0.8, 0.8), (6, 99, 1.0, 1.0, 1.0)]
    made, audited = graph.families(nodes, spark.createDataFrame(edges, "a int, b int, identity double, coverage_a double, coverage_b double"), 0.6, 0.8)
    name = lambda *m: "sf_" + hashlib.sha256("|".join(map(str, m)).encode()).hexdigest()[:12]
    got = {r["node"]: (r["family_id"], r["family_size"]) for r in made.collect()}
    assert got == {0: (name(0, 1, 2), 3), 1: (name(0, 1, 2), 3), 2: (name(0, 1, 2), 3), 3: (name(3), 1), 4: (name(4), 1), 5: (name(5), 1), 6: (name(6, 7), 2), 7: (name(6, 7), 2)}
    assert sorted((r["a"], r["b"]) for r in audited.filter("qualifies").collect()) == [(0, 1), (2, 1), (6, 7), (6, 99)]


def test_pooled_models_weigh_assays_and_leave_groups_out(spark):
    from driftlens.operators import supervised

    r = np.random.default_rng(5)
    rows = []
    for i in range(160):
        assay = i % 8 if i < 80 else 0
        a, b = r.normal(), r.normal()
        rows.append((f"P{assay // 2}", f"A{assay}", i, float(a), float(b), float(a - 0.5 * b + r.normal(0, 0.1))))
    df = spark.createDataFrame(rows, "protein string, assay string, row int, a double, s double, target double")
    got = supervised.pooled(df, ["a", "s"], ["s"], "protein", "assay", folds=4, settings={"rounds": 2, "least": 5, "leaves": 3, "depth": 2}).toPandas()
    assert got.groupby("model").size().to_dict() == {m: 160 for m in ("ridge", "boosted", "ridge_mutation_only", "boosted_mutation_only")}
    table_ = pd.DataFrame(rows, columns=["protein", "assay", "row", "a", "s", "target"])
    own = got[got["model"] == "ridge"]
    for fold, part in own.groupby("fold"):
        train = table_[~table_["protein"].isin(part["protein"])]
        w = (1 / train.groupby("assay")["row"].transform("size")).to_numpy()
        w = w / w.mean()
        x = train[["a", "s"]].to_numpy()
        z = (x - x.mean(0)) / x.std(0)
        zc, yc = z - np.average(z, axis=0, weights=w), train["target"].to_numpy() - np.average(train["target"], weights=w)
        coef = np.linalg.solve((zc * w[:, None]).T @ zc + 10 * np.eye(2), (zc * w[:, None]).T @ yc) / x.std(0)
        want = np.average(train["target"], weights=w) + (part[["a", "s"]].to_numpy() - np.average(x, axis=0, weights=w)) @ coef
        assert np.allclose(part["predicted"], want)


def test_win_summary(spark):
    from driftlens.operators import supervised

    r = random.Random(3)
    rows = [("m", f"g{i % 6}", r.randint(0, 1), round(r.random(), 1)) for i in range(90)]
    got = supervised.win_summary(spark.createDataFrame(rows, "model string, g string, label int, probability double"), "g").first()
    pairs = [(p > q) + 0.5 * (p == q) for _, _, a, p in rows if a for _, _, b, q in rows if not b]
    right = [(g, a, a == (p >= 0.5)) for _, g, a, p in rows]
    assert math.isclose(got["roc_auc"], np.mean(pairs))
    assert math.isclose(got["brier"], np.mean([(p - a) ** 2 for *_, a, p in rows]))
    assert math.isclose(got["balanced_accuracy"], (np.mean([c for _, a, c in right if a]) + np.mean([c for _, a, c in right if not a])) / 2)
    assert math.isclose(got["mean_group_accuracy"], np.mean([np.mean([c for h, _, c in right if h == g]) for g in {g for g, *_ in right}]))


@pytest.mark.parametrize(("loss", "target", "weight"), [("squared", "y", "w"), ("absolute", "y", None), ("logistic", "label", None)])
def test_boosting_of_groups_too_large_for_a_task_equals_its_twin(data, frame, monkeypatch, loss, target, weight):
    """Passes over all cells give the trees that one task gives."""
    settings = {"rounds": 3, "rate": 0.3, "leaves": 5, "least": 7, "l2": 1.0, "bins": 16, "depth": 3}
    monkeypatch.setattr(boosting, "GATHERED", 0)
    model = boosting.fit(frame.filter("row < 900"), ["grp"], X, target, weight, loss=loss, keep=2, **settings)
    got = {r["row"]: r["predicted"] for r in boosting.predict(frame, model, ["grp"]).collect()}
    for _, own in data.groupby("grp"):
        w = own[weight].to_numpy() if weight else np.ones(len(own))
        want = twin(own[X].to_numpy(), own[target].to_numpy().astype(float), w, loss, **settings)
        assert np.allclose([got[r] for r in own["row"]], want, rtol=1e-9)


def test_full_rounds_are_few_jobs_and_equal_rows_one_cell(spark):
    """150 rounds of a group are no jobs of their own; features that a key tells and rows added up change no value."""
    from driftlens.operators import supervised

    r = np.random.default_rng(8)
    rows = []
    for i in range(600):
        key, assay = f"K{i * 7 % 11}", i % 24
        s = float(r.integers(0, 4))
        rows.append((f"P{assay // 2}", f"A{assay}", key, float(i * 7 % 11 % 4), float(i * 7 % 11), s, float(s + (i * 7 % 11) / 5 + r.normal(0, 0.3))))
    rows.append(("P0", "A0", "bad", None, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "protein string, assay string, key string, a double, b double, s double, target double").cache()
    more = {"group": "protein", "assay": "assay", "folds": 4}
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("pooled", "pooled")
    told = supervised.pooled(df, ["a", "b", "s"], ["s"], **more, keys=["key"], varying=["s"])
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("pooled")) < 120
    key = ["model", "fold", "assay", "key", "s", "target"]
    got, want = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (told, supervised.pooled(df, ["a", "b", "s"], ["s"], **more)))
    assert len(got) == len(want) == 4 * len(rows) and list(got.columns) == list(want.columns)
    assert got[key].equals(want[key]) and np.allclose(got["predicted"].astype(float), want["predicted"].astype(float), rtol=1e-9, equal_nan=True)
    assert got["predicted"].isna().sum() == 4
