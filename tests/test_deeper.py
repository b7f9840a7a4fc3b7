"""Resampling within levels, abstention, interval suites, unions and registries on small frames with known values."""

import pytest
from pyspark.sql import functions as F

from driftlens.operators import fits, graph, intervals, joins, nested, registries


def test_draws_within_levels_keep_the_nesting(spark):
    leaves = [("m", f"f{i}", f"f{i}p{j}", f"f{i}p{j}a{k}", float(i)) for i in range(3) for j in range(i + 1) for k in range(2)]
    df = spark.createDataFrame(leaves, "g string, f string, p string, a string, v double")
    got = nested.within(df, ["g"], ["f", "p", "a"], repeats=5).collect()
    assert {r["_rep"] for r in got} == set(range(5)) and all(r["p"].startswith(r["f"]) and r["a"].startswith(r["p"]) for r in got)
    for rep in range(5):
        # three families are drawn, each as many proteins as it has, each two assays
        assert sum(1 / (2 * (int(r["f"][1]) + 1)) for r in got if r["_rep"] == rep) == pytest.approx(3)
    flat = df.withColumn("v", F.lit(2.0))
    assert nested.nested_mean(flat, ["g"], ["f", "p", "a"], "v", 20).first()[1:] == (2.0, 2.0, 1 / 21)
    assert nested.nested_mean(df.limit(0), ["g"], ["f", "p", "a"], "v").count() == 0


def test_position_rank_without_variance_is_zero(spark):
    df = spark.createDataFrame([("a", i % 4, float(i), float(i)) for i in range(12)] + [("b", i, 1.0, float(i)) for i in range(4)] + [("a", 1, None, 2.0)], "g string, position int, observed double, predicted double")
    got = {r["g"]: r for r in nested.position_rank(df, ["g"], repeats=30).collect()}
    assert got["a"]["lower"] == pytest.approx(1) and got["a"]["upper"] == pytest.approx(1)
    assert (got["b"]["lower"], got["b"]["upper"], got["b"]["p"]) == (0.0, 0.0, 1.0)


def test_improvements_against_plain_sums(spark):
    gains = [0.9, 0.5, -0.1, 0.4, 0.0, -0.5, 0.2, -0.3, -0.2, 0.1]
    df = spark.createDataFrame([("p", i, g, 1 - g, 10.0 - i) for i, g in enumerate(gains)], "panel string, id int, gain double, regret double, conf double")
    got = nested.improvements(df, ["panel"], [F.desc("conf"), F.col("id")]).first()
    means = [sum(gains[:k]) / k for k in range(1, 11)]
    area = sum((a + b) / 20 for a, b in zip(means, means[1:]))
    assert got["utility_auc"] == pytest.approx(area - 0.9 * means[-1]) and got["regret_auc"] == pytest.approx(area - 0.9 * means[-1])
    assert got["utility_half"] == pytest.approx(means[4] - means[9]) and got["risk_half"] == pytest.approx(0.5 - 2 / 5)


def test_gates(spark):
    limit = spark.createDataFrame([("m", "regret_auc", 0.1), ("m", "risk_auc", 0.0), ("n", "regret_auc", -0.1), ("n", "risk_auc", 0.2)], "g string, name string, lower double")
    points = spark.createDataFrame([("m", 0.0), ("n", 1.0)], "g string, utility_half double")
    panels = spark.createDataFrame([("m", 0.1, 0.0, 0.0), ("m", 0.1, 0.1, 0.1)], "g string, regret_auc double, risk_auc double, utility_half double")
    got = {r["g"]: tuple(r)[1:] for r in nested.development_gates(limit, points, panels, ["g"]).collect()}
    assert got == {"m": (True, True, True), "n": (False, None, False)}


def test_unions_and_thresholds(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    groups = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None)], "node long, group string")
    edges = spark.createDataFrame([(2, 3, 0.9), (6, 7, 0.6), (5, 99, 0.9)], "a long, b long, s double")
    got = {r["node"]: r["component"] for r in graph.union(nodes, [groups], edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}
    at = {(r["threshold"], r["node"]): r["component"] for r in graph.sensitivity(nodes, edges, "s", [0.5, 0.8]).collect()}
    assert at[0.5, 7] == 6 and at[0.8, 7] == 7 and at[0.8, 3] == 2 and len(at) == 14


def test_weighted_quantile(spark):
    df = spark.createDataFrame([("g", 1.0, 1), ("g", 2.0, 1), ("g", 2.0, 2), ("g", 9.0, 1), ("g", None, 50)], "g string, v double, w long")
    assert [intervals.weighted_quantile(df, ["g"], "v", "w", q).first()["quantile"] for q in (0.2, 0.21, 0.8, 0.81)] == [1.0, 2.0, 2.0, 9.0]


def test_registries(spark):
    frame = spark.createDataFrame([(1, 2, 3, 4)], "dms_S1 int, dms_S1_err int, dmsx int, other int")
    assert registries.condition_columns(frame, "dms") == ["dms_S1"]
    registries.refuse_outcomes(frame, ["y"], ["outcome"])
    for bad in ("y", "My_Outcome_2"):
        with pytest.raises(ValueError, match=bad):
            registries.refuse_outcomes(frame.withColumnRenamed("other", bad), ["y"], ["outcome"])
    rows = spark.createDataFrame([(1, "2020-01-02", 5, 50), (2, "2020-01-01", 5, 50), (3, "soon", 5, 50), (4, "2020-02-01", 5, 50), (5, None, 5, 50), (6, "2020-01-09", 4, 50), (7, "2020-01-09", 5, 99)], "urn int, day string, n int, size int")
    rule = dict(after="2020-01-01", until="2020-02-01", least=5, lengths=(40, 60))
    assert sorted(r["urn"] for r in registries.candidates(rows, "urn", "day", "n", "size", **rule).collect()) == [1, 4]
    with pytest.raises(ValueError, match="twice"):
        registries.candidates(rows.union(rows), "urn", "day", "n", "size", **rule)
    ruled = spark.createDataFrame([(1, "d", True, False), (2, "d", None, False), (3, "d", False, None), (4, None, False, False)], "urn int, digest string, prior boolean, overlap boolean")
    got = {r["urn"]: (r["reasons"], r["included"]) for r in registries.excluded(ruled, "urn", "digest", ["prior", "overlap"]).collect()}
    assert got == {1: ("prior", False), 2: ("", True), 3: ("", False), 4: ("", False)}
    seen = registries.eligibility(spark.createDataFrame([("passed",), ("failed",), (None,)], "s string"), "s").collect()
    assert [(r["eligible"], r["reason"]) for r in seen] == [(True, ""), (False, "qualification_failed"), (False, "not_qualified")]


def test_best_single_is_chosen_on_train_rows(spark):
    rows = [("a", m, role, float(i), float(i if good == (role == "train") else -i)) for m, good in (("m", False), ("n", True)) for role in ("train", "test") for i in range(5)]
    got = fits.best_single(spark.createDataFrame(rows, "g string, model string, role string, observed double, predicted double"), ["g"], "model").collect()
    assert {(r["model"], r["role"], r["train_spearman"]) for r in got} == {("n", "test", 1.0)} and len(got) == 5


def test_align_models_counts_finite_scores(spark):
    source = spark.createDataFrame([("g", "x"), ("g", "x"), ("g", "y"), ("g", "z"), ("h", "x")], "g string, c string")
    stored = spark.createDataFrame([("g", "x", 1.0, None), ("g", "x", None, None), ("g", "y", float("nan"), 1.0), ("g", "w", 1.0, 1.0)], "g string, c string, m double, n double")
    assert sorted(map(tuple, joins.align_models(source, stored, ["g"], "c", ["m", "n"]).collect())) == [("g", 3, 2, 1, 1), ("h", 1, 0, 0, 0)]


def test_joint_families_name_only_what_is_held(spark):
    known = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "node long, group string")
    edges = spark.createDataFrame([(2, 10, 1.0), (11, 99, 1.0), (12, 12, 1.0)], "a long, b long, s double")
    targets = spark.createDataFrame([(10,), (11,), (12,)], "node long")
    assert sorted(map(tuple, graph.joint(known, targets, edges).collect())) == [(10, "1"), (11, "undocumented"), (12, "undocumented")]
