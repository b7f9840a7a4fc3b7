"""Intervals, policies and table audits on small frames with known values."""

import pytest

from driftlens.operators import intervals, policies, tables

ROWS = "g string, grp string, id int, observed double, predicted double"


def test_group_radii(spark):
    frame = spark.createDataFrame([("a", "x", 1, 0.1, 0.0), ("a", "x", 2, 2.0, 0.0), ("a", "y", 3, 0.2, 0.0), ("a", "z", 4, 0.3, 0.0)], ROWS)
    assert intervals.group_max_radius(frame, ["g"], "grp", 0.5).first()["radius"] == 0.3
    assert intervals.hierarchical_radius(frame, ["g"], "grp", "id", 0.99).first()["radius"] is None
    small = {r["grp"]: r["radius"] for r in intervals.mondrian_radius(frame, ["g"], "grp", "id", 0.5, least=2).collect()}
    assert small == {"x": 2.0, "y": 0.3, "z": 0.3}


def test_nearest_fitted(spark):
    frame = spark.createDataFrame([("a", 1, "train"), ("a", 4, "test"), ("a", 6, "train"), ("a", 9, "test"), ("b", 5, "test")], "g string, position int, role string")
    assert {(r["g"], r["position"]): r["distance"] for r in intervals.nearest_fitted(frame, ["g"]).collect()} == {("a", 4): 2, ("a", 9): 3, ("b", 5): None}


def test_choice_and_curve(spark):
    frame = spark.createDataFrame([("t1", "m", 1.0, 0.5), ("t1", "n", 1.0, 0.9), ("t2", "m", 0.2, -1.0), ("t2", "n", 0.1, 3.0)], "task string, model string, decision double, gain double")
    chosen = policies.choose(frame, ["task"], "model", "decision", "gain")
    assert {(r["task"], r["model"]): round(r["regret"], 6) for r in chosen.collect()} == {("t1", "m"): 0.4, ("t2", "m"): 4.0}
    points = policies.curve(chosen, ["model"], ["task"], "decision", steps=2)
    assert {r["coverage"]: (r["retained"], r["failure"], r["tail_gain"]) for r in points.collect()} == {0.5: (1, 0.0, 0.5), 1.0: (2, 0.5, -1.0)}
    assert policies.area(points, ["model"], "coverage", "mean_regret").first()["area"] == pytest.approx(0.5 * (0.4 + 2.2) / 2)


def test_tables(spark):
    frame = spark.createDataFrame([("t", "AC")], "target string, sequence string")
    made = tables.substitutions(frame, "sequence")
    assert made.count() == 38 and made.filter("code = 'A1C'").count() == 1
    two = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert tables.table_digest(two).first() == tables.table_digest(two.select("y", "x").orderBy("x", ascending=False)).first()
    spans = spark.createDataFrame([("p", 1, 5), ("p", 6, 8), ("p", 10, 30), ("q", 40, 50)], "g string, a int, b int")
    assert [(r["g"], r["islands"], r["share"]) for r in tables.covered_share(spans, ["g"], "a", "b", 10).collect()] == [("p", 2, 0.9)]
    folds = tables.group_folds(spark.createDataFrame([("k", f"g{i}") for i in range(10) for _ in range(i + 1)], "k string, grp string"), ["k"], "grp", 5).collect()
    assert {r["n"]: r["fold"] for r in folds} == {10: 0, 9: 1, 8: 2, 7: 3, 6: 4, 5: 4, 4: 3, 3: 2, 2: 1, 1: 0}
