"""Pairing, audits, ranks, policies and sets on small frames with known values, nulls and ties."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftlens.operators import panels


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pairing(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, x string")
    right = spark.createDataFrame([(1, "c"), (2, "d"), (2, "e")], "k int, y string")
    assert panels.pairing(left, right, ["k"]).first().asDict() == {"left_rows": 3, "right_rows": 3, "paired": 2, "repeated": 1, "exact": False}
    assert panels.pairing(left.limit(0), right.limit(0), ["k"]).first().asDict() == {"left_rows": 0, "right_rows": 0, "paired": 0, "repeated": 0, "exact": True}
    assert rows(panels.one_to_one(left, right.filter("y <> 'e'"), ["k"])) == [(1, "a", "c"), (2, "b", "d")]
    for bad in (right, right.limit(0)):
        with pytest.raises(ValueError, match="repeat"):
            panels.one_to_one(left, bad, ["k"])


def test_score_audit_names_every_fault(spark):
    source = spark.createDataFrame([(g, c, 1.0) for g in "abcd" for c in "xy"], "g string, c string, v double")
    scored = spark.createDataFrame([("a", "x", 1.0, 0.1), ("a", "y", 1.0, 0.2), ("b", "x", 1.0, 0.1), ("b", "x", 1.0, 0.1), ("c", "x", 2.0, None), ("c", "y", 1.0, float("nan"))], "g string, c string, v double, m double")
    found = {r["g"]: (r["reasons"], r["common"]) for r in panels.score_audit(source, scored, ["g"], "c", "v", ["m"]).collect()}
    assert found["a"] == ("", 1.0) and found["d"] == ("missing_scores;incomplete_variant_join;insufficient_common_score_coverage", 0.0)
    assert found["b"] == ("duplicate_score_variants;incomplete_variant_join;insufficient_common_score_coverage", 0.5)
    assert found["c"] == ("score_mismatch;insufficient_common_score_coverage", 0.0)
    assert panels.score_audit(source, scored, ["g"], "c", "v", ["m"], all_finite=True).filter("g = 'c'").first()["reasons"] == "score_mismatch;nonfinite_predictions:m"


def test_pooled_ranks_equal_one_sort(spark):
    frame = spark.range(500).select(F.when(F.col("id") % 3 == 0, "p").when(F.col("id") % 3 == 1, "q").alias("panel"), "id", (F.col("id") * 37 % 11).alias("c"))
    got = panels.coverage_decisions(frame.repartition(7), "panel", "c", ["id"]).collect()
    order = sorted(got, key=lambda r: (-r["c"], r["panel"] is not None, r["panel"] or "", r["id"]))
    assert [r["pooled_rank"] for r in order] == list(range(1, 501)) and sum(r["pooled_decision"] == "deploy" for r in got) == 250
    for panel in ("p", "q", None):
        assert [r["panel_rank"] for r in order if r["panel"] == panel] == list(range(1, 1 + sum(r["panel"] == panel for r in got)))
    assert panels.coverage_decisions(frame.limit(0), "panel", "c", ["id"]).count() == 0


def test_policies(spark):
    frame = spark.createDataFrame([("t", "a", 1.0), ("t", "base", 0.95), ("u", "a", 1.0), ("u", "base", 0.5)], "task string, m string, s double")
    assert rows(panels.override(frame, ["task"], "m", "s", "base", 0.1).select("task", "m", "overrode")) == [("t", "base", False), ("u", "a", True)]
    with pytest.raises(PySparkException, match="baseline"):
        panels.override(frame.filter("m = 'a'"), ["task"], "m", "s", "base", 0.1).collect()
    value = panels.priority({"neff": F.lit(None).cast("double"), "length": F.lit(0.0), "decision": F.lit(3.0)}, {"neff": (1.0, 2.0), "length": (1.0, 2.0), "decision": (1.0, 2.0)})
    assert spark.range(1).select(value.alias("v")).first()["v"] == pytest.approx(0.5 * -0.5 + 0.25)
    tail = spark.createDataFrame([("g", i, float(i)) for i in range(10)], "g string, i int, v double")
    assert panels.tail_mean(tail, ["g"], "v", "i").first()["tail_mean"] == 0.5 and panels.order_statistic(tail, ["g"], "v", 99).first()["v"] == 9.0


def test_sets_and_units(spark):
    a, b = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int"), spark.createDataFrame([(None,), (3,)], "k int")
    assert rows(panels.differences(a, b)) == [(1, "missing"), (2, "missing"), (3, "unexpected")]
    assert rows(panels.mapping(spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None)], "k string, v int"), "k", "v")) == [("a", 1, False), ("b", None, True), ("c", None, False)]
    units = spark.createDataFrame([("p", "f", 1, None), ("p", "f", 1, None), ("q", "f", 1, None), ("q", "f", 1, 5)], "p string, file string, start int, stop int")
    assert rows(panels.structure_units(units, "p", "file", "start", "stop")) == [("p", 2, False, "f", 1, None), ("q", 2, True, None, None, None)]
    cuts = spark.createDataFrame([("ABCDE", 2, 4), ("ABCDE", 0, 3), ("ABCDE", 4, 9), (None, 1, 1)], "s string, a int, b int")
    assert sorted((r["segment"] or "") for r in panels.segments(cuts, "s", "a", "b").collect()) == ["", "", "", "BCD"]
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.4), (1, 1, 1.0), (3, 1, 0.2)], "a int, b int, tm double")
    assert rows(panels.reciprocal(edges, "a", "b", ["tm"], [])) == [(1, 2, 2, 0.4), (1, 3, 1, 0.2)]


def test_baseline_draws_are_shared(spark):
    wide = spark.createDataFrame([("g", f"u{i}", float(i), float(i) + 1, None if i == 3 else float(i)) for i in range(4)], "g string, u string, base double, better double, same double")
    found = {r["model"]: r for r in panels.against_baseline(wide, ["g"], "u", ["base", "better", "same"], "base").collect()}
    assert (found["better"]["delta"], found["better"]["lower"], found["better"]["radius"], found["better"]["best_share"]) == pytest.approx((1.0, 1.0, 0.0, 1.0))
    assert found["same"]["delta"] == 0.0
