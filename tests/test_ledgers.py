"""Scalars, contracts, features, joins and fits on small frames with known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.functions import names
from driftlens.operators import contracts, features, fits, intervals, joins, metrics, splits, tables


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def test_names(spark):
    assert tuple(one(spark, "p.Ala1Cys", names.hgvs)) == ("A", 1, "C") and tuple(one(spark, "p.Gly7Ter", names.hgvs)) == ("G", 7, "*") and tuple(one(spark, "p.Gly7=", names.hgvs)) == ("G", 7, "G")
    assert one(spark, "p.Ala1_Cys3del", names.hgvs) is None and one(spark, "p.Abc1Cys", names.hgvs) is None
    assert one(spark, " HTTPS://doi.org/10.1/AbC/.", names.doi) == "10.1/abc" and one(spark, None, names.doi) is None
    assert one(spark, "A1C", names.mutation_group) == "hydrophobic>polar" and one(spark, "A1C/D2E", names.mutation_group) == "multiple" and one(spark, "", names.mutation_group) == "multiple"
    assert str(one(spark, "2024", names.cutoff_end)) == "2024-12-31" and str(one(spark, "2024-02", names.cutoff_end)) == "2024-02-29" and one(spark, "soon", names.cutoff_end) is None
    assert one(spark, "ala 1_cys", lambda c: names.flexible_code(c, F.lit("ACD"))) == "A1C" and one(spark, "C1A", lambda c: names.flexible_code(c, F.lit("ACD"))) is None
    spans = spark.range(1).select(names.windows(F.lit(2000)).alias("w")).first()["w"]
    assert [(w["start"], w["stop"]) for w in spans] == [(0, 1022), (766, 1788), (978, 2000)]
    assert [tuple(w) for w in spark.range(1).select(names.windows(F.lit(10)).alias("w")).first()["w"]] == [(0, 10)]


def test_contracts(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "k string, v int")
    assert contracts.contract(frame, ["k", "v"], ["k"]).first().asDict() == {"rows": 3, "repeated_keys": 1, "null_keys": 1}
    with pytest.raises(ValueError, match="missing"):
        contracts.contract(frame, ["x"], ["k"])
    with pytest.raises(ValueError, match="outcomes"):
        contracts.outcome_firewall(frame.withColumn("DMS_score", F.lit(1)), set(), ("dms_",))
    assert contracts.condition_columns(spark.createDataFrame([(1, 2, 3)], "mean_y_S1 int, mean_y_S1_err int, mean_z int")) == ["mean_y_S1"]
    bill = contracts.budget(spark.createDataFrame([("j", 1000.0), ("k", 500.0), ("k", None)], "job string, cost double"), "job", "cost", 100.0).first()
    assert (bill["spent"], bill["alert"], bill["permitted"], bill["faults"]) == (1500.0, "75%", True, 2)
    target = spark.createDataFrame([("AC", 2, "x")], "s string, n int, sha string")
    assert contracts.target_faults(target, "s", "sha", "n").first()["fault"] == "digest"
    measured = spark.createDataFrame([("", 0, False, 5000), ("A1C", 1, False, 1000), ("A1*", 1, False, 9000), ("A2C", 1, True, 9000)], "code string, m int, indel boolean, n int")
    assert [r["code"] for r in contracts.quality(measured, "n", "indel", "code").collect()] == ["", "A1C"]


def test_digest_tells_nulls_names_and_bounds_apart(spark):
    rows = [("a", "b|c"), ("a|b", "c"), (None, "c"), ("", "c")]
    digests = {tables.table_digest(spark.createDataFrame([r], "x string, y string")).first()["digest"] for r in rows}
    assert len(digests) == 4
    assert tables.table_digest(spark.createDataFrame([rows[0]], "x string, z string")).first()["digest"] not in digests
    assert tables.table_digest(spark.createDataFrame([], "x string")).first()["rows"] == 0


def test_metrics_leave_out_rows_that_are_not_finite(spark):
    rows = [("g", str(i), v, 0.0) for i, v in enumerate([-1.0, 0.25, 0.5, 2.0, None, float("nan")])]
    frame = spark.createDataFrame(rows, "g string, i string, observed double, predicted double")
    assert metrics.conformal_radius(frame, ["g"], "i", 0.5).first()["radius"] == 1.0
    assert metrics.ndcg(frame.withColumn("predicted", F.col("observed")), ["g"], "i").first()["ndcg"] == 1.0
    assert metrics.risk_coverage(frame.withColumn("u", F.abs("observed")), ["g"], "i", "u", [0.5]).first()["retained"] == 2


def test_bridging_rows_are_excluded(spark):
    frame = spark.createDataFrame([("g", [1]), ("g", [2]), ("g", [1, 2]), ("g", [])], "g string, places array<int>")
    held = spark.createDataFrame([("g", 2)], "g string, position int")
    assert {tuple(r["places"]): r["role"] for r in splits.bridge(frame, held, ["g"]).collect()} == {(1,): "train", (2,): "test", (1, 2): "excluded", (): "excluded"}
    with pytest.raises(Exception, match="single position"):
        splits.held_positions(spark.createDataFrame([("g", 1)], "g string, position int"), ["g"]).collect()


def test_features(spark):
    frame = spark.createDataFrame([("A1C/D4P",), ("",), ("A1*",), ("bad",)], "code string")
    got = {r["code"]: r for r in features.biophysical(frame).collect()}
    r = got["A1C/D4P"]
    assert (r["mutation_count"], r["position_mean"], r["position_std"], r["proline_introduced"]) == (2.0, 2.5, 1.5, 1.0)
    assert r["hydropathy_delta_sum"] == pytest.approx(0.7 + 1.9) and r["charge_delta_abs"] == 1.0 and r["polar_delta"] == 0.0
    assert got[""]["position_max"] == 0.0 and got["bad"]["position_max"] is None and got["A1*"]["volume_delta_sum"] == -88.6
    assert {r["feature"] for r in features.additive(frame, ["code"]).filter("code = 'A1C/D4P'").collect()} == {"position=1", "substitution=A>C", "mutation=A1C", "position=4", "substitution=D>P", "mutation=D4P"}


def test_ridge_equals_its_closed_form(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 3)) * [1, 50, 0.1] + [0, 1000, 5]
    x[:, 2] = np.where(np.arange(60) < 40, x[0, 2], x[:, 2])
    y = x @ [1.0, 0.2, 3.0] + r.normal(size=60)
    roles = ["train"] * 40 + ["test"] * 20
    rows = [("g", int(i), *map(float, x[i]), float(y[i]), roles[i]) for i in range(60)] + [("h", 99, 1.0, 2.0, 3.0, 4.0, "test")]
    frame = spark.createDataFrame(rows, "g string, i int, a double, b double, c double, observed double, role string")
    got = {q["i"]: q["predicted"] for q in fits.ridge(frame, ["g"], ["a", "b", "c"], alpha=2.0).collect()}
    m, s = x[:40].mean(0), x[:40].std(0)
    s[s < 1e-12] = 1
    z = (x - m) / s
    w = np.linalg.solve(z[:40].T @ z[:40] + 2 * np.eye(3), z[:40].T @ (y[:40] - y[:40].mean()))
    assert got.pop(99) is None
    assert np.allclose([got[i] for i in range(40, 60)], z[40:] @ w + y[:40].mean())


def test_joins(spark):
    pairs = spark.createDataFrame([("t", 1.0, 2.0), ("t", 2.0, 3.0), ("t", 3.0, None), ("u", 1.0, 1.0)], "g string, a double, b double")
    assert {r["g"]: (r["n"], r["rho"]) for r in joins.rank_correlation(pairs, ["g"], "a", "b").collect()} == {"t": (2, 1.0), "u": (1, None)}
    state = joins.three_state(spark.createDataFrame([("x", "F1"), ("x", "F2"), ("y", None), ("z", "F3")], "i string, f string"), spark.createDataFrame([("F2",)], "f string"), "i", "f")
    assert {r["i"]: (r["status"], r["overlap"], r["shared"]) for r in state.collect()} == {"x": ("audited", True, "F2"), "y": ("undocumented", None, None), "z": ("audited", False, "")}
    spread = lambda t: [(i, c) for i, c in enumerate(t)]
    side = lambda t: spark.createDataFrame([("p", i, c) for i, c in spread(t)], "p string, place int, residue string")
    best = joins.region_offset(side("ACDEYGHI"), side("ZZZZACDEFGHIQQ"), "p").first()
    assert (best["offset"], best["mapped"], best["first"], best["last"]) == (4, 7, 4, 11)
    runs = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 3.0)], "k string, s string, v double")
    assert joins.paired(runs, ["k"], "s", "a", "b", ["v"]).first()["v_delta"] == 2.0
    with pytest.raises(Exception, match="not paired"):
        joins.paired(runs.unionByName(runs.filter("s = 'a'")), ["k"], "s", "a", "b", ["v"]).collect()


def test_distance_scaled_intervals_widen(spark):
    rows = [("g", f"c{p}", p, 1.0, 0.0, "fit" if p < 4 else "calibration" if p < 7 else "test") for p in range(1, 11)]
    got = intervals.distance_scaled(spark.createDataFrame(rows, "g string, code string, position int, observed double, predicted double, role string"), ["g"], "code").orderBy("position").collect()
    assert [r["position"] for r in got] == [7, 8, 9, 10] and all(a["half_width"] < b["half_width"] for a, b in zip(got, got[1:]))
