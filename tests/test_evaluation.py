"""Evaluation operators on small hand-made frames with known values."""

import random

import pytest
from pyspark.sql import functions as F

from driftlens.functions import codes
from driftlens.operators import graph, metrics, splits, summaries
from driftlens.plans import studies


def test_codes(spark):
    frame = spark.createDataFrame([(c,) for c in ("A169C", "A2C/D4E", "", "B12A", "A0C", "A12A", "A-1C", "p.A1C", "A2C/A2D")], "code string")
    got = {r["code"]: r["m"] for r in frame.select("code", codes.parse(F.col("code")).alias("m")).collect()}
    assert got["A169C"] == [("A", 169, "C")] and got[""] == []
    assert [m["pos"] for m in got["A2C/D4E"]] == [2, 4]
    assert all(got[c] is None for c in ("B12A", "A0C", "A12A", "A-1C", "p.A1C", "A2C/A2D"))
    one = spark.createDataFrame([("A1C/D3E", "ACD*"), ("C1A", "ACD*")], "code string, s string").withColumn("m", codes.parse(F.col("code")))
    rows = one.select(codes.agrees(F.col("m"), F.col("s")).alias("ok"), codes.apply_to(F.col("m"), F.col("s")).alias("s")).collect()
    assert rows[0]["ok"] and rows[0]["s"] == "CCE*" and not rows[1]["ok"]


def test_metrics(spark):
    frame = spark.createDataFrame([("p", i, float(i), float(i)) for i in range(4)] + [("c", i, float(i), 1e16) for i in range(4)] + [("c", 9, None, 1.0)], "g string, id int, observed double, predicted double")
    got = {r["g"]: r for r in metrics.regression(frame, ["g"]).collect()}
    assert got["p"]["spearman"] == pytest.approx(1) and got["p"]["rmse"] == 0 and got["p"]["r2"] == 1
    assert got["c"]["spearman"] == 0 and got["c"]["n"] == 4
    assert metrics.ndcg(frame.filter("g = 'p'"), ["g"], "id").first()["ndcg"] == pytest.approx(1)
    residuals = spark.createDataFrame([(1, i, v, 0.0) for i, v in enumerate([-1.0, 0.25, 0.5, 2.0])], "g int, id int, observed double, predicted double")
    assert metrics.conformal_radius(residuals, ["g"], "id", 0.5).first()["radius"] == 1.0


def test_splits(spark):
    frame = spark.createDataFrame([("a", f"A{p}{x}", p) for p in range(1, 31) for x in "CD"], "g string, code string, position int")
    held = lambda df: sorted({r["position"] for r in df.filter("role = 'test'").collect()})
    assert held(splits.modulo(frame, 2)) == [2, 7, 12, 17, 22, 27]
    assert held(splits.contiguous(frame, ["g"], 2)) == list(range(13, 19))
    audit = splits.leakage(splits.position(frame, ["g"]), ["g"]).first()
    assert audit["shared_position"] == 0 and audit["test_rows"] == 12
    assert splits.leakage(splits.random_item(frame, ["g"]), ["g"]).first()["shared_code"] == 0


def test_components_and_holm(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "node int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7)], "a int, b int")
    assert {r["node"]: r["component"] for r in graph.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8}
    p = spark.createDataFrame([("x", "a", 0.01), ("x", "b", 0.04), ("x", "c", 0.03)], "g string, name string, p double")
    assert {r["name"]: round(r["adjusted"], 6) for r in summaries.holm(p, ["g"], "name", "p").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_components_settle_on_long_chains(spark):
    order = list(range(500))
    random.Random(3).shuffle(order)
    chain = [*zip(order, order[1:]), (0, 0), (order[0], 7000)]
    nodes = spark.createDataFrame([(i,) for i in [*range(500), 900, 901]], "node int")
    edges = spark.createDataFrame([*chain, (901, 900)], "a int, b int")
    got = {r["node"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert got == dict.fromkeys(order, 0) | {900: 900, 901: 900}
    with pytest.raises(RuntimeError):
        graph.components(nodes, edges, rounds=1)


def test_components_over_all_events(spark, tmp_path):
    r = random.Random(8)
    events = [(i, r.choice([None, *range(0, 4000, 97)])) for i in range(400)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, u in events:
        if u is not None:
            x, y = sorted((find(u), find(u * 31 + i)))
            root[y] = x
    got = {r["node"]: r["component"] for r in studies.QUERIES["g_components_all"](spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_entry_lists_sql_only_for_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
