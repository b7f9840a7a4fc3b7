"""Work that must not grow faster than its input, held against the plain form."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.operators import cohorts, linear, metrics, nested, panels, positions, resampling, sparse, supervised
from driftlens.plans import bindings, deeper, ledgers, models, studies
from driftlens.plans import panels as panel_plans


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Lines with nulls, NaN, odd and even cells, line numbers past 20 and a supplier without a key."""
    d = str(tmp_path_factory.mktemp("lines"))
    k = F.col("id")
    v = lambda m: F.when(k % m != 0, (k * 7919 % 1000 / 8)).alias("v")
    rows = spark.range(6000).select(
        F.when(k % 11 != 0, k % 7).alias("l_suppkey"), (k * 13 % 400).alias("l_partkey"), (k % 45 + 1).cast("int").alias("l_linenumber"), v(5).alias("l_extendedprice"),
        F.when(k % 19 == 0, F.lit(float("nan"))).otherwise(v(3)).alias("l_quantity"), v(2).alias("l_discount"), v(9).alias("l_tax"),
    )
    rows.write.parquet(f"{d}/lineitem.parquet")
    return d


def test_items_equal_their_text_and_are_dealt_once(spark, lines):
    want = spark.sql(bindings.ITEMS, lineitem=spark.read.parquet(f"{lines}/lineitem.parquet"))
    got = bindings.items(spark, lines)
    assert got.dtypes == want.dtypes and got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plain = want.unpivot(["assay_id", "protein_id", "family_id", "position", "code", "observed"], ["qty", "disc", "tax"], "model_id", "predicted").withColumn("predicted", F.col("predicted") * 1000.0)
    told = bindings.scores(spark, lines)
    assert told.dtypes == plain.dtypes and told.exceptAll(plain).isEmpty() and plain.exceptAll(told).isEmpty()
    ranked = supervised.Window.partitionBy("assay_id", "model_id").orderBy("predicted")
    plan = told.withColumn("r", F.rank().over(ranked))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.fixture(scope="module")
def shifts(spark):
    rows = [(g, p, f"{'ACDEF'[p % 5]}{p}{'LMNP'[(i + p) % 4]}", float(i * 37 % 11), "test" if i % 5 == 0 else "train") for g in ("g", "h", None) for p in range(1, 13) for i in range(9)]
    return spark.createDataFrame(rows, "grp string, position int, code string, observed double, role string")


@pytest.mark.parametrize("limit", [0, 100])
def test_gathered_groups_equal_the_long_tables(spark, shifts, monkeypatch, limit):
    """Groups beyond the limit take the long tables; no step of the others is a job of its own."""
    rows = shifts.filter("grp IS NOT NULL").unionByName(shifts.filter("grp = 'g'").withColumn("grp", F.lit("big")).withColumn("observed", F.col("observed") + 1))
    rows = rows.filter("grp = 'big' OR position < 8")
    calls = []
    whole = sparse.sparse_ridge
    monkeypatch.setattr(sparse, "sparse_ridge", lambda *a, **k: calls.append(1) or whole(*a, **k))
    told = lambda: {(r["grp"], r["code"], r["observed"]): r["predicted"] for r in sparse.additive_ridge(rows, ["grp"]).collect()}
    want = told()
    assert not calls
    monkeypatch.setattr(sparse, "GATHERED", limit)
    got = told()
    assert len(calls) == 1 and got.keys() == want.keys() and len({v for v in got.values()}) > 5
    assert all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)


def test_parts_merge_across_batches(spark):
    """Parts of a group that straddle batches, and groups of one part between them."""
    r = np.random.default_rng(3)
    rows = [(f"g{i % 9}" if i % 3 else f"one{i}", float(a), float(b)) for i, (a, b) in enumerate(r.normal(0, 1, (90, 2)))] + [(None, 1.0, 2.0), (None, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "grp string, a double, y double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {x["grp"]: (x["_n"], np.array(x["_scatter"])) for x in linear.moments(df, ["grp"], ["a"], "y").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == {g for g, *_ in rows}
    for g, (n, scatter) in got.items():
        x = np.array([(a, y) for k, a, y in rows if k == g])
        assert n == len(x) and np.allclose(scatter.reshape(2, 2), (x - x.mean(0)).T @ (x - x.mean(0)))


def test_splits_of_a_study_deal_rows_once(spark, shifts, monkeypatch):
    """All seeds and splits come from one reading of the rows."""
    plans = []
    kept = supervised.stored
    monkeypatch.setattr(supervised, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    got = supervised.assays(shifts.filter("grp IS NOT NULL"), ["grp"], [1, 2], models=("mean",)).collect()
    assert len(got) == 2 * 2 * 2
    assert plans[0].count("Exchange hashpartitioning") == 1


def test_audits_deal_runs_once_and_rank_pairs_by_counts(spark, lines, monkeypatch):
    """Runs meet by one dealing of targets; ranks are of counted pairs, so that a model's rows never reach one task."""
    from driftlens.operators import gates, ranks

    r = np.random.default_rng(5)
    rows = [(m, f"t{i % 3}", f"v{i}", "ok" if i % 17 else "failed", float(r.integers(0, 6))) for m in ("a", "b") for i in range(120)]
    first = spark.createDataFrame(rows, "model_id string, target_id string, variant_id string, status string, score double")
    second = first.withColumn("score", F.when(F.col("variant_id") == "v5", float("nan")).otherwise(F.col("score") % 4))
    expected = spark.createDataFrame([*{(t, v) for _, t, v, *_ in rows if v != "v7"}, ("t9", "v1")], "target_id string, variant_id string")
    plans, sizes = [], []
    kept, dealt = gates.stored, ranks.stored
    monkeypatch.setattr(gates, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    every = gates._together({"one": first, "two": second}, expected)
    assert plans[0].count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(ranks, "stored", lambda df: sizes.append(df.count()) or dealt(df))
    got = {x["model_id"]: x for x in gates._agreement(every, "one", "two", ["model_id"]).collect()}
    assert max(sizes) < 20  # pairs of six values and four, not rows
    for m in ("a", "b"):
        x = np.array([(s, s % 4) for k, _, v, _, s in rows if k == m and v != "v5"])
        rank = [np.searchsorted(np.sort(c), c, "left") + (np.searchsorted(np.sort(c), c, "right") - np.searchsorted(np.sort(c), c, "left") + 1) / 2 for c in x.T]
        assert got[m]["n"] == 119 and got[m]["exact"] == (x[:, 0] == x[:, 1]).sum() and math.isclose(got[m]["rho"], np.corrcoef(*rank)[0, 1], rel_tol=1e-9)
    models = spark.createDataFrame([("a",), ("none",)], "model_id string")
    told = {(x["model_id"], x["target_id"]): (x["expected"], x["_one"]) for x in gates._covered(every, models, ("one",)).collect()}
    want = {(x["model_id"], x["target_id"]): (x["expected"], x["scored"]) for x in gates.target_coverage(first, expected, models).collect()}
    assert told == want and told["a", "t9"] == (1, 0)


def test_positions_are_drawn_where_their_group_is(spark):
    """The draws and sums of the long form, without a row a draw."""
    rows = [(g, i * (3 + 4 * k) % 23 if i % 9 else None, float(i * 37 % 11), float(i * (5 + k) % 13)) for k, g in enumerate(("g", "h", None)) for i in range(60)] + [("one", 1, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "grp string, position int, observed double, predicted double")
    made = nested.position_rank(df, ["grp"], repeats=20)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    ranked = df.select("grp", "position", *(metrics.average_rank(c, ["grp"]).alias(n) for c, n in (("observed", "_x"), ("predicted", "_y"))))
    x, y = F.col("_x"), F.col("_y")
    parts = {"_c": F.count(F.lit(1)), "_sx": F.sum(x), "_sy": F.sum(y), "_xx": F.sum(x * x), "_yy": F.sum(y * y), "_xy": F.sum(x * y)}
    places = ranked.groupBy("grp", "position").agg(*(v.alias(k) for k, v in parts.items()))
    sums = nested.drawn(places, ["grp"], "position", 20).groupBy("grp", "_rep").agg(*(F.sum(k).alias(k) for k in parts))
    spread = F.expr("(_xx - _sx * _sx / _c) * (_yy - _sy * _sy / _c)")
    long = nested.limits(sums.withColumn("_rho", F.when(spread > 1e-9, F.expr("_xy - _sx * _sy / _c") / F.sqrt(spread)).otherwise(0.0)), ["grp"], "_rho")
    told = lambda t: {r["grp"]: r[1:] for r in t.collect()}
    got, want = told(made), told(long)
    assert got.keys() == want.keys() == {"g", "h", "one"} and all(got[k] == pytest.approx(want[k]) for k in want) and got["g"] != got["h"]


def test_named_draws_are_those_of_the_long_form(spark):
    rows = [(p, a, m, i % 7 if (i, m) != (3, "u") else 8, float(i * 37 % 11), float(i * (5 + len(m)) % 13)) for p, a in (("p", "a"), ("p", "b"), ("q", "c")) for m in ("u", "vv") for i in range(30)]
    df = spark.createDataFrame(rows, "protein_id string, assay_id string, model_id string, position int, observed double, predicted double")
    by = ["protein_id", "assay_id"]
    ranked = df.select(*by, "model_id", "position", *(metrics.average_rank(c, [*by, "model_id"]).alias(n) for c, n in (("observed", "_x"), ("predicted", "_y"))))
    places = positions.gathered(ranked, by, "position", {m: F.col("model_id") == m for m in ("u", "vv")}).withColumn("_name", F.concat_ws("/", *by))
    got = {(r["assay_id"], m, i): v for r in positions.replicates(places, by, ["u", "vv"], 9, "1|position", named=True).collect() for m in ("u", "vv") for i, v in enumerate(r[m])}
    taken = resampling.times(df, by, "position", 9, 1, "position")
    want = ranked.join(taken, [*by, "position"]).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).groupBy("assay_id", "model_id", "_rep").agg(F.corr("_x", "_y").alias("v"))
    want = {(r["assay_id"], r["model_id"], r["_rep"]): r["v"] for r in want.collect()}
    assert got.keys() == want.keys() and len(got) == 54 and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_items_have_tasks_by_their_lines(spark, lines, monkeypatch):
    monkeypatch.setattr(bindings, "LINES", 500)
    assert bindings.scores(spark, lines).rdd.getNumPartitions() == 12


def test_draws_within_levels_are_spread_and_those_of_the_long_form(spark):
    """Copies are dealt by replicate and path, not by the few groups above; a repeated or null unit counts as before."""
    rows = [("m", f"f{i % 3}", f"f{i % 3}p{i % 2}", None if i == 7 else f"a{i}", float(i)) for i in range(40)] + [("m", "f0", "f0p0", "a0", 99.0), (None, "f", "p", "a", 1.0)]
    df = spark.createDataFrame(rows, "g string, f string, p string, a string, v double")
    got = nested.within(df, ["g"], ["f", "p", "a"], repeats=6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_path" in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning(_rep" in line)
    want = []
    units = lambda above: sorted({r[len(above) + 1] for r in rows if r[0] == "m" and r[1:len(above) + 1] == above}, key=lambda v: (v is not None, v))
    pick = lambda path, n: int(hashlib.md5(f"1|{path}".encode()).hexdigest()[:8], 16) % n
    for rep in range(6):
        state = [((), str(rep))]
        for _ in range(3):
            state = [((*above, units(above)[pick(f"{path}|{i}", len(units(above)))]), f"{path}|{i}") for above, path in state for i in range(len(units(above)))]
        want += [(rep, r[4]) for keys, _ in state if None not in keys for r in rows if r[:4] == ("m", *keys)]
    assert sorted((r["_rep"], r["v"]) for r in got.collect()) == sorted(want)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_many_jobs_read_is_written_once(spark, lines, monkeypatch):
    """No plan that later jobs repeat goes back to the lines."""
    tasks, sure = models._tasks(spark, lines), deeper._surest(spark, lines)
    assert tasks.count() > 0 and sure.count() > 0 and "lineitem" not in _plan(tasks) + _plan(sure)
    given = []
    monkeypatch.setattr(models.adapters, "score_panel", lambda a, targets, rows, *_: given.extend([targets, rows]) or (rows.limit(0).withColumn("score", F.lit(1.0)), targets.limit(0)))
    with pytest.raises(Exception):  # the stand-in's audit has no columns of its own
        models.io_score_panel(spark, lines)
    assert len(given) == 4 and not any("lineitem" in _plan(df) for df in given)
    assert "lineitem" not in _plan(ledgers.run_benchmark(spark, lines))


def test_a_paired_assay_is_dealt_once(spark, lines):
    assert "code#" not in "".join(p for p in _plan(panel_plans.j_paired_phenotypes(spark, lines)).splitlines() if "Exchange hashpartitioning" in p)


def test_proteins_of_a_summary_are_written(spark):
    runs = spark.range(40).select((F.col("id") % 2).alias("m"), (F.col("id") % 5).alias("p"), F.col("id").alias("a"), (F.col("id") * 7 % 11 / 3).alias("v"))
    made = panels.protein_summary(runs, ["m"], "p", "a", ["v"], repeats=20)
    assert "Range (" not in _plan(made) and {(r["n_assays"], r["n_proteins"]) for r in made.collect()} == {(20, 5)}


def test_outcome_tables_are_parsed_once_with_the_medians_of_their_rows(spark):
    rows = [("t", "p.Ala1Val", v, None) for v in (1.0, 4.0, 2.0, 9.0)] + [("t", "p.Ala1Gly", 5.0, None), ("t", "p.Ala1Leu", None, None), ("t", "nothing", 1.0, None), ("t", "p.Val1Ala", 1.0, None)]
    rows += [("t", "p.Ala1=", v, None) for v in (3.0, 1.0, 8.0)] + [("t", "p.Cys2=", 2.0, None)] + [("t", "p.Cys2Ter", v, None) for v in (7.0, 5.0, 9.0)] + [("u", "nothing", 1.0, -1)]
    df = spark.createDataFrame(rows, "urn string, code string, score double, orientation int").withColumn("sequence", F.lit("AC"))
    variants, audit = cohorts.canonical(df, ["urn"], "code", "score", "sequence", "orientation", controls=3)
    assert "Aggregate" not in _plan(audit) and "LocalTableScan" not in _plan(variants)
    # synonymous 1, 2, 3, 8: 2.5; termination 5, 7, 9: 7
    assert {r["variant"]: (r["raw_score"], r["source_rows"], r["score"]) for r in variants.collect()} == {"A1V": (3.0, 4, -3.0), "A1G": (5.0, 1, -5.0)}
    told = {r["urn"]: r.asDict() for r in audit.collect()}
    assert [told["t"][c] for c in ("input_rows", "parsed_rows", "invalid_codes", "reference_mismatches", "synonymous_controls", "termination_controls", "direction", "variants", "repeated_rows")] == [15, 12, 1, 1, 4, 3, -1, 2, 4]
    assert [told["u"][c] for c in ("input_rows", "parsed_rows", "direction", "variants", "repeated_rows")] == [1, 0, -1, 0, 0]


def test_split_runs_stay_where_their_assay_is(spark, lines):
    assert _plan(studies._split_runs(spark, lines)).count("Exchange hashpartitioning") == 1


def test_best_single_leaves_rows_where_their_group_is(spark, lines):
    """Train and test rows are dealt once each, by assay; the chosen model is no key that deals them again."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = deeper.ml_span(spark, lines)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        rows = bindings.scores(spark, lines).withColumn("role", F.when(F.col("position") % 5 == 2, "test").otherwise("train"))
        best = {}
        for r in sorted(metrics.regression(rows.filter("role = 'train'"), ["assay_id", "model_id"]).collect(), key=lambda r: (-round(r["spearman"], 9), r["model_id"])):
            best.setdefault(r["assay_id"], r["model_id"])
        want = {(a, m, n) for a, m, n in rows.filter("assay_id IS NOT NULL AND role = 'test' AND NOT isnan(observed) AND NOT isnan(predicted) AND predicted IS NOT NULL AND observed IS NOT NULL").groupBy("assay_id", "model_id").count().collect() if best.get(a) == m}
        assert {(r["assay_id"], r["model_id"], r["n"]) for r in made.collect()} == want and want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_nested_means_read_their_input_once_and_draw_in_the_rows_of_groups(spark):
    """Draws of leaves are no rows that meet; values are those of the rows that `within` gives."""
    seen = spark.sparkContext.accumulator(0)
    rows = [(m, f"F{i % 4}", f"P{i % 7}" if i % 11 else None, f"A{i}" if i % 13 else None, None if i % 10 == 0 else float(i * 37 % 23)) for m in ("a", "b") for i in range(60)]

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "m string, f string, p string, a string, v double"
    plain = spark.createDataFrame(rows, schema)
    for levels in (["f", "p", "a"], ["a"]):
        seen.value = 0
        got = {r["m"]: r.asDict() for r in nested.nested_mean(plain.mapInArrow(counted, schema), ["m"], levels, "v", 20).collect()}
        assert seen.value == len(rows)
        leaves = plain.groupBy("m", *levels).agg(F.avg("v").alias("_v"))
        drawn = nested.within(leaves, ["m"], levels, 20).groupBy("m", "_rep").agg(F.avg("_v").alias("_v"))
        want = {r["m"]: r.asDict() for r in nested.limits(drawn, ["m"], "_v").collect()}
        assert got.keys() == want.keys() == {"a", "b"}
        for m in want:
            assert all(math.isclose(got[m][c], want[m][c], rel_tol=1e-12) for c in ("lower", "upper", "p"))


@pytest.mark.parametrize(("name", "rounds"), [("ml_pooled", {(150, 31)}), ("run_group_holdout", {(150, 31)}), ("ml_transport", {(250, 15)}), ("ml_param_search", {(250, 15), (500, 15), (300, 31)})])
def test_registered_fits_take_all_rounds(spark, lines, tmp_path, monkeypatch, name, rounds):
    """What a registered query gives to boosting are the library's rounds and leaves (run here with one round)."""
    from driftlens.operators import boosting

    fit, seen = boosting.fit, set()

    def watched(*args, **settings):
        seen.add((settings.get("rounds", 150), settings.get("leaves", 31)))
        return fit(*args, **settings | {"rounds": 1})

    monkeypatch.setattr(boosting, "fit", watched)
    spark.read.parquet(f"{lines}/lineitem.parquet").fillna(1.0).filter("l_suppkey IS NOT NULL").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert getattr(models, name)(spark, str(tmp_path)).count() > 0 and seen == rounds
