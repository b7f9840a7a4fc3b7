"""Queries of codes, identifiers, contracts, features, joins and fits, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import codes, names
from driftlens.functions.codes import RESIDUES
from driftlens.operators import contracts, features, fits, intervals, joins, metrics, policies, ranks, splits, summaries
from driftlens.operators.storage import stored
from driftlens.plans.audits import _TOP, _chosen
from driftlens.plans.bindings import items, scores, variants
from driftlens.plans.studies import _DRAW, _FLAT, _ITEMS, _POSITION, _RUNS, _SCORES, _TASK_SQL, TASK, _ranked, _round, _split_runs

_INV = {v: k for k, v in names.THREE.items()}
_SEQ = RESIDUES * 3


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


# scalars

def x_hgvs(spark, d):
    three = names.literal_map(_INV)
    p = F.col("position")
    alt = F.when(p % 13 == 0, "Ter").when(p % 17 == 0, "=").when(p % 19 == 0, "Xaa").otherwise(three[F.col("alt")])
    m = names.hgvs(F.concat(F.lit("p."), three[F.col("ref")], _text(p), alt))
    return items(spark, d).select("assay_id", "code", m["ref"].alias("ref"), m["pos"].alias("pos"), m["alt"].alias("alt"))


def x_flexible_code(spark, d):
    three = names.literal_map(_INV)
    text = F.concat(F.lower(three[F.col("ref")]), F.lit(" "), _text(F.col("position")), F.lit("_"), F.when(F.col("position") % 7 == 0, "Xyz").otherwise(three[F.col("alt")]))
    return items(spark, d).select("assay_id", "code", names.flexible_code(text, F.lit(_SEQ)).alias("found"))


def x_doi(spark, d):
    prefix = F.element_at(F.array(*map(F.lit, ("https://doi.org/", "doi:", "http://dx.doi.org/", ""))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return _t(spark, d, "supplier").select("s_suppkey", names.doi(F.concat(F.lit(" "), prefix, F.lit("10.1/"), "s_name", F.lit("/., ").substr(1, 3))).alias("doi"))


def x_source_id(spark, d):
    k = _text(F.col("p_partkey") % 10)
    kind = F.col("p_partkey") % 4
    value = F.when(kind == 0, F.concat(k, F.lit("abc_d_"), _text(F.col("p_partkey")))).when(kind == 1, F.concat(F.lit("set_"), k, F.lit("xyz"))).when(kind == 2, F.concat(F.lit("set_P"), k, F.lit("ABC"), k)).otherwise("none")
    return _t(spark, d, "part").select("p_partkey", names.source_id(value).alias("source_id"))


def x_mutation_group(spark, d):
    return variants(spark, d).select("l_orderkey", names.mutation_group(F.col("code")).alias("grp"))


def x_protein_id(spark, d):
    k = F.col("c_custkey") % 4
    gene, name, acc = F.when(k == 0, F.col("c_mktsegment")), F.when(k == 1, F.concat(F.lit("  "), F.col("c_name"), F.lit(" domain"))).otherwise(F.lit(" ")), F.when(k == 2, F.lit("Q1"))
    return _t(spark, d, "customer").select("c_custkey", names.protein_id(gene, name, acc, F.concat(F.lit("urn:"), _text(F.col("c_custkey")))).alias("protein_id"))


def x_task_id(spark, d):
    return scores(spark, d).select(F.concat_ws("::", "family_id", "protein_id", "assay_id", "model_id").alias("task_id")).distinct()


def x_cutoff_end(spark, d):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "yyyy")).when(k == 1, F.date_format(day, "yyyy-MM")).when(k == 2, F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd"))).otherwise("soon")
    return _t(spark, d, "orders").select("o_orderkey", _text(names.cutoff_end(text)).alias("cutoff"))


def x_log1p(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", F.round(names.log1p(F.col("s_acctbal")), 9).alias("value"))


def _lengths(spark, d):
    return _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 4000 + 1).cast("int").alias("length")).withColumn("w", names.windows(F.col("length")))


def x_windows(spark, d):
    chosen = names.window_of(F.floor(F.col("length") / 2).cast("int") + 1, F.col("w"))["start"]
    rows = _lengths(spark, d).withColumn("middle", chosen)
    return rows.select("p_partkey", "middle", F.explode("w").alias("s")).select("p_partkey", "middle", "s.start", "s.stop")


def x_positions(spark, d):
    return variants(spark, d).select("l_orderkey", F.array_join(F.transform(codes.positions(codes.parse(F.col("code"))), lambda p: p.cast("string")), ";").alias("positions"))


def _own_sequence() -> Column:
    """The sequence of an order's protein; every seventh protein has another residue at 5."""
    return F.when(F.col("l_orderkey") % 7 == 0, F.lit(_SEQ[:4] + "W" + _SEQ[5:])).otherwise(F.lit(_SEQ))


def x_validate_reference(spark, d):
    return variants(spark, d).select("l_orderkey", codes.agrees(codes.parse(F.col("code")), _own_sequence()).alias("agrees"))


def x_apply_variant(spark, d):
    return variants(spark, d).select("l_orderkey", codes.apply_to(codes.parse(F.col("code")), F.lit(_SEQ)).alias("sequence"))


# contracts

def _targets(spark, d):
    k = F.col("s_suppkey")
    sequence = F.concat(F.substr(F.lit(_SEQ), F.lit(1), (k % 60 + 1).cast("int")), F.when(k % 11 == 0, "X").otherwise(""))
    rows = _t(spark, d, "supplier").select("s_suppkey", sequence.alias("sequence"))
    return rows.select("s_suppkey", F.concat(F.lower("sequence"), F.when(k % 2 == 0, "*").otherwise("")).alias("sequence"), F.when(k % 5 == 0, "0").otherwise(F.sha2("sequence", 256)).alias("sha"), (F.length("sequence") + F.when(k % 7 == 0, 1).otherwise(0)).alias("length"))


def p_sequence_digest(spark, d):
    return _targets(spark, d).select("s_suppkey", codes.digest(F.col("sequence")).alias("digest"))


def p_validate_targets(spark, d):
    return contracts.target_faults(_targets(spark, d), "sequence", "sha", "length").select("s_suppkey", "fault")


def _measured(spark, d):
    code = F.concat(F.lit("A"), _text(F.col("l_linenumber")), F.when(F.col("l_linestatus") == "O", "*").otherwise("C"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("counts"), (F.col("l_returnflag") == "R").alias("indel"), code.alias("code"), (F.col("l_linenumber") - 1).alias("mutations"), F.when(F.col("l_partkey") % 3 == 0, "EP").when(F.col("l_partkey") % 3 == 1, "SSVL").alias("library"))


def p_quality_filter(spark, d):
    return contracts.quality(_measured(spark, d), "counts", "indel", "code", 20000).select("l_orderkey", "l_linenumber", "code")


def p_summarize(spark, d):
    return contracts.summarize(_measured(spark, d), "mutations", "indel", "library")


def p_contract(spark, d):
    rows = _t(spark, d, "lineitem").withColumn("l_linenumber", F.when(F.col("l_partkey") % 97 != 0, F.col("l_linenumber") % 4))
    return contracts.contract(rows, ["l_orderkey", "l_linenumber", "l_quantity"], ["l_orderkey", "l_linenumber"])


def p_finite_rows(spark, d):
    k = F.col("event_id")
    text = F.when(k % 7 == 0, "bad").when(k % 11 == 0, "NaN").when(k % 13 == 0, "Infinity").otherwise(_text(F.col("value")))
    return _t(spark, d, "events").withColumn("text", text).filter(metrics.finite("text")).select("event_id")


def p_publication_dates(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderstatus").alias("panel"), _text(F.col("o_custkey")).alias("target"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return contracts.publication_dates(rows, "panel", "target", "date")


def p_direction_rule(spark, d):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, ("set_km_1", "akmb", "Km", "kcat"))), (k % 4 + 1).cast("int"))
    category = F.element_at(F.array(*map(F.lit, ("activity", "selectivity", "activity", "other", "activity"))), (k % 5 + 1).cast("int"))
    return _t(spark, d, "part").select("p_partkey", contracts.direction(name, category).alias("direction"))


def p_complete_tasks(spark, d):
    rows = _t(spark, d, "lineitem").select("l_partkey", _text(F.col("l_linenumber")).alias("model"))
    return contracts.complete_tasks(rows, ["l_partkey"], "model", ["1", "2", "3", "4"])


def p_budget_check(spark, d):
    ledger = _t(spark, d, "orders").select(_text(F.floor(F.col("o_orderkey") / 2)).alias("job"), F.when(F.col("o_orderkey") % 50 != 0, F.round("o_totalprice")).alias("cost"))
    return contracts.budget(ledger, "job", "cost", 1000.0, 5e9)


def a_eligibility(spark, d):
    place = F.col("l_partkey") % 60 + 1
    ref = F.substr(F.lit(_SEQ), place.cast("int"), F.lit(1))
    alt = F.substr(F.lit(_SEQ), ((place + F.col("l_linenumber")) % 20 + 1).cast("int"), F.lit(1))
    code = F.when(F.col("l_partkey") % 401 == 0, "B12A").otherwise(F.concat(ref, _text(place), alt))
    rows = _t(spark, d, "lineitem").select("l_suppkey", code.alias("code"), F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("value"))
    m = codes.parse(F.col("code"))
    return contracts.eligibility(rows, ["l_suppkey"], "code", "value", m.isNotNull(), codes.agrees(m, F.lit(_SEQ)))


def set_intersection(spark, d):
    return contracts.shared_by_all(_t(spark, d, "lineitem"), "l_partkey", "l_linenumber")


def w_linspace_sample(spark, d):
    return contracts.linspace_sample(items(spark, d).select("assay_id", "code"), ["assay_id"], "code", 100)


def w_stratified_hash(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 97).alias("size"))
    return contracts.stratified_hash(rows, "c_custkey", "size", "s|", 30)


# features and fits

def f_biophysical(spark, d):
    # adding 0 turns a negative zero into a plain one
    return features.biophysical(variants(spark, d)).select("l_orderkey", *((F.round(k, 6) + 0.0).alias(k) for k in features.NAMES))


def f_additive(spark, d):
    return features.additive(variants(spark, d), ["l_orderkey"])


def m_score_shape(spark, d):
    rows = scores(spark, d).withColumn("predicted", F.when(~((F.col("model_id") == "tax") & (F.col("position") % 11 == 0)), F.col("predicted")))
    return _round(features.score_shape(rows, ["assay_id"], "model_id", "code", "predicted"), "score_dispersion", "score_tail_separation", "missing_fraction", "ensemble_agreement", "ensemble_disagreement", digits=6)


def f_other_family_similarity(spark, d):
    name = lambda c: F.concat(F.lit("P"), _text(F.col(c) % 40))
    edges = _t(spark, d, "lineitem").select(name("l_suppkey").alias("a"), name("l_partkey").alias("b"), F.col("l_extendedprice").alias("similarity"))
    proteins = _t(spark, d, "supplier").select(name("s_suppkey").alias("protein_id"), (F.col("s_suppkey") % 40 % 15).alias("family_id")).distinct()
    return features.other_family_similarity(edges, proteins)


def f_wide_shapes(spark, d):
    means = scores(spark, d).groupBy(*TASK).agg(F.avg("predicted").alias("mean"), F.max("predicted").alias("top"))
    made = features.wide(means, ["assay_id"], "model_id", ["qty", "disc", "tax"], ["mean", "top"])
    return _round(made, *made.columns[1:], digits=6)


def _positions_split(spark, d):
    return splits.position(items(spark, d), ["assay_id"])


def ml_mean(spark, d):
    return _round(fits.mean(_positions_split(spark, d), ["assay_id"]).select("assay_id", "code", "predicted"), "predicted", digits=4)


def ml_biophysical_ridge(spark, d):
    """Ridge on the fifteen features, positions left out. Held against a closed form in tests."""
    rows = features.biophysical(_positions_split(spark, d).select("assay_id", "code", "observed", "role"))
    return fits.ridge(rows, ["assay_id"], features.NAMES).select("assay_id", "code", "observed", "predicted")


def run_benchmark(spark, d):
    """Two fits on three splits of every assay, with their metrics."""
    source = items(spark, d).drop("qty", "disc", "tax")
    by = ["assay_id", "split"]
    made = {"random": lambda r: splits.random_item(r, ["assay_id"]), "position": lambda r: splits.position(r, ["assay_id"]), "modulo": lambda r: splits.modulo(r, 2)}
    rows = source
    for name, split in made.items():
        rows = split(rows).withColumnRenamed("role", f"_{name}")
    # all splits on one dealing, features once a code, written once: both fits read train and test rows
    full = stored(features.biophysical(rows))
    full = full.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(n).alias("split"), F.col(f"_{n}").alias("role")) for n in made)))).select("*", "_s.*").drop("_s", *(f"_{n}" for n in made))
    rows = full.select("assay_id", "split", "code", "observed", "role")
    columns = ["assay_id", "split", "code", "observed", "predicted", "model"]
    predicted = fits.mean(rows, by).withColumn("model", F.lit("mean")).select(*columns).unionByName(fits.ridge(full, by, features.NAMES).withColumn("model", F.lit("biophysical_ridge")).select(*columns))
    return metrics.regression(predicted, [*by, "model"])


# splits, intervals, windows

def sp_bridge_rule(spark, d):
    rows = variants(spark, d).select("l_orderkey", (F.col("l_orderkey") % 10).alias("g"), "code", codes.positions(codes.parse(F.col("code"))).alias("places"))
    held = spark.range(10).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(2), F.lit(60), F.lit(5))).alias("position"))
    return splits.bridge(rows, held, ["g"]).select("l_orderkey", "code", "role")


def sp_group_shuffle(spark, d):
    return splits.group_shuffle(items(spark, d).select("family_id", "assay_id", "code"), ["family_id"], "assay_id")


def sp_leave_panel(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("panel"))
    return splits.leave_panel(rows, "panel", [0, 1, 2]).groupBy("left_out", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


def m_interval_coverage(spark, d):
    inside = (F.abs(F.col("observed") - F.col("predicted")) <= 20000.0).cast("double")
    return _round(scores(spark, d).groupBy(*TASK).agg(F.avg(inside).alias("coverage")), "coverage")


def _scored_split(spark, d):
    return splits.position(scores(spark, d), ["assay_id"])


def c_standard(spark, d):
    return _round(intervals.fitted_radius(_scored_split(spark, d), TASK, "code").select(*TASK, "code", "lower", "upper"), "lower", "upper", digits=4)


def w_position_gap(spark, d):
    return intervals.position_gap(_positions_split(spark, d).filter("role = 'train'"), ["assay_id"])


def c_distance(spark, d):
    role = F.when(F.col("position") % 5 == 2, "test").when(F.col("position") % 5 == 4, "calibration").otherwise("fit")
    return _round(intervals.distance_scaled(scores(spark, d).withColumn("role", role), TASK, "code").select(*TASK, "code", "half_width"), "half_width", digits=4)


def w_empirical_percentile(spark, d):
    rows = scores(spark, d)
    return _round(metrics.empirical_percentile(rows.filter("position <= 40").select(*TASK, "code", "predicted"), rows.filter("position > 40").select(*TASK, "code", "predicted"), TASK, "code", "predicted"), "percentile")


def o_top_k(spark, d):
    order = metrics.Window.partitionBy(*TASK).orderBy(F.desc("predicted"), "code")
    return scores(spark, d).withColumn("place", F.row_number().over(order)).filter("place <= 5").select(*TASK, "code", "place")


def w_argmax(spark, d):
    return policies.choose(scores(spark, d), TASK, "code", "predicted", "observed").select(*TASK, "code", F.round("regret", 4).alias("regret"))


def w_ntile_blocks(spark, d):
    order = metrics.Window.partitionBy("assay_id").orderBy("position")
    return items(spark, d).select("assay_id", "position").distinct().withColumn("block", F.ntile(5).over(order))


def m_repeat_classifier(spark, d):
    rows = _t(spark, d, "events").select("event_type", (F.col("event_id") % 3 == 0).cast("int").alias("label"), (F.pmod(F.floor("value"), F.lit(10)) / 10.0).alias("score"))
    return _round(ranks.auc(rows, ["event_type"], "label", "score"), "auc", "brier", "accuracy", "balanced_accuracy", "majority_rate")


# joins

def m_safe_spearman(spark, d):
    return _round(joins.rank_correlation(items(spark, d), ["assay_id"], "qty", "observed", 3), "rho")


def j_parity(spark, d):
    return _round(ranks.correlation(scores(spark, d), ["protein_id", "model_id"], "predicted", "observed"), "rho")


def j_many_to_one_complete(spark, d):
    people = _t(spark, d, "customer").filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.many_to_one(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), people, ["o_custkey"], "c_mktsegment")


def j_semi_flags(spark, d):
    late = _t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.flag(_t(spark, d, "customer").select("c_custkey"), late, ["c_custkey"], "has_closed")


def j_three_state_overlap(spark, d):
    rows = _t(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderpriority")).alias("note"))
    known = _t(spark, d, "orders").filter("substr(o_orderpriority, 1, 1) < '3'").select(F.col("o_orderpriority").alias("note"))
    return joins.three_state(rows, known, "o_custkey", "note")


_MODELS = [("m1", "known", None), ("m2", "clean", None), ("m3", "Possible", "never"), ("m4", None, "1995"), ("m5", "clean", "1996-06"), ("m6", None, None)]


def j_exposure_cross(spark, d):
    first = _t(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("published"))
    targets = _t(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("target_id"), (F.col("c_custkey") % 5 != 0).alias("unseen"), "published")
    return joins.exposure(targets, spark.createDataFrame(_MODELS, "model_id string, declared string, cutoff string"))


def j_interval_overlap(spark, d):
    start = F.col("event_id") % 50 + 1
    spans = _t(spark, d, "events").filter("user_id IS NOT NULL AND value IS NOT NULL").select("user_id", "event_id", "event_type", start.alias("a"), (start + F.pmod(F.floor("value"), F.lit(30))).alias("b"))
    left = spans.filter("event_type = 'click'").select("user_id", "event_id", "a", "b")
    right = spans.filter("event_type <> 'click'").select("user_id", F.col("event_id").alias("other_id"), F.col("a").alias("c"), F.col("b").alias("d"))
    return _round(joins.interval_overlap(left, right, ["user_id"]).select("event_id", "other_id", "overlap", "share", "qualifies"), "share")


def j_clique_pairs(spark, d):
    return joins.group_pairs(_t(spark, d, "orders"), "o_custkey", "o_orderkey")


def j_offset_mapping(spark, d):
    k = F.col("s_suppkey")
    text = F.concat(F.substr(F.lit(_SEQ), (k % 17 + 1).cast("int"), F.lit(12)), F.substr(F.lit(RESIDUES), (k % 20 + 1).cast("int"), F.lit(3)))
    places = lambda c: F.posexplode(F.split(c, "")).alias("place", "residue")
    rows = _t(spark, d, "supplier")
    return joins.region_offset(rows.select("s_suppkey", places(text)), rows.select("s_suppkey", places(F.lit(_SEQ))), "s_suppkey")


def j_paired_feature_sets(spark, d):
    means = scores(spark, d).groupBy(*TASK).agg(F.avg("predicted").alias("mean"))
    return _round(joins.paired(means, ["assay_id"], "model_id", "disc", "qty", ["mean"]), "disc_mean", "qty_mean", "mean_delta", digits=4)


# summaries

def _gaps(spark, d):
    return summaries.gaps(_split_runs(spark, d), ["protein_id", *TASK], "split", "spearman", "random", "position")


def s_gaps(spark, d):
    return _round(_gaps(spark, d).select("protein_id", *TASK, "spearman_gap"), "spearman_gap")


def s_gap_summary(spark, d):
    return _round(summaries.distribution(_gaps(spark, d), ["model_id"], "spearman_gap"), "mean", "sd", "min", "p05", "p95", "max")


def s_multi_summary(spark, d):
    return _round(summaries.multi(_gaps(spark, d), ["model_id"], "protein_id", "spearman_gap"), "mean", "median", "positive_share")


def s_model_panel(spark, d):
    return _round(_chosen(spark, d).groupBy("model_id").agg(F.count(F.lit(1)).alias("tasks"), F.avg("gain").alias("mean_gain"), F.avg("regret").alias("mean_regret"), F.avg((F.col("gain") <= 0).cast("double")).alias("failure")), "mean_gain", "mean_regret", "failure", digits=6)


def pl_priors(spark, d):
    gains = metrics.top_selection(scores(spark, d), TASK, "code")
    return _round(gains.groupBy("model_id").agg(F.avg("gain_sd").alias("prior")), "prior", digits=6)


def pl_regret(spark, d):
    return _round(_chosen(spark, d).groupBy(F.lit("chosen").alias("policy")).agg(F.avg("regret").alias("regret")), "regret", digits=6)


def s_cluster(spark, d):
    """Sizes of the groups of orders by customer: groups, singles, largest."""
    return summaries.clusters(_t(spark, d, "orders"), "o_custkey", "o_orderkey")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        x_hgvs, x_flexible_code, x_doi, x_source_id, x_mutation_group, x_protein_id, x_task_id, x_cutoff_end, x_log1p, x_windows, x_positions, x_validate_reference, x_apply_variant,
        p_sequence_digest, p_validate_targets, p_quality_filter, p_summarize, p_contract, p_finite_rows, p_publication_dates, p_direction_rule, p_complete_tasks, p_budget_check, a_eligibility,
        set_intersection, w_linspace_sample, w_stratified_hash, f_biophysical, f_additive, m_score_shape, f_other_family_similarity, f_wide_shapes, ml_mean, ml_biophysical_ridge, run_benchmark,
        sp_bridge_rule, sp_group_shuffle, sp_leave_panel, m_interval_coverage, c_standard, w_position_gap, c_distance, w_empirical_percentile, o_top_k, w_argmax, w_ntile_blocks, m_repeat_classifier,
        m_safe_spearman, j_parity, j_many_to_one_complete, j_semi_flags, j_three_state_overlap, j_exposure_cross, j_interval_overlap, j_clique_pairs, j_offset_mapping, j_paired_feature_sets,
        s_gaps, s_gap_summary, s_multi_summary, s_model_panel, pl_priors, pl_regret, s_cluster,
    )
}


# SQL

_THREE_SQL = "MAP {" + ", ".join(f"'{a}': '{t}'" for t, a in names.THREE.items()) + "}"
_CLASS_SQL = "MAP {" + ", ".join(f"'{a}': '{c}'" for a, c in names.RESIDUE_CLASS.items()) + "}"
_LP = f"""lv AS (SELECT l_orderkey, l_partkey % 60 + 1 AS position, substr('{RESIDUES}', (l_partkey % 60 % 20 + 1)::INT, 1) AS ref,
  substr('{RESIDUES}', ((l_partkey % 60 + 1 + l_linenumber) % 20 + 1)::INT, 1) AS alt FROM lineitem),
lp AS (SELECT l_orderkey, position, any_value(ref) AS ref, min(alt) AS alt FROM lv WHERE ref <> alt GROUP BY ALL),
multi AS (SELECT l_orderkey, string_agg(ref || position || alt, '/' ORDER BY position) AS code, count(*) AS n FROM lp GROUP BY 1)"""
_TARGETS = f"""raw AS (SELECT s_suppkey, substr('{_SEQ}', 1, (s_suppkey % 60 + 1)::INT) || CASE WHEN s_suppkey % 11 = 0 THEN 'X' ELSE '' END AS q FROM supplier)"""
_PROP = "prop(aa, h, v, c, ar, po) AS (VALUES " + ", ".join(f"('{a}', {features.HYDROPATHY[a]}::DOUBLE, {features.VOLUME[a]}::DOUBLE, {features.CHARGE.get(a, 0.0)}::DOUBLE, {int(a in features.AROMATIC)}, {int(a in features.POLAR)})" for a in RESIDUES) + ")"
_MEASURED = """m AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS counts, l_returnflag = 'R' AS indel, 'A' || l_linenumber || CASE WHEN l_linestatus = 'O' THEN '*' ELSE 'C' END AS code,
  l_linenumber - 1 AS mutations, CASE l_partkey % 3 WHEN 0 THEN 'EP' WHEN 1 THEN 'SSVL' END AS library FROM lineitem)"""
_RHO = """CASE WHEN count(*) >= {} AND max(ra) > min(ra) AND max(rb) > min(rb) THEN corr(ra, rb) END"""


def _pair_ranks(source: str, by: str, a: str, b: str) -> str:
    return f"""rk AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY {a}) + (count(*) OVER (PARTITION BY {by}, {a}) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY {by} ORDER BY {b}) + (count(*) OVER (PARTITION BY {by}, {b}) - 1) / 2.0::DOUBLE AS rb FROM {source})"""


_TRAIN_RADIUS = f"""res AS (SELECT s.*, count(*) OVER w AS n, row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY abs(observed - predicted), code) AS i FROM scores s ANTI JOIN held h ON s.assay_id = h.assay_id AND s.position = h.position WINDOW w AS (PARTITION BY {_TASK_SQL})),
rad AS (SELECT {_TASK_SQL}, abs(observed - predicted) AS radius FROM res WHERE i = least(n, ceil((n + 1) * 0.8::DOUBLE)))"""
_GAPS = f"""{_RUNS}, gaps AS (SELECT protein_id, {_TASK_SQL}, max(spearman) FILTER (split = 'random') - max(spearman) FILTER (split = 'position') AS gap FROM runs GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "x_hgvs": f"""WITH items AS ({_ITEMS}) SELECT assay_id, code, CASE WHEN ok THEN ref END AS ref, CASE WHEN ok THEN position::INTEGER END AS pos,
  CASE WHEN ok THEN CASE WHEN position % 13 = 0 THEN '*' WHEN position % 17 = 0 THEN ref ELSE alt END END AS alt FROM (SELECT *, position % 19 <> 0 OR position % 13 = 0 OR position % 17 = 0 AS ok FROM items)""",
    "x_flexible_code": f"WITH items AS ({_ITEMS}) SELECT assay_id, code, CASE WHEN position % 7 <> 0 THEN code END AS found FROM items",
    "x_doi": "SELECT s_suppkey, lower('10.1/' || s_name) AS doi FROM supplier",
    "x_source_id": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'chain:' || p_partkey % 10 || 'ABC:D' WHEN 1 THEN 'structure:' || p_partkey % 10 || 'XYZ'
  WHEN 2 THEN 'accession:P' || p_partkey % 10 || 'ABC' || p_partkey % 10 END AS source_id FROM part""",
    "x_mutation_group": f"""WITH {_LP}, k AS (SELECT {_CLASS_SQL} AS m) SELECT multi.l_orderkey, CASE WHEN n = 1 THEN m[substr(code, 1, 1)] || '>' || m[substr(code, -1)] ELSE 'multiple' END AS grp FROM multi, k""",
    "x_protein_id": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_name WHEN 2 THEN 'Q1' ELSE 'urn:' || c_custkey END AS protein_id FROM customer",
    "x_task_id": f"WITH {_SCORES} SELECT DISTINCT family_id || '::' || protein_id || '::' || assay_id || '::' || model_id AS task_id FROM scores",
    "x_cutoff_end": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') || '-12-31' WHEN 1 THEN last_day(o_orderdate)::VARCHAR WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS cutoff FROM orders""",
    "x_log1p": "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN round(ln(1 + s_acctbal), 9) END AS value FROM supplier",
    "x_windows": """WITH l AS (SELECT p_partkey, (p_partkey * 37 % 4000 + 1)::INTEGER AS n FROM part),
s AS (SELECT p_partkey, n, unnest(range(0, n - 1022 + 1, 766)) AS a FROM l WHERE n > 1022 UNION SELECT p_partkey, n, n - 1022 FROM l WHERE n > 1022 UNION SELECT p_partkey, n, 0 FROM l WHERE n <= 1022),
w AS (SELECT p_partkey, a, least(a + 1022, n) AS b, n // 2 AS mid FROM s),
m AS (SELECT p_partkey, a, row_number() OVER (PARTITION BY p_partkey ORDER BY least(mid - a, b - 1 - mid) DESC, a) AS i FROM w WHERE a <= mid AND mid < b)
SELECT w.p_partkey, m.a::INTEGER AS middle, w.a::INTEGER AS start, w.b::INTEGER AS stop FROM w JOIN m ON w.p_partkey = m.p_partkey AND m.i = 1""",
    "x_positions": f"WITH {_LP} SELECT l_orderkey, string_agg(position::VARCHAR, ';' ORDER BY position) AS positions FROM lp GROUP BY 1",
    "x_validate_reference": f"WITH {_LP} SELECT l_orderkey, NOT (l_orderkey % 7 = 0 AND bool_or(position = 5)) AS agrees FROM lp GROUP BY 1",
    "x_apply_variant": f"""WITH {_LP}, p AS (SELECT DISTINCT l_orderkey, i FROM lp, range(1, 61) r(i))
SELECT p.l_orderkey, string_agg(coalesce(lp.alt, substr('{_SEQ}', i::INT, 1)), '' ORDER BY i) AS sequence FROM p LEFT JOIN lp ON p.l_orderkey = lp.l_orderkey AND lp.position = i GROUP BY 1""",
    "p_sequence_digest": f"WITH {_TARGETS} SELECT s_suppkey, sha256(q) AS digest FROM raw",
    "p_validate_targets": f"""WITH {_TARGETS} SELECT s_suppkey, concat_ws(';', CASE WHEN s_suppkey % 11 = 0 THEN 'residues' END, CASE WHEN s_suppkey % 7 = 0 THEN 'length' END, CASE WHEN s_suppkey % 5 = 0 THEN 'digest' END) AS fault FROM raw""",
    "p_quality_filter": f"WITH {_MEASURED} SELECT l_orderkey, l_linenumber, code FROM m WHERE counts >= 20000 AND NOT indel AND NOT contains(code, '*')",
    "p_summarize": f"""WITH {_MEASURED} SELECT count(*) AS rows, count(*) FILTER (mutations = 0) AS wild_type_rows, count(*) FILTER (mutations <> 0 AND NOT indel) AS substitution_rows, count(*) FILTER (indel) AS indel_rows,
  count(*) FILTER (library = 'EP') AS ep_rows, count(*) FILTER (library = 'SSVL') AS ssvl_rows FROM m""",
    "p_contract": """WITH k AS (SELECT l_orderkey, CASE WHEN l_partkey % 97 <> 0 THEN l_linenumber % 4 END AS x, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS repeated_keys, coalesce(sum(n) FILTER (x IS NULL), 0)::BIGINT AS null_keys FROM k""",
    "p_finite_rows": "SELECT event_id FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND value IS NOT NULL",
    "p_publication_dates": """WITH t AS (SELECT o_orderstatus AS panel, o_custkey::VARCHAR AS target, min(strftime(o_orderdate, '%Y-%m-%d')) AS published FROM orders GROUP BY ALL)
SELECT * FROM t UNION ALL SELECT panel, '*', min(published) FROM t GROUP BY 1""",
    "p_direction_rule": """SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 2, 4) THEN CASE WHEN p_partkey % 4 IN (0, 2) THEN -1 ELSE 1 END END::INTEGER AS direction FROM part""",
    "p_complete_tasks": "SELECT l_partkey, count(DISTINCT l_linenumber) FILTER (l_linenumber <= 4) AS models, count(DISTINCT l_linenumber) FILTER (l_linenumber <= 4) = 4 AS complete FROM lineitem GROUP BY 1",
    "p_budget_check": """WITH j AS (SELECT o_orderkey // 2 AS job, count(*) AS n, coalesce(sum(round(o_totalprice)) FILTER (o_orderkey % 50 <> 0 AND o_totalprice >= 0), 0) AS cost, count(*) FILTER (o_orderkey % 50 = 0 OR o_totalprice IS NULL OR o_totalprice < 0) AS bad FROM orders GROUP BY 1),
s AS (SELECT sum(n)::BIGINT AS jobs, sum(cost) AS spent, (count(*) FILTER (n > 1) + sum(bad))::BIGINT AS faults FROM j)
SELECT jobs, spent, spent + 1000 AS projected, CASE WHEN (spent + 1000) / 5e9 >= 0.9 THEN '90%' WHEN (spent + 1000) / 5e9 >= 0.75 THEN '75%' WHEN (spent + 1000) / 5e9 >= 0.5 THEN '50%' ELSE 'none' END AS alert, spent + 1000 <= 5e9 AS permitted, faults FROM s""",
    "a_eligibility": f"""WITH r AS (SELECT l_suppkey, l_partkey % 60 + 1 AS position, l_partkey % 401 = 0 AS bad, substr('{_SEQ}', (l_partkey % 60 + 1)::INT, 1) AS ref, substr('{_SEQ}', ((l_partkey % 60 + 1 + l_linenumber) % 20 + 1)::INT, 1) AS alt, CASE WHEN l_discount > 0 THEN l_quantity END AS v FROM lineitem),
c AS (SELECT *, CASE WHEN bad THEN 'B12A' ELSE ref || position || alt END AS code, NOT bad AND ref <> alt AS valid FROM r),
g AS (SELECT l_suppkey, count(*) FILTER (valid AND v IS NOT NULL) AS singles, count(DISTINCT position) FILTER (valid AND v IS NOT NULL) AS positions, count(DISTINCT v) FILTER (valid AND v IS NOT NULL) AS scores, count(*) FILTER (NOT valid) AS invalid, 0::BIGINT AS mismatches, count(*) - count(DISTINCT code) AS repeats FROM c GROUP BY 1),
w AS (SELECT *, concat_ws(';', CASE WHEN singles < 500 THEN 'too_few_singles' END, CASE WHEN positions < 20 THEN 'too_few_positions' END, CASE WHEN scores < 10 THEN 'too_few_scores' END, CASE WHEN invalid > 0 THEN 'invalid_codes' END, CASE WHEN repeats > 0 THEN 'repeated_codes' END) AS reasons FROM g)
SELECT *, reasons = '' AS eligible FROM w""",
    "set_intersection": "SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)",
    "w_linspace_sample": f"""WITH items AS ({_ITEMS}), r AS (SELECT assay_id, code, row_number() OVER (PARTITION BY assay_id ORDER BY code) - 1 AS i, count(*) OVER (PARTITION BY assay_id) AS n FROM items)
SELECT assay_id, code FROM r WHERE n <= 100 OR i IN (SELECT j * (n - 1) // 99 FROM range(100) t(j))""",
    "w_stratified_hash": """WITH r AS (SELECT c_custkey, c_custkey * 7 % 97 AS size, row_number() OVER (ORDER BY c_custkey * 7 % 97, c_custkey) AS r, count(*) OVER () AS n FROM customer),
s AS (SELECT *, (4 * (r - 1) // n)::INTEGER AS stratum FROM r) SELECT c_custkey, size, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('s|' || c_custkey), c_custkey) AS i FROM s) WHERE i <= 30""",
    "f_biophysical": f"""WITH {_LP}, {_PROP} SELECT l_orderkey, count(*)::DOUBLE AS mutation_count, round(avg(position), 6) + 0.0 AS position_mean, round(stddev_pop(position), 6) + 0.0 AS position_std, min(position)::DOUBLE AS position_min, max(position)::DOUBLE AS position_max,
  round(sum(b.h - a.h), 6) + 0.0 AS hydropathy_delta_sum, round(sum(abs(b.h - a.h)), 6) + 0.0 AS hydropathy_delta_abs, round(sum(b.v - a.v), 6) + 0.0 AS volume_delta_sum, round(sum(abs(b.v - a.v)), 6) + 0.0 AS volume_delta_abs, round(sum(b.c - a.c), 6) + 0.0 AS charge_delta_sum, round(sum(abs(b.c - a.c)), 6) + 0.0 AS charge_delta_abs,
  sum(b.ar - a.ar)::DOUBLE AS aromatic_delta, sum(b.po - a.po)::DOUBLE AS polar_delta, count(*) FILTER (alt = 'P')::DOUBLE AS proline_introduced, count(*) FILTER (alt = 'G')::DOUBLE AS glycine_introduced
FROM lp JOIN prop a ON a.aa = ref JOIN prop b ON b.aa = alt GROUP BY 1""",
    "f_additive": f"WITH {_LP} SELECT l_orderkey, unnest(['position=' || position, 'substitution=' || ref || '>' || alt, 'mutation=' || ref || position || alt]) AS feature FROM lp",
    "m_score_shape": f"""WITH {_SCORES}, s AS (SELECT assay_id, model_id, code, CASE WHEN NOT (model_id = 'tax' AND position % 11 = 0) THEN predicted END AS p FROM scores),
e AS (SELECT assay_id, model_id, quantile_cont(p, 0.9) AS edge FROM s GROUP BY ALL),
g AS (SELECT assay_id, model_id, stddev_pop(p) AS sd, avg(p) FILTER (round(p, 9) >= round(edge, 9)) AS tail, median(p) AS mid, 1 - count(p) / count(*) AS missing FROM s JOIN e USING (assay_id, model_id) GROUP BY ALL),
pr AS (SELECT a.assay_id, a.model_id AS a, b.model_id AS b, a.p AS x, b.p AS y FROM s a JOIN s b ON a.assay_id = b.assay_id AND a.code = b.code AND a.model_id < b.model_id WHERE a.p IS NOT NULL AND b.p IS NOT NULL),
{_pair_ranks("pr", "assay_id, a, b", "x", "y")}, c AS (SELECT assay_id, a, b, corr(ra, rb) AS rho FROM rk GROUP BY ALL HAVING count(*) >= 50 AND max(ra) > min(ra) AND max(rb) > min(rb)),
m AS (SELECT assay_id, model_id, (median(rho) + 1) / 2 AS agree FROM (SELECT assay_id, unnest([a, b]) AS model_id, rho FROM c) GROUP BY ALL)
SELECT assay_id, model_id, round(sd, 6) AS score_dispersion, round(missing, 6) AS missing_fraction, round(CASE WHEN sd > 0 THEN (tail - mid) / sd END, 6) AS score_tail_separation, round(agree, 6) AS ensemble_agreement, round(1 - agree, 6) AS ensemble_disagreement FROM g LEFT JOIN m USING (assay_id, model_id)""",
    "f_other_family_similarity": """WITH e AS (SELECT 'P' || l_suppkey % 40 AS a, 'P' || l_partkey % 40 AS b, l_extendedprice AS s FROM lineitem), w AS (SELECT a, b, s FROM e UNION ALL SELECT b, a, s FROM e),
f AS (SELECT DISTINCT 'P' || s_suppkey % 40 AS p, s_suppkey % 40 % 15 AS f FROM supplier), t AS (SELECT w.a, max(s) AS s FROM w JOIN f x ON x.p = w.a JOIN f y ON y.p = w.b WHERE x.f <> y.f GROUP BY 1)
SELECT f.p AS protein_id, coalesce(t.s, 0) AS similarity FROM f LEFT JOIN t ON t.a = f.p""",
    "f_wide_shapes": f"""WITH {_SCORES}, t AS (SELECT {_TASK_SQL}, avg(predicted) AS m, max(predicted) AS x FROM scores GROUP BY ALL) SELECT assay_id, """ + ", ".join(f"round(max({v}) FILTER (model_id = '{m}'), 6) AS {n}__{m}" for v, n in (("m", "mean"), ("x", "top")) for m in ("qty", "disc", "tax")) + " FROM t GROUP BY 1",
    "ml_mean": f"""WITH items AS ({_ITEMS}), {_POSITION}, r AS (SELECT i.*, h.position IS NOT NULL AS test FROM items i LEFT JOIN held h USING (assay_id, position)), m AS (SELECT assay_id, avg(observed) AS p FROM r WHERE NOT test GROUP BY 1)
SELECT assay_id, code, round(p, 4) AS predicted FROM r LEFT JOIN m USING (assay_id) WHERE test""",
    "sp_bridge_rule": f"""WITH {_LP}, c AS (SELECT l_orderkey, count(*) FILTER (position % 5 = 2) AS k, count(*) AS n FROM lp GROUP BY 1)
SELECT l_orderkey, code, CASE WHEN k = c.n THEN 'test' WHEN k = 0 THEN 'train' ELSE 'excluded' END AS role FROM multi JOIN c USING (l_orderkey)""",
    "sp_group_shuffle": f"""WITH items AS ({_ITEMS}), g AS (SELECT family_id, assay_id, count(*) OVER (PARTITION BY family_id) AS n, row_number() OVER (PARTITION BY family_id ORDER BY {_DRAW.format("'1|' || assay_id")}, assay_id) AS i FROM (SELECT DISTINCT family_id, assay_id FROM items))
SELECT i.family_id, i.assay_id, code, CASE WHEN g.i <= ceil(n * 0.25::DOUBLE) THEN 'calibration' ELSE 'fit' END AS role FROM items i JOIN g ON g.family_id = i.family_id AND g.assay_id = i.assay_id""",
    "sp_leave_panel": "SELECT p::INTEGER AS left_out, CASE WHEN c_nationkey % 3 = p THEN 'test' ELSE 'train' END AS role, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer, range(3) t(p) GROUP BY ALL",
    "m_interval_coverage": f"WITH {_SCORES} SELECT {_TASK_SQL}, round(avg((abs(observed - predicted) <= 20000)::INT::DOUBLE), 9) AS coverage FROM scores GROUP BY ALL",
    "c_standard": f"""WITH {_SCORES}, {_POSITION}, {_TRAIN_RADIUS} SELECT {_TASK_SQL}, code, round(predicted - radius, 4) AS lower, round(predicted + radius, 4) AS upper FROM scores s JOIN rad USING ({_TASK_SQL}) WHERE (s.assay_id, s.position) IN (SELECT (assay_id, position) FROM held)""",
    "w_position_gap": f"""WITH items AS ({_ITEMS}), {_POSITION}, p AS (SELECT DISTINCT i.assay_id, i.position FROM items i ANTI JOIN held h ON i.assay_id = h.assay_id AND i.position = h.position), g AS (SELECT assay_id, position - lag(position) OVER (PARTITION BY assay_id ORDER BY position) AS gap FROM p)
SELECT assay_id, coalesce(median(gap), 1)::DOUBLE AS gap FROM g GROUP BY 1""",
    "c_distance": f"""WITH {_SCORES}, f AS (SELECT DISTINCT assay_id, position FROM items WHERE position % 5 NOT IN (2, 4)),
gp AS (SELECT assay_id, coalesce(median(g), 1) AS gap FROM (SELECT assay_id, position - lag(position) OVER (PARTITION BY assay_id ORDER BY position) AS g FROM f) GROUP BY 1),
far AS (SELECT i.assay_id, i.position, min(abs(i.position - f.position)) AS far FROM (SELECT DISTINCT assay_id, position FROM items) i JOIN f USING (assay_id) GROUP BY ALL),
z AS (SELECT s.*, sqrt(1 + far / greatest(gap, 1)) AS scale FROM scores s JOIN far USING (assay_id, position) JOIN gp USING (assay_id)),
r AS (SELECT {_TASK_SQL}, abs(observed - predicted) / scale AS r, count(*) OVER (PARTITION BY {_TASK_SQL}) AS n, row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY abs((observed - predicted) / scale), code) AS i FROM z WHERE position % 5 = 4),
rad AS (SELECT {_TASK_SQL}, r AS radius FROM r WHERE i = least(n, ceil((n + 1) * 0.8::DOUBLE)))
SELECT {_TASK_SQL}, code, round(radius * scale, 4) AS half_width FROM z JOIN rad USING ({_TASK_SQL}) WHERE position % 5 = 2""",
    "w_empirical_percentile": f"""WITH {_SCORES}, v AS (SELECT {_TASK_SQL}, code, round(predicted, 12) AS v, position <= 40 AS ref FROM scores),
q AS (SELECT *, count(*) FILTER (ref) OVER (PARTITION BY {_TASK_SQL} ORDER BY v RANGE UNBOUNDED PRECEDING) / nullif(count(*) FILTER (ref) OVER (PARTITION BY {_TASK_SQL}), 0) AS p FROM v)
SELECT {_TASK_SQL}, code, round(p, 9) AS percentile FROM q WHERE NOT ref""",
    "o_top_k": f"WITH {_SCORES} SELECT {_TASK_SQL}, code, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY predicted DESC, code) AS place FROM scores) WHERE place <= 5",
    "w_argmax": f"WITH {_SCORES} SELECT {_TASK_SQL}, code, round(best - observed, 4) AS regret FROM (SELECT *, max(observed) OVER (PARTITION BY {_TASK_SQL}) AS best, row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY predicted DESC, code) AS i FROM scores) WHERE i = 1",
    "w_ntile_blocks": f"WITH items AS ({_ITEMS}) SELECT assay_id, position, ntile(5) OVER (PARTITION BY assay_id ORDER BY position)::INTEGER AS block FROM (SELECT DISTINCT assay_id, position FROM items)",
    "m_repeat_classifier": """WITH e AS (SELECT event_type, (event_id % 3 = 0)::INT AS y, ((floor(value)::BIGINT % 10 + 10) % 10) / 10.0::DOUBLE AS s FROM events WHERE value IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY s) + (count(*) OVER (PARTITION BY event_type, s) - 1) / 2.0::DOUBLE AS r FROM e)
SELECT event_type, count(*) AS n, sum(y)::BIGINT AS positives, round(CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))) END, 9) AS auc,
  round(avg(pow(s - y, 2)), 9) AS brier, round(avg(((s >= 0.5)::INT = y)::INT::DOUBLE), 9) AS accuracy,
  round((avg((s >= 0.5)::INT::DOUBLE) FILTER (y = 1) + avg((s < 0.5)::INT::DOUBLE) FILTER (y = 0)) / 2, 9) AS balanced_accuracy, round(greatest(avg(y), 1 - avg(y)), 9) AS majority_rate FROM r GROUP BY 1""",
    "m_safe_spearman": f"WITH items AS ({_ITEMS}), {_pair_ranks('items', 'assay_id', 'qty', 'observed')} SELECT assay_id, count(*) AS n, round({_RHO.format(3)}, 9) AS rho FROM rk GROUP BY 1",
    "j_parity": f"WITH {_SCORES}, {_pair_ranks('scores', 'protein_id, model_id', 'predicted', 'observed')} SELECT protein_id, model_id, count(*) AS n, round({_RHO.format(2)}, 9) AS rho FROM rk GROUP BY ALL",
    "j_many_to_one_complete": "SELECT o_orderkey, o_custkey, c_mktsegment, c_mktsegment IS NULL AS unmatched FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 3) ON o_custkey = c_custkey",
    "j_semi_flags": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL) AS has_closed FROM customer",
    "j_three_state_overlap": """WITH r AS (SELECT o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN o_orderpriority END AS note FROM orders), k AS (SELECT DISTINCT o_orderpriority AS note, true AS seen FROM orders WHERE substr(o_orderpriority, 1, 1) < '3'),
g AS (SELECT o_custkey, count(r.note) AS n, list_sort(list(DISTINCT r.note) FILTER (seen)) AS shared FROM r LEFT JOIN k ON r.note = k.note GROUP BY 1)
SELECT o_custkey, CASE WHEN n > 0 THEN 'audited' ELSE 'undocumented' END AS status, CASE WHEN n > 0 THEN coalesce(len(shared), 0) > 0 END AS overlap, CASE WHEN n > 0 THEN coalesce(array_to_string(shared, ';'), '') END AS shared FROM g""",
    "j_exposure_cross": """WITH p AS (SELECT o_custkey, min(o_orderdate::DATE) AS d FROM orders GROUP BY 1), m(model_id, declared, cut) AS (VALUES ('m1', 'known', NULL::DATE), ('m2', 'clean', NULL), ('m3', 'possible', NULL), ('m4', NULL, DATE '1995-12-31'), ('m5', 'clean', DATE '1996-06-30'), ('m6', NULL, NULL))
SELECT c_custkey AS target_id, model_id, CASE WHEN declared = 'known' THEN 'known' WHEN c_custkey % 5 = 0 THEN 'possible' WHEN d > cut THEN 'clean' WHEN d <= cut THEN 'possible' WHEN declared IN ('clean', 'possible') THEN declared ELSE 'undocumented' END AS category FROM customer LEFT JOIN p ON o_custkey = c_custkey, m""",
    "j_interval_overlap": """WITH s AS (SELECT user_id, event_id, event_type, event_id % 50 + 1 AS a, event_id % 50 + 1 + (floor(value)::BIGINT % 30 + 30) % 30 AS b FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
j AS (SELECT l.event_id, r.event_id AS other_id, greatest(0, least(l.b, r.b) - greatest(l.a, r.a) + 1) AS overlap, least(l.b - l.a, r.b - r.a) + 1 AS span FROM s l JOIN s r USING (user_id) WHERE l.event_type = 'click' AND r.event_type <> 'click')
SELECT event_id, other_id, overlap, round(overlap / span, 9) AS share, overlap / span >= 0.5::DOUBLE AS qualifies FROM j""",
    "j_clique_pairs": "SELECT o_custkey, a, o_orderkey AS b FROM (SELECT DISTINCT o_custkey, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS a FROM orders) WHERE o_orderkey > a",
    "j_offset_mapping": f"""WITH t AS (SELECT s_suppkey, substr('{_SEQ}', (s_suppkey % 17 + 1)::INT, 12) || substr('{RESIDUES}', (s_suppkey % 20 + 1)::INT, 3) AS q FROM supplier),
x AS (SELECT s_suppkey, i, substr(q, i::INT, 1) AS r FROM t, range(1, 16) a(i) WHERE i <= length(q)), c AS (SELECT i, substr('{_SEQ}', i::INT, 1) AS r FROM range(1, 61) a(i)),
o AS (SELECT s_suppkey, (c.i - x.i)::INTEGER AS "offset", count(*) AS mapped, min(c.i - 1)::INTEGER AS first, max(c.i - 1)::INTEGER AS last FROM x JOIN c USING (r) GROUP BY 1, 2)
SELECT s_suppkey, "offset", mapped, first, last FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY mapped DESC, abs("offset"), "offset") AS n FROM o) WHERE n = 1""",
    "j_paired_feature_sets": f"""WITH {_SCORES}, t AS (SELECT assay_id, avg(predicted) FILTER (model_id = 'disc') AS d, avg(predicted) FILTER (model_id = 'qty') AS q FROM scores GROUP BY 1)
SELECT assay_id, round(d, 4) AS disc_mean, round(q, 4) AS qty_mean, round(q - d, 4) AS mean_delta FROM t""",
    "s_gaps": f"{_GAPS} SELECT protein_id, {_TASK_SQL}, round(gap, 9) AS spearman_gap FROM gaps",
    "s_gap_summary": f"{_GAPS} SELECT model_id, count(gap) AS n, round(avg(gap), 9) AS mean, round(stddev_samp(gap), 9) AS sd, round(min(gap), 9) AS min, round(quantile_cont(gap, 0.05), 9) AS p05, round(quantile_cont(gap, 0.95), 9) AS p95, round(max(gap), 9) AS max FROM gaps GROUP BY 1",
    "s_multi_summary": f"""{_GAPS}, u AS (SELECT model_id, protein_id, avg(gap) AS v FROM gaps GROUP BY ALL) SELECT model_id, count(*) AS units, round(avg(v), 9) AS mean, round(median(v), 9) AS median, round(avg((v > 0)::INT::DOUBLE), 9) AS positive_share FROM u GROUP BY 1""",
    "s_model_panel": f"WITH {_SCORES}, {_TOP} SELECT model_id, count(*) AS tasks, round(avg(gain), 6) AS mean_gain, round(avg(regret), 6) AS mean_regret, round(avg((gain <= 0)::INT::DOUBLE), 6) AS failure FROM chosen GROUP BY 1",
    "pl_priors": f"WITH {_SCORES}, {_TOP} SELECT model_id, round(avg(gain), 6) AS prior FROM gains GROUP BY 1",
    "pl_regret": f"WITH {_SCORES}, {_TOP} SELECT 'chosen' AS policy, round(avg(regret), 6) AS regret FROM chosen",
    "s_cluster": "WITH g AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (n = 1) AS singles, max(n) AS largest FROM g",
}
