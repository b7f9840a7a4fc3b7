"""Queries of pairing, score audits, roll-ups, ranks, policies and sets, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import codes, names
from driftlens.functions.codes import RESIDUES
from driftlens.operators import joins, metrics, panels, policies, splits, summaries
from driftlens.plans.bindings import dealt_over, items, scores, variants
from driftlens.plans.studies import _DRAW, _FLAT, _ITEMS, _POSITION, _RANDOM, _RUNS, _SCORES, _TASK_SQL, TASK, _ranked, _round, _split_runs

_SEQ = RESIDUES * 3
_RUN = ["protein_id", *TASK]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _number(c: str) -> Column:
    """The number of an assay or protein name."""
    return F.substr(F.col(c), F.lit(2)).cast("int")


# roll-ups

def s_multi_gaps(spark, d):
    made = panels.pivot_gaps(_split_runs(spark, d), _RUN, "split", ["spearman", "rmse", "r2"], "random", "position")
    return _round(made, *made.columns[3:], digits=6)


def s_zero_diff(spark, d):
    made = panels.pivot_gaps(_split_runs(spark, d), _RUN, "split", ["spearman", "rmse"], "random", "position", "subset_{}_difference")
    return _round(made, *made.columns[3:], digits=6)


def s_assays(spark, d):
    made = panels.pivot_gaps(_split_runs(spark, d), _RUN, "split", ["spearman", "rmse"], "random", "position")
    made = panels.over_repeats(made, ["protein_id", "model_id"], "assay_id", ["spearman_gap", "rmse_gap"])
    return _round(made, "spearman_gap", "rmse_gap", digits=6)


def s_official(spark, d):
    made = panels.protein_summary(_split_runs(spark, d), ["model_id", "split"], "protein_id", "assay_id", ["spearman"])
    return _round(made, *made.columns[4:], digits=6)


def _selected(spark, d):
    rows = scores(spark, d)
    return panels.selection(rows, _RUN, "code")


def s_modern(spark, d):
    made = panels.protein_summary(_selected(spark, d), ["model_id"], "protein_id", "assay_id", ["spearman", "gain_sd", "top_recall"])
    return _round(made, *made.columns[3:], digits=6)


def s_external(spark, d):
    return _round(summaries.balanced(_selected(spark, d), ["model_id"], ["protein_id"], "top_recall"), "mean")


def s_transfer(spark, d):
    runs = _split_runs(spark, d)
    key = ["protein_id", "assay_id", "split"]
    own = runs.select(*key, F.col("model_id").alias("source"), F.col("spearman").alias("source_spearman"))
    pairs = own.join(runs.select(*key, F.col("model_id").alias("target"), F.col("spearman").alias("transfer_spearman")), key)
    pairs = pairs.withColumn("gap", F.col("source_spearman") - F.col("transfer_spearman"))
    made = panels.transfer_summary(pairs, ["split"], "source", "target", "transfer_spearman", "gap")
    return _round(made, *made.columns[2:])


def s_span(spark, d):
    chosen = _selected(spark, d).groupBy("model_id").agg(F.median("spearman").alias("median_spearman"), F.avg("gain_sd").alias("mean_gain"), F.median("gain_sd").alias("median_gain"), F.avg("top_recall").alias("mean_recall"))
    return _round(chosen, *chosen.columns[1:])


def m_selection_small(spark, d):
    return _round(panels.selection(scores(spark, d), TASK, "code"), "spearman", "gain_sd", "top_recall")


def m_external_eval(spark, d):
    """Protein-wide, over rows where both values are finite."""
    rows = scores(spark, d).withColumn("predicted", F.when(F.col("position") % 7 != 0, F.col("predicted"))).withColumn("item", F.concat_ws("|", "assay_id", "code"))
    return _round(panels.selection(rows, ["protein_id", "model_id"], "item"), "spearman", "gain_sd", "top_recall")


def _baseline(spark, d):
    means = _selected(spark, d).groupBy("protein_id", "model_id").agg(F.avg("gain_sd").alias("v"))
    models = ["qty", "disc", "tax"]
    wide = means.groupBy("protein_id").agg(*(F.max(F.when(F.col("model_id") == m, F.col("v"))).alias(m) for m in models)).withColumn("panel", _number("protein_id") % 4)
    return panels.against_baseline(wide, ["panel"], "protein_id", models, "qty")


def b_vs_baseline(spark, d):
    return _round(_baseline(spark, d).select("panel", "model", "delta", "lower", "upper", "radius"), "delta", "lower", "upper", "radius", digits=6)


def w_simultaneous_rank(spark, d):
    return _round(_baseline(spark, d).select("panel", "model", "mean_rank", "best_share"), "mean_rank", "best_share", digits=6)


# pairing

def _judged(spark, d):
    """Predictions and outcomes of every task; outcomes of some positions are missing."""
    rows = scores(spark, d)
    return rows.select(*TASK, "code", "predicted"), rows.filter((_number("assay_id") % 3 != 0) | (F.col("position") % 4 != 0)).select(*TASK, "code", "observed")


def j_frozen_eval(spark, d):
    predicted, observed = _judged(spark, d)
    return panels.one_to_one(predicted, observed, [*TASK, "code"]).select(*TASK, "code", F.round(F.col("observed") - F.col("predicted"), 4).alias("residual"))


def j_paired_protocols(spark, d):
    predicted, observed = _judged(spark, d)
    return panels.pairing(predicted, observed, [*TASK, "code"])


def j_outcome_alignment(spark, d):
    predicted, observed = _judged(spark, d)
    return panels.alignment(predicted, observed.select("assay_id", "code").distinct(), ["assay_id"], "model_id", "code")


def j_unexpected_keys(spark, d):
    predicted, observed = _judged(spark, d)
    return predicted.join(observed, [*TASK, "code"], "left_anti").select(*TASK, "code")


def j_paired_win(spark, d):
    runs = _split_runs(spark, d).filter("split = 'position'")
    side = lambda m, n: runs.filter(F.col("model_id") == m).select("protein_id", "assay_id", F.round("spearman", 9).alias(n))
    return side("qty", "fitted").join(side("disc", "fixed"), ["protein_id", "assay_id"]).withColumn("wins", F.col("fitted") > F.col("fixed"))


def j_run_repeatability(spark, d):
    rows = scores(spark, d)
    again = rows.select(*TASK, "code", F.when(F.col("position") % 7 == 0, F.col("predicted") + 1).otherwise(F.col("predicted")).alias("again"))
    both = rows.join(again, [*TASK, "code"]).filter(metrics.finite("predicted") & metrics.finite("again"))
    exact = both.groupBy(*TASK).agg(F.count_if(F.col("predicted") == F.col("again")).alias("exact"))
    return _round(joins.rank_correlation(both, TASK, "predicted", "again").join(exact, TASK), "rho")


def j_paired_phenotypes(spark, d):
    """Each assay with the next one of its protein: outcomes and predictors over the codes that both have."""
    rows, key = items(spark, d), ["protein_id", "assay_id", "code"]
    values, none = ["observed", "qty", "disc", "tax"], F.lit(None).cast("struct<observed: double, qty: double, disc: double, tax: double>")
    side = lambda assay, one, two: rows.select("protein_id", assay.alias("assay_id"), "code", one.alias("a"), two.alias("b"))
    own = F.struct(*values)
    # an assay's own items and the next one's meet by one dealing, before a row is made for each predictor
    both = side(F.col("assay_id"), own, none).unionByName(side(F.concat(F.lit("A"), _number("assay_id") - 40), none, own))
    met = both.repartition(2 * dealt_over(_t(spark, d, "lineitem")), "assay_id").groupBy(*key).agg(F.max("a").alias("a"), F.max("b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model_id"), (F.col("a")[m] * 1000.0).alias("predicted"), (F.col("b")[m] * 1000.0).alias("predicted_b")) for m in values[1:]))).alias("_m")
    shared = met.dropna(subset=key).select(*key, F.col("a.observed").alias("observed"), F.col("b.observed").alias("observed_b"), each).select("*", "_m.*").drop("_m")
    outcome = joins.rank_correlation(shared.filter("model_id = 'qty'"), ["protein_id", "assay_id"], "observed", "observed_b").withColumnRenamed("rho", "outcome_rho")
    each = joins.rank_correlation(shared, ["protein_id", *TASK], "predicted", "predicted_b")
    agreement = each.groupBy("protein_id", "assay_id").agg(F.median("rho").alias("median_rho"), F.min("rho").alias("least_rho"))
    return _round(outcome.join(agreement, ["protein_id", "assay_id"]), "outcome_rho", "median_rho", "least_rho")


def j_metadata_enrich(spark, d):
    people = _t(spark, d, "customer").filter("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    places = _t(spark, d, "nation").filter("n_nationkey % 6 <> 1").select("n_nationkey", "n_name")
    rows = _t(spark, d, "orders").select("o_orderkey", "o_custkey").join(people, "o_custkey", "left").join(places, "n_nationkey", "left")
    return rows.select("o_orderkey", "c_mktsegment", "n_name", (F.col("c_mktsegment").isNull() | F.col("n_name").isNull()).alias("incomplete"))


# audits

def _scored(spark, d):
    """Source items and a score table that lacks, repeats and alters some of them."""
    source, n = items(spark, d), _number("assay_id")
    kept = source.filter((n % 7 != 0) | (F.col("position") % 5 != 0)).filter(n % 23 != 0)
    moved = kept.withColumn("observed", F.when((n % 11 == 0) & (F.col("position") % 3 == 0), F.col("observed") + 1).otherwise(F.col("observed")))
    moved = moved.withColumn("tax", F.when((n % 3 != 0) | (F.col("position") % 9 != 0), F.col("tax")))
    return source.select("assay_id", "code", "observed"), moved.unionByName(moved.filter((n % 13 == 0) & (F.col("position") % 2 == 0))).select("assay_id", "code", "observed", "qty", "disc", "tax")


_MODELS = ["qty", "disc", "tax"]


def a_zero_shot(spark, d):
    return _round(panels.score_audit(*_scored(spark, d), ["assay_id"], "code", "observed", _MODELS), "difference", "common", digits=6)


def a_paired_landscape(spark, d):
    made = panels.score_audit(*_scored(spark, d), ["assay_id"], "code", "observed", _MODELS, 0.9)
    return _round(made.select("assay_id", "common", "eligible"), "common", digits=6)


def a_fold_scores(spark, d):
    source, scored = _scored(spark, d)
    split = F.when(F.pmod(F.length("code"), F.lit(2)) == 0, "even").otherwise("odd")
    made = panels.score_audit(source.withColumn("split", split), scored.withColumn("split", split), ["assay_id", "split"], "code", "observed", _MODELS, all_finite=True)
    return made.select("assay_id", "split", "source_items", "matched", "repeated", "tax_finite", "reasons", "eligible")


def a_published_panel(spark, d):
    rows = scores(spark, d).withColumn("predicted", F.when((F.col("model_id") != "tax") | (F.col("position") % 9 != 0), F.col("predicted")))
    rows = rows.withColumn("predicted", F.when((F.col("model_id") != "disc") | (_number("assay_id") % 20 != 0) | (F.col("position") % 3 != 0), F.col("predicted")))
    return _round(panels.published_panel(rows, "assay_id", "model_id", "predicted", ["qty", "disc", "tax"]), "coverage", digits=6)


def a_pfam_annotations(spark, d):
    clan = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" C"), (F.col("c_nationkey") % 5).cast("string"), F.lit(" "))).when(F.col("c_custkey") % 3 == 1, " ")
    family = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("PF"), F.col("c_nationkey").cast("string")))
    unit = names.domain_unit(family, clan)
    status = F.when(family.isNull(), "unannotated").when(unit.startswith("clan:"), "clan").otherwise("family")
    return _t(spark, d, "customer").select("c_custkey", unit.alias("unit"), status.alias("status"))


def a_structure_units(spark, d):
    k = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select("o_custkey", F.concat(F.lit("f"), (F.col("o_custkey") + F.when(k % 50 == 0, 1).otherwise(0)).cast("string")).alias("file"), F.lit(1).alias("start"), F.when(k % 31 != 0, F.col("o_custkey") % 90).alias("stop"))
    return panels.structure_units(rows, "o_custkey", "file", "start", "stop")


def g_segments(spark, d):
    k = F.col("s_suppkey")
    rows = _t(spark, d, "supplier").select("s_suppkey", F.lit(_SEQ).alias("sequence"), (k % 40).alias("start"), (k % 40 + k % 23).alias("stop"))
    return panels.segments(rows, "sequence", "start", "stop").select("s_suppkey", "segment", "segment_sha256", "segment_length")


def g_reciprocal(spark, d):
    edges = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("q"), (F.col("l_partkey") % 50).alias("t"), F.col("l_extendedprice").alias("tm"), F.col("l_quantity").alias("identity"))
    return panels.reciprocal(edges, "q", "t", ["tm"], ["identity"])


# ranks and policies

def _ordered(spark, d):
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("v"))


def w_coverage_ranks(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderstatus").alias("panel"), "o_custkey", "o_orderkey", F.round("o_totalprice", -3).alias("confidence"))
    made = panels.coverage_decisions(rows, "panel", "confidence", ["o_custkey", "o_orderkey"])
    return made.select("panel", "o_orderkey", "pooled_rank", "panel_rank", "pooled_decision", "panel_decision")


def w_top_fraction(spark, d):
    return panels.top_fraction(_ordered(spark, d), ["o_custkey"], "v", "o_orderkey", 0.3).select("o_custkey", "o_orderkey")


def w_tail_mean(spark, d):
    return _round(panels.tail_mean(_ordered(spark, d), ["o_custkey"], "v", "o_orderkey"), "tail_mean", digits=4)


def w_order_statistic(spark, d):
    return panels.order_statistic(_ordered(spark, d), ["o_custkey"], "v", 5)


def _tasks(spark, d):
    """(task, model_id, decision, gain, regret): how far the top predictions stand out, and what they gain."""
    rows = scores(spark, d)
    sd = F.stddev_pop("predicted")
    decision = rows.groupBy(*TASK).agg(F.round(F.when(sd > 1e-12, (F.max("predicted") - F.avg("predicted")) / sd).otherwise(0.0), 6).alias("decision"))
    return metrics.top_selection(rows, TASK, "code").select(*TASK, F.col("gain_sd").alias("gain"), F.col("regret_sd").alias("regret")).join(decision, TASK)


def _areas(spark, d):
    points = policies.curve(_tasks(spark, d), ["model_id"], ["assay_id"], "decision")
    return policies.area(points, ["model_id"], "coverage", "mean_regret")


def w_trapezoid(spark, d):
    return _round(_areas(spark, d), "area", digits=6)


def o_best_comparator(spark, d):
    return _round(_areas(spark, d).orderBy("area", "model_id").limit(1), "area", digits=6)


def pl_override(spark, d):
    return panels.override(_tasks(spark, d), ["assay_id"], "model_id", "decision", "disc", 0.1).select(*TASK, "overrode", F.round("gain", 6).alias("gain"))


def pl_priority(spark, d):
    rows = _t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("neff"), (F.col("s_suppkey") * 37 % 4000 + 1).alias("length"), F.col("s_nationkey").cast("double").alias("decision"))
    neff = F.when(F.col("neff") >= 0, F.log1p("neff"))
    fitted = rows.agg(*(f(c) for c in (neff, F.log1p("length"), F.col("decision")) for f in (F.avg, F.stddev_pop))).first()
    constants = {n: (fitted[2 * i], fitted[2 * i + 1]) for i, n in enumerate(panels.PRIORITY)}
    return rows.select("s_suppkey", F.round(panels.priority({n: F.col(n) for n in panels.PRIORITY}, constants), 6).alias("priority"))


# scalars, sets and splits

def x_log_odds(spark, d):
    """Log probabilities of residues at positions from counts over all orders; one is added for each of twenty residues."""
    rows = variants(spark, d).select("l_orderkey", F.explode(codes.parse(F.col("code"))).alias("m")).select("l_orderkey", "m.*")
    seen = rows.groupBy(F.col("pos").alias("position"), F.col("alt").alias("residue")).agg(F.count(F.lit(1)).alias("c"))
    total = rows.groupBy(F.col("pos").alias("position")).agg(F.count(F.lit(1)).alias("n"))
    table = total.select("position", "n", F.explode(F.split(F.lit(RESIDUES), "")).alias("residue")).join(seen, ["position", "residue"], "left")
    table = table.select("position", "residue", F.log((F.coalesce("c", F.lit(0)) + 1) / (F.col("n") + 20)).alias("logp"))
    return _round(panels.log_odds(rows, ["l_orderkey"], table), "log_odds", digits=6)


def x_window_mean(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.explode(names.windows(F.col("p_size").cast("int"), 20, 5)).alias("w"))
    rows = rows.select("p_partkey", F.col("w.start").alias("s"), F.explode(F.sequence(F.col("w.start"), F.col("w.stop") - 1)).alias("place"))
    value = ((F.col("s") * 7 + F.col("place")) % 11).cast("double")
    return _round(rows.groupBy("p_partkey", "place").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("windows")), "mean")


def p_canonicalize_assay(spark, d):
    rows = variants(spark, d).select(F.col("l_orderkey").alias("o_orderkey"), F.translate("code", "/", ":").alias("code"))
    orders = _t(spark, d, "orders")
    rows = rows.join(orders.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "NaN").otherwise(F.col("o_custkey").cast("string")).alias("score")), "o_orderkey")
    return panels.single_codes(rows, "code", "score", orders.select("o_orderkey", "o_orderstatus"), "o_orderkey").select("o_orderkey", "code", "score", "o_orderstatus")


def set_union(spark, d):
    left = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return left.unionByName(_t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


def set_difference(spark, d):
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return panels.differences(people, _t(spark, d, "orders").select((F.col("o_custkey") + 7).alias("key")))


def set_distinct(spark, d):
    return panels.mapping(_t(spark, d, "orders"), "o_custkey", "o_orderstatus")


def set_partition(spark, d):
    """Whole targets go to the pilot or the holdout; `crossing` counts targets found in both."""
    rows = _t(spark, d, "orders").select("o_custkey", F.when(F.col("o_custkey") % 5 == 0, "pilot").otherwise("holdout").alias("part"))
    sides = rows.groupBy("o_custkey").agg(F.min("part").alias("part"), F.count_distinct("part").alias("_n"), F.count(F.lit(1)).alias("rows"))
    return sides.groupBy("part").agg(F.count(F.lit(1)).alias("targets"), F.sum("rows").alias("rows"), F.count_if(F.col("_n") > 1).alias("crossing"))


def sp_suite(spark, d):
    rows = items(spark, d).drop("qty", "disc", "tax")
    made = {"random": splits.random_item(rows, ["assay_id"]), "position": splits.position(rows, ["assay_id"]), "modulo": splits.modulo(rows, 2)}
    parts = [x.withColumn("split", F.lit(n)) for n, x in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("assay_id", "code", "split", "role")


def sp_calibration(spark, d):
    train = splits.position(items(spark, d), ["assay_id"]).filter("role = 'train'").drop("role")
    return splits.random_item(train, ["assay_id"]).select("assay_id", "code", F.when(F.col("role") == "test", "calibration").otherwise("fit").alias("role"))


def sp_seeds(spark, d):
    rows = panels.over_seeds(items(spark, d).select("assay_id", "code"), 3, 2)
    order = metrics.Window.partitionBy("assay_id", "seed").orderBy(codes.draw(F.col("seed"), F.col("code")), "code")
    rows = rows.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(metrics.Window.partitionBy("assay_id", "seed")))
    return rows.select("assay_id", "code", "seed", F.when(F.col("_i") <= F.ceil(F.col("_n") * F.lit(0.2)), "test").otherwise("train").alias("role"))


def o_stable_sort(spark, d):
    return _t(spark, d, "orders").select("o_orderstatus", "o_custkey", "o_orderkey").orderBy("o_orderstatus", F.desc("o_custkey"), "o_orderkey")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        s_multi_gaps, s_zero_diff, s_assays, s_official, s_modern, s_external, s_transfer, s_span, m_selection_small, m_external_eval, b_vs_baseline, w_simultaneous_rank,
        j_frozen_eval, j_paired_protocols, j_outcome_alignment, j_unexpected_keys, j_paired_win, j_run_repeatability, j_paired_phenotypes, j_metadata_enrich,
        a_zero_shot, a_paired_landscape, a_fold_scores, a_published_panel, a_pfam_annotations, a_structure_units, g_segments, g_reciprocal,
        w_coverage_ranks, w_top_fraction, w_tail_mean, w_order_statistic, w_trapezoid, o_best_comparator, pl_override, pl_priority,
        x_log_odds, x_window_mean, p_canonicalize_assay, set_union, set_difference, set_distinct, set_partition, sp_suite, sp_calibration, sp_seeds, o_stable_sort,
    )
}

_FULL = f"{_RUNS}, full_runs AS (SELECT protein_id, assay_id, model_id, split, {_FLAT} AS spearman, sqrt(avg(pow(observed - predicted, 2))) AS rmse, 1 - sum(pow(observed - predicted, 2)) / sum(pow(observed - mu, 2)) AS r2 FROM (SELECT *, avg(observed) OVER (PARTITION BY protein_id, assay_id, model_id, split) AS mu FROM ranked) GROUP BY ALL)"


def _sides(*values: str, name: str = "{}_gap") -> str:
    side = "max({}) FILTER (split = '{}')"
    return ", ".join(f"round({side.format(v, 'random')}, 6) AS random_{v}, round({side.format(v, 'position')}, 6) AS position_{v}, round({side.format(v, 'random')} - {side.format(v, 'position')}, 6) AS {name.format(v)}" for v in values)


def _select_sql(source: str, by: str, item: str, name: str = "sel") -> str:
    """CTEs that end in name(by, n, spearman, gain_sd, regret_sd, top_recall)."""
    return f"""{_ranked(source, by).replace('ranked AS', name + '_r AS', 1)}, {name}_k AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY {by}) * 0.1::DOUBLE)) AS kk,
  row_number() OVER (PARTITION BY {by} ORDER BY predicted DESC, {item}) AS a, row_number() OVER (PARTITION BY {by} ORDER BY observed DESC, {item}) AS b FROM {name}_r),
{name} AS (SELECT {by}, count(*) AS n, {_FLAT} AS spearman, count(*) FILTER (a <= kk AND b <= kk) / max(kk) AS top_recall,
  CASE WHEN stddev_pop(observed) > 1e-12 THEN (avg(observed) FILTER (a <= kk) - avg(observed)) / stddev_pop(observed) ELSE 0 END AS gain_sd,
  CASE WHEN stddev_pop(observed) > 1e-12 THEN (max(observed) - max(observed) FILTER (a <= kk)) / stddev_pop(observed) ELSE 0 END AS regret_sd FROM {name}_k GROUP BY {by})"""


def _replicas(source: str, by: str, unit: str, values: list[str]) -> str:
    """CTEs that end in reps(by, rep, n, values)."""
    on = " AND ".join(f"dr.{c.strip()} = u.{c.strip()}" for c in by.split(","))
    keys = ", ".join(f"dr.{c.strip()}" for c in by.split(","))
    means = ", ".join(f"avg(u.{v}) AS {v}" for v in values)
    return f"""u AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {unit}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
dr AS (SELECT {by}, n, rep, {_DRAW.format("'1|' || rep || '|' || i")} % n AS i FROM u, range(200) r(rep)),
reps AS (SELECT {keys}, dr.rep, any_value(dr.n) AS n, {means} FROM dr JOIN u ON {on} AND dr.i = u.i GROUP BY {keys}, dr.rep)"""


def _summary_sql(start: str, runs: str, by: str, values: list[str]) -> str:
    edges = ", ".join(f"round(CASE WHEN max(n) > 1 THEN quantile_cont({v}, {q}) END, 6) AS {v}_ci_{e}" for v in values for e, q in (("low", 0.025), ("high", 0.975)))
    return f"""{start}, pl AS (SELECT {by}, protein_id, count(DISTINCT assay_id) AS assays, {', '.join(f'avg({v}) AS {v}' for v in values)} FROM {runs} GROUP BY {by}, protein_id), {_replicas('pl', by, 'protein_id', values)},
pts AS (SELECT {by}, sum(assays)::BIGINT AS n_assays, count(*) AS n_proteins, {', '.join(f'round(avg({v}), 6) AS mean_{v}' for v in values)} FROM pl GROUP BY {by}), lim AS (SELECT {by}, {edges} FROM reps GROUP BY {by})
SELECT * FROM pts JOIN lim USING ({by})"""


_SEL = f"WITH {_SCORES}, {_select_sql('scores', 'protein_id, assay_id, model_id', 'code')}"
_BASE = f"""{_SEL}, w AS (SELECT protein_id, substr(protein_id, 2)::INT % 4 AS panel, avg(gain_sd) FILTER (model_id = 'qty') AS qty, avg(gain_sd) FILTER (model_id = 'disc') AS disc, avg(gain_sd) FILTER (model_id = 'tax') AS tax FROM sel GROUP BY 1),
{_replicas('w', 'panel', 'protein_id', ['qty', 'disc', 'tax'])}, pts AS (SELECT panel, avg(disc) - avg(qty) AS d_disc, avg(tax) - avg(qty) AS d_tax FROM w GROUP BY 1),
x AS (SELECT *, greatest(abs(disc - qty - d_disc), abs(tax - qty - d_tax)) AS far FROM reps JOIN pts USING (panel)),
long AS (SELECT panel, rep, n, far, 'disc' AS model, disc AS v, disc - qty AS dd, d_disc AS delta FROM x UNION ALL SELECT panel, rep, n, far, 'tax', tax, tax - qty, d_tax FROM x UNION ALL SELECT panel, rep, n, far, 'qty', qty, 0, 0 FROM x),
place AS (SELECT *, row_number() OVER (PARTITION BY panel, rep ORDER BY v DESC, model) AS place FROM long)"""
_JUDGED = f"WITH {_SCORES}, o AS (SELECT * FROM scores WHERE substr(assay_id, 2)::INT % 3 <> 0 OR position % 4 <> 0)"
_AUDIT = f"""WITH items AS (SELECT *, substr(assay_id, 2)::INT AS k FROM ({_ITEMS})), kept AS (SELECT assay_id, code, position, k, CASE WHEN k % 11 = 0 AND position % 3 = 0 THEN observed + 1 ELSE observed END AS v, qty, disc,
  CASE WHEN k % 3 <> 0 OR position % 9 <> 0 THEN tax END AS tax FROM items WHERE (k % 7 <> 0 OR position % 5 <> 0) AND k % 23 <> 0),
one AS (SELECT assay_id, code, CASE WHEN k % 13 = 0 AND position % 2 = 0 THEN 2 ELSE 1 END AS times, v, qty, disc, tax FROM kept),
r AS (SELECT i.assay_id, i.code, i.observed, one.times, one.v, one.qty, one.disc, one.tax, CASE WHEN length(i.code) % 2 = 0 THEN 'even' ELSE 'odd' END AS split FROM items i LEFT JOIN one ON i.assay_id = one.assay_id AND i.code = one.code)"""
_COUNTS = "count(*) AS source_items, count(times) AS matched, count(*) FILTER (times > 1) AS repeated, count(tax) AS tax_finite"
_FIRST_FAULTS = "CASE WHEN matched = 0 THEN 'missing_scores' END, CASE WHEN repeated > 0 THEN 'duplicate_score_variants' END, CASE WHEN matched < source_items THEN 'incomplete_variant_join' END, CASE WHEN difference > 1e-10 THEN 'score_mismatch' END"
_WHOLE = f"""{_AUDIT}, a AS (SELECT assay_id, {_COUNTS}, max(abs(observed - v)) AS difference, count(*) FILTER (qty IS NOT NULL AND disc IS NOT NULL AND tax IS NOT NULL) / count(*)::DOUBLE AS common, count(qty) AS qty_finite, count(disc) AS disc_finite FROM r GROUP BY 1)"""
_TASKS = f"""WITH {_SCORES}, {_select_sql('scores', _TASK_SQL, 'code')}, dec AS (SELECT {_TASK_SQL}, round(CASE WHEN stddev_pop(predicted) > 1e-12 THEN (max(predicted) - avg(predicted)) / stddev_pop(predicted) ELSE 0 END, 6) AS decision FROM scores GROUP BY ALL),
tasks AS (SELECT assay_id, model_id, decision, gain_sd AS gain, regret_sd AS regret FROM sel JOIN dec USING (assay_id, model_id))"""
_AREAS = f"""{_TASKS}, rk AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY decision DESC, assay_id) AS i, count(*) OVER (PARTITION BY model_id) AS n FROM tasks),
cv AS (SELECT model_id, c / 10.0::DOUBLE AS c, avg(regret) AS y FROM rk, range(1, 11) g(c) WHERE i <= ceil(n * (c / 10.0::DOUBLE)) GROUP BY 1, 2),
st AS (SELECT model_id, (c - lag(c) OVER w) * (y + lag(y) OVER w) / 2 AS s FROM cv WINDOW w AS (PARTITION BY model_id ORDER BY c)), areas AS (SELECT model_id, round(sum(s), 6) AS area FROM st GROUP BY 1)"""
_TOP_OF = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice {}, o_orderkey)"
_VARIANTS = f"""p AS (SELECT l_orderkey, l_partkey % 60 + 1 AS position, substr('{RESIDUES}', (l_partkey % 60 % 20 + 1)::INT, 1) AS ref, substr('{RESIDUES}', ((l_partkey % 60 + 1 + l_linenumber) % 20 + 1)::INT, 1) AS alt FROM lineitem),
m AS (SELECT l_orderkey, position, min(ref || position || alt) AS code FROM p WHERE ref <> alt GROUP BY 1, 2)"""
_RANK_OF = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0::DOUBLE"
_RHO_OF = "CASE WHEN count(*) >= 2 AND max({0}) > min({0}) AND max({1}) > min({1}) THEN corr(r{0}, r{1}) END"


def _rho_rows(source: str, by: str, x: str, y: str, name: str) -> str:
    return f"{name} AS (SELECT *, {_RANK_OF.format(by, x)} AS r{x}, {_RANK_OF.format(by, y)} AS r{y} FROM {source})"


ORACLES: dict[str, str] = {
    "s_multi_gaps": f"{_FULL} SELECT protein_id, assay_id, model_id, {_sides('spearman', 'rmse', 'r2')} FROM full_runs GROUP BY ALL",
    "s_zero_diff": f"{_FULL} SELECT protein_id, assay_id, model_id, {_sides('spearman', 'rmse', name='subset_{}_difference')} FROM full_runs GROUP BY ALL",
    "s_assays": f"""{_FULL}, g AS (SELECT protein_id, assay_id, model_id, max(spearman) FILTER (split = 'random') - max(spearman) FILTER (split = 'position') AS s, max(rmse) FILTER (split = 'random') - max(rmse) FILTER (split = 'position') AS m FROM full_runs GROUP BY ALL)
SELECT protein_id, model_id, count(DISTINCT assay_id) AS repeats, round(avg(s), 6) AS spearman_gap, round(avg(m), 6) AS rmse_gap FROM g GROUP BY ALL""",
    "s_official": _summary_sql(_RUNS, "runs", "model_id, split", ["spearman"]),
    "s_modern": _summary_sql(_SEL, "sel", "model_id", ["spearman", "gain_sd", "top_recall"]),
    "s_external": f"{_SEL}, q AS (SELECT model_id, protein_id, avg(top_recall) AS v FROM sel GROUP BY ALL) SELECT model_id, count(*) AS units, round(avg(v), 9) AS mean FROM q GROUP BY 1",
    "s_transfer": f"""{_RUNS}, x AS (SELECT a.split, a.model_id AS source, b.model_id AS target, b.spearman AS t, a.spearman - b.spearman AS gap FROM runs a JOIN runs b USING (protein_id, assay_id, split))
SELECT split, count(DISTINCT source) AS conditions, round(avg(t) FILTER (source = target), 9) AS diagonal_mean, round(avg(t) FILTER (source <> target), 9) AS off_diagonal_mean, round(min(t) FILTER (source <> target), 9) AS off_diagonal_min,
  round(max(t) FILTER (source <> target), 9) AS off_diagonal_max, round(avg(gap) FILTER (source <> target), 9) AS gap_mean, round(max(gap) FILTER (source <> target), 9) AS gap_max FROM x GROUP BY 1""",
    "s_span": f"{_SEL} SELECT model_id, round(median(spearman), 9) AS median_spearman, round(avg(gain_sd), 9) AS mean_gain, round(median(gain_sd), 9) AS median_gain, round(avg(top_recall), 9) AS mean_recall FROM sel GROUP BY 1",
    "m_selection_small": f"WITH {_SCORES}, {_select_sql('scores', _TASK_SQL, 'code')} SELECT {_TASK_SQL}, n, round(spearman, 9) AS spearman, round(gain_sd, 9) AS gain_sd, round(top_recall, 9) AS top_recall FROM sel",
    "m_external_eval": f"""WITH {_SCORES}, kept AS (SELECT *, assay_id || '|' || code AS item FROM scores WHERE position % 7 <> 0), {_select_sql('kept', 'protein_id, model_id', 'item')}
SELECT protein_id, model_id, n, round(spearman, 9) AS spearman, round(gain_sd, 9) AS gain_sd, round(top_recall, 9) AS top_recall FROM sel""",
    "b_vs_baseline": f"""{_BASE} SELECT panel, model, round(max(delta), 6) AS delta, round(CASE WHEN max(n) > 1 THEN quantile_cont(dd, 0.025) END, 6) AS lower, round(CASE WHEN max(n) > 1 THEN quantile_cont(dd, 0.975) END, 6) AS upper,
  round(CASE WHEN max(n) > 1 THEN quantile_cont(far, 0.95) END, 6) AS radius FROM place WHERE model <> 'qty' GROUP BY ALL""",
    "w_simultaneous_rank": f"{_BASE} SELECT panel, model, round(avg(place), 6) AS mean_rank, round(avg((place = 1)::INT::DOUBLE), 6) AS best_share FROM place WHERE model <> 'qty' GROUP BY ALL",
    "j_frozen_eval": f"{_JUDGED} SELECT assay_id, model_id, code, round(observed - predicted, 4) AS residual FROM o",
    "j_paired_protocols": f"{_JUDGED} SELECT (SELECT count(*) FROM scores) AS left_rows, (SELECT count(*) FROM o) AS right_rows, (SELECT count(*) FROM scores JOIN o USING (assay_id, model_id, code)) AS paired, 0::BIGINT AS repeated, (SELECT count(*) FROM scores) = (SELECT count(*) FROM o) AS exact",
    "j_outcome_alignment": f"""{_JUDGED}, c AS (SELECT s.assay_id, s.model_id, count(*) AS scored, count(k.code) AS aligned FROM scores s LEFT JOIN (SELECT DISTINCT assay_id, code FROM o) k ON s.assay_id = k.assay_id AND s.code = k.code GROUP BY 1, 2)
SELECT *, CASE WHEN aligned < 10 THEN 'too_few_aligned_variants' WHEN aligned < scored * 0.95::DOUBLE THEN 'low_aligned_share' ELSE '' END AS reason FROM c""",
    "j_unexpected_keys": f"{_JUDGED} SELECT assay_id, model_id, code FROM scores WHERE substr(assay_id, 2)::INT % 3 = 0 AND position % 4 = 0",
    "j_paired_win": f"""{_RUNS} SELECT protein_id, assay_id, round(a.spearman, 9) AS fitted, round(b.spearman, 9) AS fixed, round(a.spearman, 9) > round(b.spearman, 9) AS wins
FROM (SELECT * FROM runs WHERE split = 'position' AND model_id = 'qty') a JOIN (SELECT * FROM runs WHERE split = 'position' AND model_id = 'disc') b USING (protein_id, assay_id)""",
    "j_run_repeatability": f"""WITH {_SCORES}, both_runs AS (SELECT assay_id, model_id, predicted AS x, CASE WHEN position % 7 = 0 THEN predicted + 1 ELSE predicted END AS y FROM scores), {_rho_rows('both_runs', _TASK_SQL, 'x', 'y', 'rr')}
SELECT assay_id, model_id, count(*) AS n, round({_RHO_OF.format('x', 'y')}, 9) AS rho, count(*) FILTER (x = y) AS exact FROM rr GROUP BY 1, 2""",
    "j_paired_phenotypes": f"""WITH {_SCORES}, sh AS (SELECT a.protein_id, a.assay_id, a.model_id, a.observed AS x, b.observed AS y, a.predicted AS p, b.predicted AS q FROM scores a JOIN scores b ON a.protein_id = b.protein_id AND a.model_id = b.model_id AND a.code = b.code
  AND substr(b.assay_id, 2)::INT - 40 = substr(a.assay_id, 2)::INT), first_model AS (SELECT * FROM sh WHERE model_id = 'qty'), {_rho_rows('first_model', 'protein_id, assay_id', 'x', 'y', 'ro')}, {_rho_rows('sh', 'protein_id, assay_id, model_id', 'p', 'q', 'rm')},
oc AS (SELECT protein_id, assay_id, count(*) AS n, {_RHO_OF.format('x', 'y')} AS o FROM ro GROUP BY 1, 2), em AS (SELECT protein_id, assay_id, model_id, {_RHO_OF.format('p', 'q')} AS r FROM rm GROUP BY 1, 2, 3),
ag AS (SELECT protein_id, assay_id, median(r) AS md, min(r) AS mn FROM em GROUP BY 1, 2)
SELECT protein_id, assay_id, n, round(o, 9) AS outcome_rho, round(md, 9) AS median_rho, round(mn, 9) AS least_rho FROM oc JOIN ag USING (protein_id, assay_id)""",
    "j_metadata_enrich": """SELECT o_orderkey, c_mktsegment, n_name, c_mktsegment IS NULL OR n_name IS NULL AS incomplete FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 3) ON o_custkey = c_custkey
LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 <> 1) ON c_nationkey = n_nationkey""",
    "a_zero_shot": f"""{_WHOLE}, f AS (SELECT *, concat_ws(';', {_FIRST_FAULTS}, CASE WHEN common < 0.95 THEN 'insufficient_common_score_coverage' END) AS reasons FROM a)
SELECT assay_id, source_items, matched, repeated, round(difference, 6) AS difference, round(common, 6) AS common, qty_finite, disc_finite, tax_finite, reasons, reasons = '' AS eligible FROM f""",
    "a_paired_landscape": f"{_WHOLE} SELECT assay_id, round(common, 6) AS common, concat_ws('', {_FIRST_FAULTS}, CASE WHEN common < 0.9 THEN 'x' END) = '' AS eligible FROM a",
    "a_fold_scores": f"""{_AUDIT}, a AS (SELECT assay_id, split, {_COUNTS}, max(abs(observed - v)) AS difference, count(qty) AS q, count(disc) AS dd FROM r GROUP BY 1, 2),
f AS (SELECT *, concat_ws(';', {_FIRST_FAULTS}, CASE WHEN q < source_items THEN 'nonfinite_predictions:qty' END, CASE WHEN dd < source_items THEN 'nonfinite_predictions:disc' END, CASE WHEN tax_finite < source_items THEN 'nonfinite_predictions:tax' END) AS reasons FROM a)
SELECT assay_id, split, source_items, matched, repeated, tax_finite, reasons, reasons = '' AS eligible FROM f""",
    "a_published_panel": f"""WITH {_SCORES}, p AS (SELECT model_id, assay_id, count(*) FILTER (NOT (model_id = 'tax' AND position % 9 = 0) AND NOT (model_id = 'disc' AND substr(assay_id, 2)::INT % 20 = 0 AND position % 3 = 0)) AS p, count(*) AS t FROM scores GROUP BY 1, 2),
a AS (SELECT model_id, round(sum(p) / sum(t)::DOUBLE, 6) AS coverage, count(*) FILTER (p >= t * 0.95::DOUBLE) AS targets, sum(p) / sum(t)::DOUBLE >= 0.95::DOUBLE AS eligible FROM p GROUP BY 1),
s AS (SELECT assay_id FROM p JOIN a USING (model_id) WHERE eligible AND p >= t * 0.95::DOUBLE GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM a WHERE eligible)) SELECT *, (SELECT count(*) FROM s) AS shared_targets FROM a""",
    "a_pfam_annotations": """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'clan:C' || (c_nationkey % 5) ELSE 'pfam:PF' || c_nationkey END AS unit,
  CASE WHEN c_custkey % 7 = 0 THEN 'unannotated' WHEN c_custkey % 3 = 0 THEN 'clan' ELSE 'family' END AS status FROM customer""",
    "a_structure_units": """WITH r AS (SELECT o_custkey, 'f' || (o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END) AS file, CASE WHEN o_orderkey % 31 <> 0 THEN o_custkey % 90 END AS stop FROM orders),
g AS (SELECT o_custkey, count(*) AS "rows", count(DISTINCT file || '|' || coalesce(stop::VARCHAR, '-')) > 1 AS conflict, min(file) AS file, min(stop) AS stop FROM r GROUP BY 1)
SELECT o_custkey, "rows", conflict, CASE WHEN NOT conflict THEN file END AS file, CASE WHEN NOT conflict THEN 1 END AS start, CASE WHEN NOT conflict THEN stop END AS stop FROM g""",
    "g_segments": f"""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 40 >= 1 AND s_suppkey % 40 + s_suppkey % 23 <= 60 THEN substr('{_SEQ}', (s_suppkey % 40)::INT, (s_suppkey % 23 + 1)::INT) END AS segment FROM supplier)
SELECT s_suppkey, segment, sha256(segment) AS segment_sha256, length(segment)::INTEGER AS segment_length FROM s""",
    "g_reciprocal": """WITH e AS (SELECT l_suppkey % 50 AS q, l_partkey % 50 AS t, l_extendedprice AS tm, l_quantity AS i FROM lineitem)
SELECT least(q, t) AS a, greatest(q, t) AS b, count(DISTINCT q) AS directions, min(tm) AS min_tm, max(i) AS max_identity FROM e WHERE q <> t GROUP BY 1, 2""",
    "w_coverage_ranks": """WITH r AS (SELECT o_orderstatus AS panel, o_orderkey, o_custkey, round(o_totalprice, -3) AS c FROM orders),
k AS (SELECT *, row_number() OVER (ORDER BY c DESC, panel, o_custkey, o_orderkey) AS pooled_rank, row_number() OVER (PARTITION BY panel ORDER BY c DESC, o_custkey, o_orderkey) AS panel_rank, count(*) OVER () AS n, count(*) OVER (PARTITION BY panel) AS pn FROM r)
SELECT panel, o_orderkey, pooled_rank, panel_rank, CASE WHEN pooled_rank <= ceil(n * 0.5::DOUBLE) THEN 'deploy' ELSE 'abstain' END AS pooled_decision, CASE WHEN panel_rank <= ceil(pn * 0.5::DOUBLE) THEN 'deploy' ELSE 'abstain' END AS panel_decision FROM k""",
    "w_top_fraction": f"SELECT o_custkey, o_orderkey FROM (SELECT *, {_TOP_OF.format('DESC')} AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE i <= ceil(n * 0.3::DOUBLE)",
    "w_tail_mean": f"SELECT o_custkey, round(avg(o_totalprice), 4) AS tail_mean FROM (SELECT *, {_TOP_OF.format('')} AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE i <= ceil(n * 0.2::DOUBLE) GROUP BY 1",
    "w_order_statistic": "SELECT o_custkey, o_totalprice AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS i, count(o_totalprice) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_totalprice IS NOT NULL) WHERE i = least(5, n)",
    "w_trapezoid": f"{_AREAS} SELECT model_id, area FROM areas",
    "o_best_comparator": f"{_AREAS} SELECT model_id, area FROM areas ORDER BY area, model_id LIMIT 1",
    "pl_override": f"""{_TASKS}, x AS (SELECT *, row_number() OVER (PARTITION BY assay_id ORDER BY decision DESC, model_id) AS i, max(decision) OVER (PARTITION BY assay_id) - max(decision) FILTER (model_id = 'disc') OVER (PARTITION BY assay_id) > 0.1::DOUBLE AS overrode FROM tasks)
SELECT assay_id, model_id, overrode, round(gain, 6) AS gain FROM x WHERE CASE WHEN overrode THEN i = 1 ELSE model_id = 'disc' END""",
    "pl_priority": """WITH r AS (SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN ln(1 + s_acctbal::DOUBLE) END AS a, ln(1 + (s_suppkey * 37 % 4000 + 1)::DOUBLE) AS b, s_nationkey::DOUBLE AS c FROM supplier),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM r)
SELECT s_suppkey, round((coalesce(a, ma) - ma) / sa + 0.5::DOUBLE * (b - mb) / sb + 0.25::DOUBLE * (c - mc) / sc, 6) AS priority FROM r, m""",
    "x_log_odds": f"""WITH {_VARIANTS}, x AS (SELECT l_orderkey, position, left(code, 1) AS ref, right(code, 1) AS alt FROM m), c AS (SELECT position, alt, count(*) AS c FROM x GROUP BY 1, 2), n AS (SELECT position, count(*) AS n FROM x GROUP BY 1)
SELECT l_orderkey, round(sum(ln((coalesce(a.c, 0) + 1) / (n + 20)::DOUBLE) - ln((coalesce(b.c, 0) + 1) / (n + 20)::DOUBLE)), 6) AS log_odds FROM x JOIN n USING (position)
LEFT JOIN c a ON a.position = x.position AND a.alt = x.alt LEFT JOIN c b ON b.position = x.position AND b.alt = x.ref GROUP BY 1""",
    "x_window_mean": """WITH p AS (SELECT p_partkey, p_size::INT AS n FROM part), st AS (SELECT DISTINCT p_partkey, n, least(s, greatest(n - 20, 0)) AS s FROM p, range(0, 60, 15) g(s) WHERE s < greatest(n - 20, 0) + 15)
SELECT p_partkey, g.place::INTEGER AS place, round(avg(((s * 7 + g.place) % 11)::DOUBLE), 9) AS mean, count(*) AS windows FROM st, range(0, 60) g(place) WHERE g.place >= s AND g.place < least(s + 20, n) GROUP BY 1, 2""",
    "p_canonicalize_assay": f"""WITH {_VARIANTS}, v AS (SELECT l_orderkey, min(code) AS code FROM m GROUP BY 1 HAVING count(*) = 1)
SELECT o_orderkey, code, o_custkey::VARCHAR AS score, o_orderstatus FROM v JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 9 <> 0 AND o_custkey IS NOT NULL""",
    "set_union": "SELECT s_suppkey AS key, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer",
    "set_difference": """WITH e AS (SELECT DISTINCT c_custkey AS key FROM customer), s AS (SELECT DISTINCT o_custkey + 7 AS key FROM orders)
SELECT key, 'missing' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM s) UNION ALL SELECT key, 'unexpected' FROM (SELECT * FROM s EXCEPT SELECT * FROM e)""",
    "set_distinct": "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) <= 1 THEN min(o_orderstatus) END AS o_orderstatus, count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders GROUP BY 1",
    "set_partition": """SELECT CASE WHEN o_custkey % 5 = 0 THEN 'pilot' ELSE 'holdout' END AS part, count(DISTINCT o_custkey) + (count(*) > count(o_custkey))::INT AS targets, count(*)::BIGINT AS "rows", 0::BIGINT AS crossing FROM orders GROUP BY 1""",
    "sp_suite": f"""WITH items AS ({_ITEMS}), {_POSITION}, {_RANDOM} SELECT assay_id, code, 'random' AS split, CASE WHEN (assay_id, code) IN (SELECT (assay_id, code) FROM picked) THEN 'test' ELSE 'train' END AS role FROM items
UNION ALL SELECT assay_id, code, 'position', CASE WHEN (assay_id, position) IN (SELECT (assay_id, position) FROM held) THEN 'test' ELSE 'train' END FROM items
UNION ALL SELECT assay_id, code, 'modulo', CASE WHEN position % 5 = 2 THEN 'test' ELSE 'train' END FROM items""",
    "sp_calibration": f"""WITH items AS ({_ITEMS}), {_POSITION}, tr AS (SELECT * FROM items WHERE (assay_id, position) NOT IN (SELECT (assay_id, position) FROM held)),
x AS (SELECT assay_id, code, count(*) OVER (PARTITION BY assay_id) AS n, row_number() OVER (PARTITION BY assay_id ORDER BY {_DRAW.format("'1|' || code")}, code) AS i FROM tr) SELECT assay_id, code, CASE WHEN i <= ceil(n * 0.2::DOUBLE) THEN 'calibration' ELSE 'fit' END AS role FROM x""",
    "sp_seeds": f"""WITH items AS ({_ITEMS}), x AS (SELECT assay_id, code, seed::INTEGER AS seed, count(*) OVER (PARTITION BY assay_id, seed) AS n, row_number() OVER (PARTITION BY assay_id, seed ORDER BY {_DRAW.format("seed || '|' || code")}, code) AS i FROM items, range(3, 5) s(seed))
SELECT assay_id, code, seed, CASE WHEN i <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS role FROM x""",
    "o_stable_sort": "SELECT o_orderstatus, o_custkey, o_orderkey FROM orders",
}
