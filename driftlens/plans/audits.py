"""Queries of intervals, policies and table audits, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.codes import RESIDUES
from driftlens.operators import intervals, metrics, policies, splits, summaries, tables
from driftlens.plans.bindings import items, scores
from driftlens.plans.studies import _DRAW, _FLAT, _ITEMS, _POSITION, _SCORES, _TASK_SQL, TASK, _ranked, _round

_RADIUS = f"""res AS (SELECT *, abs(observed - predicted) AS r, count(*) OVER (PARTITION BY {_TASK_SQL}) AS n,
  row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY abs(observed - predicted), code) AS i FROM scores),
  rad AS (SELECT {_TASK_SQL}, r AS radius FROM res WHERE i = least(n, ceil((n + 1) * 0.8::DOUBLE)))"""
_TOP = f"""ranked AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY {_TASK_SQL}) * 0.1::DOUBLE)) AS kk, row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY predicted DESC, code) AS a FROM scores),
  gains AS (SELECT protein_id, {_TASK_SQL}, round((avg(observed) FILTER (a <= kk) - avg(observed)) / stddev_pop(observed), 9) AS gain, round(avg(predicted), 6) AS decision FROM ranked GROUP BY ALL),
  best AS (SELECT *, max(gain) OVER (PARTITION BY assay_id) - gain AS regret, row_number() OVER (PARTITION BY assay_id ORDER BY decision DESC, model_id) AS i FROM gains),
  chosen AS (SELECT * EXCLUDE (i), protein_id AS panel FROM best WHERE i = 1)"""
_CURVE = f"""WITH {_SCORES}, {_TOP}, r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY decision DESC, assay_id) AS i, count(*) OVER (PARTITION BY model_id) AS n FROM chosen),
  g AS (SELECT r.*, c / 10.0::DOUBLE AS coverage, ceil(n * (c / 10.0::DOUBLE)) AS k FROM r, range(1, 11) s(c)),
  t AS (SELECT *, row_number() OVER (PARTITION BY model_id, coverage ORDER BY gain, assay_id) AS low FROM g WHERE i <= k),
  curve AS (SELECT model_id, coverage, count(*) AS retained, avg((gain <= 0)::INT::DOUBLE) AS failure, avg(gain) AS mean_gain, avg(regret) AS mean_regret, avg(gain) FILTER (low <= ceil(k * 0.2::DOUBLE)) AS tail_gain,
    median(gain) AS median_gain, median(regret) AS median_regret, min(decision) AS threshold FROM t GROUP BY ALL)"""


def _with_radius(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(spark, d)
    return rows.join(metrics.conformal_radius(rows, TASK, "code"), TASK)


def w_pct_rank(spark: SparkSession, d: str) -> DataFrame:
    share = metrics.average_rank("predicted", TASK) / F.count(F.lit(1)).over(metrics.Window.partitionBy(*TASK))
    return _round(scores(spark, d).select(*TASK, "code", share.alias("pct_rank")), "pct_rank")


def m_interval_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_radius(spark, d).withColumns({"lower": F.col("predicted") - F.col("radius"), "upper": F.col("predicted") + F.col("radius")})
    # the residual that sets the radius lies on the edge of its interval, within rounding of it
    rows = rows.withColumns({"lower": F.col("lower") - 1e-6, "upper": F.col("upper") + 1e-6})
    return _round(intervals.interval_metrics(rows, TASK, "lower", "upper"), "coverage").withColumns({"mean_width": F.round("mean_width", 4), "median_width": F.round("median_width", 4)})


def m_position_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _round(intervals.position_coverage(_with_radius(spark, d), TASK, "radius"), "mean", "p10", "min")


def m_group_mae(spark: SparkSession, d: str) -> DataFrame:
    errors = scores(spark, d).withColumn("error", F.abs(F.col("observed") - F.col("predicted")))
    return _round(summaries.balanced(errors, ["model_id"], ["assay_id"], "error"), "mean", digits=3)


def c_mondrian(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(spark, d).withColumn("grp", F.col("position") % 7)
    return _round(intervals.mondrian_radius(rows, TASK, "grp", "code", least=45), "radius", digits=4)


def c_group_max(spark: SparkSession, d: str) -> DataFrame:
    return _round(intervals.group_max_radius(scores(spark, d), TASK, "position"), "radius", digits=4)


def c_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    return _round(intervals.hierarchical_radius(scores(spark, d), TASK, "position", "code"), "radius", digits=4)


def j_nearest_position(spark: SparkSession, d: str) -> DataFrame:
    return intervals.nearest_fitted(splits.position(items(spark, d), ["assay_id"]), ["assay_id"])


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(spark, d)
    gains = metrics.top_selection(rows, ["protein_id", *TASK], "code").select("protein_id", *TASK, F.round("gain_sd", 9).alias("gain"))
    decisions = rows.groupBy(*TASK).agg(F.round(F.avg("predicted"), 6).alias("decision"))
    return policies.choose(gains.join(decisions, TASK), ["assay_id"], "model_id", "decision", "gain")


def pl_choose(spark: SparkSession, d: str) -> DataFrame:
    return _round(_chosen(spark, d).select("protein_id", *TASK, "decision", "gain", "regret"), "decision", "gain", "regret", digits=6)


def pl_curve(spark: SparkSession, d: str) -> DataFrame:
    return _round(policies.curve(_chosen(spark, d), ["model_id"], ["assay_id"], "decision"), "failure", "mean_gain", "mean_regret", "tail_gain", "median_gain", "median_regret", "threshold", digits=6)


def s_policy(spark: SparkSession, d: str) -> DataFrame:
    points = policies.curve(_chosen(spark, d), ["model_id"], ["assay_id"], "decision")
    made = policies.summary(points, ["model_id"])
    return _round(made, *made.columns[1:], digits=6)


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.repeat(F.lit(RESIDUES), 3).alias("sequence"))


def p_substitution_universe(spark: SparkSession, d: str) -> DataFrame:
    return tables.substitutions(_sequences(spark, d), "sequence")


def p_table_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet")
    rows = rows.withColumns({"o_totalprice": F.round(F.col("o_totalprice") * 100).cast("long"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority": F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderpriority"))})
    return tables.table_digest(rows)


def j_align_scores(spark: SparkSession, d: str) -> DataFrame:
    source = items(spark, d)
    # some source rows and some scores stand twice
    source = source.unionByName(source.filter("position % 17 = 0"))
    stored = source.filter("position % 11 <> 0").select("assay_id", "code", F.when(F.col("position") % 13 != 0, F.col("qty")).alias("qty"))
    stored = stored.unionByName(stored.filter("substr(code, 2) LIKE '2%'"))
    return _round(tables.align(source, stored, ["assay_id"], "code", "qty"), "share")


def sp_depth(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    parts = F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda i: F.concat(F.lit("A"), i.cast("string"), F.lit("C")))
    made = lines.groupBy("l_orderkey").agg(F.array_join(parts, "/").alias("code"))
    return made.select("l_orderkey", "code", tables.depth_role(F.col("code"), 1, 5).alias("role"))


def sp_group_kfold(spark: SparkSession, d: str) -> DataFrame:
    return tables.group_folds(scores(spark, d), ["model_id"], "protein_id")


def w_group_weights(spark: SparkSession, d: str) -> DataFrame:
    return _round(tables.group_weights(scores(spark, d), ["model_id"], "assay_id"), "weight")


def w_islands(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("event_id") % 50 + 1
    spans = spark.read.parquet(f"{d}/events.parquet").filter("user_id IS NOT NULL AND value IS NOT NULL").select("user_id", start.alias("start"), (start + F.floor(F.abs("value")) % 5).alias("stop"))
    return _round(tables.covered_share(spans, ["user_id"], "start", "stop", 52), "share")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        w_pct_rank, m_interval_metrics, m_position_coverage, m_group_mae, c_mondrian, c_group_max, c_hierarchical, j_nearest_position, pl_choose, pl_curve, s_policy,
        p_substitution_universe, p_table_digest, j_align_scores, sp_depth, sp_group_kfold, w_group_weights, w_islands,
    )
}

_HEAD = "10:o_orderkey=bigint;9:o_custkey=bigint;13:o_orderstatus=string;12:o_totalprice=bigint;11:o_orderdate=string;15:o_orderpriority=string;"
_HEAD = "".join(sorted((x + ";" for x in _HEAD[:-1].split(";")), key=lambda x: x.split(":")[1]))
_PART = "coalesce(length({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_DIGEST = f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice * 100)::BIGINT AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders)
SELECT count(*) AS rows, coalesce(sum(('0x' || substr(sha256('{_HEAD}' || {" || ".join(_PART.format(c) for c in sorted(("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))}), 1, 15))::BIGINT), 0)::VARCHAR AS digest, sha256('{_HEAD}') AS head FROM o"""
_TAKE = "row_number() OVER (PARTITION BY {} ORDER BY r, {})"
ORACLES: dict[str, str] = {
    "w_pct_rank": f"WITH {_SCORES}, {_ranked('scores', _TASK_SQL)} SELECT {_TASK_SQL}, code, round(rp / count(*) OVER (PARTITION BY {_TASK_SQL}), 9) AS pct_rank FROM ranked",
    "m_interval_metrics": f"""WITH {_SCORES}, {_RADIUS}, e AS (SELECT s.*, predicted - radius - 1e-6::DOUBLE AS lo, predicted + radius + 1e-6::DOUBLE AS hi FROM scores s JOIN rad USING ({_TASK_SQL}))
SELECT {_TASK_SQL}, round(avg((observed >= lo AND observed <= hi)::INT::DOUBLE), 9) AS coverage, round(avg(hi - lo), 4) AS mean_width, round(median(hi - lo), 4) AS median_width FROM e GROUP BY ALL""",
    "m_position_coverage": f"""WITH {_SCORES}, {_RADIUS}, p AS (SELECT {_TASK_SQL}, position, avg((abs(observed - predicted) <= radius)::INT::DOUBLE) AS share FROM scores JOIN rad USING ({_TASK_SQL}) GROUP BY ALL)
SELECT {_TASK_SQL}, count(*) AS positions, round(avg(share), 9) AS mean, round(quantile_cont(share, 0.1), 9) AS p10, round(min(share), 9) AS min FROM p GROUP BY ALL""",
    "m_group_mae": f"""WITH {_SCORES}, a AS (SELECT {_TASK_SQL}, avg(abs(observed - predicted)) AS e FROM scores GROUP BY ALL) SELECT model_id, count(*) AS units, round(avg(e), 3) AS mean FROM a GROUP BY 1""",
    "c_mondrian": f"""WITH {_SCORES}, {_RADIUS}, g AS (SELECT *, position % 7 AS grp, count(*) OVER (PARTITION BY {_TASK_SQL}, position % 7) AS m, {_TAKE.format(_TASK_SQL + ", position % 7", "code")} AS j FROM res)
SELECT {_TASK_SQL}, g.grp, g.m AS n, round(CASE WHEN g.m >= 45 THEN g.r ELSE rad.radius END, 4) AS radius FROM g JOIN rad USING ({_TASK_SQL}) WHERE g.j = least(g.m, ceil((g.m + 1) * 0.8::DOUBLE))""",
    "c_group_max": f"""WITH {_SCORES}, w AS (SELECT {_TASK_SQL}, position, max(abs(observed - predicted)) AS r FROM scores GROUP BY ALL),
o AS (SELECT *, count(*) OVER (PARTITION BY {_TASK_SQL}) AS n, {_TAKE.format(_TASK_SQL, "position")} AS i FROM w) SELECT {_TASK_SQL}, round(r, 4) AS radius FROM o WHERE i = least(n, ceil((n + 1) * 0.8::DOUBLE))""",
    "c_hierarchical": f"""WITH {_SCORES}, g AS (SELECT {_TASK_SQL}, count(DISTINCT position) AS g FROM scores GROUP BY ALL),
z AS (SELECT s.*, g.g, abs(observed - predicted) AS r, count(*) OVER (PARTITION BY {_TASK_SQL}, position) AS size FROM scores s JOIN g USING ({_TASK_SQL})),
m AS (SELECT *, sum(1.0::DOUBLE / ((g + 1) * size)) OVER (PARTITION BY {_TASK_SQL} ORDER BY r, code ROWS UNBOUNDED PRECEDING) AS mass FROM z)
SELECT {_TASK_SQL}, round(min(r) FILTER (mass >= 0.8::DOUBLE - 1e-9::DOUBLE), 4) AS radius FROM m GROUP BY ALL""",
    "j_nearest_position": f"""WITH items AS ({_ITEMS}), {_POSITION}, fit AS (SELECT DISTINCT i.assay_id, i.position FROM items i ANTI JOIN held h ON i.assay_id = h.assay_id AND i.position = h.position)
SELECT h.assay_id, h.position, min(abs(h.position - f.position)) AS distance FROM held h LEFT JOIN fit f USING (assay_id) GROUP BY ALL""",
    "pl_choose": f"WITH {_SCORES}, {_TOP} SELECT protein_id, {_TASK_SQL}, round(decision, 6) AS decision, round(gain, 6) AS gain, round(regret, 6) AS regret FROM chosen",
    "pl_curve": f"{_CURVE} SELECT model_id, coverage, retained, round(failure, 6) AS failure, round(mean_gain, 6) AS mean_gain, round(mean_regret, 6) AS mean_regret, round(tail_gain, 6) AS tail_gain, round(median_gain, 6) AS median_gain, round(median_regret, 6) AS median_regret, round(threshold, 6) AS threshold FROM curve",
    "s_policy": f"""{_CURVE}, l AS (SELECT model_id, coverage, mean_regret, failure, mean_gain, {", ".join(f"(coverage - lag(coverage) OVER w) * ({v} + lag({v}) OVER w) / 2 AS s_{v}" for v in ("mean_regret", "failure", "mean_gain"))} FROM curve WINDOW w AS (PARTITION BY model_id ORDER BY coverage))
SELECT model_id, {", ".join(f"round(sum(s_{v}), 6) AS {v}_area, round(max({v}) FILTER (coverage = 0.5::DOUBLE), 6) AS {v}_half" for v in ("mean_regret", "failure", "mean_gain"))} FROM l GROUP BY 1""",
    "p_substitution_universe": f"""WITH s AS (SELECT s_suppkey, repeat('{RESIDUES}', 3) AS q FROM supplier), p AS (SELECT s_suppkey, i::INTEGER AS position, substr(q, i, 1) AS ref FROM s, range(1, 61) r(i))
SELECT s_suppkey, position, ref, alt, ref || position || alt AS code FROM p, (SELECT unnest(string_split('{" ".join(RESIDUES)}', ' ')) AS alt) WHERE alt <> ref""",
    "p_table_digest": _DIGEST,
    "j_align_scores": f"""WITH one AS ({_ITEMS}), items AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE position % 17 = 0),
once AS (SELECT assay_id, code, CASE WHEN position % 13 <> 0 THEN qty END AS qty FROM items WHERE position % 11 <> 0), stored AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE substr(code, 2) LIKE '2%'),
l AS (SELECT assay_id, code, count(*) AS n FROM items GROUP BY ALL), r AS (SELECT assay_id, code, count(*) AS m, count(qty) AS v FROM stored GROUP BY ALL)
SELECT assay_id, sum(n)::BIGINT AS source_rows, count(m) AS matched, count(*) FILTER (n > 1) AS source_repeats, count(*) FILTER (m > 1) AS score_repeats, round(count(*) FILTER (v > 0) / count(*), 9) AS share FROM l LEFT JOIN r USING (assay_id, code) GROUP BY 1""",
    "sp_depth": """WITH o AS (SELECT l_orderkey, string_agg('A' || l_linenumber || 'C', '/' ORDER BY l_linenumber) AS code, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1)
SELECT l_orderkey, code, CASE WHEN n <= 1 THEN 'train' WHEN n <= 5 THEN 'test' END AS role FROM o""",
    "sp_group_kfold": f"""WITH {_SCORES}, s AS (SELECT model_id, protein_id, count(*) AS n FROM scores GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY n DESC, {_DRAW.format("'1|' || protein_id")}, protein_id) - 1 AS t FROM s)
SELECT model_id, protein_id, n, (CASE WHEN (t // 5) % 2 = 1 THEN 4 - t % 5 ELSE t % 5 END)::INTEGER AS fold FROM t""",
    "w_group_weights": f"""WITH {_SCORES}, s AS (SELECT model_id, assay_id, count(*) AS n FROM scores GROUP BY ALL)
SELECT *, round(sum(n) OVER (PARTITION BY model_id) / (count(*) OVER (PARTITION BY model_id) * n), 9) AS weight FROM s""",
    "w_islands": """WITH s AS (SELECT user_id, event_id % 50 + 1 AS a, event_id % 50 + 1 + floor(abs(value))::BIGINT % 5 AS b FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
c AS (SELECT DISTINCT user_id, x FROM (SELECT user_id, unnest(range(a, least(b, 52) + 1)) AS x FROM s)),
n AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY x) AS before FROM c)
SELECT user_id, count(*) FILTER (before IS NULL OR before < x - 1) AS islands, round(count(*) / 52.0::DOUBLE, 9) AS share FROM n GROUP BY 1""",
}
