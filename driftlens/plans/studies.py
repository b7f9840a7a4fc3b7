"""The registered queries of the evaluation operators, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import codes
from driftlens.operators import graph, metrics, splits, summaries
from driftlens.plans.bindings import ITEMS, items, scores

TASK = ["assay_id", "model_id"]
_ITEMS = ITEMS.format(lineitem="lineitem")
_SCORES = f"""items AS ({_ITEMS}), scores AS (SELECT assay_id, protein_id, family_id, position, code, observed, 'qty' AS model_id, qty * 1000.0::DOUBLE AS predicted FROM items
  UNION ALL SELECT assay_id, protein_id, family_id, position, code, observed, 'disc', disc * 1000.0::DOUBLE FROM items
  UNION ALL SELECT assay_id, protein_id, family_id, position, code, observed, 'tax', tax * 1000.0::DOUBLE FROM items)"""
_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def _ranked(source: str, by: str) -> str:
    return f"""ranked AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY observed) + (count(*) OVER (PARTITION BY {by}, observed) - 1) / 2.0::DOUBLE AS ro,
  rank() OVER (PARTITION BY {by} ORDER BY predicted) + (count(*) OVER (PARTITION BY {by}, predicted) - 1) / 2.0::DOUBLE AS rp FROM {source})"""


_FLAT = "CASE WHEN max(observed) - min(observed) < 1e-12 OR max(predicted) - min(predicted) < 1e-12 THEN 0.0::DOUBLE ELSE corr(ro, rp) END"
_POSITION = f"""pos AS (SELECT assay_id, position, count(*) OVER (PARTITION BY assay_id) AS n, row_number() OVER (PARTITION BY assay_id ORDER BY {_DRAW.format("'1|' || position")}, position) AS i FROM (SELECT DISTINCT assay_id, position FROM items)),
  held AS (SELECT assay_id, position FROM pos WHERE i <= least(n - 1, greatest(1, round_even(n * 0.2::DOUBLE, 0))))"""
_RANDOM = f"""cod AS (SELECT assay_id, code, count(*) OVER (PARTITION BY assay_id) AS n, row_number() OVER (PARTITION BY assay_id ORDER BY {_DRAW.format("'1|' || code")}, code) AS i FROM (SELECT DISTINCT assay_id, code FROM items)),
  picked AS (SELECT assay_id, code FROM cod WHERE i <= ceil(n * 0.2::DOUBLE))"""


def _round(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def x_parse_code(spark: SparkSession, d: str) -> DataFrame:
    parsed = items(spark, d).select("assay_id", "code", codes.parse(F.col("code")).alias("m"))
    sequence = F.repeat(F.lit(codes.RESIDUES), 3)
    return parsed.select("assay_id", "code", F.element_at("m", 1)["ref"].alias("ref"), F.element_at("m", 1)["pos"].alias("pos"), F.element_at("m", 1)["alt"].alias("alt"), codes.agrees(F.col("m"), sequence).alias("agrees"), codes.digest(codes.apply_to(F.col("m"), sequence)).alias("digest"))


def m_regression(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.regression(scores(spark, d), TASK), "spearman", "r2").withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4)})


def m_top_selection(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.top_selection(scores(spark, d), TASK, "code"), "top_recall", "gain_sd", "regret_sd").withColumn("selected_mean", F.round("selected_mean", 4))


def m_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.ndcg(scores(spark, d), TASK, "code"), "ndcg")


def m_conformal_radius(spark: SparkSession, d: str) -> DataFrame:
    return metrics.conformal_radius(scores(spark, d), TASK, "code").withColumn("radius", F.round("radius", 4))


def m_risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(spark, d).withColumn("unc", F.abs("predicted"))
    return metrics.risk_coverage(rows, TASK, "code", "unc", [0.25, 0.5, 1.0]).withColumns({"mae": F.round("mae", 2), "threshold": F.round("threshold", 6)})


def w_average_rank(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select(*TASK, "code", metrics.average_rank("predicted", TASK).alias("rank"))


def _roles(split) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: split(items(spark, d)).select("assay_id", "code", "position", "role")


def a_leakage(spark: SparkSession, d: str) -> DataFrame:
    return splits.leakage(splits.position(items(spark, d), ["assay_id"]), ["assay_id"])


def _split_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.random_item(items(spark, d), ["assay_id"]).withColumnRenamed("role", "by_code")
    rows = splits.position(rows, ["assay_id"]).withColumnRenamed("role", "by_position")
    tested = F.array_compact(F.array(F.when(F.col("by_code") == "test", "random"), F.when(F.col("by_position") == "test", "position")))
    kept = ["protein_id", "assay_id", "split", "code", "observed"]
    # exploded, rows stay where their assay is; an unpivot would deal them anew, into tasks merged for their small size
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("model_id"), (F.col(c) * 1000.0).alias("predicted")) for c in ("qty", "disc", "tax")))).alias("_m")
    long = rows.withColumn("split", F.explode(tested)).select(*kept, each).select(*kept, "_m.*")
    return metrics.regression(long, ["protein_id", *TASK, "split"])


def run_fixed_scores(spark: SparkSession, d: str) -> DataFrame:
    """Stored scores on items left out at random and on positions left out, and the gap of each task."""
    return _round(summaries.gaps(_split_runs(spark, d), ["protein_id", *TASK], "split", "spearman", "random", "position"), "random_spearman", "position_spearman", "spearman_gap")


def s_zero_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round(summaries.balanced(_split_runs(spark, d), ["model_id", "split"], ["protein_id"], "spearman"), "mean")


def s_robustness(spark: SparkSession, d: str) -> DataFrame:
    return _round(summaries.distribution(metrics.regression(scores(spark, d), TASK), ["model_id"], "spearman"), "mean", "sd", "min", "p05", "p95", "max")


def b_cluster_mean(spark: SparkSession, d: str) -> DataFrame:
    values = items(spark, d).groupBy("family_id", "protein_id").agg(F.avg("observed").alias("v"))
    return _round(summaries.bootstrap_mean(values, ["family_id"], "protein_id", "v"), "lower", "upper", digits=4)


def b_holm(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("g"), "s_name", ((F.abs("s_acctbal") % 1000) / 10000.0).alias("p"))
    return _round(summaries.holm(p, ["g"], "s_name", "p"), "p", "adjusted")


def g_components(spark: SparkSession, d: str) -> DataFrame:
    """Users and the events they share."""
    events = spark.read.parquet(f"{d}/events.parquet").filter("user_id IS NOT NULL")
    event = F.col("event_id") + 1_000_000_000
    edges = events.select(F.col("user_id").alias("a"), event.alias("b"))
    return graph.components(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), edges)


def g_components_all(spark: SparkSession, d: str) -> DataFrame:
    """Components over the edges of all events; the ids grow with the table. Without SQL: recursion over all reaches is too slow."""
    events = spark.read.parquet(f"{d}/events.parquet")
    edges = events.select(F.col("user_id").alias("a"), (F.col("user_id") * 31 + F.col("event_id")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return graph.components(nodes, edges)


_TASK_SQL = "assay_id, model_id"
_ROLE = "SELECT i.assay_id, i.code, i.position, CASE WHEN {} THEN 'test' ELSE 'train' END AS role FROM items i"
_RUNS = f"""WITH {_SCORES}, {_POSITION}, {_RANDOM}, test AS (SELECT s.*, 'random' AS split FROM scores s JOIN picked USING (assay_id, code)
  UNION ALL SELECT s.*, 'position' FROM scores s JOIN held h ON s.assay_id = h.assay_id AND s.position = h.position),
  {_ranked("test", "protein_id, assay_id, model_id, split")}, runs AS (SELECT protein_id, assay_id, model_id, split, {_FLAT} AS spearman FROM ranked GROUP BY ALL)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "x_parse_code": x_parse_code, "m_regression": m_regression, "m_top_selection": m_top_selection, "m_ndcg": m_ndcg, "m_conformal_radius": m_conformal_radius,
    "m_risk_coverage": m_risk_coverage, "w_average_rank": w_average_rank,
    "sp_random_item": _roles(lambda x: splits.random_item(x, ["assay_id"])), "sp_position": _roles(lambda x: splits.position(x, ["assay_id"])),
    "sp_modulo": _roles(lambda x: splits.modulo(x, 2)), "sp_contiguous": _roles(lambda x: splits.contiguous(x, ["assay_id"], 2)),
    "a_leakage": a_leakage, "run_fixed_scores": run_fixed_scores, "s_zero_summary": s_zero_summary, "s_robustness": s_robustness,
    "b_cluster_mean": b_cluster_mean, "b_holm": b_holm, "g_components": g_components, "g_components_all": g_components_all,
}

ORACLES: dict[str, str] = {
    "x_parse_code": f"""WITH items AS ({_ITEMS}), s AS (SELECT repeat('{codes.RESIDUES}', 3) AS q)
SELECT assay_id, code, ref, position::INTEGER AS pos, alt, substr(q, position::INTEGER, 1) = ref AS agrees,
  sha256(substr(q, 1, position::INTEGER - 1) || alt || substr(q, position::INTEGER + 1)) AS digest FROM items, s""",
    "m_regression": f"""WITH {_SCORES}, {_ranked("scores", _TASK_SQL)}, m AS (SELECT *, avg(observed) OVER (PARTITION BY {_TASK_SQL}) AS mu FROM ranked)
SELECT {_TASK_SQL}, count(*) AS n, round({_FLAT}, 9) AS spearman, round(sqrt(avg(pow(observed - predicted, 2))), 4) AS rmse, round(avg(abs(observed - predicted)), 4) AS mae,
  round(1 - sum(pow(observed - predicted, 2)) / sum(pow(observed - mu, 2)), 9) AS r2 FROM m GROUP BY ALL""",
    "m_top_selection": f"""WITH {_SCORES}, k AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY {_TASK_SQL}) * 0.1::DOUBLE)) AS kk,
  row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY predicted DESC, code) AS a, row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY observed DESC, code) AS b FROM scores)
SELECT {_TASK_SQL}, max(kk)::BIGINT AS k, round(count(*) FILTER (a <= kk AND b <= kk) / max(kk), 9) AS top_recall, round(avg(observed) FILTER (a <= kk), 4) AS selected_mean,
  round(CASE WHEN stddev_pop(observed) > 1e-12 THEN (avg(observed) FILTER (a <= kk) - avg(observed)) / stddev_pop(observed) ELSE 0 END, 9) AS gain_sd,
  round(CASE WHEN stddev_pop(observed) > 1e-12 THEN (max(observed) - max(observed) FILTER (a <= kk)) / stddev_pop(observed) ELSE 0 END, 9) AS regret_sd FROM k GROUP BY ALL""",
    "m_ndcg": f"""WITH {_SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY observed, code) / count(*) OVER (PARTITION BY {_TASK_SQL})::DOUBLE AS rel,
  row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY predicted DESC, code) AS p, row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY observed DESC, code DESC) AS b FROM scores)
SELECT {_TASK_SQL}, round(sum((pow(2, rel) - 1) / log2(p + 1)) / sum((pow(2, rel) - 1) / log2(b + 1)), 9) AS ndcg FROM k GROUP BY ALL""",
    "m_conformal_radius": f"""WITH {_SCORES}, r AS (SELECT {_TASK_SQL}, abs(observed - predicted) AS r, count(*) OVER (PARTITION BY {_TASK_SQL}) AS n,
  row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY abs(observed - predicted), code) AS i FROM scores)
SELECT {_TASK_SQL}, round(r, 4) AS radius FROM r WHERE i = least(n, ceil((n + 1) * 0.8::DOUBLE))""",
    "m_risk_coverage": f"""WITH {_SCORES}, r AS (SELECT *, abs(predicted) AS unc, count(*) OVER (PARTITION BY {_TASK_SQL}) AS n, row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY abs(predicted), code) AS i FROM scores)
SELECT {_TASK_SQL}, c::DOUBLE AS coverage, count(*) AS retained, round(avg(abs(observed - predicted)), 2) AS mae, round(max(unc), 6) AS threshold
FROM r, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) v(c) WHERE i <= ceil(n * c) GROUP BY {_TASK_SQL}, c""",
    "w_average_rank": f"WITH {_SCORES}, {_ranked('scores', _TASK_SQL)} SELECT {_TASK_SQL}, code, rp AS rank FROM ranked",
    "sp_random_item": f"WITH items AS ({_ITEMS}), {_RANDOM} {_ROLE.format('(i.assay_id, i.code) IN (SELECT (assay_id, code) FROM picked)')}",
    "sp_position": f"WITH items AS ({_ITEMS}), {_POSITION} {_ROLE.format('(i.assay_id, i.position) IN (SELECT (assay_id, position) FROM held)')}",
    "sp_modulo": f"WITH items AS ({_ITEMS}) {_ROLE.format('i.position % 5 = 2')}",
    "sp_contiguous": f"""WITH items AS ({_ITEMS}), b AS (SELECT assay_id, position, ntile(5) OVER (PARTITION BY assay_id ORDER BY position) - 1 AS b FROM (SELECT DISTINCT assay_id, position FROM items))
{_ROLE.format('b.b = 2')} JOIN b USING (assay_id, position)""",
    "a_leakage": f"""WITH items AS ({_ITEMS}), {_POSITION}, r AS ({_ROLE.format('(i.assay_id, i.position) IN (SELECT (assay_id, position) FROM held)')}),
c AS (SELECT assay_id, count(*) FILTER (n > 1) AS shared_code FROM (SELECT assay_id, code, count(DISTINCT role) AS n FROM r GROUP BY ALL) GROUP BY 1),
p AS (SELECT assay_id, count(*) FILTER (n > 1) AS shared_position FROM (SELECT assay_id, position, count(DISTINCT role) AS n FROM r GROUP BY ALL) GROUP BY 1)
SELECT assay_id, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'test') AS test_rows, any_value(shared_code) AS shared_code, any_value(shared_position) AS shared_position FROM r JOIN c USING (assay_id) JOIN p USING (assay_id) GROUP BY 1""",
    "run_fixed_scores": f"""{_RUNS} SELECT protein_id, assay_id, model_id, round(max(spearman) FILTER (split = 'random'), 9) AS random_spearman, round(max(spearman) FILTER (split = 'position'), 9) AS position_spearman,
  round(max(spearman) FILTER (split = 'random') - max(spearman) FILTER (split = 'position'), 9) AS spearman_gap FROM runs GROUP BY ALL""",
    "s_zero_summary": f"""{_RUNS}, p AS (SELECT model_id, split, protein_id, avg(spearman) AS v FROM runs GROUP BY ALL) SELECT model_id, split, count(*) AS units, round(avg(v), 9) AS mean FROM p GROUP BY ALL""",
    "s_robustness": f"""WITH {_SCORES}, {_ranked("scores", _TASK_SQL)}, t AS (SELECT {_TASK_SQL}, {_FLAT} AS s FROM ranked GROUP BY ALL)
SELECT model_id, count(s) AS n, round(avg(s), 9) AS mean, round(stddev_samp(s), 9) AS sd, round(min(s), 9) AS min, round(quantile_cont(s, 0.05), 9) AS p05, round(quantile_cont(s, 0.95), 9) AS p95, round(max(s), 9) AS max FROM t GROUP BY 1""",
    "b_cluster_mean": f"""WITH items AS ({_ITEMS}), v AS (SELECT family_id, protein_id, avg(observed) AS v FROM items GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY protein_id) - 1 AS i, count(*) OVER (PARTITION BY family_id) AS n FROM v),
d AS (SELECT family_id, n, rep, {_DRAW.format("'1|' || rep || '|' || i")} % n AS i FROM u, range(200) r(rep)),
m AS (SELECT d.family_id, d.rep, any_value(d.n) AS n, avg(u.v) AS mean FROM d JOIN u ON d.family_id = u.family_id AND d.i = u.i GROUP BY 1, 2)
SELECT family_id, round(CASE WHEN max(n) > 1 THEN quantile_cont(mean, 0.025) END, 4) AS lower, round(CASE WHEN max(n) > 1 THEN quantile_cont(mean, 0.975) END, 4) AS upper FROM m GROUP BY 1""",
    "b_holm": """WITH p AS (SELECT s_nationkey AS g, s_name, (abs(s_acctbal) % 1000) / 10000.0::DOUBLE AS p FROM supplier),
a AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER (PARTITION BY g) - row_number() OVER (PARTITION BY g ORDER BY p, s_name) + 1) * p) AS a FROM p)
SELECT g, s_name, round(p, 9) AS p, round(max(a) OVER (PARTITION BY g ORDER BY p, s_name ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM a""",
    "g_components": """WITH RECURSIVE e AS (SELECT user_id AS a, event_id + 1000000000 AS b FROM events WHERE user_id IS NOT NULL),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS reach FROM both_ways UNION SELECT r.node, w.b FROM r JOIN both_ways w ON r.reach = w.a)
SELECT node, min(reach) AS component FROM r GROUP BY 1""",
}
