"""Queries of resampling over levels, abstention, interval suites, unions of families and registries, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.operators import fits, graph, intervals, joins, metrics, nested, panels, registries, summaries
from driftlens.operators.storage import stored
from driftlens.plans.audits import _TOP, _chosen
from driftlens.plans.bindings import items, scores
from driftlens.plans.studies import _DRAW, _FLAT, _ITEMS, _SCORES, _TASK_SQL, TASK, _ranked, _round

#: Draws of a bootstrap in the registered queries.
REPEATS = 50
LEVELS = ["family_id", "protein_id", "assay_id"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# resampling

def _task_ranks(spark, d):
    return metrics.regression(scores(spark, d), ["family_id", "protein_id", *TASK])


def b_hierarchical_mean(spark, d):
    made = nested.nested_mean(_task_ranks(spark, d), ["model_id"], LEVELS, "spearman", REPEATS)
    return _round(made, "lower", "upper", "p", digits=6)


def _sides(spark, d):
    """Each assay's rank correlation of two models, and the difference."""
    side = lambda m: F.max(F.when(F.col("model_id") == m, F.col("spearman")))
    made = _task_ranks(spark, d).groupBy(*LEVELS).agg(side("qty").alias("one"), side("disc").alias("two"))
    return made.withColumn("delta", F.col("one") - F.col("two"))


def b_pair_differences(spark, d):
    drawn = nested.pooled(_sides(spark, d), ["family_id"], "protein_id", ["delta"], REPEATS)
    return _round(nested.limits(drawn, ["family_id"], "delta"), "lower", "upper", "p", digits=6)


def b_paired_group(spark, d):
    sides = _sides(spark, d).withColumn("half", F.substr("family_id", F.lit(2)).cast("int") % 2)
    drawn = nested.pooled(sides, ["half"], "family_id", ["one", "two"], REPEATS).withColumn("delta", F.col("one") - F.col("two"))
    long = drawn.unpivot(["half", "_rep"], ["one", "two", "delta"], "side", "value")
    return _round(nested.limits(long, ["half", "side"], "value").select("half", "side", "lower", "upper"), "lower", "upper", digits=6)


def b_position_rank(spark, d):
    return _round(nested.position_rank(scores(spark, d), TASK, repeats=REPEATS), "lower", "upper", "p", digits=6)


# abstention

def _surest(spark, d):
    number = F.substr("protein_id", F.lit(2)).cast("int")
    # written once: each level of a bootstrap reads it
    return stored(_chosen(spark, d)).withColumns({"family_id": F.concat(F.lit("F"), (number % 15).cast("string")), "panel": number % 3, "study": number % 2})


def _order() -> list[Column]:
    return [F.desc("decision"), F.col("assay_id")]


def pl_abstain_stats(spark, d):
    return _round(nested.improvements(_surest(spark, d), ["panel"], _order()), *nested.IMPROVEMENTS, digits=6)


def b_improvements(spark, d):
    made = nested.bootstrap_improvements(_surest(spark, d), ["panel"], LEVELS, _order(), REPEATS)
    return _round(made, "lower", "upper", "p", digits=6)


def a_gates_development(spark, d):
    tasks = _surest(spark, d)
    limit = nested.bootstrap_improvements(tasks, ["study"], LEVELS, _order(), REPEATS)
    # sums in another order differ in their last digits, where a gate asks for 0
    limit = limit.withColumn("lower", F.round("lower", 9))
    rounded = lambda by: _round(nested.improvements(tasks, by, _order()), *nested.IMPROVEMENTS)
    return nested.development_gates(limit, rounded(["study"]), rounded(["study", "panel"]), ["study"])


# intervals

def c_suite(spark, d):
    role = F.when(F.col("position") % 5 == 2, "test").when(F.col("position") % 5 == 4, "calibration").otherwise("fit")
    rows = scores(spark, d).withColumn("role", role).withColumn("grp", F.col("position") % 3)
    return _round(intervals.suite(rows, TASK, "code", "grp", least=5).select(*TASK, "code", "method", "half_width"), "half_width", digits=4)


def w_weighted_quantile(spark, d):
    rows = _t(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("w"))
    return intervals.weighted_quantile(rows, ["l_suppkey"], "l_extendedprice", "w", 0.8)


# metrics and runs

def m_training_properties(spark, d):
    rows = scores(spark, d).filter("position % 5 <> 2")
    made = metrics.training_properties(rows, TASK)
    return _round(made, *made.columns[4:], digits=6)


def run_landscape(spark, d):
    """Items that every model has a score for, each model on the same items."""
    rows = items(spark, d).withColumn("tax", F.when(F.col("position") % 7 != 0, F.col("tax"))).dropna(subset=["qty", "disc", "tax"])
    long = rows.unpivot(["assay_id", "code", "observed"], ["qty", "disc", "tax"], "model_id", "predicted").withColumn("predicted", F.col("predicted") * 1000.0)
    return _round(panels.selection(long, TASK, "code"), "spearman", "gain_sd", "top_recall")


def ml_span(spark, d):
    """Of each assay the predictor that ranks its train rows best, on its test rows."""
    rows = scores(spark, d).withColumn("role", F.when(F.col("position") % 5 == 2, "test").otherwise("train"))
    chosen = fits.best_single(rows, ["assay_id"], "model_id")
    return _round(metrics.regression(chosen, [*TASK, "train_spearman"]).select(*TASK, "train_spearman", "n", "spearman"), "train_spearman", "spearman")


def s_heldout(spark, d):
    rows = scores(spark, d).withColumn("unc", F.abs("predicted"))
    kept = metrics.risk_coverage(rows, ["protein_id", *TASK], "code", "unc", [0.25, 0.5, 1.0])
    return _round(summaries.balanced(kept, ["model_id", "coverage"], ["protein_id"], "mae"), "mean", digits=2)


def j_align_fold_scores(spark, d):
    source = items(spark, d)
    stored = source.filter("position % 11 <> 0").select("assay_id", "code", F.when(F.col("position") % 13 != 0, F.col("qty")).alias("qty"), F.when(F.col("position") % 6 != 0, F.col("disc")).otherwise(F.lit(float("nan"))).alias("disc"))
    return joins.align_models(source, stored, ["assay_id"], "code", ["qty", "disc"])


# graphs

def _families(spark, d):
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.floor(F.col("s_suppkey") / 4).alias("family"))


def _links(spark, d):
    k = F.col("s_suppkey")
    return _t(spark, d, "supplier").select(k.alias("a"), (k + k % 9 + 1).alias("b"), (k * 13 % 100 / 100).alias("tm"), (k * 29 % 100 / 100).alias("cov"))


def g_union_families(spark, d):
    return graph.union(_families(spark, d), [_families(spark, d).select("node", F.col("family").alias("group"))], _links(spark, d).filter("tm >= 0.6 AND cov >= 0.6"))


def g_union_annotations(spark, d):
    nodes = _families(spark, d)
    clan = nodes.select("node", F.when(F.col("node") % 5 == 0, F.col("node") % 40).alias("group"))
    return graph.union(nodes, [nodes.select("node", F.col("family").alias("group")), clan])


def g_sensitivity(spark, d):
    links = _links(spark, d).filter("cov >= 0.5")
    return graph.sensitivity(_families(spark, d).select("node"), links, "tm", [0.5, 0.7, 0.9])


def g_joint_families(spark, d):
    nodes = _families(spark, d)
    known = nodes.filter("node % 3 <> 0").select("node", F.col("family").alias("group"))
    return graph.joint(known, nodes.filter("node % 3 = 0"), _links(spark, d).filter("tm >= 0.6"))


# registries

def p_condition_columns(spark, d):
    wide = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(*(F.count_if(F.col("l_linenumber") == i).alias(f"dms_S{i}") for i in (1, 2, 3)), F.lit(0).cast("long").alias("dms_S1_err"), F.max("l_linenumber").alias("dmsx"))
    return wide.unpivot(["l_suppkey"], registries.condition_columns(wide, "dms"), "condition", "value")


def p_outcome_firewall(spark, d):
    frame = items(spark, d).drop("observed")
    registries.refuse_outcomes(frame, exact=["observed"], markers=["outcome", "dms_score"])
    return frame.groupBy("assay_id").agg(F.count(F.lit(1)).alias("rows"))


def p_metadata_candidates(spark, d):
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("reported"))
    rows = _t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("urn"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"), "reported", (F.col("o_custkey") % 100).alias("length"))
    return registries.candidates(rows, "urn", "published", "reported", "length", after="1995-01-31", until="1997-06-30", least=3, lengths=(20, 80))


def p_complement_candidates(spark, d):
    k = F.col("p_partkey")
    rows = _t(spark, d, "part").select(k.alias("urn"), F.md5((k % 700).cast("string")).alias("digest"), (k % 11 == 0).alias("prior_panel"), (k % 13 == 0).alias("doi_overlap"), F.contains("p_name", F.lit("a")).alias("meta_analysis"))
    return registries.excluded(rows, "urn", "digest", ["prior_panel", "doi_overlap", "meta_analysis"])


def p_task_registry(spark, d):
    c = _t(spark, d, "customer")
    part = lambda i, name, down: c.filter(F.col("c_nationkey") % 3 == i).select(F.col("c_custkey").alias("task"), F.lit(name).alias("panel"), F.lit(down).alias("lower_is_better"), (F.col("c_acctbal") > 0).alias("included"))
    return registries.registry([part(0, "development", False), part(1, "external", True), part(2, "untouched", False)], "task")


def a_model_eligibility(spark, d):
    rows = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("model"), F.element_at(F.array(*map(F.lit, ("passed", "failed", "missing"))), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("status"))
    return registries.eligibility(rows, "status")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        b_hierarchical_mean, b_pair_differences, b_paired_group, b_position_rank, pl_abstain_stats, b_improvements, a_gates_development, c_suite, w_weighted_quantile, m_training_properties, run_landscape, ml_span, s_heldout, j_align_fold_scores, g_joint_families,
        g_union_families, g_union_annotations, g_sensitivity, p_condition_columns, p_outcome_firewall, p_metadata_candidates, p_complement_candidates, p_task_registry, a_model_eligibility,
    )
}


# SQL

_T = f"""WITH {_SCORES}, {_ranked("scores", _TASK_SQL)}, t AS (SELECT family_id, protein_id, assay_id, model_id, {_FLAT} AS v FROM ranked GROUP BY ALL)"""
_PAIR = f"""{_T}, s AS (SELECT family_id, protein_id, assay_id, max(v) FILTER (model_id = 'qty') AS one, max(v) FILTER (model_id = 'disc') AS two, max(v) FILTER (model_id = 'qty') - max(v) FILTER (model_id = 'disc') AS delta FROM t GROUP BY ALL)"""
_LIMITS = "round(quantile_cont({0}, 0.025), 6) AS lower, round(quantile_cont({0}, 0.975), 6) AS upper, round((1 + count(*) FILTER ({0} <= 0)) / (1 + count({0})), 6) AS p"


def _units(by: str, unit: str, source: str, columns: str = "") -> str:
    """Distinct units of a level with their place and number."""
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {unit}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM (SELECT DISTINCT {by}, {unit}{columns} FROM {source}))"


def _within(by: str, leaf: str) -> str:
    """CTEs d3(by, family_id, protein_id, assay_id, path): assays drawn level by level."""
    draw = _DRAW.format("'1|' || path || '|' || i")
    return f"""f AS {_units(by, 'family_id', leaf)}, p AS {_units(by + ', family_id', 'protein_id', leaf)}, a AS {_units(by + ', family_id, protein_id', 'assay_id', leaf)},
k1 AS (SELECT {by}, path || '|' || i AS path, {draw} % n AS j FROM f, (SELECT rep::VARCHAR AS path FROM range({REPEATS}) r(rep))), d1 AS (SELECT k.{by}, k.path, f.family_id FROM k1 k JOIN f ON f.{by} = k.{by} AND f.i = k.j),
k2 AS (SELECT d.{by}, d.family_id, path || '|' || i AS path, {draw} % n AS j FROM d1 d JOIN p USING ({by}, family_id)), d2 AS (SELECT k.{by}, k.family_id, k.path, p.protein_id FROM k2 k JOIN p ON p.{by} = k.{by} AND p.family_id = k.family_id AND p.i = k.j),
k3 AS (SELECT d.{by}, d.family_id, d.protein_id, path || '|' || i AS path, {draw} % n AS j FROM d2 d JOIN a USING ({by}, family_id, protein_id)),
d3 AS (SELECT k.{by}, k.family_id, k.protein_id, a.assay_id, k.path, split_part(k.path, '|', 1) AS rep FROM k3 k JOIN a ON a.{by} = k.{by} AND a.family_id = k.family_id AND a.protein_id = k.protein_id AND a.i = k.j)"""


def _pooled(by: str, unit: str, sums: str) -> str:
    """CTE d(by, rep, unit's columns) over u, the units with their sums."""
    draw = _DRAW.format("'1|' || rep || '|' || i")
    return f"""m AS ({sums}), u AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {unit}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM m),
k AS (SELECT {by}, rep, {draw} % n AS i FROM u, range({REPEATS}) r(rep)), d AS (SELECT u.*, k.rep FROM k JOIN u USING ({by}, i))"""


_AREA = {
    "regret": ("last", "avg(regret)"), "risk": ("last", "avg((gain <= 0)::INT::DOUBLE)"), "utility": ("first", "avg(gain)"),
}


def _improved(source: str, by: str, tag: str = "") -> str:
    """CTE imp(by, improvements) over tasks; tag tells several apart."""
    values = ", ".join(f"{e} AS {k}" for k, (_, e) in _AREA.items())
    out = []
    for k, (kind, _) in _AREA.items():
        sign = 1 if kind == "first" else -1
        out.append(f"{sign} * (sum({k} * CASE WHEN c IN (1, 10) THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END) - 0.9::DOUBLE * max({k}) FILTER (c = 10)) AS {k}_auc, {sign} * (max({k}) FILTER (c = 5) - max({k}) FILTER (c = 10)) AS {k}_half")
    return f"""o{tag} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY decision DESC, assay_id) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
pt{tag} AS (SELECT {by}, c, {values} FROM o{tag}, range(1, 11) s(c) WHERE i <= ceil(n * (c / 10.0::DOUBLE)) GROUP BY {by}, c),
imp{tag} AS (SELECT {by}, {", ".join(out)} FROM pt{tag} GROUP BY {by})"""


_SUREST = f"""WITH {_SCORES}, {_TOP}, sure AS (SELECT protein_id, assay_id, gain, regret, decision, 'F' || substr(protein_id, 2)::INT % 15 AS family_id, substr(protein_id, 2)::INT % 3 AS panel, substr(protein_id, 2)::INT % 2 AS study FROM chosen)"""
_LINKS = "l AS (SELECT s_suppkey AS a, s_suppkey + s_suppkey % 9 + 1 AS b, s_suppkey * 13 % 100 / 100.0::DOUBLE AS tm, s_suppkey * 29 % 100 / 100.0::DOUBLE AS cov FROM supplier)"
_REACH = """both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT node, node AS reach FROM n UNION SELECT r.node, w.b FROM r JOIN both_ways w ON r.reach = w.a JOIN n ON n.node = w.b)
SELECT node, min(reach) AS component FROM r GROUP BY 1"""
_STAR = "SELECT node AS a, min(node) OVER (PARTITION BY {0}) AS b FROM n WHERE {0} IS NOT NULL"

ORACLES: dict[str, str] = {
    "b_hierarchical_mean": f"""{_T}, {_within('model_id', 't')}, m AS (SELECT d3.model_id, rep, avg(v) AS v FROM d3 JOIN t USING (model_id, family_id, protein_id, assay_id) GROUP BY ALL)
SELECT model_id, {_LIMITS.format('v')} FROM m GROUP BY 1""",
    "b_pair_differences": f"""{_PAIR}, {_pooled('family_id', 'protein_id', 'SELECT family_id, protein_id, sum(delta) AS s, count(delta) AS c FROM s GROUP BY ALL')},
x AS (SELECT family_id, rep, sum(s) / sum(c) AS v FROM d GROUP BY ALL) SELECT family_id, {_LIMITS.format('v')} FROM x GROUP BY 1""",
    "b_paired_group": f"""{_PAIR}, {_pooled('half', 'family_id', 'SELECT (substr(family_id, 2)::INT % 2)::INTEGER AS half, family_id, sum(one) AS s1, count(one) AS c1, sum(two) AS s2, count(two) AS c2 FROM s GROUP BY ALL')},
x AS (SELECT half, rep, sum(s1) / sum(c1) AS one, sum(s2) / sum(c2) AS two FROM d GROUP BY ALL),
y AS (SELECT half, 'one' AS side, one AS v FROM x UNION ALL SELECT half, 'two', two FROM x UNION ALL SELECT half, 'delta', one - two FROM x)
SELECT half, side, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM y GROUP BY ALL""",
    "b_position_rank": f"""WITH {_SCORES}, {_ranked("scores", _TASK_SQL)}, {_pooled(_TASK_SQL, 'position', f'SELECT {_TASK_SQL}, position, count(*) AS c, sum(ro) AS sx, sum(rp) AS sy, sum(ro * ro) AS xx, sum(rp * rp) AS yy, sum(ro * rp) AS xy FROM ranked GROUP BY ALL')},
q AS (SELECT {_TASK_SQL}, rep, sum(c) AS c, sum(sx) AS sx, sum(sy) AS sy, sum(xx) AS xx, sum(yy) AS yy, sum(xy) AS xy FROM d GROUP BY ALL),
x AS (SELECT {_TASK_SQL}, CASE WHEN (xx - sx * sx / c) * (yy - sy * sy / c) > 1e-9 THEN (xy - sx * sy / c) / sqrt((xx - sx * sx / c) * (yy - sy * sy / c)) ELSE 0 END AS v FROM q)
SELECT {_TASK_SQL}, {_LIMITS.format('v')} FROM x GROUP BY ALL""",
    "pl_abstain_stats": f"""{_SUREST}, {_improved('sure', 'panel')} SELECT panel, {', '.join(f'round({c}, 6) AS {c}' for c in nested.IMPROVEMENTS)} FROM imp""",
    "b_improvements": f"""{_SUREST}, {_within('panel', 'sure')}, w AS (SELECT d3.panel, d3.rep, s.assay_id, s.gain, s.regret, s.decision FROM d3 JOIN sure s USING (panel, family_id, protein_id, assay_id)), {_improved('w', 'panel, rep')},
y AS ({' UNION ALL '.join(f"SELECT panel, '{c}' AS name, {c} AS v FROM imp" for c in nested.IMPROVEMENTS)}) SELECT panel, name, {_LIMITS.format('v')} FROM y GROUP BY ALL""",
    "a_gates_development": f"""{_SUREST}, {_within('study', 'sure')}, w AS (SELECT d3.study, d3.rep, s.assay_id, s.gain, s.regret, s.decision FROM d3 JOIN sure s USING (study, family_id, protein_id, assay_id)),
{_improved('w', 'study, rep', '1')}, {_improved('sure', 'study', '2')}, {_improved('sure', 'study, panel', '3')},
lo AS (SELECT study, round(quantile_cont(regret_auc, 0.025), 9) > 0 AND round(quantile_cont(risk_auc, 0.025), 9) >= 0 AS ok FROM imp1 GROUP BY 1),
pa AS (SELECT study, bool_and(round(regret_auc, 9) >= 0 AND round(risk_auc, 9) >= 0 AND round(utility_half, 9) >= 0) AS panel_gate FROM imp3 GROUP BY 1),
fa AS (SELECT study, ok AND round(utility_half, 9) >= 0 AS family_gate, panel_gate FROM lo JOIN imp2 USING (study) JOIN pa USING (study)) SELECT *, family_gate AND panel_gate AS ready FROM fa""",
    "c_suite": f"""WITH {_SCORES}, f AS (SELECT DISTINCT assay_id, position FROM items WHERE position % 5 NOT IN (2, 4)),
gp AS (SELECT assay_id, coalesce(median(g), 1) AS gap FROM (SELECT assay_id, position - lag(position) OVER (PARTITION BY assay_id ORDER BY position) AS g FROM f) GROUP BY 1),
far AS (SELECT i.assay_id, i.position, min(abs(i.position - f.position)) AS far FROM (SELECT DISTINCT assay_id, position FROM items) i JOIN f USING (assay_id) GROUP BY ALL),
z AS (SELECT s.*, position % 3 AS grp, sqrt(1 + far / greatest(gap, 1)) AS scale FROM scores s JOIN far USING (assay_id, position) JOIN gp USING (assay_id)),
c AS (SELECT *, abs(observed - predicted) AS r, abs((observed - predicted) / scale) AS q, count(*) OVER w AS n, count(*) OVER g AS m, row_number() OVER (w ORDER BY abs(observed - predicted), code) AS i,
  row_number() OVER (w ORDER BY abs((observed - predicted) / scale), code) AS j, row_number() OVER (g ORDER BY abs(observed - predicted), code) AS h FROM z WHERE position % 5 = 4 WINDOW w AS (PARTITION BY {_TASK_SQL}), g AS (PARTITION BY {_TASK_SQL}, grp)),
k1 AS (SELECT {_TASK_SQL}, r FROM c WHERE i = least(n, ceil((n + 1) * 0.8::DOUBLE))), k2 AS (SELECT {_TASK_SQL}, grp, r FROM c WHERE m >= 5 AND h = least(m, ceil((m + 1) * 0.8::DOUBLE))), k3 AS (SELECT {_TASK_SQL}, q FROM c WHERE j = least(n, ceil((n + 1) * 0.8::DOUBLE))),
o AS (SELECT z.assay_id, z.model_id, code, 'standard' AS method, r AS v FROM z JOIN k1 USING ({_TASK_SQL}) WHERE position % 5 = 2
  UNION ALL SELECT z.assay_id, z.model_id, code, 'classes', coalesce(k2.r, k1.r) FROM z JOIN k1 USING ({_TASK_SQL}) LEFT JOIN k2 USING ({_TASK_SQL}, grp) WHERE position % 5 = 2
  UNION ALL SELECT z.assay_id, z.model_id, code, 'distance', q * scale FROM z JOIN k3 USING ({_TASK_SQL}) WHERE position % 5 = 2)
SELECT {_TASK_SQL}, code, method, round(v, 4) AS half_width FROM o""",
    "w_weighted_quantile": """WITH l AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity::BIGINT) AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) AS upto, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM l) SELECT l_suppkey, min(v) AS quantile FROM c WHERE upto >= total * 0.8::DOUBLE - 1e-9::DOUBLE GROUP BY 1""",
    "m_training_properties": f"""WITH {_SCORES}, tr AS (SELECT * FROM scores WHERE position % 5 <> 2), {_ranked("tr", _TASK_SQL)},
s AS (SELECT {_TASK_SQL}, position, count(*) AS c, avg(observed) AS mu, stddev_pop(observed) AS sd FROM tr GROUP BY ALL),
b AS (SELECT {_TASK_SQL}, count(*) AS n, stddev_pop(observed) AS sd, quantile_cont(observed, 0.75) - quantile_cont(observed, 0.25) AS iqr, CASE WHEN count(*) > 2 THEN skewness(observed) ELSE 0 END AS skew, {_FLAT} AS rho FROM ranked GROUP BY ALL)
SELECT {_TASK_SQL}, any_value(n) AS train_rows, count(*) AS train_positions, round(any_value(n) / (count(*) * 19), 6) AS density, round(avg(c), 6) AS per_position, round(stddev_pop(c) / avg(c), 6) AS per_position_cv,
  round(any_value(b.sd), 6) AS target_sd, round(any_value(iqr), 6) AS target_iqr, round(any_value(skew), 6) AS target_skew, round(stddev_pop(mu) / any_value(b.sd), 6) AS site_mean_spread,
  round(avg((s.sd / b.sd > 0.7)::INT::DOUBLE), 6) AS variable_sites, round(avg(s.sd) / any_value(b.sd), 6) AS site_sd_ratio, round(any_value(rho), 6) AS score_spearman FROM s JOIN b USING ({_TASK_SQL}) GROUP BY ALL""",
    "run_landscape": f"""WITH {_SCORES.replace("scores AS", "every AS")}, scores AS (SELECT * FROM every WHERE position % 7 <> 0), {_ranked("scores", _TASK_SQL)},
k AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY {_TASK_SQL}) * 0.1::DOUBLE)) AS kk, row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY predicted DESC, code) AS a, row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY observed DESC, code) AS b FROM ranked)
SELECT {_TASK_SQL}, count(*) AS n, round({_FLAT}, 9) AS spearman, round(CASE WHEN stddev_pop(observed) > 1e-12 THEN (avg(observed) FILTER (a <= kk) - avg(observed)) / stddev_pop(observed) ELSE 0 END, 9) AS gain_sd,
  round(count(*) FILTER (a <= kk AND b <= kk) / max(kk), 9) AS top_recall FROM k GROUP BY ALL""",
    "g_union_families": f"""WITH RECURSIVE n AS (SELECT s_suppkey AS node, s_suppkey // 4 AS family FROM supplier), {_LINKS}, e AS ({_STAR.format('family')} UNION SELECT a, b FROM l WHERE tm >= 0.6::DOUBLE AND cov >= 0.6::DOUBLE), {_REACH}""",
    "g_union_annotations": f"""WITH RECURSIVE n AS (SELECT s_suppkey AS node, s_suppkey // 4 AS family, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 40 END AS clan FROM supplier), e AS ({_STAR.format('family')} UNION {_STAR.format('clan')}), {_REACH}""",
    "ml_span": f"""WITH {_SCORES}, x AS (SELECT *, position % 5 = 2 AS test FROM scores), {_ranked("x", _TASK_SQL + ", test")}, t AS (SELECT {_TASK_SQL}, test, count(*) AS n, round({_FLAT}, 9) AS rho FROM ranked GROUP BY ALL),
b AS (SELECT {_TASK_SQL}, rho AS train_spearman FROM (SELECT *, row_number() OVER (PARTITION BY assay_id ORDER BY rho DESC, model_id) AS i FROM t WHERE NOT test) WHERE i = 1)
SELECT {_TASK_SQL}, train_spearman, n, rho AS spearman FROM b JOIN t USING ({_TASK_SQL}) WHERE test""",
    "s_heldout": f"""WITH {_SCORES}, r AS (SELECT *, count(*) OVER (PARTITION BY {_TASK_SQL}) AS n, row_number() OVER (PARTITION BY {_TASK_SQL} ORDER BY abs(predicted), code) AS i FROM scores),
a AS (SELECT protein_id, {_TASK_SQL}, c::DOUBLE AS coverage, avg(abs(observed - predicted)) AS mae FROM r, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) v(c) WHERE i <= ceil(n * c) GROUP BY ALL),
p AS (SELECT model_id, coverage, protein_id, avg(mae) AS mae FROM a GROUP BY ALL) SELECT model_id, coverage, count(*) AS units, round(avg(mae), 2) AS mean FROM p GROUP BY ALL""",
    "j_align_fold_scores": f"""WITH items AS ({_ITEMS}) SELECT assay_id, count(*) AS items, count(*) FILTER (position % 11 <> 0) AS matched, count(*) FILTER (position % 11 <> 0 AND position % 13 <> 0) AS finite_qty,
  count(*) FILTER (position % 11 <> 0 AND position % 6 <> 0) AS finite_disc FROM items GROUP BY 1""",
    "g_joint_families": f"""WITH RECURSIVE n AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey // 4 END AS family FROM supplier), {_LINKS}, k AS (SELECT a, b FROM l WHERE tm >= 0.6::DOUBLE AND a IN (SELECT node FROM n) AND b IN (SELECT node FROM n)),
e AS ({_STAR.format('family')} UNION SELECT a, b FROM k), {_REACH.replace('SELECT node, min(reach) AS component FROM r GROUP BY 1', '')}
SELECT node, CASE WHEN node IN (SELECT a FROM k UNION SELECT b FROM k) THEN min(reach)::VARCHAR ELSE 'undocumented' END AS family FROM r WHERE node % 3 = 0 GROUP BY node""",
    "g_sensitivity": f"""WITH RECURSIVE {_LINKS}, s AS (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE]) AS threshold), n AS (SELECT threshold, s_suppkey AS node FROM s, supplier), e AS (SELECT threshold, a, b FROM s, l WHERE cov >= 0.5::DOUBLE AND tm >= threshold),
both_ways AS (SELECT threshold, a, b FROM e UNION SELECT threshold, b, a FROM e), r AS (SELECT threshold, node, node AS reach FROM n UNION SELECT r.threshold, r.node, w.b FROM r JOIN both_ways w ON r.threshold = w.threshold AND r.reach = w.a JOIN n ON n.threshold = w.threshold AND n.node = w.b)
SELECT threshold, node, min(reach) AS component FROM r GROUP BY ALL""",
    "p_condition_columns": """WITH w AS (SELECT l_suppkey, count(*) FILTER (l_linenumber = 1) AS a, count(*) FILTER (l_linenumber = 2) AS b, count(*) FILTER (l_linenumber = 3) AS c FROM lineitem GROUP BY 1)
SELECT l_suppkey, 'dms_S1' AS condition, a AS value FROM w UNION ALL SELECT l_suppkey, 'dms_S2', b FROM w UNION ALL SELECT l_suppkey, 'dms_S3', c FROM w""",
    "p_outcome_firewall": f"WITH items AS ({_ITEMS}) SELECT assay_id, count(*) AS rows FROM items GROUP BY 1",
    "p_metadata_candidates": """WITH l AS (SELECT l_orderkey, count(*) AS reported FROM lineitem GROUP BY 1)
SELECT o_orderkey AS urn, strftime(o_orderdate, '%Y-%m-%d') AS published, reported, o_custkey % 100 AS length FROM orders JOIN l ON o_orderkey = l_orderkey
WHERE o_orderdate > DATE '1995-01-31' AND o_orderdate <= DATE '1997-06-30' AND reported >= 3 AND o_custkey % 100 BETWEEN 20 AND 80""",
    "p_complement_candidates": """WITH p AS (SELECT p_partkey AS urn, md5((p_partkey % 700)::VARCHAR) AS digest, concat_ws(';', CASE WHEN p_partkey % 11 = 0 THEN 'prior_panel' END, CASE WHEN p_partkey % 13 = 0 THEN 'doi_overlap' END, CASE WHEN contains(p_name, 'a') THEN 'meta_analysis' END) AS reasons FROM part),
f AS (SELECT *, min(urn) FILTER (reasons = '') OVER (PARTITION BY digest) AS first FROM p) SELECT urn, digest, reasons, reasons = '' AND urn = first AS included FROM f""",
    "p_task_registry": """SELECT CASE c_nationkey % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'external' ELSE 'untouched' END AS panel, c_nationkey % 3 = 1 AS lower_is_better, c_acctbal > 0 AS included, count(*) AS tasks, count(*) - count(DISTINCT c_custkey) AS repeated FROM customer GROUP BY ALL""",
    "a_model_eligibility": """SELECT s_suppkey AS model, CASE s_suppkey % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'missing' END AS status, s_suppkey % 3 = 0 AS eligible, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'qualification_failed' ELSE 'not_qualified' END AS reason FROM supplier""",
}
