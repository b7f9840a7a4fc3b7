"""Queries of cohorts, executed and qualified panels, overlap and acceptance gates, with SQL that says the same.

Their inputs hold faults: codes that are none, references that miss the sequence, scores that are not finite, keys that are
not expected, runs and models that are missing, digests that differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import names
from driftlens.functions.codes import RESIDUES
from driftlens.operators import cohorts, gates, nested, policies
from driftlens.operators.storage import stored
from driftlens.plans.bindings import items
from driftlens.plans.deeper import _SUREST, _improved, _order, _pooled, _surest, _within
from driftlens.plans.ledgers import _RHO, _pair_ranks
from driftlens.plans.models import _AREAS, _POLICIES, _STRIPS, pl_policies, s_panel_policy
from driftlens.plans.studies import _ITEMS, _round

REPEATS = 50
LEVELS = ["family_id", "protein_id", "assay_id"]
SEQUENCE = RESIDUES * 3
_NAMED = "".join({v: k for k, v in names.THREE.items()}[r] for r in RESIDUES)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# inputs, one text for both engines

#: Score tables in three-letter codes: wild types, stops, other references, places beyond the sequence, texts that are no code.
RAW = f"""SELECT concat('urn:', CAST(n AS VARCHAR(9))) AS urn, n, CASE WHEN k % 41 = 0 THEN 'p.?' ELSE concat('p.', substr('{_NAMED}', CAST(3 * ((position - CASE WHEN k % 37 = 0 THEN 0 ELSE 1 END) % 20) + 1 AS INT), 3), CAST(position AS VARCHAR(9)),
  CASE WHEN k % 11 = 0 AND n % 5 <> 2 THEN '=' WHEN k % 13 = 0 THEN 'Ter' ELSE substr('{_NAMED}', CAST(3 * ((position + l_linenumber) % 20) + 1 AS INT), 3) END) END AS code,
  CASE WHEN k % 43 = 0 THEN NULL WHEN k % 47 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(l_extendedprice AS DOUBLE) END AS score, CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS orientation
FROM (SELECT l_suppkey AS n, l_orderkey AS k, l_partkey % 63 + 1 AS position, l_linenumber, l_extendedprice FROM {{lineitem}}) x"""

#: Predictions of items by four models; a fifth is named but has none.
PREDICTED = """SELECT model_id, target_id, CASE WHEN model_id = 'extra' AND n % 50 = 3 AND position = 7 THEN 'X0X' ELSE code END AS variant_id, position, n, CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS panel_id,
  CASE WHEN model_id = 'disc' AND n % 6 = 0 AND position % 9 = 0 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN model_id = 'qty' AND n % 15 = 2 AND position % 3 = 0 THEN CAST('NaN' AS DOUBLE) WHEN model_id = 'disc' THEN CAST(disc AS DOUBLE) WHEN model_id = 'tax' THEN CAST(tax AS DOUBLE) ELSE CAST(qty AS DOUBLE) END AS score
FROM (SELECT assay_id AS target_id, CAST(substr(assay_id, 2) AS INT) AS n, position, code, qty, disc, tax FROM {items}) x, (VALUES ('qty'), ('disc'), ('tax'), ('extra')) AS v(model_id) WHERE NOT (model_id = 'tax' AND n % 10 = 1)"""

#: What each run of a model left behind; one checkpoint changed, one run was not timed, one runner differs.
RECEIPTS = """SELECT run, model_id, concat('c-', model_id, CASE WHEN model_id = 'extra' AND run = 'b' THEN '2' ELSE '' END) AS checkpoint, concat('i-', model_id) AS container, concat('s-', model_id) AS specification, 'tree' AS source,
  CASE WHEN model_id = 'tax' AND run = 'a' THEN 'other' ELSE 'runner' END AS runner, CASE WHEN model_id = 'disc' AND run = 'parity' THEN 0.0 ELSE 1.5 END AS elapsed
FROM (VALUES ('a'), ('b'), ('parity')) AS r(run), (VALUES ('qty'), ('disc'), ('tax'), ('extra')) AS v(model_id)"""

MODELS = [("qty", "f1", "d1", "d1"), ("disc", "f2", "d2", "d2"), ("tax", "f3", "d3", "old"), ("extra", "f3", "d4", "d4"), ("gone", "f4", None, "d5")]
_FLIGHT = [("qty", "f1", "permitted", True, "w", "c1", "i1"), ("disc", "f2", "permitted", True, "w", "c2", "i2"), ("tax", "f3", "permitted", False, "", None, "i3"), ("extra", "f3", "restricted", True, "w", None, "i4"), ("gone", "f4", "permitted", False, "", None, "i5")]


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """Written once: audits read it several times."""
    return stored(spark.sql(PREDICTED, items=items(spark, d)))


def _expected(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select(F.col("assay_id").alias("target_id"), F.col("code").alias("variant_id"))


def _again(rows: DataFrame) -> DataFrame:
    """A second run: one model gives other scores at odd places."""
    return rows.withColumn("score", F.when((F.col("model_id") == "disc") & (F.col("position") % 2 == 1), -F.col("score")).otherwise(F.col("score")))


def _reference(rows: DataFrame) -> DataFrame:
    """Published scores: on another scale, and of the opposite sign for one model."""
    return rows.select("model_id", "target_id", "variant_id", F.when(F.col("model_id") == "tax", -F.col("score")).otherwise(F.col("score") * 2 + 1).alias("score"))


def _models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model_id string, family string, executed string, current string")


# cohorts

def _raw(spark, d):
    return spark.sql(RAW, lineitem=_t(spark, d, "lineitem")).withColumn("sequence", F.lit(SEQUENCE))


def a_canonical_external(spark, d):
    """Missense substitutions of each score table with median scores, all in the direction in which more is better."""
    variants, _ = cohorts.canonical(_raw(spark, d), ["urn"], "code", "score", "sequence", "orientation")
    return _round(variants, "raw_score", "score", digits=4)


def a_external_cohort(spark, d):
    """Every score table with its counts, its protein, and why it may not enter the cohort."""
    variants, audit = cohorts.canonical(_raw(spark, d), ["urn"], "code", "score", "sequence", "orientation", controls=12)
    kept, judged = cohorts.cohort(variants, audit, ["urn"], least=230, positions=55)
    entered = kept.groupBy("urn").agg(F.count(F.lit(1)).alias("entered"))
    n = F.col("s_suppkey")
    protein = names.protein_id(F.when(n % 4 == 0, F.concat(F.lit("G"), (n % 25).cast("string"))), F.when(n % 4 < 2, F.concat(F.lit(" T"), (n % 30).cast("string"), F.lit("  domain"))), F.when(n % 4 == 2, F.concat(F.lit("Q"), n.cast("string"))), F.col("urn"))
    told = _t(spark, d, "supplier").select(F.concat(F.lit("urn:"), n.cast("string")).alias("urn"), n).withColumn("protein_id", protein).select("urn", "protein_id")
    return judged.join(told, "urn", "left").join(entered, "urn", "left").withColumn("entered", F.coalesce("entered", F.lit(0)))


def _data_sets(spark, d):
    """(path, doi, source_id, status, sequence) of data sets named by a chain, a structure, an accession or nothing known."""
    k = F.col("p_partkey")
    letter = F.substr(F.lit(RESIDUES), (F.floor(k / 10) % 20 + 1).cast("int"), F.lit(1))
    token = F.concat((k % 10).cast("string"), letter, F.lit("BC"))
    name = F.when(k % 4 == 0, F.concat(token, F.lit("_D_n"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("set_"), token, F.lit("_n"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("P"), (k % 10).cast("string"), letter, F.lit("BC"), (k % 10).cast("string"), F.lit("_n"), k.cast("string"))).otherwise(F.concat(F.lit("n"), k.cast("string")))
    kind = F.element_at(F.array(*map(F.lit, ("activity", "binding", "stability"))), (k % 3 + 1).cast("int"))
    sequence = F.substr(F.lit(SEQUENCE), (k % 10 + 1).cast("int"), (F.floor(k / 10) % 20 + 20).cast("int"))
    status = F.when(F.floor(k / 10) % 20 == 3, "not_found").otherwise("resolved")
    doi = F.when(k % 13 != 0, F.concat(F.lit("https://doi.org/10.1/X"), (k % 300).cast("string"), F.lit(".")))
    return _t(spark, d, "part").select(F.concat(F.lit("data/"), kind, F.lit("/"), name, F.lit(".v1.csv")).alias("path"), F.concat(name, F.lit(".v1")).alias("dataset_id"), doi.alias("doi"), status.alias("status"), F.when(F.floor(k / 10) % 20 != 5, sequence).alias("sequence"))


def p_target_overlap_rules(spark, d):
    """Data sets with the reasons against them, and the target that those of one sequence share."""
    rows = _data_sets(spark, d)
    sequences = rows.withColumn("source_id", names.source_id(F.col("dataset_id"))).filter("source_id IS NOT NULL").select("source_id", "status", "sequence").distinct()
    s = F.col("s_suppkey")
    known = _t(spark, d, "supplier").select(F.substr(F.lit(SEQUENCE), (s % 10 + 1).cast("int"), (s % 20 + 20).cast("int")).alias("sequence"), F.concat(F.lit("doi:10.1/x"), (s % 60).cast("string")).alias("doi"))
    judged, targets = cohorts.target_rules(rows.select("path"), sequences, rows.select("dataset_id", "doi"), known, known)
    return judged.drop("source_path").join(targets.select("target_id", F.col("source_id").alias("protein_id"), "sequence_length", "source_assays", "dois"), "target_id", "left")


# panels

def _with_gates(rows: DataFrame, found: DataFrame) -> DataFrame:
    one = found.agg(F.max(F.when(F.col("gate") == "shared_targets", F.col("value"))).alias("shared_targets"), F.bool_and("passed").alias("gates_passed"))
    return rows.crossJoin(F.broadcast(one))


def a_execution_panel(spark, d):
    coverage = stored(gates.target_coverage(_predicted(spark, d), _expected(spark, d), _models(spark)))
    audit = stored(gates.execution(coverage, _models(spark), targets=60))
    chosen = audit.filter("status = 'complete'")
    return _with_gates(audit, gates.panel_gates(chosen, gates.shared_targets(coverage, chosen, 0.95), 3, 3, 50))


def a_preflight(spark, d):
    first = _predicted(spark, d)
    models = spark.createDataFrame(_FLIGHT, "model_id string, family string, licence string, parity_required boolean, checkpoint string, checkpoint_sha256 string, container_sha256 string")
    # gates read the audit several times, a row a model: what made it runs once
    audit = stored(gates.preflight(first, _again(first), _reference(first), _expected(spark, d), models, least=0.85))
    chosen = audit.filter("eligible")
    shared = gates.shared_targets(gates.target_coverage(first, _expected(spark, d), models), chosen, 0.95)
    made = _with_gates(audit, gates.panel_gates(chosen, shared, 2, 2, 50))
    return _round(made, "coverage", "repeat_rho", "parity_rho")


def a_qualification(spark, d):
    first = _predicted(spark, d)
    runs = [r.select(F.lit(name).alias("run"), "model_id", "target_id", "variant_id", "status", "score") for name, r in (("a", first), ("b", _again(first)), ("parity", first))]
    models = _models(spark).select("model_id", "family", *(F.concat(F.lit(f"{c[0] if c != 'container' else 'i'}-"), "model_id").alias(c) for c in ("checkpoint", "container", "specification")))
    audit, coverage = gates.qualification(runs[0].unionByName(runs[1]).unionByName(runs[2]), spark.sql(RECEIPTS), _reference(first), _expected(spark, d), models, least=0.85, variants=30, targets=20)
    audit = stored(audit)
    chosen = audit.filter("qualified")
    made = _with_gates(audit, gates.panel_gates(chosen, gates.shared_targets(coverage, chosen, 0.95), 1, 1, 50))
    return _round(made, "coverage_a", "coverage_b", "repeat_rho", "parity_rho")


def a_final_panel(spark, d):
    k = F.col("s_suppkey")
    named = F.concat(F.lit("m"), (k % 90).cast("string")).alias("model_id")
    digests = lambda j: (F.concat(F.lit("c"), (j % 5).cast("string")).alias("checkpoint"), F.concat(F.lit("i"), (j % 3).cast("string")).alias("container"))
    rows = _t(spark, d, "supplier")
    audit = rows.select(named, (k % 7 != 0).alias("qualified"), *digests(k))
    described = rows.filter("s_suppkey % 11 <> 0").select(named, F.concat(F.lit("f"), (k % 6).cast("string")).alias("family"), *digests(k + F.when(k % 13 == 0, 1).otherwise(0)))
    specifications = described.unionByName(described.filter("substr(family, 2) = '4'"))
    made = gates.final_panel([audit.filter("qualified"), audit.filter("NOT qualified")], specifications)
    c = F.col("c_custkey")
    receipts = _t(spark, d, "customer").withColumn("receipt", F.explode(F.array(*map(F.lit, (2, 3, 4))))).filter(c * F.col("receipt") % (F.col("receipt") + 5) != 0).select("receipt", c.alias("target_id"))
    return _with_gates(made, gates.panel_gates(made.filter("status = 'selected'"), gates.in_every(receipts), 8, 4, 300))


def a_select_predictions(spark, d):
    """Coverage of targets by panel over the models that were executed on it."""
    executions = spark.createDataFrame([(p, m) for p, ms in (("even", ("qty", "disc", "tax")), ("odd", ("qty", "disc", "extra"))) for m in ms], "panel_id string, model_id string")
    expected = _expected(spark, d).withColumn("panel_id", F.when(F.substr("target_id", F.lit(2)).cast("int") % 2 == 0, "even").otherwise("odd"))
    coverage = gates.target_coverage(_predicted(spark, d), expected, executions, ["panel_id"])
    return _round(gates.selected_predictions(coverage, executions), "min_coverage")


def a_overlap(spark, d):
    orders, k = _t(spark, d, "orders"), F.col("o_orderkey")
    digest = lambda c: F.sha2((c % 700).cast("string"), 256).alias("sequence_sha256")
    targets = _t(spark, d, "customer").select(F.col("c_custkey").alias("target_id"), digest(F.col("c_custkey")))
    s = F.col("s_suppkey")
    known = _t(spark, d, "supplier").select(digest(s * 7), F.concat(F.lit("s"), (s % 20).cast("string")).alias("structure"), F.concat(F.lit("c"), (s % 10).cast("string")).alias("clan"))
    own = lambda n, m, p: orders.select(F.col("o_custkey").alias("target_id"), F.when(k % m == 0, F.concat(F.lit(p), (k % n).cast("string"))).alias("annotation"))
    links = orders.select(F.col("o_custkey").alias("target_id"), F.when(k % 5 != 0, F.col("o_totalprice") > 430000).alias("qualifies"))
    return gates.overlap(targets, known, links, (own(50, 7, "s"), known.select(F.col("structure").alias("annotation"))), (own(31, 5, "c"), known.select(F.col("clan").alias("annotation"))))


# gates

COMPARED = ["always_best", "ablation:msa_only", "elastic_net"]


def a_gates_transport(spark, d):
    """Six gates of the chosen policy against always taking the best model; improvements are of mean regret, drawn by family."""
    rows = pl_policies(spark, d).withColumn("family_id", F.concat(F.lit("F"), (F.substr("assay_id", F.lit(2)).cast("int") % 40 % 15).cast("string")))
    halves = policies.curve(rows, ["policy"], ["assay_id"], "confidence").filter(F.round("coverage", 9) == 0.5).select("policy", F.round("mean_regret", 9).alias("regret"), F.round("mean_gain", 9).alias("gain"), F.round("failure", 9).alias("failure"))
    ours = rows.filter("policy = 'chosen'")
    sides = rows.filter(F.col("policy").isin(*COMPARED)).select(F.col("policy").alias("comparator"), "assay_id", F.col("regret").alias("other"))
    gaps = sides.join(ours.select("assay_id", "family_id", "regret"), "assay_id").withColumn("delta", F.col("other") - F.col("regret"))
    limit = nested.limits(nested.pooled(gaps, ["comparator"], "family_id", ["delta"], REPEATS), ["comparator"], "delta")
    differences = gaps.groupBy("comparator").agg(F.round(F.avg("delta"), 9).alias("point")).join(limit.select("comparator", F.round("lower", 9).alias("lower"), "p"), "comparator")
    panels = s_panel_policy(spark, d).select("panel", F.col("regret_area").alias("improvement"))
    bounds = ours.select(F.col("gain").alias("observed"), F.col("confidence").alias("lower"))
    told = {"statement": "no gain over the best model", "change": "none", "evidence": ["policies"]}
    return _round(gates.transport_gates(halves, differences, panels, bounds, "always_best", [0, 1, 2], ablations=("ablation:msa_only", "elastic_net"), conclusion=told), "value", digits=6)


def a_gates_conservative(spark, d):
    """Gates over all tasks (panel -1) and each panel."""
    tasks = _surest(spark, d).withColumn("panel", F.explode(F.array(F.col("panel").cast("int"), F.lit(-1))))
    points = stored(_round(nested.improvements(tasks, ["panel"], _order()), *nested.IMPROVEMENTS))
    # gates read the limits, a row a panel and improvement, several times: draws are made once
    limit = stored(nested.bootstrap_improvements(tasks, ["panel"], LEVELS, _order(), REPEATS)).withColumn("lower", F.round("lower", 9))
    point = points.filter("panel = -1").unpivot([], nested.IMPROVEMENTS, "name", "value")
    made = gates.conservative_gates(point, limit.filter("panel = -1").select("name", "lower", "p"), points.filter("panel >= 0"), limit.filter("panel >= 0 AND name = 'regret_auc'").select("panel", "p"))
    return _round(made, "value", "lower", "adjusted", digits=6)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (a_canonical_external, a_external_cohort, p_target_overlap_rules, a_execution_panel, a_preflight, a_qualification, a_final_panel, a_select_predictions, a_overlap, a_gates_transport, a_gates_conservative)
}


# SQL

_PARSED = f"""WITH raw AS ({RAW.format(lineitem='lineitem')}), p AS (SELECT *, regexp_extract(code, '^p\\.([A-Z][a-z][a-z])([1-9][0-9]*)([A-Z][a-z][a-z]|=)$', 1) AS r, try_cast(regexp_extract(code, '^p\\.[A-Z][a-z][a-z]([1-9][0-9]*)', 1) AS INTEGER) AS pos, regexp_extract(code, '([A-Z][a-z][a-z]|=)$', 1) AS t FROM raw),
l AS (SELECT *, substr('{RESIDUES}', ((strpos('{_NAMED}', r) + 2) // 3)::INT, 1) AS a, CASE WHEN t = 'Ter' THEN '*' WHEN t = '=' THEN substr('{RESIDUES}', ((strpos('{_NAMED}', r) + 2) // 3)::INT, 1) ELSE substr('{RESIDUES}', ((strpos('{_NAMED}', t) + 2) // 3)::INT, 1) END AS b FROM p),
e AS (SELECT *, a || pos || b AS variant, CASE WHEN score IS NULL OR isnan(score) THEN 'no_score' WHEN r = '' THEN 'invalid' WHEN substr('{SEQUENCE}', pos, 1) <> a THEN 'mismatch' WHEN a = b THEN 'synonymous' WHEN b = '*' THEN 'termination' ELSE 'missense' END AS effect FROM l),
g AS (SELECT urn, max(n) AS n, count(*) AS input_rows, count(*) FILTER (effect IN ('synonymous', 'termination', 'missense')) AS parsed_rows, count(*) FILTER (effect = 'invalid') AS invalid_codes, count(*) FILTER (effect = 'mismatch') AS reference_mismatches, count(*) FILTER (effect = 'synonymous') AS synonymous_controls,
  count(*) FILTER (effect = 'termination') AS termination_controls, CASE WHEN max(orientation) IN (1, -1) THEN max(orientation) WHEN count(*) FILTER (effect = 'synonymous') >= {{0}} AND count(*) FILTER (effect = 'termination') >= {{0}} THEN nullif(sign(median(score) FILTER (effect = 'synonymous') - median(score) FILTER (effect = 'termination')), 0) END::INTEGER AS direction FROM e GROUP BY 1),
s AS (SELECT urn, variant, pos AS position, median(score) AS raw_score, count(*) AS source_rows FROM e WHERE effect = 'missense' GROUP BY ALL)"""

_GIVEN = f"items AS ({_ITEMS}), pred AS ({PREDICTED.format(items='items')}), want AS (SELECT DISTINCT assay_id AS target_id, code AS variant_id FROM items)"
_MODEL_ROWS = f"models(model_id, family, executed, current) AS (VALUES {', '.join('(' + ', '.join('NULL' if v is None else repr(v) for v in m) + ')' for m in MODELS)})"
_FLIGHT_ROWS = f"models(model_id, family, licence, parity_required, checkpoint, checkpoint_sha256, container_sha256) AS (VALUES {', '.join('(' + ', '.join('NULL' if v is None else str(v) if isinstance(v, bool) else repr(v) for v in m) + ')' for m in _FLIGHT)})"


def _covered(name: str, source: str, extra: str = "") -> str:
    """CTEs of each model's coverage of each expected target, from the keys that are in both."""
    return f"""{name}w AS (SELECT *{extra} FROM want), {name}ok AS (SELECT DISTINCT model_id, target_id, variant_id FROM {source} WHERE status = 'ok' AND score IS NOT NULL AND NOT isnan(score)),
{name} AS (SELECT m.model_id, w.target_id, count(*) AS expected, count(k.variant_id) AS scored, count(k.variant_id) / count(*)::DOUBLE AS coverage FROM models m CROSS JOIN want w LEFT JOIN {name}ok k ON k.model_id = m.model_id AND k.target_id = w.target_id AND k.variant_id = w.variant_id GROUP BY ALL)"""


def _shared(source: str, chosen: str, least: str = "0.95") -> str:
    return f"shared AS (SELECT target_id FROM {source} JOIN {chosen} USING (model_id) WHERE {source}.coverage >= {least}::DOUBLE GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM {chosen}))"


def _gated(chosen: str, models: int, families: int, targets: int) -> str:
    return f"""gg AS (SELECT (SELECT count(*) FROM shared) AS shared_targets, (SELECT count(*) FROM {chosen}) >= {models} AND (SELECT count(DISTINCT family) FROM {chosen}) >= {families} AND (SELECT count(*) FROM shared) >= {targets} AS gates_passed)"""


_AGAIN = "sec AS (SELECT * REPLACE (CASE WHEN model_id = 'disc' AND position % 2 = 1 THEN -score ELSE score END AS score) FROM pred)"
_PUBLISHED = "ref AS (SELECT model_id, target_id, variant_id, CASE WHEN model_id = 'tax' THEN -score ELSE score * 2 + 1 END AS score FROM pred)"


def _agreed(name: str, other: str, by: str) -> str:
    """CTE name(by, n, exact, rho) over variants that pred and other have scores of."""
    ranked = _pair_ranks(f"{name}p", by, "one", "two").replace("rk AS", f"{name}r AS", 1)
    once = lambda t: f"(SELECT model_id, target_id, variant_id, min(score) AS score FROM {t} WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)"
    return f"""{name}p AS (SELECT model_id, target_id, p.score AS one, o.score AS two FROM {once('pred')} p JOIN {once(other)} o USING (model_id, target_id, variant_id)),
{ranked}, {name}e AS (SELECT {by}, count(*) FILTER (one = two) AS exact FROM {name}p GROUP BY ALL), {name} AS (SELECT {by}, count(*) AS n, {_RHO.format(2)} AS rho FROM {name}r GROUP BY ALL)"""


_MISSED = "array_to_string(list_filter([{0}], lambda x: x IS NOT NULL), ';')"


def _unless(**conditions: str) -> str:
    return _MISSED.format(", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in conditions.items()))


_COUNTED = "a AS (SELECT model_id, count(*) AS \"rows\", count(DISTINCT pred.target_id || '|' || pred.variant_id) FILTER (want.target_id IS NULL) AS unexpected FROM pred LEFT JOIN want ON want.target_id = pred.target_id AND want.variant_id = pred.variant_id GROUP BY 1)"
_PT = "p_partkey"
_L = f"substr('{RESIDUES}', ({_PT} // 10 % 20 + 1)::INT, 1)"
_WITH_GAPS = "dif AS (SELECT comparator, round(avg(v), 9) AS point FROM (SELECT o.policy AS comparator, o.regret - c.regret AS v FROM po o JOIN po c ON c.assay_id = o.assay_id AND c.policy = 'chosen' WHERE o.policy IN ({0})) GROUP BY 1)"
_QUOTED = ", ".join(f"'{c}'" for c in COMPARED)

ORACLES: dict[str, str] = {
    "a_canonical_external": f"{_PARSED.format(10)} SELECT urn, variant, position, round(raw_score, 4) AS raw_score, source_rows, round(raw_score * direction, 4) AS score FROM s JOIN g USING (urn)",
    "a_external_cohort": f"""{_PARSED.format(12)}, h AS (SELECT urn, count(*) AS variants, count(DISTINCT position) AS positions, count(DISTINCT raw_score) AS unique_scores, coalesce(sum(source_rows) FILTER (source_rows > 1), 0)::BIGINT AS repeated_rows FROM s GROUP BY 1),
j AS (SELECT g.* EXCLUDE (n), n, coalesce(variants, 0) AS variants, coalesce(positions, 0) AS positions, coalesce(unique_scores, 0) AS unique_scores, coalesce(repeated_rows, 0) AS repeated_rows FROM g LEFT JOIN h USING (urn)),
q AS (SELECT *, {_unless(too_few_variants='variants >= 230', too_few_positions='positions >= 55', too_few_scores='unique_scores >= 10', no_direction='direction IS NOT NULL')} AS reasons FROM j)
SELECT q.* EXCLUDE (n), reasons = '' AS eligible, CASE WHEN s_suppkey % 4 = 0 THEN 'G' || s_suppkey % 25 WHEN s_suppkey % 4 = 1 THEN 'T' || s_suppkey % 30 WHEN s_suppkey % 4 = 2 THEN 'Q' || s_suppkey WHEN s_suppkey IS NOT NULL THEN urn END AS protein_id, CASE WHEN reasons = '' THEN variants ELSE 0 END AS entered FROM q LEFT JOIN supplier ON s_suppkey = n""",
    "p_target_overlap_rules": f"""WITH r AS (SELECT {_PT} AS k, CASE {_PT} % 4 WHEN 0 THEN {_PT} % 10 || {_L} || 'BC_D_n' || {_PT} WHEN 1 THEN 'set_' || {_PT} % 10 || {_L} || 'BC_n' || {_PT} WHEN 2 THEN 'P' || {_PT} % 10 || {_L} || 'BC' || {_PT} % 10 || '_n' || {_PT} ELSE 'n' || {_PT} END || '.v1' AS dataset_id,
  CASE {_PT} % 4 WHEN 0 THEN 'chain:' || {_PT} % 10 || {_L} || 'BC:D' WHEN 1 THEN 'structure:' || {_PT} % 10 || {_L} || 'BC' WHEN 2 THEN 'accession:P' || {_PT} % 10 || {_L} || 'BC' || {_PT} % 10 END AS source_id, ['activity', 'binding', 'stability'][{_PT} % 3 + 1] AS category,
  CASE WHEN {_PT} % 13 <> 0 THEN '10.1/x' || {_PT} % 300 END AS doi, {_PT} // 10 % 20 AS l, CASE WHEN {_PT} % 4 <> 3 AND {_PT} // 10 % 20 <> 5 THEN substr('{SEQUENCE}', ({_PT} % 10 + 1)::INT, ({_PT} // 10 % 20 + 20)::INT) END AS sequence FROM part),
kd AS (SELECT DISTINCT '10.1/x' || s_suppkey % 60 AS doi, true AS readit FROM supplier), ks AS (SELECT DISTINCT substr('{SEQUENCE}', (s_suppkey % 10 + 1)::INT, (s_suppkey % 20 + 20)::INT) AS sequence, true AS seen FROM supplier),
x AS (SELECT r.*, {_MISSED.format("CASE WHEN source_id IS NULL THEN 'unparsed_target' WHEN l = 3 THEN 'not_found' WHEN r.sequence IS NULL THEN 'unresolved_sequence' END, CASE WHEN r.doi IS NULL THEN 'missing_publication' WHEN readit THEN 'known_publication' END, CASE WHEN seen THEN 'known_sequence' END")} AS exclusion_reasons
  FROM r LEFT JOIN kd ON kd.doi = r.doi LEFT JOIN ks ON ks.sequence = r.sequence),
y AS (SELECT *, exclusion_reasons = '' AS selected, CASE WHEN exclusion_reasons = '' THEN 'panel-' || substr(sha256(sequence), 1, 16) END AS target_id FROM x),
t AS (SELECT target_id, arg_min(source_id, dataset_id) AS protein_id, length(min(sequence))::INTEGER AS sequence_length, array_to_string(list_sort(list(DISTINCT dataset_id)), ';') AS source_assays, array_to_string(list_sort(list(DISTINCT doi)), ';') AS dois FROM y WHERE selected GROUP BY 1)
SELECT y.target_id, category, dataset_id, source_id, doi, exclusion_reasons, selected, protein_id, sequence_length, source_assays, dois FROM y LEFT JOIN t ON t.target_id = y.target_id""",
    "a_execution_panel": f"""WITH {_GIVEN}, {_MODEL_ROWS}, {_covered('cv', 'pred')}, {_COUNTED},
m AS (SELECT models.*, coalesce("rows", 0) AS "rows", coalesce(unexpected, 0) AS unexpected, (SELECT count(*) FROM cv WHERE cv.model_id = models.model_id AND coverage >= 0.95::DOUBLE) AS covered FROM models LEFT JOIN a USING (model_id)),
st AS (SELECT *, CASE WHEN unexpected > 0 THEN 'refused' WHEN covered >= 60 THEN 'complete' ELSE 'incomplete' END AS status FROM m), ch AS (SELECT * FROM st WHERE status = 'complete'), {_shared('cv', 'ch')}, {_gated('ch', 3, 3, 50)}
SELECT model_id, family, "rows", unexpected, covered, status, coalesce(executed = current, false) AS digest_matches, shared_targets, gates_passed FROM st, gg""",
    "a_preflight": f"""WITH {_GIVEN}, {_FLIGHT_ROWS}, {_covered('cv', 'pred')}, {_AGAIN}, {_PUBLISHED}, {_agreed('again', 'sec', 'model_id')}, {_agreed('par', 'ref', 'model_id')},
per AS (SELECT model_id, sum(scored) / sum(expected)::DOUBLE AS coverage, count(*) FILTER (coverage >= 0.85::DOUBLE) AS covered FROM cv GROUP BY 1),
j AS (SELECT models.*, coverage, covered, again.rho AS repeat_rho, par.rho AS parity_rho FROM models LEFT JOIN per USING (model_id) LEFT JOIN again USING (model_id) LEFT JOIN par USING (model_id)),
st AS (SELECT *, {_unless(licence="licence = 'permitted'", coverage="coverage >= 0.85::DOUBLE", repeat="round(repeat_rho, 12) >= 0.999::DOUBLE", parity="NOT parity_required OR coalesce(round(parity_rho, 12) >= 0.99::DOUBLE, false)", provenance="coalesce(container_sha256, '') <> '' AND (coalesce(checkpoint, '') = '' OR coalesce(checkpoint_sha256, '') <> '')")} AS failed FROM j),
ch AS (SELECT * FROM st WHERE failed = ''), {_shared('cv', 'ch')}, {_gated('ch', 2, 2, 50)}
SELECT model_id, family, round(coverage, 9) AS coverage, covered, round(repeat_rho, 9) AS repeat_rho, round(parity_rho, 9) AS parity_rho, failed, failed = '' AS eligible, shared_targets, gates_passed FROM st, gg""",
    "a_qualification": f"""WITH {_GIVEN}, {_MODEL_ROWS}, {_AGAIN}, {_covered('ca', 'pred')}, {_covered('cb', 'sec')}, {_PUBLISHED}, {_agreed('again', 'sec', 'model_id')}, {_agreed('par', 'ref', 'model_id, target_id')}, rc AS ({RECEIPTS}),
cv AS (SELECT model_id, target_id, ca.expected, least(ca.coverage, cb.coverage) AS coverage, ca.scored AS sa, cb.scored AS sb FROM ca JOIN cb USING (model_id, target_id)), per AS (SELECT model_id, sum(sa) / sum(expected)::DOUBLE AS coverage_a, sum(sb) / sum(expected)::DOUBLE AS coverage_b FROM cv GROUP BY 1),
pt AS (SELECT model_id, count(*) AS parity_targets, bool_and(n >= 30 AND coalesce(round(rho, 12) >= 0.99::DOUBLE, false)) AS fine, min(rho) AS parity_rho FROM par GROUP BY 1),
gv AS (SELECT model_id, count(*) = 3 AS receipts, count(DISTINCT checkpoint) = 1 AND max(checkpoint) = 'c-' || model_id AS checkpoint, max(container) = 'i-' || model_id AS container, max(specification) = 's-' || model_id AS specification, count(DISTINCT source) = 1 AND count(DISTINCT runner) = 1 AS code, min(elapsed) > 0 AS timed FROM rc GROUP BY 1),
j AS (SELECT models.model_id, family, coverage_a, coverage_b, coalesce(again.n, 0) AS repeat_rows, coalesce(exact, 0) AS exact_rows, again.rho AS repeat_rho, coalesce(parity_targets, 0) AS parity_targets, fine, parity_rho, gv.* EXCLUDE (model_id)
  FROM models LEFT JOIN per USING (model_id) LEFT JOIN again USING (model_id) LEFT JOIN againe USING (model_id) LEFT JOIN pt USING (model_id) LEFT JOIN gv USING (model_id)),
st AS (SELECT *, {_unless(receipts='receipts', coverage='least(coverage_a, coverage_b) >= 0.85::DOUBLE', repeat='round(repeat_rho, 12) >= 0.999::DOUBLE', parity='fine AND parity_targets >= 20', checkpoint='checkpoint', container='container', specification='specification', code='code', time='timed')} AS failed FROM j),
ch AS (SELECT * FROM st WHERE failed = ''), {_shared('cv', 'ch')}, {_gated('ch', 1, 1, 50)}
SELECT model_id, family, round(coverage_a, 9) AS coverage_a, round(coverage_b, 9) AS coverage_b, repeat_rows, exact_rows, round(repeat_rho, 9) AS repeat_rho, parity_targets, round(parity_rho, 9) AS parity_rho, failed, failed = '' AS qualified, shared_targets, gates_passed FROM st, gg""",
    "a_final_panel": f"""WITH au AS (SELECT 'm' || s_suppkey % 90 AS model_id, s_suppkey % 7 <> 0 AS qualified, 'c' || s_suppkey % 5 AS checkpoint, 'i' || s_suppkey % 3 AS container FROM supplier),
sp0 AS (SELECT 'm' || s_suppkey % 90 AS model_id, 'f' || s_suppkey % 6 AS family, 'c' || (s_suppkey + (s_suppkey % 13 = 0)::INT) % 5 AS checkpoint, 'i' || (s_suppkey + (s_suppkey % 13 = 0)::INT) % 3 AS container FROM supplier WHERE s_suppkey % 11 <> 0), sp AS (SELECT * FROM sp0 UNION ALL SELECT * FROM sp0 WHERE family = 'f4'),
m AS (SELECT model_id, count(*) AS audits, bool_and(qualified) AS q, max(checkpoint) AS c, max(container) AS i FROM au GROUP BY 1),
st AS (SELECT model_id, audits, q, (SELECT count(*) FROM sp WHERE sp.model_id = m.model_id) AS named, (SELECT count(*) FROM sp WHERE sp.model_id = m.model_id AND checkpoint = c AND container = i) AS candidates, (SELECT max(family) FROM sp WHERE sp.model_id = m.model_id AND checkpoint = c AND container = i) AS fam FROM m),
z AS (SELECT *, CASE WHEN NOT q THEN 'unqualified' WHEN audits > 1 THEN 'repeated' WHEN named = 0 THEN 'missing' WHEN candidates <> 1 THEN 'ambiguous' ELSE 'selected' END AS status FROM st), ch AS (SELECT *, fam AS family FROM z WHERE status = 'selected'),
shared AS (SELECT c_custkey FROM customer WHERE c_custkey * 2 % 7 <> 0 AND c_custkey * 3 % 8 <> 0 AND c_custkey * 4 % 9 <> 0), {_gated('ch', 8, 4, 300)}
SELECT model_id, CASE WHEN status = 'selected' THEN fam END AS family, audits, candidates, status, shared_targets, gates_passed FROM z, gg""",
    "a_select_predictions": f"""WITH {_GIVEN}, models(panel_id, model_id) AS (VALUES ('even', 'qty'), ('even', 'disc'), ('even', 'tax'), ('odd', 'qty'), ('odd', 'disc'), ('odd', 'extra')),
ok AS (SELECT DISTINCT model_id, target_id, variant_id FROM pred WHERE status = 'ok' AND NOT isnan(score)), w AS (SELECT *, CASE WHEN substr(target_id, 2)::INT % 2 = 0 THEN 'even' ELSE 'odd' END AS panel_id FROM want),
cv AS (SELECT panel_id, w.target_id, m.model_id, count(k.variant_id) / count(*)::DOUBLE AS coverage FROM w JOIN models m USING (panel_id) LEFT JOIN ok k ON k.model_id = m.model_id AND k.target_id = w.target_id AND k.variant_id = w.variant_id GROUP BY ALL)
SELECT panel_id, target_id, count(*) AS models, count(*) FILTER (coverage >= 0.95::DOUBLE) AS models_usable, bool_and(coverage >= 0.95::DOUBLE) AS shared, round(min(coverage), 9) AS min_coverage FROM cv GROUP BY ALL""",
    "a_overlap": """WITH k AS (SELECT DISTINCT s_suppkey * 7 % 700 AS q FROM supplier), o AS (SELECT o_custkey, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 's' || o_orderkey % 50 END AS s, CASE WHEN o_orderkey % 5 = 0 THEN 'c' || o_orderkey % 31 END AS c, o_orderkey % 5 <> 0 AND o_totalprice > 430000 AS linked FROM orders),
ks AS (SELECT DISTINCT 's' || s_suppkey % 20 AS s FROM supplier), kc AS (SELECT DISTINCT 'c' || s_suppkey % 10 AS c FROM supplier),
g AS (SELECT o_custkey, bool_or(linked) AS linked, count(o.s) AS ns, count(o.c) AS nc, count(ks.s) AS hs, count(kc.c) AS hc FROM o LEFT JOIN ks ON ks.s = o.s LEFT JOIN kc ON kc.c = o.c GROUP BY 1)
SELECT c_custkey AS target_id, c_custkey % 700 NOT IN (SELECT q FROM k) AS sequence_unseen, NOT coalesce(linked, false) AS family_unseen, CASE WHEN ns > 0 THEN 'audited' ELSE 'undocumented' END AS structure_status, CASE WHEN ns > 0 THEN hs > 0 END AS structure_overlap,
  CASE WHEN nc > 0 THEN 'audited' ELSE 'undocumented' END AS clan_status, CASE WHEN nc > 0 THEN hc > 0 END AS clan_overlap FROM customer LEFT JOIN g ON o_custkey = c_custkey""",
    "a_gates_transport": f"""{_POLICIES}, po AS (SELECT policy, assay_id, gain, round(regret, 6) AS regret, round(confidence, 6) AS confidence, 'F' || substr(assay_id, 2)::INT % 40 % 15 AS family_id, substr(assay_id, 2)::INT % 3 AS panel, 1 AS times FROM pol),
ha AS (SELECT policy, round(avg(regret), 9) AS regret, round(avg(gain), 9) AS gain, round(avg((gain <= 0)::INT::DOUBLE), 9) AS failure FROM (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY confidence DESC, assay_id) AS i, count(*) OVER (PARTITION BY policy) AS n FROM po) WHERE i <= ceil(n * 0.5::DOUBLE) GROUP BY 1),
gp AS (SELECT o.policy AS comparator, c.family_id, o.regret - c.regret AS delta FROM po o JOIN po c ON c.assay_id = o.assay_id AND c.policy = 'chosen' WHERE o.policy IN ({_QUOTED})), {_WITH_GAPS.format(_QUOTED)},
{_pooled('comparator', 'family_id', 'SELECT comparator, family_id, sum(delta) AS s, count(delta) AS c FROM gp GROUP BY ALL')}, xx AS (SELECT comparator, rep, sum(s) / sum(c) AS v FROM d GROUP BY ALL),
lim AS (SELECT comparator, round(quantile_cont(v, 0.025), 9) AS lower, (1 + count(*) FILTER (v <= 0)) / (1 + count(v)) AS p FROM xx GROUP BY 1), ad AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, comparator) + 1) * p) AS a FROM lim JOIN dif USING (comparator)), hm AS (SELECT *, max(a) OVER (ORDER BY p, comparator ROWS UNBOUNDED PRECEDING) AS adjusted FROM ad),
sp AS (SELECT * FROM po WHERE policy IN ('chosen', 'always_best')), {_AREAS.format('ar', 'panel, policy', 'sp')}, e AS (SELECT panel, policy, {_STRIPS.format('regret')} AS area FROM ar GROUP BY 1, 2), pn AS (SELECT panel, round(max(area) FILTER (policy = 'always_best') - max(area) FILTER (policy = 'chosen'), 6) AS v FROM e GROUP BY 1)
SELECT gate, round(value, 6) AS value, coalesce(passed, false) AS passed FROM (SELECT 'regret_area' AS gate, point AS value, lower > 0 AND adjusted < 0.05 AS passed FROM hm WHERE comparator = 'always_best'
UNION ALL SELECT 'utility_at_half', c.regret, c.regret < b.regret AND c.gain >= b.gain AND c.failure <= b.failure FROM ha c, ha b WHERE c.policy = 'chosen' AND b.policy = 'always_best'
UNION ALL SELECT 'coverage', avg((gain >= confidence)::INT::DOUBLE), avg((gain >= confidence)::INT::DOUBLE) BETWEEN 0.85 AND 0.95 FROM po WHERE policy = 'chosen' UNION ALL SELECT 'panel_direction', min(v), count(*) = 3 AND min(v) > 0 FROM pn
UNION ALL SELECT 'ablations', min(point), min(point) > 0 FROM hm WHERE comparator <> 'always_best' UNION ALL SELECT 'conclusion', NULL, true)""",
    "a_gates_conservative": f"""{_SUREST}, su AS (SELECT * REPLACE (panel::INTEGER AS panel) FROM sure UNION ALL SELECT * REPLACE (-1 AS panel) FROM sure), {_within('panel', 'su')}, w AS (SELECT d3.panel, d3.rep, s.assay_id, s.gain, s.regret, s.decision FROM d3 JOIN su s USING (panel, family_id, protein_id, assay_id)),
{_improved('w', 'panel, rep', '1')}, {_improved('su', 'panel', '2')}, y AS (SELECT panel, rep, unnest(['regret_auc', 'risk_auc', 'utility_half']) AS name, unnest([regret_auc, risk_auc, utility_half]) AS v FROM imp1),
li AS (SELECT panel, name, round(quantile_cont(v, 0.025), 9) AS lower, (1 + count(*) FILTER (v <= 0)) / (1 + count(v)) AS p FROM y GROUP BY ALL), pv AS (SELECT panel, unnest(['regret_auc', 'risk_auc', 'utility_half']) AS name, round(unnest([regret_auc, risk_auc, utility_half]), 9) AS v FROM imp2),
asked AS (SELECT name, p FROM li WHERE panel = -1 AND name <> 'regret_auc' UNION ALL SELECT 'panel:' || panel, p FROM li WHERE panel >= 0 AND name = 'regret_auc'), ad AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p) AS a FROM asked), hm AS (SELECT name, max(a) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) AS adjusted FROM ad)
SELECT gate, round(value, 6) AS value, round(lower, 6) AS lower, round(adjusted, 6) AS adjusted, passed FROM (SELECT CASE name WHEN 'regret_auc' THEN 'regret_area' WHEN 'risk_auc' THEN 'failures' ELSE 'gain_at_half' END AS gate, v AS value, lower, adjusted, CASE name WHEN 'regret_auc' THEN lower > 0 WHEN 'risk_auc' THEN lower >= 0 ELSE v >= 0 END AS passed
  FROM pv JOIN li USING (panel, name) LEFT JOIN hm USING (name) WHERE panel = -1 UNION ALL SELECT 'panel:' || panel, v, NULL, adjusted, v > 0 FROM pv JOIN hm ON hm.name = 'panel:' || panel WHERE panel >= 0 AND pv.name = 'regret_auc'
  UNION ALL SELECT 'panel_direction', min(v), NULL, NULL, bool_and(v > 0) FROM pv WHERE panel >= 0 AND name = 'regret_auc')""",
}
