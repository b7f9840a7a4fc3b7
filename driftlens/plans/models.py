"""Queries of fits, cross-fitting, policy search and resampling, with SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.codes import RESIDUES, draw
from driftlens.operators import adapters, boosting, crossfit, discovery, encoding, graph, linear, metrics, policies, resampling, sparse, splits, supervised
from driftlens.operators.storage import shared_folder, stored
from driftlens.plans.bindings import items, scores
from driftlens.plans.studies import _DRAW, _FLAT, _ITEMS, _SCORES, TASK, _ranked, _round

#: Rounds and leaves in queries that fit many forests of trees side by side: far below the library's defaults.
SMALL = {"rate": 0.2, "rounds": 4, "leaves": 6, "least": 5, "l2": 1.0, "bins": 32, "depth": 3}
COLUMNS = crossfit.Columns(["f1", "f2", "f3"], task="assay_id")
#: What tells the features of `_cross` but the scores, and the scores.
KEYS, VARYING = ["code", "length"], ["qty", "disc", "tax"]
REPEATS = 50
LEVELS = ["family_id", "protein_id", "assay_id"]


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """A row an assay and predictor: its selection gain and what is known without outcomes. Written once: fits read it in many jobs."""
    rows = scores(spark, d)
    known = rows.groupBy("family_id", "protein_id", *TASK).agg(
        F.round(F.avg("predicted"), 4).alias("f1"), F.round(F.stddev_pop("predicted"), 4).alias("f2"), F.count(F.lit(1)).cast("double").alias("f3"),
        F.when(F.substr("assay_id", F.lit(2)).cast("int") % 9 != 0, F.count_distinct("position").cast("double")).alias("msa_neff"), F.sum("position").cast("double").alias("protein_length"),
    )
    gains = metrics.top_selection(rows, TASK, "code").select(*TASK, F.round("gain_sd", 9).alias("gain"))
    return stored(known.join(gains, TASK))


def _foreseen(spark: SparkSession, d: str) -> DataFrame:
    """Tasks with a prediction of their gain that is off by a draw, and priors over all tasks."""
    noise = draw(F.col("assay_id"), F.col("model_id")) % 1000 / 1000 - 0.5
    rows = _tasks(spark, d).withColumn("predicted", F.round(F.col("gain") * 0.5 + noise, 6))
    return crossfit.with_priors(rows, rows, [], COLUMNS).withColumn("prior", F.round("prior", 9))


# fits

def ml_additive_ridge(spark, d):
    """Sparse ridge on position, substitution and mutation indicators, positions left out. Held against the dense form in tests."""
    rows = splits.position(items(spark, d).select("assay_id", "position", "code", "observed"), ["assay_id"])
    return sparse.additive_ridge(rows, ["assay_id"]).select("assay_id", "code", "observed", F.round("predicted", 3).alias("predicted"))


def _cross(spark, d):
    rows = items(spark, d).withColumn("length", F.lit(60))
    return supervised.cross_features(rows, ["assay_id"], "code", "ref", "alt", "position", "length", "observed", ["qty", "disc", "tax"], RESIDUES)


def f_cross_protein(spark, d):
    rows, _ = _cross(spark, d)
    place = lambda kind: sum(F.col(f"{kind}_{a}") * (i + 1) for i, a in enumerate(RESIDUES)).cast("int")
    total = lambda kind: sum(F.col(f"{kind}_{a}") for a in RESIDUES).cast("int")
    made = rows.select("assay_id", "code", place("reference").alias("reference_at"), total("reference").alias("references"), place("alternate").alias("alternate_at"), "normalized_position", "log_protein_length", "hydropathy_delta_sum", "qty", "disc", "tax", "target")
    return _round(made, "normalized_position", "log_protein_length", "hydropathy_delta_sum", "target", digits=6)


def ml_pooled(spark, d):
    """Ridge and boosted trees over all assays, proteins left out, with and without predictor scores: 150 rounds of 31 leaves,
    as the library has them. Parts are tested."""
    rows, names = _cross(spark, d)
    made = supervised.pooled(rows, names, VARYING, "protein_id", "assay_id", keys=KEYS, varying=VARYING)
    return made.select("model", "fold", "assay_id", "code", "target", F.round("predicted", 6).alias("predicted"))


def run_group_holdout(spark, d):
    """The metrics of `ml_pooled`'s ridge and boosted trees by held-out protein, from the same 150 rounds."""
    rows, names = _cross(spark, d)
    made = supervised.pooled(rows, names, [], "protein_id", "assay_id", ablation=False, keys=KEYS, varying=VARYING)
    # written once: the metrics ask for a prediction several times
    made = stored(made.select("model", "fold", "protein_id", "assay_id", "target", "predicted"))
    return metrics.regression(made, ["model", "fold", "protein_id", "assay_id"], "target")


def run_assays(spark, d):
    """Three fits on two splits of every assay, with radius, coverage and width; parts are tested."""
    return supervised.assays(items(spark, d).select("assay_id", "position", "code", "observed"), ["assay_id"], [1])


def run_repeated(spark, d):
    """Mean and biophysical ridge over two seeds."""
    return supervised.repeated(items(spark, d).select("assay_id", "position", "code", "observed"), ["assay_id"], 1, 2, models=("mean", "biophysical_ridge"))


def ml_transport(spark, d):
    """Elastic net and boosted trees of a task's gain and the error scale, for three families' folds left out; 250 rounds each,
    as the library has them."""
    rows = crossfit.crossed(crossfit.folded(_tasks(spark, d), [], "family_id", 3, "_own"), "_own", 3, "fold")
    net = crossfit.estimate(rows, ["fold"], COLUMNS, "elastic_net", {}).withColumnRenamed("predicted", "elastic")
    trees = crossfit.estimate(rows, ["fold"], COLUMNS, "boosted", crossfit.CANDIDATES[0]).select("fold", *TASK, F.col("predicted").alias("boosted"))
    errors = rows.withColumn("_e", F.col("gain") - F.avg("gain").over(crossfit.Window.partitionBy("fold", "role", "model_id")))
    scale = crossfit.error_scale(errors, ["fold"], COLUMNS, "_e").select("fold", *TASK, "scale")
    made = net.join(trees, ["fold", *TASK]).join(scale, ["fold", *TASK])
    return _round(made.select("fold", "family_id", *TASK, "gain", "elastic", "boosted", "scale"), "elastic", "boosted", "scale", digits=6)


def ml_param_search(spark, d):
    """The errors of the library's three candidates (250, 500 and 300 rounds) on families left out, and the one chosen."""
    errors, _ = crossfit.search(_tasks(spark, d), [], COLUMNS)
    return _round(errors, "error", digits=6)


def ml_out_of_group(spark, d):
    made = crossfit.out_of_group(_tasks(spark, d), [], COLUMNS, 4, "elastic_net", {})
    return _round(made.select("family_id", *TASK, "gain", "predicted", "prior", "baseline"), "predicted", "prior", digits=6)


def pl_crossfit(spark, d):
    made = crossfit.cross_fit(_tasks(spark, d), COLUMNS, folds=3, inner=3, coverage=0.5, candidates=(SMALL | {"rounds": 2}, SMALL | {"rounds": 2, "leaves": 3}), settings=SMALL | {"rounds": 2})
    return made.select("fold", "candidate", "family_id", *TASK, "gain", "predicted", "prior", "scale", "decision", "quantile", "lower", "selected", "confidence", "trusted")


def ml_components(spark, d):
    """Four forests of regret and gain with balanced panels, for the families left out. Held against a twin in tests."""
    n = F.substr("family_id", F.lit(2)).cast("int")
    own = crossfit.Window.partitionBy("assay_id")
    rows = _tasks(spark, d).withColumns({"panel": F.substr("protein_id", F.lit(2)).cast("int") % 3, "regret": F.max("gain").over(own) - F.col("gain"), "test": n % 4 == 0})
    shapes, meta = ["f1", "f2"], ["f3", "protein_length"]
    parts = {"p_regret": ("regret", shapes), "p_gain_meta": ("gain", meta), "p_gain_all": ("gain", [*meta, *shapes]), "p_gain_shape": ("gain", shapes)}
    made = boosting.components(rows.filter("NOT test"), rows.filter("test"), [], parts, "panel", trees=10, depth=4)
    return _round(made.select("family_id", *TASK, "gain", "regret", *parts), *parts, digits=6)


def ml_winner(spark, d):
    """Whether one predictor gains more than another in an assay, judged by families left out."""
    wide = _tasks(spark, d).groupBy("family_id", "protein_id", "assay_id").pivot("model_id", ["qty", "disc", "tax"]).agg(F.max("gain").alias("gain"), F.max("f1").alias("f1"), F.max("f2").alias("f2"))
    rows = wide.withColumn("label", (F.col("qty_gain") > F.col("disc_gain")).cast("int"))
    made, _ = supervised.winner(rows, ["qty_f1", "qty_f2", "disc_f1", "disc_f2"], "family_id", folds=3, settings=SMALL)
    return _round(supervised.win_summary(made, "protein_id"), "prevalence", "roc_auc", "brier", "accuracy", "balanced_accuracy", "majority_accuracy", "mean_group_accuracy", digits=6)


def m_geometry(spark, d):
    """How many dimensions the ranked predictors of an assay span. Held against NumPy in tests."""
    own = crossfit.Window.partitionBy("assay_id")
    rows = items(spark, d).withColumns({c: F.percent_rank().over(own.orderBy(c)) for c in ("qty", "disc", "tax", "observed")})
    return _round(linear.geometry(rows, ["assay_id"], ["qty", "disc", "tax", "observed"]), "effective_rank", digits=6)


def _customers(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    return rows.select(k, F.when(k % 4 == 0, "new").otherwise("known").alias("role"), F.when(k % 7 != 0, F.col("c_acctbal").cast("double")).alias("balance"), F.when(k % 11 == 0, None).when((k % 4 == 0) & (k % 5 == 0), "unseen").otherwise(F.col("c_mktsegment")).alias("segment"))


def f_impute_encode(spark, d):
    """Medians, modes, categories and scales of the known customers, applied to all."""
    rows = _customers(spark, d)
    state = encoding.fit(rows.filter("role = 'known'"), [], ["balance"], ["segment"])
    made = encoding.apply(rows, state, [], ["balance"], ["segment"], scale=True)
    hot = F.array_position(F.slice("features", 2, 1000), F.lit(1.0)).cast("int")
    return made.select("c_custkey", F.round(F.get("features", F.lit(0)), 6).alias("balance"), hot.alias("segment_at"), (F.size("features") - 1).cast("int").alias("segments"))


# policies and resampling

def pl_policy_search(spark, d):
    made = crossfit.policy_search(_foreseen(spark, d), [], COLUMNS)
    return _round(made.select("shrinkage", "margin", "regret_area", "mean_regret", "decision_mean", "neff_mean", "length_sd", "chosen"), "regret_area", "mean_regret", "decision_mean", "neff_mean", "length_sd", digits=6)


HIGHEST = {"decision_only": ("decision", "decision"), "uncalibrated": ("predicted", "predicted"), "elastic_net": ("elastic", "elastic"), "ablation:msa_only": ("f3", "f3")}
FIXED = {"always_best": None, "msa_depth": "protein_length", "score_dispersion": "f2"}


def pl_policies(spark, d):
    """The row that each of ten policies takes of each assay; the chosen one by the highest prior plus prediction."""
    rows = _foreseen(spark, d).withColumns({"decision": F.round(0.75 * F.col("predicted") + 0.25 * F.col("prior"), 6), "elastic": F.round(F.col("f1") / 1000 - F.col("f2") / 900, 6)})
    first = F.row_number().over(crossfit.Window.partitionBy("assay_id").orderBy(F.desc(F.round(F.col("prior") + F.col("predicted"), 6)), "model_id"))
    rows = rows.withColumns({"chosen": first == 1, "sure": F.round(F.col("predicted") - 0.1, 6)})
    made = policies.policy_rows(rows, ["assay_id"], "model_id", "gain", HIGHEST, {"chosen": ("chosen", "sure")}, FIXED, F.col("baseline"))
    return _round(made.select("policy", *TASK, "gain", "regret", "confidence"), "regret", "confidence", digits=6)


def s_panel_policy(spark, d):
    """What the chosen rows improve over always taking the best model, as areas by panel."""
    rows = pl_policies(spark, d).filter("policy IN ('chosen', 'always_best')").withColumn("panel", F.substr("assay_id", F.lit(2)).cast("int") % 3)
    made = crossfit.areas(rows, ["panel", "policy"], [F.desc("confidence"), F.col("assay_id")], {"regret_area": F.col("regret"), "risk_area": (F.col("gain") <= 0).cast("double")})
    side = lambda p, c: F.max(F.when(F.col("policy") == p, F.col(c)))
    gains = made.groupBy("panel").agg(*((side("always_best", c) - side("chosen", c)).alias(c) for c in ("regret_area", "risk_area")))
    return _round(gains, "regret_area", "risk_area", digits=6)


def c_selected_lower(spark, d):
    """Bounds of the policy 0.75, 0.1, whose constants come from a third of the families, calibrated on a third."""
    part = F.substr("family_id", F.lit(2)).cast("int") % 3
    rows = _foreseen(spark, d).withColumns({"role": F.when(part == 0, "calibration").when(part == 1, "test").otherwise("train"), "scale": F.round(F.abs("predicted") / 2 + 0.5, 6)})
    taken = crossfit.decided(rows.filter("role = 'train'"), [], COLUMNS, F.lit(0.75), F.lit(0.1))
    policy = crossfit.constants(taken, [], COLUMNS).withColumns({"shrinkage": F.lit(0.75), "margin": F.lit(0.1)})
    made = crossfit.selected_lower(rows, [], COLUMNS, policy, 0.8)
    return _round(made.select(*TASK, "decision", "quantile", "lower", "selected", "confidence", "trusted"), "decision", "quantile", "lower", "confidence", digits=6)


def pl_abstain_scores(spark, d):
    rows = _foreseen(spark, d).select("family_id", *TASK, F.round("f1", 1).alias("regret"), F.col("predicted").alias("gain_all"), F.round("f2", 0).alias("gain_meta"), F.col("f3").alias("gain_shape"))
    reference = rows.filter(F.substr("family_id", F.lit(2)).cast("int") % 3 == 0)
    made = crossfit.abstention_scores(rows, reference, [])
    names = [c for c in made.columns if c not in rows.columns]
    return _round(made.select(*TASK, *names), *names, digits=6)


def b_nested_external(spark, d):
    made = resampling.nested_external(scores(spark, d), ("qty", "disc"), repeats=REPEATS)
    return _round(made.select("model", "mean_spearman", "bootstrap_mean", "lower", "upper", "proteins", "assays"), "mean_spearman", "bootstrap_mean", "lower", "upper", digits=6)


def b_policy_difference(spark, d):
    rows = _foreseen(spark, d)
    best = F.max("gain").over(crossfit.Window.partitionBy("assay_id"))
    first = F.row_number().over(crossfit.Window.partitionBy("assay_id").orderBy(F.desc("predicted"), "model_id"))
    rows = rows.withColumns({"regret": best - F.col("gain"), "_i": first})
    ours = rows.filter("_i = 1").withColumn("confidence", F.col("predicted"))
    other = rows.filter("model_id = baseline").withColumn("confidence", F.lit(0.0))
    made = resampling.policy_difference(ours, other, LEVELS, repeats=REPEATS)
    return _round(made, "point", "lower", "upper", "above_zero", digits=6)


# unknown layouts, resumable scores, families

UNKNOWN = ["Mutant Code", "label", "variant_note", "Activity (A)", "site_score", "other", "constant effect"]


def _unknown(spark, d):
    """Every assay's items in columns of unclear names, some of them decoys, and some empty in some assays."""
    n, p = F.substr("assay_id", F.lit(2)).cast("int"), F.col("position")
    cells = [
        F.when(n % 3 != 0, F.col("code")), F.when(n % 3 == 0, F.concat(F.lit("p."), "code")).otherwise(F.concat(F.lit("n"), p.cast("string"))), F.when(p % 5 == 0, F.col("code")).otherwise("x"),
        F.when((n % 4 != 0) & (p % 7 != 0), F.floor("observed").cast("string")), p.cast("string"), F.col("qty").cast("string"), F.lit("1"),
    ]
    return items(spark, d).select("assay_id", *(c.alias(name) for c, name in zip(cells, UNKNOWN, strict=True)), F.lit(RESIDUES * 3).alias("sequence"), F.when(n % 2 == 0, 1).otherwise(-1).alias("direction"))


def a_venus_canonical(spark, d):
    """Columns chosen in each assay's table of unknown layout, and its substitutions with their median outcome."""
    rows = _unknown(spark, d)
    chosen = discovery.choose_columns(rows, ["assay_id"], UNKNOWN, "sequence", "assay_id")
    made = discovery.canonical(rows, chosen, ["assay_id"], UNKNOWN, "sequence", "direction")
    return made.join(chosen, "assay_id").select("assay_id", "mutation_column", "outcome_column", "variant_id", F.round("effect", 4).alias("effect"), "source_rows")


class Doubled:
    """A scorer for the query below: twice the place, nothing for every sixth place, and some targets it cannot do."""

    model_id, model_version = "doubled", "1"

    def score_target(self, target, variants):
        if int(target["target_id"][1:]) % 17 == 3:
            raise RuntimeError("no scores")
        place = variants["variant_id"].str.slice(1, -1).astype(int)
        return variants.assign(score=place * 2.0)[place % 6 != 0]


def io_score_panel(spark, d):
    """The audit of a scoring run that finds the scores of half of its targets from an earlier one."""
    rows = stored(items(spark, d).select(F.lit("panel").alias("panel_id"), F.col("assay_id").alias("target_id"), F.col("code").alias("variant_id")))
    targets = stored(rows.select("target_id").distinct()).select("target_id", F.lit(RESIDUES * 3).alias("sequence"), F.sha2(F.lit(RESIDUES * 3), 256).alias("sequence_sha256"))
    store = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    adapters.score_panel(Doubled(), targets.filter(F.substr("target_id", F.lit(2)).cast("int") % 2 == 0), rows, "first", store)
    made, audit = adapters.score_panel(Doubled(), targets, rows, "second", store)
    sums = made.groupBy("target_id").agg(F.sum("score").alias("total"))
    return audit.join(sums, "target_id", "left").select("target_id", "cache_hit", "variants", F.round("coverage", 9).alias("coverage"), "status", "error", "total")


def g_families(spark, d):
    """Families of suppliers over a chained graph whose edges must reach an identity and both coverages."""
    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{d}/supplier.parquet")
    edges = rows.select(k.alias("a"), (k + k % 9 + 1).alias("b"), (k * 13 % 100 / 100).alias("identity"), (k * 29 % 100 / 100).alias("coverage_a"), (k * 17 % 100 / 100).alias("coverage_b"))
    made, audited = graph.families(rows.select(k.alias("node")), edges, 0.3, 0.3)
    kept = audited.filter("qualifies AND b_family IS NOT NULL").groupBy(F.col("a_family").alias("family_id")).agg(F.count(F.lit(1)).alias("edges"))
    return made.join(kept, "family_id", "left").select("node", "family_id", "family_size", F.coalesce("edges", F.lit(0)).alias("edges"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ml_additive_ridge, f_cross_protein, ml_pooled, run_group_holdout, run_assays, run_repeated, ml_transport, ml_param_search, ml_out_of_group, pl_crossfit, ml_components, ml_winner, m_geometry,
        f_impute_encode, pl_policy_search, pl_policies, s_panel_policy, c_selected_lower, pl_abstain_scores, b_nested_external, b_policy_difference, a_venus_canonical, io_score_panel, g_families,
    )
}

_TASKS = f"""WITH {_SCORES}, kk AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY assay_id, model_id) * 0.1::DOUBLE)) AS kk, row_number() OVER (PARTITION BY assay_id, model_id ORDER BY predicted DESC, code) AS a FROM scores),
tasks AS (SELECT family_id, protein_id, assay_id, model_id, round(CASE WHEN stddev_pop(observed) > 1e-12 THEN (avg(observed) FILTER (a <= kk) - avg(observed)) / stddev_pop(observed) ELSE 0 END, 9) AS gain,
  round(avg(predicted), 4) AS f1, round(stddev_pop(predicted), 4) AS f2, count(*)::DOUBLE AS f3, CASE WHEN substr(assay_id, 2)::INT % 9 <> 0 THEN count(DISTINCT position)::DOUBLE END AS msa_neff, sum(position)::DOUBLE AS protein_length
  FROM kk GROUP BY family_id, protein_id, assay_id, model_id),
pri AS (SELECT model_id, avg(gain) AS prior FROM tasks GROUP BY 1), base AS (SELECT model_id AS baseline FROM pri ORDER BY prior DESC, model_id LIMIT 1),
seen AS (SELECT t.*, round(gain * 0.5::DOUBLE + ({_DRAW.format("assay_id || '|' || model_id")} % 1000 / 1000.0::DOUBLE - 0.5::DOUBLE), 6) AS predicted, round(prior, 9) AS prior, baseline FROM tasks t JOIN pri USING (model_id), base)"""


def _taken(source: str, by: str) -> str:
    """CTEs r and taken: what the policy takes of each task; source has shrinkage and margin."""
    own = f"PARTITION BY {by}assay_id"
    return f"""d AS (SELECT *, shrinkage * predicted + (1 - shrinkage) * prior AS decision FROM {source}),
r AS (SELECT *, max(gain) OVER ({own}) - gain AS regret, row_number() OVER ({own} ORDER BY decision DESC, model_id) AS i, max(decision) OVER ({own}) AS top, max(CASE WHEN model_id = baseline THEN decision END) OVER ({own}) AS low FROM d),
taken AS (SELECT * FROM r WHERE CASE WHEN top - low > margin THEN i = 1 ELSE model_id = baseline END)"""


_LOG = {"decision": "decision", "neff": "ln(1 + msa_neff)", "length": "ln(1 + protein_length)"}
_FIXED = ", ".join(f"coalesce(avg({v}), 0) AS {k}_mean, CASE WHEN stddev_pop({v}) > 1e-12 THEN stddev_pop({v}) ELSE 1 END AS {k}_sd" for k, v in _LOG.items())
_SURE = "round(" + " + ".join(f"{w}::DOUBLE * (coalesce({_LOG[k]}, {k}_mean) - {k}_mean) / {k}_sd" for k, w in (("neff", 1.0), ("length", 0.5), ("decision", 0.25))) + ", 9)"
_STRIPS = "sum({0} * CASE WHEN c IN (1, 10) THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END)"


def _share(column: str) -> str:
    return f"(SELECT count(*) FROM ref WHERE round(ref.{column}, 9) <= round(x.{column}, 9)) / (SELECT count(*)::DOUBLE FROM ref)"


_HIT = lambda seed, level, name, rest: _DRAW.format(f"'{seed}|{level}|' || {name} || '|' || {rest}")
_LIMIT = "round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper"
_RHO = "CASE WHEN (xx - sx * sx / c) * (yy - sy * sy / c) > 1e-9 THEN (xy - sx * sy / c) / sqrt((xx - sx * sx / c) * (yy - sy * sy / c)) ELSE 0 END"


def _level(name: str, source: str, above: str, level: str, key: str) -> str:
    """CTE: how often each replicate takes each unit of a level, below the counts of `source`."""
    by = f"{above}, " if above else ""
    units = f"SELECT *, row_number() OVER ({'PARTITION BY ' + above if above else ''} ORDER BY {level}) - 1 AS i, count(*) OVER ({'PARTITION BY ' + above if above else ''}) AS n FROM (SELECT DISTINCT {by}{level} FROM seen)"
    slots = f"SELECT u.*, s.rep, c.copy FROM ({units}) u JOIN {source} s USING ({above}), LATERAL (SELECT unnest(range(1, s.times + 1)) AS copy) c" if above else f"SELECT u.*, rep, 1 AS copy FROM ({units}) u, range({REPEATS}) q(rep)"
    return f"""{name} AS (SELECT {by}{level}, rep, times FROM (SELECT {by}rep, {_HIT(1, level, key, "rep || '|' || copy || '|' || i")} % n AS i, count(*) AS times FROM ({slots}) GROUP BY ALL) JOIN ({units}) USING ({by}i))"""


_AREAS = """{0} AS (SELECT {1}, c, sum(regret * t) / max(k) AS regret, sum((gain <= 0)::INT * t) / max(k) AS risk FROM (SELECT *, greatest(0, least(times, k - before)) AS t FROM
  (SELECT *, greatest(1, ceil(total * (c / 10.0::DOUBLE))) AS k FROM (SELECT *, coalesce(sum(times) OVER (PARTITION BY {1} ORDER BY confidence DESC, assay_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(times) OVER (PARTITION BY {1}) AS total FROM {2}), range(1, 11) s(c))) GROUP BY {1}, c)"""

_RAND = _DRAW.format("'row|1|' || assay_id || '|' || model_id")
_WAYS = {name: (c, sure) for name, (c, sure) in HIGHEST.items()} | {"oracle": ("gain", "gain"), "random": (_RAND, _DRAW.format("'confidence|1|' || assay_id") + " / 4294967296.0::DOUBLE"), "chosen": ("round(prior + predicted, 6)", "round(predicted - 0.1::DOUBLE, 6)")}
_POLICIES = f"""{_TASKS}, z AS (SELECT *, max(gain) OVER (PARTITION BY assay_id) - gain AS regret, round(0.75::DOUBLE * predicted + 0.25::DOUBLE * prior, 6) AS decision, round(f1 / 1000 - f2 / 900, 6) AS elastic FROM seen),
pol AS ({" UNION ALL ".join(f"SELECT '{n}' AS policy, assay_id, model_id, gain, regret, ({sure})::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY assay_id ORDER BY {c} DESC, model_id) AS i FROM z) WHERE i = 1" for n, (c, sure) in _WAYS.items())}
UNION ALL {" UNION ALL ".join(f"SELECT '{n}', assay_id, model_id, gain, regret, {sure or 0.0}::DOUBLE FROM z WHERE model_id = baseline" for n, sure in FIXED.items())})"""

ORACLES: dict[str, str] = {
    "pl_policies": f"{_POLICIES} SELECT policy, assay_id, model_id, gain, round(regret, 6) AS regret, round(confidence, 6) AS confidence FROM pol",
    "s_panel_policy": f"""{_POLICIES}, s AS (SELECT *, substr(assay_id, 2)::INT % 3 AS panel, 1 AS times FROM (SELECT policy, assay_id, gain, round(regret, 6) AS regret, round(confidence, 6) AS confidence FROM pol) WHERE policy IN ('chosen', 'always_best')),
{_AREAS.format('ar', 'panel, policy', 's')}, e AS (SELECT panel, policy, {_STRIPS.format('regret')} AS regret_area, {_STRIPS.format('risk')} AS risk_area FROM ar GROUP BY 1, 2)
SELECT panel, round(max(regret_area) FILTER (policy = 'always_best') - max(regret_area) FILTER (policy = 'chosen'), 6) AS regret_area, round(max(risk_area) FILTER (policy = 'always_best') - max(risk_area) FILTER (policy = 'chosen'), 6) AS risk_area FROM e GROUP BY 1""",
    "f_cross_protein": f"""WITH items AS ({_ITEMS}), o AS (SELECT *, row_number() OVER (PARTITION BY assay_id ORDER BY code) - 1 AS i, count(*) OVER (PARTITION BY assay_id) AS n FROM items),
t AS (SELECT * FROM o WHERE n <= 1000 OR i IN (SELECT floor(j * (n - 1) / 999.0) FROM range(1000) s(j))),
h AS (SELECT unnest(['A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y']) AS a, unnest([1.8,2.5,-3.5,-3.5,2.8,-0.4,-3.2,4.5,-3.9,3.8,1.9,-3.5,-1.6,-3.5,-4.5,-0.8,-0.7,4.2,-0.9,-1.3]::DOUBLE[]) AS v)
SELECT assay_id, code, strpos('{RESIDUES}', ref)::INTEGER AS reference_at, 1 AS "references", strpos('{RESIDUES}', alt)::INTEGER AS alternate_at, round(position / 60.0::DOUBLE, 6) AS normalized_position, round(ln(61.0::DOUBLE), 6) AS log_protein_length,
  round(y.v - x.v, 6) AS hydropathy_delta_sum, qty, disc, tax, round((rank() OVER (PARTITION BY assay_id ORDER BY observed) + (count(*) OVER (PARTITION BY assay_id, observed) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY assay_id), 6) AS target
FROM t JOIN h x ON x.a = ref JOIN h y ON y.a = alt""",
    "f_impute_encode": """WITH c AS (SELECT c_custkey, c_custkey % 4 <> 0 AS known, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal::DOUBLE END AS balance, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 4 = 0 AND c_custkey % 5 = 0 THEN 'unseen' ELSE c_mktsegment END AS segment FROM customer),
m AS (SELECT median(balance) AS mid FROM c WHERE known), s AS (SELECT avg(coalesce(balance, mid)) AS mu, stddev_pop(coalesce(balance, mid)) AS sd FROM c, m WHERE known),
g AS (SELECT segment, count(*) AS n FROM c WHERE known AND segment IS NOT NULL GROUP BY 1), top AS (SELECT segment AS mode FROM g ORDER BY n DESC, segment LIMIT 1), l AS (SELECT list(segment ORDER BY segment) AS levels FROM g)
SELECT c_custkey, round((coalesce(balance, mid) - mu) / sd, 6) AS balance, coalesce(list_position(levels, coalesce(segment, mode)), 0)::INTEGER AS segment_at, len(levels)::INTEGER AS segments FROM c, m, s, top, l""",
    "pl_policy_search": f"""{_TASKS}, grid AS (SELECT * FROM (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) a(shrinkage), (VALUES (0.05::DOUBLE), (0.075::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE)) b(margin)), x AS (SELECT * FROM seen, grid),
{_taken('x', 'shrinkage, margin, ')}, fixed AS (SELECT shrinkage, margin, avg(regret) AS mean_regret, {_FIXED} FROM taken GROUP BY 1, 2), sure AS (SELECT t.*, {_SURE} AS sure FROM taken t JOIN fixed USING (shrinkage, margin)),
o AS (SELECT *, row_number() OVER (PARTITION BY shrinkage, margin ORDER BY sure DESC, assay_id) AS j, count(*) OVER (PARTITION BY shrinkage, margin) AS n FROM sure),
pt AS (SELECT shrinkage, margin, c, avg(regret) AS v FROM o, range(1, 11) s(c) WHERE j <= ceil(n * (c / 10.0::DOUBLE)) GROUP BY ALL), ar AS (SELECT shrinkage, margin, {_STRIPS.format('v')} AS area FROM pt GROUP BY 1, 2)
SELECT shrinkage, margin, round(area, 6) AS regret_area, round(mean_regret, 6) AS mean_regret, round(decision_mean, 6) AS decision_mean, round(neff_mean, 6) AS neff_mean, round(length_sd, 6) AS length_sd,
  row_number() OVER (ORDER BY round(area, 9), round(mean_regret, 9), margin DESC, shrinkage DESC) = 1 AS chosen FROM ar JOIN fixed USING (shrinkage, margin)""",
    "c_selected_lower": f"""{_TASKS}, x AS (SELECT *, 0.75::DOUBLE AS shrinkage, 0.1::DOUBLE AS margin, substr(family_id, 2)::INT % 3 AS part, round(abs(predicted) / 2 + 0.5::DOUBLE, 6) AS scale FROM seen),
{_taken('x', 'part, ')}, fixed AS (SELECT {_FIXED} FROM taken WHERE part = 2),
cal AS (SELECT *, (decision - gain) / scale AS res, count(*) OVER (PARTITION BY family_id) AS size FROM taken WHERE part = 0), g AS (SELECT count(DISTINCT family_id) AS g FROM cal),
mass AS (SELECT res, sum(1.0::DOUBLE / ((g + 1) * size)) OVER (ORDER BY res, assay_id ROWS UNBOUNDED PRECEDING) AS m FROM cal, g), q AS (SELECT min(res) FILTER (m >= 0.8::DOUBLE - 1e-9) AS q FROM mass),
chosen AS (SELECT assay_id, model_id, {_SURE} AS confidence FROM taken, fixed WHERE part = 1)
SELECT d.assay_id, d.model_id, round(decision, 6) AS decision, round(q, 6) AS quantile, round(decision - q * scale, 6) AS lower, c.model_id IS NOT NULL AS selected, round(confidence, 6) AS confidence, c.model_id IS NOT NULL AND coalesce(decision - q * scale > 0, false) AS trusted
FROM (SELECT * FROM d WHERE part = 1) d CROSS JOIN q LEFT JOIN chosen c ON c.assay_id = d.assay_id AND c.model_id = d.model_id""",
    "pl_abstain_scores": f"""{_TASKS}, x AS (SELECT family_id, assay_id, model_id, round(f1, 1) AS regret, predicted AS gain_all, round(f2, 0) AS gain_meta, f3 AS gain_shape FROM seen), ref AS (SELECT * FROM x WHERE substr(family_id, 2)::INT % 3 = 0),
s AS (SELECT avg(gain_all) AS gm, stddev_pop(gain_all) AS gs, avg(regret) AS rm, stddev_pop(regret) AS rs FROM ref),
p AS (SELECT x.*, 1 - {_share('regret')} AS safe, {_share('gain_meta')} AS pm, {_share('gain_all')} AS pa, {_share('gain_shape')} AS ps FROM x)
SELECT assay_id, model_id, round(safe, 6) AS pure_regret, {', '.join(f"round(2 * {c} * safe / ({c} + safe + 1e-12), 6) AS harm_{n}" for c, n in (('pm', 'gain_meta'), ('pa', 'gain_all'), ('ps', 'gain_shape')))},
  {', '.join(f"round((gain_all - gm) / gs - {w}::DOUBLE * (regret - rm) / rs, 6) AS blend_{str(w).replace('.', '_')}" for w in (0.5, 1.0, 1.5, 2.0))} FROM p, s""",
    "b_nested_external": f"""WITH {_SCORES}, two AS (SELECT * FROM scores WHERE model_id IN ('qty', 'disc')), {_ranked('two', 'protein_id, assay_id, model_id')},
m AS (SELECT protein_id, assay_id, model_id, position, count(*) AS c, sum(ro) AS sx, sum(rp) AS sy, sum(ro * ro) AS xx, sum(rp * rp) AS yy, sum(ro * rp) AS xy FROM ranked GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY protein_id, assay_id ORDER BY position) - 1 AS i, count(*) OVER (PARTITION BY protein_id, assay_id) AS n FROM (SELECT DISTINCT protein_id, assay_id, position FROM two)),
hp AS (SELECT protein_id, assay_id, rep, {_HIT(1, 'position', "protein_id || '/' || assay_id", "rep || '|' || i")} % n AS i, count(*) AS t FROM u, range({REPEATS}) r(rep) GROUP BY ALL),
q AS (SELECT protein_id, assay_id, model_id, rep, sum(c * t) AS c, sum(sx * t) AS sx, sum(sy * t) AS sy, sum(xx * t) AS xx, sum(yy * t) AS yy, sum(xy * t) AS xy FROM hp JOIN u USING (protein_id, assay_id, i) JOIN m USING (protein_id, assay_id, position) GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY assay_id) - 1 AS i, count(*) OVER (PARTITION BY protein_id) AS n FROM (SELECT DISTINCT protein_id, assay_id FROM two)),
ha AS (SELECT protein_id, rep, {_HIT(1, 'assay', 'protein_id', "rep || '|' || i")} % n AS i, count(*) AS t FROM a, range({REPEATS}) r(rep) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (ORDER BY protein_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT protein_id FROM two)),
hq AS (SELECT rep, {_HIT(1, 'protein', "''", "rep || '|' || i")} % n AS i, count(*) AS t FROM p, range({REPEATS}) r(rep) GROUP BY ALL),
pv AS (SELECT a.protein_id, model_id, q.rep, sum({_RHO} * ha.t) / sum(ha.t) AS v FROM q JOIN a USING (protein_id, assay_id) JOIN ha ON ha.protein_id = a.protein_id AND ha.i = a.i AND ha.rep = q.rep GROUP BY ALL),
one AS (SELECT model_id, pv.rep, sum(v * hq.t) / sum(hq.t) AS v FROM pv JOIN p USING (protein_id) JOIN hq ON hq.i = p.i AND hq.rep = pv.rep GROUP BY ALL),
al AS (SELECT * FROM one UNION ALL SELECT 'qty_minus_disc', rep, max(v) FILTER (model_id = 'qty') - max(v) FILTER (model_id = 'disc') FROM one GROUP BY rep),
sp AS (SELECT protein_id, assay_id, model_id, {_FLAT} AS v FROM ranked GROUP BY ALL), p1 AS (SELECT protein_id, model_id, avg(v) AS v FROM sp GROUP BY ALL), p2 AS (SELECT model_id, avg(v) AS v FROM p1 GROUP BY 1),
pt AS (SELECT * FROM p2 UNION ALL SELECT 'qty_minus_disc', max(v) FILTER (model_id = 'qty') - max(v) FILTER (model_id = 'disc') FROM p2)
SELECT al.model_id AS model, round(max(pt.v), 6) AS mean_spearman, round(avg(al.v), 6) AS bootstrap_mean, {_LIMIT.replace('(v', '(al.v')}, (SELECT count(DISTINCT protein_id) FROM two) AS proteins, (SELECT count(DISTINCT assay_id) FROM two) AS assays
FROM al JOIN pt USING (model_id) GROUP BY 1""",
    "b_policy_difference": f"""{_TASKS}, z AS (SELECT *, max(gain) OVER (PARTITION BY assay_id) - gain AS regret, row_number() OVER (PARTITION BY assay_id ORDER BY predicted DESC, model_id) AS i FROM seen),
s AS (SELECT family_id, protein_id, assay_id, gain, regret, predicted AS confidence, 'ours' AS side FROM z WHERE i = 1 UNION ALL SELECT family_id, protein_id, assay_id, gain, regret, 0.0::DOUBLE, 'other' FROM z WHERE model_id = baseline),
{_level('l1', '', '', 'family_id', "''")}, {_level('l2', 'l1', 'family_id', 'protein_id', 'family_id')}, {_level('l3', 'l2', 'family_id, protein_id', 'assay_id', "family_id || '/' || protein_id")},
w AS (SELECT s.*, rep, times FROM s JOIN l3 USING (family_id, protein_id, assay_id)), {_AREAS.format('ar', 'side, rep', 'w')}, {_AREAS.format('ap', 'side', '(SELECT *, 1 AS times FROM s)')},
e AS (SELECT side, rep, {_STRIPS.format('regret')} AS regret_area, {_STRIPS.format('risk')} AS risk_area FROM ar GROUP BY 1, 2), ep AS (SELECT side, {_STRIPS.format('regret')} AS regret_area, {_STRIPS.format('risk')} AS risk_area FROM ap GROUP BY 1),
v AS ({' UNION ALL '.join(f"SELECT '{n}' AS endpoint, rep, max({n}) FILTER (side = 'other') - max({n}) FILTER (side = 'ours') AS v FROM e GROUP BY rep" for n in ('regret_area', 'risk_area'))}),
pt AS ({' UNION ALL '.join(f"SELECT '{n}' AS endpoint, max({n}) FILTER (side = 'other') - max({n}) FILTER (side = 'ours') AS p FROM ep" for n in ('regret_area', 'risk_area'))})
SELECT endpoint, round(max(p), 6) AS point, {_LIMIT}, round(avg((v > 0)::INT::DOUBLE), 6) AS above_zero FROM v JOIN pt USING (endpoint) GROUP BY 1""",
    "a_venus_canonical": f"""WITH items AS ({_ITEMS}), u AS (SELECT *, substr(assay_id, 2)::INT AS n, repeat('{RESIDUES}', 3) AS seq FROM items),
c AS (SELECT row_number() OVER () AS r, assay_id, n, seq, CASE WHEN n % 3 <> 0 THEN code END AS c1, CASE WHEN n % 3 = 0 THEN 'p.' || code ELSE 'n' || position END AS c2, CASE WHEN position % 5 = 0 THEN code ELSE 'x' END AS c3,
  CASE WHEN n % 4 <> 0 AND position % 7 <> 0 THEN floor(observed)::BIGINT::VARCHAR END AS c4, position::VARCHAR AS c5, qty::VARCHAR AS c6, '1' AS c7 FROM u),
l AS ({" UNION ALL ".join(f"SELECT r, assay_id, n, seq, '{name}' AS col, {hint} AS hinted, {priority} AS priority, c{i + 1} AS v FROM c" for i, (name, hint, priority) in enumerate((("Mutant Code", 1, 0), ("label", 0, 0), ("variant_note", 1, 0), ("Activity (A)", 0, 1), ("site_score", 0, -1), ("other", 0, 0), ("constant effect", 0, 1))))}),
q AS (SELECT *, regexp_replace(v, '^p[.]', '') AS b, try_cast(v AS DOUBLE) AS x FROM l), w AS (SELECT *, CASE WHEN regexp_full_match(b, '[A-Z][1-9][0-9]*[A-Z]') AND substr(seq, substr(b, 2, length(b) - 2)::INT, 1) = b[1] AND b[1] <> b[-1] THEN b END AS code FROM q),
pr AS (SELECT assay_id, col, any_value(hinted) AS hinted, any_value(priority) AS priority, count(code) AS valid, count(x) AS finite, min(x) < max(x) AS varied FROM w GROUP BY ALL),
mu AS (SELECT assay_id, col AS mutation_column FROM pr WHERE valid > 0 QUALIFY row_number() OVER (PARTITION BY assay_id ORDER BY hinted DESC, valid DESC, col) = 1),
ou AS (SELECT assay_id, mutation_column, col AS outcome_column FROM pr JOIN mu USING (assay_id) WHERE col <> mutation_column AND finite >= 3 AND varied QUALIFY row_number() OVER (PARTITION BY assay_id ORDER BY priority DESC, finite DESC, col) = 1),
e AS (SELECT o.*, a.code AS variant_id, b.x * CASE WHEN a.n % 2 = 0 THEN 1 ELSE -1 END AS effect FROM ou o JOIN w a ON a.assay_id = o.assay_id AND a.col = o.mutation_column JOIN w b ON b.r = a.r AND b.col = o.outcome_column WHERE a.code IS NOT NULL AND b.x IS NOT NULL)
SELECT assay_id, mutation_column, outcome_column, variant_id, round(median(effect), 4) AS effect, count(*) AS source_rows FROM e GROUP BY ALL""",
    "io_score_panel": f"""WITH items AS ({_ITEMS}), t AS (SELECT assay_id AS target_id, substr(assay_id, 2)::INT AS n, count(*) AS variants, count(*) FILTER (position % 6 <> 0) AS found, sum(position * 2.0::DOUBLE) FILTER (position % 6 <> 0) AS total FROM items GROUP BY ALL)
SELECT target_id, n % 2 = 0 AND n % 17 <> 3 AS cache_hit, variants, CASE WHEN n % 17 = 3 THEN 0.0::DOUBLE ELSE round(found / variants::DOUBLE, 9) END AS coverage, CASE WHEN n % 17 = 3 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN n % 17 = 3 THEN 'RuntimeError: no scores' ELSE '' END AS error, CASE WHEN n % 17 <> 3 THEN total END AS total FROM t""",
    "g_families": """WITH RECURSIVE n AS (SELECT s_suppkey AS node FROM supplier), l AS (SELECT s_suppkey AS a, s_suppkey + s_suppkey % 9 + 1 AS b FROM supplier WHERE s_suppkey * 13 % 100 >= 30 AND s_suppkey * 29 % 100 >= 30 AND s_suppkey * 17 % 100 >= 30),
k AS (SELECT * FROM l WHERE b IN (SELECT node FROM n)), both_ways AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r AS (SELECT node, node AS reach FROM n UNION SELECT r.node, w.b FROM r JOIN both_ways w ON r.reach = w.a),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY 1), f AS (SELECT component, 'sf_' || substr(sha256(string_agg(node::VARCHAR, '|' ORDER BY node::VARCHAR)), 1, 12) AS family_id, count(*) AS family_size FROM c GROUP BY 1),
e AS (SELECT component, count(*) AS edges FROM k JOIN c ON c.node = k.a GROUP BY 1) SELECT node, family_id, family_size, coalesce(edges, 0) AS edges FROM c JOIN f USING (component) LEFT JOIN e USING (component)""",
}
