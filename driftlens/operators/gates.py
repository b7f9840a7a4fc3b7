"""Audits of executed, repeated and selected model panels, of overlap, and the gates that a study must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators import joins, ranks, summaries
from driftlens.operators.metrics import average_rank, finite
from driftlens.operators.storage import stored


def _stated(models: DataFrame, most: int = 10_000) -> DataFrame:
    """A stated list that goes to all tasks; a longer one raises."""
    if models.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} models")
    return F.broadcast(models)


def _scored(predictions: DataFrame, extra: list[str]) -> DataFrame:
    """Each prediction's key once, with whether any of its rows has a finite score and status ok."""
    good = F.coalesce((F.col("status") == "ok") & finite("score"), F.lit(False))
    return predictions.groupBy(*extra, "model_id", "target_id", "variant_id").agg(F.bool_or(good).alias("_ok"), F.count(F.lit(1)).alias("_rows"))


def target_coverage(predictions: DataFrame, expected: DataFrame, models: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(extra, model_id, target_id, expected, scored, rows, unexpected, coverage) for each stated model and target.

    predictions(extra, model_id, target_id, variant_id, status, score); expected(extra, target_id, variant_id); models(extra,
    model_id), others are left out. extra: keys above the target, such as a panel. Targets without predictions have coverage 0,
    and so have those with keys that are not expected; a target that occurs in predictions alone has expected 0."""
    extra = extra or []
    models = _stated(models.select(*extra, "model_id").distinct())
    wanted = expected.select(*extra, "target_id", "variant_id").distinct()
    sizes = wanted.groupBy(*extra, "target_id").agg(F.count(F.lit(1)).alias("expected"))
    met = _scored(predictions, extra).join(models, [*extra, "model_id"], "left_semi").join(wanted.withColumn("_w", F.lit(True)), [*extra, "target_id", "variant_id"], "left")
    counts = met.groupBy(*extra, "model_id", "target_id").agg(F.count_if(F.col("_ok") & F.col("_w")).alias("scored"), F.sum("_rows").alias("rows"), F.count_if(F.col("_w").isNull()).alias("unexpected"))
    every = sizes.join(models, extra) if extra else sizes.crossJoin(models)
    made = every.join(counts, [*extra, "model_id", "target_id"], "full").na.fill(0, ["expected", "scored", "rows", "unexpected"])
    return made.withColumn("coverage", F.col("scored") / F.greatest("expected", F.lit(1)))


def shared_targets(coverage: DataFrame, chosen: DataFrame, least: float) -> DataFrame:
    """(target_id) that every chosen model covers by `least`; none if no model is chosen."""
    members = _stated(chosen.select("model_id").distinct())
    usable = coverage.filter((F.col("coverage") >= least) & (F.col("expected") > 0)).join(members, "model_id", "left_semi")
    total = chosen.agg(F.count_distinct("model_id").alias("_all"))
    return usable.groupBy("target_id").agg(F.count_distinct("model_id").alias("_n")).join(F.broadcast(total), F.col("_n") == F.col("_all")).select("target_id")


def panel_gates(chosen: DataFrame, shared: DataFrame, models: int, families: int, targets: int) -> DataFrame:
    """(gate, value, least, passed): enough models, families of models, and targets that all of them share."""
    row = lambda df, value, name, least: df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("gate"), "value", F.lit(least).cast("long").alias("least"), (F.col("value") >= least).alias("passed"))
    made = row(chosen, F.count_distinct("model_id"), "models", models).unionByName(row(chosen, F.count_distinct("family"), "families", families))
    return made.unionByName(row(shared, F.count(F.lit(1)), "shared_targets", targets))


def execution(coverage: DataFrame, models: DataFrame, least: float = 0.95, targets: int = 300) -> DataFrame:
    """(model_id, family, rows, unexpected, covered, status, digest_matches) of each of models(model_id, family, executed, current).

    covered: targets of at least that coverage. A model with keys that are not expected is `refused`; one with fewer covered
    targets, or no predictions, is `incomplete`. A missing digest does not match."""
    usable = (F.col("coverage") >= least) & (F.col("expected") > 0)
    per = coverage.groupBy("model_id").agg(F.sum("rows").alias("rows"), F.sum("unexpected").alias("unexpected"), F.count_if(usable).alias("covered"))
    rows = models.join(per, "model_id", "left").na.fill(0, ["rows", "unexpected", "covered"])
    status = F.when(F.col("unexpected") > 0, "refused").when(F.col("covered") >= targets, "complete").otherwise("incomplete")
    return rows.select("model_id", "family", "rows", "unexpected", "covered", status.alias("status"), F.coalesce(F.col("executed") == F.col("current"), F.lit(False)).alias("digest_matches"))


_KEY = ["model_id", "target_id", "variant_id"]


def _together(runs: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """A written row a key that any run has: for each run its least finite score (the run's name) and, where it has a status, whether
    a score of status ok is there (name_ok); _w: whether the key is expected. Expected keys stand there too, without a model.

    All runs are dealt by target once, in place of a join for each pair of them."""
    good = F.coalesce((F.col("status") == "ok") & finite("score"), F.lit(False))
    none = F.lit(None)
    parts = []
    for name, df in runs.items():
        score = F.when(finite("score"), F.col("score").cast("double"))
        there = good if "status" in df.columns else none
        parts.append(df.filter("model_id IS NOT NULL").select(*_KEY, *((score if r == name else none).cast("double").alias(r) for r in runs), *((there if r == name else none).cast("boolean").alias(f"{r}_ok") for r in runs)))
    parts.append(expected.select(none.cast(runs[next(iter(runs))].schema["model_id"].dataType).alias("model_id"), *_KEY[1:], *(none.cast("double").alias(r) for r in runs), *(none.cast("boolean").alias(f"{r}_ok") for r in runs)))
    rows = _all(parts).repartition("target_id").groupBy(*_KEY).agg(*(F.min(r).alias(r) for r in runs), *(F.bool_or(f"{r}_ok").alias(f"{r}_ok") for r in runs))
    wanted = F.max(F.col("model_id").isNull()).over(Window.partitionBy("target_id", "variant_id")) & F.col("target_id").isNotNull() & F.col("variant_id").isNotNull()
    return stored(rows.withColumn("_w", wanted))


def _covered(rows: DataFrame, models: DataFrame, runs: tuple[str, ...]) -> DataFrame:
    """(model_id, target_id, expected, a column a run: its expected keys with a score) from `_together`, for each stated model and target."""
    models = _stated(models.select("model_id").distinct())
    sizes = rows.filter("model_id IS NULL").groupBy("target_id").agg(F.count(F.lit(1)).alias("expected"))
    counts = rows.join(models, "model_id", "left_semi").groupBy("model_id", "target_id").agg(*(F.count_if(F.col(f"{r}_ok") & F.col("_w")).alias(f"_{r}") for r in runs))
    return sizes.crossJoin(models).join(counts, ["model_id", "target_id"], "full").na.fill(0, ["expected", *(f"_{r}" for r in runs)])


def _agreement(rows: DataFrame, left: str, right: str, by: list[str], least: int = 2) -> DataFrame:
    """(by, n, exact, rho) over keys of `_together` that both runs have finite scores of. by may hold the target, whose variants meet in one task."""
    pairs = rows.filter(F.col("model_id").isNotNull() & F.col(left).isNotNull() & F.col(right).isNotNull())
    if "target_id" not in by:
        equal = pairs.groupBy(*by).agg(F.count_if(F.col(left) == F.col(right)).alias("exact"))
        return ranks.correlation(pairs, by, left, right, least).join(equal, by)
    ranked = pairs.select(*by, F.col(left).alias("_one"), F.col(right).alias("_two")).withColumns({"_a": average_rank("_one", by), "_b": average_rank("_two", by)})
    varies = (F.count(F.lit(1)) >= least) & (F.max("_a") > F.min("_a")) & (F.max("_b") > F.min("_b"))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_one") == F.col("_two")).alias("exact"), F.when(varies, F.corr("_a", "_b")).alias("rho"))


def preflight(first: DataFrame, second: DataFrame, reference: DataFrame, expected: DataFrame, models: DataFrame, least: float = 0.95, repeat: float = 0.999, parity: float = 0.99) -> DataFrame:
    """models with coverage, covered, repeat_rho, parity_rho, provenance, eligible and failed, the gates missed joined by ;.

    first, second: runs of the same panel; reference(model_id, target_id, variant_id, score). models(model_id, family, licence,
    parity_required, checkpoint, checkpoint_sha256, container_sha256): a declared checkpoint needs its digest, and all models
    a container's. Correlations that cannot be formed fail, but for a parity that is not required."""
    every = _together({"a": first, "b": second, "parity": reference}, expected)
    share = F.col("_a") / F.greatest("expected", F.lit(1))
    per = _covered(every, models, ("a",)).groupBy("model_id").agg(F.try_divide(F.sum("_a"), F.sum("expected")).alias("coverage"), F.count_if((share >= least) & (F.col("expected") > 0)).alias("covered"))
    again = _agreement(every, "a", "b", ["model_id"]).select("model_id", F.col("rho").alias("repeat_rho"))
    same = _agreement(every, "a", "parity", ["model_id"]).select("model_id", F.col("rho").alias("parity_rho"))
    rows = models.join(per, "model_id", "left").join(again, "model_id", "left").join(same, "model_id", "left")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    gates = {
        "licence": F.col("licence") == "permitted", "coverage": F.round("coverage", 12) >= least, "repeat": F.round("repeat_rho", 12) >= repeat,
        "parity": ~F.col("parity_required") | F.coalesce(F.round("parity_rho", 12) >= parity, F.lit(False)), "provenance": filled("container_sha256") & (~filled("checkpoint") | filled("checkpoint_sha256")),
    }
    missed = F.concat_ws(";", *(F.when(~F.coalesce(g, F.lit(False)), n) for n, g in gates.items()))
    made = rows.withColumn("failed", missed).withColumn("eligible", F.col("failed") == "")
    return made.select("model_id", "family", "coverage", F.coalesce("covered", F.lit(0)).alias("covered"), "repeat_rho", "parity_rho", "failed", "eligible")


#: The runs of a qualification.
RUNS = ("a", "b", "parity")


def qualification(runs: DataFrame, receipts: DataFrame, reference: DataFrame, expected: DataFrame, models: DataFrame, least: float = 0.95, repeat: float = 0.999, parity: float = 0.99, variants: int = 20, targets: int = 1) -> tuple[DataFrame, DataFrame]:
    """(models with the gates missed, joined by ;, and qualified; coverage of runs a and b, the lesser of both).

    runs(run, model_id, target_id, variant_id, status, score), run a, b or parity. receipts(run, model_id, checkpoint, container,
    specification, source, runner, elapsed), one a run. models(model_id, family, checkpoint, container, specification): what
    receipts must show. Parity: each target has `variants` shared variants and a rank correlation of `parity`, on `targets` targets at least."""
    of = lambda r: runs.filter(F.col("run") == r)
    every = _together({**{r: of(r) for r in RUNS}, "reference": reference}, expected)
    both = stored(_covered(every, models, ("a", "b"))).withColumn("coverage", F.least("_a", "_b") / F.greatest("expected", F.lit(1)))
    per = both.groupBy("model_id").agg(F.try_divide(F.sum("_a"), F.sum("expected")).alias("coverage_a"), F.try_divide(F.sum("_b"), F.sum("expected")).alias("coverage_b"))
    again = _agreement(every, "a", "b", ["model_id"]).select("model_id", F.col("n").alias("repeat_rows"), F.col("exact").alias("exact_rows"), F.col("rho").alias("repeat_rho"))
    rho = F.round("rho", 12)
    met = _agreement(every, "parity", "reference", ["model_id", "target_id"]).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("parity_targets"), F.bool_and((F.col("n") >= variants) & F.coalesce(rho >= parity, F.lit(False))).alias("_parity"), F.min("rho").alias("parity_rho"),
    )
    shown = [F.count_distinct(c).alias(f"_d_{c}") for c in ("checkpoint", "container", "specification", "source", "runner")]
    given = receipts.filter(F.col("run").isin(*RUNS)).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("_receipts"), F.count_distinct("run").alias("_runs"), *shown, F.bool_and(F.coalesce(F.col("elapsed") > 0, F.lit(False))).alias("_timed"),
        *(F.count(c).alias(f"_n_{c}") for c in ("checkpoint", "container", "specification", "source", "runner")), *(F.max(c).alias(f"_v_{c}") for c in ("checkpoint", "container", "specification")),
    )
    rows = models.join(per, "model_id", "left").join(again, "model_id", "left").join(met, "model_id", "left").join(given, "model_id", "left")
    uniform = lambda c: (F.col(f"_d_{c}") == 1) & (F.col(f"_n_{c}") == len(RUNS))
    gates = {
        "receipts": (F.col("_receipts") == len(RUNS)) & (F.col("_runs") == len(RUNS)), "coverage": F.round(F.least("coverage_a", "coverage_b"), 12) >= least, "repeat": F.round("repeat_rho", 12) >= repeat,
        "parity": F.col("_parity") & (F.col("parity_targets") >= targets), **{c: uniform(c) & (F.col(f"_v_{c}") == F.col(c)) for c in ("checkpoint", "container", "specification")}, "code": uniform("source") & uniform("runner"), "time": F.col("_timed"),
    }
    missed = F.concat_ws(";", *(F.when(~F.coalesce(g, F.lit(False)), n) for n, g in gates.items()))
    made = rows.withColumn("failed", missed).withColumn("qualified", F.col("failed") == "")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return made.select("model_id", "family", "coverage_a", "coverage_b", zero("repeat_rows"), zero("exact_rows"), "repeat_rho", zero("parity_targets"), "parity_rho", "failed", "qualified"), both.select("model_id", "target_id", "expected", "coverage")


def final_panel(audits: list[DataFrame], specifications: DataFrame) -> DataFrame:
    """(model_id, family, audits, candidates, status) of the models that any of audits(model_id, qualified, checkpoint, container) names.

    candidates: specifications(model_id, family, checkpoint, container) of its own digests. status: `unqualified`, `repeated`
    (audited more than once), `missing` (no specification of its name), `ambiguous` (not one candidate), else `selected`."""
    rows = audits[0]
    for more in audits[1:]:
        rows = rows.unionByName(more)
    told = rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("audits"), F.bool_and(F.coalesce("qualified", F.lit(False))).alias("_q"), F.max("checkpoint").alias("_c"), F.max("container").alias("_i"))
    named = specifications.select("model_id", "family", F.col("checkpoint").alias("_sc"), F.col("container").alias("_si"))
    fits = (F.col("_sc") == F.col("_c")) & (F.col("_si") == F.col("_i"))
    made = told.join(named, "model_id", "left").groupBy("model_id", "audits", "_q").agg(F.count_if(fits).alias("candidates"), F.count("_sc").alias("_named"), F.max(F.when(fits, F.col("family"))).alias("_family"))
    status = F.when(~F.col("_q"), "unqualified").when(F.col("audits") > 1, "repeated").when(F.col("_named") == 0, "missing").when(F.col("candidates") != 1, "ambiguous").otherwise("selected")
    return made.withColumn("status", status).select("model_id", F.when(F.col("status") == "selected", F.col("_family")).alias("family"), "audits", "candidates", "status")


def in_every(receipts: DataFrame, receipt: str = "receipt", item: str = "target_id") -> DataFrame:
    """(item) that stands in every receipt, a row a receipt and item; null items stand nowhere."""
    total = receipts.agg(F.count_distinct(receipt).alias("_all"))
    return receipts.filter(F.col(item).isNotNull()).groupBy(item).agg(F.count_distinct(receipt).alias("_n")).join(F.broadcast(total), F.col("_n") == F.col("_all")).select(item)


def selected_predictions(coverage: DataFrame, executions: DataFrame, least: float = 0.95) -> DataFrame:
    """(panel_id, target_id, models, models_usable, shared, min_coverage) from target_coverage by panel.

    executions(panel_id, model_id): one a panel and model; a second one raises when it is met."""
    once = executions.groupBy("panel_id", "model_id").agg(F.count(F.lit(1)).alias("_n"))
    once = once.select("panel_id", F.when(F.col("_n") == 1, F.col("model_id")).otherwise(F.raise_error(F.lit("a model was executed twice on a panel"))).alias("model_id"))
    rows = coverage.filter("expected > 0").join(F.broadcast(once), ["panel_id", "model_id"])
    usable = F.count_if(F.col("coverage") >= least)
    return rows.groupBy("panel_id", "target_id").agg(F.count(F.lit(1)).alias("models"), usable.alias("models_usable"), (usable == F.count(F.lit(1))).alias("shared"), F.min("coverage").alias("min_coverage"))


def overlap(targets: DataFrame, known: DataFrame, links: DataFrame, structures: tuple[DataFrame, DataFrame], clans: tuple[DataFrame, DataFrame]) -> DataFrame:
    """targets(target_id, sequence_sha256) against a development set, with sequence_unseen, family_unseen, and the three states of
    structure and clan: (kind)_status and (kind)_overlap.

    known(sequence_sha256); links(target_id, qualifies): alignments to known sequences; structures and clans: (of targets
    (target_id, annotation), known (annotation)). A target without annotations is undocumented, never clean."""
    seen = joins.flag(targets.select("target_id", "sequence_sha256"), known, ["sequence_sha256"], "_seen")
    linked = joins.flag(seen, links.filter(F.coalesce("qualifies", F.lit(False))), ["target_id"], "_linked")
    rows = linked.select("target_id", (~F.col("_seen")).alias("sequence_unseen"), (~F.col("_linked")).alias("family_unseen"))
    for kind, (own, other) in (("structure", structures), ("clan", clans)):
        state = joins.three_state(own, other, "target_id", "annotation").select("target_id", F.col("status").alias(f"{kind}_status"), F.col("overlap").alias(f"{kind}_overlap"))
        rows = rows.join(state, "target_id", "left").withColumn(f"{kind}_status", F.coalesce(f"{kind}_status", F.lit("undocumented")))
    return rows


# what a study must show

def _gate(df: DataFrame, name: str, value: Column, passed: Column) -> DataFrame:
    """One row; what cannot be told does not pass."""
    return df.agg(value.cast("double").alias("value"), passed.alias("_p")).select(F.lit(name).alias("gate"), "value", F.coalesce("_p", F.lit(False)).alias("passed"))


def _all(parts: list[DataFrame]) -> DataFrame:
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made


def transport_gates(halves: DataFrame, differences: DataFrame, panels: DataFrame, bounds: DataFrame, comparator: str, required: list[str], candidate: str = "chosen", ablations: tuple[str, ...] = ("ablation:msa_only", "ablation:ensemble_only"), conclusion: dict | None = None) -> DataFrame:
    """(gate, value, passed), six rows.

    halves(policy, regret, gain, failure) at half of the tasks; differences(comparator, point, lower, p) of the regret's area, p
    adjusted here by Holm's rule; panels(panel, improvement); bounds(observed, lower) of the rows the candidate takes.
    Gates: the lower limit against the comparator above 0 and its adjusted p below 0.05; less regret, no less gain and no
    more failures at a half; lower bounds that hold for 85 to 95 %; improvement in every required panel; improvement on
    every ablation; a conclusion with statement, change and evidence. A table that lacks what a gate needs fails it."""
    of = lambda p, c: F.max(F.when(F.col("policy") == p, F.col(c)))
    once = (F.count_if(F.col("policy") == candidate) == 1) & (F.count_if(F.col("policy") == comparator) == 1)
    better = (of(candidate, "regret") < of(comparator, "regret")) & (of(candidate, "gain") >= of(comparator, "gain")) & (of(candidate, "failure") <= of(comparator, "failure"))
    told = summaries.holm(differences.withColumn("_g", F.lit(0)), ["_g"], "comparator", "p")
    first = told.filter(F.col("comparator") == comparator)
    held = F.avg((F.col("observed") >= F.col("lower")).cast("double"))
    needed = F.col("panel").isin(*required)
    ablated = told.filter(F.col("comparator").isin(*ablations))
    spoken = bool(conclusion and str(conclusion.get("statement", "")).strip() and str(conclusion.get("change", "")).strip() and conclusion.get("evidence"))
    return _all([
        _gate(first, "regret_area", F.max("point"), (F.count(F.lit(1)) == 1) & (F.max("lower") > 0) & (F.max("adjusted") < 0.05)),
        _gate(halves, "utility_at_half", of(candidate, "regret"), once & better),
        _gate(bounds, "coverage", held, held.between(0.85, 0.95)),
        _gate(panels.filter(needed), "panel_direction", F.when(F.count_distinct("panel") == len(set(required)), F.min("improvement")), (F.count_distinct("panel") == len(set(required))) & (F.min("improvement") > 0)),
        _gate(ablated, "ablations", F.when(F.count_distinct("comparator") == len(ablations), F.min("point")), (F.count_distinct("comparator") == len(ablations)) & (F.min("point") > 0)),
        _gate(panels, "conclusion", F.max(F.lit(None).cast("double")), (F.count(F.lit(1)) >= 0) & F.lit(spoken)),
    ])


def conservative_gates(point: DataFrame, limit: DataFrame, panels: DataFrame, panel_limit: DataFrame) -> DataFrame:
    """(gate, value, lower, adjusted, passed), four rows and one for each panel's direction.

    point(name, value) and limit(name, lower, p) over all tasks, names as in `nested.IMPROVEMENTS`; panels(panel, regret_auc) and
    panel_limit(panel, p). Holm's rule runs over the secondary questions: failures, gain at a half, and each panel's direction.
    Gates: the regret area's lower limit above 0; the failures' not below 0; no gain lost at a half; regret better in every panel."""
    asked = limit.filter(F.col("name").isin("risk_auc", "utility_half")).select("name", "p").unionByName(panel_limit.select(F.concat(F.lit("panel:"), F.col("panel").cast("string")).alias("name"), "p"))
    adjusted = summaries.holm(asked.withColumn("_g", F.lit(0)), ["_g"], "name", "p").select("name", "adjusted")
    main = point.join(limit, "name").join(adjusted, "name", "left").filter(F.col("name").isin("regret_auc", "risk_auc", "utility_half"))
    gate = F.when(F.col("name") == "regret_auc", "regret_area").when(F.col("name") == "risk_auc", "failures").otherwise("gain_at_half")
    passed = F.when(F.col("name") == "regret_auc", F.col("lower") > 0).when(F.col("name") == "risk_auc", F.col("lower") >= 0).otherwise(F.col("value") >= 0)
    parts = [main.select(gate.alias("gate"), "value", "lower", F.when(F.col("name") != "regret_auc", F.col("adjusted")).alias("adjusted"), F.coalesce(passed, F.lit(False)).alias("passed"))]
    named = panels.withColumn("name", F.concat(F.lit("panel:"), F.col("panel").cast("string")))
    nothing = F.lit(None).cast("double")
    parts.append(named.join(adjusted, "name", "left").select(F.col("name").alias("gate"), F.col("regret_auc").alias("value"), nothing.alias("lower"), "adjusted", F.coalesce(F.col("regret_auc") > 0, F.lit(False)).alias("passed")))
    parts.append(_gate(panels, "panel_direction", F.min("regret_auc"), F.bool_and(F.col("regret_auc") > 0)).select("gate", "value", nothing.alias("lower"), nothing.alias("adjusted"), "passed"))
    return _all(parts)
