"""Cohorts, panels, gates and ranks on small frames with faults, held against plain Python where a rule is not plain to see."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from driftlens.operators import cohorts, gates, ranks

NAN = float("nan")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def plain_ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def test_average_ranks_and_correlation(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), i, float(r.randrange(6)), float(r.randrange(40))) for i in range(300)] + [("c", 900, 1.0, 2.0), ("c", 901, 1.0, 3.0), ("d", 902, 5.0, None), ("d", 903, NAN, 1.0)]
    frame = spark.createDataFrame(rows, "g string, i int, x double, y double")
    made = {x["i"]: x["rank"] for x in ranks.average_ranks(frame, ["g"], {"rank": "y"}).collect()}
    assert len(made) == len(rows) and made[902] is None
    told = {x["g"]: (x["n"], x["rho"]) for x in ranks.correlation(frame, ["g"], "x", "y").collect()}
    assert set(told) == {"a", "b", None, "c"} and told["c"] == (2, None)
    for g in ("a", "b", None):
        own = [x for x in rows if x[0] == g]
        y = plain_ranks([x[3] for x in own])
        assert [made[x[1]] for x in own] == y
        assert math.isclose(told[g][1], statistics.correlation(plain_ranks([x[2] for x in own]), y), rel_tol=1e-9)
    assert ranks.correlation(frame.limit(0), ["g"], "x", "y").collect() == []
    assert ranks.correlation(frame.filter("g = 'a'"), [], "x", "y").first()["n"] == sum(x[0] == "a" for x in rows)


def test_auc(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.4), ("a", 1, 0.4), ("a", 0, 0.7), ("a", 0, 0.1), ("a", 1, None), ("a", None, 0.5), ("b", 1, 0.2)]
    got = {x["g"]: x for x in ranks.auc(spark.createDataFrame(rows, "g string, y int, s double"), ["g"], "y", "s").collect()}
    # pairs of a positive and a negative: 3 + 1.5 of 6
    assert got["a"]["auc"] == 4.5 / 6 and math.isclose(got["a"]["balanced_accuracy"], (1 / 2 + 2 / 3) / 2) and got["a"]["majority_rate"] == 0.6
    assert got["b"]["auc"] is None and got["b"]["balanced_accuracy"] is None and got["b"]["n"] == 1


def scored(spark, rows):
    return spark.createDataFrame(rows, "urn string, code string, score string, sequence string, orientation int, variant string")


def test_canonical_scores_take_their_direction_from_controls(spark):
    rows = [("u", "p.Ala1Cys", "1.0", "acd", None, "x"), ("u", "p.Ala1Cys", "2.0", "acd", None, "x"), ("u", "p.Cys2Asp", "4", "acd", None, "x"), ("u", "p.Ala2Asp", "4", "acd", None, "x"), ("u", "p.Asp9Ala", "4", "acd", None, "x"), ("u", None, "4", "acd", None, "x"), ("u", "p.Ala1Gly", "nan", "acd", None, "x"), ("u", "p.Ala1Gly", "text", "acd", None, "x")]
    rows += [("u", "p.Ala1=", "1", "acd", None, "x"), ("u", "p.Ala1Ter", "5", "acd", None, "x")] * 2
    rows += [("v", "p.Ala1Cys", "3", "ACD", -1, "x"), ("w", "p.Ala1Cys", "3", "ACD", None, "x"), ("z", "p.Ala1Cys", None, "ACD", 1, "x"), ("y", "p.Ala1Cys", "1", None, 7, "x"), ("s", "p.Ala1=", "2", "ACD", None, "x"), ("s", "p.Ala1Ter", "2", "ACD", None, "x")]
    variants, audit = cohorts.canonical(scored(spark, rows), ["urn"], "code", "score", "sequence", "orientation", controls=1)
    assert rows_of(variants, "urn", "variant", "raw_score", "source_rows", "score") == [("u", "A1C", 1.5, 2, -1.5), ("u", "C2D", 4.0, 1, -4.0), ("v", "A1C", 3.0, 1, -3.0), ("w", "A1C", 3.0, 1, None)]
    got = {x["urn"]: x for x in audit.collect()}
    assert (got["u"]["input_rows"], got["u"]["parsed_rows"], got["u"]["invalid_codes"], got["u"]["reference_mismatches"], got["u"]["repeated_rows"]) == (12, 7, 1, 2, 2)
    # equal medians, a statement that is no direction, and a table without any usable row
    assert got["s"]["direction"] is None and got["y"]["direction"] is None and got["z"]["variants"] == 0 and got["z"]["direction"] == 1
    kept, judged = cohorts.cohort(variants, audit, ["urn"], least=1, positions=1, scores=1)
    told = dict(rows_of(judged, "urn", "reasons"))
    assert told == {"u": "", "v": "", "w": "no_direction", "z": "too_few_variants;too_few_positions;too_few_scores", "y": "too_few_variants;too_few_positions;too_few_scores;no_direction", "s": "too_few_variants;too_few_positions;too_few_scores;no_direction"}
    assert {x["urn"] for x in kept.collect()} == {"u", "v"}
    nothing, none = cohorts.canonical(scored(spark, rows).limit(0), ["urn"], "code", "score", "sequence", "orientation")
    assert nothing.collect() == [] and none.collect() == []


def test_target_rules(spark):
    paths = spark.createDataFrame([("d/act/1ABC_A_x.csv",), ("d/act/1ABC_A_y.tar.csv",), ("d/bind/2DEF_B.csv",), ("d/bind/3GHI_B.csv",), ("d/bind/4JKL_B.csv",), ("plain.csv",)], "path string")
    sequences = spark.createDataFrame([("chain:1ABC:A", "resolved", "ACD"), ("chain:2DEF:B", "not_found", None), ("chain:3GHI:B", "resolved", None), ("chain:4JKL:B", "resolved", "KKK")], "source_id string, status string, sequence string")
    dois = [("1ABC_A_x", "https://doi.org/10.1/A"), ("1ABC_A_y.tar", "10.1/b"), ("2DEF_B", "10.1/seen"), ("4JKL_B", "10.1/c"), ("plain", "")]
    publications = spark.createDataFrame(dois, "dataset_id string, doi string")
    known = spark.createDataFrame([("KKK", "DOI:10.1/SEEN"), (None, None)], "sequence string, doi string")
    judged, targets = cohorts.target_rules(paths, sequences, publications, known, known)
    assert dict(rows_of(judged, "dataset_id", "exclusion_reasons")) == {"1ABC_A_x": "", "1ABC_A_y.tar": "", "2DEF_B": "not_found;known_publication", "3GHI_B": "unresolved_sequence;missing_publication", "4JKL_B": "known_sequence", "plain": "unparsed_target;missing_publication"}
    assert rows_of(targets, "source_id", "sequence_length", "source_assays", "dois") == [("chain:1ABC:A", 3, "1ABC_A_x;1ABC_A_y.tar", "10.1/a;10.1/b")]
    with pytest.raises(Exception, match="looked up twice"):
        cohorts.target_rules(paths, sequences, publications.union(publications.limit(1)), known, known)[0].collect()


SCORES = "model_id string, target_id string, variant_id string, status string, score double"


def panel(spark):
    rows = [("m", "t", "a", "ok", 1.0), ("m", "t", "b", "ok", 2.0), ("m", "t", "b", "failed", None), ("m", "s", "a", "ok", NAN), ("n", "t", "a", "ok", 1.0), ("n", "t", "x", "ok", 1.0), ("n", "q", "a", None, 1.0), ("other", "t", "a", "ok", 1.0)]
    expected = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "b"), ("s", "a")], "target_id string, variant_id string")
    models = spark.createDataFrame([("m", "f", "1", "1"), ("n", "f", "1", None), ("gone", "g", None, None)], "model_id string, family string, executed string, current string")
    return spark.createDataFrame(rows, SCORES), expected, models


def test_execution_counts_what_is_missing_and_what_is_not_expected(spark):
    predictions, expected, models = panel(spark)
    coverage = gates.target_coverage(predictions, expected, models)
    assert rows_of(coverage, "model_id", "target_id", "expected", "scored", "unexpected") == [("gone", "s", 1, 0, 0), ("gone", "t", 2, 0, 0), ("m", "s", 1, 0, 0), ("m", "t", 2, 2, 0), ("n", "q", 0, 0, 1), ("n", "s", 1, 0, 0), ("n", "t", 2, 1, 1)]
    audit = gates.execution(coverage, models, 0.5, 1)
    assert rows_of(audit, "model_id", "covered", "status", "digest_matches") == [("gone", 0, "incomplete", False), ("m", 1, "complete", True), ("n", 1, "refused", False)]
    assert rows_of(gates.shared_targets(coverage, models.filter("family = 'f'"), 0.5), "target_id") == [("t",)]
    # a chosen model without any target leaves nothing shared, and so does a choice of none
    assert gates.shared_targets(coverage, models, 0.5).collect() == [] and gates.shared_targets(coverage, models.limit(0), 0.5).collect() == []
    found = gates.panel_gates(models.filter("family = 'f'"), gates.shared_targets(coverage, models.filter("family = 'f'"), 0.5), 2, 2, 1)
    assert rows_of(found, "gate", "value", "passed") == [("families", 1, False), ("models", 2, True), ("shared_targets", 1, True)]
    assert gates.target_coverage(predictions.limit(0), expected.limit(0), models).collect() == []


def test_preflight_names_every_gate_missed(spark):
    first = spark.createDataFrame([(m, "t", v, "ok", s) for m in "abc" for v, s in (("x", 1.0), ("y", 2.0), ("z", 3.0))] + [("d", "t", "x", "ok", 1.0)], SCORES)
    second = first.withColumn("score", F.when(F.col("model_id") == "b", -F.col("score")).otherwise(F.col("score")))
    expected = first.select("target_id", "variant_id").distinct()
    models = spark.createDataFrame([("a", "f", "permitted", True, "w", "1", "i"), ("b", "f", "permitted", True, "w", None, "i"), ("c", "g", None, False, None, None, ""), ("d", "g", "permitted", False, None, None, "i")], "model_id string, family string, licence string, parity_required boolean, checkpoint string, checkpoint_sha256 string, container_sha256 string")
    reference = first.filter("model_id = 'a'").select("model_id", "target_id", "variant_id", "score")
    made = gates.preflight(first, second, reference, expected, models)
    assert rows_of(made, "model_id", "failed", "eligible") == [("a", "", True), ("b", "repeat;parity;provenance", False), ("c", "licence;provenance", False), ("d", "coverage;repeat", False)]


def test_qualification_wants_three_equal_receipts(spark):
    one = [(m, "t", v, "ok", s) for m in "abc" for v, s in (("x", 1.0), ("y", 2.0), ("z", 3.0))]
    runs = spark.createDataFrame([(r, *x) for r in ("a", "b", "parity") for x in one if (r, x[0]) != ("b", "c")], "run string, " + SCORES)
    receipts = [(r, m, "k" + m, "i", "s", "tree", "runner" if (r, m) != ("b", "b") else "r2", 1.0 if (r, m) != ("a", "b") else None) for r in ("a", "b", "parity") for m in "abc" if (r, m) != ("b", "c")]
    held = spark.createDataFrame(receipts, "run string, model_id string, checkpoint string, container string, specification string, source string, runner string, elapsed double")
    models = spark.createDataFrame([("a", "f", "ka", "i", "s"), ("b", "f", "kb", "i", "old"), ("c", "g", "kc", "i", "s")], "model_id string, family string, checkpoint string, container string, specification string")
    reference = spark.createDataFrame([x[:3] + (x[4] * 2,) for x in one], "model_id string, target_id string, variant_id string, score double")
    expected = runs.select("target_id", "variant_id").distinct()
    made, coverage = gates.qualification(runs, held, reference, expected, models, variants=3)
    assert rows_of(made, "model_id", "failed", "qualified") == [("a", "", True), ("b", "specification;code;time", False), ("c", "receipts;coverage;repeat;checkpoint;container;specification;code", False)]
    assert rows_of(coverage, "model_id", "coverage") == [("a", 1.0), ("b", 1.0), ("c", 0.0)]
    assert gates.qualification(runs, held, reference, expected, models, variants=4)[0].filter("qualified").collect() == []


def test_final_panel_and_selection(spark):
    audit = lambda rows: spark.createDataFrame(rows, "model_id string, qualified boolean, checkpoint string, container string")
    told = spark.createDataFrame([("a", "f", "1", "i"), ("a", "f", "2", "i"), ("b", "g", "1", "i"), ("b", "g", "1", "i"), ("d", "h", "1", "i")], "model_id string, family string, checkpoint string, container string")
    made = gates.final_panel([audit([("a", True, "1", "i"), ("b", True, "1", "i"), ("c", True, "1", "i")]), audit([("d", True, "1", "i"), ("d", True, "1", "i"), ("e", None, "1", "i")])], told)
    assert rows_of(made, "model_id", "family", "candidates", "status") == [("a", "f", 1, "selected"), ("b", None, 2, "ambiguous"), ("c", None, 0, "missing"), ("d", None, 1, "repeated"), ("e", None, 0, "unqualified")]
    receipts = spark.createDataFrame([(1, "t"), (1, "t"), (2, "t"), (1, "s"), (2, None)], "receipt int, target_id string")
    assert rows_of(gates.in_every(receipts), "target_id") == [("t",)]

    predictions, expected, _ = panel(spark)
    ran = spark.createDataFrame([("p", "m"), ("p", "n")], "panel_id string, model_id string")
    put = lambda df: df.withColumn("panel_id", F.lit("p"))
    coverage = gates.target_coverage(put(predictions), put(expected), ran, ["panel_id"])
    assert rows_of(gates.selected_predictions(coverage, ran, 0.5), "target_id", "models", "models_usable", "shared", "min_coverage") == [("s", 2, 0, False, 0.0), ("t", 2, 2, True, 0.5)]
    with pytest.raises(Exception, match="executed twice"):
        gates.selected_predictions(coverage, ran.union(ran)).collect()


def test_overlap_never_takes_missing_for_clean(spark):
    targets = spark.createDataFrame([("a", "1", "z"), ("b", "2", "z"), ("c", None, "z")], "target_id string, sequence_sha256 string, annotation string")
    notes = lambda rows: spark.createDataFrame(rows, "target_id string, annotation string")
    known = spark.createDataFrame([("1", "s1"), (None, None)], "sequence_sha256 string, annotation string")
    links = spark.createDataFrame([("b", True), ("b", False), ("c", None)], "target_id string, qualifies boolean")
    made = gates.overlap(targets, known, links, (notes([("a", "s1"), ("b", "s2")]), known.select("annotation")), (notes([("a", None)]), known.select("annotation")))
    assert rows_of(made, "target_id", "sequence_unseen", "family_unseen", "structure_status", "structure_overlap", "clan_status", "clan_overlap") == [
        ("a", False, True, "audited", True, "undocumented", None), ("b", True, False, "audited", False, "undocumented", None), ("c", True, True, "undocumented", None, "undocumented", None),
    ]


def test_gates_fail_on_what_they_cannot_tell(spark):
    halves = spark.createDataFrame([("chosen", 0.1, 0.5, 0.0), ("base", 0.2, 0.5, 0.1)], "policy string, regret double, gain double, failure double")
    gaps = spark.createDataFrame([("base", 0.1, 0.02, 0.01), ("x", 0.2, 0.1, 0.02), ("y", 0.1, 0.1, 0.04)], "comparator string, point double, lower double, p double")
    panels = spark.createDataFrame([("p", 0.1), ("q", 0.2), ("r", -1.0)], "panel string, improvement double")
    bounds = spark.createDataFrame([(1.0, 0.5)] * 9 + [(1.0, 2.0)], "observed double, lower double")
    told = {"statement": "s", "change": "c", "evidence": ["e"]}
    run = lambda **k: dict(rows_of(gates.transport_gates(**{"halves": halves, "differences": gaps, "panels": panels, "bounds": bounds, "comparator": "base", "required": ["p", "q"], "ablations": ("x", "y"), "conclusion": told} | k), "gate", "passed"))
    assert set(run().values()) == {True} and len(run()) == 6
    assert not run(required=["p", "q", "r"])["panel_direction"] and not run(required=["p", "none"])["panel_direction"] and not run(ablations=("x", "z"))["ablations"]
    assert not run(conclusion={"statement": " ", "change": "c", "evidence": ["e"]})["conclusion"] and not run(conclusion=None)["conclusion"]
    # Holm's rule takes 0.02 times 3
    assert not run(comparator="x", differences=gaps.replace(0.01, 0.5, ["p"]).replace(0.04, 0.5, ["p"]))["regret_area"]
    assert set(run(halves=halves.limit(0), differences=gaps.limit(0), panels=panels.limit(0), bounds=bounds.limit(0), conclusion=None).values()) == {False}

    point = spark.createDataFrame([("regret_auc", 0.1), ("risk_auc", 0.0), ("utility_half", -0.1)], "name string, value double")
    limit = spark.createDataFrame([("regret_auc", 0.01, 0.01), ("risk_auc", 0.0, 0.02), ("utility_half", -0.2, 0.5)], "name string, lower double, p double")
    each = spark.createDataFrame([("p", 0.1, 0.01), ("q", 0.0, 0.4)], "panel string, regret_auc double, p double")
    made = gates.conservative_gates(point, limit, each.select("panel", "regret_auc"), each.select("panel", "p"))
    assert dict(rows_of(made, "gate", "passed")) == {"regret_area": True, "failures": True, "gain_at_half": False, "panel:p": True, "panel:q": False, "panel_direction": False}
    adjusted = dict(rows_of(made, "gate", "adjusted"))
    assert adjusted["panel:p"] == 0.04 and math.isclose(adjusted["failures"], 0.06) and math.isclose(adjusted["panel:q"], 0.8) and adjusted["gain_at_half"] == adjusted["panel:q"] and adjusted["regret_area"] is None
