"""Panels of runs, scores and targets: pairing, audits with reasons, roll-ups with intervals, pooled ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators.metrics import finite, regression, top_selection
from driftlens.operators.storage import stored
from driftlens.operators.summaries import replicates


def pivot_gaps(runs: DataFrame, by: list[str], split: str, metrics: list[str], first: str, second: str, name: str = "{}_gap") -> DataFrame:
    """Metrics of two splits side by side with their differences; a missing split gives nulls."""
    value = lambda m, s: F.max(F.when(F.col(split) == s, F.col(m)))
    columns = [c for m in metrics for c in (value(m, first).alias(f"{first}_{m}"), value(m, second).alias(f"{second}_{m}"), (value(m, first) - value(m, second)).alias(name.format(m)))]
    return runs.groupBy(*by).agg(*columns)


def over_repeats(df: DataFrame, by: list[str], repeat: str, values: list[str]) -> DataFrame:
    """Means over repeats, and how many different ones there are."""
    return df.groupBy(*by).agg(F.count_distinct(repeat).alias("repeats"), *(F.avg(v).alias(v) for v in values))


def protein_summary(runs: DataFrame, by: list[str], protein: str, assay: str, values: list[str], repeats: int = 200) -> DataFrame:
    """Assays, proteins, and for each value the mean in which proteins weigh the same, with 95 % limits over
    proteins drawn anew (null for fewer than two)."""
    assays = runs.groupBy(*by, protein, assay).agg(*(F.avg(v).alias(v) for v in values))
    # written: a row a protein, which means, draws and their values read
    proteins = stored(assays.groupBy(*by, protein).agg(F.count_distinct(assay).alias("_assays"), *(F.avg(v).alias(v) for v in values)))
    points = proteins.groupBy(*by).agg(F.sum("_assays").alias("n_assays"), F.count(F.lit(1)).alias("n_proteins"), *(F.avg(v).alias(f"mean_{v}") for v in values))
    edge = lambda v, q: F.when(F.max("_n") > 1, F.percentile(v, F.lit(q)))
    limits = replicates(proteins, by, protein, values, repeats).groupBy(*by).agg(*(e for v in values for e in (edge(v, 0.025).alias(f"{v}_ci_low"), edge(v, 0.975).alias(f"{v}_ci_high"))))
    return points.join(limits, by)


def transfer_summary(df: DataFrame, by: list[str], source: str, target: str, transfer: str, gap: str) -> DataFrame:
    """Scores within a condition against scores carried over to others."""
    same = F.col(source) == F.col(target)
    on, off, gaps = F.when(same, F.col(transfer)), F.when(~same, F.col(transfer)), F.when(~same, F.col(gap))
    return df.groupBy(*by).agg(F.count_distinct(source).alias("conditions"), F.avg(on).alias("diagonal_mean"), F.avg(off).alias("off_diagonal_mean"), F.min(off).alias("off_diagonal_min"), F.max(off).alias("off_diagonal_max"), F.avg(gaps).alias("gap_mean"), F.max(gaps).alias("gap_max"))


def against_baseline(wide: DataFrame, by: list[str], unit: str, models: list[str], baseline: str, repeats: int = 200) -> DataFrame:
    """(by, model, delta, lower, upper, radius, mean_rank, best_share) of models against a baseline.

    wide: a row a unit, a column a model. All models share the draws of units; radius is the 95th percentile
    of a draw's largest distance between drawn and observed difference. Groups of one unit give nulls."""
    # a unit without one of the values takes no part
    rows = wide.dropna(subset=models)
    points = rows.groupBy(*by).agg(*(F.avg(m).alias(m) for m in models)).unpivot([*by, baseline], [m for m in models if m != baseline], "model", "value")
    points = points.select(*by, "model", (F.col("value") - F.col(baseline)).alias("delta"))
    drawn = replicates(rows, by, unit, models, repeats).withColumn("_base", F.col(baseline)).unpivot([*by, "_rep", "_n", "_base"], models, "model", "value")
    place = Window.partitionBy(*by, "_rep").orderBy(F.desc("value"), "model")
    drawn = drawn.withColumn("_place", F.row_number().over(place)).filter(F.col("model") != baseline).join(points, [*by, "model"])
    drawn = drawn.withColumn("_delta", F.col("value") - F.col("_base"))
    drawn = drawn.withColumn("_far", F.max(F.abs(F.col("_delta") - F.col("delta"))).over(Window.partitionBy(*by, "_rep")))
    edge = lambda c, q: F.when(F.max("_n") > 1, F.percentile(c, F.lit(q)))
    return drawn.groupBy(*by, "model").agg(F.max("delta").alias("delta"), edge("_delta", 0.025).alias("lower"), edge("_delta", 0.975).alias("upper"), edge("_far", 0.95).alias("radius"), F.avg("_place").alias("mean_rank"), F.avg((F.col("_place") == 1).cast("double")).alias("best_share"))


def selection(df: DataFrame, by: list[str], item: str) -> DataFrame:
    """spearman, gain_sd and top_recall at a tenth."""
    return regression(df, by).select(*by, "n", "spearman").join(top_selection(df, by, item).select(*by, "gain_sd", "top_recall"), by)


# pairing

def pairing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: left_rows, right_rows, paired and repeated keys, and whether all pair one to one."""
    both = left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    keys = both.groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    made = keys.agg(zero(F.sum("_l")).alias("left_rows"), zero(F.sum("_r")).alias("right_rows"), F.count_if((F.col("_l") > 0) & (F.col("_r") > 0)).alias("paired"), F.count_if((F.col("_l") > 1) | (F.col("_r") > 1)).alias("repeated"))
    return made.withColumn("exact", (F.col("left_rows") == F.col("paired")) & (F.col("right_rows") == F.col("paired")))


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of keys that are unique on both sides; repeated keys and an empty result raise."""
    seen = pairing(left, right, on).first()
    if seen["repeated"] or not seen["paired"]:
        raise ValueError(f"{seen['repeated']} keys repeat and {seen['paired']} pair")
    return left.join(right, on)


def alignment(scores: DataFrame, outcomes: DataFrame, task: list[str], model: str, item: str, least: int = 10, share: float = 0.95) -> DataFrame:
    """(task, model, scored, aligned, reason): why a task's scores cannot be judged, empty if they can."""
    rows = scores.join(outcomes.select(*task, item, F.lit(1).alias("_met")).distinct(), [*task, item], "left")
    made = rows.groupBy(*task, model).agg(F.count(F.lit(1)).alias("scored"), F.count("_met").alias("aligned"))
    reason = F.when(F.col("aligned") < least, "too_few_aligned_variants").when(F.col("aligned") < F.col("scored") * F.lit(share), "low_aligned_share").otherwise("")
    return made.withColumn("reason", reason)


# audits

def score_audit(source: DataFrame, scored: DataFrame, by: list[str], item: str, value: str, models: list[str], least: float = 0.95, all_finite: bool = False) -> DataFrame:
    """A row a group of source: joined and repeated items, largest difference of values, the share of items
    with finite scores of all models, and the reasons (joined by ;) against its use.

    all_finite: name each model with a score that is not finite, in place of the share."""
    one = scored.groupBy(*by, item).agg(F.count(F.lit(1)).alias("_times"), F.min(value).alias("_value"), *(F.min(m).alias(f"_{m}") for m in models))
    rows = source.join(one, [*by, item], "left")
    whole = reduce(Column.__and__, (finite(f"_{m}") for m in models))
    made = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("source_items"), F.count("_times").alias("matched"), F.count_if(F.col("_times") > 1).alias("repeated"), F.max(F.abs(F.col(value) - F.col("_value"))).alias("difference"), (F.count_if(whole) / F.count(F.lit(1))).alias("common"), *(F.count_if(finite(f"_{m}")).alias(f"{m}_finite") for m in models))
    faults = [F.when(F.col("matched") == 0, "missing_scores"), F.when(F.col("repeated") > 0, "duplicate_score_variants"), F.when(F.col("matched") < F.col("source_items"), "incomplete_variant_join"), F.when(F.col("difference") > 1e-10, "score_mismatch")]
    faults += [F.when(F.col(f"{m}_finite") < F.col("source_items"), f"nonfinite_predictions:{m}") for m in models] if all_finite else [F.when(F.col("common") < least, "insufficient_common_score_coverage")]
    return made.withColumn("reasons", F.concat_ws(";", *faults)).withColumn("eligible", F.col("reasons") == "")


def published_panel(df: DataFrame, target: str, model: str, value: str, permitted: list[str], least: float = 0.95) -> DataFrame:
    """A row a model: coverage, targets with enough of it, eligibility, and the targets that all eligible models share."""
    per = df.groupBy(model, target).agg(F.count_if(finite(value)).alias("_p"), F.count(F.lit(1)).alias("_t"))
    per = per.withColumn("_ok", F.col("_p") >= F.col("_t") * F.lit(least))
    made = per.groupBy(model).agg((F.sum("_p") / F.sum("_t")).alias("coverage"), F.count_if("_ok").alias("targets"))
    made = made.withColumn("eligible", F.col(model).isin(permitted) & (F.col("coverage") >= least))
    used = made.filter("eligible").select(model)
    number = used.count()
    shared = per.filter("_ok").join(used, model, "left_semi").groupBy(target).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") == number).count()
    return made.withColumn("shared_targets", F.lit(shared if number else 0).cast("long"))


def structure_units(df: DataFrame, protein: str, file: str, start: str, stop: str) -> DataFrame:
    """A row a protein: its file and range, or `conflict` where its rows do not agree (nulls are a value too)."""
    unit = F.struct(file, start, stop)
    made = df.groupBy(protein).agg(F.count_distinct(F.to_json(unit)).alias("_n"), F.min(unit).alias("_u"), F.count(F.lit(1)).alias("rows"))
    one = lambda c: F.when(F.col("_n") == 1, F.col("_u")[c]).alias(c)
    return made.select(protein, "rows", (F.col("_n") > 1).alias("conflict"), one(file), one(start), one(stop))


def segments(df: DataFrame, sequence: str, start: str, stop: str) -> DataFrame:
    """df with the segment of one-based inclusive bounds, its sha256 and length; all null outside the sequence."""
    ok = (F.col(start) >= 1) & (F.col(stop) <= F.length(sequence)) & (F.col(start) <= F.col(stop))
    cut = F.when(ok, F.substr(F.col(sequence), F.col(start).cast("int"), (F.col(stop) - F.col(start) + 1).cast("int")))
    return df.withColumn("segment", cut).withColumn("segment_sha256", F.sha2("segment", 256)).withColumn("segment_length", F.length("segment"))


def reciprocal(edges: DataFrame, a: str, b: str, lows: list[str], highs: list[str]) -> DataFrame:
    """Directed edges as unordered pairs: how many directions, the least of `lows` and the largest of `highs`.

    An edge to itself is left out; repeated directed edges count once as a direction."""
    pair = edges.filter(F.col(a) != F.col(b)).withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b))
    return pair.groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.count_distinct(a).alias("directions"), *(F.min(c).alias(f"min_{c}") for c in lows), *(F.max(c).alias(f"max_{c}") for c in highs))


# ranks

def pooled_ranks(df: DataFrame, order: list[Column | str], groups: dict[str, list[str]]) -> DataFrame:
    """df with a rank (1 first) and the number of rows for each name: among all rows ([]) or within columns.

    No task sees a whole group: rows are dealt by ranges of the order, and a range's ranks start where those
    of earlier ranges end. The order must be total; the tables of starts have a row a range and group."""
    rows = dealt = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    for name, by in groups.items():
        own = Window.partitionBy(*by)
        sizes = dealt.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_size"))
        before = F.coalesce(F.sum("_size").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sizes.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_by_{c}") for c in by), before.alias("_start"), F.sum("_size").over(own).alias(f"{name}_rows"))
        met = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.col("_part") == F.col("_p"))
        rank = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) + F.col("_start")
        rows = rows.join(starts, met).withColumn(name, rank.cast("long")).drop("_p", "_start", *(f"_by_{c}" for c in by))
    return rows.drop("_part")


def coverage_decisions(df: DataFrame, panel: str, confidence: str, ties: list[str]) -> DataFrame:
    """Pooled and per-panel ranks by confidence; the first half, rounded up, is deployed and the rest abstains."""
    order = [F.desc(confidence), F.col(panel), *map(F.col, ties)]
    rows = pooled_ranks(df, order, {"pooled_rank": [], "panel_rank": [panel]})
    decide = lambda name: F.when(F.col(f"{name}_rank") <= F.ceil(F.col(f"{name}_rank_rows") * 0.5), "deploy").otherwise("abstain")
    return rows.withColumn("pooled_decision", decide("pooled")).withColumn("panel_decision", decide("panel")).drop("pooled_rank_rows", "panel_rank_rows")


def top_fraction(df: DataFrame, by: list[str], confidence: str, item: str, share: float) -> DataFrame:
    """The ceil(n * share) rows of each group with the highest confidence; ties by item."""
    own = Window.partitionBy(*by)
    rows = df.withColumn("_i", F.row_number().over(own.orderBy(F.desc(confidence), item))).withColumn("_n", F.count(F.lit(1)).over(own))
    return rows.filter(F.col("_i") <= F.ceil(F.col("_n") * F.lit(share))).drop("_i", "_n")


def tail_mean(df: DataFrame, by: list[str], value: str, item: str, share: float = 0.2) -> DataFrame:
    """Mean of the lowest ceil(n * share) values of each group."""
    low = df.withColumn("_low", -F.col(value))
    return top_fraction(low, by, "_low", item, share).groupBy(*by).agg(F.avg(value).alias("tail_mean"))


def order_statistic(df: DataFrame, by: list[str], value: str, place: int) -> DataFrame:
    """The place-th smallest value of each group, its largest where there are fewer; nulls are left out."""
    own = Window.partitionBy(*by)
    rows = df.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(own.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(own))
    return rows.filter(F.col("_i") == F.least(F.lit(place), F.col("_n"))).select(*by, value)


# policies

def override(df: DataFrame, task: list[str], model: str, decision: str, baseline: str, margin: float) -> DataFrame:
    """A task's top model where it beats the baseline by more than the margin, else the baseline.

    Ties by model; a task without the baseline raises."""
    own = Window.partitionBy(*task)
    base = F.max(F.when(F.col(model) == baseline, F.col(decision))).over(own)
    rows = df.withColumn("_i", F.row_number().over(own.orderBy(F.desc(decision), model))).withColumn("_base", base).withColumn("_top", F.max(decision).over(own))
    needed = F.when(F.col("_base").isNull(), F.raise_error(F.lit("a task lacks the baseline")).cast("boolean")).otherwise(F.col("_top") - F.col("_base") > margin)
    rows = rows.withColumn("overrode", needed)
    return rows.filter(F.when(F.col("overrode"), F.col("_i") == 1).otherwise(F.col(model) == baseline)).drop("_i", "_base", "_top")


#: Weights that the priority is defined by (fixed values).
PRIORITY = {"neff": 1.0, "length": 0.5, "decision": 0.25}


def priority(parts: dict[str, Column], constants: dict[str, tuple[float, float]]) -> Column:
    """Weighted sum of standardised parts; neff and length as log1p; what is missing counts as its mean."""
    total = F.lit(0.0)
    for name, weight in PRIORITY.items():
        mean, sd = constants[name]
        c = parts[name] if name == "decision" else F.when(parts[name] >= 0, F.log1p(parts[name]))
        total = total + weight * (F.coalesce(c, F.lit(mean)) - mean) / sd
    return total


def single_codes(df: DataFrame, code: str, value: str, metadata: DataFrame, on: str) -> DataFrame:
    """Rows with a finite value and one mutation (codes joined by :), with their metadata."""
    return df.filter(finite(value) & (F.size(F.split(code, ":")) == 1)).join(metadata, on)


# sets and splits

def differences(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """Keys on one side only, with `side` missing or unexpected. Nulls equal nulls."""
    return expected.distinct().exceptAll(seen.distinct()).withColumn("side", F.lit("missing")).unionByName(seen.distinct().exceptAll(expected.distinct()).withColumn("side", F.lit("unexpected")))


def mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row a key with its value, null and `conflict` where it has several."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("_v")).select(key, F.when(F.col("_n") <= 1, F.col("_v")).alias(value), (F.col("_n") > 1).alias("conflict"))


def over_seeds(df: DataFrame, start: int, repeats: int) -> DataFrame:
    """df once a seed: start, start + 1, and so on."""
    if repeats < 2:
        raise ValueError("at least two repeats are needed")
    return df.withColumn("seed", F.explode(F.sequence(F.lit(start), F.lit(start + repeats - 1))))


def log_odds(mutations: DataFrame, by: list[str], table: DataFrame) -> DataFrame:
    """(by, log_odds): sum over mutations(by, ref, pos, alt) of log p(alt) - log p(ref) from table(position, residue, logp).

    A mutation whose residues the table lacks makes the sum null."""
    side = lambda c: table.select(F.col("position").alias("pos"), F.col("residue").alias(c), F.col("logp").alias(f"_{c}"))
    rows = mutations.join(side("alt"), ["pos", "alt"], "left").join(side("ref"), ["pos", "ref"], "left")
    gap = F.col("_alt") - F.col("_ref")
    return rows.groupBy(*by).agg(F.when(F.count(gap) == F.count(F.lit(1)), F.sum(gap)).alias("log_odds"))
