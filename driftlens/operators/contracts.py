"""What a table must hold, and what is counted of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.codes import RESIDUES, digest
from driftlens.operators.metrics import finite


def contract(df: DataFrame, required: list[str], key: list[str]) -> DataFrame:
    """One row: rows, keys that occur more than once, and rows with a null key. Missing columns raise at once."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    null = ~F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in key))
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first(null).alias("_null")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(F.col("_n") > 1).alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n")).otherwise(0)), F.lit(0)).alias("null_keys"))


def outcome_firewall(df: DataFrame, forbidden: set[str], markers: tuple[str, ...]) -> DataFrame:
    """df, unless a column's name is forbidden or holds a marker, in lower case; checked before any job."""
    if shown := [c for c in df.columns if c.lower() in forbidden or any(m in c.lower() for m in markers)]:
        raise ValueError(f"columns reveal outcomes: {', '.join(shown)}")
    return df


def target_faults(df: DataFrame, sequence: str, sha: str, length: str) -> DataFrame:
    """df with `fault`: what is wrong with a target's sequence, length and digest; empty if nothing is."""
    bare = F.upper(F.regexp_replace(F.trim(sequence), r"\*$", ""))
    return df.withColumn("fault", F.concat_ws(
        ";", F.when(F.col(sequence).isNull() | ~F.coalesce(F.regexp_like(bare, F.lit(f"^[{RESIDUES}]+$")), F.lit(False)), "residues"),
        F.when(~F.coalesce(F.length(bare) == F.col(length), F.lit(False)), "length"), F.when(~F.coalesce(digest(F.col(sequence)) == F.col(sha), F.lit(False)), "digest"),
    ))


def quality(df: DataFrame, count: str, indel: str, code: str, least: float = 1000, substitutions_only: bool = True, exclude_stop: bool = True) -> DataFrame:
    """Rows of at least `least` counts, without indels and stops; nothing is imputed."""
    out = df.filter(F.col(count) >= least)
    if substitutions_only:
        out = out.filter(~F.col(indel))
    return out.filter(~F.contains(F.col(code), F.lit("*"))) if exclude_stop else out


def summarize(df: DataFrame, mutations: str, indel: str, library: str) -> DataFrame:
    """One row of counts: all, wild type, substitutions, indels, and rows of the two kinds of library."""
    wild, has = F.col(mutations) == 0, F.col(indel)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(wild).alias("wild_type_rows"), F.count_if(~wild & ~has).alias("substitution_rows"), F.count_if(has).alias("indel_rows"), F.count_if(F.col(library) == "EP").alias("ep_rows"), F.count_if(F.col(library) == "SSVL").alias("ssvl_rows"))


def condition_columns(df: DataFrame, prefix: str = "mean_y") -> list[str]:
    return [c for c in df.columns if c.startswith(f"{prefix}_S") and not c.endswith("_err")]


def complete_tasks(df: DataFrame, task: list[str], model: str, models: list[str]) -> DataFrame:
    """(task, models, complete): how many of the given models each task has, and whether it has all."""
    known = F.when(F.col(model).isin(models), F.col(model))
    return df.groupBy(*task).agg(F.count_distinct(known).alias("models")).withColumn("complete", F.col("models") == len(models))


def budget(ledger: DataFrame, job: str, cost: str, planned: float = 0.0, cap: float = 2000.0) -> DataFrame:
    """One row: jobs, spent, projected, the alert reached, whether it is permitted, and rows that break the ledger's rules."""
    jobs = ledger.groupBy(job).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(finite(cost) & (F.col(cost) >= 0), F.col(cost)).otherwise(0.0)).alias("_cost"), F.count_if(~F.coalesce(finite(cost) & (F.col(cost) >= 0), F.lit(False))).alias("_bad"))
    one = jobs.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("jobs"), F.coalesce(F.sum("_cost"), F.lit(0.0)).alias("spent"), (F.count_if(F.col("_n") > 1) + F.coalesce(F.sum("_bad"), F.lit(0))).alias("faults"))
    part = (F.col("spent") + planned) / cap
    return one.select("jobs", "spent", (F.col("spent") + planned).alias("projected"), F.when(part >= 0.9, "90%").when(part >= 0.75, "75%").when(part >= 0.5, "50%").otherwise("none").alias("alert"), (F.col("spent") + planned <= cap).alias("permitted"), "faults")


def direction(name: Column, category: Column) -> Column:
    """1 where higher is better, -1 for a Michaelis constant (km as a word of the name), null without an order."""
    return F.when(category == "activity", F.when(F.regexp_like(name, F.lit(r"(?i)(^|[^a-z])km([^a-z]|$)")), -1).otherwise(1)).cast("int")


def publication_dates(df: DataFrame, panel: str, target: str, date: str) -> DataFrame:
    """The earliest date of each target, and one row `*` a panel with the panel's earliest."""
    each = df.groupBy(panel, target).agg(F.min(date).alias("published"))
    return each.unionByName(each.groupBy(panel).agg(F.min("published").alias("published")).withColumn(target, F.lit("*")))


def eligibility(df: DataFrame, by: list[str], code: str, value: str, valid: Column, agrees: Column, singles: int = 500, positions: int = 20, scores: int = 10) -> DataFrame:
    """Counts of each assay and the reasons, joined by ;, for which it is not eligible."""
    out = df.withColumns({"_valid": F.coalesce(valid, F.lit(False)), "_agrees": F.coalesce(agrees, F.lit(False)), "_v": F.when(finite(value), F.col(value))})
    usable = F.col("_valid") & F.col("_v").isNotNull()
    place = F.regexp_extract(F.col(code), r"^[A-Z]([0-9]+)[A-Z]$", 1)
    found = out.groupBy(*by).agg(
        F.count_if(usable).alias("singles"), F.count_distinct(F.when(usable, place)).alias("positions"), F.count_distinct(F.when(usable, F.col("_v"))).alias("scores"),
        F.count_if(~F.col("_valid")).alias("invalid"), F.count_if(F.col("_valid") & ~F.col("_agrees")).alias("mismatches"), (F.count(code) - F.count_distinct(code)).alias("repeats"),
    )
    reasons = (("too_few_singles", F.col("singles") < singles), ("too_few_positions", F.col("positions") < positions), ("too_few_scores", F.col("scores") < scores), ("invalid_codes", F.col("invalid") > 0), ("reference_mismatch", F.col("mismatches") > 0), ("repeated_codes", F.col("repeats") > 0))
    return found.withColumn("reasons", F.concat_ws(";", *(F.when(c, n) for n, c in reasons))).withColumn("eligible", F.col("reasons") == "")


def shared_by_all(df: DataFrame, item: str, member: str, among: list[str] | None = None) -> DataFrame:
    """Items that every member has: n-way intersection. among: the members, or all that occur."""
    pairs = df.select(item, member).distinct()
    if among is not None:
        return pairs.filter(F.col(member).isin(among)).groupBy(item).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(among)).select(item)
    total = pairs.select(member).distinct().agg(F.count(F.lit(1)).alias("_all"))
    return pairs.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(total), F.col("_n") == F.col("_all")).select(item)


def linspace_sample(df: DataFrame, by: list[str], item: str, most: int) -> DataFrame:
    """Of each group at most `most` rows: those at int(i * (n - 1) / (most - 1)) in order of items; the first one if
    `most` is 1."""
    own = Window.partitionBy(*by)
    rows = df.withColumn("_i", F.row_number().over(own.orderBy(item)) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    # row i is taken if some whole j has floor(j * (n - 1) / (most - 1)) = i
    low = F.ceil(F.try_divide(F.col("_i") * (most - 1), F.col("_n") - 1))
    hit = F.floor(low * (F.col("_n") - 1) / (most - 1)) == F.col("_i") if most > 1 else F.col("_i") == 0
    return rows.filter((F.col("_n") <= most) | ((F.col("_n") > most) & hit)).drop("_i", "_n")


def stratified_hash(df: DataFrame, item: str, size: str, seed: str, each: int, strata: int = 4) -> DataFrame:
    """`each` items of every stratum of equal numbers by size, those of least sha256 of seed and item.

    Ranks over all items come from counts by size (few distinct sizes), not from one task's sort of all rows."""
    sizes = df.groupBy(size).agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy().orderBy(size).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.select(size, before.alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("_all"))
    ranked = df.join(placed, size).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(size).orderBy(item)))
    cut = ranked.withColumn("stratum", F.floor(strata * (F.col("_r") - 1) / F.col("_all")).cast("int"))
    order = Window.partitionBy("stratum").orderBy(F.sha2(F.concat(F.lit(seed), F.col(item).cast("string")), 256), item)
    return cut.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= each).drop("_i", "_r", "_before", "_all")
