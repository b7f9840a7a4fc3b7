"""Which columns of a table of unknown layout hold substitutions and outcomes, and its canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import names

#: Parts of names that hint at a mutation column, words that hint at an outcome, and words that speak against one.
MUTATION_HINTS = "mut|variant|substitution"
OUTCOME_WORDS = ("activity", "kcat", "kcatkm", "km", "score", "fitness", "value", "effect")
PLACE_WORDS = ("position", "site", "index", "residue", "rank")


def _plain(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def _number(text: Column) -> Column:
    """A finite number, or null; lambda-bound so that the text is cast once."""
    return F.get(F.transform(F.array(text.try_cast("double")), lambda v: F.when(F.abs(v) < float("inf"), v)), F.lit(0))


def choose_columns(df: DataFrame, by: list[str], columns: list[str], sequence: str, assay: str) -> DataFrame:
    """(by, mutation_column, outcome_column, error), from one pass over all columns of all tables at once.

    Mutation: a name with a hint first, then most values that are single substitutions of the sequence, then the
    least name. Outcome: another column with three finite values that are not all equal; words of the name that are
    the assay's or speak for an outcome first, words of places last, then most finite values, then the least name.
    error says which of the two a table lacks."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    long = df.select(*by, F.col(sequence).alias("_sequence"), F.col(assay).alias("_assay"), cells.alias("_c")).select(*by, "_sequence", "_assay", "_c.*")
    long = long.select(*by, "column", "_assay", names.flexible_code(F.col("value"), F.col("_sequence")).alias("_code"), _number(F.col("value")).alias("_number"))
    profile = long.groupBy(*by, "column").agg(F.count("_code").alias("valid"), F.count("_number").alias("finite"), (F.min("_number") < F.max("_number")).alias("varied"), F.first("_assay").alias("_assay"))
    name = _plain(F.col("column"))
    words = F.split(name, "_")
    wanted = F.concat(F.split(_plain(F.col("_assay")), "_"), F.array(*map(F.lit, OUTCOME_WORDS)))
    profile = profile.withColumns({"hinted": F.regexp_like(F.regexp_replace(F.lower("column"), "[^a-z0-9]+", "_"), F.lit(MUTATION_HINTS)).cast("int"), "priority": F.arrays_overlap(words, wanted).cast("int") - 2 * F.arrays_overlap(words, F.array(*map(F.lit, PLACE_WORDS))).cast("int")})
    own = Window.partitionBy(*by)
    mutation = F.row_number().over(own.orderBy(F.desc(F.col("valid") > 0), F.desc("hinted"), F.desc("valid"), "column"))
    # a row a column and table, so windows over a table stay as small as its columns
    placed = profile.withColumn("_m", (mutation == 1) & (F.col("valid") > 0)).withColumn("_able", (F.col("finite") >= 3) & F.coalesce("varied", F.lit(False)) & ~F.col("_m"))
    placed = placed.withColumn("_o", F.col("_able") & (F.row_number().over(own.orderBy(F.desc("_able"), F.desc("priority"), F.desc("finite"), "column")) == 1))
    pick = lambda flag: F.max(F.when(F.col(flag), F.col("column")))
    made = placed.groupBy(*by).agg(pick("_m").alias("mutation_column"), pick("_o").alias("outcome_column"))
    error = F.when(F.col("mutation_column").isNull(), "no column of single substitutions").when(F.col("outcome_column").isNull(), "no finite outcome that varies")
    return made.withColumn("error", error)


def canonical(df: DataFrame, chosen: DataFrame, by: list[str], columns: list[str], sequence: str, direction: str) -> DataFrame:
    """(by, variant_id, effect, source_rows): the median outcome times the direction of each substitution; rows without a
    valid substitution or a finite outcome, and tables with an error, are left out."""
    cells = F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))
    rows = df.join(chosen.filter("error IS NULL").select(*by, "mutation_column", "outcome_column"), by).withColumn("_cells", cells)
    rows = rows.select(*by, names.flexible_code(F.try_element_at("_cells", F.col("mutation_column")), F.col(sequence)).alias("variant_id"), (_number(F.try_element_at("_cells", F.col("outcome_column"))) * F.col(direction)).alias("_effect"))
    return rows.filter("variant_id IS NOT NULL AND _effect IS NOT NULL").groupBy(*by, "variant_id").agg(F.median("_effect").alias("effect"), F.count(F.lit(1)).alias("source_rows"))
