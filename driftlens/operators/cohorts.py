"""Outcome tables brought to one form, and the rules by which an assay enters a cohort or a target a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import names
from driftlens.operators.metrics import finite
from driftlens.operators.storage import stored


def consequences(df: DataFrame, by: list[str], code: str, score: str, sequence: str, orientation: str) -> DataFrame:
    """(by, orientation, raw_score, position, variant, effect), a row for each of df's.

    effect: `no_score` where the score is no finite number, `invalid` where the code is not one protein substitution
    (null too), `mismatch` where its reference does not stand in the sequence, else synonymous, termination or missense."""
    known = F.upper(F.coalesce(F.col(sequence), F.lit("")))
    rows = df.select(*by, F.col(orientation).cast("int").alias("orientation"), finite(score).alias("_finite"), F.col(score).try_cast("double").alias("raw_score"), names.hgvs(F.col(code)).alias("_m"), known.alias("_s"))
    m = F.col("_m")
    stands = F.coalesce((m["pos"] <= F.length("_s")) & (F.substr("_s", m["pos"], F.lit(1)) == m["ref"]), F.lit(False))
    effect = F.when(~F.col("_finite"), "no_score").when(m.isNull(), "invalid").when(~stands, "mismatch").when(m["alt"] == m["ref"], "synonymous").when(m["alt"] == "*", "termination").otherwise("missense")
    return rows.select(*by, "orientation", "raw_score", m["pos"].alias("position"), F.concat(m["ref"], m["pos"].cast("string"), m["alt"]).alias("variant"), effect.alias("effect"))


def _middle(values: Column) -> Column:
    """The median of a sorted array without nulls; null for an empty one."""
    n = F.size(values)
    at = lambda i: F.get(values, F.floor(i).cast("int"))
    return F.when(n % 2 == 1, at(n / 2)).when(n > 0, at(n / 2 - 1) * 0.5 + at(n / 2) * 0.5)


def canonical(df: DataFrame, by: list[str], code: str, score: str, sequence: str, orientation: str, controls: int = 10) -> tuple[DataFrame, DataFrame]:
    """(variants, audit) of each table in df; by names the table.

    variants: (by, variant, position, raw_score, source_rows, score), missense substitutions with the median of their rows,
    times the table's direction. The direction is what is stated (1 or -1); without a statement the sign of the synonymous
    median less the termination median, if there are `controls` rows of each; else null, and null scores.
    audit: a row for each table, one without any usable row too. Classes' medians hold a table's distinct control scores."""
    usable = F.col("effect").isin("synonymous", "termination", "missense")
    rows = consequences(df, by, code, score, sequence, orientation).repartition(*by)
    # each table's rows are dealt once; cells, written once, hold the few scores of a substitution, sorted
    cells = rows.groupBy(*by, "effect", "variant", "position").agg(F.count(F.lit(1)).alias("_k"), F.max("orientation").alias("orientation"), F.sort_array(F.collect_list(F.when(usable, F.col("raw_score")))).alias("_scores"))
    cells = stored(cells)
    of = lambda e: F.coalesce(F.sum(F.when(F.col("effect").isin(*e), F.col("_k"))), F.lit(0))
    middle = lambda e: _middle(F.sort_array(F.flatten(F.collect_list(F.when(F.col("effect") == e, F.col("_scores"))))))
    shown = F.signum(middle("synonymous") - middle("termination")).cast("int")
    told = F.max("orientation")
    enough = (of(["synonymous"]) >= controls) & (of(["termination"]) >= controls)
    direction = F.when(told.isNull() & enough & (shown != 0), shown).when(told.isin(1, -1), told)
    tables = cells.groupBy(*by).agg(
        F.sum("_k").alias("input_rows"), of(["synonymous", "termination", "missense"]).alias("parsed_rows"), of(["invalid"]).alias("invalid_codes"), of(["mismatch"]).alias("reference_mismatches"),
        of(["synonymous"]).alias("synonymous_controls"), of(["termination"]).alias("termination_controls"), direction.alias("direction"),
    )
    single = cells.filter("effect = 'missense'").select(*by, "variant", "position", _middle(F.col("_scores")).alias("raw_score"), F.col("_k").alias("source_rows"))
    variants = single.join(tables.select(*by, "direction"), by).select(*by, "variant", "position", "raw_score", "source_rows", (F.col("raw_score") * F.col("direction")).alias("score"))
    held = single.groupBy(*by).agg(
        F.count(F.lit(1)).alias("variants"), F.count_distinct("position").alias("positions"), F.count_distinct("raw_score").alias("unique_scores"), F.sum(F.when(F.col("source_rows") > 1, F.col("source_rows"))).alias("repeated_rows"),
    )
    return variants, stored(tables.join(held, by, "left").na.fill(0, ["variants", "positions", "unique_scores", "repeated_rows"]))


def cohort(variants: DataFrame, audit: DataFrame, by: list[str], least: int = 500, positions: int = 20, scores: int = 10) -> tuple[DataFrame, DataFrame]:
    """(variants of the tables that may enter, audit of all with eligible and the reasons against, joined by ;)."""
    rules = {"too_few_variants": F.col("variants") < least, "too_few_positions": F.col("positions") < positions, "too_few_scores": F.col("unique_scores") < scores, "no_direction": F.col("direction").isNull()}
    judged = audit.withColumn("reasons", F.concat_ws(";", *(F.when(c, n) for n, c in rules.items()))).withColumn("eligible", F.col("reasons") == "")
    return variants.join(judged.filter("eligible").select(*by), by, "left_semi"), judged


def target_rules(paths: DataFrame, sequences: DataFrame, publications: DataFrame, known_sequences: DataFrame, known_publications: DataFrame, path: str = "path", panel: str = "panel") -> tuple[DataFrame, DataFrame]:
    """(data sets with exclusion_reasons, selected and target_id, targets: one for each sequence of those selected).

    paths: files named folder/category/.../data set.ending. sequences(source_id, status, sequence) and
    publications(dataset_id, doi) are looked up once a data set; a key that stands there twice raises. Reasons: a name
    without an identifier, one that is not resolved (its status), no publication, one that is known, a known sequence."""

    def once(df: DataFrame, key: str) -> DataFrame:
        found = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *(F.max(c).alias(c) for c in df.columns if c != key))
        return found.withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("looked up twice: "), F.col(key).cast("string"))))).drop("_n")

    parts = F.split(path, "/")
    dataset = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    rows = paths.select(F.col(path).alias("source_path"), F.try_element_at(parts, F.lit(2)).alias("category"), dataset.alias("dataset_id")).withColumn("source_id", names.source_id(F.col("dataset_id")))
    doi = once(publications, "dataset_id").select("dataset_id", F.nullif(names.doi(F.col("doi")), F.lit("")).alias("doi"))
    rows = rows.join(once(sequences.select("source_id", "status", "sequence"), "source_id"), "source_id", "left").join(doi, "dataset_id", "left")
    rows = rows.join(known_sequences.select("sequence").distinct().withColumn("_seen", F.lit(True)), "sequence", "left")
    rows = rows.join(known_publications.select(names.doi(F.col("doi")).alias("doi")).distinct().withColumn("_read", F.lit(True)), "doi", "left")
    resolved = F.coalesce((F.col("status") == "resolved") & F.col("sequence").isNotNull(), F.lit(False))
    reasons = F.concat_ws(
        ";",
        F.when(F.col("source_id").isNull(), "unparsed_target").when(~resolved, F.when(F.col("status") != "resolved", F.col("status")).otherwise("unresolved_sequence")),
        F.when(F.col("doi").isNull(), "missing_publication").when(F.col("_read"), "known_publication"),
        F.when(F.col("_seen"), "known_sequence"),
    )
    digest = F.sha2("sequence", 256)
    judged = rows.withColumns({"exclusion_reasons": reasons, "sequence_sha256": digest}).withColumn("selected", F.col("exclusion_reasons") == "")
    judged = judged.withColumn("target_id", F.when(F.col("selected"), F.concat(F.lit(f"{panel}-"), F.substr("sequence_sha256", F.lit(1), F.lit(16)))))
    first = F.min_by("source_id", "dataset_id")
    targets = judged.filter("selected").groupBy("target_id", "sequence_sha256").agg(
        first.alias("source_id"), F.length(F.min("sequence")).alias("sequence_length"), F.array_join(F.array_sort(F.collect_set("dataset_id")), ";").alias("source_assays"), F.array_join(F.array_sort(F.collect_set("doi")), ";").alias("dois"),
    )
    return judged.select("source_path", "category", "dataset_id", "source_id", "doi", "exclusion_reasons", "selected", "target_id"), targets
