"""What may enter a study: columns, candidates, exclusions and registries of tasks and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def condition_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns of conditions: named prefix_S..., but for their errors."""
    return [c for c in df.columns if c.startswith(f"{prefix}_S") and not c.endswith("_err")]


def refuse_outcomes(df: DataFrame, exact: list[str], markers: list[str]) -> None:
    """Raises where a column's name reveals an outcome: one of `exact`, or one that holds a marker (any case).
    Names are read; no row is."""
    bad = [c for c in df.columns if c in exact or any(m in c.lower() for m in markers)]
    if bad:
        raise ValueError(f"columns reveal outcomes: {', '.join(bad)}")


def candidates(df: DataFrame, urn: str, published: str, reported: str, length: str, after: str, until: str, least: int, lengths: tuple[int, int]) -> DataFrame:
    """Rows published within (after, until], with enough reported rows and a length in [lengths].

    Unreadable dates and nulls fall out. A urn that two of the rows share raises."""
    day = F.try_to_date(published, "yyyy-MM-dd")
    rows = df.filter((day > F.to_date(F.lit(after))) & (day <= F.to_date(F.lit(until))) & (F.col(reported) >= least) & F.col(length).between(*lengths))
    if not rows.groupBy(urn).count().filter("count > 1").isEmpty():
        raise ValueError("a urn stands twice")
    return rows


def excluded(df: DataFrame, urn: str, digest: str, rules: list[str]) -> DataFrame:
    """(urn, digest, reasons, included): the names of the true columns of `rules` joined by ;, and of each
    digest's rows without a reason the one of least urn. A null rule is not a reason."""
    rows = df.select(urn, digest, F.concat_ws(";", *(F.when(F.col(r), r) for r in rules)).alias("reasons"))
    first = rows.filter("reasons = ''").groupBy(digest).agg(F.min(urn).alias("_first"))
    return rows.join(first, digest, "left").select(urn, digest, "reasons", ((F.col("reasons") == "") & F.coalesce(F.col(urn) == F.col("_first"), F.lit(False))).alias("included"))


def registry(parts: list[DataFrame], key: str) -> DataFrame:
    """(panel, lower_is_better, included, tasks, repeated) of panels joined by name; repeated counts the rows of a
    panel beyond its first of a key."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    by = ["panel", "lower_is_better", "included"]
    return rows.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.sum("_n").alias("tasks"), F.sum(F.col("_n") - 1).alias("repeated"))


def eligibility(df: DataFrame, status: str) -> DataFrame:
    """df with eligible and the reason against: qualification_failed, or not_qualified for any other status and null."""
    passed = F.coalesce(F.col(status) == "passed", F.lit(False))
    return df.withColumns({"eligible": passed, "reason": F.when(passed, "").when(F.col(status) == "failed", "qualification_failed").otherwise("not_qualified")})
