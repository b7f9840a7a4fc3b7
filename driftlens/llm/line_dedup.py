"""Boilerplate lines by their frequency within a site.

For each site: the share of its pages that hold a line. Lines whose share exceeds `ratio` on a site of
at least `least` pages, and which stand on at least `holders` of them, are dropped from that site's pages;
the other lines keep their order. A line that stands twice on a page counts its page once.

Null or empty texts have no lines and give an empty text; a null site is a site of its own; repeated
rows are pages of their own; an empty table gives an empty result. Other columns are kept whatever their names;
the text column and n_lines, n_dropped replace columns of the same name. The lines over the ratio on one site number at most the mean number
of lines of a page divided by the ratio, which bounds the list that is joined back to the pages. Counts are
keyed by (site, line) and pages meet their site's list by (site, salt), so that a large site is spread
over all tasks; a site's list is repeated for the salts that its pages have, at most one a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import parts

RATIO, LEAST = 0.2, 5
BLOCKS = "p|br|div|li|ul|ol|nav|article|footer|header|h1|h2|h3|h4|h5|h6|title|head|body|html|table|tr|td|th|section|blockquote"


def host(url: Column) -> Column:
    """The host of an absolute address, lower case, without port; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return F.when(found != "", found)


def html_lines(html: Column) -> Column:
    """The text of a page, a block a line: scripts and styles out, block tags to line ends, other tags out."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "\n")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>", "\n")
    return F.regexp_replace(out, r"<[^>]*>", "")


def lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def _mark(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def drop_site_lines(pages: DataFrame, site: str, text: str, ratio: float = RATIO, least: int = LEAST, into: str | None = None, holders: int = 2) -> DataFrame:
    """pages with `into` (default: the text column) without its site's frequent lines, and n_lines, n_dropped."""
    into = into or text
    kept_columns = [c for c in pages.columns if c not in (into, "n_lines", "n_dropped")]
    other = [F.col(f"`{c}`") for c, kind in pages.dtypes if c != text and "map<" not in kind and "variant" not in kind]
    # the salt of a page follows from its other columns alone: a task run again deals it alike, and counting salts reads no texts
    salts = parts(pages.sparkSession)
    # the rows travel as one column, so that no name of theirs meets a name used here
    base = pages.select(
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in kept_columns)).alias("row"), lines(F.col(f"`{text}`")).alias("_lines"), F.col(f"`{site}`").isNotNull().alias("_known"),
        F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("")).alias("_site"), F.pmod(F.xxhash64(F.lit(0), *other), F.lit(salts)).alias("_salt"),
    )
    here = ["_known", "_site"]
    totals = base.groupBy(*here).agg(F.count(F.lit(1)).alias("_pages")).filter(F.col("_pages") >= least)
    counts = base.select(*here, F.explode(F.array_distinct(F.transform("_lines", _mark))).alias("_mark")).groupBy(*here, "_mark").agg(F.count(F.lit(1)).alias("_with"))
    frequent = counts.filter(F.col("_with") >= holders).join(totals, here).filter(F.col("_with") > ratio * F.col("_pages")).groupBy(*here).agg(F.collect_set("_mark").alias("_frequent"))
    salted = base.groupBy(*here, "_salt").agg(F.count(F.lit(1)).alias("_in")).select(*here, "_salt").join(frequent, here)
    joined = base.join(salted, [*here, "_salt"], "left")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    kept = F.filter("_lines", lambda x: ~F.array_contains(F.coalesce("_frequent", none), _mark(x)))
    added = {into: F.array_join(kept, "\n"), "n_lines": F.size("_lines").cast("long"), "n_dropped": (F.size("_lines") - F.size(kept)).cast("long")}
    return joined.select(*(F.col("row").getField(c).alias(c) for c in kept_columns), *(v.alias(k) for k, v in added.items()))
