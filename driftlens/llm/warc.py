"""Merkle fixity audit of WARC replicas.

Records of a WARC file, ordered by offset, are hashed; hashes of `fanout` neighbours make the hash of
the offset range that they cover, up to one root a file. Two replicas are compared by their roots, and
only mismatching ranges are opened, level by level, down to single records.

Nulls in a page give empty header values or an empty body; repeated pages are records of their own;
empty tables give empty trees; a replica that lacks a file or a record is reported as `missing` or
`extra`; records are told apart by file and place, so that ids may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import cut

#: Records of a file and children of a node, about and at most.
RECORDS, FANOUT = 512, 8


def record(page_id: Column, url: Column, body: Column) -> Column:
    """A page as the bytes of a WARC/1.0 resource record."""
    content = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), content, F.lit("\r\n\r\n").cast("binary"))


def placed(made: DataFrame) -> DataFrame:
    """made(file, record_id, _url, digest, length, ...) with place and offset in its file."""
    order = Window.partitionBy("file").orderBy(F.col("record_id").asc_nulls_first(), F.col("_url").asc_nulls_first(), "digest")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return made.withColumn("place", (F.row_number().over(order) - 1).cast("long")).withColumn("offset", offset)


def dealt_records(pages: DataFrame, files: int, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """pages as records(file, record_id, _url, record, length, digest), not yet in order: no shuffle so far.

    The file of a page follows from the md5 of its id and address."""
    named = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit(""))))
    dealt = F.pmod(F.conv(F.substr(named, F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(files)).cast("int")
    made = pages.select(dealt.alias("file"), F.col(key).alias("record_id"), F.col(url).alias("_url"), record(F.col(key), F.col(url), F.col(body)).alias("record"))
    return made.withColumn("length", F.octet_length("record").cast("long")).withColumn("digest", F.sha2("record", 256))


def write_records(pages: DataFrame, files: int, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """pages as records(file, place, offset, length, record_id, digest, record), dealt to `files` WARC files.

    The file of a page follows from the md5 of its id and address, its place from id, address and body."""
    return placed(dealt_records(pages, files, key, url, body)).select("file", "place", "offset", "length", "record_id", "digest", "record")


def leaves(records: DataFrame) -> DataFrame:
    """One node a record, whose hash covers its offset range and its digest."""
    return records.select("file", F.col("place").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), F.sha2(F.concat_ws("|", "offset", "length", "digest"), 256).alias("hash"), "record_id", "digest")


def tree(records: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes(file, node, start, stop, hash) of each level, leaves first; level `levels` is the root of a file.

    Each level is written before the next is made from it, so that no plan holds more than one level."""
    made = [leaves(records).select("file", "node", "start", "stop", "hash")]
    for level in range(1, levels + 1):
        node = F.floor(F.col("node") / fanout) if level < levels else F.lit(0).cast("long")
        above = (
            made[-1].groupBy("file", node.alias("node"))
            .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("below"))
            .select("file", "node", "start", "stop", F.sha2(F.concat_ws("|", F.transform("below", lambda x: x["hash"])), 256).alias("hash"))
        )
        made.append(cut(above))
    return made


def depth(most: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves for files of at most so many records."""
    levels = 1
    while fanout**levels < most:
        levels += 1
    return levels


def audit(first: DataFrame, second: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Damaged records(file, place, offset, length, record_id, status), found by descending from the roots.

    first and second: records of the replica that is trusted and of the one that is checked. status:
    corrupt (another digest at the place), moved (same digest, another offset), missing, extra."""
    most = max(x["n"] or 0 for x in (first.agg((F.max("place") + 1).alias("n")).first(), second.agg((F.max("place") + 1).alias("n")).first()))
    levels = depth(max(1, most), fanout)
    trees, bad = [tree(x, levels, fanout) for x in (first, second)], None
    for level in range(levels, -1, -1):
        parent = F.floor(F.col("node") / fanout) if level + 1 < levels else F.lit(0).cast("long")
        sides = []
        for nodes, name in zip(trees, "ab"):
            own = nodes[level].select("file", "node", F.col("hash").alias(f"hash_{name}"))
            if bad is not None:
                own = own.withColumn("parent", parent).join(bad.withColumnRenamed("node", "parent"), ["file", "parent"], "left_semi").drop("parent")
            sides.append(own)
        bad = cut(sides[0].join(sides[1], ["file", "node"], "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file", "node"))
    places = bad.select("file", F.col("node").alias("place"))
    one = first.select("file", "place", *(F.col(c).alias(f"{c}_a") for c in ("offset", "length", "record_id", "digest")))
    two = second.select("file", "place", *(F.col(c).alias(f"{c}_b") for c in ("offset", "length", "record_id", "digest")))
    both = places.join(one, ["file", "place"], "left").join(two, ["file", "place"], "left")
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").when(F.col("digest_a") != F.col("digest_b"), "corrupt").otherwise("moved")
    return both.select("file", "place", *(F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in ("offset", "length", "record_id")), status.alias("status"))
