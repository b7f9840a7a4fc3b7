"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.operators.storage import discard, stored


def _least(edges: DataFrame) -> DataFrame:
    """edges(u, v) with `least`: the smallest of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return edges.join(least, "u")


def _stars(down: DataFrame) -> DataFrame:
    """down(u, v), v < u: every node's larger neighbours hung on its least neighbour, then its smaller ones."""
    both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
    small = _least(large).select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").filter("u <> v").distinct()


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", rounds: int = 50) -> DataFrame:
    """(node, component): the least node reachable over edges(a, b), edges between nodes only.

    Alternating large and small stars: edges are hung anew until each node but the least of its component
    has one edge, to the least. Rounds grow with the logarithm of a chain's length; an error is raised
    where `rounds` do not suffice."""
    known = nodes.select(F.col(node)).distinct()
    for end in ("a", "b"):
        edges = edges.join(known.select(F.col(node).alias(end)), end, "left_semi")
    down = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for done in range(rounds + 1):
        # a star forest has one edge a child, and no child with children
        ends = down.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(down.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg((F.sum("up") + F.max("down")).alias("ways"), F.max("up").alias("child")).filter("child = 1 AND ways > 1").isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"components have not settled after {rounds} rounds")
        last, down = down, stored(_stars(down))
        discard(last)
    return nodes.select(node).join(down.select(F.col("u").alias(node), "v"), node, "left").select(node, F.coalesce("v", node).alias("component"))


def star(members: DataFrame, node: str, group: str) -> DataFrame:
    """edges(a, b) that hang the members of each group on its least one; null groups hold nothing together."""
    known = members.filter(F.col(group).isNotNull())
    least = known.groupBy(group).agg(F.min(node).alias("b"))
    return known.join(least, group).select(F.col(node).alias("a"), "b").filter("a <> b")


def union(nodes: DataFrame, groups: list[DataFrame], edges: DataFrame | None = None, node: str = "node") -> DataFrame:
    """components of nodes held together by any of groups(node, group) and by edges(a, b)."""
    made = edges.select("a", "b") if edges is not None else None
    for members in groups:
        more = star(members, node, "group")
        made = more if made is None else made.unionByName(more)
    return components(nodes.select(node).distinct(), made, node)


def sensitivity(nodes: DataFrame, edges: DataFrame, value: str, thresholds: list[float], node: str = "node") -> DataFrame:
    """(threshold, node, component) over edges(a, b, value) of at least each threshold; one propagation for all."""
    levels = F.array(*map(F.lit, thresholds))
    at = lambda c: F.struct("threshold", F.col(c).alias("id"))
    every = nodes.select(node).distinct().withColumn("threshold", F.explode(levels)).select(at(node).alias("node"))
    kept = edges.withColumn("threshold", F.explode(levels)).filter(F.col(value) >= F.col("threshold")).select(at("a").alias("a"), at("b").alias("b"))
    return components(every, kept).select("node.threshold", F.col("node.id").alias(node), F.col("component.id").alias("component"))


def joint(development: DataFrame, targets: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, family) of targets in one graph with development(node, group): the component as text, or
    `undocumented` for targets that no edge(a, b) to a known node holds."""
    nodes = development.select(node).unionByName(targets.select(node)).distinct()
    found = union(nodes, [development], edges)
    known = edges.filter("a <> b").join(nodes.select(F.col(node).alias("a")), "a", "left_semi").join(nodes.select(F.col(node).alias("b")), "b", "left_semi")
    held = known.select(F.col("a").alias(node)).unionByName(known.select(F.col("b").alias(node))).distinct().withColumn("_held", F.lit(True))
    rows = targets.select(node).distinct().join(found, node).join(held, node, "left")
    return rows.select(node, F.when(F.col("_held"), F.col("component").cast("string")).otherwise("undocumented").alias("family"))


def families(nodes: DataFrame, alignments: DataFrame, identity: float, coverage: float, node: str = "node", prefix: str = "sf_") -> tuple[DataFrame, DataFrame]:
    """((node, family_id, family_size), alignments with qualifies, a_family, b_family): components over alignments(a, b,
    identity, coverage_a, coverage_b) that reach the identity and both coverages.

    A family's id is a digest of its sorted members, so that it does not hang on any one node's name; a family's
    members meet in one row for it. A qualifying alignment that crosses families raises."""
    able = (F.col("identity") >= identity) & (F.col("coverage_a") >= coverage) & (F.col("coverage_b") >= coverage)
    marked = alignments.withColumn("qualifies", F.coalesce(able, F.lit(False)))
    found = stored(components(nodes.select(node).distinct(), marked.filter("qualifies").select("a", "b"), node))
    members = F.sort_array(F.collect_set(F.col(node).cast("string")))
    named = found.groupBy("component").agg(F.concat(F.lit(prefix), F.substr(F.sha2(F.array_join(members, "|"), 256), F.lit(1), F.lit(12))).alias("family_id"), F.count(F.lit(1)).alias("family_size"))
    made = stored(found.join(named, "component").select(node, "family_id", "family_size"))
    end = lambda c: made.select(F.col(node).alias(c), F.col("family_id").alias(f"{c}_family"))
    audited = marked.join(end("a"), "a", "left").join(end("b"), "b", "left")
    crossing = F.col("qualifies") & (F.col("a_family") != F.col("b_family"))
    checked = F.when(crossing, F.raise_error(F.lit("a qualifying alignment crosses families")).cast("boolean")).otherwise(F.col("qualifies"))
    return made, audited.withColumn("qualifies", checked)
