"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Every distinct vector is a node of one shard's graph. Nodes enter in batches: a greedy beam search over
the graph so far proposes neighbours, and robust pruning keeps a neighbour only if no kept one is closer
to it by the factor 1 / ALPHA, so that edges point in different directions. A query walks every shard's
graph with a beam, and all finds of the beam are ranked together by exact distance. Distances are in double
precision; a shard's vectors are centred and scaled before they are compared, so that neither large values
nor a large common part lose what tells them apart. Nodes that no path from the entry reaches become entries
themselves: each node of a shard can be found, and a shard of fewer nodes than the beam is searched whole.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an
id; equal vectors share one node, which carries as many of their smallest ids as a result can show;
vectors of different lengths are never compared; rows with a query's own id are not its neighbours;
ties go to the smaller id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA = 20_000, 32, 64, 128, 1.2


class Graph:
    """A directed graph over the rows of a matrix, each with up to DEGREE edges."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 256):
        self.largest = float(np.abs(vectors).max()) or 1.0
        scaled = vectors / self.largest
        self.middle = scaled.mean(0)
        self.unit = float(np.abs(scaled - self.middle).max()) or 1.0
        self.x = self.placed(vectors)
        n = len(self.x)
        self.degree, self.alpha2 = degree, alpha * alpha
        self.edges = np.full((n, degree), -1, np.int32)
        self.start = int((self.x**2).sum(1).argmin())
        self.entries = np.array([self.start])
        order = np.random.default_rng(n).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]])
        done = 1
        while done < n:
            new = order[done : done + min(done, batch)]
            ids, dist = self.walk(self.x[new], beam)
            self.edges[new] = self.prune(new, ids, dist)
            self._back(new)
            done += len(new)
        self._reach()

    def placed(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as the graph compares them: centred and scaled."""
        return np.ascontiguousarray((vectors / self.largest - self.middle) / self.unit, np.float64)

    def _reach(self) -> None:
        """More entries, until every node is reached from one."""
        met = np.zeros(len(self.x), bool)
        front, entries = self.entries, [self.start]
        while True:
            while len(front):
                met[front] = True
                near = np.unique(self.edges[front])
                front = near[(near >= 0) & ~met[near]]
            left = np.flatnonzero(~met)
            if not len(left):
                break
            front = left[:1]
            entries.append(int(left[0]))
        self.entries = np.array(entries)

    def walk(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries at once: (ids, squared distances) of each beam, nearest first; -1 pads."""
        b, n = len(queries), len(self.x)
        rows = np.arange(b)
        seen = np.zeros((b, n), bool)
        first = len(self.entries)
        beam = max(beam, first)
        ids = np.full((b, beam), -1, np.int32)
        dist = np.full((b, beam), np.inf)
        left = np.zeros((b, beam), bool)
        ids[:, :first], left[:, :first], seen[:, self.entries] = self.entries, True, True
        dist[:, :first] = ((queries[:, None, :] - self.x[self.entries]) ** 2).sum(2)
        while True:
            going = np.where(left, dist, np.inf)
            at = going.argmin(1)
            live = np.flatnonzero(np.isfinite(going[rows, at]))
            if not len(live):
                break
            left[live, at[live]] = False
            near = self.edges[ids[live, at[live]]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(fresh, near, self.start)] = True
            far = ((self.x[near] - queries[live][:, None, :]) ** 2).sum(2)
            far[~fresh] = np.inf
            all_ids, all_dist = np.hstack([ids[live], near]), np.hstack([dist[live], far])
            all_left = np.hstack([left[live], fresh])
            best = np.argpartition(all_dist, beam - 1, 1)[:, :beam]
            ids[live], dist[live], left[live] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_dist, all_left))
        order = dist.argsort(1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        ids[~np.isfinite(dist)] = -1
        return ids, dist

    def prune(self, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Kept neighbours of each node among candidates sorted by distance."""
        alive = (ids >= 0) & (ids != nodes[:, None])
        places = self.x[ids]
        out = np.full((len(nodes), self.degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for r in range(self.degree):
            first = alive.argmax(1)
            there = alive[rows, first]
            if not there.any():
                break
            out[there, r] = ids[rows, first][there]
            gap = ((places - places[rows, first][:, None, :]) ** 2).sum(2)
            alive &= (self.alpha2 * gap > dist) | ~there[:, None]
            alive[rows, first] = False
        return out

    def _back(self, new: np.ndarray) -> None:
        """Edges back to the new nodes; nodes with too many are pruned."""
        to = self.edges[new]
        source = np.repeat(new, self.degree)[to.ravel() >= 0]
        target = to.ravel()[to.ravel() >= 0]
        order = target.argsort(kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        added = np.full((len(nodes), count.max()), -1, np.int32)
        added[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.hstack([self.edges[nodes], added])
        have = (both >= 0).sum(1)
        packed = np.take_along_axis(both, (both < 0).argsort(1, kind="stable"), 1)
        fits = have <= self.degree
        self.edges[nodes[fits]] = packed[fits][:, : self.degree]
        for part in np.array_split(np.flatnonzero(~fits), max(1, -(-int((~fits).sum()) // 256))):
            if not len(part):
                continue
            ids = packed[part][:, : have[part].max()]
            dist = ((self.x[ids] - self.x[nodes[part]][:, None, :]) ** 2).sum(2)
            dist[ids < 0] = np.inf
            by = dist.argsort(1, kind="stable")
            self.edges[nodes[part]] = self.prune(nodes[part], np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1))

    def nearest(self, queries: np.ndarray, beam: int = BEAM) -> Iterator[tuple[int, np.ndarray]]:
        """For each query its number and the nodes of its beam, nearest first."""
        for i in range(0, len(queries), 128):
            for j, ids in enumerate(self.walk(self.placed(queries[i : i + 128]), beam)[0]):
                yield i + j, ids[ids >= 0]


def distance(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; also right where squares would overflow or vanish."""
    gap = rows - query
    largest = np.abs(gap).max(initial=0.0)
    if 0 < largest < 1e-140 or largest > 1e140:
        return largest * np.sqrt(((gap / largest) ** 2).sum(1))
    return np.sqrt((gap**2).sum(1))


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def search(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row.

    queries has the columns of rows and may be taken from it. Both sides meet once in each shard:
    queries times shards rows, the block scheme of a stated query set."""
    own = rows.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    nodes = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    shards = max(1, -(-own.count() // shard))
    nodes = nodes.select(F.size("v").alias("d"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "members")
    asked = queries.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("q"))
    asked = asked.select(F.size("q").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query_id", "q")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}
        if left.num_rows and right.num_rows:
            x, q = _matrix(left.column("v")), _matrix(right.column("q"))
            members = left.column("members").to_pylist()
            asking, rows = right.column("query_id").to_numpy(), []
            for i, ids in Graph(x).nearest(q, max(BEAM, k + 1)):
                far = distance(x[ids], q[i])
                # of one shard no more than k + 1 nodes can be among the k nearest; ties at the edge stay
                edge = np.partition(far, k)[k] if len(far) > k else np.inf
                rows += [(asking[i], m, d) for j, d in zip(ids[far <= edge].tolist(), far[far <= edge].tolist(), strict=True) for m in members[j]]
            if rows:
                out = {n: np.array(c) for n, c in zip(out, zip(*rows, strict=True), strict=True)}
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    # a query's own vector may stand in the shard: k + 1 members of a node leave k others
    found = nodes.groupBy("d", "shard").cogroup(asked.groupBy("d", "shard")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.filter("query_id <> vec_id").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
