"""Histogram gradient boosting of all groups at once.

Features are cut into bins once, and rows of a group that share all bins become one cell: counts and sums of weights
and weighted targets, which is all that squared and logistic losses ask of them. Features that a key tells (a `Lookup`)
are one part of a cell, the row of a small table, whatever their number.

A group of up to `GATHERED` bytes of cells is fitted by one task, all rounds of all such groups in one job. Larger ones
take a pass for each level of a tree: each task sums counts, gradients and Hessians of its cells by node and part, and
the sums meet by node, where its best split is found. Either way only trees reach the driver, which are as many as
groups, rounds and leaves and do not grow with the rows. Groups are fold or candidate keys: few, each with any number
of rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators.linear import Lookup, matrix, vector
from driftlens.operators.linear import whole as finite_rows
from driftlens.operators.storage import discard, stored

#: Bytes of a group's cells, as a task holds them, up to which it fits the group by itself.
GATHERED = 1 << 29
#: Cells of a written chunk at most, and those that a step of numpy works on.
CHUNK, BLOCK = 1 << 17, 1 << 15


@dataclass
class Tree:
    """Nodes in heap order: node i splits by feature and bin (left: at most that bin) into 2 i + 1 and 2 i + 2, or is a leaf."""

    feature: dict[int, int] = field(default_factory=dict)
    bin: dict[int, int] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bin numbers."""
        at = np.zeros(len(bins), np.int64)
        for i in sorted(self.feature):
            here = np.flatnonzero(at == i)
            at[here] = 2 * i + 1 + (bins[here, self.feature[i]] > self.bin[i])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        at = self.nodes(bins)
        out = np.zeros(len(bins))
        for i, v in self.value.items():
            out[at == i] = v
        return out


def best_first(splits: dict[int, tuple[float, int, int]], leaves: int) -> Tree:
    """The tree that always splits the node of most gain (ties: least node) until it has as many leaves."""
    tree, frontier = Tree(), {0}
    while len(tree.feature) + 1 < leaves:
        able = [(-splits[i][0], i) for i in frontier if i in splits]
        if not able:
            break
        _, i = min(able)
        frontier = (frontier - {i}) | {2 * i + 1, 2 * i + 2}
        tree.feature[i], tree.bin[i] = splits[i][1], splits[i][2]
    tree.value = dict.fromkeys(frontier, 0.0)
    return tree


@dataclass
class Model:
    """Boosted trees by group number, with what turns rows into bins."""

    features: list[str]
    numbers: dict[tuple, int]
    edges: dict[int, list[np.ndarray]]
    base: dict[int, float]
    trees: dict[int, list[Tree]]
    loss: str
    lookup: Lookup | None = None


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)


def _numbered(df: DataFrame, by: list[str], numbers: dict[tuple, int], how: str = "inner") -> DataFrame:
    """df with _m, the number of its group."""
    if not by:
        return df.withColumn("_m", F.lit(0))
    rows = [(*k, i) for k, i in numbers.items()]
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*by).dtypes) + ", _m int"
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), by, how)


def _masks(trees: list[Tree], place: dict[int, tuple[int, np.ndarray]], sizes: list[int]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """(by part: for each tree and value the leaves, as bits from left to right, that the value leaves open; values of leaves).

    The bits that all parts of a row leave open are one. Trees of 64 leaves at most."""
    masks, values = {}, np.zeros((len(trees), 64))
    for t, tree in enumerate(trees):
        bits, order, stack = {}, [], [0]
        while stack:
            i = stack.pop()
            if i in tree.feature:
                stack += [2 * i + 2, 2 * i + 1]
            else:
                bits[i] = 1 << len(order)
                order.append(i)
        values[t, : len(order)] = [tree.value[i] for i in order]
        for i in sorted(tree.feature, reverse=True):
            left, right = bits[2 * i + 1], bits[2 * i + 2]
            bits[i] = left | right
            part, bins = place[tree.feature[i]]
            mask = masks.setdefault(part, np.full((len(trees), sizes[part]), 2**64 - 1, np.uint64))[t]
            mask &= np.where(bins > tree.bin[i], np.uint64(2**64 - 1 - left), np.uint64(2**64 - 1 - right))
    return masks, values


class Layout:
    """How the parts of a group's cells tell the bins of its features: the row of a lookup's table (first, if there is
    one) and a bin for each other feature. table: (rows, features `given`), the bins that a lookup's rows stand for."""

    def __init__(self, own: list[int], given: list[int], table: np.ndarray | None, bins: int) -> None:
        self.sizes = ([] if table is None else [len(table)]) + [bins] * len(own)
        self.place: dict[int, tuple[int, np.ndarray]] = {}
        cuts, self.order = [], None
        if table is not None:
            self.place |= {j: (0, table[:, c]) for c, j in enumerate(given)}
            self.order = np.argsort(table, axis=0, kind="stable").T
            ordered = np.take_along_axis(table.T, self.order, 1)
            # a cut after the last row of each bin but the highest
            self.ends = np.flatnonzero(np.column_stack([ordered[:, 1:] != ordered[:, :-1], np.zeros(len(ordered), bool)]).ravel())
            cuts += [(given[i // len(table)], int(ordered.ravel()[i])) for i in self.ends]
        for t, j in enumerate(own, len(self.sizes) - len(own)):
            self.place[j] = (t, np.arange(bins))
            cuts += [(j, k) for k in range(bins - 1)]
        self.turn = np.array(sorted(range(len(cuts)), key=cuts.__getitem__), np.int64)
        self.cuts = [cuts[i] for i in self.turn]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(int)

    def left(self, hist: np.ndarray) -> np.ndarray:
        """What stands left of each cut, in order of features and bins."""
        made = []
        if self.order is not None:
            made.append(np.cumsum(hist[:, : self.sizes[0]][:, self.order], axis=-1).reshape(3, -1)[:, self.ends])
        for t in range(self.order is not None, len(self.sizes)):
            made.append(np.cumsum(hist[:, self.starts[t] : self.starts[t + 1] - 1], axis=-1))
        return np.concatenate(made, 1)[:, self.turn]

    def counts(self, hist: np.ndarray, j: int) -> np.ndarray:
        t, bins = self.place[j]
        return np.bincount(bins, hist[0, self.starts[t] : self.starts[t + 1]])


def _drawn(layout: Layout, hist: np.ndarray, m: int, node: int, drawn: tuple[int, float]) -> np.ndarray:
    """Which cuts a node tries: of a drawn share of the features one each, a place between its least and largest bin."""
    at = lambda what, j: int(hashlib.md5(f"{drawn[0]}|{what}|{m}|{node}|{j}".encode()).hexdigest()[:8], 16) / 2.0**32
    tried = set()
    for j in sorted(layout.place, key=lambda j: (at("feature", j), j))[: max(1, round(drawn[1] * len(layout.place)))]:
        there = np.flatnonzero(layout.counts(hist, j))
        cut = there[0] + at("cut", j) * (there[-1] - there[0])
        tried.add((j, int(there[there <= cut][-1])))
    return np.array([c in tried for c in layout.cuts])


def _split(layout: Layout, hist: np.ndarray, least: int, l2: float, tried: np.ndarray | None) -> tuple | None:
    """(gain, feature, bin, gradients left and right, Hessians left and right) of a node's best cut; ties: least feature and bin."""
    n, g, h = hist[:, : layout.sizes[0]].sum(1)
    nl, gl, hl = layout.left(hist)
    able = (nl >= least) & (n - nl >= least)
    if tried is not None:
        able &= tried
    if not able.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(able, np.round(gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2), 9), -1.0)
    i = int(np.argmax(gain))
    if not gain[i] > 0:
        return None
    return float(gain[i]), *layout.cuts[i], float(gl[i]), float(g - gl[i]), float(hl[i]), float(h - hl[i])


def _turns(layout: Layout, splits: dict[int, tuple], down: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Where the nodes of a level send their rows: to a first child or nowhere, and by part whether to the second one."""
    first, count = 2**down - 1, 2**down
    goto, right = np.arange(first, first + count + 1), {}
    for i in range(count):
        if (s := splits.get(first + i)) is not None:
            goto[i] = 2 * (first + i) + 1
            t, bins = layout.place[s[1]]
            right.setdefault(t, np.zeros((count + 1, layout.sizes[t]), np.uint8))[i] = bins > s[2]
    return goto, {t: r.ravel() for t, r in right.items()}


def _routed(layout: Layout, turns: tuple, down: int, parts: np.ndarray, node: np.ndarray) -> np.ndarray:
    first, count = 2**down - 1, 2**down
    live = node >= first
    here = np.where(live, node - first, count)
    goto, right = turns
    new = goto[here]
    for t, r in right.items():
        new += r[here * layout.sizes[t] + parts[t]]
    return np.where(live, new, node)


def _sums(layout: Layout, parts: np.ndarray, node: np.ndarray, down: int, n: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """By part: counts, gradients and Hessians by node of the level (a last one for all others) and value."""
    first, count = 2**down - 1, 2**down
    here = np.where(node >= first, node - first, count)
    out = []
    for t, size in enumerate(layout.sizes):
        key = here * size + parts[t]
        made = [np.bincount(key, v, (count + 1) * size) for v in ((n, g) if h is n else (n, g, h))]
        out.append(np.stack([*made, made[0]] if h is n else made))
    return out


def _joined(layout: Layout, sums: list[np.ndarray], count: int) -> np.ndarray:
    """(nodes, 3, values of all parts)."""
    return np.concatenate([s.reshape(3, count + 1, size)[:, :count].transpose(1, 0, 2) for s, size in zip(sums, layout.sizes, strict=True)], 2)


def _leaf_of(tree: Tree, depth: int) -> np.ndarray:
    """The leaf of a pruned tree for each node of the tree before."""
    at = np.zeros(2 ** (depth + 1) - 1, np.int64)
    for i in range(1, len(at)):
        up = at[(i - 1) // 2]
        at[i] = i if up == (i - 1) // 2 and up in tree.feature else up
    return at


def _grown(layout: Layout, parts: np.ndarray, n: np.ndarray, w: np.ndarray, y: np.ndarray, f: np.ndarray, m: int, loss: str, rounds: int, rate: float, leaves: int, least: int, l2: float, depth: int, drawn: tuple | None) -> list[Tree]:
    """All trees of one group from its cells; f is moved along."""
    trees, blocks = [], [slice(i, i + BLOCK) for i in range(0, len(n), BLOCK)]
    same = loss == "squared" and np.array_equal(n, w)
    for _ in range(rounds):
        g, h = derivatives(loss, y, f, w)
        h = n if same else h
        node, splits, sums = np.zeros(len(n), np.int64), {}, {}
        turns, down = None, 0
        for down in range(depth):
            total = None
            for at in blocks:
                if turns is not None:
                    node[at] = _routed(layout, turns, down - 1, parts[:, at], node[at])
                own_n = n[at]
                made = _sums(layout, parts[:, at], node[at], down, own_n, g[at], own_n if same else h[at])
                total = made if total is None else [a + b for a, b in zip(total, made, strict=True)]
            found = _level_splits(layout, _joined(layout, total, 2**down), m, down, splits, sums, least, l2, drawn)
            turns = None
            if not found:
                break
            splits |= found
            turns = _turns(layout, splits, down)
        if not splits:
            break
        if turns is not None:
            for at in blocks:
                node[at] = _routed(layout, turns, down, parts[:, at], node[at])
        tree = best_first(splits, leaves)
        leaf = _leaf_of(tree, depth)[node]
        for i in tree.value:
            tree.value[i] = rate * (float(np.median((y - f)[leaf == i])) if loss == "absolute" else -sums[i][0] / (sums[i][1] + l2))
        values = np.zeros(2 ** (depth + 1) - 1)
        values[list(tree.value)] = list(tree.value.values())
        f += values[leaf]
        trees.append(tree)
    return trees


def _level_splits(layout: Layout, hists: np.ndarray, m: int, down: int, splits: dict, sums: dict, least: int, l2: float, drawn: tuple | None) -> dict[int, tuple]:
    """The splits of a level's nodes by heap number, from their sums; what they send to either side goes into `sums`."""
    first, out = 2**down - 1, {}
    for i, hist in enumerate(hists):
        node = first + i
        if (down and (node - 1) // 2 not in splits) or not hist[0, : layout.sizes[0]].any():
            continue
        s = _split(layout, hist, least, l2, _drawn(layout, hist, m, node, drawn) if drawn is not None else None)
        if s is not None:
            out[node] = s[:3]
            sums[2 * node + 1], sums[2 * node + 2] = (s[3], s[5]), (s[4], s[6])
    return out


def derivatives(loss: str, y: np.ndarray, f: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians of cells; y: sums of weighted targets (absolute loss: the target of the cell's one row)."""
    if loss == "squared":
        return f * w - y, w
    if loss == "absolute":
        return np.sign(f - y) * w, w
    share = 1 / (1 + np.exp(-f))
    return share * w - y, np.maximum(share * (1 - share), 1e-16) * w


_CHUNK = "_m int, _size int, _parts binary, _n binary, _w binary, _y binary, _f binary"


def _chunk(m: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"_m": pa.array([m], pa.int32()), "_size": pa.array([len(arrays[1])], pa.int32()), **{c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in zip(("_parts", "_n", "_w", "_y", "_f"), arrays, strict=True)}})


def _chunks(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(group, [parts, n, w, y, f]) of each chunk."""
    for batch in batches:
        for r in range(batch.num_rows):
            blob = lambda c: batch.column(c)[r].as_buffer()  # noqa: B023, E731
            yield batch.column("_m")[r].as_py(), [np.frombuffer(blob("_parts"), np.uint16).reshape(count, -1), *(np.frombuffer(blob(c)) for c in ("_n", "_w", "_y", "_f"))]


def fit(df: DataFrame, by: list[str], features: list[str], target: str, weight: str | None = None, rounds: int = 150, rate: float = 0.05, leaves: int = 31, least: int = 40, l2: float = 1.0, bins: int = 64, depth: int = 6, loss: str = "squared", keep: int = 10, drawn: tuple[int, float] | None = None, lookup: Lookup | None = None, count: str | None = None) -> Model:
    """Boosted trees of each group's rows. Rows without a finite target or feature take no part.

    loss: squared, absolute (leaves take the median residual; no weights) or logistic (target 0 or 1). Trees are grown
    to `depth` levels and pruned to the `leaves` that best-first growth takes. A group is done once a tree has no split.
    In groups too large for one task the sums of the trees so far are written with the cells every `keep` rounds, so
    that a pass evaluates at most `keep` trees.
    drawn: (seed, share) - a node tries one drawn bin of each of a drawn share of the features, in place of all.
    lookup: the features that a number tells; df has that column in their place. count: how many rows of equal features
    a row stands for, with the sum of their weights and the weighted mean of their targets."""
    if loss == "absolute" and (weight is not None or count is not None):
        raise ValueError("absolute loss takes no weights")
    given = [j for j, c in enumerate(features) if lookup is not None and c in lookup.features]
    own = [j for j in range(len(features)) if j not in given]
    p, known = len(own), None if lookup is None else lookup.of([features[j] for j in given])
    number = F.lit(0) if known is None else F.col(lookup.column)
    kept = df.select(*by, vector([*(features[j] for j in own), target]).alias("_x"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"), number.cast("int").alias("_id"), (F.lit(1) if count is None else F.col(count)).cast("long").alias("_c"))
    kept = kept.filter(finite_rows("_x") & (F.col("_w") > 0) & F.col("_id").isNotNull())
    if known is not None and not np.isfinite(known).all():
        kept = kept.filter(~F.col("_id").isin(np.flatnonzero(~np.isfinite(known).all(1)).tolist()))
    held_rows = stored(kept)
    groups = [tuple(r[c] for c in by) for r in held_rows.select(*by).distinct().collect()] if by else [()]
    numbers = {k: i for i, k in enumerate(sorted(groups, key=str))}
    rows = _numbered(held_rows, by, numbers)
    y = F.element_at("_x", -1)
    quantiles = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    found = rows.groupBy("_m").agg(
        F.array(*(F.percentile_approx(F.get("_x", F.lit(j)), quantiles, F.lit(10_000)) for j in range(p if count is None else 0))).cast("array<array<double>>").alias("edges"),
        (F.sum(y * F.col("_w")) / F.sum("_w")).alias("mean"), (F.median(y) if loss == "absolute" else F.lit(None)).alias("mid"), (F.sum("_w") / F.sum("_c")).alias("w"),
    ).collect()
    # an edge separates values up to it from larger ones; one that nothing lies above is never a best split
    edges = {r["_m"]: {j: np.unique(np.asarray(e, float)) for j, e in zip(own, r["edges"], strict=False)} for r in found}
    if count is not None and p:
        # a value is a quantile's if the rows up to it reach one more share than those before it
        values = rows.select("_m", "_c", F.posexplode(F.slice("_x", 1, p)).alias("_j", "_v")).groupBy("_m", "_j", "_v").agg(F.sum("_c").alias("_c"))
        each = Window.partitionBy("_m", "_j")
        upto, whole = F.sum("_c").over(each.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), F.sum("_c").over(each)
        shares = lambda n: F.least(F.floor(n * bins / whole), F.lit(bins - 1))
        for r in values.withColumn("_at", shares(upto) > shares(upto - F.col("_c"))).filter("_at").groupBy("_m", "_j").agg(F.collect_list("_v").alias("e")).collect():
            edges[r["_m"]][own[r["_j"]]] = np.unique(np.asarray(r["e"], float))
    mean_weight = {r["_m"]: r["w"] for r in found}
    base = {r["_m"]: r["mid"] if loss == "absolute" else float(np.log(r["mean"] / (1 - r["mean"]))) if loss == "logistic" else r["mean"] for r in found}
    if known is not None:
        # quantiles of what a number tells, from how often each number is there
        often = {m: np.zeros(len(known)) for m in edges}
        for r in rows.groupBy("_m", "_id").agg(F.sum("_c").alias("n")).collect():
            often[r["_m"]][r["_id"]] = r["n"]
        for m, times in often.items():
            for c, j in enumerate(given):
                order = np.argsort(known[:, c], kind="stable")
                upto = np.cumsum(times[order])
                edges[m][j] = np.unique(known[order[np.searchsorted(upto, np.ceil(np.arange(1, bins) / bins * upto[-1]), side="left")], c])
    layouts = {m: Layout(own, given, None if known is None else _binned(known, [e[j] for j in given]), bins) for m, e in edges.items()}
    parts, merged_y = p + (known is not None), loss != "absolute"

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, x = batch.column("_m").to_numpy(), matrix(batch.column("_x"), p + 1)[0]
            made, w = np.zeros((len(m), parts), np.uint16), batch.column("_w").to_numpy().copy()
            if known is not None:
                made[:, 0] = batch.column("_id").to_numpy()
            for i in np.unique(m).tolist():
                at = m == i
                for c, j in enumerate(own):
                    made[at, parts - p + c] = np.searchsorted(edges[i][j], x[at, c], side="left")
                w[at] /= mean_weight[i]
            keys = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * 2 * parts).astype(np.int32)), pa.py_buffer(made.tobytes())])
            yield pa.RecordBatch.from_pydict({"_m": pa.array(m, pa.int32()), "_key": keys, "_n": pa.array(batch.column("_c").to_numpy().astype(float)), "_w": pa.array(w), "_y": pa.array(x[:, p] * w if merged_y else x[:, p])})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        total = 0

        def out() -> Iterator[pa.RecordBatch]:
            for i, own_ in held.items():
                keys, *sums = (np.concatenate(v) for v in zip(*own_, strict=True))
                yield _chunk(i, [keys.T, *sums, np.full(len(keys), base[i])])

        for batch in batches:
            m = batch.column("_m").to_numpy()
            keys = np.frombuffer(b"".join(batch.column("_key").to_pylist()), np.uint16).reshape(-1, parts)
            sums = [batch.column(c).to_numpy() for c in ("_n", "_w", "_y")]
            for i in np.unique(m).tolist():
                at = m == i
                held.setdefault(i, []).append([keys[at], *(v[at] for v in sums)])
            total += len(m)
            if total >= CHUNK:
                yield from out()
                held, total = {}, 0
        yield from out()

    cells = rows.mapInArrow(cut_up, "_m int, _key binary, _n double, _w double, _y double")
    if merged_y:
        cells = cells.groupBy("_m", "_key").agg(*(F.sum(c).alias(c) for c in ("_n", "_w", "_y")))
    table = stored(cells.mapInArrow(pack, _CHUNK))
    discard(held_rows)
    sizes = {r["_m"]: r["n"] for r in table.groupBy("_m").agg(F.sum("_size").alias("n")).collect()}
    settings = {"loss": loss, "rounds": rounds, "rate": rate, "leaves": leaves, "least": least, "l2": l2, "depth": depth, "drawn": drawn}
    # a cell's parts and eight numbers, which a task has beside it
    small = sorted(m for m, n in sizes.items() if n * (2 * parts + 64) <= GATHERED)
    trees: dict[int, list[Tree]] = {i: [] for i in numbers.values()}

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for m, arrays in _chunks(batches, parts):
            held.setdefault(m, []).append(arrays)
        while held:
            m, own_ = held.popitem()
            arrays = [np.concatenate(v, -1) for v in zip(*own_, strict=True)]
            del own_
            made = _grown(layouts[m], *arrays, m, **settings)
            said = json.dumps([[list(t.feature.items()), list(t.bin.items()), list(t.value.items())] for t in made])
            yield pa.RecordBatch.from_pydict({"_m": pa.array([m], pa.int32()), "trees": pa.array([said])})

    if small:
        # a group is a task of its own
        turn = F.create_map(*(F.lit(v) for i, m in enumerate(small) for v in (m, i)))
        dealt = table.filter(F.col("_m").isin(small)).withColumn("_turn", turn[F.col("_m")]).repartitionById(len(small), "_turn").drop("_turn")
        for r in dealt.mapInArrow(alone, "_m int, trees string").collect():
            trees[r["_m"]] = [Tree(*(dict(map(tuple, v)) for v in t)) for t in json.loads(r["trees"])]
    if len(small) < len(sizes):
        large = table.filter(~F.col("_m").isin(small)) if small else table
        trees |= _by_passes(large, {m: layouts[m] for m in sizes if m not in small}, parts, keep, settings)
    discard(table)
    return Model(features, numbers, {m: [e[j] for j in range(len(features))] for m, e in edges.items()}, base, trees, loss, lookup)


def _by_passes(table: DataFrame, layouts: dict[int, Layout], parts: int, keep: int, settings: dict) -> dict[int, list[Tree]]:
    """The trees of groups too large for one task: a pass a level of the trees of all of them."""
    loss, rate, leaves, least, l2, depth, drawn = (settings[k] for k in ("loss", "rate", "leaves", "least", "l2", "depth", "drawn"))
    trees: dict[int, list[Tree]] = {m: [] for m in layouts}
    pending: dict[int, list[Tree]] = {m: [] for m in layouts}
    written, live = table, set(layouts)

    def moved(layout: Layout, held: list[Tree], part: np.ndarray, f: np.ndarray) -> np.ndarray:
        """f with the trees that are not written with it yet."""
        f = f.copy()
        for tree in held:
            node = placed(layout, {i: (0.0, j, tree.bin[i]) for i, j in tree.feature.items()}, depth, part)
            values = np.zeros(2 ** (depth + 1) - 1)
            values[list(tree.value)] = list(tree.value.values())
            f += values[node]
        return f

    def placed(layout: Layout, splits: dict[int, tuple], levels: int, part: np.ndarray) -> np.ndarray:
        node = np.zeros(part.shape[1], np.int64)
        for down in range(levels):
            if any(2**down - 1 <= i < 2 ** (down + 1) - 1 for i in splits):
                node = _routed(layout, _turns(layout, splits, down), down, part, node)
        return node

    def level(held: dict[int, list[Tree]], splits: dict[int, dict], down: int) -> list:
        """What the best splits of a level are, by group and node."""
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for m, (part, n, w, y, f) in _chunks(batches, parts):
                if m not in splits:
                    continue
                layout = layouts[m]
                for at in (slice(i, i + BLOCK) for i in range(0, len(n), BLOCK)):
                    own = part[:, at]
                    g, h = derivatives(loss, y[at], moved(layout, held[m], own, f[at]), w[at])
                    made = _sums(layout, own, placed(layout, splits[m], down, own), down, n[at], g, h)
                    total[m] = made if m not in total else [a + b for a, b in zip(total[m], made, strict=True)]
            for m, made in total.items():
                hists = _joined(layouts[m], made, 2**down)
                nodes = [i for i, hist in enumerate(hists) if hist[0].any()]
                yield pa.RecordBatch.from_pydict({"_m": pa.array([m] * len(nodes), pa.int32()), "_node": pa.array(nodes, pa.int32()), "_hist": pa.array([hists[i].tobytes() for i in nodes], pa.binary())})

        def best(own: pa.Table) -> pa.Table:
            m, i = own.column("_m")[0].as_py(), own.column("_node")[0].as_py()
            hist = sum(np.frombuffer(b.as_buffer()).reshape(3, -1) for b in own.column("_hist"))
            beside: dict = {}
            upto = {(2**down + i) // 2 - 1: ()} if down else {}
            hists = np.zeros((i + 1, *hist.shape))
            hists[i] = hist
            found = _level_splits(layouts[m], hists, m, down, upto, beside, least, l2, drawn)
            return pa.table({"said": pa.array([json.dumps([m, node, s, beside[2 * node + 1], beside[2 * node + 2]]) for node, s in found.items()], pa.string())})

        parted = table.mapInArrow(sums, "_m int, _node int, _hist binary")
        return [json.loads(r["said"]) for r in parted.groupBy("_m", "_node").applyInArrow(best, "said string").collect()]

    def medians(held: dict[int, list[Tree]], grown: dict[int, Tree]) -> dict[tuple[int, int], float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for m, (part, n, _, y, f) in _chunks(batches, parts):
                if m not in grown:
                    continue
                rest = y - moved(layouts[m], held[m], part, f)
                leaf = placed(layouts[m], {i: (0.0, j, grown[m].bin[i]) for i, j in grown[m].feature.items()}, depth, part)
                yield pa.RecordBatch.from_pydict({"_m": pa.array(np.full(len(n), m, np.int32)), "_node": pa.array(leaf.astype(np.int32)), "_rest": pa.array(rest)})

        made = table.mapInArrow(run, "_m int, _node int, _rest double").groupBy("_m", "_node").agg(F.median("_rest").alias("v"))
        return {(r["_m"], r["_node"]): r["v"] for r in made.collect()}

    for turn in range(settings["rounds"]):
        held = {m: list(t) for m, t in pending.items()}
        splits: dict[int, dict] = {m: {} for m in live}
        sums: dict[int, dict] = {m: {} for m in live}
        for down in range(depth):
            found = level(held, splits, down)
            for m, node, s, left, right in found:
                splits[m][node], sums[m][2 * node + 1], sums[m][2 * node + 2] = tuple(s), left, right
            if not found:
                break
        live = {m for m in live if splits[m]}
        if not live:
            break
        grown = {m: best_first(splits[m], leaves) for m in live}
        mid = medians(held, grown) if loss == "absolute" else {}
        for m, tree in grown.items():
            for i in tree.value:
                tree.value[i] = rate * (mid[m, i] if loss == "absolute" else -sums[m][i][0] / (sums[m][i][1] + l2))
            trees[m].append(tree), pending[m].append(tree)
        if (turn + 1) % keep == 0 and turn + 1 < settings["rounds"]:
            held = {m: list(t) for m, t in pending.items()}

            def sum_up(batches: Iterator[pa.RecordBatch], held: dict = held) -> Iterator[pa.RecordBatch]:
                for m, (part, *sums_, f) in _chunks(batches, parts):
                    yield _chunk(m, [part, *sums_, moved(layouts[m], held[m], part, f)])

            newer = stored(table.mapInArrow(sum_up, _CHUNK))
            if table is not written:
                discard(table)
            table, pending = newer, {m: [] for m in layouts}
    if table is not written:
        discard(table)
    return trees


def predict(df: DataFrame, model: Model, by: list[str], into: str = "predicted") -> DataFrame:
    """df with its group's prediction (a probability after logistic loss); null without a fit or with a missing feature.

    A function of a few columns: others stay where they are, and those that nobody asks for are never made."""
    lookup, features = model.lookup, model.features
    given = [j for j, c in enumerate(features) if lookup is not None and c in lookup.features]
    own = [j for j in range(len(features)) if j not in given]
    p, known = len(own), None if lookup is None else lookup.of([features[j] for j in given])
    tables = {} if known is None else {m: _binned(known, [e[j] for j in given]) for m, e in model.edges.items()}
    right = None if known is None else np.isfinite(known).all(1)
    edges, base, trees, loss = model.edges, model.base, model.trees, model.loss
    made: dict[int, tuple] = {}

    @F.arrow_udf("double")
    def run(m_: pa.Array, x_: pa.Array, ids_: pa.Array) -> pa.Array:
        m, ids = m_.to_numpy(zero_copy_only=False), ids_.to_numpy(zero_copy_only=False)
        x, there = matrix(x_, p) if p else (np.zeros((len(m), 0)), np.ones(len(m), bool))
        there &= ids >= 0
        if right is not None:
            there[there] = right[ids[there]]
        out = np.full(len(m), np.nan)
        for i in np.unique(m).tolist():
            at = np.flatnonzero((m == i) & there)
            if i < 0 or not len(at):
                continue
            columns = [*([ids[at]] if given else []), *(np.searchsorted(edges[i][j], x[at, c], side="left") for c, j in enumerate(own))]
            f = np.full(len(at), base[i])
            if all(len(t.value) <= 64 for t in trees[i]):
                if i not in made:
                    place = {j: (0, tables[i][:, c]) for c, j in enumerate(given)} | {j: (c + bool(given), np.arange(256)) for c, j in enumerate(own)}
                    made[i] = _masks(trees[i], place, [*([len(known)] if given else []), *[256] * len(own)])
                masks, values = made[i]
                for start in range(0, len(at), 1024):
                    here = slice(start, start + 1024)
                    # before any split: a tree's one leaf is the first bit
                    open_ = np.full((len(trees[i]), len(f[here])), 2**64 - 1, np.uint64)
                    for part, mask in masks.items():
                        open_ &= mask[:, columns[part][here]]
                    leaf = np.frexp((open_ & (~open_ + np.uint64(1))).astype(float))[1] - 1
                    f[here] += np.take_along_axis(values, leaf, 1).sum(0)
            else:
                b = np.zeros((len(at), len(features)), np.uint8)
                if given:
                    b[:, given] = tables[i][ids[at]]
                for c, j in enumerate(own):
                    b[:, j] = columns[c + bool(given)]
                for tree in trees[i]:
                    f += tree.predict(b)
            out[at] = 1 / (1 + np.exp(-f)) if loss == "logistic" else f
        return pa.array(out, mask=np.isnan(out))

    number = F.lit(0) if known is None else F.coalesce(F.col(lookup.column).cast("int"), F.lit(-1))
    x = vector([features[j] for j in own]) if own else F.array(F.lit(0.0))
    names = df.columns
    return _numbered(df, by, model.numbers, "left").select(*names, run(F.coalesce("_m", F.lit(-1)), x, number).alias(into))


def forest(train: DataFrame, test: DataFrame, by: list[str], features: list[str], target: str, weight: str | None = None, trees: int = 250, share: float = 0.7, least: int = 3, depth: int = 8, bins: int = 64, seed: int = 1, into: str = "predicted") -> DataFrame:
    """test with the mean of randomised trees of its group: every tree sees all train rows, and each node tries one drawn cut of
    each of a drawn share of the features. All trees of a level grow in one pass; they are held on the driver."""
    numbered = lambda df: df.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    model = fit(numbered(train), [*by, "_tree"], features, target, weight, rounds=1, rate=1.0, leaves=2**depth, least=least, l2=0.0, bins=bins, depth=depth, drawn=(seed, share))
    rows = test.withColumn("_id", F.monotonically_increasing_id())
    rows = stored(rows)
    made = predict(numbered(rows.select(*by, "_id", *(c for c in features if c not in by))), model, [*by, "_tree"], "_one").groupBy("_id").agg(F.avg("_one").alias(into))
    return rows.join(made, "_id").drop("_id")


def components(train: DataFrame, test: DataFrame, by: list[str], parts: dict[str, tuple[str, list[str]]], panel: str, **settings: object) -> DataFrame:
    """test with a column for each part: a forest of its (target, features), panels weighing the same as each other."""
    weighted = train.withColumn("_weight", 1 / F.count(F.lit(1)).over(Window.partitionBy(*by, panel)))
    weighted, out = stored(weighted), test
    for name, (target, features) in parts.items():
        out = stored(forest(weighted, out, by, features, target, "_weight", into=name, **settings))
    return out
