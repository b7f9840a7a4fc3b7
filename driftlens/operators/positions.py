"""Rank correlations whose positions are drawn with replacement: a group's positions meet in one row, where its draws are
made and summed up, so that what is shuffled grows with positions and not with replicates."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = ("_c", "_sx", "_sy", "_xx", "_yy", "_xy")


def gathered(ranked: DataFrame, by: list[str], position: str, sides: dict[str, Column]) -> DataFrame:
    """(by, _n, an array a side and part): sums of the ranks _x and _y of the rows that each side's condition takes,
    at each of the group's positions in their order; a row a group."""
    x, y = F.col("_x"), F.col("_y")
    values = dict(zip(PARTS, (F.lit(1.0), x, y, x * x, y * y, x * y), strict=True))
    parts = {f"{s}{k}": F.coalesce(F.sum(F.when(own, v)), F.lit(0.0)) for s, own in sides.items() for k, v in values.items()}
    places = ranked.groupBy(*by, position).agg(*(v.alias(k) for k, v in parts.items()))
    rows = places.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(position, *parts))).alias("_places"))
    return rows.select(*by, F.size("_places").alias("_n"), *(F.col("_places")[k].alias(k) for k in parts))


def draws(texts: list[bytes]) -> np.ndarray:
    """What codes.draw gives for the joined parts."""
    return np.frombuffer(b"".join(md5(t).digest()[:4] for t in texts), dtype=">u4").astype(np.int64)


def _alike(size: np.ndarray, most: int = 200_000) -> Iterator[tuple[int, np.ndarray]]:
    """Places of groups of one size, so many at once that they hold few values."""
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for part in np.array_split(at, -(-len(at) * int(n) // most)):
            yield int(n), part


def replicates(rows: DataFrame, by: list[str], sides: list[str], repeats: int, seed: str, named: bool) -> DataFrame:
    """(by, an array a side): the rank correlation of each replicate, as many positions drawn as the group has; 0 for no
    variance, null for no rows. rows: as of `gathered`. Draws depend on the seed, the replicate and the place, and
    on the group's name if `named` (a column _name)."""
    keep = [rows.schema[c] for c in by]
    schema = T.StructType([*keep, *(T.StructField(s, T.ArrayType(T.DoubleType())) for s in sides)])
    names = [f"{s}{k}" for s in sides for k in PARTS]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[int, list[bytes]] = {}
        shared: dict[int, np.ndarray] = {}

        def taken(n: int, name: str | None) -> np.ndarray:
            """How often each replicate takes each place."""
            if n not in ends:
                ends[n] = [b"|%d|%d" % (r, i) for r in range(repeats) for i in range(n)]
            head = (seed if name is None else f"{seed}|{name}").encode()
            picks = draws([head + e for e in ends[n]]) % n
            return np.bincount(np.repeat(np.arange(repeats), n) * n + picks, minlength=repeats * n).reshape(repeats, n).astype(float)

        for batch in batches:
            size = batch.column("_n").to_numpy()
            start = np.concatenate([[0], np.cumsum(size)])
            flat = np.stack([batch.column(c).flatten().to_numpy() for c in names]) if len(size) else np.zeros((len(names), 0))
            out = np.zeros((len(sides), len(size), repeats))
            empty = np.zeros(out.shape, dtype=bool)
            labels = batch.column("_name").to_pylist() if named else None
            for n, at in _alike(size):
                values = flat[:, start[at][:, None] + np.arange(n)].transpose(1, 2, 0)
                if named:
                    sums = np.stack([taken(n, labels[g]) @ v for g, v in zip(at, values, strict=True)])
                else:
                    if n not in shared:
                        shared[n] = taken(n, None)
                    sums = shared[n] @ values
                c, sx, sy, xx, yy, xy = np.moveaxis(sums.reshape(len(at), repeats, len(sides), 6), (3, 2), (0, 1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    spread = (xx - sx * sx / c) * (yy - sy * sy / c)
                    out[:, at] = np.where(spread > 1e-9, (xy - sx * sy / c) / np.sqrt(np.where(spread > 1e-9, spread, 1.0)), 0.0)
                empty[:, at] = c == 0
            offsets = pa.array(np.arange(len(size) + 1) * repeats, pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(v.ravel(), pa.float64(), mask=m.ravel())) for v, m in zip(out, empty, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *arrays], names=[*by, *sides])

    return rows.mapInArrow(made, schema)


def limits(rows: DataFrame, by: list[str], values: str) -> DataFrame:
    """(by, lower, upper, p) of an array of replicates without nulls: the 2.5 % on each side, and p as in nested.limits."""
    last = F.size("_v") - 1

    def edge(q: float) -> Column:
        at = last * F.lit(q)
        low = F.floor(at).cast("int")
        return F.get("_v", low) + (at - low) * (F.get("_v", F.least(low + 1, last)) - F.get("_v", low))

    sorted_rows = rows.select(*by, F.array_sort(values).alias("_v"))
    return sorted_rows.select(*by, edge(0.025).alias("lower"), edge(0.975).alias("upper"), ((F.size(F.filter("_v", lambda v: v <= 0)) + 1) / (F.size("_v") + 1)).alias("p"))
