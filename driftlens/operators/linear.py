"""Linear models per group from small sufficient statistics: ridge, elastic net and logistic regression.

Each task reduces its rows to one set of moments a group, about their own mean; sets of different tasks are merged
pairwise, so that no digits of large values are lost and rows are read once and never shuffled. Rows without a
finite target or feature take no part in a fit and get a null prediction."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.operators.storage import cut, stored

#: Numbers of moments a task holds before it hands them on.
HELD = 1 << 22
_MOMENTS = "_n double, _w double, _umean array<double>, _usquares array<double>, _mean array<double>, _scatter array<double>"


@dataclass
class Lookup:
    """Features that a number tells, in a column of rows: row i of `values` has those of number i. As few rows as a driver holds."""

    column: str
    features: list[str]
    values: np.ndarray

    def of(self, features: list[str]) -> np.ndarray:
        return self.values[:, [self.features.index(c) for c in features]]


def vector(features: list[str]) -> Column:
    """The features as one array of doubles."""
    return F.array(*(F.col(c).cast("double") for c in features))


def whole(x: str) -> Column:
    """Whether an array column has only finite numbers."""
    return F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))


def matrix(column: pa.Array, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of p numbers, NaN for null; whether each row is finite) of an array column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, p)
    return flat, np.isfinite(flat).all(1)


def _keyed(by: list[str]) -> Column:
    return F.struct(*by) if by else F.struct(F.lit(1).alias("one"))


def _merge(a: tuple, b: tuple) -> tuple:
    """Moments (n, w, unweighted mean and squares, weighted mean, weighted products about it) of two sets of rows."""
    n, w = a[0] + b[0], a[1] + b[1]
    du, d = b[2] - a[2], b[4] - a[4]
    return n, w, a[2] + du * b[0] / n, a[3] + b[3] + du * du * a[0] * b[0] / n, a[4] + d * b[1] / w, a[5] + b[5] + np.outer(d, d) * (a[1] * b[1] / w)


def _of(x: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple:
    total, rows = w.sum(), n.sum()
    mean = (w @ x) / total
    centred = x - mean
    own = (n @ x) / rows
    return float(rows), float(total), own, n @ (x - own) ** 2, mean, (centred * w[:, None]).T @ centred


def moments(df: DataFrame, by: list[str], features: list[str], target: str, weight: str | None = None, lookup: Lookup | None = None, count: str | None = None) -> DataFrame:
    """(by, moments) of the features and, last, the target; weights must be positive. What a lookup tells is put in within the task.

    count: how many rows of equal features a row stands for, with the sum of their weights and the weighted mean of their
    targets; all moments but the target's own square are those of the rows."""
    given = [j for j, c in enumerate(features) if lookup is not None and c in lookup.features]
    own = [j for j in range(len(features) + 1) if j not in given]
    known = None if lookup is None else lookup.of([features[j] for j in given])
    number = F.lit(0) if lookup is None else F.coalesce(F.col(lookup.column).cast("int"), F.lit(-1))
    kept = df.withColumns({"_x": vector([[*features, target][j] for j in own]), "_v": F.lit(1.0) if weight is None else F.col(weight).cast("double"), "_number": number, "_times": F.lit(1.0) if count is None else F.col(count).cast("double")})
    # rows are judged within the task: a filter here would work out costly features twice
    kept = kept.select(F.to_json(_keyed(by)).alias("_key"), *by, "_x", "_v", "_number", "_times")
    p = len(features) + 1

    def full(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x, ok = matrix(batch.column("_x"), len(own))
        if known is None:
            return x, ok
        at, made = batch.column("_number").to_numpy(), np.empty((len(x), p))
        made[:, own], made[:, given] = x, known[at]
        return made, (at >= 0) & np.isfinite(made).all(1)

    schema = pa.schema([("_n", pa.float64()), ("_w", pa.float64()), *((c, pa.list_(pa.float64())) for c in ("_umean", "_usquares", "_mean", "_scatter"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        keys: dict[str, pa.RecordBatch] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for k, m in held.items():
                own = pa.RecordBatch.from_pydict({"_n": [m[0]], "_w": [m[1]], "_umean": [m[2]], "_usquares": [m[3]], "_mean": [m[4]], "_scatter": [m[5].ravel()]}, schema)
                yield pa.RecordBatch.from_arrays([*(keys[k].column(c) for c in ["_key", *by]), *own.columns], ["_key", *by, *schema.names])

        for batch in batches:
            if not batch.num_rows:
                continue
            x, ok = full(batch)
            w, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_v", "_times"))
            ok &= w > 0
            if not ok.all():
                batch, x, w, n = batch.filter(pa.array(ok)), x[ok], w[ok], n[ok]
                if not len(x):
                    continue
            codes = batch.column("_key").dictionary_encode()
            place = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[order], np.arange(len(codes.dictionary) + 1))
            for i, k in enumerate(codes.dictionary.to_pylist()):
                at = order[edges[i] : edges[i + 1]]
                made = _of(x[at], w[at], n[at])
                if k in held:
                    held[k] = _merge(held[k], made)
                else:
                    held[k], keys[k] = made, batch.slice(int(at[0]), 1)
            if len(held) * p * p > HELD:
                yield from out()
                held, keys = {}, {}
        yield from out()

    keyed = "".join(f"{c} {t}, " for c, t in df.select(*by).dtypes)
    parts = kept.mapInArrow(run, "_key string, " + keyed + _MOMENTS)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of a group follow each other; the last group of a batch may go on in the next one."""
        held: tuple | None = None
        row: pa.RecordBatch | None = None

        def out() -> pa.RecordBatch:
            own = pa.RecordBatch.from_pydict({"_n": [held[0]], "_w": [held[1]], "_umean": [held[2]], "_usquares": [held[3]], "_mean": [held[4]], "_scatter": [held[5].ravel()]}, schema)
            return pa.RecordBatch.from_arrays([*(row.column(c) for c in by), *own.columns], [*by, *schema.names])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("_key").to_pylist()
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            part = lambda i: (*(batch.column(c)[i].as_py() for c in ("_n", "_w")), *(batch.column(c)[i].values.to_numpy() for c in ("_umean", "_usquares", "_mean")), batch.column("_scatter")[i].values.to_numpy().reshape(p, p))  # noqa: B023, E731
            start = 0
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                goes_on = a == 0 and held is not None and row.column("_key")[0].as_py() == keys[0]
                if not goes_on and b - a == 1 and b < len(keys):
                    continue  # whole already: handed on as it is with its neighbours
                if not goes_on:
                    if held is not None:
                        yield out()
                        held = None
                    if a > start:
                        yield batch.slice(start, a - start).select([*by, *schema.names])
                    held, row, a = part(a), batch.slice(a, 1), a + 1
                for i in range(a, b):
                    held = _merge(held, part(i))
                start = b
        if held is not None:
            yield out()

    # a row a task and group meets here, not the rows themselves
    parts = parts.repartition(*by).sortWithinPartitions("_key") if by else parts.repartition(1)
    return parts.mapInArrow(merged, keyed + _MOMENTS)


def _solved(stats: DataFrame, by: list[str], p: int, solve: Callable[[float, float, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], standardise: bool) -> DataFrame:
    """(by, _coef, _intercept) where solve(n, w, gram, products, ...) gives the weights of scaled, centred features."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            coef, intercept = [], []
            for n, w, squares, mean, scatter in zip(frame["_n"], frame["_w"], frame["_usquares"], frame["_mean"], frame["_scatter"], strict=True):
                full, mean = np.asarray(scatter, float).reshape(p + 1, p + 1), np.asarray(mean, float)
                sd = np.sqrt(np.asarray(squares, float)[:p] / n) if standardise else np.ones(p)
                sd[sd < 1e-12] = 1.0
                found = solve(n, w, full[:p, :p] / np.outer(sd, sd), full[:p, p] / sd) / sd
                coef.append(found.tolist()), intercept.append(float(mean[p] - found @ mean[:p]))
            made = frame[by].copy()
            made["_coef"], made["_intercept"] = coef, intercept
            yield made

    keyed = "".join(f"{c} {t}, " for c, t in stats.select(*by).dtypes)
    return stats.mapInPandas(run, keyed + "_coef array<double>, _intercept double")


def ridge(df: DataFrame, by: list[str], features: list[str], target: str = "observed", alpha: float = 10.0, weight: str | None = None, standardise: bool = True, lookup: Lookup | None = None, count: str | None = None) -> DataFrame:
    """(by, _coef, _intercept) of ridge regressions with a free intercept; the scale of features is unweighted.

    Weights are scaled to a mean of 1, as a penalty means something only against their size."""
    p = len(features)
    return _solved(moments(df, by, features, target, weight, lookup, count), by, p, lambda n, w, gram, xy: np.linalg.solve(gram * (n / w) + alpha * np.eye(p), xy * (n / w)), standardise)


def _descend(gram: np.ndarray, xy: np.ndarray, n: float, alpha: float, l1: float, tolerance: float, most: int) -> np.ndarray:
    """Weights of least squares / 2n + alpha l1 |w| + alpha (1 - l1) w^2 / 2, a coordinate at a time."""
    gram, xy, w = gram / n, xy / n, np.zeros(len(xy))
    for _ in range(most):
        moved = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            rest = xy[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha * l1, 0.0) / (gram[j, j] + alpha * (1 - l1))
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved <= tolerance * max(1.0, np.abs(w).max(initial=0.0)):
            return w
    raise RuntimeError(f"coordinate steps did not settle within {most} rounds")


def elastic_net(df: DataFrame, by: list[str], features: list[str], target: str = "observed", alpha: float = 0.05, l1: float = 0.2, tolerance: float = 1e-10, most: int = 100_000) -> DataFrame:
    """(by, _coef, _intercept) of elastic nets on standardised features, solved on the Gram matrix."""
    return _solved(moments(df, by, features, target), by, len(features), lambda n, w, gram, xy: _descend(gram, xy, n, alpha, l1, tolerance, most), True)


def linear(features: list[str]) -> Column:
    """intercept + coefficients times features; null where a feature is missing."""
    part = lambda a, b: F.when(F.abs(a) < float("inf"), a * b)
    return F.aggregate(F.zip_with(vector(features), "_coef", part), F.col("_intercept"), lambda s, v: s + v)


def predict(df: DataFrame, fitted: DataFrame, by: list[str], features: list[str], into: str = "predicted", lookup: Lookup | None = None) -> DataFrame:
    """df with the fitted line of its group; null for groups without a fit. What a lookup tells is summed up once a group and number."""
    if lookup is not None:
        given = [j for j, c in enumerate(features) if c in lookup.features]
        own = [j for j in range(len(features)) if j not in given]
        part = lambda a, b: F.when(F.abs(a) < float("inf"), a * b)
        rows = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(lookup.of([features[j] for j in given]).tolist())], f"{lookup.column} int, _known array<double>")
        pick = lambda at: F.array(*(F.get("_coef", F.lit(j)) for j in at)).cast("array<double>")
        base = F.aggregate(F.zip_with("_known", pick(given), part), F.col("_intercept"), lambda s, v: s + v)
        known = fitted.crossJoin(F.broadcast(rows)).select(*by, lookup.column, base.alias("_base"), pick(own).alias("_own"))
        joined = df.join(F.broadcast(known), [*by, lookup.column], "left")
        total = F.col("_base")
        for i, j in enumerate(own):
            total = total + part(F.col(features[j]).cast("double"), F.get("_own", F.lit(i)))
        return joined.select(*df.columns, total.alias(into))
    joined = df.join(fitted, by, "left") if by else df.crossJoin(F.broadcast(fitted))
    return joined.withColumn(into, linear(features)).drop("_coef", "_intercept")


def logistic(df: DataFrame, by: list[str], features: list[str], target: str = "label", c: float = 1.0, balanced: bool = True, tolerance: float = 1e-8, most: int = 60) -> DataFrame:
    """(by, _coef, _intercept, _scaled) of logistic regressions on standardised features, by Newton steps.

    target is 0 or 1. balanced: each class weighs as much as the other. A step is one pass that sums gradient and
    Hessian a group; a step that does not lower the loss is halved. _scaled: coefficients per standard deviation.
    Groups of one class have no fit."""
    p = len(features)
    keyed = "".join(f"{k} {t}, " for k, t in df.select(*by).dtypes)
    rows = stored(df.select(*by, vector([*features, target]).alias("_x"))).filter(whole("_x"))
    y = F.element_at("_x", -1)
    stats = moments(df, by, features, target).select(*by, "_n", "_umean", "_usquares").join(rows.groupBy(*by).agg(F.sum(y).alias("_ones")), by) if by else moments(df, by, features, target).crossJoin(rows.agg(F.sum(y).alias("_ones")))
    stats = stats.filter((F.col("_ones") > 0) & (F.col("_ones") < F.col("_n"))).select(*by, "_n", "_ones", F.slice("_umean", 1, p).alias("_umean"), F.slice("_usquares", 1, p).alias("_usquares"))
    sd = F.transform("_usquares", lambda s: F.when(F.sqrt(s / F.col("_n")) < 1e-12, 1.0).otherwise(F.sqrt(s / F.col("_n"))))
    zero = F.array_repeat(F.lit(0.0), p + 1)
    state = cut(stats.select(*by, "_n", "_ones", "_umean", sd.alias("_sd"), zero.alias("_at"), zero.alias("_step"), F.lit(float("inf")).alias("_loss"), F.lit(False).alias("_done")))
    join = lambda a, b: a.join(b, by) if by else a.crossJoin(b)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for key, own in frame.groupby(by, sort=False, dropna=False) if by else [((), frame)]:
                x = np.stack(own["_x"].to_numpy())
                first = own.iloc[0]
                z = np.column_stack([(x[:, :p] - np.asarray(first["_umean"])) / np.asarray(first["_sd"]), np.ones(len(x))])
                w = np.where(x[:, p] > 0, first["_n"] / (2 * first["_ones"]), first["_n"] / (2 * (first["_n"] - first["_ones"]))) if balanced else np.ones(len(x))
                eta = z @ (np.asarray(first["_at"]) + np.asarray(first["_step"]))
                share = np.where(eta >= 0, 1 / (1 + np.exp(-np.abs(eta))), np.exp(-np.abs(eta)) / (1 + np.exp(-np.abs(eta))))
                loss = float((w * (np.logaddexp(0, eta) - x[:, p] * eta)).sum())
                values = np.concatenate([[loss], z.T @ (w * (share - x[:, p])), ((z * (w * share * (1 - share))[:, None]).T @ z).ravel()])
                out.append((own, values))
            made = pd.concat([own.iloc[:1][by] for own, _ in out], ignore_index=True) if by else pd.DataFrame(index=range(len(out)))
            made["_sums"] = [v.tolist() for _, v in out]
            yield made

    def stepped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        penalty = np.append(np.ones(p), 0.0)
        for frame in frames:
            at, step, loss, done = [], [], [], []
            for r in frame.itertuples():
                values, a, s = np.asarray(r[frame.columns.get_loc("_sums") + 1]), np.asarray(r[frame.columns.get_loc("_at") + 1]), np.asarray(r[frame.columns.get_loc("_step") + 1])
                before, new = r[frame.columns.get_loc("_loss") + 1], a + s
                now = c * values[0] + 0.5 * float((penalty * new * new).sum())
                if now > before + 1e-12 * abs(before):
                    at.append(a), step.append(s / 2), loss.append(before), done.append(bool(np.abs(s).max() < 1e-14))
                    continue
                gradient = c * values[1 : p + 2] + penalty * new
                hessian = c * values[p + 2 :].reshape(p + 1, p + 1) + np.diag(penalty)
                at.append(new), step.append(-np.linalg.solve(hessian, gradient)), loss.append(now), done.append(bool(np.abs(gradient).max() <= tolerance))
            made = frame[[*by, "_n", "_ones", "_umean", "_sd"]].copy()
            made["_at"], made["_step"], made["_loss"], made["_done"] = [v.tolist() for v in at], [v.tolist() for v in step], loss, done
            yield made

    for _ in range(most):
        if state.filter(~F.col("_done")).isEmpty():
            break
        parts = join(rows, state.filter(~F.col("_done"))).mapInPandas(sums, keyed + "_sums array<double>")
        # a row a batch and group: the sums of arrays are taken element by element
        at = parts.select(*by, F.posexplode("_sums").alias("_i", "_s")).groupBy(*by, "_i").agg(F.sum("_s").alias("_s"))
        summed = at.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_s"))), lambda v: v["_s"]).alias("_sums"))
        state = cut(join(state.filter(~F.col("_done")), summed).mapInPandas(stepped, state.schema).unionByName(state.filter("_done")))
    else:
        raise RuntimeError(f"Newton steps did not settle within {most}")
    coef = F.zip_with(F.slice("_at", 1, p), "_sd", lambda a, s: a / s)
    shift = F.aggregate(F.zip_with(coef, "_umean", lambda a, m: a * m), F.lit(0.0), lambda s, v: s + v)
    return state.select(*by, coef.alias("_coef"), (F.element_at("_at", -1) - shift).alias("_intercept"), F.slice("_at", 1, p).alias("_scaled"))


def probability(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def geometry(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, pcs_80pct, pcs_90pct, pcs_95pct, effective_rank): how many principal components of the standardised columns
    hold that share of their variance, and the exponential of the shares' entropy. Constant columns stand for 0.

    One aggregation gives all groups' covariances; the eigenvalues are those of a matrix of the columns alone."""
    p = len(columns) - 1

    def shares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for scatter in frame["_scatter"]:
                full = np.asarray(scatter, float).reshape(p + 1, p + 1)
                sd = np.sqrt(np.maximum(np.diag(full), 0))
                live = sd > 1e-12 * max(1.0, sd.max())
                scaled = np.where(np.outer(live, live), full / np.outer(np.where(live, sd, 1), np.where(live, sd, 1)), 0.0)
                values = np.maximum(np.linalg.eigvalsh(scaled)[::-1], 0)
                if values.sum() <= 0:
                    out.append((None, None, None, None))
                    continue
                share = values / values.sum()
                upto = np.cumsum(share)
                out.append((*(min(int(np.searchsorted(upto, t - 1e-12) + 1), p + 1) for t in (0.8, 0.9, 0.95)), float(np.exp(-(share * np.log(share + 1e-15)).sum()))))
            made = frame[by].copy()
            for i, name in enumerate(("pcs_80pct", "pcs_90pct", "pcs_95pct", "effective_rank")):
                made[name] = pd.Series([v[i] for v in out], index=made.index, dtype="Int64" if i < 3 else "float64")
            yield made

    keyed = "".join(f"{c} {t}, " for c, t in df.select(*by).dtypes)
    return moments(df, by, columns[:-1], columns[-1]).select(*by, "_scatter").mapInPandas(shares, keyed + "pcs_80pct long, pcs_90pct long, pcs_95pct long, effective_rank double")
