"""Clustering (M16–M21, U8): mixed-type matrix, K-means with k selection, silhouette, Ward.

The matrix of a job is written once as blocks of rows (one binary float64 matrix a row), the
form in which every scan reads it.  Each scan returns sums of a size set by the models (clusters
x features), never rows; samples are bounded parameters.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialise
from . import ml_prep

#: Rows of the sample that a silhouette compares (all pairs of them).
SILHOUETTE_ROWS = 5000
#: Numbers of one block, and of a broadcast table of centres or sampled rows (64 MB).
BLOCK_NUMBERS, MOST_NUMBERS = 1 << 17, 1 << 23
#: Micro-clusters that Ward agglomerates; as many different rows are agglomerated exactly.
MICRO = 5000
#: Numbers of rows that are put in the order of cells at once, and rows of a cell.
CELLED_NUMBERS, CELL_ROWS = 1 << 21, 64
_TILE, _ROWS = 256, 1 << 13


def sent(spark: SparkSession, value) -> Callable[[], object]:
    """A function that gives tasks the broadcast ``value``, whose size the caller has checked."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(packed.value)


def _checked(a: np.ndarray) -> np.ndarray:
    if a.size > MOST_NUMBERS:
        raise ValueError(f"{a.shape[0]} x {a.shape[1]} numbers to broadcast; at most {MOST_NUMBERS}")
    return a


# ---------------------------------------------------------------------------
# Blocks
# ---------------------------------------------------------------------------

def blocks(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x binary): the rows of ``features`` as float64 matrices, written once.  Rows with a null
    or NaN are left out (listwise)."""
    names = list(features)
    size = max(1, BLOCK_NUMBERS // max(1, len(names)))
    cols = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names)]

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]) if batch.num_rows else np.zeros((0, len(names)))
            held.append(x[~np.isnan(x).any(axis=1)])
            n += len(held[-1])
            while n >= size:
                x = np.concatenate(held)
                yield pa.RecordBatch.from_arrays([pa.array([x[:size].tobytes()], pa.binary())], ["x"])
                held, n = [x[size:]], n - size
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["x"])

    return materialise(df.select(*cols).mapInArrow(pack, "x binary"), "blocks")


def _matrices(batches, d: int):
    for batch in batches:
        for b in batch.column("x"):
            yield np.frombuffer(b.as_buffer(), np.float64).reshape(-1, d)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest row of ``c``, squared distance); ties to the smaller number."""
    d = (c * c).sum(1) - 2 * (x @ c.T)
    near = d.argmin(axis=1)
    return near, ((x - c[near]) ** 2).sum(axis=1)


def _halved(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers in the order of cells, where each cell starts).  Cells are halved along their
    longest side until they hold at most ``most`` rows, or equal rows only."""
    order, start, waiting = np.arange(len(x)), [], [(0, len(x))] if len(x) else []
    while waiting:
        a, b = waiting.pop()
        rows = order[a:b]
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        side = int((high - low).argmax())
        if b - a <= most or not high[side] > low[side]:
            start.append(a)
            continue
        v = part[:, side]
        middle = np.partition(v, len(v) // 2)[len(v) // 2]
        left = v < middle if middle > low[side] else v <= middle
        order[a:b] = np.concatenate((rows[left], rows[~left]))
        cut = a + int(left.sum())
        waiting += [(cut, b), (a, cut)]
    return order, np.array(start, np.int64)


def _nearest_of_many(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """As the numbers of :func:`_nearest`, for many centres: rows are compared cell by cell with
    the centres that can be nearest to a point of the cell's box."""
    near, t = np.zeros(len(x), np.int64), np.ascontiguousarray(c.T)
    order, start = _halved(x, CELL_ROWS)
    for a, b in zip(start, np.append(start[1:], len(x))):
        rows = order[a:b]
        part = x[rows]
        below, above = part.min(axis=0)[:, None] - t, t - part.max(axis=0)[:, None]
        outside = np.maximum(np.maximum(below, above), 0)
        farthest = np.maximum(np.abs(below), np.abs(above))  # the box's other side
        bound = (farthest * farthest).sum(axis=0).min()
        some = np.flatnonzero((outside * outside).sum(axis=0) <= bound * (1 + 1e-9) + 1e-12)
        near[rows] = some[_nearest(part, c[some])[0]]
    return near


def cells(table: DataFrame, d: int) -> DataFrame:
    """(x binary, cells binary): the rows of several blocks in the order of small cells, and each
    cell's box, sums, sum of squares and number of rows; written once, read by every round."""
    size = max(1, CELLED_NUMBERS // d)

    def pack(held):
        x = np.concatenate(held)
        order, start = _halved(x, CELL_ROWS)
        x = x[order]
        about = np.column_stack((np.minimum.reduceat(x, start), np.maximum.reduceat(x, start), np.add.reduceat(x, start),
                                 np.add.reduceat((x * x).sum(axis=1), start), np.diff(np.append(start, len(x)))))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([about.tobytes()], pa.binary())], ["x", "cells"])

    def run(batches):
        held, n = [], 0
        for x in _matrices(batches, d):
            held.append(x)
            n += len(x)
            if n >= size:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() < cores:  # of a few large files
        table = table.repartition(cores)
    return materialise(table.mapInArrow(run, "x binary, cells binary"), "cells")


def _with_cells(batches, d: int):
    for batch in batches:
        for x, about in zip(batch.column("x"), batch.column("cells")):
            yield np.frombuffer(x.as_buffer(), np.float64).reshape(-1, d), np.frombuffer(about.as_buffer(), np.float64).reshape(-1, 3 * d + 2)


def _sample(spark: SparkSession, table: DataFrame, d: int, n: int, seed: int, centres: np.ndarray | None = None) -> np.ndarray:
    """``n`` rows without replacement, evenly or in proportion to their squared distance from
    ``centres``: the smallest exponential keys, of a generator seeded by each block."""
    c = sent(spark, centres)

    def pick(batches):
        at = c()
        keys, rows = np.zeros(0), np.zeros((0, d))
        for x in _matrices(batches, d):
            rng = np.random.default_rng([seed, zlib.crc32(x.tobytes()), len(x)])
            weight = np.ones(len(x)) if at is None else _nearest(x, at)[1]
            with np.errstate(divide="ignore"):
                k = rng.exponential(size=len(x)) / weight
            keys, rows = np.concatenate((keys, k)), np.concatenate((rows, x))
            if len(keys) > n:
                few = keys <= np.partition(keys, n - 1)[n - 1]
                keys, rows = keys[few], rows[few]
            order = np.lexsort((*rows.T, keys))[:n]
            order = order[np.isfinite(keys[order])]
            keys, rows = keys[order], rows[order]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([r.tobytes() for r in rows], pa.binary())], ["k", "x"])

    found = table.mapInArrow(pick, "k double, x binary").orderBy("k", "x").limit(n).collect()  # n rows
    return np.array([np.frombuffer(bytes(r["x"]), np.float64) for r in found]).reshape(-1, d)


def _grouped_sums(table: DataFrame, d: int, work: Callable[..., np.ndarray], shape: tuple[int, ...], read=_matrices) -> np.ndarray:
    """The sum over all blocks of ``work(block)``, an array of ``shape``: added per task, then by
    a grouped sum; the driver gets one array."""
    def run(batches):
        total = np.zeros(shape)
        for x in read(batches, d):
            total += work(x)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "v"])

    out = np.zeros(int(np.prod(shape)))
    for r in table.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(shape)


# ---------------------------------------------------------------------------
# M16 matrix
# ---------------------------------------------------------------------------

def cluster_matrix(df: DataFrame, features: Sequence[str], max_levels: int = 20) -> tuple[DataFrame, list[str]]:
    """(``df`` plus one column x0, x1, … per dimension, the names of the dimensions).

    Numeric features get their median where null, others one 0/1 column per level but the
    first (null all zeros; those with one level or more than ``max_levels`` are left out);
    what is still null becomes 0, and every dimension is scaled by its population mean and
    deviation (a constant one to 0).  Medians of all columns come from one kernel pass,
    means and deviations from one aggregate; the rest is a projection with these as literals
    (as subqueries they would be planned again for every use).
    """
    types = dict(df.dtypes)
    features = [f for f in features if f in types]
    if not features:
        raise ValueError("none of the features is a column")
    numeric = [c for c in features if types[c] in ml_prep.NUMERIC or types[c].startswith("decimal") or types[c] == "boolean"]
    others = [c for c in features if c not in numeric]
    levels = {c: lv for c, lv in (ml_prep.category_levels(df, others, max_levels) if others else {}).items() if len(lv) > 1}
    dims = [(c, None) for c in numeric] + [(c, v) for c, lv in levels.items() for v in lv[1:]]
    names = [c if v is None else f"{c}_{v}" for c, v in dims]
    med = ml_prep.medians(df, numeric).first()["m"] if numeric else None  # one row, as the statistics

    def raw(i: int, c: str, v):
        if v is not None:
            return F.coalesce((F.col(f"`{c}`").cast("string") == F.lit(v)).cast("double"), F.lit(0.0))
        x = F.col(f"`{c}`").cast("double")
        return F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0 if med[f"m{i}"] is None else med[f"m{i}"]))

    out = df.withColumns({f"x{i}": raw(i, c, v) for i, (c, v) in enumerate(dims)})
    if not dims:
        return out, names
    stats = out.agg(F.struct(*[f(F.col(f"x{i}")).alias(f"{s}{i}") for i in range(len(dims)) for s, f in (("m", F.avg), ("s", F.stddev_pop))]).alias("s")).first()["s"]
    return out.withColumns({f"x{i}": (F.col(f"x{i}") - F.lit(stats[f"m{i}"]).cast("double")) / F.lit(stats[f"s{i}"] or 1.0) for i in range(len(dims))}), names


# ---------------------------------------------------------------------------
# M18 silhouette
# ---------------------------------------------------------------------------

def silhouettes(spark: SparkSession, sample: np.ndarray, labels: np.ndarray) -> list[float | None]:
    """Mean Euclidean silhouette of the rows of ``sample`` for every column of ``labels``.

    Tasks take tiles of rows against all rows of the (bounded) sample; distances are summed
    per cluster of every column at once.  A row alone in its cluster counts 0; with fewer
    than two clusters, or as many as rows, there is none.
    """
    n = len(sample)
    groups = [np.unique(labels[:, m], return_inverse=True) for m in range(labels.shape[1])]
    able = [m for m, (u, _) in enumerate(groups) if 2 <= len(u) < n]
    if not able:
        return [None] * labels.shape[1]
    _checked(sample)
    parts = sent(spark, (sample, [groups[m][1].reshape(-1) for m in able], [len(groups[m][0]) for m in able]))

    def work(batches):
        x, inverse, sizes = parts()
        hot = [np.eye(k)[g] for g, k in zip(inverse, sizes)]
        counts = [h.sum(axis=0) for h in hot]
        square = (x * x).sum(axis=1)
        for batch in batches:
            out = np.zeros(len(hot))
            for a in batch.column("id").to_numpy():
                rows = slice(a * _TILE, min(n, (a + 1) * _TILE))
                dist = np.sqrt(np.maximum(square[rows, None] - 2 * (x[rows] @ x.T) + square, 0))
                dist[np.arange(dist.shape[0]), np.arange(rows.start, rows.stop)] = 0
                for m, (h, c) in enumerate(zip(hot, counts)):
                    own, total = inverse[m][rows], dist @ h
                    at = np.arange(len(own))
                    inside = total[at, own] / np.maximum(c[own] - 1, 1)
                    mean = total / c
                    mean[at, own] = np.inf
                    near = mean.min(axis=1)
                    s = (near - inside) / np.maximum(np.maximum(near, inside), np.finfo(float).tiny)
                    out[m] += s[c[own] > 1].sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hot))), pa.array(out)], ["m", "s"])

    tiles = -(-n // _TILE)
    found = {r["m"]: r["s"] / n for r in spark.range(0, tiles, 1, tiles).mapInArrow(work, "m long, s double").groupBy("m").agg(F.sum("s").alias("s")).collect()}
    return [found[able.index(m)] if m in able else None for m in range(labels.shape[1])]


def silhouette(df: DataFrame, features: Sequence[str], cluster: str, n: int = SILHOUETTE_ROWS, seed: int = 42) -> float | None:
    """M18 of a labelled table: at most ``n`` of its rows, chosen evenly; rows with a null
    feature or cluster are left out.  Cluster labels are numbers."""
    cols = [*features, cluster]
    table = blocks(df.select(*[F.col(f"`{c}`") for c in cols]), cols)
    s = _sample(df.sparkSession, table, len(cols), n, seed)
    return silhouettes(df.sparkSession, s[:, :-1], s[:, -1:])[0]


# ---------------------------------------------------------------------------
# M17/M19 K-means
# ---------------------------------------------------------------------------

class KMeansModel(NamedTuple):
    """Centres of one start; ``sse`` is the sum of squared distances of all rows."""

    k: int
    start: int
    centres: np.ndarray
    sse: float

    def transform(self, df: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
        """``df`` with the number of the nearest centre; null where a feature is null."""
        c = self.centres

        def nearest(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([s.to_numpy(float) for s in columns]) if len(columns[0]) else np.zeros((0, c.shape[1]))
            whole = ~np.isnan(x).any(axis=1)
            return pd.Series(np.where(whole, _nearest(np.nan_to_num(x), c)[0], 0), dtype="int32").where(pd.Series(whole))

        nearest.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        return df.withColumn(out, F.pandas_udf(nearest, "int")(*[F.col(f"`{f}`").cast("double") for f in features]))


def _candidates(spark: SparkSession, table: DataFrame, d: int, k: int, seed: int, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """k-means|| (Bahmani and others, 2012): candidates drawn in rounds of 2k by their squared
    distance from those so far, and the number of rows nearest to each."""
    c = _sample(spark, table, d, 1, seed)
    for r in range(rounds):
        more = _sample(spark, table, d, 2 * k, seed + 1 + r, c)
        if not len(more):
            break
        c = np.concatenate((c, more))
    c = np.unique(c, axis=0)
    at = sent(spark, _checked(c))
    return c, _grouped_sums(table, d, lambda x: np.bincount(_nearest(x, at())[0], minlength=len(at())).astype(float), (len(c),))


def _plus_plus(c: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ over the weighted candidates; fewer when there are fewer."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(c), p=w / w.sum()))]
    while len(chosen) < min(k, len(c)):
        p = w * _nearest(c, c[chosen])[1]
        if p.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(c), p=p / p.sum())))
    return c[chosen]


def _cluster_sums(x: np.ndarray, about: np.ndarray, c: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per centre of every model its rows' sums, sum of squares and number.  A cell whose box
    lies nearer to one centre than to all others adds its sums; only the rows of cells
    between are compared one by one."""
    d = x.shape[1]
    low, high, sums = about[:, :d], about[:, d:2 * d], about[:, 2 * d:]
    middle, half, rows = (low + high) / 2, (high - low) / 2, about[:, -1].astype(np.int64)
    out = np.zeros((len(c), d + 2))
    score = middle @ c.T - (c * c).sum(axis=1) / 2  # the nearer, the larger
    for a, b in zip(bounds[:-1], bounds[1:]):
        m, s = c[a:b], score[:, a:b]
        own, between = s.argmax(axis=1), np.ones(len(s), bool)
        slack = 1e-12 * (1 + np.abs(s).max(initial=0))
        for j in range(b - a):
            mine = np.flatnonzero(own == j)
            ahead = s[mine, j, None] - s[mine] > half[mine] @ np.abs(m - m[j]).T * (1 + 1e-9) + slack
            ahead[:, j] = True
            mine = mine[ahead.all(axis=1)]
            out[a + j] += sums[mine].sum(axis=0)
            between[mine] = False
        if not between.any():
            continue
        at = np.flatnonzero(np.repeat(between, rows))
        for lo in range(0, len(at), _ROWS):
            y = x[at[lo:lo + _ROWS]].T
            dist = (m * m).sum(axis=1)[:, None] - 2 * (m @ y)
            near, least = np.zeros(y.shape[1], np.int64), dist[0]
            for j in range(1, b - a):
                np.copyto(near, j, where=dist[j] < least)
                np.minimum(least, dist[j], out=least)
            for i, v in enumerate((*y, (y * y).sum(axis=0), None)):
                out[a:b, i] += np.bincount(near, weights=v, minlength=b - a)
    return out


def advance(spark: SparkSession, table: DataFrame, d: int, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One scan of the :func:`cells` for all models: per model the sums and counts of its
    clusters and its SSE."""
    stacked = _checked(np.concatenate(centres))
    bounds = np.cumsum([0, *map(len, centres)])
    at = sent(spark, (stacked, bounds))
    total = _grouped_sums(table, d, lambda block: _cluster_sums(*block, *at()), (len(stacked), d + 2), _with_cells)
    sums, square, n = total[:, :d], total[:, d], total[:, d + 1]
    sse = square - 2 * (sums * stacked).sum(axis=1) + n * (stacked * stacked).sum(axis=1)
    return [(sums[a:b], n[a:b], max(0.0, float(sse[a:b].sum()))) for a, b in zip(bounds[:-1], bounds[1:])]


def lloyd(spark: SparkSession, table: DataFrame, d: int, starts: list[np.ndarray], max_iter: int = 300, tol: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Lloyd's rounds of all models at once: a scan advances every model that still moves.
    ``table`` are :func:`blocks`.

    A model is done when the squared moves of its centres add up to at most ``tol`` (of
    standardised columns) or after ``max_iter`` rounds; an empty cluster keeps its centre.
    The SSE belongs to the final centres (one more scan for all).
    """
    centres, open_, table = [c.copy() for c in starts], list(range(len(starts))), cells(table, d)
    for _ in range(max_iter):
        if not open_:
            break
        still = []
        for i, (sums, n, _) in zip(open_, advance(spark, table, d, [centres[i] for i in open_])):
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[i])
            move, centres[i] = float(((new - centres[i]) ** 2).sum()), new
            if move > tol:
                still.append(i)
        open_ = still
    return [(c, sse) for c, (_, _, sse) in zip(centres, advance(spark, table, d, centres))] if centres else []


def kmeans(df: DataFrame, features: Sequence[str], ks: Sequence[int], starts: int = 10, seed: int = 42,
           max_iter: int = 300, tol: float = 1e-4, sample: int = SILHOUETTE_ROWS) -> list[tuple[KMeansModel, float | None]]:
    """For every k of ``ks`` the best of ``starts`` seedings by SSE, and its silhouette on
    at most ``sample`` rows.  ``features`` are the columns of a scaled matrix; rows with a null
    are left out.  A table with fewer different rows than k gets as many clusters."""
    spark, d = df.sparkSession, len(features)
    table = blocks(df, features)
    c, w = _candidates(spark, table, d, max(ks), seed)
    if not len(c):
        raise ValueError("no complete rows to cluster")
    plan = [(k, s) for k in ks for s in range(starts)]
    found = lloyd(spark, table, d, [_plus_plus(c, w, k, seed + s) for k, s in plan], max_iter, tol)
    models = [KMeansModel(k, s, centres, sse) for (k, s), (centres, sse) in zip(plan, found)]
    best = [min((m for m in models if m.k == k), key=lambda m: (m.sse, m.start)) for k in ks]
    rows = _sample(spark, table, d, sample, seed)
    labels = np.column_stack([_nearest(rows, m.centres)[0] for m in best])
    return list(zip(best, silhouettes(spark, rows, labels)))


# ---------------------------------------------------------------------------
# M21 Ward
# ---------------------------------------------------------------------------

class Features:
    """Clustering features (n, mean) of at most ``limit`` micro-clusters.  A row joins the nearest
    one within ``radius``, else starts its own; when there are too many, the radius grows and
    the features join each other.  Up to ``limit`` different rows each keeps its own."""

    def __init__(self, d: int, limit: int):
        self.n, self.mean, self.radius, self.limit = np.zeros(0), np.zeros((0, d)), 0.0, limit

    def add(self, mean: np.ndarray, n: np.ndarray) -> None:
        mean, at = np.unique(mean, axis=0, return_inverse=True)
        self._join(mean, np.bincount(at.reshape(-1), weights=n, minlength=len(mean)))
        while len(self.n) > self.limit:
            self._grow()
            mean, n = self.mean, self.n
            self.n, self.mean = np.zeros(0), np.zeros((0, mean.shape[1]))
            order = np.argsort(-n, kind="stable")
            self._join(mean[order], n[order])

    def _grow(self) -> None:
        part = self.mean[:: max(1, len(self.mean) // 512)]
        d = np.sqrt(np.maximum((part * part).sum(1)[:, None] - 2 * part @ self.mean.T + (self.mean * self.mean).sum(1), 0))
        d[d <= max(self.radius, 1e-12)] = np.inf
        self.radius = max(2 * self.radius, float(np.median(d.min(axis=1))) if np.isfinite(d.min(axis=1)).any() else 2 * self.radius + 1e-12)

    def _join(self, mean: np.ndarray, n: np.ndarray) -> None:
        for a in range(0, len(mean), _TILE):
            x, w = mean[a:a + _TILE], n[a:a + _TILE]
            # only a mean within the radius of the tile's box can take one of its rows
            away = np.maximum(np.maximum(x.min(axis=0) - self.mean, self.mean - x.max(axis=0)), 0)
            some = np.flatnonzero((away * away).sum(axis=1) <= self.radius ** 2 * (1 + 1e-9))
            if len(some):
                near, d2 = _nearest(x, self.mean[some])
                inside = d2 <= self.radius ** 2
                self._absorb(some[near[inside]], x[inside], w[inside])
                x, w = x[~inside], w[~inside]
            while len(x):  # each turn the first row left becomes a micro-cluster
                inside = ((x - x[0]) ** 2).sum(axis=1) <= self.radius ** 2
                inside[0] = True
                total = w[inside].sum()
                self.mean = np.concatenate((self.mean, (x[inside] * w[inside, None]).sum(axis=0, keepdims=True) / total if inside.sum() > 1 else x[:1]))
                self.n = np.append(self.n, total)
                x, w = x[~inside], w[~inside]

    def _absorb(self, at: np.ndarray, x: np.ndarray, w: np.ndarray) -> None:
        if not len(at):
            return
        own, to = np.unique(at, return_inverse=True)
        step = (x - self.mean[at]) * w[:, None]
        moved = np.column_stack([np.bincount(to, weights=v, minlength=len(own)) for v in step.T])
        self.n[own] += np.bincount(to, weights=w, minlength=len(own))
        self.mean[own] += moved / np.maximum(self.n[own], 1)[:, None]


def ward_labels(mean: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Ward agglomeration of weighted points into ``k`` clusters by nearest-neighbour chains; the
    clusters are numbered in the order of their first point."""
    size, centre = n.astype(float).copy(), mean.astype(float).copy()
    alive = np.ones(len(n), bool)
    merges, chain = [], []

    def cost(i: int) -> np.ndarray:
        c = size * size[i] / (size + size[i]) * ((centre - centre[i]) ** 2).sum(axis=1)
        c[~alive] = np.inf
        c[i] = np.inf
        return c

    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        c = cost(chain[-1])
        j = int(c.argmin())
        if len(chain) > 1 and c[chain[-2]] <= c[j]:
            j = chain[-2]
            i = chain.pop()
            chain.pop()
            a, b = min(i, j), max(i, j)
            merges.append((float(c[j]), len(merges), a, b))
            centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(j)
    parent = np.arange(len(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, _, a, b in sorted(merges)[:max(0, len(n) - k)]:
        parent[root(b)] = root(a)
    roots = np.array([root(i) for i in range(len(n))], int)
    first = {r: i for i, r in enumerate(dict.fromkeys(roots.tolist()))}
    return np.array([first[r] for r in roots.tolist()], np.int32)


def ward(df: DataFrame, features: Sequence[str], k: int = 4, micro: int = MICRO, out: str = "cluster", fan_in: int = 16) -> DataFrame:
    """``df`` with its Ward cluster (0 … k−1; null where a feature is null).

    One scan builds the clustering features of each task, trees of ``fan_in`` merge them, and
    the at most ``micro`` that are left are agglomerated in one task; rows get the cluster of
    their nearest micro-cluster.  With at most ``micro`` different rows this is Ward's method on
    all rows, else on micro-clusters whose radius the data set.  ``features`` are columns of a
    scaled matrix.
    """
    spark, d = df.sparkSession, len(features)
    table = blocks(df, features)
    schema = "part long, n double, mean binary"

    def packed(f: Features, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": part, "n": f.n, "mean": [m.tobytes() for m in f.mean]})

    def build(batches):
        from pyspark import TaskContext
        f = Features(d, micro)
        for x in _matrices(batches, d):
            f.add(x, np.ones(len(x)))
        yield pa.RecordBatch.from_pandas(packed(f, TaskContext.get().partitionId()), preserve_index=False,
                                         schema=pa.schema([("part", pa.int64()), ("n", pa.float64()), ("mean", pa.binary())]))

    def merge(key, group):
        f = Features(d, micro)
        group = group.sort_values(["part", "mean"])
        f.add(np.frombuffer(b"".join(group["mean"]), np.float64).reshape(-1, d), group["n"].to_numpy())
        return packed(f, int(key[0]))

    def finish(group):
        group = group.sort_values("mean").reset_index(drop=True)
        mean = np.frombuffer(b"".join(group["mean"]), np.float64).reshape(-1, d)
        order = np.lexsort(mean.T[::-1])
        return pd.DataFrame({"mean": group["mean"].to_numpy()[order], "cluster": ward_labels(mean[order], group["n"].to_numpy()[order], k)})

    feats = materialise(table.mapInArrow(build, schema), "features")
    while feats.agg(F.count_distinct("part")).first()[0] > 1:  # each round leaves a fan_in-th of the parts
        feats = materialise(feats.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part").applyInPandas(merge, schema), "features")
    found = feats.groupBy(F.lit(0).alias("one")).applyInPandas(finish, "mean binary, cluster int").collect()  # micro rows
    if not found:
        return df.withColumn(out, F.lit(None).cast("int"))
    centres = _checked(np.array([np.frombuffer(bytes(r["mean"]), np.float64) for r in found]))
    labels = np.array([r["cluster"] for r in found], np.int32)
    at = sent(spark, (centres, labels))

    def nearest(*columns: pd.Series) -> pd.Series:
        c, own = at()
        x = np.column_stack([s.to_numpy(float) for s in columns]) if len(columns[0]) else np.zeros((0, d))
        whole = ~np.isnan(x).any(axis=1)
        got = np.zeros(len(x), np.int32)
        got[whole] = own[_nearest_of_many(x[whole], c)]
        return pd.Series(got, dtype="int32").where(pd.Series(whole))

    nearest.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(nearest, "int")(*[F.col(f"`{f}`").cast("double") for f in features]))


# ---------------------------------------------------------------------------
# M20 profile, U8 transposed profile
# ---------------------------------------------------------------------------

def profile(assigned: DataFrame, features: Sequence[str], cluster: str = "prediction") -> DataFrame:
    """Per cluster n, % of rows and the mean of every feature."""
    agg = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"`{c}`").alias(c) for c in features])
    return agg.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a cluster


def transposed(profile_: DataFrame, features: Sequence[str], k: int, cluster: str = "prediction") -> DataFrame:
    """U8: one row per feature (``variable``), one column C0 … C(k−1) per cluster."""
    pairs = [F.struct(F.lit(f).alias("variable"), F.col(f"`{f}`").cast("double").alias("v")) for f in features]
    long = profile_.select(F.col(cluster).alias("_c"), F.explode(F.array(*pairs)).alias("_p")).select("_c", "_p.*")
    return long.groupBy("variable").agg(*[F.max(F.when(F.col("_c") == i, F.col("v"))).alias(f"C{i}") for i in range(k)])
