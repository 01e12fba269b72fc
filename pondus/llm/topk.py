"""Exact top-k inner products with block-at-a-time pruning.

Vectors become integers, ``floor(256 x)``.  Similar vectors (by nearest pivot) are put next
to each other in cells of bounded bytes, a cell in blocks of ``BLOCK`` vectors, each with the
largest and smallest value of every component.  The sum over components of the larger product
bounds every score within a block.  A query

1. gets a first k-th score from a bounded sample of real vectors,
2. goes only to the cells whose bound reaches it,
3. takes a cell's blocks in order of their bounds, scores each through the block's vectors,
   and stops where the next bound falls below its k-th score.

Bounds only ever discard what can't enter the result, so it is exact.  A cell's vectors reach
one task once; its queries stream past them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import shared, written

K, SCALE = 5, 256
BLOCK = 256
CELL_BYTES = 16 << 20
#: Sampled vectors: the first PIVOTS of them order the cells, all give first k-th scores.
SAMPLE, PIVOTS = 1024, 64
_CHUNK = 256


def _unpack(column, width: int | None = None) -> np.ndarray:
    """Binary int64 vectors as rows of a float64 or, if sums could be inexact, object matrix;
    shorter ones are padded with zeros."""
    rows = [np.frombuffer(v.as_buffer() if isinstance(v, pa.Scalar) else v, np.int64) for v in column]
    width = max([0, *map(len, rows)]) if width is None else width
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :min(width, len(r))] = r[:width]
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers: by float64 while every sum is exact there, else by Python's."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def _integers(batches, pivots: np.ndarray):
    for batch in batches:
        x = [np.floor(SCALE * np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)) for v in batch.column("embedding")]
        v = [np.clip(r, -2.0 ** 62, 2.0 ** 62).astype(np.int64) for r in x]
        near = np.zeros(len(v), np.int32)
        if len(pivots):
            m = np.zeros((len(v), pivots.shape[1]))
            for i, r in enumerate(v):
                m[i, :min(len(r), m.shape[1])] = r[:m.shape[1]]
            near = (m @ pivots.T).argmax(axis=1).astype(np.int32) if len(v) else near
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(near)], ["vec_id", "v", "pivot"])


def _place(batches):
    """The partition is the cell; blocks are runs of its rows."""
    cell, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        block = (np.arange(batch.num_rows) + n) // BLOCK
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), cell, np.int32)), pa.array(block.astype(np.int32)), batch.column("vec_id"), batch.column("v")],
                                         ["cell", "block", "vec_id", "v"])


def _extremes(batches):
    """(cell, high, low): largest and smallest value of each component, 0 included."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        cells, x = batch.column("cell").to_numpy(), _unpack(batch.column("v"))
        for c in np.unique(cells):
            own = x[cells == c]
            high, low = np.maximum(own.max(axis=0), 0), np.minimum(own.min(axis=0), 0)
            if int(c) in found:
                h, l = found[int(c)]
                width = max(len(h), len(high))
                pad = lambda a: np.pad(a, (0, width - len(a)))
                high, low = np.maximum(pad(h), pad(high)), np.minimum(pad(l), pad(low))
            found[int(c)] = high, low
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([h.tobytes() for h, _ in found.values()], pa.binary()),
                                      pa.array([l.tobytes() for _, l in found.values()], pa.binary())], ["cell", "high", "low"])


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of each query's score for each (high, low); rounded up beyond 2**53."""
    q, width = q.astype(np.float64), min(q.shape[1], high.shape[1])
    q, high, low = q[:, :width], high[:, :width].astype(np.float64), low[:, :width].astype(np.float64)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    return np.where(np.abs(bound) < 2 ** 50, bound, bound + np.abs(bound) * 1e-9)


def _route(batches, cells, sample_ids, sample, k):
    """A query row for every cell that its bound can't rule out, with its first k-th score."""
    names, high, low = cells
    for batch in batches:
        ids = batch.column("vec_id").to_numpy()
        for a in range(0, len(ids), _CHUNK):
            part = batch.slice(a, _CHUNK)
            q, own = _unpack(part.column("v")), ids[a:a + _CHUNK]
            least = np.full(len(own), -2 ** 63, np.int64)
            width = min(q.shape[1], sample.shape[1])
            if len(sample_ids) > k:
                s = _exact(q[:, :width], sample[:, :width])
                s[own[:, None] == sample_ids[None, :]] = -2 ** 63
                least = np.partition(s, len(sample_ids) - k, axis=1)[:, len(sample_ids) - k]
            row, cell = np.nonzero(_bounds(q, high, low) >= least[:, None].astype(np.float64) * (1 - np.sign(least)[:, None] * 1e-12))
            yield pa.RecordBatch.from_arrays([pa.array(names[cell].astype(np.int32)), pa.array(np.full(len(row), -1, np.int32)), pa.array(own[row]),
                                              part.column("v").take(pa.array(row)), pa.array(least[row])], ["cell", "block", "vec_id", "v", "least"])


class _Cell:
    """One cell's vectors and blocks; ``search`` is the pruned loop."""

    def __init__(self, ids, vectors):
        self.ids, self.x = np.concatenate(ids), vectors
        starts = np.arange(0, len(self.ids), BLOCK)
        self.high, self.low = (np.stack([f(self.x[a:a + BLOCK]) for a in starts]) for f in (
            lambda b: np.maximum(b.max(axis=0), 0), lambda b: np.minimum(b.min(axis=0), 0)))
        self.most = float(np.abs(self.x.astype(np.float64)).max(initial=0))

    def search(self, ids, q, least, k):
        width = min(q.shape[1], self.x.shape[1])
        q, x = q[:, :width], self.x[:, :width]
        bound = _bounds(q, self.high, self.low)
        order = np.argsort(-bound, axis=1, kind="stable")
        for i in range(len(ids)):
            kth, best_s, best_v = int(least[i]), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for b in order[i]:
                if bound[i, b] < kth:
                    break
                at = slice(b * BLOCK, (b + 1) * BLOCK)
                s, v = _exact(q[i:i + 1], x[at])[0], self.ids[at]
                good = (s >= kth) & (v != ids[i])
                if good.any():
                    best_s, best_v = np.concatenate((best_s, s[good])), np.concatenate((best_v, v[good]))
                    top = np.lexsort((best_v, -best_s))[:k]
                    best_s, best_v = best_s[top], best_v[top]
                    if len(best_s) == k:
                        kth = max(kth, int(best_s[-1]))
            if len(best_s):
                yield ids[i], best_v, best_s


def _search(batches, k):
    """Rows by cell: its vectors first (block >= 0), then its queries."""
    now, cell, ids, raw = None, None, [], []
    for batch in batches:
        cells, blocks, names, least = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "vec_id", "least"))
        cut = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | ((blocks[1:] < 0) != (blocks[:-1] < 0))]) if len(cells) else []
        for a, b in zip(cut, np.r_[cut[1:], len(cells)]):
            part = batch.column("v").slice(a, b - a)
            if cells[a] != now:
                now, cell, ids, raw = cells[a], None, [], []
            if blocks[a] >= 0:
                ids.append(names[a:b])
                raw += [v.as_buffer() for v in part]
                continue
            if cell is None and ids:
                cell, raw = _Cell(ids, _unpack(raw)), []
            for c in range(0, b - a if cell else 0, _CHUNK):
                q = _unpack(part.slice(c, _CHUNK))
                found = list(cell.search(names[a + c:min(b, a + c + _CHUNK)], q, least[a + c:min(b, a + c + _CHUNK)], k))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in found], [len(x[1]) for x in found])),
                                                      pa.array(np.concatenate([x[1] for x in found])), pa.array(np.concatenate([x[2] for x in found]))],
                                                     ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = K, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query, ties to the smaller vec_id.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id.  Vectors that
    are null or hold a null or non-finite component, and rows without a vec_id, take no part.
    Of different lengths, the shorter counts as padded with zeros.  Rows equal in id and vector
    count once; a query never meets its own id.  Fewer than k candidates give fewer rows.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    (packed,) = _integers(sample.combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], sample.schema)], np.zeros((0, 0))) if sample.num_rows else (None,)
    sample_ids = packed.column("vec_id").to_numpy() if packed else np.zeros(0, np.int64)
    sample_v = _unpack(packed.column("v")) if packed else np.zeros((0, 0), np.int64)
    sample_ids, first = np.unique(sample_ids, return_index=True)
    sample_v = sample_v[first]
    pivots = sample_v[:PIVOTS].astype(np.float64)
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12) if len(pivots) else 1.0
    size = valid.agg(F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0))).first()[0]
    cells = max(spark.sparkContext.defaultParallelism, -(-size // cell_bytes))
    axes = shared(spark, pivots)
    placed = written(valid.mapInArrow(lambda it: _integers(it, axes()), "vec_id long, v binary, pivot int").distinct()
                     .repartitionByRange(cells, "pivot", F.xxhash64("vec_id")).mapInArrow(_place, "cell int, block int, vec_id long, v binary"), "cells")
    ends: dict[int, list] = {}
    for r in placed.select("cell", "v").mapInArrow(_extremes, "cell int, high binary, low binary").collect():
        ends.setdefault(r["cell"], []).append((np.frombuffer(r["high"], np.int64), np.frombuffer(r["low"], np.int64)))
    width = max([0, *(len(h) for x in ends.values() for h, _ in x)])
    pad = lambda a: np.pad(a, (0, width - len(a)))
    names = np.array(sorted(ends), np.int64)
    high = np.stack([np.max([pad(h) for h, _ in ends[c]], axis=0) for c in names]) if len(names) else np.zeros((0, 0), np.int64)
    low = np.stack([np.min([pad(l) for _, l in ends[c]], axis=0) for c in names]) if len(names) else np.zeros((0, 0), np.int64)
    plan = shared(spark, ((names, high, low), sample_ids, sample_v))
    routed = placed.filter(is_query).select("vec_id", "v").mapInArrow(lambda it: _route(it, *plan(), k), "cell int, block int, vec_id long, v binary, least long")
    rows = placed.withColumn("least", F.lit(0).cast("long")).unionByName(routed).repartition("cell").sortWithinPartitions("cell", F.col("block") < 0, "block", "vec_id")
    found = rows.mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score long").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The registered query in DuckDB SQL.
SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
