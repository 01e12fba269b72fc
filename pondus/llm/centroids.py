"""Exact centroid clustering (Lloyd's rounds) with heap-ordered bounds.

Vectors become integers, ``floor(256 x)``, so assignments, sums and centroids are exact.  A
vector's gap is its distance to the second nearest centroid less that to its own.  When
centroids move, no gap of cluster a shrinks by more than the move of a plus the longest move
of another centroid; these sums accumulate per cluster as its drift.  A vector's key is its
gap plus the drift of its cluster when the gap was measured, and each cluster keeps a heap of
its keys, smallest first: while the root's key is above the cluster's drift, no vector of it
can change.  Roots at or below it are popped, compared with all centroids, and pushed into
the heap of the cluster they now belong to.

The vectors are packed into blocks of at most ``BLOCK``, one row of a Parquet table each,
with their heaps.  A round is one pass over the blocks.  A block also states the sums and
counts that popped vectors take from one cluster and bring to another; these are added up per
task, then by a grouped sum, so the driver gets clusters x (components + 1) numbers a round.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import discard, shared, written

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors of one block.
BLOCK = 4096
#: Components beyond this have squared distances beyond a long.
LARGEST = 2 ** 27
#: Numbers that all centroids together may hold (they are broadcast): 32 MB.
MOST_NUMBERS = 1 << 22
_SAFE = 1e-9

_BLOCK = "ids binary, no_id binary, x binary, cluster binary, key binary, heap binary, moved binary, counts binary"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``c``, exact in int64: by float64
    products where no partial sum can pass 2**53, else by integers."""
    most = float(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 2 ** 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        return d.astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def _gaps(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, gap): ties go to the smaller number; the gap is rounded down."""
    near = d.argmin(axis=1)
    if d.shape[1] == 1:
        return near, np.full(len(d), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return near, two[:, 1] - two[:, 0] - _SAFE * (1 + two[:, 1])


class Block:
    """Vectors, their clusters and keys, and the heaps: one list of (key, row) per cluster."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, key: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.x, self.cluster, self.key, self.heaps = x, cluster, key, heaps

    @classmethod
    def first(cls, x: np.ndarray, k: int) -> "Block":
        """Nothing assigned yet: every vector is due."""
        return cls(x, np.full(len(x), -1, np.int32), np.full(len(x), -np.inf), [[] for _ in range(k)])

    @classmethod
    def load(cls, row: dict, dim: int, k: int) -> "Block":
        cluster, key = np.frombuffer(row["cluster"], np.int32).copy(), np.frombuffer(row["key"], np.float64).copy()
        order = np.frombuffer(row["heap"], np.int32)  # the heaps one after another, each in heap order
        heaps, at = [], 0
        for n in np.bincount(cluster, minlength=k):
            part = order[at:at + n]
            heaps.append(list(zip(key[part].tolist(), part.tolist())))
            at += n
        x = np.frombuffer(row["x"], np.int32).reshape(-1, dim)
        return cls(x, cluster, key, heaps)

    def order(self) -> np.ndarray:
        return np.array([i for heap in self.heaps for _, i in heap], np.int32)

    def due(self, drift: np.ndarray) -> np.ndarray:
        """Pop the vectors whose gap has expired."""
        if len(self.cluster) and self.cluster[0] < 0:
            return np.arange(len(self.cluster))
        out = []
        for heap, limit in zip(self.heaps, (drift * (1 + _SAFE) + _SAFE).tolist()):
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def advance(self, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Assign exactly; (sums, counts) moved between the clusters, and vectors popped."""
        due = self.due(drift)
        moved, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        if not len(due):
            return moved, counts, 0
        x, before = self.x[due].astype(np.int64), self.cluster[due]
        now, gap = _gaps(squared(x, centroids))
        self.cluster[due], self.key[due] = now, gap + drift[now]
        for key, c, i in zip(self.key[due].tolist(), now.tolist(), due.tolist()):
            heapq.heappush(self.heaps[c], (key, i))
        change = before != now
        np.add.at(moved, now[change], x[change])
        np.add.at(counts, now[change], 1)
        old = change & (before >= 0)
        np.subtract.at(moved, before[old], x[old])
        np.subtract.at(counts, before[old], 1)
        return moved, counts, len(due)


def integers(values, scale: int = SCALE, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their integer vectors) of an Arrow list column: exactly ``dim`` components,
    none null or non-finite.  A component beyond ``LARGEST`` is an error."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    n = values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(n == dim)
    flat = values.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null component becomes NaN
    good = np.isfinite(x).all(axis=1)
    x = np.floor(scale * x[good])
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"a component beyond {LARGEST} / {scale}: its squared distances don't fit a long")
    return rows[good], x.astype(np.int32)


def _blocks(batches, centroids: np.ndarray, options: tuple[int, int, int]):
    """Pack a partition's vectors into blocks and assign them for the first time."""
    scale, dim, block = options
    ids, xs, held = [], [], 0

    def packed():
        x, i = np.concatenate(xs), pa.concat_arrays(ids)
        none = i.is_null().to_numpy(zero_copy_only=False)
        return x, i.fill_null(0).to_numpy(), none

    for batch in batches:
        rows, x = integers(batch.column("v"), scale, dim)
        ids.append(batch.column("id").take(pa.array(rows)))
        xs.append(x)
        held += len(x)
        while held >= block:
            x, i, none = packed()
            yield _row(Block.first(x[:block], len(centroids)), i[:block], none[:block], centroids, np.zeros(len(centroids)))
            ids, xs, held = [pa.array(i[block:], pa.int64(), mask=none[block:])], [x[block:]], held - block
    if held:
        x, i, none = packed()
        yield _row(Block.first(x, len(centroids)), i, none, centroids, np.zeros(len(centroids)))


def _row(b: Block, ids: np.ndarray, none: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> pa.RecordBatch:
    moved, counts, _ = b.advance(centroids, drift)
    cells = [ids.astype(np.int64), none.astype(bool), b.x, b.cluster, b.key, b.order(), moved, counts]
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], [c.split()[0] for c in _BLOCK.split(", ")])


def _each(batch):
    """One block at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _round(batches, centroids: np.ndarray, drift: np.ndarray):
    k, dim = centroids.shape
    for batch in batches:
        for row in _each(batch):
            yield _row(Block.load(row, dim, k), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["no_id"], bool), centroids, drift)


def _sums(batches, k: int, dim: int):
    """A task's sum of what its blocks move: (cluster, component, sum), component -1 the count."""
    moved, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for batch in batches:
        for m, n in zip(batch.column("moved"), batch.column("counts")):
            moved += np.frombuffer(m.as_buffer(), np.int64).reshape(k, dim)
            counts += np.frombuffer(n.as_buffer(), np.int64)
    both = np.concatenate((counts[:, None], moved), axis=1)
    c, j = np.nonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(j.astype(np.int32) - 1), pa.array(both[c, j])], ["cluster", "component", "n"])


def _distances(batches, centroids: np.ndarray):
    k, dim = centroids.shape
    for batch in batches:
        for row in _each(batch):
            x, cluster = np.frombuffer(row["x"], np.int32).reshape(-1, dim).astype(np.int64), np.frombuffer(row["cluster"], np.int32)
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["no_id"], bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(((x - centroids[cluster]) ** 2).sum(axis=1))], ["vec_id", "cluster", "distance"])


def _moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much every cluster's gaps may shrink, rounded up."""
    far = np.sqrt(((new.astype(object) - old.astype(object)) ** 2).sum(axis=1).astype(np.float64)) * (1 + _SAFE) + _SAFE
    longest = int(far.argmax())
    second = np.delete(far, longest).max(initial=0.0)
    return far + np.where(np.arange(len(far)) == longest, second, far[longest])


def first_centroids(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    """The ``k`` rows with the smallest hash of ``<seed>:<id>``; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    return vectors.orderBy(key, "v").limit(k)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED,
            id_col: str = "vec_id", vector_col: str = "embedding", on_round: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that
    has exactly ``dim`` components, none null or non-finite; other rows take no part.

    Ids are integers; repeated ids are vectors of their own, a null id hashes as ``null`` and
    stays null.  With fewer than ``k`` vectors each is a centroid; an empty table gives no rows.  Ties of distance go
    to the smaller number, empty clusters keep their centroid.  A component beyond
    2**27 / scale in size ends the query with an error, because squared distances would not
    fit a long.  Extra columns are ignored, whatever their names.  ``on_round(number, blocks)``
    sees every written table of blocks.
    """
    if k * dim > MOST_NUMBERS:
        raise ValueError(f"{k} centroids of {dim} components; at most {MOST_NUMBERS} numbers are broadcast")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    whole = rows.filter((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    start = first_centroids(whole, k, seed).select("v").toArrow().column("v")
    centroids = integers(start, scale, dim)[1].astype(np.int64)
    out_schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out_schema)
    k = len(centroids)
    sums, counts, drift = np.zeros((k, dim), object), np.zeros(k, object), np.zeros(k)
    sent = shared(spark, centroids)
    blocks = written(rows.mapInArrow(lambda it, sent=sent: _blocks(it, sent(), (scale, dim, BLOCK)), _BLOCK), "blocks")
    for number in range(rounds):
        if on_round:
            on_round(number, blocks)
        for r in blocks.select("moved", "counts").mapInArrow(lambda it: _sums(it, k, dim), "cluster int, component int, n long").groupBy("cluster", "component").agg(
                F.sum("n").alias("n")).collect():  # k * (dim + 1) numbers
            if r["component"] < 0:
                counts[r["cluster"]] += r["n"]
            else:
                sums[r["cluster"], r["component"]] += r["n"]
        new = np.array([[int(s) // int(n) for s in own] if n else list(old) for own, n, old in zip(sums, counts, centroids)], np.int64)
        drift, centroids = drift + _moves(centroids, new), new
        sent, before = shared(spark, (centroids, drift)), blocks
        blocks = written(before.mapInArrow(lambda it, sent=sent: _round(it, *sent()), _BLOCK), "blocks")
        discard(before)
    if on_round:
        on_round(rounds, blocks)
    sent = shared(spark, centroids)
    out = blocks.select("ids", "no_id", "x", "cluster").mapInArrow(lambda it, sent=sent: _distances(it, sent()), "vec_id long, cluster int, distance long")
    found = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    total = F.lit(sum(found.values()))
    table = spark.createDataFrame([(c, d, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in sorted(found.items())],
                                  "cluster int, cluster_inertia long, centroid_sha256 string")
    return (out.join(F.broadcast(table), "cluster")  # k rows
            .select("vec_id", "cluster", "distance", "cluster_inertia", total.cast("long").alias("inertia"), "centroid_sha256"))


def _sql() -> str:
    """The defaults of :func:`cluster` in DuckDB SQL: one set of CTEs per round."""
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, 'null')), embedding) - 1 AS rid, vec_id, embedding
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT rid, j, floor({SCALE} * embedding[j]::DOUBLE)::BIGINT AS x FROM v, (SELECT unnest(range(1, {DIM + 1})) AS j)),
c0 AS MATERIALIZED (SELECT rid AS cluster, j, x AS c FROM x WHERE rid < {K})"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""d{r} AS (SELECT rid, cluster, sum((x - c) * (x - c))::BIGINT AS distance FROM x JOIN c{r} USING (j) GROUP BY rid, cluster),
a{r} AS MATERIALIZED (SELECT rid, min(distance) AS distance, arg_min(cluster, (distance, cluster)) AS cluster FROM d{r} GROUP BY rid)""")
        if r < ROUNDS:
            parts.append(f"""s{r} AS (SELECT cluster, j, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (rid) GROUP BY cluster, j),
c{r + 1} AS MATERIALIZED (SELECT cluster, j, CASE WHEN n IS NULL THEN c WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS c FROM c{r} LEFT JOIN s{r} USING (cluster, j))""")
    return ",\n".join(parts) + f"""
SELECT vec_id::BIGINT AS vec_id, a.cluster::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (rid) JOIN (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY j)) AS sha FROM c{ROUNDS} GROUP BY cluster) h ON h.cluster = a.cluster
"""


SQL = _sql()
