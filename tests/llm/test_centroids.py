"""Centroid clustering against plain rounds over all vectors."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pondus.llm import centroids as C


def brute(rows, k, rounds, dim):
    """(id, cluster, distance, cluster inertia, inertia, hash) by comparing everything."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cent = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        cent = [[sum(col) // len(own[j]) for col in zip(*own[j])] if j in own else c for j, c in enumerate(cent)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, c in found if c == j) for j in range(len(cent))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, d, c in found), key=repr)


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (6, dim))
    rows = [(i, [float(x) for x in middle[i % 6] + rng.normal(0, .2, dim)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 2)]  # a third of all are one vector
    rows += [(2, rows[2][1]), (None, [0.0] * dim), (2000, None), (2001, []), (2002, [1.0] * (dim - 1)), (2003, [1.0] * (dim - 1) + [None]),
             (2004, [float("nan")] + [1.0] * (dim - 1)), (2005, [float("inf")] + [1.0] * (dim - 1)), (2006, [-3.5] * dim), (2007, [3.5] * dim), (2007, [-3.5] * dim)]
    return rows


@pytest.mark.parametrize("n,dim,k,rounds", [(120, 4, 7, 5), (90, 3, 1, 2), (60, 2, 40, 4), (3, 5, 40, 3)])
def test_equals_plain_rounds(spark, n, dim, k, rounds, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)  # several blocks a partition
    rows = vectors(n, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns(
        {c: F.lit("x") for c in ("id", "v", "cluster", "distance", "label", "key")})
    got = C.cluster(df, k=k, rounds=rounds, dim=dim)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, k, rounds, dim)


def test_only_expired_gaps_are_compared_again():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(1000 * m, 10, (500, 8)) for m in range(4)]).astype(np.int32)
    cent = np.array([[1000 * m] * 8 for m in range(4)], np.int64)
    b = C.Block.first(x, 4)
    _, counts, popped = b.advance(cent, np.zeros(4))
    assert popped == 2000 and counts.tolist() == [500] * 4
    moved = cent + 5
    drift = C._moves(cent, moved)
    loaded = C.Block.load({"x": x.tobytes(), "cluster": b.cluster.tobytes(), "key": b.key.tobytes(), "heap": b.order().tobytes()}, 8, 4)
    assert loaded.advance(moved, drift)[2] == 0  # nothing is near a border
    far = cent.copy()
    far[0] += 300
    drift = drift + C._moves(moved, far)
    popped = loaded.advance(far, drift)[2]
    assert 0 <= popped < 2000 and (loaded.cluster == C.squared(x.astype(np.int64), far).argmin(axis=1)).all()


def test_bounds_hold_through_random_moves():
    rng = np.random.default_rng(5)
    for size in (50, 40_000_000):  # float64 products, and integers
        x = rng.integers(-size, size, (300, 4)).astype(np.int32)
        cent = x[:9].astype(np.int64)
        b, drift, seen = C.Block.first(x, 9), np.zeros(9), 0
        sums, counts = np.zeros((9, 4), np.int64), np.zeros(9, np.int64)
        for _ in range(12):
            m, n, popped = b.advance(cent, drift)
            sums, counts, seen = sums + m, counts + n, seen + popped
            want = ((x[:, None, :].astype(object) - cent[None].astype(object)) ** 2).sum(axis=2).argmin(axis=1)
            assert (b.cluster == want).all()
            assert (counts == np.bincount(want, minlength=9)).all()
            assert all((sums[c] == x[want == c].sum(axis=0)).all() for c in range(9))
            new = cent + rng.integers(-size // 20 - 1, size // 20 + 2, cent.shape)
            drift, cent = drift + C._moves(cent, new), new
        assert seen < 12 * 300


def test_empty_large_and_too_many(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert C.cluster(none).count() == 0 and C.cluster(spark.createDataFrame([(1, None)], none.schema)).count() == 0
    with pytest.raises(Exception, match="fit a long"):
        C.cluster(spark.createDataFrame([(1, [1e20] * 64)], "vec_id long, embedding array<double>")).collect()
    with pytest.raises(ValueError, match="broadcast"):
        C.cluster(none, k=1 << 20)
