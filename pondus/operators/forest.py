"""Random forest with reproducible bagging and out-of-bag score (M9).

A row's weight in a tree is a Poisson(1) number from a hash of (row key, tree), so every scan
knows which trees saw a row.  Features are coded by at most 255 thresholds.  A batch of trees
is grown from blocks of distinct (codes, label) with their bagged counts and weights, added up
over the rows of a task before anything is shuffled, then over tasks.  Nodes of more than ``LOCAL`` entries are split level by level from
distributed histograms; smaller ones, in most tables the roots, are finished one node a task, a
whole level at a time in numpy.  Features are drawn per node by a hash of its path, so the trees
don't depend on where a node is grown.

The forest stays a Parquet table of flat trees; scoring broadcasts it in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise
from .clusters import sent

#: Trees of one batch; entries of a node that one task finishes; rows that are bagged at once;
#: entries that a task holds before it passes them on.
BATCH, LOCAL, CHUNK, HELD = 50, 400_000, 1 << 17, 1 << 16
#: Thresholds of a feature; bytes of trees that one broadcast holds.
EDGES, BLOCK_BYTES = 255, 64 << 20

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
_CUTS = np.minimum(_POISSON * 2.0 ** 53, 2.0 ** 53).astype(np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Poisson counts by the leading 16 of 53 bits; 255 where a cut falls between.
_LOW, _HIGH = (np.searchsorted(_CUTS, (np.arange(1 << 16, dtype=np.uint64) << np.uint64(37)) + np.uint64(x), "right") for x in (0, (1 << 37) - 1))
_LEAD = np.where(_LOW == _HIGH, _LOW, 255).astype(np.uint8)
_TILE = 1 << 14


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mult)
    return x ^ (x >> np.uint64(31))


def _salts(trees: np.ndarray, seed: int) -> np.ndarray:
    return _mix(trees.astype(np.uint64) * _GOLD + np.uint64(seed))


def _mixed(row: np.ndarray) -> np.ndarray:
    return _mix(row.view(np.uint64) if row.dtype == np.int64 else row)


def _counts(mixed: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Poisson(1) counts of one tree, in tiles that stay in the processor's cache."""
    out = np.empty(len(mixed), np.uint8)
    for a in range(0, len(mixed), _TILE):
        u = _mix(mixed[a:a + _TILE] ^ salt) >> np.uint64(11)
        c = _LEAD[(u >> np.uint64(37)).astype(np.uint16)]
        between = np.flatnonzero(c == 255)
        c[between] = np.searchsorted(_CUTS, u[between], "right")
        out[a:a + _TILE] = c
    return out


def bag(row: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) counts, rows x trees."""
    mixed = _mixed(row)
    return np.column_stack([_counts(mixed, s) for s in _salts(trees, seed)]) if len(trees) else np.zeros((len(row), 0), np.uint8)


class Tree(NamedTuple):
    """Flat arrays; a leaf has feature −1, the right child stands behind the left one.
    ``code`` sends codes up to it to the left, ``p`` is the weighted share of label 1, ``cover``
    the weight."""

    feature: np.ndarray
    code: np.ndarray
    left: np.ndarray
    p: np.ndarray
    cover: np.ndarray

    def pack(self) -> bytes:
        return b"".join(a.astype(t).tobytes() for a, t in zip(self, _TYPES))

    @classmethod
    def unpack(cls, data: bytes) -> "Tree":
        n, at, out = len(data) // sum(np.dtype(t).itemsize for t in _TYPES), 0, []
        for t in _TYPES:
            out.append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
        return cls(*out)

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while True:
            f = self.feature[at]
            rows = np.flatnonzero(f >= 0)
            if not len(rows):
                return at
            a = at[rows]
            at[rows] = self.left[a] + (codes[rows, f[rows]] > self.code[a])


_TYPES = (np.int16, np.uint8, np.int32, np.float64, np.float64)


# ---------------------------------------------------------------------------
# Splits of many nodes at once
# ---------------------------------------------------------------------------

def _best_codes(node: np.ndarray, code: np.ndarray, n: np.ndarray, w0: np.ndarray, w1: np.ndarray, m: int, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node the best threshold of one feature: (purity, code).  Purity is the sum over both
    children of (w0² + w1²) / w, −inf without a split that leaves ``min_leaf`` rows in each."""
    key, inv = np.unique(node * 256 + code, return_inverse=True)
    inv = inv.reshape(-1)
    node, code = key // 256, key % 256
    sums = [np.bincount(inv, weights=v, minlength=len(key)) for v in (n, w0, w1)]
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    group = np.cumsum(np.concatenate(([False], node[1:] != node[:-1])))
    left, total = [], []
    for v in sums:
        c = np.cumsum(v)
        base = (c[first] - v[first])[group]
        left.append(c - base)
        total.append(np.add.reduceat(v, first)[group])
    (ln, l0, l1), (tn, t0, t1) = left, total
    r0, r1 = np.maximum(t0 - l0, 0), np.maximum(t1 - l1, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = np.nan_to_num((l0 * l0 + l1 * l1) / (l0 + l1)) + np.nan_to_num((r0 * r0 + r1 * r1) / (r0 + r1))
    purity[(ln < min_leaf) | (tn - ln < min_leaf)] = -np.inf
    best = np.maximum.reduceat(purity, first)
    hit = np.flatnonzero(purity == best[group])
    _, at = np.unique(group[hit], return_index=True)
    out, at_code = np.full(m, -np.inf), np.zeros(m, np.int64)
    out[node[first]], at_code[node[first]] = best, code[hit[at]]
    return out, at_code


def _choose(purity: np.ndarray, codes: np.ndarray, h: np.ndarray, mtry: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node (feature, code), feature −1 without a split: the best of the ``mtry`` features that
    come first in the node's draw, else the first one that splits at all."""
    m, p = purity.shape
    draw = _mix(h[:, None] + np.arange(1, p + 1, dtype=np.uint64) * _GOLD)
    rank = np.empty((m, p), np.int64)
    rank[np.arange(m)[:, None], draw.argsort(axis=1)] = np.arange(p)
    among = np.where(rank < mtry, purity, -np.inf)
    feature = among.argmax(axis=1)
    none = ~np.isfinite(among.max(axis=1))
    later = np.where(np.isfinite(purity), rank, p).argmin(axis=1)
    feature = np.where(none, later, feature)
    able = np.isfinite(purity).any(axis=1)
    return np.where(able, feature, -1), codes[np.arange(m), feature]


def _child(h: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(h * np.uint64(2) + np.uint64(1) + right.astype(np.uint64))


def _root(seed: int, tree: int) -> np.ndarray:
    return _mix(np.array([seed], np.uint64) * _GOLD + np.uint64(tree))


def grow(codes: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, h: int, mtry: int, depth: int, min_leaf: int) -> Tree:
    """One (sub)tree in memory, a level at a time."""
    w0, w1 = np.where(y == 0, w, 0.0), np.where(y == 1, w, 0.0)
    node, hashes, out = np.zeros(len(y), np.int64), np.array([h], np.uint64), []
    at, levels = 0, 0
    rows = np.arange(len(y))
    while True:
        m = len(hashes)
        cn, c0, c1 = (np.bincount(node, weights=v[rows], minlength=m) for v in (n, w0, w1))
        feature, code = np.full(m, -1), np.zeros(m, np.int64)
        able = (cn >= 2 * min_leaf) & (c0 > 0) & (c1 > 0) if levels < depth else np.zeros(m, bool)
        if able.any():
            part = able[node]
            rows, node = rows[part], node[part]
            own = np.cumsum(able) - 1
            found = [_best_codes(own[node], codes[rows, f].astype(np.int64), n[rows], w0[rows], w1[rows], int(able.sum()), min_leaf) for f in range(codes.shape[1])]
            feature[able], code[able] = _choose(np.column_stack([a for a, _ in found]), np.column_stack([b for _, b in found]), hashes[able], mtry)
        split = feature >= 0
        left = np.full(m, -1)
        left[split] = at + m + 2 * np.arange(int(split.sum()))
        cover = c0 + c1
        out.append((feature, code, left, np.divide(c1, cover, out=np.zeros(m), where=cover > 0), cover))
        if not split.any():
            return Tree(*(np.concatenate(x) for x in zip(*out)))
        keep = split[node]
        rows, node = rows[keep], node[keep]
        right = codes[rows, feature[node]] > code[node]
        node = 2 * (np.cumsum(split) - 1)[node] + right
        hashes = np.column_stack([_child(hashes[split], np.zeros(1)), _child(hashes[split], np.ones(1))]).ravel()
        at, levels = at + m, levels + 1


def importances_of(t: Tree, p: int) -> np.ndarray:
    """Weighted impurity decreases by feature, as shares of their sum."""
    gini = 2 * t.p * (1 - t.p) * t.cover
    s = np.flatnonzero(t.feature >= 0)
    out = np.bincount(t.feature[s], weights=np.maximum(gini[s] - gini[t.left[s]] - gini[t.left[s] + 1], 0), minlength=p)
    return out / out.sum() if out.sum() > 0 else out


# ---------------------------------------------------------------------------
# Blocks of bagged entries
# ---------------------------------------------------------------------------

def _key(codes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Codes and label as one value a row, in the order of the bytes: a number where they fit."""
    k = codes.shape[1] + 1
    out = np.zeros((len(y), max(8, k)), np.uint8)
    out[:, -k:-1], out[:, -1] = codes, y
    return out.view(">u8").reshape(-1).astype(np.uint64) if k <= 8 else out.view(np.dtype((np.void, k))).reshape(-1)


class _Block(NamedTuple):
    codes: np.ndarray
    y: np.ndarray
    n: np.ndarray
    w: np.ndarray

    def pack(self) -> bytes:
        return b"".join((self.codes.astype(np.uint8).tobytes(), self.y.astype(np.uint8).tobytes(), self.n.astype(np.float64).tobytes(), self.w.astype(np.float64).tobytes()))

    @classmethod
    def unpack(cls, data: bytes, p: int) -> "_Block":
        k = len(data) // (p + 17)
        return cls(np.frombuffer(data, np.uint8, k * p).reshape(k, p), np.frombuffer(data, np.uint8, k, k * p),
                   np.frombuffer(data, np.float64, k, k * (p + 1)), np.frombuffer(data, np.float64, k, k * (p + 9)))

    @classmethod
    def join(cls, blocks: list["_Block"]) -> "_Block":
        return cls(*(np.concatenate(x) for x in zip(*blocks)))

    def rows(self, keep: np.ndarray) -> "_Block":
        return _Block(*(a[keep] for a in self))

    def distinct(self) -> "_Block":
        """Entries of equal codes and label added up, in one order whatever they came in."""
        _, first, inv = np.unique(_key(self.codes, self.y), return_index=True, return_inverse=True)
        inv = inv.reshape(-1)
        return _Block(self.codes[first], self.y[first], np.bincount(inv, weights=self.n), np.bincount(inv, weights=self.w))


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]).astype(np.uint8)


def _edges(table: DataFrame, p: int) -> list[np.ndarray]:
    """Thresholds of every feature: half-way between its values where there are few, else its
    quantiles."""
    cols = [f"x{i}" for i in range(p)]
    few = table.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    small = [c for c in cols if few[c] <= EDGES]
    values = table.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in small]).first() if small else {}  # about EDGES values each
    out = {c: np.array(values[c], float) for c in small if len(values[c]) <= EDGES + 1}
    out = {c: (v[1:] + v[:-1]) / 2 for c, v in out.items()}
    wide = [c for c in cols if c not in out]
    if wide:
        for c, q in zip(wide, table.approxQuantile(wide, [i / (EDGES + 1) for i in range(1, EDGES + 1)], 1e-3)):
            out[c] = np.unique(np.array(q, float))
    return [out[c] for c in cols]


def _frame(batch, p: int) -> tuple[np.ndarray, ...]:
    x = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(p)])
    return x, batch.column("id").to_numpy(), batch.column("y").to_numpy(), batch.column("w").to_numpy()


def _coded(table: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Chunks of rows in the order of (codes, label): codes and label of each different one, where
    it starts, and the rows' ids and weights.  Every batch of trees reads these."""
    p = len(edges)

    def emit(held):
        x, rid, y, w = (np.concatenate(a) for a in zip(*held))
        codes, y = coded(x, edges), y.astype(np.uint8)
        key = _key(codes, y)
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        first = order[start]
        data = (codes[first].tobytes(), y[first].tobytes(), start.astype(np.int32).tobytes(), rid[order].astype(np.int64).tobytes(), w[order].astype(np.float64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in data], ["codes", "y", "start", "id", "w"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(_frame(batch, p))
            n += batch.num_rows
            if n >= CHUNK:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    return table.mapInArrow(run, "codes binary, y binary, start binary, id binary, w binary")


def _bagged(chunks: DataFrame, p: int, trees: range, seed: int) -> DataFrame:
    """(tree, size, block): every tree's entries, added up over the rows of a task while there
    are at most ``HELD`` different ones, so that rows that share codes and label don't add to
    what is written."""
    numbers = np.array(trees)

    def sums(row) -> list[np.ndarray]:
        """codes, y, and per tree the bagged rows and weight of each."""
        codes, y, start, rid, w = (np.frombuffer(b, t) for b, t in zip(row, (np.uint8, np.uint8, np.int32, np.int64, np.float64)))
        mixed, k = _mixed(rid), len(y)
        own = w[start]
        same = bool((np.repeat(own, np.diff(np.append(start, len(w)))) == w).all())  # one weight an entry
        n, wt = np.empty((len(trees), k)), np.empty((len(trees), k))
        for t, salt in enumerate(_salts(numbers, seed)):
            c = _counts(mixed, salt)
            n[t] = np.add.reduceat(c > 0, start, dtype=np.int32)
            wt[t] = np.add.reduceat(c, start, dtype=np.int32) * own if same else np.add.reduceat(c * w, start)
        return [codes.reshape(k, p), y, n, wt]

    def joined(held: list) -> list[np.ndarray]:
        codes, y, n, w = (np.concatenate(a, axis=i) for a, i in zip(zip(*held), (0, 0, 1, 1)))
        _, first, inv = np.unique(_key(codes, y), return_index=True, return_inverse=True)
        inv = inv.reshape(-1)
        return [codes[first], y[first], *(np.stack([np.bincount(inv, weights=r, minlength=len(first)) for r in a]) for a in (n, w))]

    def emit(held: list):
        codes, y, n, w = held[0] if len(held) == 1 else joined(held)
        rows = []
        for t, tree in enumerate(trees):
            some = np.flatnonzero(n[t])
            rows.append((tree, len(some), _Block(codes[some], y[some], n[t][some], w[t][some]).pack()))
        return _blocks(rows)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5))):
                held.append(sums([v.as_buffer() for v in row]))
                size += len(held[-1][1])
                if size > HELD and len(held) > 1:
                    held = [joined(held)]
                    size = len(held[0][1])
                if size > HELD // 2:  # too many different ones to gain much here
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return chunks.mapInArrow(run, "tree int, size long, block binary")


def _blocks(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["tree", "size", "block"])


def _merged(entries: DataFrame, p: int, local: int) -> DataFrame:
    """The entries of trees that look too large for one task, added up over all tasks in slices
    by a hash of codes and label; else ``entries``."""
    most = entries.groupBy("tree").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0
    slices = -(-most // max(1, local))
    if slices <= 1:
        return entries

    def cut(batches):
        for batch in batches:
            for tree, data in zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist()):
                b = _Block.unpack(data, p)
                h = b.y.astype(np.uint64)
                for f in range(p):
                    h = _mix(h * _GOLD + b.codes[:, f])
                at = (h % np.uint64(slices)).astype(np.int64)
                own = np.unique(at)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(own), pa.int32()), pa.array(own, pa.int64()), pa.array([b.rows(at == i).pack() for i in own], pa.binary())],
                                                 ["tree", "slice", "block"])

    def add(key, g):
        b = _Block.join([_Block.unpack(x, p) for x in g["block"]]).distinct()
        return pd.DataFrame({"tree": [int(key[0])], "size": [len(b.y)], "block": [b.pack()]})

    cuts = entries.select("tree", "block").mapInArrow(cut, "tree int, slice long, block binary")
    return materialise(cuts.groupBy("tree", "slice").applyInPandas(add, "tree int, size long, block binary"), "merged")


# ---------------------------------------------------------------------------
# Growing
# ---------------------------------------------------------------------------

class _Top:
    """The splits of nodes too large for one task: (tree, node) -> (feature, code, p, cover); a
    node's children are 2 i and 2 i + 1."""

    def __init__(self):
        self.splits: dict[tuple[int, int], tuple[int, int, float, float]] = {}

    def nodes(self, tree: int, codes: np.ndarray) -> np.ndarray:
        """The lowest node above ``LOCAL`` or below it that each entry has come to."""
        at, out = {1: np.arange(len(codes))}, np.ones(len(codes), np.int64)
        while at:
            node, rows = at.popitem()
            s = self.splits.get((tree, node))
            if s is None:
                out[rows] = node
            else:
                right = codes[rows, s[0]] > s[1]
                at[2 * node], at[2 * node + 1] = rows[~right], rows[right]
        return out

    def path(self, seed: int, tree: int, node: int) -> int:
        h = _root(seed, tree)
        for bit in bin(node)[3:]:
            h = _child(h, np.array([int(bit)]))
        return int(h[0])


def _grow_batch(entries: DataFrame, p: int, trees: range, seed: int, mtry: int, max_depth: int, min_leaf: int, local: int) -> DataFrame:
    """(tree, flat, importance) of a batch of trees."""
    spark = entries.sparkSession
    top, large = _Top(), {(r["tree"], 1) for r in entries.groupBy("tree").agg(F.sum("size").alias("n")).where(F.col("n") > local).collect()}
    level = 0
    while large and level < max_depth:
        at = sent(spark, (top, large))

        def histograms(batches):
            t, open_ = at()
            for batch in batches:
                for tree, data in zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist()):
                    b = _Block.unpack(data, p)
                    node, parts = t.nodes(tree, b.codes), []
                    for i in np.unique(node):
                        if (tree, int(i)) in open_:
                            own = b.rows(node == i)
                            for f in range(p):
                                c = own.codes[:, f].astype(np.int64) * 2 + own.y
                                k = np.bincount(c, minlength=512)
                                s = np.flatnonzero(k)
                                parts.append((np.full(len(s), tree), np.full(len(s), i), np.full(len(s), f), s // 2, s % 2, np.bincount(c, weights=own.n, minlength=512)[s],
                                              np.bincount(c, weights=own.w, minlength=512)[s], k[s]))
                    if parts:
                        cols = [np.concatenate(x) for x in zip(*parts)]
                        kinds = (np.int32, np.int64, np.int32, np.int32, np.int32, float, float, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, kinds)], ["tree", "node", "feature", "code", "y", "n", "w", "size"])

        def choose(key, g):
            t, _ = at()
            tree, node = int(key[0]), int(key[1])
            zero = np.zeros(len(g), np.int64)
            w0, w1 = np.where(g["y"] == 0, g["w"], 0.0), np.where(g["y"] == 1, g["w"], 0.0)
            found = [(np.full(1, -np.inf), np.zeros(1, np.int64))] * p
            for f in g["feature"].unique():
                s = (g["feature"] == f).to_numpy()
                found[f] = _best_codes(zero[s], g["code"].to_numpy(np.int64)[s], g["n"].to_numpy()[s], w0[s], w1[s], 1, min_leaf)
            one = (g["feature"] == g["feature"].iloc[0]).to_numpy()
            c0, c1 = float(w0[one].sum()), float(w1[one].sum())
            feature, code = -1, 0
            if c0 > 0 and c1 > 0:
                h = np.array([t.path(seed, tree, node)], np.uint64)
                a, b = _choose(np.column_stack([x for x, _ in found]), np.column_stack([x for _, x in found]), h, mtry)
                feature, code = int(a[0]), int(b[0])
            own = g[(g["feature"] == feature) & (g["code"] <= code)]["size"].sum()
            return pd.DataFrame([(tree, node, feature, code, c1 / (c0 + c1) if c0 + c1 else 0.0, c0 + c1, int(own), int(g["size"][one].sum() - own))],
                                columns=["tree", "node", "feature", "code", "p", "cover", "left", "right"])

        keys = ["tree", "node", "feature", "code", "y"]
        hist = entries.select("tree", "block").mapInArrow(histograms, "tree int, node long, feature int, code int, y int, n double, w double, size long")
        hist = hist.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("size").alias("size"))
        found = hist.groupBy("tree", "node").applyInPandas(choose, "tree int, node long, feature int, code int, p double, cover double, left long, right long").collect()
        large = set()  # every node of a level holds more than local entries, so there are no more than entries / local
        for r in found:
            if r["feature"] >= 0:
                top.splits[r["tree"], r["node"]] = (r["feature"], r["code"], r["p"], r["cover"])
                large |= {(r["tree"], 2 * r["node"] + i) for i, size in enumerate((r["left"], r["right"])) if size > local}
        level += 1
    at = sent(spark, top)

    def by_node(batches):
        t = at()
        for batch in batches:
            rows = []
            for tree, data in zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist()):
                b = _Block.unpack(data, p)
                node = t.nodes(tree, b.codes)
                rows += [(tree, int(i), b.rows(node == i).pack()) for i in np.unique(node)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                                             ["tree", "node", "block"])

    def finish(key, g):
        tree, node = int(key[0]), int(key[1])
        b = _Block.join([_Block.unpack(x, p) for x in g["block"]]).distinct()
        b = b.rows(b.w > 0)
        flat = grow(b.codes, b.y, b.n, b.w, at().path(seed, tree, node), mtry, max_depth - node.bit_length() + 1, min_leaf)
        return pd.DataFrame({"tree": [tree], "node": [node], "flat": [flat.pack()]})

    def whole(key, g):
        tree, t = int(key[0]), at()
        flat = _assembled(tree, t, dict(zip(g["node"], g["flat"])))
        return pd.DataFrame({"tree": [tree], "flat": [flat.pack()], "importance": [importances_of(flat, p).tobytes()]})

    parts = entries.mapInArrow(by_node, "tree int, node long, block binary")
    grown = parts.repartition(max(1, len(trees)), "tree", "node").groupBy("tree", "node").applyInPandas(finish, "tree int, node long, flat binary")
    return grown.groupBy("tree").applyInPandas(whole, "tree int, flat binary, importance binary")


def _assembled(tree: int, top: _Top, parts: dict[int, bytes]) -> Tree:
    """The top of a tree and its finished parts as one flat tree."""
    if 1 in parts:
        return Tree.unpack(parts[1])
    cols: list[list] = [[], [], [], [], []]
    waiting = [(1, 0)]
    for c in cols:
        c.append(0)
    while waiting:
        node, at = waiting.pop()
        s = top.splits.get((tree, node))
        if s is not None:
            left = len(cols[0])
            for c, v in zip(cols, (s[0], s[1], left, s[2], s[3])):
                c[at] = v
                c += [0, 0]
            waiting += [(2 * node, left), (2 * node + 1, left + 1)]
            continue
        t = Tree.unpack(parts[node])
        shift = len(cols[0]) - 1  # its root goes to ``at``, the others to the end
        moved = [t.feature, t.code, np.where(t.left >= 0, t.left + shift, -1), t.p, t.cover]
        for c, v in zip(cols, moved):
            c[at] = v[0].item()
            c += v[1:].tolist()
    return Tree(*(np.array(c) for c in cols))


# ---------------------------------------------------------------------------
# The forest
# ---------------------------------------------------------------------------

class Forest:
    """A fitted forest: ``trees`` (tree, flat, importance) is a written table."""

    def __init__(self, spark: SparkSession, trees: DataFrame, training: DataFrame, features: Sequence[str], edges: list[np.ndarray], seed: int):
        self.spark, self.trees, self.training, self.features, self.edges, self.seed = spark, trees, training, list(features), edges, seed
        self.sizes = {r["tree"]: r["n"] for r in trees.select("tree", F.octet_length("flat").alias("n")).collect()}

    @property
    def n_trees(self) -> int:
        return len(self.sizes)

    def blocks(self) -> Iterator[list[tuple[int, Tree]]]:
        """The trees, in blocks of about ``BLOCK_BYTES``."""
        group, size = [], 0
        groups = []
        for t in sorted(self.sizes):
            if group and size + self.sizes[t] > BLOCK_BYTES:
                groups.append(group)
                group, size = [], 0
            group.append(t)
            size += self.sizes[t]
        for g in [*groups, group] if group else groups:
            rows = self.trees.where(F.col("tree").between(g[0], g[-1])).select("tree", "flat").orderBy("tree").collect()
            yield [(r["tree"], Tree.unpack(bytes(r["flat"]))) for r in rows]

    def importances(self) -> np.ndarray:
        """Mean decrease of impurity, as in every tree a share of its sum."""
        p = len(self.features)
        total = np.zeros(p)
        for r in self.trees.select("importance").toLocalIterator():
            total += np.frombuffer(bytes(r["importance"]), float)
        return total / total.sum() if total.sum() > 0 else total

    def probability(self, columns: Sequence[Column]) -> Column:
        """The mean over the trees of the share of label 1; null where a feature is null."""
        total = None
        for block in self.blocks():
            part = self._votes(block)(F.lit(0).cast("long"), *columns).getField("s")
            total = part if total is None else total + part
        return F.when(~F.isnan(total), total / self.n_trees)

    def _votes(self, block: list[tuple[int, Tree]], out_of_bag: bool = False):
        at, edges, seed = sent(self.spark, block), self.edges, self.seed

        def votes(rid: pd.Series, *xs: pd.Series) -> pd.DataFrame:
            trees = at()
            x = np.column_stack([s.to_numpy(float) for s in xs]) if len(rid) else np.zeros((0, len(xs)))
            none = np.isnan(x).any(axis=1)
            codes, inv = np.unique(coded(x, edges), axis=0, return_inverse=True)
            inv = inv.reshape(-1)
            leaves = np.column_stack([t.p[t.leaf_of(codes)] for _, t in trees])
            if out_of_bag:
                out = bag(rid.to_numpy(np.int64), np.array([t for t, _ in trees]), seed) == 0
                s, n = (leaves[inv] * out).sum(axis=1), out.sum(axis=1).astype(float)
            else:
                s, n = leaves.sum(axis=1)[inv], np.full(len(x), float(len(trees)))
            return pd.DataFrame({"s": np.where(none, np.nan, s), "n": n})

        votes.__annotations__ = {"rid": pd.Series, "xs": pd.Series, "return": pd.DataFrame}
        return F.pandas_udf(votes, "s double, n double")

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its vector ``features``, plus probability and prediction (as a classifier
        of the ML library)."""
        x = vector_to_array("features")
        out = df.withColumn("_p", self.probability([x[i] for i in range(len(self.features))]))
        return out.withColumns({"probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))), "prediction": (F.col("_p") > 0.5).cast("double")}).drop("_p")

    def out_of_bag(self) -> DataFrame:
        """One row: ``oob_score`` (accuracy), rows, and rows that every tree had in its bag.

        A training row is voted on only by trees whose bag it isn't in (Poisson count 0), by
        their mean probability; rows in every bag don't count."""
        cols = [F.col(f"x{i}") for i in range(len(self.features))]
        s = n = None
        d = self.training
        for i, block in enumerate(self.blocks()):
            d = d.withColumn(f"_v{i}", self._votes(block, True)(F.col("id"), *cols))
            v = F.col(f"_v{i}")
            s, n = (v["s"] if s is None else s + v["s"]), (v["n"] if n is None else n + v["n"])
        hit = ((s / n) > 0.5).cast("int") == F.col("y")
        return d.agg((F.count(F.when((n > 0) & hit, 1)) / F.nullif(F.count(F.when(n > 0, 1)), F.lit(0))).alias("oob_score"),
                     F.count(F.lit(1)).alias("n"), F.count(F.when(n == 0, 1)).alias("n_in_every_bag"))


def fit(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, key: Sequence[str] | None = None, *, n_trees: int = 500,
        max_depth: int = 30, min_leaf: int = 5, seed: int = 42, batch: int = BATCH, local: int = LOCAL) -> Forest:
    """M9: a forest of gini trees on √p features a node.

    Rows with a null feature or label, or a weight that isn't positive, are left out.  ``key``
    identifies a row for bagging; without it rows are numbered once, as the training table is
    written.  ``max_depth`` is at most 60.
    """
    spark, p = df.sparkSession, len(features)
    if not p:
        raise ValueError("a forest needs features")
    rid = F.xxhash64(*[F.col(f"`{k}`") for k in key]) if key else F.monotonically_increasing_id()
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    cols = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    table = df.select(*cols, F.col(f"`{label}`").cast("int").alias("y"), w.alias("w"), rid.alias("id"))
    whole = [F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}") for i in range(p)]
    table = materialise(table.where(F.col("y").isin(0, 1) & (F.col("w") > 0) & _all(whole)), "training")
    edges = _edges(table, p)
    chunks = materialise(_coded(table, edges), "coded")
    mtry, trees = max(1, int(math.sqrt(p))), None
    for a in range(0, n_trees, batch):
        numbers = range(a, min(n_trees, a + batch))
        entries = _merged(materialise(_bagged(chunks, p, numbers, seed), "bag"), p, local)
        part = materialise(_grow_batch(entries, p, numbers, seed, mtry, min(max_depth, 60), min_leaf, local), "trees")
        trees = part if trees is None else trees.unionByName(part)
    return Forest(spark, trees, table, features, edges, seed)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
