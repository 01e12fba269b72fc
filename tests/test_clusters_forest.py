"""K-means, silhouette, Ward and the forest against plain NumPy versions."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pondus.operators import clusters as C, explain as X, forest as R, ml_prep, models
from pondus.plans import model_jobs


def cloud(n=400, d=3, k=4, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 4, (k, d))
    return middle[rng.integers(0, k, n)] + rng.normal(0, 1, (n, d))


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])])).repartition(3)


def plain_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        inside = (labels == own)
        if inside.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, inside].sum() / (inside.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) - {own})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def plain_lloyd(x, c, rounds, tol):
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        done = ((new - c) ** 2).sum() <= tol
        c = new
        if done:
            break
    return c, ((x[:, None] - c[None]) ** 2).sum(-1).min(1).sum()


def test_silhouette_equals_numpy(spark):
    x = np.concatenate([cloud(), cloud()[:30]])  # with copies
    rng = np.random.default_rng(2)
    labels = np.column_stack([rng.integers(0, 3, len(x)), (x[:, 0] > 0).astype(int), np.zeros(len(x), int), np.arange(len(x)), np.r_[np.zeros(len(x) - 1, int), 1]])
    got = C.silhouettes(spark, x, labels)
    assert got[2] is None and got[3] is None
    assert [got[i] for i in (0, 1, 4)] == pytest.approx([plain_silhouette(x, labels[:, i]) for i in (0, 1, 4)], abs=1e-9)
    df = frame(spark, np.column_stack((x, labels[:, 1]))).withColumnRenamed("x3", "c")
    assert C.silhouette(df.unionByName(df.limit(1).withColumn("c", F.lit(None).cast("double"))), ["x0", "x1", "x2"], "c") == pytest.approx(got[1])
    assert -1 <= C.silhouette(df, ["x0", "x1", "x2"], "c", n=50) <= 1
    assert C.silhouettes(spark, np.zeros((6, 2)), np.array([[0], [0], [0], [1], [1], [1]])) == [0.0]


def test_all_models_advance_as_lloyd(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_NUMBERS", 150)
    x = cloud()
    table = C.blocks(frame(spark, x), ["x0", "x1", "x2"])
    assert table.count() >= 8
    starts = [x[i:i + k].copy() for i in (0, 50) for k in (1, 2, 5)]
    starts.append(np.concatenate((x[:2], np.full((1, 3), 1e6))))  # a centre that no row is near
    for (c, sse), start in zip(C.lloyd(spark, table, 3, starts, 40, 1e-8), starts):
        want, total = plain_lloyd(x, start, 40, 1e-8)
        assert np.allclose(c, want, atol=1e-7) and sse == pytest.approx(total)


def test_rounds_compare_only_rows_of_cells_between_centres():
    rng = np.random.default_rng(5)
    x = np.column_stack((rng.normal(0, 1, 20_000), rng.integers(0, 4, 20_000).astype(float)))
    order, start = C._halved(x, 64)
    assert sorted(order) == list(range(len(x))) and np.diff(np.append(start, len(x))).max() <= 64
    y = x[order]
    about = np.column_stack((np.minimum.reduceat(y, start), np.maximum.reduceat(y, start), np.add.reduceat(y, start),
                             np.add.reduceat((y * y).sum(1), start), np.diff(np.append(start, len(y)))))
    centres = [x[:3], x[10:17], np.concatenate((x[:2], x[:1]))]  # the last with equal centres
    got = C._cluster_sums(y, about, np.concatenate(centres), np.cumsum([0, *map(len, centres)]))
    want = []
    for c in centres:
        near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        want += [[*x[near == j].sum(0), (x[near == j] ** 2).sum(), (near == j).sum()] for j in range(len(c))]
    assert np.allclose(got, want)
    bare = y.copy()
    bare[:] = np.nan  # cells of one centre alone are never looked into
    far = np.array([[-1e3, 0.0], [0.0, 1.5], [1e3, 0.0]])
    assert C._cluster_sums(bare, about, far, np.array([0, 3]))[:, -1].tolist() == [0, 20_000, 0]
    order, start = C._halved(np.ones((500, 2)), 64)  # equal rows are one cell
    assert len(order) == 500 and start.tolist() == [0]


def test_kmeans_selects_k(spark):
    x = np.concatenate([np.random.default_rng(i).normal(10 * i, 0.3, (60, 2)) for i in range(3)])
    found = C.kmeans(frame(spark, x), ["x0", "x1"], range(2, 6), starts=3)
    assert [m.k for m, _ in found] == [2, 3, 4, 5] and max(found, key=lambda f: f[1])[0].k == 3
    best = found[1][0]
    assert best.sse == pytest.approx(((x[:, None] - best.centres[None]) ** 2).sum(-1).min(1).sum())
    again = C.kmeans(frame(spark, x), ["x0", "x1"], [3], starts=3)[0][0]
    assert again.sse == pytest.approx(best.sse)
    few = C.kmeans(frame(spark, np.array([[1.0, 1.0], [1.0, 1.0], [2.0, 2.0]])), ["x0", "x1"], [4], starts=2)
    assert len(few[0][0].centres) == 2 and few[0][0].sse == 0
    with pytest.raises(ValueError, match="no complete rows"):
        C.kmeans(frame(spark, x).limit(0), ["x0", "x1"], [2])


def test_cluster_matrix(spark):
    rows = [(1.0, "a", "one", 3, None), (2.0, "b.c", "one", None, None), (None, None, "one", 7, None), (4.0, "a", "one", 9, None), (float("nan"), "d", "one", 9, None)]
    df = spark.createDataFrame(rows, "v double, c string, k string, `n.m` int, e double").withColumn("id", F.col("c"))
    m, names = C.cluster_matrix(df, ["v", "c", "k", "n.m", "e", "absent"])
    assert names == ["v", "n.m", "e", "c_b.c", "c_d"]
    raw = np.array([[1, 3, 0, 0, 0], [2, 8, 0, 1, 0], [2, 7, 0, 0, 0], [4, 9, 0, 0, 0], [2, 9, 0, 0, 1]], float)
    raw[1, 1] = 8.0  # the median of 3, 7, 9, 9
    s = raw.std(0)
    want = (raw - raw.mean(0)) / np.where(s > 0, s, 1)
    got = np.array([[r[f"x{i}"] for i in range(5)] for r in m.collect()])
    assert np.allclose(sorted(got.tolist()), sorted(want.tolist()))
    assert models.kmeans_best(df, ["v", "c", "n.m"], 2, 3, starts=2)[0].where("prediction IS NULL").count() == 0
    assert C.cluster_matrix(df.limit(0), ["v", "c"])[0].count() == 0
    with pytest.raises(ValueError):
        C.cluster_matrix(df, ["absent"])


def plain_ward(x, k):
    groups = {i: [i] for i in range(len(x))}
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
    while len(groups) > k:
        a, b = min(itertools.combinations(groups, 2), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[a] = groups[a] + groups.pop(b)
    return {frozenset(g) for g in groups.values()}


def test_ward_equals_the_plain_method(spark):
    x = cloud(70, 2, 5, seed=4)
    x = np.concatenate((x, x[:10]))  # copies belong together
    df = frame(spark, x).repartition(4)
    for k in (1, 3, 6):
        rows = C.ward(df, ["x0", "x1"], k).collect()
        at = {}
        for r in rows:
            at.setdefault(r["cluster"], set()).add((r["x0"], r["x1"]))
        want = plain_ward(x, k)
        assert {frozenset(v) for v in at.values()} == {frozenset(map(tuple, x[list(g)].tolist())) for g in want}
    assert C.ward(df.limit(0), ["x0", "x1"]).count() == 0


def test_ward_on_micro_clusters(spark):
    x = np.concatenate([np.random.default_rng(i).normal(20 * i, 1, (400, 2)) for i in range(3)])
    out = C.ward(frame(spark, x).repartition(9).withColumn("none", F.lit(1)), ["x0", "x1"], 3, micro=40, fan_in=2)
    sizes = {}
    for r in out.collect():
        sizes.setdefault(r["cluster"], set()).add(round(r["x0"] / 20))
    assert sorted(map(sorted, sizes.values())) == [[0], [1], [2]]
    f = C.Features(2, 40)
    for a in range(0, len(x), 100):
        f.add(x[a:a + 100], np.ones(100))
    assert len(f.n) <= 40 and f.n.sum() == len(x) and np.allclose((f.mean * f.n[:, None]).sum(0), x.sum(0))


def test_rows_meet_only_micro_clusters_near_them(monkeypatch):
    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(20_000, 3)), rng.normal(size=(700, 3))
    compared, plain = [], C._nearest
    monkeypatch.setattr(C, "_nearest", lambda a, b: compared.append(len(a) * len(b)) or plain(a, b))
    assert (C._nearest_of_many(x, c) == plain(x, c)[0]).all()
    assert sum(compared) < len(x) * len(c) / 2
    del compared[:]
    f = C.Features(3, 300)
    f.add(rng.normal(size=(2000, 3)), np.ones(2000))
    del compared[:]
    size = len(f.n)
    f._join(x[np.lexsort(x.T[::-1])], np.ones(len(x)))
    assert f.n.sum() == 22_000 and sum(compared) < len(x) * size
    assert len(C._nearest_of_many(x[:0], c)) == 0


def test_profile_and_its_transpose(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 3.0, 4.0), (1, 5.0, None)], "prediction int, `a.b` double, c double")
    prof = C.profile(df, ["a.b", "c"])
    assert {r["prediction"]: (r["n"], r["a.b"], r["c"]) for r in prof.collect()} == {0: (2, 2.0, 3.0), 1: (1, 5.0, None)}
    got = {r["variable"]: (r["C0"], r["C1"]) for r in C.transposed(prof, ["a.b", "c"], 2).collect()}
    assert got == {"a.b": (2.0, 5.0), "c": (3.0, None)}


# --- forest -------------------------------------------------------------------------------

def labelled(spark, n=500, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randint(0, 20), rng.random(), rng.randint(0, 3)
        rows.append((i, float(a), b, float(c), int((a > 10) ^ (c == 2)) if rng.random() < 0.9 else rng.randint(0, 1), float(rng.randint(0, 4))))
    return spark.createDataFrame(rows, "k long, a double, b double, `c.d` double, y int, w double").repartition(3), rows


FEATURES = ["a", "b", "c.d"]


def test_bags_are_poisson_and_reproducible():
    rows, trees = np.arange(20_000, dtype=np.int64), np.arange(5)
    c = R.bag(rows, trees, 42)
    assert (c == R.bag(rows, trees, 42)).all() and (c[:50] == R.bag(rows[:50], trees, 42)).all() and (c != R.bag(rows, trees, 43)).any()
    for v in range(5):
        assert abs((c == v).mean() - math.exp(-1) / math.factorial(v)) < 0.01
    assert abs(np.corrcoef(c.T.astype(float))[0, 1]) < 0.02


def test_entries_are_added_up_before_they_are_written(spark):
    df = spark.range(0, 300_000, 1, 2).select(F.col("id"), (F.col("id") % 4).cast("double").alias("x0"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit(2.0).alias("w"))
    chunks = R._coded(df, [np.array([0.5, 1.5, 2.5])])
    entries = R._bagged(chunks, 1, range(3), 42)
    rows = entries.collect()
    assert sorted((r["tree"], r["size"]) for r in rows) == [(t, 8) for t in range(3) for _ in range(2)]  # one block a task and tree
    merged = R._merged(entries, 1, 10).collect()
    assert sum(r["size"] for r in merged if r["tree"] == 0) == 8
    c = R.bag(np.arange(300_000, dtype=np.int64), np.arange(3), 42)
    for t in range(3):
        b = R._Block.join([R._Block.unpack(r["block"], 1) for r in merged if r["tree"] == t])
        assert b.n.sum() == (c[:, t] > 0).sum() and b.w.sum() == 2 * c[:, t].sum(dtype=int)
        i = np.flatnonzero((b.codes[:, 0] == 1) & (b.y == 1))[0]
        ids = np.arange(300_000)
        assert b.w[i] == 2 * c[(ids % 4 == 1) & (ids % 3 == 0), t].sum(dtype=int)


def test_entries_of_many_values_and_weights(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.integers(0, 200, (3000, 9)).astype(float), columns=[f"x{i}" for i in range(9)]).assign(id=range(3000), y=rng.integers(0, 2, 3000), w=rng.random(3000) + 0.5)
    pdf = pd.concat([pdf, pdf.assign(w=3.0, id=pdf["id"] + 5000)])  # equal codes, other weights
    chunks = R._coded(spark.createDataFrame(pdf).repartition(2), [np.arange(254) + 0.5] * 9)
    rows = R._merged(R._bagged(chunks, 9, range(2), 1), 9, 500).collect()
    c = R.bag(pdf["id"].to_numpy(np.int64), np.arange(2), 1)
    for t in range(2):
        b = R._Block.join([R._Block.unpack(r["block"], 9) for r in rows if r["tree"] == t])
        assert len(b.y) == len(b.distinct().y) and b.n.sum() == (c[:, t] > 0).sum() and b.w.sum() == pytest.approx((c[:, t] * pdf["w"]).sum())


def plain_split(x, y, w, n, min_leaf):
    """The best gini split over all features by trying every threshold: its purity."""
    best = -np.inf
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            l = x[:, f] <= t
            if n[l].sum() >= min_leaf and n[~l].sum() >= min_leaf:
                best = max(best, sum((w[s & (y == v)].sum()) ** 2 / w[s].sum() for s in (l, ~l) for v in (0, 1)))
    return best


def test_grown_tree_is_greedy_and_consistent():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (300, 3)).astype(np.uint8)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 8)).astype(np.uint8) ^ (rng.random(300) < 0.1)
    w, n = rng.integers(1, 5, 300).astype(float), np.ones(300)
    t = R.grow(x, y, n, w, 7, 3, 30, 5)
    leaf = t.leaf_of(x)
    assert (t.feature[leaf] < 0).all()
    at = {0: np.arange(300)}
    for i in range(len(t.feature)):  # parents stand before their children
        rows = at[i]
        assert t.cover[i] == w[rows].sum() and t.p[i] == pytest.approx(w[rows][y[rows] == 1].sum() / w[rows].sum())
        if t.feature[i] < 0:
            assert (leaf[rows] == i).all()
            continue
        left = x[rows, t.feature[i]] <= t.code[i]
        at[t.left[i]], at[t.left[i] + 1] = rows[left], rows[~left]
        purity = sum(w[s][y[s] == v].sum() ** 2 / w[s].sum() for s in (rows[left], rows[~left]) for v in (0, 1))
        assert purity == pytest.approx(plain_split(x[rows], y[rows], w[rows], n[rows], 5)) and min(left.sum(), (~left).sum()) >= 5
    assert len(R.grow(x[:0], y[:0], n[:0], w[:0], 7, 1, 30, 5).feature) == 1
    assert R.grow(x, y, n, w, 7, 3, 2, 5).leaf_of(x).max() < 7


def trees_of(model):
    return {r["tree"]: bytes(r["flat"]) for r in model.trees.collect()}


def test_trees_do_not_depend_on_where_nodes_are_grown(spark, monkeypatch):
    df, _ = labelled(spark)
    whole = R.fit(df, FEATURES, "y", "w", ["k"], n_trees=6, batch=4)
    monkeypatch.setattr(R, "CHUNK", 100)
    split = R.fit(df.repartition(5), FEATURES, "y", "w", ["k"], n_trees=6, batch=6, local=60)  # several levels from histograms
    codes = R.coded(np.random.default_rng(1).random((400, 3)) * [20, 1, 3], whole.edges)
    for (a, x), (b, y) in zip(sorted(trees_of(whole).items()), sorted(trees_of(split).items())):
        s, t = R.Tree.unpack(x), R.Tree.unpack(y)
        assert a == b and len(s.feature) == len(t.feature) > 20
        assert np.allclose(s.p[s.leaf_of(codes)], t.p[t.leaf_of(codes)]) and sorted(s.cover) == sorted(t.cover)
    assert np.allclose(whole.importances(), split.importances())


def test_out_of_bag_score_by_brute_force(spark, monkeypatch):
    df, rows = labelled(spark)
    model = R.fit(df, FEATURES, "y", "w", ["k"], n_trees=9)
    monkeypatch.setattr(R, "BLOCK_BYTES", 1)  # a block per tree
    got = model.out_of_bag().first()
    used = [r for r in rows if r[5] > 0]
    ids = {r["a"]: r["h"] for r in df.select(F.col("k").alias("a"), F.xxhash64("k").alias("h")).collect()}
    trees = {t: R.Tree.unpack(f) for t, f in trees_of(model).items()}
    hits, voted = 0, 0
    for k, a, b, c, y, _ in used:
        counts = R.bag(np.array([ids[k]], np.int64), np.arange(9), 42)[0]
        code = R.coded(np.array([[a, b, c]]), model.edges)
        p = [t.p[t.leaf_of(code)[0]] for i, t in trees.items() if counts[i] == 0]
        if p:
            voted += 1
            hits += (np.mean(p) > 0.5) == (y == 1)
    assert (got["n"], got["n_in_every_bag"]) == (len(used), len(used) - voted)
    assert got["oob_score"] == pytest.approx(hits / voted) and got["oob_score"] > 0.7
    # a tree's entries are the rows of its bag
    kept = [r for r in used if R.bag(np.array([ids[r[0]]], np.int64), np.array([4]), 42)[0, 0]]
    root = trees[4].cover[0]
    assert root == sum(r[5] * R.bag(np.array([ids[r[0]]], np.int64), np.array([4]), 42)[0, 0] for r in kept)


def test_forest_predicts_and_explains(spark):
    df, rows = labelled(spark)
    imp, model = models.forest(df, FEATURES, "y", n_trees=20, max_depth=8, key=["k"])
    got = {r["variable"]: r["importancia"] for r in imp.collect()}
    assert sum(got.values()) == pytest.approx(1) and got["b"] < min(got["a"], got["c.d"])
    p = {r["k"]: r["p"] for r in df.withColumn("p", model.probability([F.col(f"`{c}`") for c in FEATURES])).collect()}
    assert np.mean([(p[r[0]] > 0.5) == (r[4] == 1) for r in rows]) > 0.85
    assert df.limit(1).withColumn("b", F.lit(None).cast("double")).withColumn("p", model.probability([F.col(f"`{c}`") for c in FEATURES])).first()["p"] is None
    shap = X.tree_shap(df, model, FEATURES, ["k"]).collect()
    assert len(shap) == len(rows) and all(r["fx"] == pytest.approx(p[r["k"]], abs=1e-9) for r in shap)
    assert shap[0].__fields__ == ["k", *FEATURES, *[f"phi_{c}" for c in FEATURES], "base", "fx"]


def test_flat_shap_equals_enumeration():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (250, 4)).astype(np.uint8)
    y = (x[:, 0] + x[:, 1] > 8).astype(np.uint8) ^ (rng.random(250) < 0.2)
    t = R.grow(x, y, np.ones(250), rng.integers(1, 4, 250).astype(float), 3, 2, 6, 4)

    def value(row, subset, i=0):
        f = t.feature[i]
        if f < 0:
            return t.p[i]
        l = int(t.left[i])
        if f in subset:
            return value(row, subset, l + int(row[f] > t.code[i]))
        return (t.cover[l] * value(row, subset, l) + t.cover[l + 1] * value(row, subset, l + 1)) / t.cover[i]

    got = X.flat_shap(x[:12], t, 4, cells=300)
    for row, phi in zip(x[:12], got):
        for i in range(4):
            rest = [j for j in range(4) if j != i]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / math.factorial(4) * (value(row, {*s, i}) - value(row, set(s)))
                       for r in range(4) for s in itertools.combinations(rest, r))
            assert phi[i] == pytest.approx(want, abs=1e-12)


def test_model_job_with_awkward_levels(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a.b", "1.5", "c d", None]), float(rng.randint(0, 9)) if rng.random() < 0.9 else None, rng.choice(["same"])) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, `cat.x` string, v double, s string").withColumn("y", ((F.col("v") > 4) | (F.col("`cat.x`") == "1.5")).cast("int"))
    p = model_jobs.prepare(df, ["cat.x", "v", "s"], "y", ["k"])
    assert p.predictors == ["v", "cat.x_a.b", "cat.x_c d"] and p.left_out == ["s"]
    for kind, options in (("logistic", {}), ("tree", {}), ("forest", {"n_trees": 8, "max_depth": 6})):
        out = model_jobs.fit_and_evaluate(p, kind, **options)
        assert out["auc"].first()[0] > 0.9
        if kind == "forest":
            assert out["oob"].first()["oob_score"] > 0.85
    assert [r[0] for r in ml_prep.medians(df, ["v"]).first()] == [float(np.median([r[2] for r in rows if r[2] is not None]))]
