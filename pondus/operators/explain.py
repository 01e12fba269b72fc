"""Model explanations over every row.

Tree SHAP (M23) is the path-dependent explanation of a fitted Spark decision tree: the
value of a feature subset S is E[f(x) | x_S], estimated by walking the tree and, at a
split on a feature outside S, averaging both children by their training cover.  For one
leaf l this expectation is a product over the distinct features j on the leaf's path:

    v_l · Π_j (o_j(x) if j ∈ S else z_j)

with o_j(x) = 1 when x takes every branch of the path that tests j (0 otherwise) and
z_j = the product of the cover ratios of those branches.  The Shapley value of a product
game has a closed form, so every row is explained exactly, vectorised over an Arrow
batch: for feature i on the path,

    φ_i += v_l · (o_i − z_i) · Σ_s  s!(p−s−1)!/p! · e_s

where p = number of path features and e_s is the degree-s coefficient of
Π_{j ≠ i} (z_j + o_j·t).  Features off the path get nothing from that leaf.

A forest of :mod:`forest` is explained tree by tree from flat node arrays, all leaves of a tree
at once, in broadcast blocks of trees of bounded size.

The node table of a tree comes from the saved model (its ``data`` Parquet).  It has at most
2^(depth+1) − 1 rows, so its size is bounded by the model parameters, not by the data;
it travels to the executors inside the ``mapInPandas`` closure.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import checkpoint_dir, delete_folder
from . import clusters, forest as forests


def tree_nodes(spark: SparkSession, model) -> list[dict]:
    """Node table of a fitted tree or forest (tree, id, children, split, class stats); as
    large as the model, which the driver holds anyway.  The saved copy is deleted."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/models/tree-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    data = data.select("treeID", "nodeData.*") if "nodeData" in data.columns else data.withColumn("treeID", F.lit(0))
    rows = data.select("treeID", "id", "impurityStats", "leftChild", "rightChild",
                       F.col("split.featureIndex").alias("feature"),
                       F.col("split.leftCategoriesOrThreshold").alias("left"),
                       F.col("split.numCategories").alias("ncat")).collect()
    delete_folder(spark, path)
    return [r.asDict() for r in rows]


def model_leaves(spark: SparkSession, model, positive: int = 1) -> list:
    """The leaves of a tree; of a forest, those of all trees, each tree's values divided by
    their number: Shapley values are linear in the model, and a forest is the mean."""
    trees: dict[int, list[dict]] = {}
    for node in tree_nodes(spark, model):
        trees.setdefault(node["treeID"], []).append(node)
    return [(v / len(trees), feats) for nodes in trees.values() for v, feats in _leaf_paths(nodes, positive)]


def _leaf_paths(nodes: list[dict], positive: int = 1):
    """For every leaf: its class-``positive`` probability and, per distinct feature on the
    path, the list of (test, zero fraction) pairs; ``test`` is (threshold | categories,
    goes_left, is_categorical)."""
    by_id = {n["id"]: n for n in nodes}
    cover = {i: float(sum(n["impurityStats"])) for i, n in by_id.items()}
    root = min(by_id)  # ids are pre-order; the root has the smallest id
    out = []
    stack = [(root, [])]
    while stack:
        nid, path = stack.pop()
        n = by_id[nid]
        if n["leftChild"] < 0:
            stats = n["impurityStats"]
            tot = float(sum(stats))
            v = float(stats[positive]) / tot if tot > 0 and len(stats) > positive else 0.0
            feats: dict[int, list] = {}
            for f, test, frac in path:
                feats.setdefault(f, []).append((test, frac))
            out.append((v, feats))
            continue
        f = int(n["feature"])
        cat = n["ncat"] is not None and n["ncat"] >= 0
        left = list(n["left"]) if cat else float(n["left"][0])
        for child, goes_left in ((n["leftChild"], True), (n["rightChild"], False)):
            frac = cover[child] / cover[nid] if cover[nid] > 0 else 0.0
            stack.append((child, path + [(f, (left, goes_left, cat), frac)]))
    return out


def _follows(x: np.ndarray, test) -> np.ndarray:
    left, goes_left, cat = test
    inside = np.isin(x, left) if cat else (x <= left)
    return inside if goes_left else ~inside


def _shapley_weights(p: int) -> np.ndarray:
    return np.array([math.factorial(s) * math.factorial(p - s - 1) / math.factorial(p)
                     for s in range(p)])


def shap_matrix(x: np.ndarray, leaves) -> tuple[np.ndarray, float]:
    """Exact path-dependent Shapley values for the rows of ``x`` (n × m) and the expected
    value E f = Σ_l v_l Π_j z_j."""
    n, m = x.shape
    phi = np.zeros((n, m))
    base = 0.0
    for v, feats in leaves:
        js = list(feats)
        z = {j: float(np.prod([fr for _, fr in feats[j]])) for j in js}
        base += v * float(np.prod([z[j] for j in js])) if js else v
        if not js or v == 0.0:
            continue
        o = {j: np.logical_and.reduce([_follows(x[:, j], t) for t, _ in feats[j]]).astype(float)
             for j in js}
        p = len(js)
        w = _shapley_weights(p)
        for i in js:
            # polynomial Π_{j≠i} (z_j + o_j t): coefficients e_0..e_{p-1}, one row per degree
            e = np.zeros((p, n))
            e[0] = 1.0
            deg = 0
            for j in js:
                if j == i:
                    continue
                e[1:deg + 2] = e[1:deg + 2] * z[j] + e[0:deg + 1] * o[j]
                e[0] = e[0] * z[j]
                deg += 1
            phi[:, i] += v * (o[i] - z[i]) * (w[:, None] * e).sum(axis=0)
    return phi, base


def flat_boxes(t: forests.Tree, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, z, value) of every leaf of a flat tree, leaves x features: the leaf holds codes
    lo < c <= hi, and z is the product of the cover ratios of the branches that test the feature."""
    n = len(t.feature)
    lo, hi, z = np.full((n, p), -1, np.int16), np.full((n, p), 255, np.int16), np.ones((n, p))
    level = np.zeros(1, np.int64)
    while len(level):
        level = level[t.feature[level] >= 0]
        f, left = t.feature[level], t.left[level].astype(np.int64)
        for child in (left, left + 1):
            lo[child], hi[child], z[child] = lo[level], hi[level], z[level]
            z[child, f] *= t.cover[child] / t.cover[level]
        hi[left, f] = np.minimum(hi[left, f], t.code[level])
        lo[left + 1, f] = np.maximum(lo[left + 1, f], t.code[level])
        level = np.concatenate((left, left + 1))
    leaf = t.feature < 0
    return lo[leaf], hi[leaf], z[leaf], t.p[leaf]


def flat_shap(codes: np.ndarray, t: forests.Tree, p: int, cells: int = 1 << 19) -> np.ndarray:
    """Path-dependent Shapley values of one flat tree, rows x features, all leaves at once.

    The game of a leaf is Π_j (z_j + o_j t) over the features of the tree (one that isn't on its
    path has z = o = 1 and changes nothing).  The product is extended feature by feature;
    for each feature it is then unwound: divided by its factor, from the top where o = 1 and by
    z where o = 0, so no small z is divided by twice."""
    phi = np.zeros((len(codes), p))
    used = np.unique(t.feature[t.feature >= 0]).tolist()
    if not used:
        return phi
    lo, hi, z, value = flat_boxes(t, p)
    q, w = len(used), _shapley_weights(len(used))
    step = max(1, cells // max(1, len(value)))
    for a in range(0, len(codes), step):
        c = codes[a:a + step].astype(np.int16)
        inside = [(c[:, None, f] > lo[:, f]) & (c[:, None, f] <= hi[:, f]) for f in used]
        e = [np.ones((len(c), len(value)))] + [np.zeros((len(c), len(value))) for _ in used]
        for k, (f, o) in enumerate(zip(used, inside)):
            for s in range(k + 1, 0, -1):
                e[s] = e[s] * z[:, f] + np.where(o, e[s - 1], 0.0)
            e[0] = e[0] * z[:, f]
        for f, o in zip(used, inside):
            total, up = np.zeros_like(e[0]), np.zeros_like(e[0])
            for s in range(q - 1, -1, -1):  # o = 1: c_s = e_(s+1) - z c_(s+1)
                up = e[s + 1] - z[:, f] * up
                total += w[s] * np.where(o, up, e[s] / z[:, f])
            phi[a:a + step, f] += (total * (o - z[:, f])) @ value
    return phi


def _forest_shap(df: DataFrame, model: forests.Forest, features: list[str], key: list[str]) -> DataFrame:
    """Sums over the forest's blocks of trees, each broadcast; equal rows of a batch are explained
    once."""
    p, edges, total, base = len(features), model.edges, None, 0.0
    d = df.select(*key, *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    for c in features:
        d = d.where(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`")))

    def explainer(at):
        def explain(*xs: pd.Series) -> pd.Series:
            x = np.column_stack([s.to_numpy(float) for s in xs]) if len(xs[0]) else np.zeros((0, p))
            codes, inv = np.unique(forests.coded(x, edges), axis=0, return_inverse=True)
            phi = np.zeros((len(codes), p))
            for _, t in at():
                phi += flat_shap(codes, t, p)
            return pd.Series(list(phi[inv.reshape(-1)]))

        explain.__annotations__ = {"xs": pd.Series, "return": pd.Series}
        return F.pandas_udf(explain, "array<double>")

    for block in model.blocks():
        base += sum(float(t.p[0]) for _, t in block)
        part = explainer(clusters.sent(df.sparkSession, block))(*[F.col(f"`{c}`") for c in features])
        total = part if total is None else F.zip_with(total, part, lambda a, b: a + b)
    base /= model.n_trees
    d = d.withColumn("_phi", total)
    phi = [F.col("_phi")[i] / model.n_trees for i in range(p)]
    fx = F.lit(base)
    for x in phi:
        fx = fx + x
    return d.select(*key, *[F.col(f"`{c}`") for c in features], *[x.alias(f"phi_{c}") for x, c in zip(phi, features)], F.lit(base).alias("base"), fx.alias("fx"))


def tree_shap(df: DataFrame, model, features: Sequence[str], key: Sequence[str],
              positive: int = 1) -> DataFrame:
    """M23, for a tree or a forest: one row per input row: key, the feature values, ``phi_<feature>`` for class
    ``positive``, the expected value ``base`` and the explained probability ``fx``
    (Σ φ + base = fx exactly).  Rows with a null feature are dropped (listwise, as the
    model was fitted)."""
    feats = list(features)
    keys = list(key)
    if isinstance(model, forests.Forest):
        return _forest_shap(df, model, feats, keys)
    leaves = model_leaves(df.sparkSession, model, positive)
    _, base = shap_matrix(np.zeros((1, len(feats))), leaves)
    d = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in feats]).dropna(subset=feats)
    key_fields = [f for f in d.schema.fields if f.name in keys]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in key_fields]
                       + [f"{c} double" for c in feats]
                       + [f"phi_{c} double" for c in feats] + ["base double", "fx double"])

    def explain(batches):
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype=float)
            phi, b = shap_matrix(x, leaves)
            out = pdf[keys + feats].copy()
            for j, c in enumerate(feats):
                out[f"phi_{c}"] = phi[:, j]
            out["base"] = b
            out["fx"] = b + phi.sum(axis=1)
            yield out

    return d.mapInPandas(explain, schema)


def shap_long(explained: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key, feature, value, phi) — the table behind summary, dependence and
    waterfall views; ``where`` on the key selects one observation."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"),
                      F.col(f"phi_{c}").alias("phi")) for c in features]
    return (explained.select(*key, F.explode(F.array(*pairs)).alias("_p"))
            .select(*key, "_p.feature", "_p.value", "_p.phi"))


def shap_importance(long: DataFrame) -> DataFrame:
    """Mean |φ| per feature and its % of the total (the reference's bar summary)."""
    agg = long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"),
                                      F.count(F.lit(1)).alias("n"))
    return agg.withColumn("pct", 100 * F.col("mean_abs_phi")
                          / F.sum("mean_abs_phi").over(Window.partitionBy()))


def explain_tree_model(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str],
                       weight: str | None = None, max_depth: int = 5, min_leaf: int = 50,
                       seed: int = 42) -> tuple[DataFrame, object]:
    """Fit the M8 tree and explain every row (M23); returns (explained rows, model)."""
    from .models import tree
    _, _, m = tree(df, features, label, weight=weight, max_depth=max_depth,
                   min_leaf=min_leaf, seed=seed)
    return tree_shap(df, m, features, key), m


__all__ = ["tree_nodes", "model_leaves", "shap_matrix", "flat_boxes", "flat_shap", "tree_shap", "shap_long", "shap_importance",
           "explain_tree_model"]
