"""Tree SHAP (M23/M24): exact against brute-force Shapley enumeration, additive against
the model's own probability."""

import itertools
import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pondus.operators import explain as X
from pondus.plans import bind

FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = bind.PERSON_KEY


def _data(spark):
    li = bind.table(spark, SF_SMALL, "lineitem")
    return li.select(*KEY, *FEATS,
                     ((F.col("l_extendedprice") / F.col("l_quantity") >= 1500)
                      & (F.col("l_discount") >= 0.03)).cast("double").alias("y"))


def _expected(nodes, x, subset):
    """E[f(x) | x_S] by the cover-weighted tree walk (the definition)."""
    by_id = {n["id"]: n for n in nodes}

    def walk(i):
        n = by_id[i]
        if n["leftChild"] < 0:
            s = n["impurityStats"]
            return s[1] / sum(s)
        left, right = by_id[n["leftChild"]], by_id[n["rightChild"]]
        f = n["feature"]
        if f in subset:
            return walk(n["leftChild"] if x[f] <= n["left"][0] else n["rightChild"])
        cl, cr = sum(left["impurityStats"]), sum(right["impurityStats"])
        return (cl * walk(left["id"]) + cr * walk(right["id"])) / (cl + cr)

    return walk(min(by_id))


def _brute_shap(nodes, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for r in range(m):
            for s in itertools.combinations(others, r):
                w = math.factorial(r) * math.factorial(m - r - 1) / math.factorial(m)
                phi[i] += w * (_expected(nodes, x, set(s) | {i}) - _expected(nodes, x, set(s)))
    return phi


def test_tree_shap_exact_and_additive(spark):
    d = _data(spark)
    explained, model = X.explain_tree_model(d, FEATS, "y", KEY, max_depth=4, min_leaf=20)
    assert model.depth >= 2  # the target has structure the tree must find
    rows = explained.orderBy(*KEY).limit(25).collect()
    nodes = X.tree_nodes(spark, model)
    for r in rows:
        x = np.array([r[c] for c in FEATS])
        brute = _brute_shap(nodes, x, len(FEATS))
        got = np.array([r[f"phi_{c}"] for c in FEATS])
        assert np.allclose(got, brute, atol=1e-12), (got, brute)
        assert abs(r["base"] - _expected(nodes, x, set())) < 1e-12
    # additivity against Spark's probability on every row
    vec = VectorAssembler(inputCols=FEATS, outputCol="features").transform(d)
    prob = model.transform(vec).select(*KEY, *FEATS, vector_to_array("probability")[1].alias("p1"))
    # the 4-column key has one duplicate at this scale: join on the features too
    worst = explained.join(prob, KEY + FEATS).agg(F.max(F.abs(F.col("fx") - F.col("p1")))).first()[0]
    assert worst < 1e-9
    assert explained.count() == d.count()


def test_shap_long_and_importance(spark):
    d = _data(spark)
    explained, _ = X.explain_tree_model(d, FEATS, "y", KEY, max_depth=3, min_leaf=20)
    long = X.shap_long(explained, FEATS, KEY)
    assert long.count() == len(FEATS) * d.count()
    imp = X.shap_importance(long).collect()
    assert abs(sum(r["pct"] for r in imp) - 100) < 1e-9
    top = max(imp, key=lambda r: r["mean_abs_phi"])["feature"]
    assert top in ("l_extendedprice", "l_quantity", "l_discount")
