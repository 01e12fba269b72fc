"""Correlation operators against brute force / pandas."""

import itertools

import numpy as np
import pandas as pd
import pytest

from pondus.functions import dist
from pondus.operators import corr as R


def brute_tau_b(x, y):
    s = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        s += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
    n0 = len(x) * (len(x) - 1) / 2
    tx = sum(c * (c - 1) / 2 for c in pd.Series(x).value_counts())
    ty = sum(c * (c - 1) / 2 for c in pd.Series(y).value_counts())
    return s / np.sqrt((n0 - tx) * (n0 - ty)), s


def test_kendall_grid_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, 700).astype(float)
    y = (x * 0.3 + rng.integers(0, 20, 700)).astype(float)
    x[:200] = 7.0  # heavy tie block
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    r = R.kendall_tau_b(df, "x", "y", buckets=6).first()
    tau, s = brute_tau_b(x, y)
    assert r["s"] == pytest.approx(s)
    assert r["tau_b"] == pytest.approx(tau, rel=1e-12)


@pytest.mark.parametrize("limit", [40, 150])
def test_kendall_recursive_grid_with_hot_values(spark, limit):
    """Forces the bucketed recursion (tiny group limit): continuous values plus a hot x
    value (a third of the rows) and a hot y value, against brute force."""
    rng = np.random.default_rng(17)
    n = 900
    x = np.round(rng.normal(size=n), 2)
    y = np.round(x * 0.5 + rng.normal(size=n), 2)
    x[:300] = 0.5   # hot x
    y[300:420] = -1.0  # hot y
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    r = R.kendall_tau_b(df, "x", "y", buckets=4, group_limit=limit).first()
    tau, s = brute_tau_b(x, y)
    assert r["s"] == pytest.approx(s, abs=1e-6)
    assert r["tau_b"] == pytest.approx(tau, rel=1e-12)


def test_pair_sum_kernel_large_continuous():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=1500), rng.normal(size=1500)
    w = np.ones(1500)
    dx = np.sign(x[:, None] - x[None, :])
    dy = np.sign(y[:, None] - y[None, :])
    assert R._pair_sum(x, y, w) == pytest.approx(np.triu(dx * dy, 1).sum())


def test_spearman_and_pearson_match_pandas(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"a": rng.integers(0, 10, 500).astype(float), "b": rng.normal(size=500)})
    pdf["c"] = pdf.a * 2 + rng.normal(size=500)
    df = spark.createDataFrame(pdf)
    sp = {(r["var1"], r["var2"]): r["r"] for r in R.spearman_long(df, ["a", "b", "c"]).collect()}
    ref = pdf.corr(method="spearman")
    for (a, b), v in sp.items():
        assert v == pytest.approx(ref.loc[a, b], abs=1e-12)
    pe = {(r["var1"], r["var2"]): r["r"] for r in R.pearson_long(df, ["a", "b", "c"]).collect()}
    assert pe[("a", "c")] == pytest.approx(pdf.corr().loc["a", "c"])
    assert pe[("c", "a")] == pe[("a", "c")] and pe[("a", "a")] == 1.0


def test_cronbach_matches_numpy(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=300)
    items = pd.DataFrame({f"i{k}": base + rng.normal(scale=0.7, size=300) for k in range(4)})
    out = {r["item"]: r["alpha"] for r in R.cronbach(spark.createDataFrame(items), list(items)).collect()}
    k = 4
    alpha = k / (k - 1) * (1 - items.var(ddof=1).sum() / items.sum(axis=1).var(ddof=1))
    assert out["(todos)"] == pytest.approx(alpha)
    sub = items.drop(columns="i0")
    a0 = 3 / 2 * (1 - sub.var(ddof=1).sum() / sub.sum(axis=1).var(ddof=1))
    assert out["i0"] == pytest.approx(a0)


def test_p_values(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5, 20), ("a", "c", None, 20)], "var1 string, var2 string, r double, n long")
    rows = {r["var2"]: r for r in R.with_p_values(pairs).collect()}
    t = 0.5 * np.sqrt(18 / 0.75)
    assert rows["b"]["p"] == pytest.approx(dist.t_two_sided_p(t, 18))
    assert rows["b"]["p"] == pytest.approx(0.0247, abs=1e-3)
    assert rows["c"]["p"] is None or np.isnan(rows["c"]["p"])


def test_t_quantiles():
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert dist.t_ppf(0.975, 1e8) == pytest.approx(1.959963985, abs=1e-6)
    assert dist.norm_two_sided_p(1.959963984540054) == pytest.approx(0.05)
