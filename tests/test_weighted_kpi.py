"""Weighted aggregates, KPIs, gaps and levers on hand-made fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pondus.operators import kpi as K
from pondus.operators import scenario as L
from pondus.operators import weighted as G


def test_weight_policies(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, -1.0), (4, 2.5), (5, 3.0)], "k int, w double")
    d, w = G.resolve_weight(df, "w", "zero")
    assert [r[0] for r in d.select(w).collect()] == [0.0, 0.0, -1.0, 2.5, 3.0]
    d, w = G.resolve_weight(df, "w", "drop")
    assert d.count() == 2
    d, w = G.resolve_weight(df, "w", "one")
    assert [r[0] for r in d.select(w).collect()][0] == 1.0
    zero = spark.createDataFrame([(1, 0.0), (2, None)], "k int, w double")
    d, w = G.resolve_weight(zero, "w", "zero")       # Σw ≤ 0 → unweighted
    assert [r[0] for r in d.select(w).collect()] == [1.0, 1.0]


def test_frequencies_with_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), (None, 5.0)], "c string, w double")
    rows = {r["categoria"]: r for r in G.frequencies(df, "c", "w").collect()}
    assert rows["(NaN)"]["n"] == 1 and rows["a"]["n_ponderado"] == 4.0
    assert sum(r["pct_ponderado"] for r in rows.values()) == pytest.approx(100.0)
    assert "(NaN)" not in {r["categoria"] for r in G.frequencies(df, "c", "w", include_nulls=False).collect()}


def test_weighted_summary_matches_formula(spark):
    x = np.array([1.0, 2.0, 2.0, 5.0, 9.0])
    w = np.array([1.0, 2.0, 1.0, 3.0, 1.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w)], "x double, w double")
    r = G.summary(df, "x", "w").first()
    mean = (w * x).sum() / w.sum()
    var = (w * (x - mean) ** 2).sum() / (w.sum() - 1)
    assert r["mean"] == pytest.approx(mean)
    assert r["sd"] == pytest.approx(np.sqrt(var))
    assert r["se"] == pytest.approx(np.sqrt(var) / np.sqrt(w.sum()))
    ci = G.add_t_interval(G.summary(df, "x", "w")).first()
    assert ci["ci_low"] < mean < ci["ci_high"]


def test_crosstab_shares_sum_to_100(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 2.0)], "r string, c string, w double")
    rows = G.crosstab(df, "r", "c", "w", "row").collect()
    by_row = {}
    for r in rows:
        by_row[r["r"]] = by_row.get(r["r"], 0) + r["valor"]
    assert by_row == pytest.approx({"a": 100.0, "b": 100.0})


def _frame_rows(n_f, n_m):
    rows = []
    for i in range(n_f):
        rows.append((i, 2, 1.0 if i % 2 else 0.0, 1.0))
    for i in range(n_m):
        rows.append((1000 + i, 1, 1.0, 1.0))
    return rows


@pytest.mark.parametrize("n_f,n_m,has_gap", [(30, 30, True), (29, 30, False), (30, 29, False)])
def test_gender_gap_minimum_counts(spark, n_f, n_m, has_gap):
    df = spark.createDataFrame(_frame_rows(n_f, n_m), "k int, CH04 int, ocupado double, PONDERA double")
    gap = df.agg(*K.gap_aggs(df, include_ict=False)).first()[0]
    assert (gap is not None) == has_gap
    if has_gap:
        assert gap == pytest.approx(100 * 15 / 30 - 100.0)


def _lever_df(spark, rows):
    return spark.createDataFrame(rows, "k long, g string, x double, PONDERA double")


def test_lever_flips_heaviest_until_target(spark):
    # 10 rows, all bad (x=1) except one; target 50 % good
    rows = [(i, "a", 1.0, float(w)) for i, w in enumerate([5, 1, 1, 1, 1, 1, 1, 1, 1])] + [(9, "a", 0.0, 1.0)]
    df = _lever_df(spark, rows)
    tg = spark.createDataFrame([("a", 50.0)], "g string, target double")
    out = L.flip_to_target(df, F.lit(True), "x", tg, ["k"], "g")
    flipped = sorted(r["k"] for r in out.where("_flipped").collect())
    # Σw = 14, need 7 good, have 1 → extra 6: heaviest (k0, 5) then k1 (1): prefix 0,5 < 6 → 2 rows
    assert flipped == [0, 1]


def test_lever_no_change_when_target_below_current(spark):
    rows = [(0, "a", 0.0, 1.0), (1, "a", 1.0, 1.0)]
    tg = spark.createDataFrame([("a", 40.0)], "g string, target double")
    out = L.flip_to_target(_lever_df(spark, rows), F.lit(True), "x", tg, ["k"], "g")
    assert out.where("_flipped").count() == 0


def test_lever_null_weight_counts_one_and_ties_by_key(spark):
    rows = [(3, "a", 1.0, None), (1, "a", 1.0, 1.0), (2, "a", 1.0, 1.0), (4, "a", 0.0, 1.0)]
    tg = spark.createDataFrame([("a", 75.0)], "g string, target double")
    out = L.flip_to_target(_lever_df(spark, rows), F.lit(True), "x", tg, ["k"], "g")
    # Σw = 4 (null → 1), need 3 good, have 1 → extra 2; equal weights → by key 1, 2
    assert sorted(r["k"] for r in out.where("_flipped").collect()) == [1, 2]


def test_lever_overshoot_by_one_row(spark):
    rows = [(0, "a", 1.0, 3.0), (1, "a", 1.0, 3.0), (2, "a", 0.0, 4.0)]
    tg = spark.createDataFrame([("a", 60.0)], "g string, target double")
    out = L.flip_to_target(_lever_df(spark, rows), F.lit(True), "x", tg, ["k"], "g")
    # Σw = 10, need 6, have 4 → extra 2: flipping one row of weight 3 overshoots by 1
    assert out.where("_flipped").count() == 1


def test_catalog_keeps_areas_without_data(spark):
    from pondus.sources.dimensions import territories
    dim = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "code int, name string")
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 0.0, 2.0), (2, 1.0, 1.0)],
                               "AGLOMERADO int, ocupado double, PONDERA double")
    cat = {r["territorio_id"]: r for r in K.catalog(df, territories(dim), include_ict=False).collect()}
    assert cat["nacional"]["n_individuos"] == 3
    assert cat["aglomerado_1"]["pct_ocupado"] == pytest.approx(100 / 3)
    assert cat["aglomerado_3"]["n_individuos"] is None


def test_baseline_documents_nest_evolution(spark):
    from pondus.sources.dimensions import territories
    dim = spark.createDataFrame([(1, "A")], "code int, name string")
    df = spark.createDataFrame([(1, 2020, 1.0, 1.0), (1, 2021, 0.0, 1.0)],
                               "AGLOMERADO int, anio int, ocupado double, PONDERA double")
    docs = {r["territorio_id"]: r for r in K.baseline_documents(df, territories(dim), include_ict=False).collect()}
    evo = docs["aglomerado_1"]["evolucion"]
    assert [e["anio"] for e in evo] == [2020, 2021]
    assert docs["nacional"]["kpis"]["n_individuos"] == 2
