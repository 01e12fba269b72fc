"""Growth with the table: what is read once, and what is kept in columns."""

import re

import pytest
from pyspark.sql import functions as F

from pondus.operators import corr as R, joins, kpi, models, scenario as L


def test_pairwise_spearman_joins_the_points_once(spark):
    rows = [(float(i % 7), float((i * 5) % 11) if i % 4 else None, float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = R.spearman_long(df, ["a", "b", "c"], listwise=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin ", plan)) == 3  # the ranks of either side, and the pairs' names
    pdf = df.toPandas()
    for r in out.collect():
        both = pdf[[r["var1"], r["var2"]]].dropna()
        ranks = both.rank()
        assert r["n"] == len(both) and r["r"] == pytest.approx(ranks.iloc[:, 0].corr(ranks.iloc[:, 1]))
    flat = R.spearman_long(spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double"), ["a", "b"], listwise=False)
    assert [tuple(r) for r in flat.collect()] == [("a", "b", None, 1)]


def test_scenario_frames_are_kept_in_columns(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "g int, a double, PONDERA double")
    monkeypatch.setattr(L, "apply_scenario", lambda d, *a, **k: d.withColumn("a", F.col("a") + 1))
    monkeypatch.setattr(models, "logistic", lambda *a: (None, None))
    monkeypatch.setattr(models, "predicted_rate", lambda m, d, *a: d.select("g", F.lit(1.0).alias("pct_predicho")))
    monkeypatch.setattr(kpi, "kpis", lambda d, **k: d.select("g", "a"))
    seen = []
    monkeypatch.setattr(joins, "compare_indicators", lambda b, a, by, cols: seen.append((b, a)))
    after, _ = L.scenario_run(df, None, ["g"], "g", ["a"], ["a"])
    assert after.inputFiles() and all(d.inputFiles() for d in seen[0]) and after.first()["a"] == 2.0
