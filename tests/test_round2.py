"""Cases that the first round got wrong: empty inputs, ties, mixed files, order of rows."""

import io
import math
import os
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pondus.functions import dist
from pondus.operators import corr, joins, ml_prep, ordered, scenario
from pondus.plans import frame
from pondus.sources import archives, readers, sinks


def test_ordered_kernel_on_empty_input(spark):
    empty = spark.createDataFrame([], "v double, w double, k long")
    assert ordered.gini(empty, "v", "w").collect()[0]["gini"] is None
    assert ordered.quantile_table(empty, "v", "w", ["k"]).count() == 0
    assert ordered.unweighted_quantiles(empty, "v", [0.5]).first()["q50"] is None


def test_a_lever_with_nothing_to_flip(spark):
    d = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 3.0)], "k long, bad double, PONDERA double")
    out = scenario.flip_to_target(d, F.lit(True), "bad", spark.createDataFrame([(90.0,)], "target double"), ["k"])
    assert sorted((r["k"], r["bad"], r["_flipped"]) for r in out.collect()) == [(1, 0.0, False), (2, 0.0, False)]


@pytest.mark.parametrize("buckets", [8, 200])
def test_hot_values_split_by_their_share(spark, buckets):
    rng = random.Random(3)
    rows = [(float(rng.choice([0, 0, 0, 1, 2, 2, 7])), rng.randrange(10**6), rng.random()) for _ in range(3000)]
    d = spark.createDataFrame(rows, "v double, k long, w double")
    a = ordered.running_weight(d, ["v", "k"], "w", method="window").toPandas().sort_values(["v", "k"])
    b = ordered.running_weight(d, ["v", "k"], "w", buckets=buckets).toPandas().sort_values(["v", "k"])
    assert np.allclose(a["_excl"], b["_excl"])


def test_exact_quantiles_agree_with_pandas(spark):
    rng = random.Random(5)
    pdf = pd.DataFrame({"g": [rng.choice("ab") for _ in range(500)], "v": [rng.choice([None, 0.0, rng.gauss(0, 1)]) for _ in range(500)]})
    d = spark.createDataFrame(pdf)
    probs = [0.0, 0.02, 0.2, 0.5, 0.98, 1.0]
    got = ordered.unweighted_quantiles(d, "v", probs).first()
    want = pdf["v"].dropna().quantile(probs)
    assert np.allclose(list(got), want)
    for r in ordered.unweighted_quantiles(d, "v", probs, "g").collect():
        assert np.allclose(list(r)[1:], pdf[pdf.g == r["g"]]["v"].dropna().quantile(probs))
    clipped = ordered.clip_to_percentiles(d, "v").toPandas()["v"]
    assert clipped.isna().sum() == pdf["v"].isna().sum()
    assert math.isclose(clipped.max(), pdf["v"].quantile(0.98)) and math.isclose(clipped.min(), pdf["v"].quantile(0.02))
    filled = ml_prep.impute_median(d, ["v"]).toPandas()["v"]
    assert math.isclose(filled.median(), pdf["v"].fillna(pdf["v"].median()).median()) and not filled.isna().any()


@pytest.mark.parametrize("q,dof,want", [(0.9999, 1, 3183.0988), (0.975, 10, 2.228139), (0.975, 1e6, 1.959966), (0.975, 1e12, 1.959964), (0.5, 3, 0.0), (0.025, 10, -2.228139)])
def test_student_quantiles(q, dof, want):
    assert dist.t_ppf(q, dof) == pytest.approx(want, rel=2e-6)


def test_student_quantile_of_few_degrees_of_freedom():
    t = dist.t_ppf(0.975, 0.3)
    assert t > 1000 and dist.t_sf(t, 0.3) == pytest.approx(0.025, rel=1e-9)
    for t in (0.3, 2.0, 8.0):
        assert dist.t_sf(t, 1) == pytest.approx(0.5 - math.atan(t) / math.pi, rel=1e-10)
        assert dist.t_sf(t, 1e13) == pytest.approx(dist.norm_sf(t), rel=1e-6)


def _tau_p(x, y):
    """τ-b and the tie-corrected p by all pairs."""
    n = len(x)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))
    tx, ty = (np.unique(v, return_counts=True)[1].astype(float) for v in (x, y))
    f = lambda t, e: float(e(t).sum())
    n0 = n * (n - 1) / 2
    tau = s / math.sqrt((n0 - f(tx, lambda t: t * (t - 1) / 2)) * (n0 - f(ty, lambda t: t * (t - 1) / 2)))
    e2, e3 = (lambda t: t * (t - 1) * (t - 2)), (lambda t: t * (t - 1) * (2 * t + 5))
    var = (n * (n - 1) * (2 * n + 5) - f(tx, e3) - f(ty, e3)) / 18 + 2 * f(tx, lambda t: t * (t - 1) / 2) * f(ty, lambda t: t * (t - 1) / 2) / (n * (n - 1)) + f(tx, e2) * f(ty, e2) / (9 * n * (n - 1) * (n - 2))
    return tau, math.erfc(abs(s) / math.sqrt(2 * var))


def test_correlation_by_every_method(spark):
    rng = random.Random(2)
    pdf = pd.DataFrame({"a": [float(rng.randrange(6)) for _ in range(120)], "b": [float(rng.randrange(5)) for _ in range(120)]})
    pdf["c"] = pdf["a"] + [float(rng.randrange(3)) for _ in range(120)]
    got = {(r["var1"], r["var2"]): r for r in corr.with_p_values(corr.corr_pairs(spark.createDataFrame(pdf), ["a", "b", "c"], "kendall"), "kendall").collect()}
    for (a, b), r in got.items():
        tau, p = _tau_p(pdf[a].to_numpy(), pdf[b].to_numpy())
        assert r["r"] == pytest.approx(tau) and r["p"] == pytest.approx(p, rel=1e-9, abs=1e-300) and r["significativo"] == (p < 0.05)
    with pytest.raises(ValueError):
        corr.corr_pairs(spark.createDataFrame(pdf), ["a", "b"], "other")
    pdf.loc[pdf.index % 4 == 0, "a"] = np.nan
    pdf.loc[pdf.index % 5 == 0, "c"] = np.nan
    d = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    for r in corr.spearman_long(d, ["a", "b", "c"], listwise=False).collect():
        own = pdf[[r["var1"], r["var2"]]].dropna()
        assert r["r"] == pytest.approx(own.iloc[:, 0].rank().corr(own.iloc[:, 1].rank())) and r["n"] == len(own)


def test_household_choice_ignores_the_order_of_rows(spark):
    persons = [("d1", 1, 1, 30.0, 2020, 4), ("d2", 1, 1, 40.0, 2020, 4)]
    homes = [("d1", 1, 10.0, 2020, 4), ("d1", 2, 99.0, 2020, 4), ("d1", 2, 98.0, 2020, 4), ("d2", 3, 5.0, 2020, 4)]
    p = spark.createDataFrame(persons, "CODUSU string, NRO_HOGAR int, COMPONENTE int, CH06 double, anio int, trimestre int")
    out = set()
    for order in (homes, homes[::-1], [homes[2], homes[0], homes[3], homes[1]]):
        h = spark.createDataFrame(order, "CODUSU string, NRO_HOGAR int, ITF double, anio int, trimestre int")
        f = frame.analysis_frame(h, p, include_ict=False)
        out.add(tuple(sorted((r["CODUSU"], r["ITF"]) for r in f.select("CODUSU", "ITF").collect())))
        j = joins.household_join(h.select("CODUSU", "ITF"), p, ["CODUSU"])
        out.add(("join", *sorted((r["CODUSU"], r["ITF"]) for r in j.collect())))
    assert len(out) == 2 and (("d1", 10.0), ("d2", 5.0)) in out


def _zip(folder, name, members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for member, text in members.items():
            z.writestr(member, text)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(buf.getvalue())


def test_archives_with_other_headers_and_quoted_fields(spark, tmpdir_path):
    _zip(tmpdir_path, "a.zip", {"x.txt": "A;B;C\n1;2;3\n"})
    _zip(tmpdir_path, "b.zip", {"x.txt": "C;A;B;D\n1;2;3;\"q;r\"\n7;8\n"})
    rows = {(r["A"], r["B"], r["C"], r["D"]) for r in archives.read_archive_table(spark, tmpdir_path).collect()}
    assert rows == {("1", "2", "3", None), ("2", "3", "1", "q;r"), ("8", None, "7", None)}
    assert {r["extra"] for r in archives.member_records(spark, tmpdir_path).collect()} == {0, -2}


def test_bad_lines_are_tagged_or_dropped(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "bad.csv")
    with open(path, "w") as f:
        f.write("A,B,C\n1,2,3\n4,5,6,7,8\n9\n\"x,y\",1,2\n")
    tagged = readers.read_delimited(spark, path, bad_lines="permissive")
    assert {r["_corrupt"] for r in tagged.collect()} == {None, "4,5,6,7,8", "9"}
    assert tuple(readers.corrupt_lines(tagged).first()) == (4, 2)
    assert sorted(r["A"] for r in readers.read_delimited(spark, path).collect()) == ["1", "x,y"]


def test_a_late_latin1_byte_and_a_folder(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "late.csv")
    with open(path, "wb") as f:
        f.write(b"A,B,C\n" + b"1,2,x\n" * 500 + "1,2,Córdoba\n".encode("latin-1"))
    assert readers.read_delimited(spark, path).where("C != 'x'").first()["C"] == "Córdoba"
    folder = os.path.join(tmpdir_path, "table")
    spark.range(3).write.parquet(folder)
    assert readers.read_any(spark, folder).count() == 3


def test_partitioned_writes_leave_the_session_alone(spark, tmpdir_path):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    for year in (1, 2):
        sinks.write_parquet(spark.range(2).withColumn("y", F.lit(year)), os.path.join(tmpdir_path, "p"), partition_by=["y"])
    assert spark.read.parquet(os.path.join(tmpdir_path, "p")).count() == 4
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_baseline_documents_flatten(spark):
    doc = spark.sql("SELECT 'x' AS territorio_id, named_struct('n', 5L, 'brecha_sexo', named_struct('m', 1.0D, 'f', 2.0D)) AS kpis")
    assert sinks.flatten_baseline(doc).first().asDict() == {"territorio_id": "x", "n": 5, "brecha_sexo_m": 1.0, "brecha_sexo_f": 2.0}


def test_results_of_a_request_are_written(spark, tmpdir_path):
    import json

    from pondus.plans import jobs
    req = jobs.AnalysisRequest(years="2020-2021", ambito="aglomerado", aglomerado=7)
    tables = {"a": spark.range(3), "b": {"x": spark.range(2), "n": 5}}
    jobs.write_results(req, tables, tmpdir_path)
    base = os.path.join(tmpdir_path, "aglomerado_7")
    assert spark.read.option("header", True).csv(os.path.join(base, "a")).count() == 3
    doc = json.loads(spark.read.text(os.path.join(base, "summary")).first()[0])
    assert doc["meta"]["ambito"] == "aglomerado_7" and doc["meta"]["periodo"] == "2020-2021 T4"
    assert [(t["tabla"], t["filas"]) for t in doc["tablas"]] == [("a", 3), ("b_x", 2)]
    with pytest.raises(TypeError):
        jobs.AnalysisRequest(color="red")


def test_small_sinks_and_grades(spark):
    assert {tuple(r) for r in sinks.meta_rows(spark, {"a": 1, "b": "x"}).collect()} == {("a", "1"), ("b", "x")}
    assert [corr.alpha_grade(a) for a in (0.95, 0.85, 0.75, 0.65, 0.1, None)] == ["excelente", "buena", "aceptable", "cuestionable", "pobre", "no calculable"]


def test_best_clusters(spark):
    from pondus.operators import models
    rng = random.Random(1)
    rows = [(rng.gauss(5 * (i % 3), 0.1), rng.gauss(5 * (i % 3), 0.1)) for i in range(300)]
    assigned, table, best = models.kmeans_best(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], 2, 4, starts=2)
    assert best == 3 and assigned.select("prediction").distinct().count() == 3 and table.count() == 3


def test_forest_shap_is_the_mean_of_its_trees(spark):
    from pyspark.ml.functions import vector_to_array

    from pondus.operators import explain, models
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random()) for i in range(400)]
    d = spark.createDataFrame(rows, "k long, x double, z double").withColumn("y", (F.col("x") + 0.2 * F.col("z") > 0.6).cast("double"))
    _, model = models.forest(d, ["x", "z"], "y", n_trees=5, max_depth=6)
    got = {r["k"]: r for r in explain.tree_shap(d, model, ["x", "z"], ["k"]).collect()}
    want = model.transform(models.design(d.select("k", "x", "z"), ["x", "z"]).withColumn("one", F.lit(1))).select("x", vector_to_array("probability")[1].alias("p"))
    by_x = {round(r["x"], 12): r["p"] for r in want.collect()}
    assert all(r["fx"] == pytest.approx(by_x[round(r["x"], 12)], abs=1e-9) for r in got.values())


def test_executors_need_no_copy_of_the_package(spark):
    import sys

    from pyspark import cloudpickle
    assert sys.modules["pondus"].__name__ in cloudpickle.cloudpickle._PICKLE_BY_VALUE_MODULES
    data = cloudpickle.dumps(archives._records)
    assert b"_records" in data and b"pondus.sources.archives\x94\x8c\x08_records" not in data


def test_forest_and_kmeans_queries_use_the_operators_defaults(monkeypatch):
    import inspect
    from pondus.plans import testbed3
    forest, select, calls = inspect.signature(testbed3.M.forest), inspect.signature(testbed3.M.kmeans_select), {}

    def spy(name, signature):
        def call(*args, **named):
            bound = signature.bind(*args, **named)
            bound.apply_defaults()
            calls[name] = bound.arguments
            return None, None
        return call
    monkeypatch.setattr(testbed3, "_labeled", lambda spark, sf: None)
    monkeypatch.setattr(testbed3, "lineitem", lambda spark, sf: None)
    for name, signature in (("forest", forest), ("kmeans_select", select)):
        monkeypatch.setattr(testbed3.M, name, spy(name, signature))
    testbed3.q_forest(None, None)
    testbed3.q_kmeans_select(None, None)
    assert [calls["forest"][x] for x in ("n_trees", "max_depth", "min_leaf")] == [500, 30, 5]
    assert [calls["kmeans_select"][x] for x in ("k_min", "k_max", "starts")] == [2, 8, 10]
