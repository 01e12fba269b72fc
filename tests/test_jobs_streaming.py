"""Jobs (request, territorial run), streaming KPIs, labels, evaluation, models."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pondus.functions import labels as LB
from pondus.operators import evaluate as EV
from pondus.operators import models as M
from pondus.plans import bind, jobs
from pondus.plans.testbed import frame


def test_request_validation():
    r = jobs.AnalysisRequest(years="2017-2019", analisis=["todos"], ambito="san_juan")
    assert r.years == [2017, 2018, 2019] and r.area_filter == 27 and r.label == "gran_san_juan"
    assert r.analyses == set(jobs.ANALYSES)
    with pytest.raises(ValueError):
        jobs.AnalysisRequest(modulo="x")
    with pytest.raises(ValueError):
        _ = jobs.AnalysisRequest(analisis=["magia"]).analyses
    assert jobs.AnalysisRequest.from_json('{"years": 2020, "modulo": "BASE"}').modulo == "base"


def test_run_request_descriptive_parts(spark):
    req = jobs.AnalysisRequest(years=[1995], analisis=["descriptivos", "frecuencias"])
    out = jobs.run_request(req, bind.households(spark, SF_SMALL), bind.persons(spark, SF_SMALL),
                           keep=bind.PERSON_KEY)
    assert out["descriptivos_anuales"].count() > 0
    freq = out["frecuencias"].groupBy("variable").agg(F.sum("pct_ponderado").alias("s")).collect()
    assert all(abs(r["s"] - 100) < 1e-9 for r in freq)


def test_territorial_run_writes_documents(spark, tmpdir_path):
    f = frame(spark, SF_SMALL)
    res = jobs.territorial_run(spark, f, tmpdir_path, "r1", area_dim=bind.area_dim(spark, SF_SMALL))
    assert res["catalogo"].count() == 26
    assert os.path.isdir(os.path.join(tmpdir_path, "r1", "baselines", "territorio_id=nacional"))


def test_streaming_kpis_equal_batch(spark, tmpdir_path):
    f = frame(spark, SF_SMALL).select("AGLOMERADO", "anio", "PONDERA", "secundario_completo", "superior",
                                      "ocupado", "score_movilidad_proxy", "vulnerabilidad_social",
                                      "informal_proxy", "idx_exclusion_digital")
    land = os.path.join(tmpdir_path, "landing")
    for y in (1995, 1996, 1997):  # three waves land as separate files
        f.where(F.col("anio") == y).write.mode("append").parquet(land)
    from pondus.streaming import waves
    stream = waves.read_waves(spark, land, f.schema, max_files_per_trigger=1)
    q = waves.start_kpi_stream(stream, os.path.join(tmpdir_path, "ck"), query_name="kpi_t")
    q.processAllAvailable()
    q.stop()
    got = {(r["AGLOMERADO"], r["anio"]): r for r in waves.finalize(spark.table("kpi_t")).collect()}
    from pondus.operators import kpi as K
    ref = K.evolution(f.where(F.col("anio").isin(1995, 1996, 1997)).withColumn(
        "AGLOMERADO", F.col("AGLOMERADO").cast("int")), by="AGLOMERADO", gaps=False).collect()
    assert len(got) == len(ref)
    for r in ref:
        g = got[(r["AGLOMERADO"], r["anio"])]
        assert g["pct_ocupado"] == pytest.approx(r["pct_ocupado"])
        assert g["n_individuos"] == r["n_individuos"]


def test_labels(spark):
    df = spark.createDataFrame([(1,), (9,), (None,), (42,)], "v int")
    got = [r[0] for r in df.select(LB.category_label("ESTADO", "v")).collect()]
    assert got == ["Ocupado", "9", "Sin dato", "42"]
    v = spark.createDataFrame([("CH04_LABEL",), ("REGION_41",), ("FOO",)], "variable string")
    names = {r["variable"]: r["nombre"] for r in
             LB.variable_names(v, "variable", derived={"CH04": "Sexo", "REGION": "Región"}).collect()}
    assert names == {"CH04_LABEL": "Sexo (etiqueta)", "REGION_41": "Región = 41", "FOO": "FOO"}


def test_auc_matches_rank_formula(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.normal(size=400) + y, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    auc = EV.auc(df, "y", "s").first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    ref = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert auc == pytest.approx(ref)
    roc = EV.roc_points(df, "y", "s").orderBy("threshold").collect()
    assert roc[0]["fpr"] == pytest.approx(1.0) and roc[0]["tpr"] == pytest.approx(1.0)


def test_logistic_c_parameterisation_matches_newton(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(800, 2))
    y = (X @ [1.0, -0.5] + rng.normal(size=800) > 0).astype(float)
    w = rng.integers(1, 4, 800).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(X, y, w)],
                               "a double, b double, y double, w double")
    coef, _ = M.logistic(df, ["a", "b"], "y", weight="w", C=1.0)
    got = {r["variable"]: r["coef"] for r in coef.collect()}
    beta = np.zeros(3)
    Xi = np.c_[X, np.ones(800)]
    for _ in range(50):  # Newton on Σw·loglik − ½‖β[:2]‖²
        p = 1 / (1 + np.exp(-Xi @ beta))
        g = Xi.T @ (w * (y - p)) - np.r_[beta[:2], 0]
        H = -(Xi.T * (w * p * (1 - p))) @ Xi - np.diag([1, 1, 0])
        beta -= np.linalg.solve(H, g)
    assert got["a"] == pytest.approx(beta[0], abs=1e-4)
    assert got["(intercept)"] == pytest.approx(beta[2], abs=1e-4)


def test_ward_two_stage_assigns_everyone(spark):
    rng = np.random.default_rng(9)
    pts = np.r_[rng.normal(0, 0.2, (150, 2)), rng.normal(5, 0.2, (150, 2))]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "a double, b double")
    out = M.ward_two_stage(df, ["a", "b"], k=2, micro=10)
    sizes = sorted(r["count"] for r in out.groupBy("cluster").count().collect())
    assert sizes == [150, 150]
