"""Smaller operators: subsets and search (F10, F11), geo join and map table (J10, Z7),
percentile clipping (D12), schema helpers (S4, S5), predicted rate and panel logistic
(M15, M7), and the file-processing job (Z1)."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pondus.operators import joins as J
from pondus.operators import kpi as K
from pondus.operators import models as M
from pondus.operators import ordered as O
from pondus.operators import schema as S
from pondus.plans import bind, jobs
from pondus.plans.frame import age_status_subset
from pondus.plans.testbed import frame, territory_dim
from pondus.sources import readers
from pondus.sources.dimensions import search_territories


def test_subset_and_search(spark):
    df = spark.createDataFrame([(17, 1), (18, 2), (65, 1), (40, 3), (None, 1), (30, None)],
                               "CH06 int, ESTADO int")
    assert sorted(r["CH06"] for r in age_status_subset(df).collect()) == [18, 65]
    t = territory_dim(spark, SF_SMALL)
    name = t.where("tipo = 'aglomerado'").orderBy("territorio_id").first()["territorio_nombre"]
    q = name[1:4]
    hits = search_territories(t, f"  {q.upper()} ").collect()
    assert name in [r["territorio_nombre"] for r in hits]
    assert all(q.lower() in r["territorio_nombre"].lower() for r in hits)


def test_geo_inner_and_map_metric(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "coords.json")
    with open(path, "w") as fh:
        json.dump({"coordenadas": {"1": {"lat": -34.6, "lon": -58.4, "nombre": "a"},
                                   "2": {"lat": -31.4, "lon": -64.2, "nombre": "b"},
                                   "999": {"lat": 0.0, "lon": 0.0, "nombre": "none"}}}, fh)
    coords = readers.coordinates_book(spark, path)
    cat = K.catalog(frame(spark, SF_SMALL), territory_dim(spark, SF_SMALL))
    geo = J.geo_inner(cat, coords)
    assert sorted(r["aglomerado_codigo"] for r in geo.collect()) == [1, 2]  # 999 and nation dropped
    mp = K.map_metric(cat, coords, "pct_ocupado").collect()
    assert {r["aglomerado_codigo"] for r in mp} <= {1, 2} and all(r["valor"] is not None for r in mp)


def test_clip_to_percentiles(spark):
    vals = np.arange(1, 101, dtype=float)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    out = [r["v"] for r in O.clip_to_percentiles(df, "v").collect()]
    lo, hi = np.percentile(vals, 2), np.percentile(vals, 98)
    assert min(out) == lo and max(out) == hi and len(out) == 100


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (None, None, 3.0)], "a int, b string, c double")
    num, cat = S.split_feature_types(df, ["a", "b", "c", "b_LABEL"], nominal=["a"])
    assert num == ["c"] and cat == ["a", "b", "b_LABEL"]
    rows = {r["columna"]: r for r in S.table_summary(df).collect()}
    assert rows["a"]["nulos"] == 1 and rows["c"]["nulos"] == 0
    assert rows["b"]["filas"] == 2 and rows["b"]["columnas"] == 3 and rows["b"]["tipo"] == "string"


def test_predicted_rate_and_panel_logistic(spark):
    f = frame(spark, SF_SMALL)
    res = jobs.panel_logistic(f, "vulnerabilidad_alta")
    assert "error" not in res, res
    assert res["coeficientes"].count() >= 2
    assert "p" in res["glm"].columns  # empty when the information matrix is singular (as the reference)
    rep = {r["clase"]: r for r in res["reporte"].collect()} if "clase" in res["reporte"].columns else None
    assert res["reporte"].count() >= 2 and (rep is None or len(rep) >= 2)
    feats = ["l_quantity", "l_discount"]
    li = bind.table(spark, SF_SMALL, "lineitem").withColumn(
        "y", (F.col("l_discount") >= 0.05).cast("double")).withColumn("PONDERA", F.col("l_quantity"))
    _, model = M.logistic(li, feats, "y")
    pct = M.predicted_rate(model, li, feats).first()["pct_predicho"]
    share = li.agg(100 * F.sum(F.col("y") * F.col("PONDERA")) / F.sum("PONDERA")).first()[0]
    assert abs(pct - share) < 15  # a calibrated model's mean probability tracks the rate


def test_process_files_job(spark, tmpdir_path):
    pdir = os.path.join(tmpdir_path, "persons.csv")
    hdir = os.path.join(tmpdir_path, "households.csv")
    p = bind.persons(spark, SF_SMALL).select("CODUSU", "NRO_HOGAR", "COMPONENTE", "CH04", "CH06",
                                             "ESTADO", "NIVEL_ED", "PONDERA", "IPCF", "IP_III_04")
    h = bind.households(spark, SF_SMALL).select("CODUSU", "NRO_HOGAR", "ITF", "IX_TOT") \
        if "IX_TOT" in bind.households(spark, SF_SMALL).columns else \
        bind.households(spark, SF_SMALL).select("CODUSU", "NRO_HOGAR", "ITF")
    p.coalesce(1).write.option("header", True).option("sep", ";").csv(pdir)
    h.coalesce(1).write.option("header", True).option("sep", ";").csv(hdir)
    pf = [os.path.join(pdir, x) for x in os.listdir(pdir) if x.endswith(".csv")][0]
    hf = [os.path.join(hdir, x) for x in os.listdir(hdir) if x.endswith(".csv")][0]
    table, report = jobs.process_files(spark, pf, hf, os.path.join(tmpdir_path, "out"))
    assert table.count() == p.count()
    assert "ITF" in table.columns and "EDAD_GRUPO" in table.columns or "ITF" in table.columns
    assert report.count() == 2
    assert spark.read.parquet(os.path.join(tmpdir_path, "out")).count() == p.count()
