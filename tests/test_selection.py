"""Small selection helpers: target modes (P27), weight fallback (P28), column lookup (S3),
person-only statistics (J6), seeded sample (O6)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pondus.operators import joins as J
from pondus.operators import ml_prep as MP
from pondus.operators import schema as S
from pondus.operators import weighted as G
from pondus.plans import bind


def test_guided_and_expert_targets(spark):
    df = spark.createDataFrame([(0.2, 1, "a"), (0.5, 2, "b"), (0.9, 1, None), (None, 2, "a")],
                               "INDICE_EXCLUSION double, CH04 int, grp string")
    t, feats, label = MP.model_target(df, "guiado")
    assert [r["target"] for r in t.collect()] == [0, 1, 1, 0]
    assert feats == ["CH04"] and label.startswith("INDICE_EXCLUSION")
    with pytest.raises(ValueError):  # two values {1, 2}, neither {0, 1} nor a threshold
        MP.model_target(df, "experto", "CH04")
    t3, _, _ = MP.model_target(df, "experto", "grp", positive_values=["a"])
    assert [r["target"] for r in t3.collect()] == [1, 0, 0, 1]


def test_weight_fallback_lookup_and_person_only(spark):
    df = spark.createDataFrame([(1, 2, 5.0)], "CODUSU int, NRO_HOGAR int, PONDII double")
    assert G.income_weight(df) == "PONDII"
    assert G.income_weight(df.drop("PONDII")) is None
    var = spark.createDataFrame([("hogar", "IPCF", "ingreso per capita", "num")],
                                "section string, variable string, desc string, tipo string")
    assert S.describe_column(var, " ipcf ").first()["desc"] == "ingreso per capita"
    p = bind.persons(spark, SF_SMALL)
    st = J.person_only_stats(p).first()
    assert st["personas"] == p.count()
    assert st["hogares"] == p.select("CODUSU", "NRO_HOGAR").distinct().count()


def test_seeded_sample_is_exact_and_stable(spark):
    li = bind.table(spark, SF_SMALL, "lineitem")
    a = MP.seeded_sample(li, bind.PERSON_KEY, 100, seed=7)
    b = MP.seeded_sample(li, bind.PERSON_KEY, 100, seed=7)
    c = MP.seeded_sample(li, bind.PERSON_KEY, 100, seed=8)
    ka = sorted(tuple(r) for r in a.select(*bind.PERSON_KEY).collect())
    assert len(ka) == 100
    assert ka == sorted(tuple(r) for r in b.select(*bind.PERSON_KEY).collect())
    assert ka != sorted(tuple(r) for r in c.select(*bind.PERSON_KEY).collect())
    assert a.where(F.col("l_orderkey").isNull()).count() == 0
