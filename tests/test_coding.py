"""Coding rules against hand-made fixtures (FIXTURES.md §5)."""

import pytest
from pyspark.sql import functions as F

from pondus.functions import coding as C
from pondus.functions.expr import num, num_comma, row_mean, wmean


def col_values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_age_groups(spark):
    df = spark.createDataFrame([(a,) for a in [-1, 0, 4, 5, 14, 15, 64, 65, 99, None]], "a int")
    got = col_values(df, C.age_group("a"))
    assert got == [None, "0-4 años", "0-4 años", "5-14 años", "5-14 años", "15-29 años",
                   "45-64 años", "65+ años", "65+ años", None]


def test_nonresponse_codes(spark):
    df = spark.createDataFrame([(v,) for v in [1, 9, 99, 999, -9, -99, 2, None]], "v int")
    assert col_values(df, C.nonresponse_to_null("v")) == [1, None, None, None, None, None, 2, None]


def test_yes_no_codings_are_opposite(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 2, 9, -9, None]], "v int")
    gen2 = col_values(df, C.yes_no_exclusion("v"))                  # 1 = lacks
    gen1 = col_values(df, C.yes_no_exclusion("v", lacks_code=2, has_code=1))
    assert gen2 == [None, 1.0, 0.0, None, None, None]
    assert gen1 == [None, 0.0, 1.0, None, None, None]


def test_usage_flag_nine_counts_as_used(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 9, -9, None]], "v int")
    assert col_values(df, C.usage_exclusion("v")) == [1.0, 0.0, 0.0, None, None]


def test_lenient_numbers(spark):
    df = spark.createDataFrame([(s,) for s in ["", "abc", " 12 ", "12,5", "01", "NaN", None]], "s string")
    assert col_values(df, num("s")) == [None, None, 12.0, None, 1.0, None, None]
    assert col_values(df, num_comma("s")) == [None, None, 12.0, 12.5, 1.0, None, None]


def test_code_key_normalisation(spark):
    df = spark.createDataFrame([("01",), ("4.0",), (" 12 ",), ("abc",)], "s string")
    assert col_values(df, C.code_key("s")) == ["1", "4.0", "12", "abc"]  # only integer text is a number
    df2 = spark.createDataFrame([(4.0,), (4.7,)], "d double")
    assert col_values(df2, C.code_key("d")) == ["4", "4"]


def test_row_mean_ignores_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 0.0), (None, None, None)], "a double, b double, c double")
    assert col_values(df, row_mean(["a", "b", "c"])) == [0.5, None]


def test_informal_only_among_employed(spark):
    df = spark.createDataFrame([(1.0, 2), (1.0, None), (0.0, 2)], "ocu double, pp int")
    assert col_values(df, C.informal_proxy(F.col("ocu"), F.col("pp"))) == [1.0, 0.0, None]


def test_scores(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0, None, 1.0)], "s double, u double, o double, i double, q double")
    assert col_values(df, C.mobility_score("s", "u", "o", "i", "q"))[0] == pytest.approx(0.3 + 0.2 + 0.15)


def test_weighted_mean_pairwise(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 5.0), (3.0, None), (0.0, 2.0)], "x double, w double")
    assert df.agg(wmean("x", "w")).first()[0] == pytest.approx(0.5)


def test_income_quintile_labels_with_duplicate_edges(spark):
    from pondus.plans.clean import income_quintile_label
    df = spark.createDataFrame([(float(v),) for v in [0, 5, 5, 5, 5, 5, 5, 10]], "IPCF double")
    got = [r[0] for r in income_quintile_label(df).select("QUINTIL_IPCF").collect()]
    assert got[0] is None                     # non-positive income has no quintile
    assert set(got[1:7]) == {"Q1 (más bajo)"}  # duplicate edges: the first edge hit wins
    assert got[7] == "Q5 (más alto)"


def test_mixed_type_95_percent_rule(spark):
    from pondus.operators.schema import mixed_type_decisions
    a = [str(i) for i in range(95)] + ["x"] * 5       # 95 % numeric
    b = [str(i) for i in range(94)] + ["x"] * 6       # 94 %
    df = spark.createDataFrame(list(zip(a, b)), "a string, b string")
    d = {r["columna"]: r["a_numerico"] for r in mixed_type_decisions(df).collect()}
    assert d == {"a": True, "b": False}


def test_exclusion_level_bins(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 0.25, 0.2501, 0.75, 1.0, None]], "v double")
    assert col_values(df, C.exclusion_level("v")) == [
        "Inclusión", "Inclusión", "Exclusión leve", "Exclusión moderada", "Exclusión severa", None]
