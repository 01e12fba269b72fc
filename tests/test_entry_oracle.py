"""Driver contract smoke test and a DuckDB oracle comparison at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 26
    assert "territorio_id" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.llm is not None or not any(k.startswith("op") or k == "pipeline" for k in E.queries())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", ["kpi_catalog_grouping_sets", "gini_by_group", "quintiles",
                                  "weighted_quantiles", "lever_flip", "index_rows", "kendall_tau",
                                  "spearman_matrix", "summary_weighted", "income_quintile_label"])
def test_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    s = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(E.oracle_sql()[name])
    idx = [rel.columns.index(c) for c in cols]
    d = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=str)
    assert len(s) == len(d)
    for a, b in zip(s, d):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, (int, float)):
                assert x == pytest.approx(y, rel=1e-6, abs=1e-9)
            else:
                assert x == y
