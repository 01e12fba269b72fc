"""Sinks (B1–B11): Parquet, JSON and CSV writers and export-shaping transformations.

Writers are the only actions; everything before them is one lazy plan.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

ATOMIC_SKIP = (ArrayType, MapType, StructType)


def to_atomic(df: DataFrame) -> DataFrame:
    """B1: non-atomic columns (arrays, maps, structs) become JSON text."""
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, ATOMIC_SKIP)
                       else F.col(f.name) for f in df.schema.fields])


def write_parquet(df: DataFrame, path: str, compression: str = "snappy",
                  partition_by: Sequence[str] = (), flatten: bool = True) -> None:
    """B1/B2: Parquet with a codec; ``partition_by`` (e.g. year) for panel writes with
    dynamic partition overwrite, so re-writing one wave leaves the others."""
    out = to_atomic(df) if flatten else df
    w = out.write.mode("overwrite").option("compression", compression)
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)


def write_json(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """JSON lines (nested structs kept), optionally one folder per territory."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header per result table."""
    to_atomic(df).write.mode("overwrite").option("header", True).csv(path)


def with_meta(result: DataFrame, meta: Mapping[str, object]) -> DataFrame:
    """One JSON document per row: ``{meta: {...}, ...result columns}``."""
    m = F.struct(*[F.lit(v).alias(k) for k, v in meta.items()])
    return result.select(F.to_json(F.struct(m.alias("meta"), *[F.col(c) for c in result.columns]))
                         .alias("json"))


def meta_rows(spark: SparkSession, meta: Mapping[str, object]) -> DataFrame:
    """Metadata as (clave, valor) rows."""
    return spark.createDataFrame([(str(k), json.dumps(v) if not isinstance(v, str) else v)
                                  for k, v in meta.items()], "clave string, valor string")


def readable_headers(df: DataFrame, names: Mapping[str, str], with_code: bool = True) -> DataFrame:
    """Rename columns to "Name (CODE)" (or just Name) from a name map."""
    def nm(c):
        if c not in names:
            return c
        return f"{names[c]} ({c})" if with_code else names[c]
    return df.toDF(*[nm(c) for c in df.columns])


def flatten_baseline(doc: DataFrame) -> DataFrame:
    """A baseline document as one flat row: its KPI struct as top-level columns, and each
    struct within it (the gaps) as ``brecha_<name>_<field>``."""
    kpis = doc.schema["kpis"].dataType
    out = []
    for f in kpis.fields:
        c = F.col("kpis").getField(f.name)
        if isinstance(f.dataType, StructType):
            stem = f.name if f.name.startswith("brecha") else f"brecha_{f.name}"
            out += [c.getField(g.name).alias(f"{stem}_{g.name}") for g in f.dataType.fields]
        else:
            out.append(c.alias(f.name))
    return doc.select(*[c for c in doc.columns if c != "kpis"], *out)


def top_k(df: DataFrame, col: str, k: int = 10, ascending: bool = False, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Top-k rows by a column (TakeOrderedAndProject: a bounded per-task heap)."""
    o = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
    return df.orderBy(o, *tiebreak).limit(k)
