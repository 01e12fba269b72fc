"""Equi-joins of the survey files.

Only equi-joins exist.  Person ⟕ household is a many-to-one join on the household key;
both sides are large, so it is a shuffle (sort-merge) join on the key — AQE may turn it
into a broadcast when the household side turns out small at run time, and splits skewed
key partitions (``spark.sql.adaptive.skewJoin.enabled``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HOUSEHOLD_KEY = ["CODUSU", "NRO_HOGAR"]
PERSON_KEY = ["CODUSU", "NRO_HOGAR", "COMPONENTE"]


def require_keys(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise when key columns are missing (driver-side metadata, no job)."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"{what}: missing key columns {missing}")


def row_hash(df: DataFrame):
    """A hash of all columns: the last tie-breaker, equal only for equal rows."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Deterministic keep-first per key: the smallest row by ``order``, then by a hash of
    the row, so the result doesn't depend on the input's order.  One aggregate that combines on
    the map side, so a hot key sends one row per task.  ``order`` are column names, ascending
    and nulls first."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    q = lambda c: F.col(f"`{c}`")
    first = F.min_by(F.struct(*[q(c) for c in rest]), F.struct(*[q(c) for c in order], row_hash(df)))
    out = df.groupBy(*[q(k) for k in keys]).agg(first.alias("_first"))
    return out.select(*[q(c) if c in keys else F.col("_first").getField(c).alias(c) for c in df.columns])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J3 report: rows, distinct keys and duplicated rows in one aggregate."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return per.agg(F.sum("_c").alias("filas"), F.count(F.lit(1)).alias("claves"),
                   F.sum(F.col("_c") - 1).alias("duplicadas"))


def household_join(household: DataFrame, person: DataFrame, keys: Sequence[str] = HOUSEHOLD_KEY,
                   order: Sequence | None = None, validate: bool = True) -> DataFrame:
    """Person ⟕ household, adding only household columns not already present.
    Households are reduced to the first row per key (J3); a ``_hh`` marker column tells
    matched rows apart (J4) in the same pass."""
    keys = list(keys)
    if validate:
        require_keys(household, keys, "household")
        require_keys(person, keys, "person")
    new_cols = [c for c in household.columns if c not in person.columns]
    order = [c for c in (order or []) if isinstance(c, str) and c in household.columns]
    extra = [c for c in order if c not in new_cols and c not in keys]
    h = household.select(*keys, *new_cols, *extra)
    h = keep_first(h, keys, order).drop(*extra) if validate else h.drop(*extra)
    return person.join(h.withColumn("_hh", F.lit(1)), keys, "left")


def merge_stats(joined: DataFrame, keys: Sequence[str] = HOUSEHOLD_KEY) -> DataFrame:
    """Distinct households, persons, orphans (no household match) — one aggregate."""
    return joined.agg(F.count_distinct(*[F.col(k) for k in keys]).alias("hogares"),
                      F.count(F.lit(1)).alias("personas"),
                      F.count(F.when(F.col("_hh").isNull(), 1)).alias("huerfanos"))


def orphans(person: DataFrame, household: DataFrame, keys: Sequence[str] = HOUSEHOLD_KEY) -> DataFrame:
    """Persons without a household (anti join)."""
    return person.join(household.select(*keys).distinct(), list(keys), "left_anti")


def semi_reduce(household: DataFrame, person: DataFrame, keys: Sequence[str] = ("CODUSU",)) -> DataFrame:
    """Keep households that have at least one selected person (semi join)."""
    return household.join(person.select(*keys), list(keys), "left_semi")


def label_join(df: DataFrame, dim: DataFrame, code: str, out: str,
               dim_code: str = "code", dim_name: str = "name") -> DataFrame:
    """Code → label via a join with a code book (planner broadcasts it by size)."""
    d = dim.select(F.col(dim_code).alias("_code"), F.col(dim_name).alias(out))
    return df.join(d, df[code] == d["_code"], "left").drop("_code")


def geo_inner(catalog: DataFrame, coords: DataFrame, code: str = "aglomerado_codigo") -> DataFrame:
    """Enrich with coordinates, dropping unmatched rows (inner join)."""
    return catalog.join(coords, catalog[code] == coords["code"], "inner").drop("code")


def compare_indicators(before: DataFrame, after: DataFrame, id_cols: Sequence[str],
                       indicators: Sequence[str]) -> DataFrame:
    """Unpivot both KPI rows and line them up by (id…, indicator) with the delta; a
    null id is an id."""
    def long(df, name, other):
        return df.select(*id_cols, *[F.col(c).cast("double") for c in indicators]) \
                 .unpivot(list(id_cols), list(indicators), "indicador", name).withColumn(other, F.lit(None).cast("double"))
    both = long(before, "base", "escenario").unionByName(long(after, "escenario", "base"))
    out = both.groupBy(*id_cols, "indicador").agg(F.max("base").alias("base"), F.max("escenario").alias("escenario"))
    return out.withColumn("delta", F.col("escenario") - F.col("base"))


def person_only_stats(person: DataFrame, keys: Sequence[str] = HOUSEHOLD_KEY) -> DataFrame:
    """No household table — the person table passes through; distinct households
    (by key) and persons from one aggregate."""
    return person.agg(F.count_distinct(*[F.col(k) for k in keys]).alias("hogares"),
                      F.count(F.lit(1)).alias("personas"))
