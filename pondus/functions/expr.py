"""Generic expression helpers shared by all operators.

Null semantics follow SQL; the few places where the survey code relied on pandas'
"null compares False" are written with ``coalesce`` explicitly.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: ColumnOrName) -> Column:
    """Lenient numeric coercion: text that does not parse becomes null, NaN becomes null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def num_comma(c: ColumnOrName) -> Column:
    """Decimal-comma text ("12,5") to double; blanks and junk to null."""
    s = F.trim(col(c).cast("string"))
    return num(F.regexp_replace(s, ",", "."))


def nan_to_null(c: ColumnOrName) -> Column:
    x = col(c)
    return F.when(~F.isnan(x), x)


def flag(cond: Column) -> Column:
    """Boolean condition to 0.0/1.0 where null counts as 0 (pandas comparison rule)."""
    return F.coalesce(cond.cast("double"), F.lit(0.0))


def isin_safe(c: ColumnOrName, values: Iterable) -> Column:
    """``isin`` with null -> False."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def row_mean(cols: Iterable[ColumnOrName]) -> Column:
    """Row-wise mean ignoring nulls; null when every input is null."""
    cols = [col(c) for c in cols]
    if not cols:
        return F.lit(None).cast("double")
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    count = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return total / F.nullif(count, F.lit(0))


def lookup(mapping: Mapping, key: ColumnOrName) -> Column:
    """Code -> label through a literal map (small, fixed code books only)."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[col(key)]


def wmean(x: ColumnOrName, w: ColumnOrName) -> Column:
    """Pairwise-complete weighted mean aggregate: rows with x or w null are skipped."""
    x, w = col(x), col(w)
    ok = x.isNotNull() & w.isNotNull()
    return F.sum(F.when(ok, x * w)) / F.sum(F.when(ok, w))


def wmean_where(x: ColumnOrName, w: ColumnOrName, cond: Column) -> Column:
    """Weighted mean restricted to rows where ``cond`` is true (conditional aggregate)."""
    x, w = col(x), col(w)
    ok = x.isNotNull() & w.isNotNull() & F.coalesce(cond, F.lit(False))
    return F.sum(F.when(ok, x * w)) / F.sum(F.when(ok, w))


def count_where(cond: Column) -> Column:
    return F.count(F.when(F.coalesce(cond, F.lit(False)), F.lit(1)))


def join_groups(left: DataFrame, right: DataFrame, on: Iterable[str], how: str = "inner") -> DataFrame:
    """Equi-join on group columns where null is a group of its own (null meets null).  Columns
    come from ``left``, then those of ``right`` that aren't in ``on``."""
    on = list(on)
    if not on:
        raise ValueError("join_groups needs group columns")
    names = {c: f"_pd_right_{i}" for i, c in enumerate(on)}
    r = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *[F.col(f"`{c}`") for c in right.columns if c not in names])
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in names.items()])
    return left.join(r, same, how).drop(*names.values())
