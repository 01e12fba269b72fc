"""Model preparation.

Data-dependent choices (levels of a categorical, medians, means/sd) are bounded
aggregates — at most ``max_levels`` values per column — never a row collection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .ordered import unweighted_quantiles

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def category_levels(df: DataFrame, columns: Sequence[str], max_levels: int = 30) -> dict[str, list]:
    """Distinct non-null levels per column, sorted; columns with more than ``max_levels``
    levels are left out (:func:`left_out` names them).  One aggregate: a bounded
    ``collect_set`` per column (the distinct count is checked first so no set grows past
    the limit)."""
    cols = list(columns)
    counts = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)]).first() if cols else ()
    small = [c for c, n in zip(cols, counts) if n <= 2 * max_levels]
    if not small:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(small)]).first()
    return {c: lv for c, lv in zip(small, row) if 0 < len(lv) <= max_levels}


def left_out(columns: Sequence[str], levels: dict[str, list]) -> list[str]:
    """The columns that :func:`category_levels` left out: too many levels, or none."""
    return [c for c in columns if c not in levels]


def one_hot(df: DataFrame, levels: dict[str, list], drop_first: bool = True) -> DataFrame:
    """One 0/1 column per level (``COL_level``), the alphabetically first level dropped,
    null → all zeros; constant columns (a single kept level that never varies) remain the
    caller's choice."""
    out = df
    for c, lv in levels.items():
        keep = lv[1:] if drop_first else lv
        out = out.withColumns({f"{c}_{v}": F.coalesce((F.col(f"`{c}`").cast("string") == F.lit(v)).cast("double"),
                                                       F.lit(0.0)) for v in keep})
        out = out.select(*[F.col(f"`{x}`") for x in out.columns if x != c])
    return out


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M1: fill nulls with the exact (interpolated) medians, all from one kernel pass; a column
    without values stays null."""
    if not columns:
        return df
    med = medians(df, columns).scalar()
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), med.getField(f"m{i}")) for i, c in enumerate(columns)})


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, one struct m0, m1, …: the interpolated medians of the non-null values of each
    column, by one pass of the grouped ordered kernel over (column, value)."""
    names = [f"x{i}" for i in range(len(columns))]
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)])
    q = unweighted_quantiles(wide.unpivot([], names, "c", "v").where(~F.isnan("v")), "v", [0.5], by="c")
    return q.agg(F.struct(*[F.max(F.when(F.col("c") == n, F.col("q50"))).alias(f"m{i}") for i, n in enumerate(names)]).alias("m"))


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """The vector of ``features``.  The assembler can't take names with a dot (levels such as
    "a.b"), so it gets the columns by position."""
    from pyspark.ml.feature import VectorAssembler
    names = [f"_pd_in{i}" for i in range(len(features))]
    d = df.withColumns({n: F.col(f"`{c}`") for n, c in zip(names, features)})
    return VectorAssembler(inputCols=names, outputCol=out).transform(d).drop(*names)


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row, one column: the interpolated median of the non-null values."""
    return unweighted_quantiles(df.select(F.col(column).cast("double").alias("_m")), "_m", [0.5]).select("q50")


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M2: (x − mean) / population sd; sd = 0 divides by 1."""
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    st = df.agg(F.struct(*[f(v).alias(f"{n}{i}") for i, v in enumerate(x) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).alias("st")).scalar()
    return df.withColumns({c: (v - st.getField(f"m{i}")) / F.when(st.getField(f"s{i}") == 0, F.lit(1.0)).otherwise(st.getField(f"s{i}"))
                           for i, (c, v) in enumerate(zip(columns, x))})


def hash_split(df: DataFrame, key: Sequence[str], train_fraction: float = 0.8,
               seed: int = 42) -> DataFrame:
    """M3: deterministic split by the first 8 hex digits of md5(key ‖ seed): a row is in
    the training set when that number / 16⁸ < ``train_fraction``.  Per stratum the
    proportion holds in expectation; membership survives recomputation and re-partitioning
    (unlike ``randomSplit`` on a changed partitioning)."""
    k = F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed)))
    threshold = format(int(train_fraction * 16 ** 8), "08x")
    return df.withColumn("split", F.when(F.substring(F.md5(k), 1, 8) < F.lit(threshold), "train")
                         .otherwise("test"))


def binary_target(df: DataFrame, column: str, threshold: float | None = None,
                  positive_values: Sequence | None = None, out: str = "target") -> DataFrame:
    """Boolean → int; values already in {0, 1} → int with null → 0; set membership;
    else ``>= threshold`` (null → 0)."""
    c = F.col(column)
    dtype = dict(df.dtypes)[column]
    if dtype == "boolean":
        return df.withColumn(out, F.coalesce(c.cast("int"), F.lit(0)))
    if positive_values is not None:
        return df.withColumn(out, F.coalesce(c.isin(list(positive_values)), F.lit(False)).cast("int"))
    distinct = [r[0] for r in df.select(c).where(c.isNotNull()).distinct().limit(3).collect()]
    if set(distinct) <= {0, 1}:
        return df.withColumn(out, F.coalesce(c.cast("int"), F.lit(0)))
    if threshold is None:
        raise ValueError("binary target needs a threshold or positive values")
    return df.withColumn(out, F.coalesce((c.cast("double") >= threshold).cast("int"), F.lit(0)))


def seeded_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42,
                  portable: bool = False) -> DataFrame:
    """Exactly ``n`` rows without replacement, deterministic for a seed: the n
    smallest hashes of (key, seed) — a bounded top-n heap per task
    (TakeOrderedAndProject), so no full sort and no driver collect.  ``portable`` uses
    md5 of the ``|``-joined key text (reproducible in any SQL engine) instead of xxhash64."""
    if portable:
        h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    else:
        h = F.xxhash64(*[F.col(k) for k in key], F.lit(seed))
    return df.orderBy(h, *key).limit(n)


# Default predictors of the two modelling modes of the reference.
GUIDED_FEATURES = ["CH06", "CH04", "NIVEL_ED", "REGION", "IPCF", "IX_TOT", "ITF"]
EXPERT_FEATURES = ["CH06", "CH04", "NIVEL_ED", "REGION", "IPCF", "IX_TOT"]
GUIDED_TARGET = "INDICE_EXCLUSION"


def model_target(df: DataFrame, mode: str = "guiado", column: str | None = None,
                 threshold: float | None = None, positive_values: Sequence | None = None,
                 out: str = "target") -> tuple[DataFrame, list[str], str]:
    """Target and default predictors.  Guided: the exclusion index ≥ 0.5.  Expert:
    the chosen column as is when it has two distinct values, else ``>=`` a threshold
    (default: its unweighted median, a lazy scalar subquery) for numeric columns, or
    membership in chosen values.  Returns (frame with ``out``, features, target label)."""
    if mode == "guiado":
        if GUIDED_TARGET not in df.columns:
            raise ValueError("guided mode needs the exclusion index")
        feats = [c for c in GUIDED_FEATURES if c in df.columns]
        return (binary_target(df, GUIDED_TARGET, threshold=0.5, out=out), feats,
                f"{GUIDED_TARGET} >= 0.5")
    if column is None:
        raise ValueError("expert mode needs a target column")
    feats = [c for c in EXPERT_FEATURES if c in df.columns and c != column]
    c = F.col(column)
    two = df.select(F.count_distinct(c)).first()[0] == 2
    numeric = dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint", "float", "double") \
        or dict(df.dtypes)[column].startswith("decimal")
    if not two and numeric and positive_values is None:
        thr = F.lit(threshold) if threshold is not None else exact_median(df, column).scalar()
        t = df.withColumn(out, F.coalesce((c.cast("double") >= thr).cast("int"), F.lit(0)))
        return t, feats, column
    if two and positive_values is None and threshold is None:
        t = binary_target(df, column, out=out)
    else:
        t = binary_target(df, column, threshold=threshold, positive_values=positive_values, out=out)
    return t, feats, column
