"""Schema-level operators.

Column-name work is driver-side metadata; anything needing data is one aggregate over
all columns at once (never one job per column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import num


def normalize_names(df: DataFrame) -> DataFrame:
    """Trim + upper-case every column name."""
    return df.toDF(*[c.strip().upper() for c in df.columns])


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, nulls per column, type — one aggregate, unpivoted."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    types = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    return (agg.unpivot(["_rows"], cols, "columna", "nulos")
               .select("columna", F.col("_rows").alias("filas"), F.lit(len(cols)).alias("columnas"),
                       "nulos", types[F.col("columna")].alias("tipo")))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, nulls, % nulls, distinct non-null values per column (exact, or HLL++
    ``approx_count_distinct`` at scale), from one aggregate."""
    cols = df.columns
    dist = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"n{i}"), dist(F.col(c)).alias(f"d{i}")]
    a = df.agg(*aggs)
    types = dict(df.dtypes)
    rows = [F.struct(F.lit(c).alias("columna"), F.lit(types[c]).alias("tipo"),
                     F.col(f"n{i}").alias("nulos"),
                     (100.0 * F.col(f"n{i}") / F.col("_rows")).alias("pct_nulos"),
                     F.col(f"d{i}").alias("distintos")) for i, c in enumerate(cols)]
    return a.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def mixed_type_repair(df: DataFrame, columns: Sequence[str] | None = None,
                      threshold: float = 0.95) -> DataFrame:
    """Blank strings → null; a string column becomes numeric when at least 95 % of its
    non-blank values parse.  The decision for all columns is one aggregate (scalar
    subqueries), the conversion one projection."""
    cols = [c for c, t in df.dtypes if t == "string" and (columns is None or c in columns)]
    if not cols:
        return df
    blank = {c: F.when(F.trim(F.col(c)) != "", F.col(c)) for c in cols}
    stats = df.select(*[blank[c].alias(c) for c in cols]).agg(
        *[(F.count(num(F.trim(F.col(c)))) >= threshold * F.count(F.col(c))).alias(c) for c in cols])
    # one scalar subquery for every decision, bound to a column once (a subquery runs
    # once per reference)
    out = df.withColumn("_s7", stats.select(F.struct(*cols)).scalar())
    for c in cols:
        is_num = F.col(f"_s7.{c}")
        out = out.withColumn(c, F.when(is_num, num(F.trim(blank[c])).cast("string")).otherwise(blank[c]))
    return out.drop("_s7")


def mixed_type_decisions(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """S7 decision table (column, non_blank, numeric, becomes_numeric)."""
    cols = [c for c, t in df.dtypes if t == "string"]
    aggs = []
    for i, c in enumerate(cols):
        b = F.when(F.trim(F.col(c)) != "", F.col(c))
        aggs += [F.count(b).alias(f"b{i}"), F.count(num(F.trim(b))).alias(f"p{i}")]
    a = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("columna"), F.col(f"b{i}").alias("no_vacios"),
                     F.col(f"p{i}").alias("numericos"),
                     ((F.col(f"b{i}") > 0) & (F.col(f"p{i}") >= threshold * F.col(f"b{i}"))).alias("a_numerico"))
            for i, c in enumerate(cols)]
    return a.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def available_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features present and not entirely null (one aggregate)."""
    present = [c for c in features if c in df.columns]
    if not present:
        return []
    row = df.agg(*[F.count(c).alias(c) for c in present]).first()
    return [c for c in present if row[c] > 0]


def split_feature_types(df: DataFrame, features: Sequence[str], nominal: Sequence[str] = (),
                        ordinal: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric vs one-hot features from names and the schema (no job)."""
    types = dict(df.dtypes)
    numeric, categorical = [], []
    for c in features:
        if c in nominal or c.endswith("_LABEL"):
            categorical.append(c)
        elif c in ordinal or types.get(c) in ("int", "bigint", "double", "float", "smallint", "tinyint"):
            numeric.append(c)
        else:
            categorical.append(c)
    return numeric, categorical


def detect_file_types(columns_long: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """S2 over a landing zone: (file, column) rows ⋈ fingerprint → score per (file, tipo):
    0.5 if all required present + 0.3·min(1, typical hits/typical total) when hits ≥ the
    minimum + 0.2·min(1, pattern hits/3); overrides by key + ICT hits; score < 0.5 →
    'desconocido'."""
    fp = fingerprints
    cols = columns_long.select("file", F.upper(F.trim("column")).alias("column")).distinct()
    tipos = fp.select("tipo", "pattern", "minimum").distinct()
    need = fp.groupBy("tipo").agg(
        F.count(F.when(F.col("role") == "required", 1)).alias("n_req"),
        F.count(F.when(F.col("role") == "typical", 1)).alias("n_typ"))
    hits = cols.join(fp, "column").groupBy("file", "tipo").agg(
        F.count(F.when(F.col("role") == "required", 1)).alias("h_req"),
        F.count(F.when(F.col("role") == "typical", 1)).alias("h_typ"))
    pat = (cols.join(tipos.where(F.col("pattern").isNotNull()),
                     F.expr("column rlike pattern"))
               .groupBy("file", "tipo").agg(F.count(F.lit(1)).alias("h_pat")))
    files = cols.select("file").distinct()
    # every file is scored against each fingerprint type (a fixed, tiny list)
    type_names = [r[0] for r in tipos.select("tipo").collect()]
    grid = (files.withColumn("tipo", F.explode(F.array(*[F.lit(t) for t in type_names])))
                 .join(F.broadcast(tipos.join(need, "tipo")), "tipo"))
    s = (grid.join(hits, ["file", "tipo"], "left").join(pat, ["file", "tipo"], "left")
             .fillna(0, ["h_req", "h_typ", "h_pat"]))
    score = (F.when(F.col("h_req") == F.col("n_req"), 0.5).otherwise(0.0)
             + F.when(F.col("h_typ") >= F.col("minimum"),
                      0.3 * F.least(F.lit(1.0), F.col("h_typ") / F.col("n_typ"))).otherwise(0.0)
             + 0.2 * F.least(F.lit(1.0), F.col("h_pat") / 3.0))
    s = s.withColumn("score", score)
    per_file = s.groupBy("file").agg(
        F.max_by("tipo", "score").alias("best"), F.max("score").alias("best_score"),
        F.max(F.when((F.col("tipo") == "individuo") & (F.col("h_req") == F.col("n_req")), 1)).alias("k_ind"),
        F.max(F.when((F.col("tipo") == "hogar") & (F.col("h_req") == F.col("n_req")), 1)).alias("k_hog"),
        F.max(F.when(F.col("tipo") == "tic_individual", F.col("h_typ") + F.col("h_pat"))).alias("ict_i"),
        F.max(F.when(F.col("tipo") == "tic_hogar", F.col("h_typ") + F.col("h_pat"))).alias("ict_h"))
    tipo = (F.when((F.col("k_ind") == 1) & (F.col("ict_i") > 0), "tic_individual")
             .when(F.col("k_ind") == 1, "individuo")
             .when((F.col("k_hog") == 1) & (F.col("ict_h") > 0), "tic_hogar")
             .when(F.col("k_hog") == 1, "hogar")
             .when(F.col("best_score") >= 0.5, F.col("best"))
             .otherwise("desconocido"))
    return per_file.select("file", tipo.alias("tipo"), F.col("best_score").alias("score"))


def describe_column(variables: DataFrame, column: str) -> DataFrame:
    """S3: section and metadata of one column from the ``variables`` dimension of a code
    book (lookup on the upper-cased name)."""
    return variables.where(F.upper(F.col("variable")) == column.strip().upper())


def candidate_columns(profile: DataFrame, max_distinct: int | None = 30,
                      numeric_only: bool = False) -> DataFrame:
    """Selector candidates from the S6 profile — categorical (≤ ``max_distinct``
    distinct values) or numeric with more than one distinct value."""
    numeric = F.col("tipo").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    if numeric_only:
        return profile.where(numeric & (F.col("distintos") > 1))
    return profile.where(F.col("distintos") <= max_distinct)
