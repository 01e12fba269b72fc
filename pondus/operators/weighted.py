"""Weighted aggregations.

Every operator is one ``groupBy``/``agg`` (map-side partial aggregation), followed only by
operations on the *aggregated* rows (shares, pivots), which are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import join_groups, num, wmean
from . import ordered
from .ordered import _as_list

NULL_LABEL = "(NaN)"


# ---------------------------------------------------------------------------
# G1 weight resolution (three policies, trap T3)
# ---------------------------------------------------------------------------

def resolve_weight(df: DataFrame, weight: str | None, policy: str = "zero") -> tuple[DataFrame, str]:
    """Return (df, weight column) under a null policy:

    ``zero``  null → 0 and "unweighted" when the column is missing or Σw ≤ 0 (decided by
              a scalar subquery, so the choice is lazy and made per run);
    ``drop``  rows with null or non-positive weight are dropped;
    ``one``   null → 1.
    """
    if not weight or weight not in df.columns:
        return df.withColumn("_wt", F.lit(1.0)), "_wt"
    w = num(weight)
    if policy == "one":
        return df.withColumn("_wt", F.coalesce(w, F.lit(1.0))), "_wt"
    if policy == "drop":
        return df.withColumn("_wt", w).where(F.col("_wt") > 0), "_wt"
    wz = F.coalesce(w, F.lit(0.0))
    positive = df.agg(F.sum(wz) > 0).scalar()
    return df.withColumn("_wt", F.when(positive, wz).otherwise(F.lit(1.0))), "_wt"


# ---------------------------------------------------------------------------
# G2 frequency table, G8 stacked frequencies, G18 class balance
# ---------------------------------------------------------------------------

def frequencies(df: DataFrame, column: str, weight: str | None = None, *,
                include_nulls: bool = True, order: str = "n") -> DataFrame:
    """Categoria, n, pct, n_weighted (Σw), pct_weighted; nulls as '(NaN)' or dropped.

    Shares are computed on the aggregated rows (one row per category)."""
    d, w = resolve_weight(df, weight)
    cat = F.col(column).cast("string")
    if include_nulls:
        cat = F.coalesce(cat, F.lit(NULL_LABEL))
    else:
        d = d.where(F.col(column).isNotNull())
    agg = d.groupBy(cat.alias("categoria")).agg(F.count(F.lit(1)).alias("n"),
                                                F.sum(w).alias("n_ponderado"))
    # totals as a scalar subquery: any number of categories, none of them in one task
    out = agg.withColumn("_t", agg.agg(F.struct(F.sum("n").alias("n"), F.sum("n_ponderado").alias("w"))).scalar())
    out = out.select("categoria", "n", (100 * F.col("n") / F.col("_t.n")).alias("pct"),
                     "n_ponderado", (100 * F.col("n_ponderado") / F.col("_t.w")).alias("pct_ponderado"))
    return out.orderBy(F.desc("n"), "categoria") if order == "n" else out.orderBy("categoria")


def frequencies_stacked(df: DataFrame, columns: Sequence[str], weight: str = "PONDERA",
                        labeler=None) -> DataFrame:
    """Weighted % by category for several variables in one job: unpivot to
    (variable, categoria, w) → one groupBy → share within the variable."""
    labeler = labeler or (lambda name, c: F.coalesce(c.cast("string"), F.lit("Sin dato")))
    cols = [c for c in columns if c in df.columns]
    long = df.select(F.col(weight).alias("_w"), *[labeler(c, F.col(c)).alias(c) for c in cols])
    long = long.unpivot(["_w"], cols, "variable", "categoria")
    agg = long.groupBy("variable", "categoria").agg(F.sum("_w").alias("_sw"))
    return agg.select("variable", "categoria",
                      (100 * F.col("_sw") / F.sum("_sw").over(Window.partitionBy("variable")))
                      .alias("pct_ponderado"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Share of each class."""
    agg = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return agg.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


# ---------------------------------------------------------------------------
# G3/G4 summaries
# ---------------------------------------------------------------------------

def summary(df: DataFrame, column: str, weight: str | None = None,
            quantiles: Sequence[float] = (0.25, 0.5, 0.75), by=None, *,
            weighted: bool = True) -> DataFrame:
    """N, valid, missing, mean, sd, se, df, min, max and quantiles.

    Weighted (survey-statistics convention, Σw acts as the sample size): mean Σwx/Σw,
    variance Σw(x−mean)²/(Σw−1), se = sd/√Σw, t-interval on Σw−1 degrees of freedom
    (bounds added by :func:`add_t_interval`: Student-t quantile per distinct d.f.).
    Unweighted: sample sd, mean ± 1.96·sd/√n, interpolated quantiles.
    The variance is computed as Σw(x−c)² − (Σw(x−c))²/Σw around a per-group shift
    ``c`` (the group minimum) to avoid cancellation.
    """
    by = _as_list(by)
    x = num(column)
    if weighted and weight:
        d, w = resolve_weight(df, weight)
    else:
        d, w = df.withColumn("_wt", F.lit(1.0)), "_wt"
        weighted = False
    d = d.withColumn("_x", x)
    if by:
        shift = d.groupBy(*by).agg(F.min("_x").alias("_c"))
        d = join_groups(d, shift, by)
    else:
        d = d.withColumn("_c", d.agg(F.min("_x")).scalar())
    dx = F.col("_x") - F.col("_c")
    out = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count("_x").alias("n_validos"),
        F.min("_x").alias("min"), F.max("_x").alias("max"),
        F.sum(F.when(F.col("_x").isNotNull(), F.col(w))).alias("_sw"),
        F.sum(F.col(w) * F.col("_x")).alias("_swx"),
        F.avg("_x").alias("_mean_u"), F.stddev_samp("_x").alias("_sd_u"),
        F.sum(F.col(w) * dx).alias("_s1"), F.sum(F.col(w) * dx * dx).alias("_s2"))
    if weighted:
        var = (F.col("_s2") - F.col("_s1") ** 2 / F.col("_sw")) / (F.col("_sw") - 1)
        out = out.select(*by, "n", "n_validos", (F.col("n") - F.col("n_validos")).alias("missing"),
                         (F.col("_swx") / F.col("_sw")).alias("mean"),
                         F.sqrt(var).alias("sd"), (F.sqrt(var) / F.sqrt(F.col("_sw"))).alias("se"),
                         (F.col("_sw") - 1).alias("dof"), "min", "max")
    else:
        out = out.select(*by, "n", "n_validos", (F.col("n") - F.col("n_validos")).alias("missing"),
                         F.col("_mean_u").alias("mean"), F.col("_sd_u").alias("sd"),
                         (F.col("_sd_u") / F.sqrt(F.col("n_validos"))).alias("se"),
                         (F.col("n_validos") - 1).cast("double").alias("dof"), "min", "max")
    if quantiles:
        if weighted:
            q = ordered.weighted_quantiles(d.withColumn("_xq", F.col("_x")), "_xq", w,
                                           list(quantiles) + [0.5] if 0.5 not in quantiles
                                           else list(quantiles), by)
        else:
            q = ordered.unweighted_quantiles(d, "_x", list(quantiles) + ([0.5] if 0.5 not in quantiles
                                                                      else []), by)
        q = q.withColumnRenamed("q50", "median")
        # a group without values has no quantiles, but its counts
        out = join_groups(out, q, by, "left") if by else _one_row_join(out, q)
    return out


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two single-row aggregates (both have exactly one row: a bounded pairing)."""
    k = "_one"
    return a.withColumn(k, F.lit(1)).join(F.broadcast(b.withColumn(k, F.lit(1))), k).drop(k)


def _t_quantile_udf(q: float):
    """Arrow-batched Student-t quantile: one scalar evaluation per distinct d.f. in the
    batch (a small per-value helper, no driver round trip, no cap on groups)."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    from ..functions.dist import t_ppf

    def tq(dof):
        vals = {v: t_ppf(q, float(v)) for v in dof.dropna().unique() if v > 0}
        return dof.map(vals).astype("float64")

    tq.__annotations__ = {"dof": pd.Series, "return": pd.Series}  # real types (module uses PEP 563)
    return pandas_udf(tq, "double")


def add_t_interval(summary_df: DataFrame, level: float = 0.95, weighted: bool = True) -> DataFrame:
    """Confidence bounds mean ± t·se with t on ``dof`` degrees of freedom (weighted), or
    ± 1.96·se (unweighted)."""
    if not weighted:
        z = 1.96
        return summary_df.withColumns({"ci_low": F.col("mean") - z * F.col("se"),
                                       "ci_high": F.col("mean") + z * F.col("se")})
    t = _t_quantile_udf(0.5 + level / 2)(F.col("dof"))
    return (summary_df.withColumn("_tq", t)
            .withColumns({"ci_low": F.col("mean") - F.col("_tq") * F.col("se"),
                          "ci_high": F.col("mean") + F.col("_tq") * F.col("se")})
            .drop("_tq"))


def summary_all(df: DataFrame, columns: Sequence[str], weight: str | None = None,
                quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The G3 summary for many numeric columns as **one** grouped job over the
    unpivoted (variable, value, w) table instead of a loop of jobs."""
    d, w = resolve_weight(df, weight)
    long = (d.select(F.col(w).alias("_w8"), *[num(c).alias(c) for c in columns])
              .unpivot(["_w8"], list(columns), "variable", "valor"))
    return summary(long, "valor", "_w8" if weight else None, quantiles, by="variable",
                   weighted=bool(weight))


# ---------------------------------------------------------------------------
# G5 cross-tab
# ---------------------------------------------------------------------------

def crosstab(df: DataFrame, row: str, column: str, weight: str | None = None,
             normalize: str | None = "row") -> DataFrame:
    """G5 long form: (row, column, value) with value = Σw, or ×100 shares within the row,
    the column or the total (computed on the aggregated cells)."""
    d, w = resolve_weight(df, weight)
    cells = d.groupBy(row, column).agg(F.sum(w).alias("valor"))
    part = {"row": [row], "column": [column], "total": []}
    if normalize is None:
        return cells
    return cells.withColumn("valor", 100 * F.col("valor")
                            / F.sum("valor").over(Window.partitionBy(*part[normalize])))


def crosstab_pivot(long: DataFrame, row: str, column: str, levels: Sequence) -> DataFrame:
    """Wide form with explicit column levels (no extra distinct job)."""
    return long.groupBy(row).pivot(column, list(levels)).agg(F.first("valor"))


# ---------------------------------------------------------------------------
# G14 group comparison, G19 gated correlation, G16/G17
# ---------------------------------------------------------------------------

def group_compare(df: DataFrame, value: str, group: str, weight: str | None = None, *,
                  method: str = "bucketed") -> DataFrame:
    """Per group (null group kept) Σw, weighted mean, lower weighted median, Gini,
    sorted by mean descending: one grouped running pass gives all four."""
    cd = ordered.cumulative_distribution(df, value, weight, group, method=method)
    return cd.groupBy(group).agg(
        F.sum("_w").alias("w_sum"), (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("mean"),
        ordered.median_of().alias("median_lower"), ordered.gini_of().alias("gini")).orderBy(F.desc("mean"), group)


def gated_corr(df: DataFrame, x: str, y: str, min_rows: int = 10) -> DataFrame:
    """Pearson r only when more than ``min_rows`` complete rows exist."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    n = F.count(F.when(ok, 1))
    return df.agg(n.alias("n"), F.when(n > min_rows, F.corr(x, y)).alias("r"))


def null_counts(df: DataFrame, top: int | None = 5) -> DataFrame:
    """Nulls per column (one aggregate + unpivot), the ``top`` columns with most."""
    cols = df.columns
    agg = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    long = agg.unpivot([], cols, "columna", "nulos")
    long = long.where(F.col("nulos") > 0)
    return long.orderBy(F.desc("nulos"), "columna").limit(top) if top else long


def weighted_mean(df: DataFrame, x: str, w: str, by=None) -> DataFrame:
    """Pairwise-complete weighted mean (null when no complete row)."""
    return df.groupBy(*_as_list(by)).agg(wmean(x, w).alias("wmean"))


# The income-weight fallback order of the reference (household-income
# weight, then person-income weight).
INCOME_WEIGHTS = ("PONDIH", "PONDII")


def income_weight(df: DataFrame, candidates: Sequence[str] = INCOME_WEIGHTS) -> str | None:
    """The first income weight present in the table, else none (unweighted)."""
    return next((c for c in candidates if c in df.columns), None)
