"""Correlation and scale reliability.

All k² coefficients of a matrix come out of **one** aggregate; ranks come from the
ordered kernel; p-values are driver-side scalars (one per pair, a bounded list).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.dist import norm_two_sided_p, t_two_sided_p
from . import ordered
from ..session import materialise


def pearson_long(df: DataFrame, columns: Sequence[str], *, diagonal: bool = True,
                 both_triangles: bool = True) -> DataFrame:
    """Pairwise-complete Pearson r and n for every pair, long form
    (var1, var2, r, n), from one aggregate (``corr`` skips rows with a null side)."""
    cols = list(columns)
    pairs = [(a, b) for a, b in combinations(cols, 2)]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.corr(a, b).alias(f"r{i}"), F.count(F.when(ok, 1)).alias(f"n{i}")]
    for j, c in enumerate(cols):
        aggs.append(F.count(c).alias(f"d{j}"))
    wide = df.select(*[F.col(c).cast("double") for c in cols]).agg(*aggs)
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                             F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")))
        if both_triangles:
            rows.append(F.struct(F.lit(b).alias("var1"), F.lit(a).alias("var2"),
                                 F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")))
    if diagonal:
        for j, c in enumerate(cols):
            rows.append(F.struct(F.lit(c).alias("var1"), F.lit(c).alias("var2"),
                                 F.when(F.col(f"d{j}") > 1, F.lit(1.0)).alias("r"),
                                 F.col(f"d{j}").alias("n")))
    return wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def rank_table(df: DataFrame, column: str, out: str, *, method: str = "bucketed",
               splits: Sequence[float] | None = None) -> DataFrame:
    """(value ``_rv``, average rank ``out``) for every distinct non-null value."""
    red = (df.where(F.col(column).isNotNull())
             .groupBy(F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).cast("double").alias("_w")))
    red = ordered.running_weight(red, ["_v"], "_w", method=method, total=None, splits=splits)
    return red.select(F.col("_v").alias("_rv"), (F.col("_excl") + (F.col("_w") + 1) / 2).alias(out))


def spearman_long(df: DataFrame, columns: Sequence[str], *, listwise: bool = True,
                  method: str = "bucketed") -> DataFrame:
    """R2: Pearson of average ranks, on the listwise-complete frame or, with
    ``listwise=False``, on each pair's own complete rows."""
    cols = list(columns)
    if not listwise:
        return _spearman_pairwise(df, cols)
    base = df.select(*cols).dropna()
    d = base
    splits = [None] * len(cols)
    if method == "bucketed":
        # split points of every column from one sketch pass (not one job per column)
        nb = ordered._default_buckets(base)
        probs = [i / nb for i in range(1, nb)]
        splits = base.select(*[F.col(c).cast("double").alias(c) for c in cols]) \
                     .approxQuantile(cols, probs, 1e-3)
    for c, sp in zip(cols, splits):
        # each rank table is computed from the base rows (not from the previous joins)
        d = d.join(rank_table(base, c, f"_rk_{c}", method=method, splits=sp),
                   F.col(c).cast("double") == F.col("_rv"), "left").drop("_rv")
    r = pearson_long(d.select(*[F.col(f"_rk_{c}").alias(c) for c in cols]), cols,
                     diagonal=False, both_triangles=False)
    return r


def _spearman_pairwise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Ranks within each pair's complete rows, every pair as a group of one job: first one
    row per distinct (pair, x, y), then per distinct value of either side a rank from the
    grouped kernel, joined back to the distinct points.  A value that many rows share is one
    point here, so it makes no hot key."""
    pairs = list(combinations(cols, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, r double, n long")
    one = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*").dropna()
    points = materialise(one.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")), "points")
    d = points
    for c in ("x", "y"):
        # both are written: the kernel reads its input three times, and the planner sees the
        # size of the ranks (of few values they are broadcast)
        red = materialise(points.groupBy("pair", F.col(c).alias("_v")).agg(F.sum("w").alias("_w")), "values")
        red = ordered.running_weight(red, ["_v"], "_w", "pair", total="_n")
        # n ranks have the mean (n + 1) / 2, with ties as without
        rank = F.col("_excl") + (F.col("_w") + 1) / 2 - (F.col("_n") + 1) / 2
        d = d.join(materialise(red.select("pair", F.col("_v").alias(c), rank.alias(f"d{c}")), "ranks"), ["pair", c])
    w, dx, dy = F.col("w"), F.col("dx"), F.col("dy")
    out = d.groupBy("pair").agg(F.sum("w").alias("n"), F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"))
    r = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    every = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, var1 string, var2 string")
    return every.join(F.broadcast(out), "pair", "left").select("var1", "var2", r.alias("r"), F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("n"))


def kendall_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """τ-b, n and the tie-corrected p of every pair, each on its own complete rows."""
    pairs = [kendall_tau_b(df, a, b) for a, b in combinations(list(columns), 2)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, r double, n long, p double")
    return reduce(DataFrame.unionByName, pairs).select("var1", "var2", F.col("tau_b").alias("r"), "n", "p")


def matrix(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A pair table as the full square, long form: both triangles and a diagonal of 1."""
    diagonal = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "var1 string, var2 string, r double")
    return (pairs.select("var1", "var2", "r").unionByName(pairs.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r"))
            .unionByName(diagonal))


METHODS = ("pearson", "spearman", "kendall")


def corr_pairs(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Listwise frame, one row per unordered pair (var1, var2, r, n), ordered by |r|."""
    if method not in METHODS:
        raise ValueError(f"method {method!r}; one of {', '.join(METHODS)}")
    cols = list(columns)
    d = df.select(*[F.col(c).cast("double") for c in cols]).dropna()
    if method == "spearman":
        out = spearman_long(d, cols)
    elif method == "kendall":
        out = kendall_long(d, cols)
    else:
        out = pearson_long(d, cols, diagonal=False, both_triangles=False)
    return out.orderBy(F.abs("r").desc_nulls_last(), "var1", "var2")


def with_p_values(pairs: DataFrame, method: str = "pearson") -> DataFrame:
    """Attach two-sided p and 5 % significance: t for Pearson and Spearman; Kendall's pairs
    bring their tie-corrected p with them.  The pair table has k(k−1)/2 rows (k is the
    number of *columns*), so its p-values are computed as a grouped pandas map."""
    if method not in METHODS:
        raise ValueError(f"method {method!r}; one of {', '.join(METHODS)}")
    if method == "kendall":
        return pairs.withColumn("significativo", F.col("p") < 0.05)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        ps = []
        for r, n in zip(pdf["r"], pdf["n"]):
            if r is None or np.isnan(r) or n is None or n < 3:
                ps.append(np.nan)
            elif abs(r) >= 1.0:
                ps.append(0.0)
            else:
                t = r * np.sqrt((n - 2) / (1 - r * r))
                ps.append(t_two_sided_p(float(t), float(n - 2)))
        pdf = pdf.assign(p=ps)
        return pdf.assign(significativo=pdf["p"] < 0.05)
    schema = pairs.schema.simpleString()[len("struct<"):-1] + ",p:double,significativo:boolean"
    return pairs.mapInPandas(lambda it: (fn(p) for p in it), schema)


def cronbach(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """α = k/(k−1)·(1 − Σ var_i / var_total) with sample variances on the listwise
    frame; zero total variance → null; α-if-item-deleted for every item — all from one
    aggregate of 2k+1 variances.  Fewer than two items are a ValueError."""
    items = list(items)
    k = len(items)
    if k < 2:
        raise ValueError(f"the scale's reliability needs two items or more, not {k}")
    d = df.select(*[F.col(c).cast("double") for c in items]).dropna()
    total = sum((F.col(c) for c in items), F.lit(0.0))
    aggs = [F.var_samp(c).alias(f"v{i}") for i, c in enumerate(items)]
    aggs += [F.var_samp(total).alias("vt"), F.count(F.lit(1)).alias("n")]
    aggs += [F.var_samp(total - F.col(c)).alias(f"vd{i}") for i, c in enumerate(items)]
    a = d.agg(*aggs)
    sum_v = sum((F.col(f"v{i}") for i in range(k)), F.lit(0.0))
    alpha = F.when(F.col("vt") > 0, (k / (k - 1)) * (1 - sum_v / F.col("vt")))
    rows = [F.struct(F.lit("(todos)").alias("item"), alpha.alias("alpha"))]
    if k > 2:
        for i, c in enumerate(items):
            sv = sum_v - F.col(f"v{i}")
            ai = F.when(F.col(f"vd{i}") > 0, ((k - 1) / (k - 2)) * (1 - sv / F.col(f"vd{i}")))
            rows.append(F.struct(F.lit(c).alias("item"), ai.alias("alpha")))
    return a.select(F.col("n"), F.explode(F.array(*rows)).alias("x")).select("x.*", "n")


def alpha_grade(alpha) -> str:
    """Verbal grade of α (.9 excellent, .8 good, .7 acceptable, .6 questionable)."""
    if alpha is None or np.isnan(alpha):
        return "no calculable"
    for thr, lab in ((0.9, "excelente"), (0.8, "buena"), (0.7, "aceptable"), (0.6, "cuestionable")):
        if alpha >= thr:
            return lab
    return "pobre"


# ---------------------------------------------------------------------------
# D6 Kendall tau-b
# ---------------------------------------------------------------------------

def _pair_sum(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Σ_{i<j} w_i w_j sgn(x_i−x_j) sgn(y_i−y_j) over weighted points (exact).

    Divide and conquer on x: pairs across the split are ordered in x, so their sign is
    the sign of the y difference, counted with a sorted prefix of weights."""
    if len(x) < 2:
        return 0.0
    o = np.argsort(x, kind="stable")
    x, y, w = x[o], y[o], w[o]
    return _dc(x, y, w)


def _dc(x, y, w) -> float:
    n = len(x)
    if n <= 512:
        dx = np.sign(x[:, None] - x[None, :])
        dy = np.sign(y[:, None] - y[None, :])
        return float((np.triu(dx * dy, 1) * np.outer(w, w)).sum())
    mid = n // 2
    # move the cut to a change of x so equal x values stay on one side
    cut = np.searchsorted(x, x[mid], side="left")
    if cut == 0:
        cut = np.searchsorted(x, x[mid], side="right")
        if cut == n:
            return 0.0  # all x equal: every pair is tied in x
    ly, lw, ry, rw = y[:cut], w[:cut], y[cut:], w[cut:]
    o = np.argsort(ry, kind="stable")
    rys, rws = ry[o], np.concatenate([[0.0], np.cumsum(rw[o])])
    below = rws[np.searchsorted(rys, ly, side="left")]
    above = rws[-1] - rws[np.searchsorted(rys, ly, side="right")]
    cross = float((lw * (above - below)).sum())
    return cross + _dc(x[:cut], ly, lw) + _dc(x[cut:], ry, rw)


KENDALL_GROUP = 4096  # distinct points of the last, smallest grid; buckets hold about as many


def _edges(d: DataFrame, c: str, nb: int) -> tuple[list[float], set[int]]:
    """Split points of ``c`` (≈ equal point counts per bucket) and the indices of the
    buckets that hold a single hot value: a value repeated in the quantile sketch gets
    the bucket [v, next float after v), so its tie block never shares a group."""
    raw = ordered._raw_quantiles(d, c, nb, min(1e-3, 0.25 / nb))
    hot = {v for v, times in Counter(raw).items() if times > 1}
    splits = sorted(set(raw) | {float(np.nextafter(v, np.inf)) for v in hot})
    edges = [float("-inf")] + splits
    single = {i for i, e in enumerate(edges) if e in hot}
    return splits, single


def _group_sums(d: DataFrame, keys: list[str]) -> float:
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        s = _pair_sum(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame({"s": [s]})
    return d.groupBy(*keys).applyInPandas(fn, "s double").agg(F.sum("s")).first()[0] or 0.0


def kendall_s(d: DataFrame, *, min_buckets: int = 16, group_limit: int = KENDALL_GROUP,
              n: int | None = None) -> float:
    """S = Σ_{i<j} w_i w_j sgn(x_i − x_j) sgn(y_i − y_j) over weighted distinct points
    ``d(x, y, w)``, exact, without emitting pairs.

    x and y are cut into G value buckets (G grows with the data so that a bucket holds
    about ``group_limit`` points).  Pairs in different x- and different y-buckets take
    their signs from the bucket indices, so their sum is the same statistic over the
    bucket grid (cells weighted by Σw) — computed recursively, the grid being smaller.
    The rest, S_x + S_y − S_cell, is summed exactly inside each x-bucket, y-bucket and
    cell by divide and conquer, one bounded pandas group each.  Buckets of a single
    (hot) value contribute nothing (all their pairs are tied) and are never loaded."""
    n = d.count() if n is None else n
    if n < 2:
        return 0.0
    if n <= group_limit:  # the recursion's end: at most group_limit cells
        return _group_sums(d.withColumn("_one", F.lit(0)), ["_one"])
    g = max(min_buckets, min(math.ceil(2 * n / group_limit), math.isqrt(n // 2)))
    sx, single_x = _edges(d, "x", g)
    sy, single_y = _edges(d, "y", g)
    b = ordered._bucketize(ordered._bucketize(d, "x", sx, "bx"), "y", sy, "by")
    b = b.withColumns({"bx": F.col("bx").cast("int"), "by": F.col("by").cast("int")}).cache()
    try:
        keep_x = ~F.col("bx").isin(list(single_x)) if single_x else F.lit(True)
        keep_y = ~F.col("by").isin(list(single_y)) if single_y else F.lit(True)
        s_x = _group_sums(b.where(keep_x), ["bx"])
        s_y = _group_sums(b.where(keep_y), ["by"])
        s_c = _group_sums(b.where(keep_x & keep_y), ["bx", "by"])
        grid = b.groupBy(F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y")) \
                .agg(F.sum("w").alias("w"))
        s_cross = kendall_s(grid, min_buckets=min_buckets, group_limit=group_limit)
    finally:
        b.unpersist()
    return s_cross + s_x + s_y - s_c


def kendall_tau_b(df: DataFrame, x: str, y: str, *, buckets: int = 16,
                  group_limit: int = KENDALL_GROUP) -> DataFrame:
    """τ-b on the pairwise-complete rows, exact (see :func:`kendall_s`), with the
    tie terms Σ t(t−1)/2 per distinct x and per distinct y from two aggregates."""
    # distinct (x, y) cells: read by several small jobs below, so kept once
    d = (df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
           .dropna().groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))).persist()
    try:
        cells, ties = d.agg(F.count(F.lit(1)), F.sum("w")).first()
        ties = ties or 0.0
        s = kendall_s(d, min_buckets=buckets, group_limit=group_limit, n=cells)
        t = F.col("t")
        moments = [F.coalesce(F.sum(e), F.lit(0.0)) for e in (t * (t - 1) / 2, t * (t - 1) * (t - 2), t * (t - 1) * (2 * t + 5))]
        tx, ty = (d.groupBy(c).agg(F.sum("w").alias("t")).agg(*moments).first() for c in ("x", "y"))
    finally:
        d.unpersist()
    n0 = ties * (ties - 1) / 2
    denom = math.sqrt((n0 - tx[0]) * (n0 - ty[0]))
    tau = float(s / denom) if denom > 0 else None
    p = None
    if tau is not None and ties > 2:
        # normal approximation of S, its variance corrected for ties on both sides
        n1 = ties * (ties - 1)
        var = ((n1 * (2 * ties + 5) - tx[2] - ty[2]) / 18 + 2 * tx[0] * ty[0] / n1
               + tx[1] * ty[1] / (9 * n1 * (ties - 2)))
        p = norm_two_sided_p(float(s / math.sqrt(var))) if var > 0 else None
    spark = df.sparkSession
    return spark.createDataFrame([(x, y, tau, int(ties), float(s), p)],
                                 "var1 string, var2 string, tau_b double, n long, s double, p double")
