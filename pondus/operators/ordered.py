"""Ordered / distribution operators.

All order statistics share one kernel, :func:`running_weight`: an exclusive running sum
of a weight column in a total order, optionally within groups.

A plain ``Window.orderBy`` without ``partitionBy`` moves the whole table into one task.
The kernel instead works in two passes:

1. split points of the leading order column come from ``approxQuantile`` (a bounded list
   of at most ``buckets`` numbers); the bucket of a row is a pure function of its value, so
   ties never straddle buckets and a recomputed stage yields the same buckets;
2. the running sum is taken inside ``(group, bucket)`` partitions;
3. bucket totals (at most groups x buckets rows) get an exclusive running sum per group;
4. that offset is joined back and added.

A single value may carry a third of all rows ("hot" tie block).  For row-level operators
the order continues with key columns, so such a block is split again by ranges of the
first key column (split points per hot value, also a bounded list).  Operators whose
result depends only on per-value weight totals (Gini, quantiles, medians, ranks, AUC)
first reduce the input to one row per distinct value, which removes hot blocks entirely.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import join_groups

_B = "_pd_bucket"
_S = "_pd_sub"


def _as_list(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


def _default_buckets(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def _raw_quantiles(df: DataFrame, c: str, buckets: int, rel_err: float) -> list[float]:
    probs = [i / buckets for i in range(1, buckets)]
    pts = df.approxQuantile(c, probs, rel_err) if probs else []
    return [float(p) for p in pts if p is not None]


def _bucketize(df: DataFrame, c: str, splits: list[float], out: str) -> DataFrame:
    """Bucket index of ``c`` by binary search over the split points (JVM-side); without
    split points (an empty input) everything is bucket 0."""
    if not splits:
        return df.withColumn(out, F.lit(0.0))
    edges = [float("-inf")] + splits + [float("inf")]
    tmp = "_pd_bsrc"
    b = Bucketizer(splits=edges, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return b.transform(df.withColumn(tmp, F.col(c).cast("double"))).drop(tmp)


def running_weight(df: DataFrame, order: Sequence[str] | str, weight: Sequence[str] | str, by=None, *,
                   excl: Sequence[str] | str = "_excl", total: Sequence[str] | str | None = "_tot", method: str = "bucketed",
                   buckets: int | None = None, rel_err: float = 1e-3,
                   hot_factor: float = 2.0, splits: Sequence[float] | None = None) -> DataFrame:
    """Add the exclusive running sum of ``weight`` in ``order`` within ``by`` groups.

    ``order`` must be a total order for row-level results (append key columns); the
    leading column must be numeric and non-null.  ``total`` adds the group total.  Several
    weights, with as many names in ``excl`` and ``total``, share one pass.
    ``method="window"`` is the single-pass reference path (tests, tiny inputs).
    ``splits`` may carry precomputed split points of the leading column (any points
    give the exact result; they only balance the buckets), e.g. from one multi-column
    ``approxQuantile`` shared by several calls.
    """
    order = _as_list(order)
    by = _as_list(by)
    weights, excls, tots = _as_list(weight), _as_list(excl), _as_list(total)
    if method == "window":
        win = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        out = df.withColumns({e: F.coalesce(F.sum(w).over(win), F.lit(0.0)) for w, e in zip(weights, excls)})
        return out.withColumns({t: F.sum(w).over(Window.partitionBy(*by)) for w, t in zip(weights, tots)})

    nb = buckets or _default_buckets(df)
    lead = order[0]
    raw = [float(x) for x in splits] if splits is not None else _raw_quantiles(df, lead, nb, rel_err)
    splits = sorted(set(raw))
    staged = _bucketize(df, lead, splits, _B)
    sub = F.lit(0)
    if len(order) > 1:
        # Hot tie blocks of the leading column are split by ranges of the next column.
        # A value holding more than ~2/nb of the rows shows up as a repeated split point
        # of the same quantile sketch, so no extra pass is needed to find hot values.
        nxt = order[1]
        hot = {v: k for v, k in Counter(raw).items() if k >= max(2, int(hot_factor))}
        if hot:
            cases = None
            for v, pts in _hot_splits(df, lead, nxt, hot, rel_err).items():
                idx = F.size(F.filter(F.array(*[F.lit(p) for p in pts]),
                                      lambda s: s <= F.col(nxt).cast("double"))) if pts else F.lit(0)
                cases = (F.when(F.col(lead) == F.lit(v), idx) if cases is None
                         else cases.when(F.col(lead) == F.lit(v), idx))
            if cases is not None:
                # a hot value is a split point, i.e. the left edge of its bucket: every
                # other value of that bucket is larger and must follow all its sub-ranges
                sub = cases.otherwise(F.lit(1 << 30))
    staged = staged.withColumn(_S, sub)

    part = by + [_B, _S]
    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    staged = staged.withColumns({f"_pd_local{i}": F.coalesce(F.sum(w).over(local), F.lit(0.0)) for i, w in enumerate(weights)})

    offsets = staged.groupBy(*part).agg(*[F.sum(w).alias(f"_pd_bw{i}") for i, w in enumerate(weights)])
    ow = Window.partitionBy(*by).orderBy(_B, _S).rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumns(
        {f"_pd_off{i}": F.coalesce(F.sum(f"_pd_bw{i}").over(ow), F.lit(0.0)) for i in range(len(weights))}
        | {t: F.sum(f"_pd_bw{i}").over(Window.partitionBy(*by)) for i, t in enumerate(tots)})
    offsets = offsets.drop(*[f"_pd_bw{i}" for i in range(len(weights))])
    if not by:
        # a hot value gets as many sub-ranges as split points it took, so there are at most
        # two rows per bucket: a proven bound, safe to broadcast
        offsets = F.broadcast(offsets)
    out = join_groups(staged, offsets, part)  # a null group is a group
    out = out.withColumns({e: F.col(f"_pd_local{i}") + F.col(f"_pd_off{i}") for i, e in enumerate(excls)})
    return out.drop(*[f"_pd_{x}{i}" for x in ("local", "off") for i in range(len(weights))], _B, _S)


def _hot_splits(df: DataFrame, lead: str, nxt: str, hot: dict[float, int], rel_err: float) -> dict:
    """Split points of the next column for each hot value: one less than the times that the
    value repeats in the sketch, so all of them together are no more than the buckets."""
    most = max(hot.values())
    probs = [i / most for i in range(1, most)]
    rows = (df.where(F.col(lead).isin(sorted(hot)))
              .groupBy(lead)
              .agg(F.percentile_approx(F.col(nxt).cast("double"), probs, int(1 / rel_err)).alias("p"))
              .collect())
    return {r[0]: sorted({float(r[1][i * most // hot[float(r[0])] - 1]) for i in range(1, hot[float(r[0])])})
            for r in rows if r[1]}


# ---------------------------------------------------------------------------
# Valid (value, weight) input and per-value reduction
# ---------------------------------------------------------------------------

def valid_income(df: DataFrame, value: str, weight: str | None) -> DataFrame:
    """value not null and >= 0, weight not null and > 0 (weight 1 when absent)."""
    v = F.col(value).try_cast("double")
    w = F.col(weight).try_cast("double") if weight and weight in df.columns else F.lit(1.0)
    out = df.withColumn("_v", F.when(~F.isnan(v), v)).withColumn("_w", F.when(~F.isnan(w), w))
    return out.where((F.col("_v") >= 0) & (F.col("_w") > 0))


def reduce_by_value(df: DataFrame, value: str = "_v", weight: str = "_w", by=None) -> DataFrame:
    """D1 step 1: one row per (group, distinct value) with Σw, Σw·v and the row count."""
    by = _as_list(by)
    return (df.groupBy(*by, F.col(value).alias("_v"))
              .agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n")))


def cumulative_distribution(df: DataFrame, value: str, weight: str | None, by=None, *,
                            method: str = "bucketed", buckets: int | None = None) -> DataFrame:
    """Per (group, distinct value): Σw, exclusive and inclusive running Σw, group total."""
    by = _as_list(by)
    red = reduce_by_value(valid_income(df, value, weight), by=by)
    out = running_weight(red, ["_v"], "_w", by, method=method, buckets=buckets)
    return out.withColumn("_cum", F.col("_excl") + F.col("_w"))


# ---------------------------------------------------------------------------
# D5 Gini, D7 Theil, D3 lower median, D2 weighted quantiles
# ---------------------------------------------------------------------------

def gini(df: DataFrame, value: str, weight: str | None = None, by=None, *,
         corrected: bool = False, method: str = "bucketed", buckets: int | None = None) -> DataFrame:
    """Weighted Gini  2Σw(cum−w/2)y / (Σw·Σwy) − (1 − 1/Σw); null if n<2 or Σwy=0.

    Tie-order independent, so the per-value reduction is exact.  ``corrected=True`` drops
    the ``1/Σw`` term's asymmetry (equal incomes give 0 instead of 1/Σw).
    """
    by = _as_list(by)
    cd = cumulative_distribution(df, value, weight, by, method=method, buckets=buckets)
    return cd.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_w").alias("w_sum"), gini_of(corrected).alias("gini"))


def gini_of(corrected: bool = False) -> Column:
    """The Gini as an aggregate over the rows of :func:`cumulative_distribution`."""
    y, w, cum = F.col("_v"), F.col("_w"), F.col("_cum")
    sw, swy = F.sum(w), F.sum(w * y)
    g = 2 * F.sum(w * (cum - w / 2) * y) / F.nullif(sw * swy, F.lit(0.0))
    g = g - 1 if corrected else g - (1 - 1 / sw)
    return F.when((F.sum("_n") >= 2) & (swy != 0), g)


def median_of() -> Column:
    """The lower weighted median as an aggregate over :func:`cumulative_distribution`."""
    return F.min(F.when(F.col("_cum") >= F.col("_tot") / 2, F.col("_v")))


def theil(df: DataFrame, value: str, weight: str | None = None, by=None) -> DataFrame:
    """Theil T and L in one pass:  T = Σw·y·ln y/Σwy − ln μ ;  L = ln μ − Σw·ln y/Σw.

    Rows with y = 0 add nothing to T; L is null when any y = 0; n<2 or μ≤0 → null.
    """
    by = _as_list(by)
    d = valid_income(df, value, weight)
    y, w = F.col("_v"), F.col("_w")
    agg = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("_sw"), F.sum(w * y).alias("_swy"),
        F.sum(F.when(y > 0, w * y * F.log(y))).alias("_swyl"),
        F.sum(F.when(y > 0, w * F.log(y))).alias("_swl"),
        F.count(F.when(y == 0, 1)).alias("_nz"))
    mu = F.col("_swy") / F.col("_sw")
    ok = (F.col("n") >= 2) & (mu > 0)
    t = F.coalesce(F.col("_swyl"), F.lit(0.0)) / F.col("_swy") - F.log(mu)
    l_ = F.log(mu) - F.col("_swl") / F.col("_sw")
    return agg.select(*by, "n", F.when(ok, t).alias("theil_t"),
                      F.when(ok & (F.col("_nz") == 0), l_).alias("theil_l"))


def lower_weighted_median(df: DataFrame, value: str, weight: str | None = None, by=None, *,
                          method: str = "bucketed", buckets: int | None = None) -> DataFrame:
    """D3: first value whose inclusive running weight reaches half the total."""
    by = _as_list(by)
    cd = cumulative_distribution(df, value, weight, by, method=method, buckets=buckets)
    return cd.groupBy(*by).agg(median_of().alias("median_lower"))


def weighted_quantiles(df: DataFrame, value: str, weight: str | None, probs: Sequence[float],
                       by=None, *, method: str = "bucketed", buckets: int | None = None,
                       valid: str = "notnull") -> DataFrame:
    """D2 (survey-statistics convention): over distinct values with inclusive running
    weight ``cum``, the quantile p is the first value with ``cum >= p·Σw``; on an exact
    hit (within 1e-10) the next distinct value is averaged in.

    ``valid="notnull"`` keeps every non-null value (descriptive summary); ``"income"``
    applies the value ≥ 0 / weight > 0 rule.
    """
    by = _as_list(by)
    if valid == "income":
        base = valid_income(df, value, weight)
    else:
        v = F.col(value).try_cast("double")
        w = F.col(weight).try_cast("double") if weight else F.lit(1.0)
        base = (df.withColumn("_v", F.when(~F.isnan(v), v)).withColumn("_w", w)
                  .where(F.col("_v").isNotNull() & F.col("_w").isNotNull()))
    red = reduce_by_value(base, by=by)
    cd = running_weight(red, ["_v"], "_w", by, method=method, buckets=buckets)
    cd = cd.withColumn("_cum", F.col("_excl") + F.col("_w"))
    aggs = []
    for p in probs:
        t = F.lit(float(p)) * F.col("_tot")
        tag = _qname(p)
        aggs += [F.min(F.when(F.col("_cum") >= t, F.col("_v"))).alias(f"_a_{tag}"),
                 F.min(F.when(F.col("_cum") >= t, F.col("_cum"))).alias(f"_c_{tag}"),
                 F.min(F.when(F.col("_cum") > t + 1e-10, F.col("_v"))).alias(f"_n_{tag}"),
                 F.max(t).alias(f"_t_{tag}")]
    agg = cd.groupBy(*by).agg(*aggs)
    outs = []
    for p in probs:
        tag = _qname(p)
        a, c, n, t = (F.col(f"_{k}_{tag}") for k in "acnt")
        hit = (F.abs(t - c) < 1e-10) & n.isNotNull()
        outs.append(F.when(hit, (a + n) / 2).otherwise(a).alias(tag))
    return agg.select(*by, *outs)


def _qname(p: float) -> str:
    return "q" + str(int(round(p * 100)))


# ---------------------------------------------------------------------------
# D4 quantile groups, D8 ratio
# ---------------------------------------------------------------------------

def quantile_groups(df: DataFrame, value: str, weight: str | None, key: Sequence[str],
                    n_groups: int = 5, by=None, *, method: str = "bucketed",
                    buckets: int | None = None) -> DataFrame:
    """D4 row level: assign each valid row to weighted group 1..n.

    Order is (value, key...).  Row j goes to the first group i with cum_j/Σw <= i/n
    (the first row always to group 1).  Edges are ``i*(1/n)`` as float products.
    """
    by = _as_list(by)
    d = valid_income(df, value, weight)
    d = running_weight(d, ["_v", *key], "_w", by, method=method, buckets=buckets)
    frac = (F.col("_excl") + F.col("_w")) / F.col("_tot")
    step = 1.0 / n_groups
    g = F.when(F.col("_excl") == 0, F.lit(1))
    for i in range(1, n_groups):
        g = g.when(frac <= F.lit(i * step), F.lit(i))
    g = g.otherwise(F.lit(n_groups))
    return d.withColumn("_grp", g)


def quantile_table(df: DataFrame, value: str, weight: str | None, key: Sequence[str],
                   n_groups: int = 5, by=None, *, method: str = "bucketed",
                   buckets: int | None = None) -> DataFrame:
    """D4 summary: per group low/high value, Σw, weighted mean, lower weighted median
    (within the group) and % of total income; empty groups are omitted."""
    by = _as_list(by)
    g = quantile_groups(df, value, weight, key, n_groups, by, method=method, buckets=buckets)
    g = g.withColumn("_cum", F.col("_excl") + F.col("_w"))
    keys = by + ["_grp"]
    first = g.groupBy(*keys).agg(F.min("_excl").alias("_start"), F.sum("_w").alias("_gw"))
    g2 = join_groups(g, first, keys)
    inner = F.col("_cum") - F.col("_start")
    prefix = "D" if n_groups == 10 else "Q"
    per = g2.groupBy(*keys).agg(
        F.min("_v").alias("low"), F.max("_v").alias("high"), F.sum("_w").alias("w_sum"),
        (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("mean"),
        F.min(F.when(inner >= F.col("_gw") / 2, F.col("_v"))).alias("median_lower"),
        F.sum(F.col("_w") * F.col("_v")).alias("_inc"))
    tot = per.groupBy(*by).agg(F.sum("_inc").alias("_tinc")) if by else None
    if by:
        per = join_groups(per, tot, by)
        share = 100 * F.col("_inc") / F.col("_tinc")
    else:
        share = 100 * F.col("_inc") / F.sum("_inc").over(Window.partitionBy())
    return per.select(*by, F.concat(F.lit(prefix), F.col("_grp").cast("string")).alias("grupo"),
                      "low", "high", "w_sum", "mean", "median_lower", share.alias("pct_income"))


def quintile_ratio(qtable: DataFrame, by=None) -> DataFrame:
    """Q5 mean / Q1 mean, null when the Q1 mean is not positive (full precision)."""
    by = _as_list(by)
    q5 = F.max(F.when(F.col("grupo") == "Q5", F.col("mean")))
    q1 = F.max(F.when(F.col("grupo") == "Q1", F.col("mean")))
    return qtable.groupBy(*by).agg(F.when(q1 > 0, q5 / q1).alias("ratio_q5_q1"))


# ---------------------------------------------------------------------------
# D9 unweighted quantiles, D11 share, D12 percentile clip, D10 greedy prefix
# ---------------------------------------------------------------------------

def unweighted_quantiles(df: DataFrame, value: str, probs: Sequence[float], by=None) -> DataFrame:
    """Exact linear-interpolated quantiles (pandas default), through the bucketed kernel:
    one row per distinct value and its running count, never all values in one task.
    Without values the quantiles are null (no group: one row)."""
    by = _as_list(by)
    v = F.col(value).try_cast("double")
    red = (df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
             .groupBy(*by, "_v").agg(F.count(F.lit(1)).cast("double").alias("_w")))
    cd = running_weight(red, ["_v"], "_w", by).withColumn("_cum", F.col("_excl") + F.col("_w"))
    aggs = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_tot") - 1)
        aggs += [F.min(F.when(F.col("_cum") > F.floor(at), F.col("_v"))).alias(f"_lo{i}"),
                 F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_v"))).alias(f"_hi{i}"),
                 F.max(at - F.floor(at)).alias(f"_f{i}")]
    agg = cd.groupBy(*by).agg(*aggs)
    out = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(_qname(p))
           for i, p in enumerate(probs)]
    return agg.select(*by, *out)


def clip_to_percentiles(df: DataFrame, c: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Clip to the exact 2nd and 98th percentiles (a scalar subquery, no driver loop);
    nulls stay null."""
    bounds = unweighted_quantiles(df, c, [lo, hi])
    lo_v, hi_v = (bounds.select(F.col(x)).scalar() for x in (_qname(lo), _qname(hi)))
    return df.withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), lo_v), hi_v)))


def greedy_prefix(df: DataFrame, weight: str, key: Sequence[str], extra: Column, by=None, *,
                  out: str = "_take", method: str = "bucketed", buckets: int | None = None) -> DataFrame:
    """Mark rows taken by "heaviest first until the target mass ``extra``".

    A row is taken when the weight of the rows before it (order weight desc, key asc)
    is still below ``extra``; ``extra`` is a column (constant per group).
    """
    by = _as_list(by)
    d = df.withColumn("_negw", -F.col(weight))
    d = running_weight(d, ["_negw", *key], weight, by, total=None, method=method, buckets=buckets)
    return d.withColumn(out, F.col("_excl") < extra).drop("_negw", "_excl")
