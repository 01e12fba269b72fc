"""What-if scenarios on the territorial KPIs.

Levers run for **every territory at once**: targets are a small DataFrame
(territory, target), group totals come from one aggregate, and the greedy "heaviest
first until the target mass" selection is the grouped ordered kernel (D10), which yields the
last flipped row of every territory.  Rows are then compared with that cut-off: a filter
of territory size in place of a join with all flipped rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import coding as C
from ..functions.expr import join_groups, num, row_mean, wmean, wmean_where
from ..plans.frame import ACCESS_FLAGS, USE_FLAGS
from ..session import materialise
from . import ordered
from .ordered import _as_list


def lever_baselines(df: DataFrame, by=None, weight: str = "PONDERA") -> DataFrame:
    """L1: weighted % higher education; 100 − weighted % informal among employed;
    weighted % with home internet among deciles ≤ 2 (0 when undefined)."""
    w = F.col(weight)
    dec = num("decil_ingreso")
    return df.groupBy(*_as_list(by)).agg(
        F.coalesce(100 * wmean("superior", w), F.lit(0.0)).alias("pct_superior"),
        (100 - F.coalesce(100 * wmean_where("informal_proxy", w, F.col("ocupado") == 1),
                          F.lit(0.0))).alias("pct_empleo_formal"),
        F.coalesce(100 * wmean_where(1 - F.col("excl_sin_internet_hogar"), w, dec <= 2),
                   F.lit(0.0)).alias("internet_quintil_i"))


def lever_cuts(df: DataFrame, mask: Column, col: str, targets: DataFrame, key: Sequence[str],
               by=None, *, good_value: float = 0.0, bad_value: float = 1.0,
               weight: str = "PONDERA", method: str = "bucketed") -> DataFrame:
    """L2/L3: the ``by`` columns and ``_cut``, the last row that flips in the group as
    struct(−weight, key…); groups where nothing flips have no row.

    Rows flip heaviest first, ties by key, so all rows up to ``_cut`` do.  The selection reads
    the lever's columns only and returns one row per group."""
    by = _as_list(by)
    d = (df.where(F.coalesce(mask, F.lit(False)) & F.col(col).isNotNull())
           .select(*by, *key, F.coalesce(F.col(weight), F.lit(1.0)).cast("double").alias("_w1"), F.col(col).alias("_state")))
    tot = d.groupBy(*by).agg(F.sum("_w1").alias("_sw"), F.sum(F.when(F.col("_state") == good_value, F.col("_w1"))).alias("_swg"))
    tgt = targets.select(*by, F.least(F.greatest(F.col("target"), F.lit(0.0)), F.lit(100.0)).alias("_t"))
    have = F.coalesce(F.col("_swg"), F.lit(0.0))
    plan = (join_groups(tot, tgt, by).where(F.col("_t") > 100 * have / F.col("_sw") + 0.05)
            .select(*by, F.greatest(F.lit(0.0), F.col("_t") / 100 * F.col("_sw") - have).alias("_extra")).where("_extra > 0"))
    cand = join_groups(d.where(F.col("_state") == bad_value), plan, by)
    cand = ordered.greedy_prefix(cand, "_w1", list(key), F.col("_extra"), by, method=method)
    return cand.where("_take").groupBy(*by).agg(F.max(F.struct((-F.col("_w1")).alias("w"), *key)).alias("_cut"))


def _flips(mask: Column, col: str, bad_value: float, weight: str, key: Sequence[str], cut: str) -> Column:
    row = F.struct((-F.coalesce(F.col(weight), F.lit(1.0)).cast("double")).alias("w"), *key)
    return F.coalesce(mask & (F.col(col) == bad_value) & (row <= F.col(cut)), F.lit(False))


def _with_group(df: DataFrame, targets: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """One implicit group when there are no ``by`` columns."""
    return (df, targets, by) if by else (df.withColumn("_g", F.lit(0)), targets.withColumn("_g", F.lit(0)), ["_g"])


def flip_to_target(df: DataFrame, mask: Column, col: str, targets: DataFrame, key: Sequence[str],
                   by=None, *, good_value: float = 0.0, bad_value: float = 1.0,
                   weight: str = "PONDERA", method: str = "bucketed") -> DataFrame:
    """L2/L3: within ``mask`` (rows with ``col`` not null) flip bad → good, heaviest
    weight first (ties by key), until the weighted good rate reaches the group's target
    (%).  No change when target ≤ current + 0.05 pp; a null weight counts as 1; the last
    flipped row may overshoot; a null group is a group.  ``targets`` has the ``by`` columns
    plus ``target``.  Returns ``df`` with ``col`` updated and a boolean ``_flipped``."""
    df, targets, by = _with_group(df, targets, _as_list(by))
    cuts = materialise(lever_cuts(df, mask, col, targets, key, by, good_value=good_value, bad_value=bad_value, weight=weight, method=method), "cuts")
    out = join_groups(df, cuts, by, "left")  # one row a group: the planner broadcasts it by its size
    out = out.withColumn("_flipped", _flips(mask, col, bad_value, weight, key, "_cut"))
    return out.withColumn(col, F.when(F.col("_flipped"), F.lit(good_value)).otherwise(F.col(col))).drop("_cut", "_g")


def recompute_derived(df: DataFrame, exclusion_threshold) -> DataFrame:
    """L4: indices and scores after a lever, with a **frozen** exclusion threshold
    (trap T9: pass the threshold explicitly)."""
    df = df.withColumns({"idx_acceso": row_mean(ACCESS_FLAGS), "idx_uso": row_mean(USE_FLAGS),
                         "idx_exclusion_digital": row_mean(ACCESS_FLAGS + USE_FLAGS)})
    df = df.withColumn("exclusion_digital_alta", C.at_least("idx_exclusion_digital", exclusion_threshold))
    df = df.withColumn("score_movilidad_proxy", C.mobility_score(
        "secundario_completo", "superior", "ocupado", "informal_proxy", "quintil_alto"))
    return df.withColumn("vulnerabilidad_social", C.vulnerability_score(
        "secundario_completo", "desocupado", "quintil_bajo", "idx_exclusion_digital"))


def apply_scenario(df: DataFrame, targets: DataFrame, key: Sequence[str], by=None, *,
                   exclusion_threshold=None, method: str = "bucketed") -> DataFrame:
    """Internet in deciles ≤ 2 → higher education → formal employment, in order.
    ``targets`` has ``by`` columns plus ``internet_quintil_i``, ``pct_superior``,
    ``pct_empleo_formal`` (null = lever off)."""
    by = _as_list(by)
    thr = exclusion_threshold if exclusion_threshold is not None else \
        df.agg(F.median("idx_exclusion_digital")).scalar()
    df, targets, by = _with_group(df, targets, by)
    columns = [*by, *key, "PONDERA", "decil_ingreso", "ocupado", "excl_sin_internet_hogar", "superior", "informal_proxy"]
    d = materialise(df.select(*dict.fromkeys(columns)), "levers")  # read by several jobs for each lever
    levers = [("internet_quintil_i", num("decil_ingreso") <= 2, "excl_sin_internet_hogar", 0.0, 1.0),
              ("pct_superior", F.lit(True), "superior", 1.0, 0.0),
              ("pct_empleo_formal", F.col("ocupado") == 1, "informal_proxy", 0.0, 1.0)]
    # no lever reads a column that another one writes, so their order doesn't matter and all
    # cut-offs come from the same rows
    cuts = None
    for i, (lever, mask, col, good, bad) in enumerate(levers):
        t = targets.select(*by, F.col(lever).alias("target")).where(F.col("target").isNotNull())
        c = lever_cuts(d, mask, col, t, key, by, good_value=good, bad_value=bad, method=method).withColumn("_lever", F.lit(i))
        cuts = c if cuts is None else cuts.unionByName(c)
    cuts = cuts.groupBy(*by).agg(*[F.max(F.when(F.col("_lever") == i, F.col("_cut"))).alias(f"_cut{i}") for i in range(len(levers))])
    out = join_groups(df, materialise(cuts, "cuts"), by, "left")
    out = out.withColumns({col: F.when(_flips(mask, col, bad, "PONDERA", key, f"_cut{i}"), F.lit(good)).otherwise(F.col(col))
                           for i, (_, mask, col, good, bad) in enumerate(levers)})
    return recompute_derived(out.drop(*[f"_cut{i}" for i in range(len(levers))], "_g"), thr)


def scenario_run(df: DataFrame, targets: DataFrame, key: Sequence[str], by, indicators: Sequence[str], features: Sequence[str],
                 label: str = "exclusion_digital_alta", *, weight: str = "PONDERA", exclusion_threshold=None) -> tuple[DataFrame, DataFrame]:
    """The scenario's frame, and for every territory the indicators before and after and
    their delta, among them ``pct_predicho``: the weighted mean probability (%) of ``label``
    by a logistic model that is fitted on the frame as it is and applied to both (M15)."""
    from . import joins, kpi, models
    by = _as_list(by)
    df = materialise(df, "before")  # columnar: every job reads its columns only
    after = materialise(apply_scenario(df, targets, key, by, exclusion_threshold=exclusion_threshold), "after")
    _, model = models.logistic(df, features, label, weight)
    def measured(d):
        rate = models.predicted_rate(model, d, features, weight, by)
        k = kpi.kpis(d, by=by, gaps=False)
        return join_groups(k, rate, by, "left") if by else k.withColumn("pct_predicho", rate.select("pct_predicho").scalar())
    return after, joins.compare_indicators(measured(df), measured(after), by, [*indicators, "pct_predicho"])
