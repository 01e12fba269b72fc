"""Registered queries over the test tables, each with its DuckDB oracle SQL.

``REGISTRY[name] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Every query reads the given tables (or frames Spark derives from them) in full.
Column names and types of both sides match; no rounding inside queries (trap T15).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import kpi as K
from ..operators import ordered as O
from ..operators import weighted as G
from ..sources.dimensions import territories
from . import bind
from .frame import analysis_frame
from .sql import with_frame

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
KEY = bind.PERSON_KEY
KEY_SQL = ", ".join(KEY)


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def frame(spark: SparkSession, sf: str) -> DataFrame:
    return analysis_frame(bind.households(spark, sf), bind.persons(spark, sf),
                          region_names=bind.region_dim(spark, sf),
                          area_names=bind.area_dim(spark, sf), keep=KEY)


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return bind.table(spark, sf, "lineitem")


def territory_dim(spark: SparkSession, sf: str) -> DataFrame:
    return territories(bind.area_dim(spark, sf))


# ---------------------------------------------------------------------------
# KPIs on the analysis frame
# ---------------------------------------------------------------------------
_WM = "sum(CASE WHEN {x} IS NOT NULL AND {w} IS NOT NULL THEN {x} * {w} END) / " \
      "sum(CASE WHEN {x} IS NOT NULL AND {w} IS NOT NULL THEN {w} END)"
_WMC = "sum(CASE WHEN {x} IS NOT NULL AND {w} IS NOT NULL AND coalesce({c}, false) THEN {x} * {w} END) / " \
       "sum(CASE WHEN {x} IS NOT NULL AND {w} IS NOT NULL AND coalesce({c}, false) THEN {w} END)"


def wm(x: str, w: str = "PONDERA") -> str:
    return _WM.format(x=x, w=w)


def wmc(x: str, c: str, w: str = "PONDERA") -> str:
    return _WMC.format(x=x, w=w, c=c)


def _cw(c: str) -> str:
    return f"count(CASE WHEN coalesce({c}, false) THEN 1 END)"


KPI_SQL = f"""
  CAST(count(*) AS BIGINT) AS n_individuos, sum(PONDERA) AS peso_expansion,
  count(*) >= 150 AS muestra_suficiente, count(*) < 80 AS muestra_advertencia,
  100 * ({wm('secundario_completo')}) AS pct_secundario_completo,
  100 * ({wm('superior')}) AS pct_superior,
  100 * ({wm('ocupado')}) AS pct_ocupado,
  {wm('score_movilidad_proxy')} AS score_movilidad_proxy,
  {wm('vulnerabilidad_social')} AS vulnerabilidad_social,
  100 * ({wmc('informal_proxy', 'ocupado = 1')}) AS pct_informal_ocupados,
  {wm('idx_exclusion_digital')} AS idx_exclusion_digital,
  CASE WHEN count(idx_exclusion_digital) > 0 THEN 100 * ({wm('exclusion_digital_alta')}) END
    AS pct_exclusion_digital_alta,
  CASE WHEN {_cw('CH04 = 2')} >= 30 AND {_cw('CH04 = 1')} >= 30
       THEN 100 * ({wmc('ocupado', 'CH04 = 2')}) - 100 * ({wmc('ocupado', 'CH04 = 1')}) END
    AS brecha_ocupacion_mujer_menos_hombre_pp,
  CASE WHEN {_cw('decil_ingreso <= 2')} >= 20 AND {_cw('decil_ingreso >= 9')} >= 20
       THEN 100 * ({wmc('excl_sin_internet_hogar', 'decil_ingreso <= 2')})
          - 100 * ({wmc('excl_sin_internet_hogar', 'decil_ingreso >= 9')}) END
    AS brecha_internet_q1_menos_q5_pp"""


@register("kpi_vector", with_frame(f"SELECT {KPI_SQL} FROM frame"))
def q_kpi_vector(spark, sf):
    return K.kpis(frame(spark, sf))


@register("kpi_by_area", with_frame(
    f"SELECT CAST(AGLOMERADO AS INTEGER) AS AGLOMERADO, {KPI_SQL} FROM frame GROUP BY 1"))
def q_kpi_by_area(spark, sf):
    f = frame(spark, sf)
    return K.kpis(f.withColumn("AGLOMERADO", F.col("AGLOMERADO").cast("int")), by="AGLOMERADO")


@register("kpi_evolution", with_frame(
    f"SELECT CAST(AGLOMERADO AS INTEGER) AS AGLOMERADO, anio, {KPI_SQL} FROM frame GROUP BY 1, 2"))
def q_kpi_evolution(spark, sf):
    f = frame(spark, sf)
    return K.evolution(f.withColumn("AGLOMERADO", F.col("AGLOMERADO").cast("int")), by="AGLOMERADO")


@register("kpi_gaps", with_frame(
    "SELECT anio, " + ",".join(KPI_SQL.split(",\n")[-2:]).strip() + " FROM frame GROUP BY anio"))
def q_kpi_gaps(spark, sf):
    f = frame(spark, sf)
    return f.groupBy("anio").agg(*K.gap_aggs(f))


def q_kpi_catalog(spark, sf):
    return K.catalog(frame(spark, sf), territory_dim(spark, sf))


_CATALOG_SQL = with_frame(f"""
SELECT dims.territorio_id, dims.territorio_nombre, dims.aglomerado_codigo, dims.tipo,
       agg.* EXCLUDE (territorio_id)
FROM dims LEFT JOIN agg USING (territorio_id)""", f"""
  dims AS (SELECT 'nacional' AS territorio_id, 'Total nacional' AS territorio_nombre,
                  CAST(NULL AS INTEGER) AS aglomerado_codigo, 'nacional' AS tipo
           UNION ALL
           SELECT 'aglomerado_' || CAST(n_nationkey AS VARCHAR), n_name, n_nationkey, 'aglomerado'
           FROM nation)""", f"""
  agg AS (SELECT CASE WHEN GROUPING(AGLOMERADO) = 1 THEN 'nacional'
                      ELSE 'aglomerado_' || CAST(AGLOMERADO AS VARCHAR) END AS territorio_id,
                 {KPI_SQL}
          FROM frame GROUP BY GROUPING SETS ((AGLOMERADO), ()))""")
REGISTRY["kpi_catalog_grouping_sets"] = (q_kpi_catalog, _CATALOG_SQL)


@register("kpi_by_year", with_frame(f"""
SELECT anio, CAST(count(*) AS BIGINT) AS n,
  100 * ({wm('secundario_completo')}) AS pct_secundario_completo,
  100 * ({wm('superior')}) AS pct_superior,
  100 * ({wm('ocupado')}) AS pct_ocupado,
  100 * ({wmc('informal_proxy', 'ocupado = 1')}) AS pct_informal,
  {wm('score_movilidad_proxy')} AS score_movilidad_proxy,
  {wm('ITF')} AS itf_media_ponderada,
  {wm('vulnerabilidad_social')} AS vulnerabilidad_social,
  CASE WHEN count(idx_exclusion_digital) > 0 THEN 100 * ({wm('exclusion_digital_alta')}) END
    AS pct_exclusion_digital_alta,
  CASE WHEN count(idx_exclusion_digital) > 0 THEN {wm('idx_exclusion_digital')} END
    AS idx_exclusion_digital
FROM frame GROUP BY anio"""))
def q_kpi_by_year(spark, sf):
    return K.yearly_descriptives(frame(spark, sf))


# ---------------------------------------------------------------------------
# Inequality on lineitem: value = l_extendedprice, weight = l_quantity
# ---------------------------------------------------------------------------
VALID = "(SELECT *, l_extendedprice AS v, l_quantity AS w FROM lineitem " \
        "WHERE l_extendedprice >= 0 AND l_quantity > 0)"


def _gini_sql(by: str | None) -> str:
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
WITH r AS (SELECT {g}v, sum(w) AS w, count(*) AS n FROM {VALID} GROUP BY {g}v),
c AS (SELECT *, sum(w) OVER ({part}ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum FROM r)
SELECT {g}CAST(sum(n) AS BIGINT) AS n, sum(w) AS w_sum,
  CASE WHEN sum(n) >= 2 AND sum(w * v) <> 0
       THEN 2 * sum(w * (cum - w / 2) * v) / (sum(w) * sum(w * v)) - (1 - 1 / sum(w)) END AS gini
FROM c {grp}"""


@register("gini", _gini_sql(None))
def q_gini(spark, sf):
    return O.gini(lineitem(spark, sf), "l_extendedprice", "l_quantity")


@register("gini_by_group", _gini_sql("l_returnflag"))
def q_gini_by_group(spark, sf):
    return O.gini(lineitem(spark, sf), "l_extendedprice", "l_quantity", by="l_returnflag")


@register("theil", f"""
WITH a AS (SELECT CAST(count(*) AS BIGINT) AS n, sum(w) AS sw, sum(w * v) AS swy,
                  sum(CASE WHEN v > 0 THEN w * v * ln(v) END) AS swyl,
                  sum(CASE WHEN v > 0 THEN w * ln(v) END) AS swl,
                  count(CASE WHEN v = 0 THEN 1 END) AS nz FROM {VALID})
SELECT n,
  CASE WHEN n >= 2 AND swy / sw > 0 THEN coalesce(swyl, 0.0) / swy - ln(swy / sw) END AS theil_t,
  CASE WHEN n >= 2 AND swy / sw > 0 AND nz = 0 THEN ln(swy / sw) - swl / sw END AS theil_l
FROM a""")
def q_theil(spark, sf):
    return O.theil(lineitem(spark, sf), "l_extendedprice", "l_quantity")


@register("weighted_lower_median", f"""
WITH r AS (SELECT v, sum(w) AS w FROM {VALID} GROUP BY v),
c AS (SELECT *, sum(w) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER () AS tot FROM r)
SELECT min(v) FILTER (WHERE cum >= tot / 2) AS median_lower FROM c""")
def q_wmedian(spark, sf):
    return O.lower_weighted_median(lineitem(spark, sf), "l_extendedprice", "l_quantity")


def _wq_sql(src: str, probs, by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    cols = []
    for p in probs:
        t = f"{float(p)!r} * tot"
        a = f"min(v) FILTER (WHERE cum >= {t})"
        c = f"min(cum) FILTER (WHERE cum >= {t})"
        nx = f"min(v) FILTER (WHERE cum > {t} + 1e-10)"
        cols.append(f"CASE WHEN abs(max({t}) - {c}) < 1e-10 AND {nx} IS NOT NULL "
                    f"THEN ({a} + {nx}) / 2 ELSE {a} END AS {O._qname(p)}")
    return f"""
WITH r AS (SELECT {g}v, sum(w) AS w FROM {src} GROUP BY {g}v),
c AS (SELECT *, sum(w) OVER ({part}ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum,
             sum(w) OVER ({part.strip()}) AS tot FROM r)
SELECT {g}{', '.join(cols)} FROM c{grp}"""


@register("weighted_quantiles", _wq_sql(VALID, [0.1, 0.25, 0.5, 0.75, 0.9]))
def q_wq(spark, sf):
    return O.weighted_quantiles(lineitem(spark, sf), "l_extendedprice", "l_quantity",
                                [0.1, 0.25, 0.5, 0.75, 0.9], valid="income")


def _qtable_sql(n: int) -> str:
    step = 1.0 / n
    case = "CASE WHEN excl = 0 THEN 1 " + " ".join(
        f"WHEN cum / tot <= {i * step!r} THEN {i}" for i in range(1, n)) + f" ELSE {n} END"
    prefix = "D" if n == 10 else "Q"
    return f"""
WITH c AS (SELECT v, w, coalesce(sum(w) OVER (ORDER BY v, {KEY_SQL}
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS excl,
                  sum(w) OVER () AS tot FROM {VALID}),
g AS (SELECT *, excl + w AS cum, {case} AS grp FROM c),
s AS (SELECT *, min(excl) OVER (PARTITION BY grp) AS start, sum(w) OVER (PARTITION BY grp) AS gw FROM g),
per AS (SELECT grp, min(v) AS low, max(v) AS high, sum(w) AS w_sum, sum(w * v) / sum(w) AS mean,
               min(v) FILTER (WHERE cum - start >= gw / 2) AS median_lower, sum(w * v) AS inc
        FROM s GROUP BY grp)
SELECT '{prefix}' || CAST(grp AS VARCHAR) AS grupo, low, high, w_sum, mean, median_lower,
       100 * inc / sum(inc) OVER () AS pct_income FROM per"""


@register("quintiles", _qtable_sql(5))
def q_quintiles(spark, sf):
    return O.quantile_table(lineitem(spark, sf), "l_extendedprice", "l_quantity", KEY, 5)


@register("deciles", _qtable_sql(10))
def q_deciles(spark, sf):
    return O.quantile_table(lineitem(spark, sf), "l_extendedprice", "l_quantity", KEY, 10)


@register("quintile_ratio", f"""
WITH q AS ({_qtable_sql(5)})
SELECT CASE WHEN max(mean) FILTER (WHERE grupo = 'Q1') > 0
            THEN max(mean) FILTER (WHERE grupo = 'Q5') / max(mean) FILTER (WHERE grupo = 'Q1') END
       AS ratio_q5_q1 FROM q""")
def q_qratio(spark, sf):
    return O.quintile_ratio(q_quintiles(spark, sf))


@register("group_compare", f"""
WITH r AS (SELECT l_returnflag, v, sum(w) AS w FROM {VALID} GROUP BY l_returnflag, v),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum,
             sum(w) OVER (PARTITION BY l_returnflag) AS tot FROM r),
m AS (SELECT l_returnflag, min(v) FILTER (WHERE cum >= tot / 2) AS median_lower,
             sum(w) AS w_sum, sum(w * v) / sum(w) AS mean FROM c GROUP BY l_returnflag),
gi AS ({_gini_sql('l_returnflag')})
SELECT m.l_returnflag, m.w_sum, mean, median_lower, gini FROM m JOIN gi USING (l_returnflag)""")
def q_group_compare(spark, sf):
    return G.group_compare(lineitem(spark, sf), "l_extendedprice", "l_returnflag", "l_quantity")


# ---------------------------------------------------------------------------
# Frequencies, cross-tabs, summaries
# ---------------------------------------------------------------------------

@register("freq_weighted", """
WITH a AS (SELECT coalesce(CAST(l_returnflag AS VARCHAR), '(NaN)') AS categoria,
                  CAST(count(*) AS BIGINT) AS n, sum(coalesce(l_quantity, 0.0)) AS n_ponderado
           FROM lineitem GROUP BY 1)
SELECT categoria, n, 100 * n / sum(n) OVER () AS pct, n_ponderado,
       100 * n_ponderado / sum(n_ponderado) OVER () AS pct_ponderado FROM a""")
def q_freq(spark, sf):
    return G.frequencies(lineitem(spark, sf), "l_returnflag", "l_quantity")


def _xtab_sql(norm: str | None) -> str:
    part = {"row": "PARTITION BY l_returnflag", "column": "PARTITION BY l_linestatus", "total": ""}
    val = "valor" if norm is None else f"100 * valor / sum(valor) OVER ({part[norm]})"
    return f"""
WITH c AS (SELECT l_returnflag, l_linestatus, sum(coalesce(l_quantity, 0.0)) AS valor
           FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, {val} AS valor FROM c"""


for _norm in ("row", "column", "total"):
    def _mk(norm):
        def fn(spark, sf):
            return G.crosstab(lineitem(spark, sf), "l_returnflag", "l_linestatus", "l_quantity", norm)
        return fn
    REGISTRY[f"crosstab_{_norm}"] = (_mk(_norm), _xtab_sql(_norm))


@register("crosstab_pivot", """
WITH c AS (SELECT l_returnflag, l_linestatus, sum(coalesce(l_quantity, 0.0)) AS valor
           FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_returnflag, l_linestatus, 100 * valor / sum(valor) OVER (PARTITION BY l_returnflag) AS valor FROM c)
SELECT l_returnflag, max(valor) FILTER (WHERE l_linestatus = 'F') AS F,
       max(valor) FILTER (WHERE l_linestatus = 'O') AS O FROM s GROUP BY l_returnflag""")
def q_xtab_pivot(spark, sf):
    long = G.crosstab(lineitem(spark, sf), "l_returnflag", "l_linestatus", "l_quantity", "row")
    return G.crosstab_pivot(long, "l_returnflag", "l_linestatus", ["F", "O"])


@register("summary_weighted", f"""
WITH d AS (SELECT l_extendedprice AS x, coalesce(l_quantity, 0.0) AS w FROM lineitem),
c AS (SELECT *, (SELECT min(x) FROM d) AS c0 FROM d),
a AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(x) AS BIGINT) AS n_validos,
             min(x) AS min, max(x) AS max, sum(CASE WHEN x IS NOT NULL THEN w END) AS sw,
             sum(w * x) AS swx, sum(w * (x - c0)) AS s1, sum(w * (x - c0) * (x - c0)) AS s2 FROM c),
q AS ({_wq_sql("(SELECT x AS v, w FROM d WHERE x IS NOT NULL)", [0.25, 0.5, 0.75])})
SELECT n, n_validos, n - n_validos AS missing, swx / sw AS mean,
       sqrt((s2 - s1 * s1 / sw) / (sw - 1)) AS sd, sqrt((s2 - s1 * s1 / sw) / (sw - 1)) / sqrt(sw) AS se,
       sw - 1 AS dof, min, max, q25, q50 AS median, q75
FROM a, q""")
def q_summary_weighted(spark, sf):
    return G.summary(lineitem(spark, sf), "l_extendedprice", "l_quantity")


@register("summary_unweighted", """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(l_extendedprice) AS BIGINT) AS n_validos,
       CAST(count(*) - count(l_extendedprice) AS BIGINT) AS missing,
       avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd,
       stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)) AS se,
       CAST(count(l_extendedprice) - 1 AS DOUBLE) AS dof,
       min(l_extendedprice) AS min, max(l_extendedprice) AS max,
       quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS median,
       quantile_cont(l_extendedprice, 0.75) AS q75
FROM lineitem""")
def q_summary_unweighted(spark, sf):
    return G.summary(lineitem(spark, sf), "l_extendedprice", None, weighted=False)


SUMMARY_COLS = ["l_extendedprice", "l_discount", "l_tax"]
_LONG_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS x, coalesce(l_quantity, 0.0) AS w FROM lineitem" for c in SUMMARY_COLS)


@register("summary_all_numeric", f"""
WITH d AS ({_LONG_SQL}),
c AS (SELECT *, min(x) OVER (PARTITION BY variable) AS c0 FROM d),
a AS (SELECT variable, CAST(count(*) AS BIGINT) AS n, CAST(count(x) AS BIGINT) AS n_validos,
             min(x) AS min, max(x) AS max, sum(CASE WHEN x IS NOT NULL THEN w END) AS sw,
             sum(w * x) AS swx, sum(w * (x - c0)) AS s1, sum(w * (x - c0) * (x - c0)) AS s2
      FROM c GROUP BY variable),
q AS ({_wq_sql("(SELECT variable, x AS v, w FROM d WHERE x IS NOT NULL)", [0.25, 0.5, 0.75], by="variable")})
SELECT a.variable, n, n_validos, n - n_validos AS missing, swx / sw AS mean,
       sqrt((s2 - s1 * s1 / sw) / (sw - 1)) AS sd, sqrt((s2 - s1 * s1 / sw) / (sw - 1)) / sqrt(sw) AS se,
       sw - 1 AS dof, min, max, q25, q50 AS median, q75
FROM a JOIN q USING (variable)""")
def q_summary_all(spark, sf):
    """The weighted summary of several numeric columns as one grouped job."""
    return G.summary_all(lineitem(spark, sf), SUMMARY_COLS, "l_quantity")


@register("summary_weighted_ci", None)
def q_summary_ci(spark, sf):
    """G3 with the Student-t interval (the t quantile has no SQL oracle; se and d.f. are
    checked by ``summary_weighted``, the bounds by a test)."""
    return G.add_t_interval(G.summary(lineitem(spark, sf), "l_extendedprice", "l_quantity"))


from . import testbed2  # noqa: E402,F401  (registers the remaining queries)
from . import testbed3  # noqa: E402,F401
from . import testbed4  # noqa: E402,F401
from . import testbed5  # noqa: E402,F401
