"""More registered queries: correlation, joins, cleaning, index, schema, reshape,
scenario levers, model preparation and evaluation (see :mod:`pondus.plans.testbed`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import coding as C
from ..functions.expr import num, row_mean
from ..operators import corr as R
from ..operators import evaluate as EV
from ..operators import joins as J
from ..operators import kpi as K
from ..operators import ml_prep as MP
from ..operators import schema as S
from ..operators import scenario as L
from ..operators import weighted as G
from . import bind
from .clean import income_quintile_label
from .sql import with_base, with_frame
from .testbed import KEY, KEY_SQL, REGISTRY, frame, lineitem, register, territory_dim

# ---------------------------------------------------------------------------
# Correlation (R1–R6, D6) on lineitem numeric columns; disc_nz has nulls (pairwise)
# ---------------------------------------------------------------------------
CORR_COLS = ["l_extendedprice", "l_quantity", "disc_nz", "l_tax", "net"]
CORR_SRC_SQL = ("(SELECT l_extendedprice, l_quantity, nullif(l_discount, 0) AS disc_nz, l_tax, "
                "l_extendedprice * (1 - l_discount) AS net FROM lineitem)")


def corr_input(spark, sf) -> DataFrame:
    li = lineitem(spark, sf)
    return li.select("l_extendedprice", "l_quantity",
                     F.nullif(F.col("l_discount"), F.lit(0.0)).alias("disc_nz"), "l_tax",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


def _pairs(cols, both=True, diag=True):
    out = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if (i < j) or (both and i > j):
                out.append((a, b))
            elif diag and i == j:
                out.append((a, a))
    return out


def _pearson_sql(src: str, cols, both=True, diag=True) -> str:
    parts = []
    for a, b in _pairs(cols, both, diag):
        if a == b:
            parts.append(f"SELECT '{a}' AS var1, '{a}' AS var2, CASE WHEN count({a}) > 1 THEN 1.0 END AS r, "
                         f"CAST(count({a}) AS BIGINT) AS n FROM s")
        else:
            parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r, "
                         f"CAST(count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS BIGINT) AS n "
                         f"FROM s")
    return f"WITH s AS {src}\n" + "\nUNION ALL\n".join(parts)


@register("pearson_matrix", _pearson_sql(CORR_SRC_SQL, CORR_COLS))
def q_pearson(spark, sf):
    return R.pearson_long(corr_input(spark, sf), CORR_COLS)


@register("corr_pairs", _pearson_sql(
    f"(SELECT * FROM {CORR_SRC_SQL} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CORR_COLS) + ")",
    CORR_COLS, both=False, diag=False))
def q_corr_pairs(spark, sf):
    return R.corr_pairs(corr_input(spark, sf), CORR_COLS)


@register("corr_pairs_p", None)
def q_corr_pairs_p(spark, sf):
    return R.with_p_values(R.corr_pairs(corr_input(spark, sf), CORR_COLS))


def _spearman_sql(cols) -> str:
    lw = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
                      for c in cols)
    src = f"(SELECT {ranks} FROM {CORR_SRC_SQL} WHERE {lw})"
    return _pearson_sql(src, cols, both=False, diag=False)


@register("spearman_matrix", _spearman_sql(CORR_COLS))
def q_spearman(spark, sf):
    return R.spearman_long(corr_input(spark, sf), CORR_COLS)


CRON_ITEMS = ["l_extendedprice", "net", "l_quantity"]


@register("cronbach", f"""
WITH d AS (SELECT l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_quantity FROM lineitem),
a AS (SELECT var_samp(l_extendedprice) AS v0, var_samp(net) AS v1, var_samp(l_quantity) AS v2,
             var_samp(0.0 + l_extendedprice + net + l_quantity) AS vt,
             var_samp(0.0 + l_extendedprice + net + l_quantity - l_extendedprice) AS vd0,
             var_samp(0.0 + l_extendedprice + net + l_quantity - net) AS vd1,
             var_samp(0.0 + l_extendedprice + net + l_quantity - l_quantity) AS vd2,
             CAST(count(*) AS BIGINT) AS n FROM d)
SELECT '(todos)' AS item, CASE WHEN vt > 0 THEN 1.5 * (1 - (0.0 + v0 + v1 + v2) / vt) END AS alpha, n FROM a
UNION ALL SELECT 'l_extendedprice', CASE WHEN vd0 > 0 THEN 2.0 * (1 - (0.0 + v0 + v1 + v2 - v0) / vd0) END, n FROM a
UNION ALL SELECT 'net', CASE WHEN vd1 > 0 THEN 2.0 * (1 - (0.0 + v0 + v1 + v2 - v1) / vd1) END, n FROM a
UNION ALL SELECT 'l_quantity', CASE WHEN vd2 > 0 THEN 2.0 * (1 - (0.0 + v0 + v1 + v2 - v2) / vd2) END, n FROM a""")
def q_cronbach(spark, sf):
    li = lineitem(spark, sf).withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return R.cronbach(li, CRON_ITEMS)


@register("kendall_tau", """
WITH d AS (SELECT l_quantity AS x, l_discount AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL),
c AS (SELECT x, y, CAST(count(*) AS DOUBLE) AS w FROM d GROUP BY x, y),
s AS (SELECT sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM c a JOIN c b ON a.x <> b.x AND a.y <> b.y),
t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
tx AS (SELECT sum(t * (t - 1) / 2) AS tx FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM d GROUP BY x)),
ty AS (SELECT sum(t * (t - 1) / 2) AS ty FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM d GROUP BY y))
SELECT 'l_quantity' AS var1, 'l_discount' AS var2,
       s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) AS tau_b, CAST(n AS BIGINT) AS n, s
FROM s, t, tx, ty""")
def q_kendall(spark, sf):
    return R.kendall_tau_b(lineitem(spark, sf), "l_quantity", "l_discount").drop("p")


CORR_LONG_COLS = ["idx_exclusion_digital", "score_movilidad_proxy", "vulnerabilidad_social",
                  "decil_ingreso"]


def _kendall_select(src: str, a: str, b: str) -> str:
    """τ-b of one pair in SQL: contingency self-join of distinct (x, y) cells."""
    return f"""(WITH d AS (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {src}
                WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
     c AS (SELECT x, y, CAST(count(*) AS DOUBLE) AS w FROM d GROUP BY x, y),
     s AS (SELECT coalesce(sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / 2, 0) AS s
           FROM c a JOIN c b ON a.x <> b.x AND a.y <> b.y),
     t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
     tx AS (SELECT coalesce(sum(t * (t - 1) / 2), 0) AS tx FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM d GROUP BY x)),
     ty AS (SELECT coalesce(sum(t * (t - 1) / 2), 0) AS ty FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM d GROUP BY y))
     SELECT CASE WHEN (n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty) > 0
                 THEN s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) END AS tau FROM s, t, tx, ty)"""


def _corr_long_sql(cols) -> str:
    pear = []
    for a, b in _pairs(cols):
        r = "CASE WHEN count({a}) > 1 THEN 1.0 END".format(a=a) if a == b else f"corr({a}, {b})"
        pear.append(f"SELECT '{a}' AS var1, '{b}' AS var2, {r} AS pearson FROM frame")
    kend = []
    for i, a in enumerate(cols):
        kend.append(f"SELECT '{a}' AS var1, '{a}' AS var2, 1.0 AS kendall")
        for b in cols[i + 1:]:
            q = _kendall_select("frame", a, b)
            kend.append(f"SELECT '{a}' AS var1, '{b}' AS var2, (SELECT tau FROM {q}) AS kendall")
            kend.append(f"SELECT '{b}' AS var1, '{a}' AS var2, (SELECT tau FROM {q}) AS kendall")
    return with_frame("SELECT p.var1, p.var2, p.pearson, k.kendall FROM p JOIN k USING (var1, var2)",
                      "p AS (" + "\nUNION ALL ".join(pear) + ")",
                      "k AS (" + "\nUNION ALL ".join(kend) + ")")


@register("corr_long", _corr_long_sql(CORR_LONG_COLS))
def q_corr_long(spark, sf):
    """R5 + J11: Pearson and Kendall τ-b for every ordered pair and the diagonal of the
    panel indices, joined on (var1, var2)."""
    from . import jobs
    return jobs.panel_correlations(frame(spark, sf), CORR_LONG_COLS)


@register("gated_corr", """
SELECT CAST(count(CASE WHEN idx_exclusion_digital IS NOT NULL AND score_movilidad_proxy IS NOT NULL THEN 1 END) AS BIGINT) AS n,
       CASE WHEN count(CASE WHEN idx_exclusion_digital IS NOT NULL AND score_movilidad_proxy IS NOT NULL THEN 1 END) > 10
            THEN corr(idx_exclusion_digital, score_movilidad_proxy) END AS r FROM frame""")
def q_gated_corr(spark, sf):
    return G.gated_corr(frame(spark, sf), "idx_exclusion_digital", "score_movilidad_proxy")


REGISTRY["gated_corr"] = (q_gated_corr, with_frame(REGISTRY["gated_corr"][1]))


# ---------------------------------------------------------------------------
# Joins (J1–J9) on the bound person / household files
# ---------------------------------------------------------------------------

def _hh_no_pending(spark, sf):
    """Households without pending orders, so some persons are orphans."""
    o = bind.table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select("o_orderkey")
    h = bind.households(spark, sf)
    return h.join(o, h.CODUSU == o.o_orderkey, "left_semi")


HH_NP_SQL = "hh AS (SELECT * FROM households WHERE CODUSU IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))"


@register("household_join", with_base(f"""
SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey, h.ITF, h.V10, h.V11, h.IH_II_03, h.IH_II_04,
       CASE WHEN h.CODUSU IS NOT NULL THEN 1 END AS _hh
FROM persons p LEFT JOIN hh h ON p.CODUSU = h.CODUSU AND p.NRO_HOGAR = h.NRO_HOGAR""", HH_NP_SQL))
def q_household_join(spark, sf):
    j = J.household_join(_hh_no_pending(spark, sf), bind.persons(spark, sf), order=["anio"])
    return j.select(*KEY, "ITF", "V10", "V11", "IH_II_03", "IH_II_04", "_hh")


@register("household_join_stats", with_base("""
SELECT CAST(count(DISTINCT (p.CODUSU, p.NRO_HOGAR)) AS BIGINT) AS hogares, CAST(count(*) AS BIGINT) AS personas,
       CAST(count(*) - count(h.CODUSU) AS BIGINT) AS huerfanos
FROM persons p LEFT JOIN hh h ON p.CODUSU = h.CODUSU AND p.NRO_HOGAR = h.NRO_HOGAR""", HH_NP_SQL))
def q_household_join_stats(spark, sf):
    return J.merge_stats(J.household_join(_hh_no_pending(spark, sf), bind.persons(spark, sf)))


@register("orphans_anti", with_base("""
SELECT CAST(p.anio AS INTEGER) AS anio, CAST(count(*) AS BIGINT) AS huerfanos FROM persons p
WHERE NOT EXISTS (SELECT 1 FROM hh h WHERE h.CODUSU = p.CODUSU AND h.NRO_HOGAR = p.NRO_HOGAR)
GROUP BY 1""", HH_NP_SQL))
def q_orphans(spark, sf):
    o = J.orphans(bind.persons(spark, sf), _hh_no_pending(spark, sf))
    return o.groupBy(F.col("anio").cast("int").alias("anio")).agg(F.count(F.lit(1)).alias("huerfanos"))


# "first" needs a total order (trap T14): even the 4-column key repeats in small tables
DEDUP_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus", "l_shipdate"]


@register("dedup_first", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(DEDUP_ORDER)}) AS rn
  FROM lineitem) WHERE rn = 1""")
def q_dedup(spark, sf):
    li = lineitem(spark, sf)
    return J.keep_first(li, ["l_orderkey", "l_linenumber"], DEDUP_ORDER).select(*KEY, "l_quantity")


@register("duplicate_keys", """
SELECT CAST(sum(c) AS BIGINT) AS filas, CAST(count(*) AS BIGINT) AS claves, CAST(sum(c - 1) AS BIGINT) AS duplicadas
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def q_dupkeys(spark, sf):
    return J.duplicate_keys(lineitem(spark, sf), ["l_orderkey", "l_linenumber"])


@register("semi_reduce", with_base("""
SELECT CODUSU, ITF FROM households h
WHERE EXISTS (SELECT 1 FROM persons p WHERE p.CODUSU = h.CODUSU AND p.REGION = 1 AND p.CH06 >= 15)"""))
def q_semi(spark, sf):
    p = bind.persons(spark, sf).where((F.col("REGION") == 1) & (F.col("CH06") >= 15))
    return J.semi_reduce(bind.households(spark, sf), p).select("CODUSU", "ITF")


@register("label_lookup", with_base("""
SELECT n.n_name AS area, CAST(count(*) AS BIGINT) AS n, sum(PONDERA) AS peso
FROM persons p LEFT JOIN nation n ON p.AGLOMERADO = n.n_nationkey GROUP BY 1"""))
def q_label_lookup(spark, sf):
    p = J.label_join(bind.persons(spark, sf), bind.area_dim(spark, sf), "AGLOMERADO", "area")
    return p.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.sum("PONDERA").alias("peso"))


# ---------------------------------------------------------------------------
# Cleaning rules (P2–P6, P16, S7, A5) and the whole analysis frame
# ---------------------------------------------------------------------------
FRAME_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "anio", "PONDERA",
              "excl_sin_pc", "excl_sin_internet_hogar", "excl_sin_uso_cel", "excl_sin_uso_pc",
              "excl_sin_uso_internet", "idx_acceso", "idx_uso", "idx_exclusion_digital",
              "exclusion_digital_alta", "secundario_completo", "superior", "ocupado", "desocupado",
              "asalariado_registrado", "informal_proxy", "decil_ingreso", "quintil_bajo",
              "quintil_alto", "score_movilidad_proxy", "vulnerabilidad_social", "vulnerabilidad_alta",
              "sexo_mujer", "edad", "region_nombre", "aglomerado_nombre", "ITF"]


@register("analysis_frame", with_frame(f"SELECT {', '.join(FRAME_COLS)} FROM frame"))
def q_frame(spark, sf):
    return frame(spark, sf).select(*FRAME_COLS)


@register("validate", with_frame("""
SELECT CAST(count(*) AS BIGINT) AS filas,
       CAST(count(CASE WHEN CH06 < 0 OR CH06 > 100 THEN 1 END) AS BIGINT) AS edad_fuera_rango,
       CAST(count(CASE WHEN ITF < 0 THEN 1 END) AS BIGINT) AS itf_negativo,
       (0.0 + avg(CAST(CH12 IS NULL AS DOUBLE)) + avg(CAST(ESTADO IS NULL AS DOUBLE))
            + avg(CAST(V11_M IS NULL AS DOUBLE)) + avg(CAST(V12_M IS NULL AS DOUBLE))) / 4 * 100
         AS missing_critico_pct
FROM frame"""))
def q_validate(spark, sf):
    from .frame import validate_microdata
    return validate_microdata(frame(spark, sf))


@register("age_group", with_base("""
SELECT CASE WHEN CH06 > -1 AND CH06 <= 4 THEN '0-4 años' WHEN CH06 > 4 AND CH06 <= 14 THEN '5-14 años'
            WHEN CH06 > 14 AND CH06 <= 29 THEN '15-29 años' WHEN CH06 > 29 AND CH06 <= 44 THEN '30-44 años'
            WHEN CH06 > 44 AND CH06 <= 64 THEN '45-64 años' WHEN CH06 > 64 AND CH06 <= 200 THEN '65+ años' END
         AS grupo_etario, CAST(count(*) AS BIGINT) AS n
FROM persons GROUP BY 1"""))
def q_age_group(spark, sf):
    p = bind.persons(spark, sf)
    return p.groupBy(C.age_group("CH06").alias("grupo_etario")).agg(F.count(F.lit(1)).alias("n"))


@register("nsnr_null", with_base("""
SELECT CASE WHEN V10 NOT IN (9, 99, 999, -9, -99) THEN V10 END AS v10_clean, CAST(count(*) AS BIGINT) AS n
FROM households GROUP BY 1"""))
def q_nsnr(spark, sf):
    h = bind.households(spark, sf)
    return h.groupBy(C.nonresponse_to_null("V10").alias("v10_clean")).agg(F.count(F.lit(1)).alias("n"))


@register("clean_flags", with_base("""
SELECT ESTADO, CAST(coalesce(CAST(ESTADO = 1 AS INTEGER), 0) AS INTEGER) AS ocupado,
       CAST(coalesce(CAST(ESTADO = 2 AS INTEGER), 0) AS INTEGER) AS desocupado,
       CAST(coalesce(CAST(ESTADO = 3 AS INTEGER), 0) AS INTEGER) AS inactivo,
       CAST(coalesce(NIVEL_ED IN (6), false) AS INTEGER) AS educ_superior,
       CAST(coalesce(NIVEL_ED IN (4, 5, 6), false) AS INTEGER) AS educ_secundaria_o_mas,
       CAST(count(*) AS BIGINT) AS n
FROM persons GROUP BY ALL"""))
def q_clean_flags(spark, sf):
    p = bind.persons(spark, sf)
    return p.groupBy("ESTADO", C.eq_flag("ESTADO", 1).alias("ocupado"), C.eq_flag("ESTADO", 2).alias("desocupado"),
                     C.eq_flag("ESTADO", 3).alias("inactivo"), C.in_flag("NIVEL_ED", [6]).alias("educ_superior"),
                     C.in_flag("NIVEL_ED", [4, 5, 6]).alias("educ_secundaria_o_mas")) \
            .agg(F.count(F.lit(1)).alias("n"))


_QLAB = "['Q1 (más bajo)', 'Q2', 'Q3', 'Q4', 'Q5 (más alto)']"


@register("income_quintile_label", with_base("""
, e AS (SELECT min(IPCF) AS e0, quantile_cont(IPCF, 0.2) AS e1, quantile_cont(IPCF, 0.4) AS e2,
              quantile_cont(IPCF, 0.6) AS e3, quantile_cont(IPCF, 0.8) AS e4, max(IPCF) AS e5
       FROM persons WHERE IPCF > 0)
SELECT CASE WHEN IPCF > 0 AND IPCF <= e1 AND IPCF >= e0 THEN 'Q1 (más bajo)'
            WHEN IPCF > 0 AND IPCF <= e2 AND IPCF > e1 THEN 'Q2'
            WHEN IPCF > 0 AND IPCF <= e3 AND IPCF > e2 THEN 'Q3'
            WHEN IPCF > 0 AND IPCF <= e4 AND IPCF > e3 THEN 'Q4'
            WHEN IPCF > 0 AND IPCF <= e5 AND IPCF > e4 THEN 'Q5 (más alto)' END AS QUINTIL_IPCF,
       CAST(count(*) AS BIGINT) AS n, min(IPCF) AS lo, max(IPCF) AS hi
FROM persons, e GROUP BY 1""".replace("\n, e AS", "\nSELECT 1", 0)))
def q_income_quintile(spark, sf):
    p = income_quintile_label(bind.persons(spark, sf))
    return p.groupBy("QUINTIL_IPCF").agg(F.count(F.lit(1)).alias("n"), F.min("IPCF").alias("lo"),
                                         F.max("IPCF").alias("hi"))


def _fix_with(sql: str) -> str:
    # with_base(body) puts the body after the CTE list: turn a leading ", e AS" into a CTE
    return sql.replace("\n\n, e AS", ",\n  e AS", 1).replace("\n, e AS", ",\n  e AS", 1)


REGISTRY["income_quintile_label"] = (q_income_quintile, _fix_with(REGISTRY["income_quintile_label"][1]))


def events_text(spark, sf) -> DataFrame:
    ev = bind.table(spark, sf, "events")
    return ev.select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k_text"),
                     F.regexp_replace(F.col("value").cast("string"), r"\.", ",").alias("value_comma"))


@register("mixed_type_repair", """
WITH d AS (SELECT event_type, json_extract_string(props, '$.k') AS k_text,
                  replace(CAST(value AS VARCHAR), '.', ',') AS value_comma FROM events),
c AS (SELECT 'event_type' AS columna, CAST(count(CASE WHEN trim(event_type) <> '' THEN 1 END) AS BIGINT) AS no_vacios,
             CAST(count(TRY_CAST(trim(CASE WHEN trim(event_type) <> '' THEN event_type END) AS DOUBLE)) AS BIGINT) AS numericos FROM d
      UNION ALL
      SELECT 'k_text', CAST(count(CASE WHEN trim(k_text) <> '' THEN 1 END) AS BIGINT),
             CAST(count(TRY_CAST(trim(CASE WHEN trim(k_text) <> '' THEN k_text END) AS DOUBLE)) AS BIGINT) FROM d
      UNION ALL
      SELECT 'value_comma', CAST(count(CASE WHEN trim(value_comma) <> '' THEN 1 END) AS BIGINT),
             CAST(count(TRY_CAST(trim(CASE WHEN trim(value_comma) <> '' THEN value_comma END) AS DOUBLE)) AS BIGINT) FROM d)
SELECT columna, no_vacios, numericos, no_vacios > 0 AND numericos >= 0.95 * no_vacios AS a_numerico FROM c""")
def q_mixed(spark, sf):
    return S.mixed_type_decisions(events_text(spark, sf).drop("event_id"))


@register("decimal_comma", """
SELECT event_type, sum(TRY_CAST(replace(trim(replace(CAST(value AS VARCHAR), '.', ',')), ',', '.') AS DOUBLE)) AS total,
       CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type""")
def q_decimal_comma(spark, sf):
    from ..functions.expr import num_comma
    e = events_text(spark, sf)
    return e.groupBy("event_type").agg(F.sum(num_comma("value_comma")).alias("total"),
                                       F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Generation-1 index (I1–I7) on persons ⟕ households
# ---------------------------------------------------------------------------

def index_frame(spark, sf) -> DataFrame:
    j = J.household_join(bind.households(spark, sf), bind.persons(spark, sf), order=["anio"])
    acc, _ = C.access_dimension(j)
    ski, _ = C.skills_dimension(j)
    use, _ = C.use_dimension(j)
    j = j.withColumns({"DIM_ACCESO": acc, "DIM_COMPETENCIAS": ski, "DIM_USO": use})
    j = j.withColumn("INDICE_EXCLUSION", row_mean(["DIM_ACCESO", "DIM_COMPETENCIAS", "DIM_USO"]))
    return j.withColumn("NIVEL_EXCLUSION", C.exclusion_level("INDICE_EXCLUSION"))


INDEX_SQL = """
  j AS (SELECT p.*, h.IH_II_03, h.IH_II_04 FROM persons p LEFT JOIN households h
        ON p.CODUSU = h.CODUSU AND p.NRO_HOGAR = h.NRO_HOGAR),
  d AS (SELECT *,
     CASE WHEN IH_II_04 = 1 THEN 0.0 WHEN IH_II_04 = 2 THEN 1.0 END AS a1,
     CASE WHEN IH_II_03 = 1 THEN 0.0 WHEN IH_II_03 = 2 THEN 1.0 END AS a2,
     CASE WHEN CH06 < 30 THEN 0.0 WHEN CH06 < 45 THEN 0.2 WHEN CH06 < 60 THEN 0.4 WHEN CH06 < 75 THEN 0.7
          WHEN CH06 >= 75 THEN 0.9 END AS s1,
     CASE WHEN NIVEL_ED = 7 THEN 1.0 WHEN NIVEL_ED = 1 THEN 0.9 WHEN NIVEL_ED = 2 THEN 0.7 WHEN NIVEL_ED = 3 THEN 0.5
          WHEN NIVEL_ED = 4 THEN 0.3 WHEN NIVEL_ED = 5 THEN 0.15 WHEN NIVEL_ED = 6 THEN 0.0 END AS s2,
     CASE WHEN IP_III_04 = 1 THEN 0.0 WHEN IP_III_04 = 2 THEN 1.0 END AS u1,
     CASE WHEN IP_III_05 = 1 THEN 0.0 WHEN IP_III_05 = 2 THEN 1.0 END AS u2,
     CASE WHEN IP_III_06 = 1 THEN 0.0 WHEN IP_III_06 = 2 THEN 1.0 END AS u3 FROM j),
  x AS (SELECT *,
     (0.0 + coalesce(a1, 0.0) + coalesce(a2, 0.0)) / nullif(0 + CAST(a1 IS NOT NULL AS INTEGER) + CAST(a2 IS NOT NULL AS INTEGER), 0) AS DIM_ACCESO,
     (0.0 + coalesce(s1, 0.0) + coalesce(s2, 0.0)) / nullif(0 + CAST(s1 IS NOT NULL AS INTEGER) + CAST(s2 IS NOT NULL AS INTEGER), 0) AS DIM_COMPETENCIAS,
     (0.0 + coalesce(u1, 0.0) + coalesce(u2, 0.0) + coalesce(u3, 0.0))
        / nullif(0 + CAST(u1 IS NOT NULL AS INTEGER) + CAST(u2 IS NOT NULL AS INTEGER) + CAST(u3 IS NOT NULL AS INTEGER), 0) AS DIM_USO
     FROM d),
  ix AS (SELECT *, (0.0 + coalesce(DIM_ACCESO, 0.0) + coalesce(DIM_COMPETENCIAS, 0.0) + coalesce(DIM_USO, 0.0))
        / nullif(0 + CAST(DIM_ACCESO IS NOT NULL AS INTEGER) + CAST(DIM_COMPETENCIAS IS NOT NULL AS INTEGER)
                   + CAST(DIM_USO IS NOT NULL AS INTEGER), 0) AS INDICE_EXCLUSION FROM x),
  lv AS (SELECT *, CASE WHEN INDICE_EXCLUSION > -0.001 AND INDICE_EXCLUSION <= 0.25 THEN 'Inclusión'
                        WHEN INDICE_EXCLUSION > 0.25 AND INDICE_EXCLUSION <= 0.5 THEN 'Exclusión leve'
                        WHEN INDICE_EXCLUSION > 0.5 AND INDICE_EXCLUSION <= 0.75 THEN 'Exclusión moderada'
                        WHEN INDICE_EXCLUSION > 0.75 AND INDICE_EXCLUSION <= 1.001 THEN 'Exclusión severa' END
                   AS NIVEL_EXCLUSION FROM ix)"""


@register("index_rows", with_base(f"SELECT {KEY_SQL}, DIM_ACCESO, DIM_COMPETENCIAS, DIM_USO, INDICE_EXCLUSION, "
                                  "NIVEL_EXCLUSION FROM lv", INDEX_SQL))
def q_index_rows(spark, sf):
    return index_frame(spark, sf).select(*KEY, "DIM_ACCESO", "DIM_COMPETENCIAS", "DIM_USO",
                                         "INDICE_EXCLUSION", "NIVEL_EXCLUSION")


@register("index_level_dist", with_base("""
SELECT NIVEL_EXCLUSION, CAST(count(*) AS BIGINT) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct
FROM lv GROUP BY 1""", INDEX_SQL))
def q_index_level(spark, sf):
    return K.level_distribution(index_frame(spark, sf))


@register("index_by_education", with_base("""
SELECT NIVEL_ED, avg(INDICE_EXCLUSION) AS indice_medio, CAST(count(INDICE_EXCLUSION) AS BIGINT) AS n
FROM lv GROUP BY 1""", INDEX_SQL))
def q_index_by_ed(spark, sf):
    return K.index_by(index_frame(spark, sf), "NIVEL_ED")


# ---------------------------------------------------------------------------
# Schema profile (S5, S6, G16, G18) and reshapes / sorts (U*, O*)
# ---------------------------------------------------------------------------

@register("profile_columns", """
SELECT 'o_orderkey' AS columna, 'bigint' AS tipo, CAST(count(*) - count(o_orderkey) AS BIGINT) AS nulos,
       100.0 * (count(*) - count(o_orderkey)) / count(*) AS pct_nulos, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS distintos FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', CAST(count(*) - count(o_orderstatus) AS BIGINT),
       100.0 * (count(*) - count(o_orderstatus)) / count(*), CAST(count(DISTINCT o_orderstatus) AS BIGINT) FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', CAST(count(*) - count(o_orderpriority) AS BIGINT),
       100.0 * (count(*) - count(o_orderpriority)) / count(*), CAST(count(DISTINCT o_orderpriority) AS BIGINT) FROM orders
UNION ALL SELECT 'o_custkey', 'bigint', CAST(count(*) - count(o_custkey) AS BIGINT),
       100.0 * (count(*) - count(o_custkey)) / count(*), CAST(count(DISTINCT o_custkey) AS BIGINT) FROM orders""")
def q_profile(spark, sf):
    o = bind.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    return S.column_profile(o)


@register("candidate_columns", """
WITH p AS (
SELECT 'o_orderkey' AS columna, 'bigint' AS tipo, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS distintos FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', CAST(count(DISTINCT o_orderstatus) AS BIGINT) FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', CAST(count(DISTINCT o_orderpriority) AS BIGINT) FROM orders
UNION ALL SELECT 'o_custkey', 'bigint', CAST(count(DISTINCT o_custkey) AS BIGINT) FROM orders)
SELECT columna, tipo, distintos FROM p WHERE distintos <= 30""")
def q_candidates(spark, sf):
    """Categorical selector candidates (≤ 30 distinct values) from the S6 profile."""
    return S.candidate_columns(q_profile(spark, sf), 30).select("columna", "tipo", "distintos")


@register("seeded_sample", f"""
SELECT {KEY_SQL}, l_extendedprice FROM lineitem
ORDER BY md5(concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in KEY)}, '42')), {KEY_SQL} LIMIT 500""")
def q_sample(spark, sf):
    """A 500-row seeded sample without replacement (the sample is the feature)."""
    li = lineitem(spark, sf).select(*KEY, "l_extendedprice")
    return MP.seeded_sample(li, KEY, 500, seed=42, portable=True)


@register("target_expert", """
WITH t AS (SELECT CASE WHEN l_extendedprice >= (SELECT median(l_extendedprice) FROM lineitem) THEN 1 ELSE 0 END AS target
           FROM lineitem)
SELECT target, CAST(count(*) AS BIGINT) AS n, count(*) / sum(count(*)) OVER () AS share FROM t GROUP BY 1""")
def q_target_expert(spark, sf):
    """P27 (expert mode) + G18: a many-valued numeric target binarised at its unweighted
    median (a lazy scalar subquery), then the class balance."""
    t, _, _ = MP.model_target(lineitem(spark, sf), "experto", "l_extendedprice")
    return G.class_balance(t, "target")


@register("null_top5", with_frame("""
SELECT columna, nulos FROM (
  SELECT 'idx_exclusion_digital' AS columna, CAST(count(*) - count(idx_exclusion_digital) AS BIGINT) AS nulos FROM frame
  UNION ALL SELECT 'informal_proxy', CAST(count(*) - count(informal_proxy) AS BIGINT) FROM frame
  UNION ALL SELECT 'excl_sin_uso_cel', CAST(count(*) - count(excl_sin_uso_cel) AS BIGINT) FROM frame
  UNION ALL SELECT 'excl_sin_uso_pc', CAST(count(*) - count(excl_sin_uso_pc) AS BIGINT) FROM frame
  UNION ALL SELECT 'excl_sin_uso_internet', CAST(count(*) - count(excl_sin_uso_internet) AS BIGINT) FROM frame
  UNION ALL SELECT 'excl_sin_pc', CAST(count(*) - count(excl_sin_pc) AS BIGINT) FROM frame
  UNION ALL SELECT 'CH12', CAST(count(*) - count(CH12) AS BIGINT) FROM frame
  UNION ALL SELECT 'PONDERA', CAST(count(*) - count(PONDERA) AS BIGINT) FROM frame)
WHERE nulos > 0 ORDER BY nulos DESC, columna LIMIT 5"""))
def q_null_top5(spark, sf):
    f = frame(spark, sf).select("idx_exclusion_digital", "informal_proxy", "excl_sin_uso_cel",
                                "excl_sin_uso_pc", "excl_sin_uso_internet", "excl_sin_pc", "CH12", "PONDERA")
    return G.null_counts(f, 5)


@register("class_balance", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, count(*) / sum(count(*)) OVER () AS share
FROM lineitem GROUP BY 1""")
def q_class_balance(spark, sf):
    return G.class_balance(lineitem(spark, sf), "l_returnflag")


@register("freq_multi_variable", with_frame("""
, u AS (SELECT PONDERA, 'region_nombre' AS variable, coalesce(CAST(region_nombre AS VARCHAR), 'Sin dato') AS categoria FROM frame
        UNION ALL SELECT PONDERA, 'ESTADO', coalesce(CAST(ESTADO AS VARCHAR), 'Sin dato') FROM frame
        UNION ALL SELECT PONDERA, 'NIVEL_ED', coalesce(CAST(NIVEL_ED AS VARCHAR), 'Sin dato') FROM frame),
a AS (SELECT variable, categoria, sum(PONDERA) AS sw FROM u GROUP BY 1, 2)
SELECT variable, categoria, 100 * sw / sum(sw) OVER (PARTITION BY variable) AS pct_ponderado FROM a"""))
def q_freq_multi(spark, sf):
    f = frame(spark, sf)
    return G.frequencies_stacked(f.withColumn("ESTADO", F.col("ESTADO").cast("string"))
                                  .withColumn("NIVEL_ED", F.col("NIVEL_ED").cast("string")),
                                 ["region_nombre", "ESTADO", "NIVEL_ED"])


REGISTRY["freq_multi_variable"] = (q_freq_multi, _fix_with(REGISTRY["freq_multi_variable"][1]).replace(
    ",\n  e AS", ",\n  e AS").replace("\n\n, u AS", ",\n  u AS").replace("\n, u AS", ",\n  u AS"))


def _catalog(spark, sf):
    return K.catalog(frame(spark, sf), territory_dim(spark, sf))


from .testbed import _CATALOG_SQL  # noqa: E402

_CAT = f"({_CATALOG_SQL}) cat"
MELT_IND = ["pct_secundario_completo", "pct_superior", "pct_ocupado", "score_movilidad_proxy",
            "vulnerabilidad_social", "idx_exclusion_digital"]


@register("topk_areas", f"""
SELECT territorio_id, territorio_nombre, pct_ocupado FROM {_CAT}
WHERE tipo = 'aglomerado' AND pct_ocupado IS NOT NULL
ORDER BY pct_ocupado DESC, territorio_id LIMIT 5""")
def q_topk(spark, sf):
    """The five areas with the highest employment share (the limit is the feature)."""
    c = _catalog(spark, sf).where(F.col("tipo") == "aglomerado").dropna(subset=["pct_ocupado"])
    return c.orderBy(F.desc("pct_ocupado"), "territorio_id").limit(5) \
            .select("territorio_id", "territorio_nombre", "pct_ocupado")


@register("ranking", f"""
SELECT territorio_id, vulnerabilidad_social,
       CAST(rank() OVER (ORDER BY vulnerabilidad_social DESC) AS INTEGER) AS rank
FROM {_CAT} WHERE tipo = 'aglomerado' AND vulnerabilidad_social IS NOT NULL""")
def q_ranking(spark, sf):
    """O3: territory ranking by a KPI, nulls dropped, with a rank column."""
    return K.ranking(_catalog(spark, sf), "vulnerabilidad_social")


@register("melt_compare", "\nUNION ALL\n".join(
    f"SELECT territorio_id, '{c}' AS indicador, CAST({c} AS DOUBLE) AS valor FROM {_CAT}" for c in MELT_IND))
def q_melt(spark, sf):
    """Catalogue KPIs to long form (territory, indicator, value)."""
    c = _catalog(spark, sf)
    return c.select("territorio_id", *[F.col(x).cast("double") for x in MELT_IND]) \
            .unpivot(["territorio_id"], MELT_IND, "indicador", "valor")


@register("transpose_profile", """
WITH a AS (SELECT l_returnflag, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax
           FROM lineitem GROUP BY 1),
u AS (SELECT 'l_quantity' AS variable, l_returnflag, l_quantity AS v FROM a UNION ALL
      SELECT 'l_discount', l_returnflag, l_discount FROM a UNION ALL SELECT 'l_tax', l_returnflag, l_tax FROM a)
SELECT variable, max(v) FILTER (WHERE l_returnflag = 'A') AS A, max(v) FILTER (WHERE l_returnflag = 'N') AS N,
       max(v) FILTER (WHERE l_returnflag = 'R') AS R FROM u GROUP BY variable""")
def q_transpose(spark, sf):
    """U8: per-group means with features as rows and groups as columns."""
    feats = ["l_quantity", "l_discount", "l_tax"]
    a = lineitem(spark, sf).groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in feats])
    long = a.unpivot(["l_returnflag"], feats, "variable", "v")
    return long.groupBy("variable").pivot("l_returnflag", ["A", "N", "R"]).agg(F.first("v"))


@register("panel_union", with_base("""
SELECT anio, CAST(count(*) AS BIGINT) AS n, CAST(count(V10_M) AS BIGINT) AS con_tic FROM (
  SELECT anio, CH06, NULL AS V10_M FROM persons WHERE anio = 1995
  UNION ALL SELECT anio, CH06, V10_M FROM persons WHERE anio <> 1995) GROUP BY anio"""))
def q_panel_union(spark, sf):
    """Waves with different column sets aligned by name (outer union of columns)."""
    p = bind.persons(spark, sf)
    w1 = p.where(F.col("anio") == 1995).select("anio", "CH06")
    w2 = p.where(F.col("anio") != 1995).select("anio", "CH06", "V10_M")
    u = w1.unionByName(w2, allowMissingColumns=True)
    return u.groupBy("anio").agg(F.count(F.lit(1)).alias("n"), F.count("V10_M").alias("con_tic"))


# ---------------------------------------------------------------------------
# Scenario levers (L1–L3) for every area at once
# ---------------------------------------------------------------------------
LEVER_TARGET = 80.0


@register("lever_baselines", with_frame(f"""
SELECT CAST(AGLOMERADO AS INTEGER) AS AGLOMERADO,
  coalesce(100 * ({'sum(CASE WHEN superior IS NOT NULL AND PONDERA IS NOT NULL THEN superior * PONDERA END) / sum(CASE WHEN superior IS NOT NULL AND PONDERA IS NOT NULL THEN PONDERA END)'}), 0.0) AS pct_superior,
  100 - coalesce(100 * (sum(CASE WHEN informal_proxy IS NOT NULL AND ocupado = 1 THEN informal_proxy * PONDERA END)
                        / sum(CASE WHEN informal_proxy IS NOT NULL AND ocupado = 1 THEN PONDERA END)), 0.0) AS pct_empleo_formal,
  coalesce(100 * (sum(CASE WHEN excl_sin_internet_hogar IS NOT NULL AND decil_ingreso <= 2 THEN (1 - excl_sin_internet_hogar) * PONDERA END)
                  / sum(CASE WHEN excl_sin_internet_hogar IS NOT NULL AND decil_ingreso <= 2 THEN PONDERA END)), 0.0) AS internet_quintil_i
FROM frame GROUP BY 1"""))
def q_lever_baselines(spark, sf):
    f = frame(spark, sf).withColumn("AGLOMERADO", F.col("AGLOMERADO").cast("int"))
    return L.lever_baselines(f, by="AGLOMERADO")


@register("lever_flip", with_frame(f"""
, m AS (SELECT *, CAST(AGLOMERADO AS INTEGER) AS area, coalesce(PONDERA, 1.0) AS w1 FROM frame
        WHERE coalesce(decil_ingreso <= 2, false) AND excl_sin_internet_hogar IS NOT NULL),
t AS (SELECT area, sum(w1) AS sw, coalesce(sum(CASE WHEN excl_sin_internet_hogar = 0.0 THEN w1 END), 0.0) AS swg FROM m GROUP BY area),
p AS (SELECT area, CASE WHEN {LEVER_TARGET} > 100 * swg / sw + 0.05 THEN greatest(0.0, {LEVER_TARGET} / 100 * sw - swg) ELSE 0.0 END AS extra,
             sw, swg FROM t),
c AS (SELECT m.area, m.w1, p.extra,
             coalesce(sum(m.w1) OVER (PARTITION BY m.area ORDER BY m.w1 DESC, {', '.join('m.' + k for k in KEY)}
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before
      FROM m JOIN p USING (area) WHERE m.excl_sin_internet_hogar = 1.0)
SELECT p.area AS AGLOMERADO, CAST(count(c.w1) FILTER (WHERE c.before < c.extra AND c.extra > 0) AS BIGINT) AS flipped,
       coalesce(sum(c.w1) FILTER (WHERE c.before < c.extra AND c.extra > 0), 0.0) AS flipped_w,
       100 * (p.swg + coalesce(sum(c.w1) FILTER (WHERE c.before < c.extra AND c.extra > 0), 0.0)) / p.sw AS pct_after
FROM p LEFT JOIN c USING (area) GROUP BY p.area, p.swg, p.sw"""))
def q_lever_flip(spark, sf):
    f = frame(spark, sf).withColumn("AGLOMERADO", F.col("AGLOMERADO").cast("int"))
    targets = f.select("AGLOMERADO").distinct().withColumn("target", F.lit(LEVER_TARGET))
    mask = num("decil_ingreso") <= 2
    out = L.flip_to_target(f, mask, "excl_sin_internet_hogar", targets, KEY, by="AGLOMERADO")
    m = out.where(F.coalesce(mask, F.lit(False)) & F.col("excl_sin_internet_hogar").isNotNull())
    w1 = F.coalesce(F.col("PONDERA"), F.lit(1.0))
    return m.groupBy("AGLOMERADO").agg(
        F.count(F.when(F.col("_flipped"), 1)).alias("flipped"),
        F.coalesce(F.sum(F.when(F.col("_flipped"), w1)), F.lit(0.0)).alias("flipped_w"),
        (100 * F.sum(F.when(F.col("excl_sin_internet_hogar") == 0.0, w1)) / F.sum(w1)).alias("pct_after"))


REGISTRY["lever_flip"] = (q_lever_flip, _fix_with(REGISTRY["lever_flip"][1]).replace("\n\n, m AS", ",\n  m AS")
                          .replace("\n, m AS", ",\n  m AS"))


RATE_TARGET = 40.0
_KEYS_M = ", ".join("m." + k for k in KEY)


@register("lever_rate", with_frame(f"""
SELECT p.area AS AGLOMERADO, CAST(count(c.w1) FILTER (WHERE c.before < c.extra AND c.extra > 0) AS BIGINT) AS flipped,
       coalesce(sum(c.w1) FILTER (WHERE c.before < c.extra AND c.extra > 0), 0.0) AS flipped_w,
       100 * (p.swg + coalesce(sum(c.w1) FILTER (WHERE c.before < c.extra AND c.extra > 0), 0.0)) / p.sw AS pct_after
FROM p LEFT JOIN c USING (area) GROUP BY p.area, p.swg, p.sw""",
    "m AS (SELECT *, CAST(AGLOMERADO AS INTEGER) AS area, coalesce(PONDERA, 1.0) AS w1 FROM frame "
    "WHERE superior IS NOT NULL)",
    "t AS (SELECT area, sum(w1) AS sw, coalesce(sum(CASE WHEN superior = 1.0 THEN w1 END), 0.0) AS swg "
    "FROM m GROUP BY area)",
    f"p AS (SELECT area, CASE WHEN {RATE_TARGET} > 100 * swg / sw + 0.05 "
    f"THEN greatest(0.0, {RATE_TARGET} / 100 * sw - swg) ELSE 0.0 END AS extra, sw, swg FROM t)",
    f"c AS (SELECT m.area, m.w1, p.extra, coalesce(sum(m.w1) OVER (PARTITION BY m.area ORDER BY m.w1 DESC, "
    f"{_KEYS_M} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before "
    f"FROM m JOIN p USING (area) WHERE m.superior = 0.0)"))
def q_lever_rate(spark, sf):
    """L3: raise the weighted rate of ``superior`` (0 → 1), heaviest rows first, to the
    target in every area at once."""
    f = frame(spark, sf).withColumn("AGLOMERADO", F.col("AGLOMERADO").cast("int"))
    targets = f.select("AGLOMERADO").distinct().withColumn("target", F.lit(RATE_TARGET))
    out = L.flip_to_target(f, F.lit(True), "superior", targets, KEY, by="AGLOMERADO",
                           good_value=1.0, bad_value=0.0)
    m = out.where(F.col("superior").isNotNull())
    w1 = F.coalesce(F.col("PONDERA"), F.lit(1.0))
    return m.groupBy("AGLOMERADO").agg(
        F.count(F.when(F.col("_flipped"), 1)).alias("flipped"),
        F.coalesce(F.sum(F.when(F.col("_flipped"), w1)), F.lit(0.0)).alias("flipped_w"),
        (100 * F.sum(F.when(F.col("superior") == 1.0, w1)) / F.sum(w1)).alias("pct_after"))


@register("scenario_compare", None)
def q_scenario(spark, sf):
    """All three levers for every area in one job, KPIs before/after, long compare."""
    f = frame(spark, sf).withColumn("AGLOMERADO", F.col("AGLOMERADO").cast("int"))
    targets = f.select("AGLOMERADO").distinct().withColumns({
        "internet_quintil_i": F.lit(80.0), "pct_superior": F.lit(40.0), "pct_empleo_formal": F.lit(70.0)})
    thr = f.agg(F.median("idx_exclusion_digital")).scalar()
    after = L.apply_scenario(f, targets, KEY, by="AGLOMERADO", exclusion_threshold=thr)
    ind = ["pct_superior", "pct_ocupado", "score_movilidad_proxy", "vulnerabilidad_social",
           "idx_exclusion_digital", "pct_exclusion_digital_alta", "pct_informal_ocupados"]
    before = K.kpis(f, by="AGLOMERADO", gaps=False)
    after_k = K.kpis(after, by="AGLOMERADO", gaps=False)
    return J.compare_indicators(before, after_k, ["AGLOMERADO"], ind)


# ---------------------------------------------------------------------------
# Model preparation and evaluation on a fixed score
# ---------------------------------------------------------------------------

@register("one_hot", """
SELECT o_orderkey, CAST(coalesce(o_orderpriority = '2-HIGH', false) AS DOUBLE) AS "o_orderpriority_2-HIGH",
       CAST(coalesce(o_orderpriority = '3-MEDIUM', false) AS DOUBLE) AS "o_orderpriority_3-MEDIUM",
       CAST(coalesce(o_orderpriority = '4-NOT SPECIFIED', false) AS DOUBLE) AS "o_orderpriority_4-NOT SPECIFIED",
       CAST(coalesce(o_orderpriority = '5-LOW', false) AS DOUBLE) AS "o_orderpriority_5-LOW" FROM orders""")
def q_one_hot(spark, sf):
    o = bind.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return MP.one_hot(o, MP.category_levels(o, ["o_orderpriority"]))


@register("impute_median", """
SELECT CAST(count(*) AS BIGINT) AS n,
       sum(coalesce(nullif(l_discount, 0), (SELECT median(nullif(l_discount, 0)) FROM lineitem))) AS total,
       (SELECT median(nullif(l_discount, 0)) FROM lineitem) AS mediana FROM lineitem""")
def q_impute(spark, sf):
    li = lineitem(spark, sf).select(F.nullif(F.col("l_discount"), F.lit(0.0)).alias("d"))
    med = li.agg(F.median("d")).scalar()
    return MP.impute_median(li, ["d"]).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("total")) \
             .withColumn("mediana", med)


@register("standardise_pop", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       (l_extendedprice - avg(l_extendedprice) OVER ()) / CASE WHEN stddev_pop(l_extendedprice) OVER () = 0 THEN 1.0
            ELSE stddev_pop(l_extendedprice) OVER () END AS l_extendedprice,
       (l_tax - avg(l_tax) OVER ()) / CASE WHEN stddev_pop(l_tax) OVER () = 0 THEN 1.0 ELSE stddev_pop(l_tax) OVER () END AS l_tax
FROM lineitem""")
def q_standardise(spark, sf):
    li = lineitem(spark, sf).select(*KEY, "l_extendedprice", "l_tax")
    return MP.standardise(li, ["l_extendedprice", "l_tax"])


@register("hash_split", f"""
SELECT l_returnflag, CASE WHEN substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
            CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), '42')), 1, 8) < '{format(int(0.8 * 16 ** 8), '08x')}'
            THEN 'train' ELSE 'test' END AS split, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY 1, 2""")
def q_hash_split(spark, sf):
    s = MP.hash_split(lineitem(spark, sf), KEY)
    return s.groupBy("l_returnflag", "split").agg(F.count(F.lit(1)).alias("n"))


SCORED_SQL = "(SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount AS score, " \
             "CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS pred FROM lineitem)"


def scored(spark, sf) -> DataFrame:
    li = lineitem(spark, sf)
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("score"),
                     (F.col("l_discount") >= 0.05).cast("int").alias("pred"))


@register("confusion", f"SELECT y AS real, pred, CAST(count(*) AS BIGINT) AS n FROM {SCORED_SQL} GROUP BY 1, 2")
def q_confusion(spark, sf):
    return EV.confusion(scored(spark, sf), "y", "pred").withColumnRenamed("real", "real")


@register("auc_exact", f"""
WITH t AS (SELECT score AS v, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS pos,
                  CAST(count(*) FILTER (WHERE y <> 1) AS DOUBLE) AS neg FROM {SCORED_SQL} GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS nb FROM t)
SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)) END AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c""")
def q_auc(spark, sf):
    return EV.auc(scored(spark, sf), "y", "score")


@register("roc_points", f"""
WITH t AS (SELECT score AS v, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS pos,
                  CAST(count(*) FILTER (WHERE y <> 1) AS DOUBLE) AS neg FROM {SCORED_SQL} GROUP BY 1)
SELECT v AS threshold, sum(neg) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) / sum(neg) OVER () AS fpr,
       sum(pos) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) / sum(pos) OVER () AS tpr FROM t""")
def q_roc(spark, sf):
    return EV.roc_points(scored(spark, sf), "y", "score")


def _report_sql() -> str:
    return f"""
WITH c AS (SELECT count(*) FILTER (WHERE y = 0 AND pred = 0) AS c00, count(*) FILTER (WHERE y = 0 AND pred = 1) AS c01,
                  count(*) FILTER (WHERE y = 1 AND pred = 0) AS c10, count(*) FILTER (WHERE y = 1 AND pred = 1) AS c11
           FROM {SCORED_SQL}),
k AS (SELECT '0' AS clase, c00 AS tp, c10 AS fp, c01 AS fn, c00, c01, c10, c11 FROM c
      UNION ALL SELECT '1', c11, c01, c10, c00, c01, c10, c11 FROM c),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
             CAST(tp + fn AS DOUBLE) AS support FROM k),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
SELECT clase, precision, recall, f1, support, (c00 + c11) / (c00 + c01 + c10 + c11) AS accuracy,
       avg(f1) OVER () AS f1_macro, sum(f1 * support) OVER () / sum(support) OVER () AS f1_weighted FROM f"""


@register("class_report", _report_sql())
def q_report(spark, sf):
    return EV.classification_report(scored(spark, sf), "y", "pred")


BETA = {"l_quantity": 0.05, "l_discount": -3.0, "l_tax": 2.0}


@register("linear_shap_fixed_beta", """
WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem),
a AS (SELECT avg(abs(0.05 * (l_quantity - q))) AS l_quantity, avg(abs(-3.0 * (l_discount - d))) AS l_discount,
             avg(abs(2.0 * (l_tax - t))) AS l_tax FROM lineitem, m),
u AS (SELECT 'l_quantity' AS variable, l_quantity AS mean_abs_shap FROM a UNION ALL
      SELECT 'l_discount', l_discount FROM a UNION ALL SELECT 'l_tax', l_tax FROM a)
SELECT variable, mean_abs_shap, 100 * mean_abs_shap / sum(mean_abs_shap) OVER () AS pct FROM u""")
def q_shap(spark, sf):
    return EV.linear_shap(lineitem(spark, sf), BETA)
