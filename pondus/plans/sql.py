"""The analysis frame of :mod:`pondus.plans.frame` over the bound test tables, in SQL.

Used only as the DuckDB oracle text; ``with_frame(body)`` prefixes a query with the
CTE chain ``territory → persons → households → frame``.
"""

from .bind import HOUSEHOLDS_SQL, PERSONS_SQL, TERRITORY_SQL

FRAME_SQL = """
  h0 AS (SELECT CODUSU, AGLOMERADO, REGION, ITF, DECIFR, V10, V11,
                row_number() OVER (PARTITION BY CODUSU ORDER BY anio, trimestre) AS rn
         FROM households),
  h AS (SELECT CODUSU, AGLOMERADO AS AGLOMERADO_hog, REGION AS REGION_hog, ITF,
               DECIFR AS DECIFR_hog, V10 AS H_V10, V11 AS H_V11 FROM h0 WHERE rn = 1),
  i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, NRO_HOGAR, COMPONENTE,
               CODUSU, AGLOMERADO, REGION, CH04, CAST(CH06 AS DOUBLE) AS CH06, CH12, NIVEL_ED,
               ESTADO, CAT_OCUP, PP07H, PONDERA, DECIFR, IPCF, V10_M, V11_M, V12_M,
               anio, trimestre
        FROM persons WHERE CH06 >= 15),
  j AS (SELECT i.*, h.AGLOMERADO_hog, h.REGION_hog, h.ITF, h.DECIFR_hog, h.H_V10, h.H_V11
        FROM i LEFT JOIN h ON i.CODUSU = h.CODUSU),
  f1 AS (SELECT *,
           CASE WHEN H_V10 = 2 THEN 0.0 WHEN H_V10 = 1 THEN 1.0 END AS excl_sin_pc,
           CASE WHEN H_V11 = 2 THEN 0.0 WHEN H_V11 = 1 THEN 1.0 END AS excl_sin_internet_hogar,
           CASE WHEN V10_M = 0 THEN 1.0 WHEN V10_M > 0 THEN 0.0 END AS excl_sin_uso_cel,
           CASE WHEN V11_M = 0 THEN 1.0 WHEN V11_M > 0 THEN 0.0 END AS excl_sin_uso_pc,
           CASE WHEN V12_M = 0 THEN 1.0 WHEN V12_M > 0 THEN 0.0 END AS excl_sin_uso_internet
         FROM j),
  f2 AS (SELECT *,
           (0.0 + coalesce(excl_sin_pc, 0.0) + coalesce(excl_sin_internet_hogar, 0.0))
             / nullif(0 + CAST(excl_sin_pc IS NOT NULL AS INTEGER)
                        + CAST(excl_sin_internet_hogar IS NOT NULL AS INTEGER), 0) AS idx_acceso,
           (0.0 + coalesce(excl_sin_uso_cel, 0.0) + coalesce(excl_sin_uso_pc, 0.0)
                + coalesce(excl_sin_uso_internet, 0.0))
             / nullif(0 + CAST(excl_sin_uso_cel IS NOT NULL AS INTEGER)
                        + CAST(excl_sin_uso_pc IS NOT NULL AS INTEGER)
                        + CAST(excl_sin_uso_internet IS NOT NULL AS INTEGER), 0) AS idx_uso,
           (0.0 + coalesce(excl_sin_pc, 0.0) + coalesce(excl_sin_internet_hogar, 0.0)
                + coalesce(excl_sin_uso_cel, 0.0) + coalesce(excl_sin_uso_pc, 0.0)
                + coalesce(excl_sin_uso_internet, 0.0))
             / nullif(0 + CAST(excl_sin_pc IS NOT NULL AS INTEGER)
                        + CAST(excl_sin_internet_hogar IS NOT NULL AS INTEGER)
                        + CAST(excl_sin_uso_cel IS NOT NULL AS INTEGER)
                        + CAST(excl_sin_uso_pc IS NOT NULL AS INTEGER)
                        + CAST(excl_sin_uso_internet IS NOT NULL AS INTEGER), 0)
             AS idx_exclusion_digital
         FROM f1),
  f3 AS (SELECT *,
           CASE WHEN (SELECT count(NIVEL_ED) > count(*) * 0.5 FROM j)
                THEN coalesce(CAST(NIVEL_ED >= 4 AS DOUBLE), 0.0)
                ELSE CAST(coalesce(CH12 IN (4, 5, 6, 7, 8, 9), false) AS DOUBLE) END
             AS secundario_completo,
           CASE WHEN (SELECT count(NIVEL_ED) > count(*) * 0.5 FROM j)
                THEN coalesce(CAST(NIVEL_ED >= 6 AS DOUBLE), 0.0)
                ELSE CAST(coalesce(CH12 IN (6, 7, 8, 9), false) AS DOUBLE) END AS superior,
           coalesce(CAST(ESTADO = 1 AS DOUBLE), 0.0) AS ocupado,
           coalesce(CAST(ESTADO = 2 AS DOUBLE), 0.0) AS desocupado,
           CAST(coalesce(CAT_OCUP IN (3, 4), false) AS DOUBLE) AS asalariado_registrado,
           CAST(DECIFR AS DOUBLE) AS decil_ingreso,
           coalesce(CAST(DECIFR <= 2 AS DOUBLE), 0.0) AS quintil_bajo,
           coalesce(CAST(DECIFR >= 9 AS DOUBLE), 0.0) AS quintil_alto
         FROM f2),
  f4 AS (SELECT *, CASE WHEN ocupado = 1 THEN coalesce(CAST(PP07H = 2 AS DOUBLE), 0.0) END
                     AS informal_proxy FROM f3),
  f5 AS (SELECT *,
           coalesce(secundario_completo, 0.0) * 0.3 + coalesce(superior, 0.0) * 0.2
             + coalesce(ocupado, 0.0) * 0.2 + (1 - coalesce(informal_proxy, 1.0)) * 0.15
             + coalesce(quintil_alto, 0.0) * 0.15 AS score_movilidad_proxy,
           (1 - coalesce(secundario_completo, 0.0)) * 0.35 + coalesce(desocupado, 0.0) * 0.25
             + coalesce(quintil_bajo, 0.0) * 0.25 + coalesce(idx_exclusion_digital, 0.0) * 0.15
             AS vulnerabilidad_social
         FROM f4),
  frame AS (SELECT f5.* REPLACE (coalesce(PONDERA, 1.0) AS PONDERA),
           coalesce(CAST(idx_exclusion_digital >= (SELECT median(idx_exclusion_digital) FROM f5)
                    AS INTEGER), 0) AS exclusion_digital_alta,
           coalesce(CAST(vulnerabilidad_social >= (SELECT median(vulnerabilidad_social) FROM f5)
                    AS INTEGER), 0) AS vulnerabilidad_alta,
           coalesce(CAST(CH04 = 2 AS DOUBLE), 0.0) AS sexo_mujer, CH06 AS edad,
           coalesce(r.r_name, 'Otra') AS region_nombre,
           CASE WHEN f5.AGLOMERADO IS NULL THEN 'Sin dato'
                ELSE coalesce(n.n_name, 'Aglomerado ' || CAST(f5.AGLOMERADO AS VARCHAR)) END
             AS aglomerado_nombre
         FROM f5 LEFT JOIN region r ON f5.REGION = r.r_regionkey
                 LEFT JOIN nation n ON f5.AGLOMERADO = n.n_nationkey)"""

BASE_CTES = ",".join([TERRITORY_SQL, PERSONS_SQL, HOUSEHOLDS_SQL])


def with_base(body: str, *ctes: str) -> str:
    """Prefix with the bound person/household tables (plus extra CTEs)."""
    extra = "".join("," + c for c in ctes)
    return "WITH" + BASE_CTES + extra + "\n" + body


def with_frame(body: str, *ctes: str) -> str:
    extra = "".join("," + c for c in ctes)
    return "WITH" + BASE_CTES + "," + FRAME_SQL + extra + "\n" + body
