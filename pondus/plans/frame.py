"""Z5 analysis frame (generation 2): persons ≥ min age ⟕ households on the dwelling,
ICT exclusion flags and indices, education/employment proxies, scores.

Persons and households are joined once and materialised.  The two data-dependent decisions
(the 50 % education rule and the whole-frame medians) are scalar subqueries over that table,
so nothing is collected on the driver and the source files are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import coding as C
from ..functions.expr import flag, isin_safe, num, row_mean
from ..operators.joins import keep_first
from ..session import materialise

# The survey's column names that the frame reads.
PERSON_COLS = ["CODUSU", "AGLOMERADO", "REGION", "CH04", "CH06", "CH12", "NIVEL_ED", "ESTADO",
               "CAT_OCUP", "PP07H", "PONDERA", "ITF", "DECIFR", "IPCF"]
PERSON_ICT = ["V10_M", "V11_M", "V12_M", "V18_M", "V19_AM"]
HOUSEHOLD_COLS = ["CODUSU", "AGLOMERADO", "REGION", "ITF", "DECIFR", "IPCF", "PONDIH",
                  "V10", "V11", "V12", "V14", "V15"]
ACCESS_FLAGS = ["excl_sin_pc", "excl_sin_internet_hogar"]
USE_FLAGS = ["excl_sin_uso_cel", "excl_sin_uso_pc", "excl_sin_uso_internet"]


def _maybe(df: DataFrame, c: str):
    return num(c) if c in df.columns else F.lit(None).cast("double")


def analysis_frame(hogar: DataFrame, individual: DataFrame, *, min_age: int = 15,
                   area: int | None = None, include_ict: bool = True,
                   region_names: DataFrame | None = None, area_names: DataFrame | None = None,
                   household_key: list[str] | None = None,
                   wave_order: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """Build the person-level analysis frame.

    ``household_key`` defaults to the dwelling only (trap T5, reference behaviour);
    ``wave_order`` decides which household record is "first" (default: year, quarter), then
    the household's number and a hash of the row.
    ``region_names``/``area_names`` are (code, name) dimensions (trap T2: passed in).
    ``keep`` carries extra person columns (e.g. a wider unique key) into the frame.
    """
    hkey = household_key or ["CODUSU"]
    icols = [c for c in list(keep) + ["NRO_HOGAR", "COMPONENTE"] + PERSON_COLS
             + (PERSON_ICT if include_ict else []) if c in individual.columns]
    icols += [c for c in ("anio", "trimestre") if c in individual.columns and c not in icols]
    hcols = [c for c in HOUSEHOLD_COLS if c in hogar.columns]
    horder = [c for c in (wave_order or ["anio", "trimestre"]) + ["NRO_HOGAR"] if c in hogar.columns]

    i = individual.select(*icols).withColumn("CH06", num("CH06")).where(F.col("CH06") >= min_age)
    h = hogar.select(*hcols, *[c for c in horder if c not in hcols])
    if area is not None:
        i = i.where(num("AGLOMERADO") == area)
        h = h.join(i.select(*hkey).distinct(), hkey, "left_semi")  # J8
    h = keep_first(h, hkey, horder).select(*hcols)
    ict_h = [c for c in h.columns if c.startswith("V") and c not in hkey]
    h = h.withColumnsRenamed({c: f"H_{c}" for c in ict_h})
    clash = [c for c in h.columns if c in i.columns and c not in hkey]
    h = h.withColumnsRenamed({c: f"{c}_hog" for c in clash})
    df = materialise(i.join(h, hkey, "left"), "frame")

    cols = {}
    if include_ict:
        cols["excl_sin_pc"] = C.yes_no_exclusion(_maybe(df, "H_V10"))
        cols["excl_sin_internet_hogar"] = C.yes_no_exclusion(_maybe(df, "H_V11"))
        cols["excl_sin_uso_cel"] = C.usage_exclusion(_maybe(df, "V10_M"))
        cols["excl_sin_uso_pc"] = C.usage_exclusion(_maybe(df, "V11_M"))
        cols["excl_sin_uso_internet"] = C.usage_exclusion(_maybe(df, "V12_M"))
    else:
        for c in ACCESS_FLAGS + USE_FLAGS:
            cols[c] = F.lit(None).cast("double")
    df = df.withColumns(cols)
    if include_ict:
        df = df.withColumns({
            "idx_acceso": row_mean(ACCESS_FLAGS),
            "idx_uso": row_mean(USE_FLAGS),
            "idx_exclusion_digital": row_mean(ACCESS_FLAGS + USE_FLAGS)})
    else:
        df = df.withColumns({c: F.lit(None).cast("double")
                             for c in ("idx_acceso", "idx_uso", "idx_exclusion_digital")})

    nivel, ch12 = _maybe(df, "NIVEL_ED"), _maybe(df, "CH12")
    # P10's 50 % rule; a scalar subquery runs once per reference: bind it to a column once
    df = df.withColumn("_use_nivel", df.agg(F.count(nivel) > F.count(F.lit(1)) * 0.5).scalar())
    sec, sup = C.education_proxies(nivel, ch12, F.col("_use_nivel"))
    estado, cat, pp07h, dec = (_maybe(df, c) for c in ("ESTADO", "CAT_OCUP", "PP07H", "DECIFR"))
    df = df.withColumns({
        "secundario_completo": sec, "superior": sup,
        "ocupado": flag(estado == 1), "desocupado": flag(estado == 2),
        "asalariado_registrado": isin_safe(cat, [3, 4]).cast("double"),
        "decil_ingreso": dec,
        "quintil_bajo": flag(dec <= 2), "quintil_alto": flag(dec >= 9),
    })
    df = df.withColumn("informal_proxy", C.informal_proxy(F.col("ocupado"), pp07h))
    df = df.withColumn("score_movilidad_proxy", C.mobility_score(
        "secundario_completo", "superior", "ocupado", "informal_proxy", "quintil_alto"))
    df = df.withColumn("vulnerabilidad_social", C.vulnerability_score(
        "secundario_completo", "desocupado", "quintil_bajo", "idx_exclusion_digital"))
    # both whole-frame medians in one scalar subquery (one aggregate job, reused)
    df = df.drop("_use_nivel")
    df = df.withColumn("_meds", df.agg(F.struct(
        F.median("idx_exclusion_digital").alias("idx"),
        F.median("vulnerabilidad_social").alias("vul"))).scalar())
    if include_ict:
        df = df.withColumn("exclusion_digital_alta",
                           C.at_least("idx_exclusion_digital", F.col("_meds.idx")))
    else:
        df = df.withColumn("exclusion_digital_alta", F.lit(None).cast("int"))
    df = df.withColumn("vulnerabilidad_alta", C.at_least("vulnerabilidad_social", F.col("_meds.vul")))
    df = df.drop("_meds")
    df = df.withColumns({"sexo_mujer": flag(_maybe(df, "CH04") == 2), "edad": F.col("CH06")})
    if "REGION" in df.columns:
        rname = _name_lookup(df, "REGION", region_names, "region_nombre")
        df = rname.withColumn("region_nombre", F.coalesce("region_nombre", F.lit("Otra")))
    if "AGLOMERADO" in df.columns:
        df = _name_lookup(df, "AGLOMERADO", area_names, "aglomerado_nombre")
        code = num("AGLOMERADO").cast("long")
        df = df.withColumn("aglomerado_nombre", F.when(code.isNull(), F.lit("Sin dato"))
                           .otherwise(F.coalesce("aglomerado_nombre",
                                                 F.concat(F.lit("Aglomerado "), code.cast("string")))))
    return df.withColumn("PONDERA", F.coalesce(_maybe(df, "PONDERA"), F.lit(1.0)))


def _name_lookup(df: DataFrame, code_col: str, dim: DataFrame | None, out: str) -> DataFrame:
    if dim is None:
        from ..sources.dimensions import AREAS, REGIONS_GEN2
        from ..functions.expr import lookup
        book = REGIONS_GEN2 if code_col == "REGION" else AREAS
        return df.withColumn(out, lookup(book, num(code_col).cast("int")))
    d = dim.select(F.col("code").cast("long").alias("_code"), F.col("name").alias(out))
    # a code book read from storage: no hint, the planner broadcasts it only after
    # checking its size against spark.sql.autoBroadcastJoinThreshold
    return (df.withColumn("_code", num(code_col).cast("long"))
              .join(d, "_code", "left").drop("_code"))


def validate_microdata(df: DataFrame) -> DataFrame:
    """Rows, ages outside 0–100, negative household incomes, mean % null of the
    critical columns — one aggregate."""
    aggs = [F.count(F.lit(1)).alias("filas")]
    if "CH06" in df.columns:
        e = num("CH06")
        aggs.append(F.count(F.when((e < 0) | (e > 100), 1)).alias("edad_fuera_rango"))
    if "ITF" in df.columns:
        aggs.append(F.count(F.when(num("ITF") < 0, 1)).alias("itf_negativo"))
    crit = [c for c in ["CH12", "ESTADO", "V11_M", "V12_M"] if c in df.columns]
    if crit:
        nulls = sum((F.avg(F.col(c).isNull().cast("double")) for c in crit), F.lit(0.0))
        aggs.append((nulls / len(crit) * 100).alias("missing_critico_pct"))
    else:
        aggs.append(F.lit(0.0).alias("missing_critico_pct"))
    return df.agg(*aggs)


def age_status_subset(df: DataFrame, age: str = "CH06", status: str = "ESTADO",
                      low: int = 18, high: int = 65, statuses=(1, 2)) -> DataFrame:
    """persons of working age in the labour force (age band and status set;
    null-rejecting, as a boolean mask over coerced numbers)."""
    return df.where(num(age).between(low, high) & isin_safe(num(status), list(statuses)))
