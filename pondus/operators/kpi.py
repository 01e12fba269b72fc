"""Territorial KPIs.

``kpi_aggs`` is a list of aggregate expressions; it runs under any ``groupBy`` or
grouping sets, so the nation, every area and every year come out of **one** scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import coding as C
from ..functions.expr import count_where, num, wmean, wmean_where
from ..sources.dimensions import AREA_PREFIX, NATIONAL_ID
from .ordered import _as_list


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def kpi_aggs(df: DataFrame, *, include_ict: bool = True, weight: str = "PONDERA",
             gaps: bool = True) -> list[Column]:
    """G9 + G10: sample size and flags, weighted shares (×100), scores, informality among
    the employed, digital index; gender and decile gaps with their minimum counts."""
    w = F.col(weight) if weight in df.columns else F.lit(1.0)
    n = F.count(F.lit(1))
    out = [n.alias("n_individuos"), F.sum(w).alias("peso_expansion"),
           (n >= C.KPI_MIN_N).alias("muestra_suficiente"),
           (n < C.KPI_WARN_N).alias("muestra_advertencia")]
    for key, c, pct in (("pct_secundario_completo", "secundario_completo", True),
                        ("pct_superior", "superior", True), ("pct_ocupado", "ocupado", True),
                        ("score_movilidad_proxy", "score_movilidad_proxy", False),
                        ("vulnerabilidad_social", "vulnerabilidad_social", False)):
        if c in df.columns:
            m = wmean(c, w)
            out.append((100 * m if pct else m).alias(key))
    if _has(df, "ocupado", "informal_proxy"):
        out.append((100 * wmean_where("informal_proxy", w, F.col("ocupado") == 1))
                   .alias("pct_informal_ocupados"))
    if include_ict and _has(df, "idx_exclusion_digital", "exclusion_digital_alta"):
        out += [wmean("idx_exclusion_digital", w).alias("idx_exclusion_digital"),
                F.when(F.count("idx_exclusion_digital") > 0,
                       100 * wmean("exclusion_digital_alta", w)).alias("pct_exclusion_digital_alta")]
    if gaps:
        out += gap_aggs(df, include_ict=include_ict, weight=weight)
    return out


def gap_aggs(df: DataFrame, *, include_ict: bool = True, weight: str = "PONDERA") -> list[Column]:
    """Female − male employment (pp, both sides ≥ 30 rows); bottom − top decile
    share without home internet (pp, both sides ≥ 20 rows)."""
    w = F.col(weight) if weight in df.columns else F.lit(1.0)
    out = []
    if _has(df, "CH04", "ocupado"):
        sex = num("CH04")
        f, m = sex == 2, sex == 1
        gate = (count_where(f) >= C.GAP_MIN_SEX) & (count_where(m) >= C.GAP_MIN_SEX)
        out.append(F.when(gate, 100 * wmean_where("ocupado", w, f) - 100 * wmean_where("ocupado", w, m))
                   .alias("brecha_ocupacion_mujer_menos_hombre_pp"))
    if include_ict and _has(df, "excl_sin_internet_hogar", "decil_ingreso"):
        dec = num("decil_ingreso")
        lo, hi = dec <= 2, dec >= 9
        gate = (count_where(lo) >= C.GAP_MIN_DECILE) & (count_where(hi) >= C.GAP_MIN_DECILE)
        out.append(F.when(gate, 100 * wmean_where("excl_sin_internet_hogar", w, lo)
                          - 100 * wmean_where("excl_sin_internet_hogar", w, hi))
                   .alias("brecha_internet_q1_menos_q5_pp"))
    return out


def kpis(df: DataFrame, by=None, **kw) -> DataFrame:
    """G9 under an arbitrary grouping (``by=None`` → one row)."""
    return df.groupBy(*_as_list(by)).agg(*kpi_aggs(df, **kw))


def evolution(df: DataFrame, by=None, year: str = "anio", **kw) -> DataFrame:
    """KPI vector per year (and per ``by`` group)."""
    return df.groupBy(*_as_list(by), year).agg(*kpi_aggs(df, **kw))


def yearly_descriptives(df: DataFrame, year: str = "anio", weight: str = "PONDERA") -> DataFrame:
    """Per year n, weighted % secondary/higher/employed, % informal among employed,
    mobility, household income weighted mean (T8: a mean, named so), vulnerability,
    digital index and % high."""
    w = F.col(weight)
    aggs = [F.count(F.lit(1)).alias("n"),
            (100 * wmean("secundario_completo", w)).alias("pct_secundario_completo"),
            (100 * wmean("superior", w)).alias("pct_superior"),
            (100 * wmean("ocupado", w)).alias("pct_ocupado"),
            (100 * wmean_where("informal_proxy", w, F.col("ocupado") == 1)).alias("pct_informal"),
            wmean("score_movilidad_proxy", w).alias("score_movilidad_proxy"),
            wmean("ITF", w).alias("itf_media_ponderada"),
            wmean("vulnerabilidad_social", w).alias("vulnerabilidad_social")]
    if "idx_exclusion_digital" in df.columns:
        has = F.count("idx_exclusion_digital") > 0
        aggs += [F.when(has, 100 * wmean("exclusion_digital_alta", w)).alias("pct_exclusion_digital_alta"),
                 F.when(has, wmean("idx_exclusion_digital", w)).alias("idx_exclusion_digital")]
    return df.groupBy(year).agg(*aggs)


def catalog(df: DataFrame, territory_dim: DataFrame, area: str = "AGLOMERADO", **kw) -> DataFrame:
    """KPI row for the nation and for every area in one grouping-sets scan,
    right-joined to the territory dimension (areas without data keep a row)."""
    g = df.withColumn("_area", num(area).cast("int"))
    agg = g.groupingSets([["_area"], []], "_area").agg(
        F.grouping_id().alias("_gid"), *kpi_aggs(df, **kw))
    tid = F.when(F.col("_gid") == 1, F.lit(NATIONAL_ID)).otherwise(
        F.concat(F.lit(AREA_PREFIX), F.col("_area").cast("string")))
    agg = agg.withColumn("territorio_id", tid).drop("_area", "_gid")
    return territory_dim.join(agg, "territorio_id", "left")


def baseline_documents(df: DataFrame, territory_dim: DataFrame, area: str = "AGLOMERADO",
                       year: str = "anio", **kw) -> DataFrame:
    """One nested document per territory — KPI struct plus the yearly evolution as an
    array of structs sorted by year — from a single grouping-sets aggregation
    ((area, year), (area), (year), ())."""
    g = df.withColumn("_area", num(area).cast("int"))
    agg = g.groupingSets([["_area", year], ["_area"], [year], []], "_area", year).agg(
        F.grouping_id().alias("_gid"), *kpi_aggs(df, **kw))
    names = [c for c in agg.columns if c not in ("_area", year, "_gid")]
    # grouping_id bits: area is the high bit, year the low bit
    tid = F.when(F.col("_gid").isin(2, 3), F.lit(NATIONAL_ID)).otherwise(
        F.concat(F.lit(AREA_PREFIX), F.col("_area").cast("string")))
    agg = agg.withColumn("territorio_id", tid)
    kpi_struct = F.struct(*[F.col(n) for n in names])
    totals = agg.where(F.col("_gid").isin(1, 3)).select("territorio_id", kpi_struct.alias("kpis"))
    evo = (agg.where(F.col("_gid").isin(0, 2))
              .groupBy("territorio_id")
              .agg(F.sort_array(F.collect_list(F.struct(F.col(year).alias("anio"),
                                                       *[F.col(n) for n in names]))).alias("evolucion")))
    docs = totals.join(evo, "territorio_id", "left")
    return territory_dim.join(docs, "territorio_id", "left")


def map_metric(catalog_df: DataFrame, coords: DataFrame, metric: str) -> DataFrame:
    """(area, lat, lon, metric, n) for mapping — inner join with coordinates, nulls
    dropped."""
    return (catalog_df.join(coords, catalog_df.aglomerado_codigo == coords.code, "inner")
            .select(F.col("aglomerado_codigo"), "lat", "lon", "territorio_nombre",
                    F.col(metric).alias("valor"), F.col("n_individuos").alias("n"))
            .dropna(subset=["valor"]))


def ranking(catalog_df: DataFrame, metric: str) -> DataFrame:
    """O3: territories by a KPI, highest first, nulls dropped, with their rank (ties share it).
    The catalogue has one row per territory, so one ordered window is fine."""
    c = catalog_df.where(F.col("tipo") == "aglomerado").dropna(subset=[metric])
    return c.select("territorio_id", metric, F.rank().over(Window.orderBy(F.desc(metric))).alias("rank"))


def level_distribution(df: DataFrame, level: str = "NIVEL_EXCLUSION") -> DataFrame:
    """Rows and % of all rows per level, the null level among them."""
    agg = df.groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    return agg.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a level


def index_by(df: DataFrame, group: str, index: str = "INDICE_EXCLUSION") -> DataFrame:
    """Mean of the index and rows with one, by quintile, education or another group."""
    return df.groupBy(group).agg(F.avg(index).alias("indice_medio"), F.count(index).alias("n"))
