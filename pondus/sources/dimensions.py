"""Small fixed dimension tables (code books) as DataFrames.

These are literal, bounded tables (tens of rows); joining them with ``broadcast`` is
safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Urban-area code book (32 areas) and the two region code books
# (generation 1 and generation 2 disagree on several codes, trap T2).
# ---------------------------------------------------------------------------
AREAS = {
    2: "Gran La Plata", 3: "Bahía Blanca - Cerri", 4: "Gran Rosario", 5: "Gran Santa Fé",
    6: "Gran Paraná", 7: "Posadas", 8: "Gran Resistencia", 9: "Cdro. Rivadavia - R. Tilly",
    10: "Gran Mendoza", 12: "Corrientes", 13: "Gran Córdoba", 14: "Concordia",
    15: "Formosa", 17: "Neuquén - Plottier", 18: "S. del Estero - La Banda",
    19: "Jujuy - Palpalá", 20: "Río Gallegos", 22: "Gran Catamarca", 23: "Salta",
    25: "La Rioja", 26: "San Luis - El Chorrillo", 27: "Gran San Juan",
    29: "Gran Tucumán - T. Viejo", 30: "Santa Rosa - Toay", 31: "Ushuaia - Río Grande",
    32: "Ciudad de Bs. As.", 33: "Partidos GBA", 34: "Mar del Plata - Batán",
    36: "Río Cuarto", 38: "San Nicolás - Villa Const.", 91: "Rawson - Trelew",
    93: "Viedma - Carmen de Patagones",
}
REGIONS_GEN2 = {1: "GBA", 40: "Pampeana", 41: "Noreste", 42: "Noroeste", 43: "Cuyo",
                44: "Patagonia"}
# File-type fingerprints (required columns, typical columns, column
# pattern, minimum typical hits).
FINGERPRINTS = {
    "hogar": (["CODUSU", "NRO_HOGAR"], ["IV1", "IV2", "IX_TOT", "ITF", "IPCF", "II7", "PONDIH"],
              None, 3),
    "individuo": (["CODUSU", "NRO_HOGAR", "COMPONENTE"],
                  ["CH04", "CH06", "NIVEL_ED", "ESTADO", "CAT_OCUP", "P21", "PONDII"], None, 3),
    "tic_hogar": (["CODUSU", "NRO_HOGAR"], ["IH_II_01", "IH_II_02", "IH_II_03", "IH_II_04"],
                  "^IH_", 1),
    "tic_individual": (["CODUSU", "NRO_HOGAR", "COMPONENTE"], ["IP_III_04", "IP_III_05", "IP_III_06"],
                       "^IP_", 1),
}
NATIONAL_ID = "nacional"
AREA_PREFIX = "aglomerado_"


def areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(AREAS.items()), "code int, name string")


def regions_gen2(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(REGIONS_GEN2.items()), "code int, name string")


def fingerprint_table(spark: SparkSession) -> DataFrame:
    """(tipo, column, role) rows plus (tipo, pattern, minimum) as columns."""
    rows = []
    for tipo, (req, typ, pat, mn) in FINGERPRINTS.items():
        rows += [(tipo, c, "required", pat, mn) for c in req]
        rows += [(tipo, c, "typical", pat, mn) for c in typ]
    return spark.createDataFrame(rows, "tipo string, column string, role string, "
                                       "pattern string, minimum int")


def territories(area_dim: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """Territory dimension — the nation plus one row per area, ordered by code."""
    from pyspark.sql import functions as F
    nat = area_dim.sparkSession.createDataFrame(
        [(NATIONAL_ID, "Total nacional", None, "nacional")],
        "territorio_id string, territorio_nombre string, aglomerado_codigo int, tipo string")
    per_area = area_dim.select(
        F.concat(F.lit(AREA_PREFIX), F.col(code).cast("string")).alias("territorio_id"),
        F.col(name).alias("territorio_nombre"),
        F.col(code).cast("int").alias("aglomerado_codigo"),
        F.lit("aglomerado").alias("tipo"))
    return nat.unionByName(per_area)


def of_territory(df: DataFrame, territory_id: str, territory_dim: DataFrame, column: str = "AGLOMERADO") -> DataFrame:
    """the rows of one territory.  The nation and ids that name no area keep every row;
    an area that the dimension doesn't know, or a table without the column, keeps none."""
    from pyspark.sql import functions as F
    if not territory_id.startswith(AREA_PREFIX):
        return df
    if column not in df.columns:
        return df.limit(0)
    code = territory_dim.where(F.col("territorio_id") == territory_id).select(F.col("aglomerado_codigo").cast("double").alias("_code"))
    return df.join(code, F.col(column).try_cast("double") == F.col("_code"), "left_semi")


def search_territories(territory_dim: DataFrame, query: str) -> DataFrame:
    """case-insensitive text search on the territory name."""
    from pyspark.sql import functions as F
    return territory_dim.where(F.lower(F.col("territorio_nombre")).contains(query.strip().lower()))
