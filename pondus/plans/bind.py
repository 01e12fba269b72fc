"""Binding of survey concepts to the TPC-H-like test tables.

Nothing survey-shaped ships with the test data, so the survey files are *derived* by
Spark from the given tables (their size grows with them):

* person file   = lineitem (4-column key) enriched with its order's year and its
                  customer's nation (area) and region;
* household file = orders (dwelling = order key) with the same territory columns;
* weight = ``l_quantity``, income = ``l_extendedprice``; codes are simple rules over the
  line and order attributes (documented next to each column below).

The same derivation is written once more in SQL (``PERSONS_SQL``/``HOUSEHOLDS_SQL``) for
the DuckDB oracle; both must stay identical in meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PERSON_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order key → (year, area = customer nation, region) — order-sized, not broadcast."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
             .select("o_orderkey", F.year("o_orderdate").alias("anio"),
                     F.col("c_nationkey").alias("AGLOMERADO"),
                     F.col("n_regionkey").alias("REGION")))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    t = _territory(spark, sf_dir)
    d100 = lambda c: F.round(F.col(c) * 100).cast("int")
    p = li.join(t, li.l_orderkey == t.o_orderkey).select(
        *PERSON_KEY,
        F.col("l_orderkey").alias("CODUSU"),
        F.lit(1).alias("NRO_HOGAR"),
        F.col("l_linenumber").alias("COMPONENTE"),
        "anio", F.lit(4).alias("trimestre"), "AGLOMERADO", "REGION",
        # sex: 2 = female for open lines
        F.when(F.col("l_linestatus") == "O", 2).otherwise(1).alias("CH04"),
        # age 10..59
        (F.col("l_quantity").cast("int") + 9).alias("CH06"),
        F.col("l_linenumber").alias("NIVEL_ED"),
        F.lit(None).cast("int").alias("CH12"),
        # activity: N → employed, R → unemployed, A → inactive
        F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2)
         .otherwise(3).alias("ESTADO"),
        F.when(F.col("l_discount") >= 0.05, 3).otherwise(1).alias("CAT_OCUP"),
        F.when(F.col("l_tax") >= 0.04, 2).otherwise(1).alias("PP07H"),
        F.col("l_quantity").alias("PONDERA"),
        d100("l_discount").alias("DECIFR"),
        F.col("l_extendedprice").alias("IPCF"),
        (d100("l_tax") - 1).alias("V10_M"),
        (d100("l_discount") - 1).alias("V11_M"),
        (F.col("l_linenumber") - 2).alias("V12_M"),
        # generation-1 ICT use (1 yes, 2 no)
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("IP_III_04"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("IP_III_05"),
        F.when(F.col("l_discount") == 0, 2).otherwise(1).alias("IP_III_06"),
    )
    return p


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    t = _territory(spark, sf_dir).withColumnRenamed("o_orderkey", "_k")
    return o.join(t, o.o_orderkey == t._k).select(
        F.col("o_orderkey").alias("CODUSU"), F.lit(1).alias("NRO_HOGAR"),
        "anio", F.lit(4).alias("trimestre"), "AGLOMERADO", "REGION",
        F.col("o_totalprice").alias("ITF"),
        F.lit(None).cast("int").alias("DECIFR"),
        # PC at home: 1 no, 2 yes, 9 no answer
        F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1)
         .otherwise(9).alias("V10"),
        # internet at home: 1 no for urgent/high priority, else 2 yes
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(2).alias("V11"),
        # generation-1 ICT access (1 yes, 2 no, 9 no answer)
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
         .otherwise(9).alias("IH_II_03"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 2).otherwise(1).alias("IH_II_04"),
    )


def area_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))


def region_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("code"), F.col("r_name").alias("name"))


# ---------------------------------------------------------------------------
# The same binding in SQL (DuckDB oracle)
# ---------------------------------------------------------------------------
TERRITORY_SQL = """
  territory AS (
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS anio,
           c_nationkey AS AGLOMERADO, n_regionkey AS REGION
    FROM orders JOIN customer ON o_custkey = c_custkey
                JOIN nation ON c_nationkey = n_nationkey)"""

PERSONS_SQL = """
  persons AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_orderkey AS CODUSU, 1 AS NRO_HOGAR, l_linenumber AS COMPONENTE,
           anio, 4 AS trimestre, AGLOMERADO, REGION,
           CASE WHEN l_linestatus = 'O' THEN 2 ELSE 1 END AS CH04,
           CAST(l_quantity AS INTEGER) + 9 AS CH06,
           l_linenumber AS NIVEL_ED,
           CAST(NULL AS INTEGER) AS CH12,
           CASE WHEN l_returnflag = 'N' THEN 1 WHEN l_returnflag = 'R' THEN 2 ELSE 3 END AS ESTADO,
           CASE WHEN l_discount >= 0.05 THEN 3 ELSE 1 END AS CAT_OCUP,
           CASE WHEN l_tax >= 0.04 THEN 2 ELSE 1 END AS PP07H,
           l_quantity AS PONDERA,
           CAST(round(l_discount * 100) AS INTEGER) AS DECIFR,
           l_extendedprice AS IPCF,
           CAST(round(l_tax * 100) AS INTEGER) - 1 AS V10_M,
           CAST(round(l_discount * 100) AS INTEGER) - 1 AS V11_M,
           l_linenumber - 2 AS V12_M,
           CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS IP_III_04,
           CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS IP_III_05,
           CASE WHEN l_discount = 0 THEN 2 ELSE 1 END AS IP_III_06
    FROM lineitem JOIN territory ON l_orderkey = o_orderkey)"""

HOUSEHOLDS_SQL = """
  households AS (
    SELECT o.o_orderkey AS CODUSU, 1 AS NRO_HOGAR, anio, 4 AS trimestre, AGLOMERADO, REGION,
           o_totalprice AS ITF, CAST(NULL AS INTEGER) AS DECIFR,
           CASE WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 9 END AS V10,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 2 END AS V11,
           CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 9 END AS IH_II_03,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2 ELSE 1 END AS IH_II_04
    FROM orders o JOIN territory t ON o.o_orderkey = t.o_orderkey)"""
