"""Registered queries: correlation matrices by rank, exact percentiles, model preparation on
held-out rows, levers that have nothing to do, the scenario with predicted rates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import corr as R
from ..operators import joins as J
from ..operators import ordered as O
from ..operators import scenario as L
from ..sources.dimensions import AREA_PREFIX, NATIONAL_ID, of_territory
from . import bind, model_jobs
from .sql import with_frame
from .testbed import KEY, KEY_SQL, frame, lineitem, register, territory_dim

_RANKED = ["l_quantity", "l_tax", "disc_nz"]
_RANKED_SQL = "SELECT l_quantity, l_tax, nullif(l_discount, 0) AS disc_nz FROM lineitem"


def _ranked(spark, sf):
    return lineitem(spark, sf).select("l_quantity", "l_tax", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("disc_nz"))


def _kendall_sql(a: str, b: str) -> str:
    cells = f"(SELECT {a}::DOUBLE AS x, {b}::DOUBLE AS y, count(*)::DOUBLE AS w FROM src WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)"
    ties = lambda c: f"(SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(w) AS t FROM {cells} GROUP BY {c}))"
    return f"""SELECT '{a}' AS var1, '{b}' AS var2,
      (SELECT sum(sign(p.x - q.x) * sign(p.y - q.y) * p.w * q.w) / 2 FROM {cells} p, {cells} q)
      / sqrt((n * (n - 1) / 2 - {ties("x")}) * (n * (n - 1) / 2 - {ties("y")})) AS r FROM (SELECT sum(w) AS n FROM {cells})"""


@register("kendall_matrix", f"""
WITH src AS ({_RANKED_SQL}), p AS ({" UNION ALL ".join(_kendall_sql(a, b) for a, b in combinations(_RANKED, 2))})
SELECT var1, var2, r FROM p UNION ALL SELECT var2 AS var1, var1 AS var2, r FROM p
UNION ALL {" UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in _RANKED)}""")
def q_kendall_matrix(spark, sf):
    """τ-b of every pair on its own complete rows, as a square."""
    return R.matrix(R.kendall_long(_ranked(spark, sf), _RANKED), _RANKED)


@register("corr_pairs_kendall", f"""
WITH src AS (SELECT * FROM ({_RANKED_SQL}) WHERE disc_nz IS NOT NULL)
{" UNION ALL ".join(_kendall_sql(a, b) for a, b in combinations(_RANKED, 2))}""")
def q_corr_pairs_kendall(spark, sf):
    """R4 by Kendall on the listwise-complete rows."""
    return R.corr_pairs(_ranked(spark, sf), _RANKED, "kendall").select("var1", "var2", "r")


_SPEARMAN = ["l_extendedprice", "l_quantity", "disc_nz"]


def _spearman_sql(a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return (f"SELECT '{a}' AS var1, '{b}' AS var2, corr(x, y) AS r, count(*)::BIGINT AS n FROM "
            f"(SELECT {rank(a)} AS x, {rank(b)} AS y FROM src WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@register("spearman_pairwise", f"""
WITH src AS (SELECT l_extendedprice, l_quantity, nullif(l_discount, 0) AS disc_nz FROM lineitem)
{" UNION ALL ".join(_spearman_sql(a, b) for a, b in combinations(_SPEARMAN, 2))}""")
def q_spearman_pairwise(spark, sf):
    """R2 with nulls: ranks within each pair's complete rows."""
    d = lineitem(spark, sf).select("l_extendedprice", "l_quantity", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("disc_nz"))
    return R.spearman_long(d, _SPEARMAN, listwise=False)


@register("exact_percentiles", """
SELECT l_returnflag, quantile_cont(l_extendedprice, 0.02) AS q2, quantile_cont(l_extendedprice, 0.5) AS q50,
       quantile_cont(l_extendedprice, 0.98) AS q98 FROM lineitem GROUP BY l_returnflag""")
def q_exact_percentiles(spark, sf):
    """D9 by group, through the bucketed kernel."""
    return O.unweighted_quantiles(lineitem(spark, sf), "l_extendedprice", [0.02, 0.5, 0.98], "l_returnflag")


@register("percentile_clip", """
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem)
SELECT count(*)::BIGINT AS n, sum(least(greatest(l_extendedprice, lo), hi)) AS total, min(least(greatest(l_extendedprice, lo), hi)) AS low,
       max(least(greatest(l_extendedprice, lo), hi)) AS high FROM lineitem, b""")
def q_percentile_clip(spark, sf):
    """Every line clipped to the 2nd and 98th percentiles."""
    c = F.col("l_extendedprice")
    return O.clip_to_percentiles(lineitem(spark, sf), "l_extendedprice").agg(
        F.count(F.lit(1)).alias("n"), F.sum(c).alias("total"), F.min(c).alias("low"), F.max(c).alias("high"))


@register("empty_gini", "SELECT NULL::DOUBLE AS gini, NULL::BIGINT AS n FROM lineitem WHERE l_quantity < 0 HAVING count(*) = 0")
def q_empty_gini(spark, sf):
    """The ordered kernel where a filter leaves nothing."""
    return O.gini(lineitem(spark, sf).where("l_quantity < 0"), "l_extendedprice").select("gini", "n")


@register("first_household", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_orderkey) AS rn FROM orders)
WHERE rn = 1""")
def q_first_household(spark, sf):
    """Several households (orders) of one dwelling (customer) and wave (year): the
    household's number decides, whatever the order of the rows."""
    o = bind.table(spark, sf, "orders").withColumn("anio", F.year("o_orderdate"))
    return J.keep_first(o, ["o_custkey"], ["anio", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


_HASH = ("substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), '42')), 1, 8) "
         f"< '{format(int(0.8 * 16 ** 8), '08x')}'")


def _prepared(spark, sf):
    d = lineitem(spark, sf).select(*KEY, "l_quantity", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("disc"), "l_linestatus",
                                   F.lit(1).alias("fija"), (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_tax")
    return model_jobs.prepare(d, ["l_quantity", "disc", "l_linestatus", "fija"], "y", KEY, weight="l_tax")


@register("design_matrix", f"""
WITH m AS (SELECT median(nullif(l_discount, 0)) AS med FROM lineitem),
d AS (SELECT CASE WHEN {_HASH} THEN 'train' ELSE 'test' END AS split, l_quantity, coalesce(nullif(l_discount, 0), med) AS disc,
      CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS o, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_tax FROM lineitem, m)
SELECT split, count(*)::BIGINT AS n, sum(l_quantity) AS quantity, sum(disc) AS disc, sum(o)::DOUBLE AS linestatus_o, sum(y)::BIGINT AS positives,
       sum(l_tax) AS weight FROM d GROUP BY split""")
def q_design_matrix(spark, sf):
    """M1: median imputation, one-hot, split, weights; the constant predictor is left out."""
    p = _prepared(spark, sf)
    assert p.left_out == ["fija"] and p.predictors == ["l_quantity", "disc", "l_linestatus_O"]
    return p.frame.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.sum("disc").alias("disc"), F.sum("l_linestatus_O").alias("linestatus_o"),
        F.sum("y").alias("positives"), F.sum("_weight").alias("weight"))


@register("held_out_confusion", f"""
SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS real, CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS pred, count(*)::BIGINT AS n
FROM lineitem WHERE NOT ({_HASH}) GROUP BY 1, 2""")
def q_held_out_confusion(spark, sf):
    """M10 on the test rows, with a fixed score in the model's place."""
    test = _prepared(spark, sf).frame.where("split = 'test'").select(
        "y", (F.col("l_quantity") >= 25).cast("int").alias("prediction"), F.col("l_quantity").alias("score"))
    return model_jobs.evaluated(test, "y")["confusion"]


@register("territory_rows", with_frame("""
SELECT count(*) FILTER (WHERE AGLOMERADO = 3)::BIGINT AS area, count(*)::BIGINT AS nation, 0::BIGINT AS unknown FROM frame"""))
def q_territory_rows(spark, sf):
    """rows of one area, of the nation, and of an area that doesn't exist."""
    f, dim = frame(spark, sf), territory_dim(spark, sf)
    n = [of_territory(f, t, dim).agg(F.count(F.lit(1))).scalar() for t in (f"{AREA_PREFIX}3", NATIONAL_ID, f"{AREA_PREFIX}99999")]
    return spark.range(1).select(n[0].alias("area"), n[1].alias("nation"), n[2].alias("unknown"))


@register("logistic_job", None)
def q_logistic_job(spark, sf):
    """M4 end to end: the report on held-out rows."""
    return model_jobs.fit_and_evaluate(_prepared(spark, sf), "logistic")["report"]


@register("lever_met", """
SELECT l_returnflag, count(*)::BIGINT AS n, 0::BIGINT AS flipped FROM lineitem GROUP BY l_returnflag""")
def q_lever_met(spark, sf):
    """L2 with targets that are met everywhere: the frame comes back unchanged."""
    d = lineitem(spark, sf).withColumn("bad", (F.col("l_quantity") > 10).cast("double"))
    targets = d.select("l_returnflag").distinct().withColumn("target", F.lit(0.0))
    out = L.flip_to_target(d, F.lit(True), "bad", targets, KEY, by="l_returnflag", weight="l_quantity")
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if("_flipped").alias("flipped"))


@register("scenario_predicted", None)
def q_scenario_predicted(spark, sf):
    """Indicators and predicted exclusion by area, before and after the levers."""
    f = frame(spark, sf).withColumn("AGLOMERADO", F.col("AGLOMERADO").cast("int"))
    targets = f.select("AGLOMERADO").distinct().withColumns({
        "internet_quintil_i": F.lit(80.0), "pct_superior": F.lit(40.0), "pct_empleo_formal": F.lit(70.0)})
    _, table = L.scenario_run(f, targets, KEY, "AGLOMERADO", ["pct_superior", "score_movilidad_proxy", "vulnerabilidad_social"],
                              ["superior", "ocupado", "secundario_completo", "edad"])
    return table
