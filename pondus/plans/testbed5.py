"""Registered queries with oracles for readers, sinks, schema, cleaning and frame helpers, for
groups with a null key, for scenarios and for the cluster matrix (see :mod:`pondus.plans.testbed`).

Files that a reader or a sink needs are written from the given tables into the application's
scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import coding as C
from ..functions import labels as LB
from ..functions.expr import isin_safe, num
from ..operators import clusters as CL
from ..operators import joins as J
from ..operators import kpi as K
from ..operators import ordered as O
from ..operators import schema as S
from ..operators import scenario as L
from ..operators import weighted as G
from ..session import scratch_path
from ..sources import dimensions as D
from ..sources import readers as RD
from ..sources import sinks as SK
from . import bind
from .clean import apply_labels, normalize_types
from .frame import age_status_subset, analysis_frame
from .sql import with_base, with_frame
from .testbed import KEY, REGISTRY, frame, lineitem, register, territory_dim


def orders(spark, sf) -> DataFrame:
    return bind.table(spark, sf, "orders")


# ---------------------------------------------------------------------------
# Readers (A1, A2, A3, A4, A8–A12, A14, S1)
# ---------------------------------------------------------------------------

@register("read_by_suffix", """
SELECT l_returnflag AS "L_RETURNFLAG", count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1""")
def q_read_by_suffix(spark, sf):
    """Dispatch by suffix, names upper-cased."""
    return RD.read_any(spark, f"{sf}/lineitem.parquet").groupBy("L_RETURNFLAG").agg(F.count(F.lit(1)).alias("n"), F.sum("L_QUANTITY").alias("quantity"))


@register("read_preview", "SELECT least(100, count(*)) AS n FROM lineitem")
def q_read_preview(spark, sf):
    """A preview's number of rows."""
    return RD.read_any(spark, f"{sf}/lineitem.parquet", nrows=100).agg(F.count(F.lit(1)).alias("n"))


@register("delimited_round_trip", """
SELECT o_orderstatus AS "O_ORDERSTATUS", count(*) AS n, sum(o_totalprice) AS total, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1""")
def q_delimited_round_trip(spark, sf):
    """B6, then A2/A4: written as ;-separated text with a Latin-1 letter, read with the separator
    and the encoding found."""
    path = scratch_path(spark, "delimited")
    d = orders(spark, sf).select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit("ñandú").alias("nota"))
    d.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    got = RD.read_delimited(spark, path).where("NOTA = 'ñandú'")
    return got.groupBy("O_ORDERSTATUS").agg(F.count(F.lit(1)).alias("n"), F.sum("O_TOTALPRICE").alias("total"), F.sum("O_ORDERKEY").alias("keys"))


@register("csv_sink", "SELECT count(*) AS n, sum(p_size)::BIGINT AS sizes, count(DISTINCT p_brand) AS brands FROM part")
def q_csv_sink(spark, sf):
    """A result table as CSV with a header, read back."""
    path = scratch_path(spark, "csv")
    SK.write_csv(bind.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), path)
    return RD.read_delimited(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum("P_SIZE").cast("long").alias("sizes"), F.count_distinct("P_BRAND").alias("brands"))


@register("bad_lines", """
SELECT count(*) AS good, sum(o_orderkey)::BIGINT AS keys, (SELECT count(*) FROM orders) AS lineas, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS malformadas
FROM orders WHERE o_orderkey % 5 <> 0""")
def q_bad_lines(spark, sf):
    """A3: lines with a field too many are dropped, or kept and counted."""
    path = scratch_path(spark, "lines")
    k = F.col("o_orderkey")
    line = F.concat_ws(";", k.cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.when(k % 5 == 0, F.lit("extra")))
    header = spark.range(1).select(F.lit("CODIGO;ESTADO;PRIORIDAD").alias("value"))
    header.unionByName(orders(spark, sf).select(line.alias("value"))).coalesce(1).write.text(path)
    good = RD.read_delimited(spark, path).agg(F.count(F.lit(1)).alias("good"), F.sum("CODIGO").cast("long").alias("keys"))
    report = RD.corrupt_lines(RD.read_delimited(spark, path, bad_lines="permissive"))
    return good.withColumns({c: report.select(c).scalar() for c in ("lineas", "malformadas")})


def _book(spark, sf, value) -> str:
    path = scratch_path(spark, "book")
    n = bind.table(spark, sf, "nation")
    body = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("key"), value.alias("value")))))
    n.agg(F.to_json(F.struct(body.alias("libro"))).alias("value")).write.text(path)  # one document of the nations
    return path


@register("area_book", "SELECT CAST(n_nationkey AS INTEGER) AS code, n_name AS name FROM nation")
def q_area_book(spark, sf):
    """A10: a JSON code book of areas as a dimension."""
    return RD.area_book(spark, _book(spark, sf, F.col("n_name")), "libro")


_LAT, _LON = "n_nationkey * 1.5 - 40", "n_regionkey * 2.0 - 60"


def _coordinates(spark, sf) -> DataFrame:
    value = F.struct(F.expr(_LAT).alias("lat"), F.expr(_LON).alias("lon"), F.col("n_name").alias("nombre"))
    return RD.coordinates_book(spark, _book(spark, sf, value), "libro")


@register("coordinates_book", f"SELECT CAST(n_nationkey AS INTEGER) AS code, CAST({_LAT} AS DOUBLE) AS lat, CAST({_LON} AS DOUBLE) AS lon, n_name AS name FROM nation")
def q_coordinates_book(spark, sf):
    return _coordinates(spark, sf)


@register("code_book_labels", """
SELECT 'persona' AS section, 'SEGMENTO' AS variable, c_mktsegment AS code, 'Etiqueta ' || c_mktsegment AS label, count(*) AS n FROM customer GROUP BY c_mktsegment""")
def q_code_book(spark, sf):
    """A10/S3: a variable's code book, its labels and its description."""
    path = scratch_path(spark, "dictionary")
    c = bind.table(spark, sf, "customer")
    book = F.map_from_entries(F.sort_array(F.collect_set(F.struct("c_mktsegment", F.concat(F.lit("Etiqueta "), F.col("c_mktsegment"))))))
    meta = F.struct(F.lit("segmento del cliente").alias("desc"), F.lit("cat").alias("tipo"), book.alias("etiquetas"))
    c.agg(F.to_json(F.struct(F.struct(meta.alias("segmento")).alias("persona"))).alias("value")).write.text(path)
    variables, labels = RD.code_book(spark, path)
    described = S.describe_column(variables, " segmento ").select("section", "variable")
    return (described.join(labels, "variable").join(c.groupBy(F.col("c_mktsegment").alias("code")).agg(F.count(F.lit(1)).alias("n")), "code")
            .select("section", "variable", "code", "label", "n"))


@register("panel_of_waves", with_base("""
SELECT anio, 4 AS trimestre, count(*) AS n, sum(CASE WHEN anio = 1996 THEN PONDERA END) AS peso_1996 FROM persons WHERE anio IN (1995, 1996, 1997) GROUP BY anio"""))
def q_panel_of_waves(spark, sf):
    """A table per wave, tagged and aligned by name."""
    p = bind.persons(spark, sf)
    waves = [(y, 4, p.where(F.col("anio") == y).select(*(["CH06"] if y != 1996 else ["CH06", "PONDERA"]))) for y in (1995, 1996, 1997)]
    return RD.panel(waves).groupBy("anio", "trimestre").agg(F.count(F.lit(1)).alias("n"), F.sum("PONDERA").alias("peso_1996"))


@register("cached_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def q_cached_table(spark, sf):
    """Built over what a failed write left, then read."""
    path = scratch_path(spark, "cache")
    orders(spark, sf).limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    for _ in range(2):
        got = RD.cached_table(spark, path, lambda: orders(spark, sf).select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])
    return got.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("year_range", "SELECT CAST(year(o_orderdate) AS INTEGER) AS anio, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1993, 1994, 1995, 1997) GROUP BY 1")
def q_year_range(spark, sf):
    """The years of an expression as a filter."""
    o = orders(spark, sf).select(F.year("o_orderdate").alias("anio"))
    return o.where(F.col("anio").isin(RD.year_range("1993-1995,1997"))).groupBy("anio").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Sinks (B1–B5, B8–B11)
# ---------------------------------------------------------------------------

@register("parquet_sink", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS anio, count(*) AS n, sum(length('["' || o_orderstatus || '","' || o_orderpriority || '"]'))::BIGINT AS chars FROM orders GROUP BY 1""")
def q_parquet_sink(spark, sf):
    """B1/B2: a codec, arrays as text, one folder a year; rewriting a year leaves the others."""
    path = scratch_path(spark, "panel")
    o = orders(spark, sf).select(F.year("o_orderdate").alias("anio"), F.array("o_orderstatus", "o_orderpriority").alias("lista"))
    SK.write_parquet(o, path, "gzip", ["anio"])
    SK.write_parquet(o.where("anio = 1995"), path, "gzip", ["anio"])
    return spark.read.parquet(path).groupBy("anio").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("lista")).alias("chars"))


_BASELINE = with_frame("""
SELECT t.id AS territorio_id, k.n AS n_individuos, k.pct AS pct_superior, k.anios FROM (
  SELECT 'nacional' AS id UNION ALL SELECT 'aglomerado_' || CAST(n_nationkey AS VARCHAR) FROM nation) t LEFT JOIN (
  SELECT coalesce('aglomerado_' || CAST(CAST(AGLOMERADO AS INTEGER) AS VARCHAR), 'nacional') AS id, count(*) AS n, 100 * sum(superior * PONDERA) / sum(PONDERA) AS pct,
         CAST(count(DISTINCT anio) AS INTEGER) AS anios FROM frame GROUP BY GROUPING SETS ((AGLOMERADO), ())) k ON t.id = k.id""")


def _baselines(spark, sf) -> DataFrame:
    path = scratch_path(spark, "baselines")
    SK.write_json(K.baseline_documents(frame(spark, sf), territory_dim(spark, sf)), path, ["tipo"])
    return spark.read.json(path)


@register("baseline_json", _BASELINE)
def q_baseline_json(spark, sf):
    """Documents of all territories written as JSON and read back."""
    return _baselines(spark, sf).select("territorio_id", F.col("kpis.n_individuos").alias("n_individuos"), F.col("kpis.pct_superior").alias("pct_superior"),
                                        F.when(F.col("evolucion").isNotNull(), F.size("evolucion")).alias("anios"))


@register("baseline_flat", _BASELINE.replace(", k.anios FROM", " FROM"))
def q_baseline_flat(spark, sf):
    """The documents as flat rows."""
    docs = K.baseline_documents(frame(spark, sf), territory_dim(spark, sf))
    return SK.flatten_baseline(docs).select("territorio_id", "n_individuos", "pct_superior")


@register("scenario_document", "SELECT l_returnflag AS clase, count(*) AS n, 'abc' AS corrida, 2 AS version FROM lineitem GROUP BY 1")
def q_scenario_document(spark, sf):
    """One JSON document a row with its metadata, written and read back."""
    path = scratch_path(spark, "documents")
    d = lineitem(spark, sf).groupBy(F.col("l_returnflag").alias("clase")).agg(F.count(F.lit(1)).alias("n"))
    SK.with_meta(d, {"corrida": "abc", "version": 2}).write.text(path)
    return spark.read.json(path).select("clase", "n", F.col("meta.corrida").alias("corrida"), F.col("meta.version").cast("int").alias("version"))


@register("readable_headers", """SELECT l_linestatus AS "Sexo (CH04)", count(*) AS n FROM lineitem GROUP BY 1""")
def q_readable_headers(spark, sf):
    """Codes as readable headers."""
    d = lineitem(spark, sf).groupBy(F.col("l_linestatus").alias("CH04")).agg(F.count(F.lit(1)).alias("n"))
    return SK.readable_headers(d, {"CH04": "Sexo"})


@register("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def q_top_orders(spark, sf):
    """B10/O4."""
    return SK.top_k(orders(spark, sf).select("o_orderkey", "o_totalprice"), "o_totalprice", 10, tiebreak=["o_orderkey"])


@register("meta_rows", "SELECT 'filas' AS clave, CAST(count(*) AS VARCHAR) AS valor FROM orders UNION ALL SELECT 'periodo', min(year(o_orderdate)) || '-' || max(year(o_orderdate)) FROM orders")
def q_meta_rows(spark, sf):
    """A run's metadata."""
    r = orders(spark, sf).agg(F.count(F.lit(1)), F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    return SK.meta_rows(spark, {"filas": r[0], "periodo": RD.period_text([r[1], r[2]])})


# ---------------------------------------------------------------------------
# Schema, weights, cleaning, subsets
# ---------------------------------------------------------------------------
_ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": None, "o_orderpriority": "string"}


@register("table_summary", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS columna, (SELECT count(*) FROM orders) AS filas, {len(_ORDERS) - 1 + 1} AS columnas, (SELECT count(*) FROM orders WHERE x IS NULL) AS nulos FROM (SELECT 1 AS x)".replace(
        "WHERE x IS NULL", f"WHERE {'nullif(o_orderpriority, ' + chr(39) + '2-HIGH' + chr(39) + ')' if c == 'o_orderpriority' else c} IS NULL") for c in _ORDERS))
def q_table_summary(spark, sf):
    """Rows, columns and nulls of every column."""
    d = orders(spark, sf).select(*_ORDERS).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("2-HIGH")))
    return S.table_summary(d).drop("tipo")


@register("feature_split", """SELECT 'l_quantity' AS columna, 'numerica' AS clase, sum(l_quantity) AS total FROM lineitem
UNION ALL SELECT 'l_tax', 'numerica', sum(l_tax) FROM lineitem UNION ALL SELECT 'l_returnflag', 'nominal', NULL UNION ALL SELECT 'l_linenumber', 'nominal', NULL""")
def q_feature_split(spark, sf):
    """Features that are there and not empty, numeric or one-hot, and totals of the numeric."""
    d = lineitem(spark, sf).withColumn("vacia", F.lit(None).cast("double"))
    there = S.available_features(d, ["l_quantity", "l_tax", "vacia", "l_returnflag", "l_linenumber", "ausente"])
    numeric, nominal = S.split_feature_types(d, there, nominal=["l_linenumber"])
    pairs = [F.struct(F.lit(c).alias("columna"), F.lit("numerica").alias("clase"), F.sum(c).alias("total")) for c in numeric]
    pairs += [F.struct(F.lit(c).alias("columna"), F.lit("nominal").alias("clase"), F.lit(None).cast("double").alias("total")) for c in nominal]
    return d.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


@register("weight_policies", """
WITH d AS (SELECT l_returnflag, nullif(l_tax, 0) - 0.03 AS w FROM lineitem)
SELECT l_returnflag, sum(coalesce(w, 0.0)) AS cero, sum(CASE WHEN w > 0 THEN w END) AS solo_positivos, sum(coalesce(w, 1.0)) AS uno,
       count(*)::DOUBLE AS sin_peso, count(*)::DOUBLE AS suma_negativa FROM d GROUP BY 1""")
def q_weight_policies(spark, sf):
    """G1: the three null policies, no weight column, and weights that add up to nothing."""
    d = lineitem(spark, sf).select("l_returnflag", (F.nullif(F.col("l_tax"), F.lit(0.0)) - 0.03).alias("w"), (-F.col("l_quantity")).alias("v"))
    out = None
    for name, (x, w) in {"cero": G.resolve_weight(d, "w"), "solo_positivos": G.resolve_weight(d, "w", "drop"), "uno": G.resolve_weight(d, "w", "one"),
                         "sin_peso": G.resolve_weight(d, "ausente"), "suma_negativa": G.resolve_weight(d, "v")}.items():
        part = x.groupBy("l_returnflag").agg(F.sum(w).alias(name))
        out = part if out is None else out.join(part, "l_returnflag")
    return out


@register("numeric_coercion", with_base("""
SELECT count(CASE WHEN CH06 % 2 = 0 THEN CH06 END) AS edad, sum(CASE WHEN CH06 % 2 = 0 THEN CH06 END)::DOUBLE AS suma, count(*) AS n FROM persons"""))
def q_numeric_coercion(spark, sf):
    """Text that isn't a number becomes null."""
    p = bind.persons(spark, sf).withColumn("CH06", F.when(F.col("CH06") % 2 == 0, F.concat(F.lit(" "), F.col("CH06").cast("string"))).otherwise(F.lit("s/d")))
    return normalize_types(p).agg(F.count("CH06").alias("edad"), F.sum("CH06").alias("suma"), F.count(F.lit(1)).alias("n"))


@register("code_labels", with_base("""
SELECT CASE ESTADO WHEN 1 THEN 'Ocupado' WHEN 2 THEN 'Desocupado' END AS "ESTADO_LABEL", count(*) AS n FROM persons GROUP BY 1"""))
def q_code_labels(spark, sf):
    """A label column by code, null where the book has no code."""
    book = spark.createDataFrame([("ESTADO", "1.0", "Ocupado"), ("estado", " 2", "Desocupado")], "variable string, code string, label string")
    return apply_labels(bind.persons(spark, sf), book).groupBy("ESTADO_LABEL").agg(F.count(F.lit(1)).alias("n"))


@register("category_label", with_base("""
SELECT CASE WHEN ESTADO = 2 THEN 'Sin dato' WHEN ESTADO = 1 THEN 'Ocupado' ELSE 'Inactivo' END AS categoria, count(*) AS n FROM persons GROUP BY 1"""))
def q_category_label(spark, sf):
    """P20: display labels; null is a category of its own."""
    p = bind.persons(spark, sf).select(F.nullif(F.col("ESTADO"), F.lit(2)).cast("double").alias("ESTADO"))
    return p.groupBy(LB.category_label("ESTADO", "ESTADO").alias("categoria")).agg(F.count(F.lit(1)).alias("n"))


@register("variable_names", "SELECT p_brand AS variable, CASE WHEN p_brand LIKE '%1' THEN 'Marca ' || p_brand ELSE p_brand END AS nombre, count(*) AS n FROM part GROUP BY 1")
def q_variable_names(spark, sf):
    """Names from a dictionary, else the code."""
    d = bind.table(spark, sf, "part").groupBy(F.col("p_brand").alias("variable")).agg(F.count(F.lit(1)).alias("n"))
    book = d.where(F.col("variable").endswith("1")).select("variable", F.concat(F.lit("Marca "), F.col("variable")).alias("desc"))
    return LB.variable_names(d, "variable", book).select("variable", "nombre", "n")


@register("bands", with_frame("""
SELECT CASE WHEN idx_exclusion_digital IS NULL THEN 'N/D' WHEN idx_exclusion_digital < 0.33 THEN 'bajo' WHEN idx_exclusion_digital < 0.66 THEN 'medio' ELSE 'alto' END AS banda,
       count(*) AS n FROM frame GROUP BY 1"""))
def q_bands(spark, sf):
    """P23."""
    return frame(spark, sf).groupBy(C.band_0_1("idx_exclusion_digital").alias("banda")).agg(F.count(F.lit(1)).alias("n"))


@register("income_weight", with_base("SELECT sum(IPCF * PONDERA) / sum(PONDERA) AS wmean FROM persons"))
def q_income_weight(spark, sf):
    """The person-income weight where there is no household-income weight."""
    p = bind.persons(spark, sf).withColumnRenamed("PONDERA", "PONDII")
    return G.weighted_mean(p, "IPCF", G.income_weight(p))


@register("area_frame", with_frame("SELECT count(*) AS n, sum(PONDERA) AS peso, sum(superior) AS superior FROM frame WHERE AGLOMERADO = 3"))
def q_area_frame(spark, sf):
    """the frame of one area."""
    f = analysis_frame(bind.households(spark, sf), bind.persons(spark, sf), area=3, region_names=bind.region_dim(spark, sf), area_names=bind.area_dim(spark, sf), keep=KEY)
    return f.agg(F.count(F.lit(1)).alias("n"), F.sum("PONDERA").alias("peso"), F.sum("superior").alias("superior"))


@register("membership", "SELECT coalesce(nullif(l_linenumber, 3) IN (1, 2), false) AS dentro, count(*) AS n FROM lineitem GROUP BY 1")
def q_membership(spark, sf):
    """null is in no list."""
    return lineitem(spark, sf).groupBy(isin_safe(F.nullif(F.col("l_linenumber"), F.lit(3)), [1, 2]).alias("dentro")).agg(F.count(F.lit(1)).alias("n"))


@register("working_age", with_base("SELECT ESTADO, count(*) AS n, min(CH06) AS desde, max(CH06) AS hasta FROM persons WHERE CH06 BETWEEN 18 AND 50 AND ESTADO IN (1, 2) GROUP BY 1"))
def q_working_age(spark, sf):
    """F10."""
    return age_status_subset(bind.persons(spark, sf), high=50).groupBy("ESTADO").agg(F.count(F.lit(1)).alias("n"), F.min("CH06").alias("desde"), F.max("CH06").alias("hasta"))


@register("territory_search", """SELECT 'aglomerado_' || CAST(n_nationkey AS VARCHAR) AS territorio_id, n_name AS territorio_nombre FROM nation WHERE strpos(lower(n_name), 'n_1') > 0""")
def q_territory_search(spark, sf):
    """F11."""
    return D.search_territories(territory_dim(spark, sf), " N_1 ").select("territorio_id", "territorio_nombre")


@register("persons_without_households", with_base("SELECT count(DISTINCT CODUSU) AS hogares, count(*) AS personas FROM persons"))
def q_persons_only(spark, sf):
    """J6."""
    return J.person_only_stats(bind.persons(spark, sf))


def _places(spark, sf) -> DataFrame:
    return _coordinates(spark, sf).where("code % 3 <> 0")


_MAP = with_frame(f"""
SELECT CAST(n_nationkey AS INTEGER) AS aglomerado_codigo, CAST({_LAT} AS DOUBLE) AS lat, CAST({_LON} AS DOUBLE) AS lon, k.valor, k.n
FROM nation JOIN (SELECT AGLOMERADO, sum(vulnerabilidad_social * PONDERA) / sum(PONDERA) AS valor, count(*) AS n FROM frame GROUP BY 1) k ON n_nationkey = k.AGLOMERADO
WHERE n_nationkey % 3 <> 0""")


@register("map_metric", _MAP)
def q_map_metric(spark, sf):
    """A metric with its place, territories without one left out."""
    return K.map_metric(K.catalog(frame(spark, sf), territory_dim(spark, sf)), _places(spark, sf), "vulnerabilidad_social").drop("territorio_nombre")


@register("geo_inner", _MAP.replace(", k.valor, k.n", ", k.valor AS vulnerabilidad_social"))
def q_geo_inner(spark, sf):
    """J10."""
    c = K.catalog(frame(spark, sf), territory_dim(spark, sf)).select("aglomerado_codigo", "vulnerabilidad_social")
    return J.geo_inner(c, _places(spark, sf).drop("name")).where("vulnerabilidad_social IS NOT NULL")


# ---------------------------------------------------------------------------
# Groups with a null key
# ---------------------------------------------------------------------------
_NULLED = "(SELECT nullif(l_returnflag, 'A') AS g, l_extendedprice AS v, l_quantity AS w FROM lineitem WHERE l_extendedprice >= 0 AND l_quantity > 0)"
_RUN = f"""r AS (SELECT g, v, sum(w) AS w, count(*) AS n FROM {_NULLED} GROUP BY g, v),
c AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY g) AS tot FROM r)"""
_GINI = "2 * sum(w * (cum - w / 2) * v) / (sum(w) * sum(w * v)) - (1 - 1 / sum(w))"


def nulled(spark, sf) -> DataFrame:
    return lineitem(spark, sf).withColumn("g", F.nullif("l_returnflag", F.lit("A")))


@register("null_group_gini", f"WITH {_RUN} SELECT g, CAST(sum(n) AS BIGINT) AS n, sum(w) AS w_sum, {_GINI} AS gini FROM c GROUP BY g")
def q_null_group_gini(spark, sf):
    return O.gini(nulled(spark, sf), "l_extendedprice", "l_quantity", by="g")


@register("null_group_compare", f"""WITH {_RUN}
SELECT g, sum(w) AS w_sum, sum(w * v) / sum(w) AS mean, min(v) FILTER (WHERE cum >= tot / 2) AS median_lower, {_GINI} AS gini FROM c GROUP BY g""")
def q_null_group_compare(spark, sf):
    return G.group_compare(nulled(spark, sf), "l_extendedprice", "g", "l_quantity")


@register("null_group_quantiles", f"""WITH {_RUN}, q AS (SELECT g, p, min(v) FILTER (WHERE cum >= p * tot) AS a, min(cum) FILTER (WHERE cum >= p * tot) AS hit,
  min(v) FILTER (WHERE cum > p * tot + 1e-10) AS b, max(p * tot) AS t FROM c, (SELECT unnest([0.25, 0.5, 0.9])::DOUBLE AS p) GROUP BY g, p),
z AS (SELECT g, p, CASE WHEN abs(t - hit) < 1e-10 AND b IS NOT NULL THEN (a + b) / 2 ELSE a END AS x FROM q)
SELECT g, max(x) FILTER (WHERE p = 0.25) AS q25, max(x) FILTER (WHERE p = 0.5) AS q50, max(x) FILTER (WHERE p = 0.9) AS q90 FROM z GROUP BY g""")
def q_null_group_quantiles(spark, sf):
    return O.weighted_quantiles(nulled(spark, sf), "l_extendedprice", "l_quantity", [0.25, 0.5, 0.9], by="g", valid="income")


@register("null_group_percentiles", """SELECT nullif(l_returnflag, 'A') AS g, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50 FROM lineitem GROUP BY 1""")
def q_null_group_percentiles(spark, sf):
    return O.unweighted_quantiles(nulled(spark, sf), "l_extendedprice", [0.25, 0.5], by="g")


@register("null_group_lever", f"""
WITH m AS (SELECT nullif(l_returnflag, 'A') AS g, l_quantity AS w, l_discount >= 0.04 AS bad, {', '.join(KEY)} FROM lineitem),
t AS (SELECT g, sum(w) AS sw, coalesce(sum(CASE WHEN NOT bad THEN w END), 0.0) AS swg FROM m GROUP BY g),
p AS (SELECT g, CASE WHEN 75.0 > 100 * swg / sw + 0.05 THEN greatest(0.0, 0.75 * sw - swg) ELSE 0.0 END AS extra FROM t),
c AS (SELECT g, w, coalesce(sum(w) OVER (PARTITION BY g ORDER BY w DESC, {', '.join(KEY)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM m WHERE bad)
SELECT p.g, count(*) FILTER (WHERE c.before < p.extra) AS flipped, sum(c.w) FILTER (WHERE c.before < p.extra) AS flipped_w FROM p JOIN c ON p.g IS NOT DISTINCT FROM c.g GROUP BY p.g""")
def q_null_group_lever(spark, sf):
    d = nulled(spark, sf).withColumn("bad", (F.col("l_discount") >= 0.04).cast("double"))
    targets = d.select("g").distinct().withColumn("target", F.lit(75.0))
    out = L.flip_to_target(d, F.lit(True), "bad", targets, KEY, by="g", weight="l_quantity")
    return out.groupBy("g").agg(F.count_if("_flipped").alias("flipped"), F.sum(F.when(F.col("_flipped"), F.col("l_quantity"))).alias("flipped_w"))


# ---------------------------------------------------------------------------
# Scenario (L4–L7, J14)
# ---------------------------------------------------------------------------
_LEVERS = [("lever_net", "coalesce(decil_ingreso <= 2, false)", "excl_sin_internet_hogar", 0.0, 1.0, 80.0), ("lever_sup", "true", "superior", 1.0, 0.0, 40.0),
           ("lever_inf", "coalesce(ocupado = 1, false)", "informal_proxy", 0.0, 1.0, 70.0)]


def _lever_ctes() -> list[str]:
    out, keys = [], ", ".join(KEY)
    for name, mask, col, good, bad, target in _LEVERS:
        out += [f"{name}_p AS (SELECT AGLOMERADO, CASE WHEN {target} > 100 * coalesce(sum(CASE WHEN {col} = {good} THEN PONDERA END), 0.0) / sum(PONDERA) + 0.05 "
                f"THEN greatest(0.0, {target} / 100 * sum(PONDERA) - coalesce(sum(CASE WHEN {col} = {good} THEN PONDERA END), 0.0)) ELSE 0.0 END AS extra "
                f"FROM frame WHERE {mask} AND {col} IS NOT NULL GROUP BY AGLOMERADO)",
                f"{name} AS (SELECT {keys} FROM (SELECT f.*, extra, coalesce(sum(PONDERA) OVER (PARTITION BY f.AGLOMERADO ORDER BY PONDERA DESC, {keys} "
                f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM frame f JOIN {name}_p USING (AGLOMERADO) WHERE {mask} AND {col} = {bad}) WHERE before < extra)"]
    return out


_FIVE = ["excl_sin_pc", "excl_sin_internet_hogar", "excl_sin_uso_cel", "excl_sin_uso_pc", "excl_sin_uso_internet"]
_MEAN5 = f"({' + '.join(f'coalesce({c}, 0.0)' for c in _FIVE)}) / nullif({' + '.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in _FIVE)}, 0)"
_IND = ["pct_superior", "pct_ocupado", "score_movilidad_proxy", "vulnerabilidad_social", "idx_exclusion_digital", "pct_exclusion_digital_alta", "pct_informal_ocupados"]


def _measured(name: str, source: str) -> str:
    mean = lambda x, where="true": f"sum(CASE WHEN {x} IS NOT NULL AND {where} THEN {x} * PONDERA END) / sum(CASE WHEN {x} IS NOT NULL AND {where} THEN PONDERA END)"
    return (f"{name} AS (SELECT CAST(AGLOMERADO AS INTEGER) AS AGLOMERADO, 100 * {mean('superior')} AS pct_superior, 100 * {mean('ocupado')} AS pct_ocupado, "
            f"{mean('score_movilidad_proxy')} AS score_movilidad_proxy, {mean('vulnerabilidad_social')} AS vulnerabilidad_social, {mean('idx_exclusion_digital')} AS idx_exclusion_digital, "
            f"CASE WHEN count(idx_exclusion_digital) > 0 THEN 100 * {mean('exclusion_digital_alta')} END AS pct_exclusion_digital_alta, "
            f"100 * {mean('informal_proxy', 'ocupado = 1')} AS pct_informal_ocupados FROM {source} GROUP BY AGLOMERADO)")


_AFTER = ["a1 AS (SELECT f.* REPLACE (" + ", ".join(
    f"CASE WHEN {n}.l_orderkey IS NOT NULL THEN {good} ELSE f.{col} END AS {col}" for n, _, col, good, _, _ in _LEVERS) + ") FROM frame f "
    + " ".join(f"LEFT JOIN {n} ON {' AND '.join(f'f.{k} = {n}.{k}' for k in KEY)}" for n, *_ in _LEVERS) + ")",
    f"a2 AS (SELECT * REPLACE ({_MEAN5} AS idx_exclusion_digital) FROM a1)",
    """a3 AS (SELECT * REPLACE (
    coalesce(CAST(idx_exclusion_digital >= (SELECT median(idx_exclusion_digital) FROM frame) AS INTEGER), 0) AS exclusion_digital_alta,
    coalesce(secundario_completo, 0.0) * 0.3 + coalesce(superior, 0.0) * 0.2 + coalesce(ocupado, 0.0) * 0.2 + (1 - coalesce(informal_proxy, 1.0)) * 0.15
      + coalesce(quintil_alto, 0.0) * 0.15 AS score_movilidad_proxy,
    (1 - coalesce(secundario_completo, 0.0)) * 0.35 + coalesce(desocupado, 0.0) * 0.25 + coalesce(quintil_bajo, 0.0) * 0.25
      + coalesce(idx_exclusion_digital, 0.0) * 0.15 AS vulnerabilidad_social) FROM a2)"""]

REGISTRY["scenario_compare"] = (REGISTRY["scenario_compare"][0], with_frame("\nUNION ALL\n".join(
    f"SELECT AGLOMERADO, '{c}' AS indicador, b.{c} AS base, a.{c} AS escenario, a.{c} - b.{c} AS delta FROM before_ b JOIN after_ a USING (AGLOMERADO)" for c in _IND),
    *_lever_ctes(), *_AFTER, _measured("before_", "frame"), _measured("after_", "a3")))


# ---------------------------------------------------------------------------
# Cluster matrix and silhouette
# ---------------------------------------------------------------------------
_Z = "({x} - avg({x}) OVER ()) / CASE WHEN stddev_pop({x}) OVER () > 0 THEN stddev_pop({x}) OVER () ELSE 1 END"


@register("cluster_matrix", f"""
WITH d AS (SELECT c_custkey, coalesce(nullif(c_nationkey, 7), median(nullif(c_nationkey, 7)) OVER ())::DOUBLE AS a, c_acctbal AS b,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END AS s1, CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0 ELSE 0.0 END AS s2 FROM customer)
SELECT c_custkey, {_Z.format(x='a')} AS nacion, {_Z.format(x='b')} AS saldo, {_Z.format(x='s1')} AS construccion, {_Z.format(x='s2')} AS muebles FROM d""")
def q_cluster_matrix(spark, sf):
    """Medians, one-hot, scaling of mixed columns."""
    c = bind.table(spark, sf, "customer").select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(7)).alias("nacion"), F.col("c_acctbal").alias("saldo"), "c_mktsegment",
                                                 F.lit("uno").alias("constante"))
    m, names = CL.cluster_matrix(c, ["nacion", "saldo", "c_mktsegment", "constante"])
    at = {n: F.col(f"x{i}") for i, n in enumerate(names)}
    return m.select("c_custkey", at["nacion"].alias("nacion"), at["saldo"].alias("saldo"), at["c_mktsegment_BUILDING"].alias("construccion"), at["c_mktsegment_FURNITURE"].alias("muebles"))


@register("silhouette", """
WITH d AS (SELECT s_suppkey AS id, s_acctbal / 1000.0 AS a, s_nationkey::DOUBLE AS b, CASE WHEN s_acctbal > 2000 THEN 1 WHEN s_acctbal > -500 THEN 0 ELSE 2 END AS c FROM supplier),
p AS (SELECT x.id, x.c AS own, y.c AS other, sum(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) AS s, count(*) AS n FROM d x JOIN d y ON true GROUP BY ALL),
i AS (SELECT id, own, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS inside, min(CASE WHEN own <> other THEN s / n END) AS near FROM p GROUP BY ALL)
SELECT avg(CASE WHEN inside IS NULL OR greatest(inside, near) = 0 THEN 0 ELSE (near - inside) / greatest(inside, near) END) AS silhouette FROM i""")
def q_silhouette(spark, sf):
    """M18 on the suppliers (its sample holds all of them up to 5 000)."""
    d = bind.table(spark, sf, "supplier").select((F.col("s_acctbal") / 1000.0).alias("a"), F.col("s_nationkey").cast("double").alias("b"),
                                                 F.when(F.col("s_acctbal") > 2000, 1).when(F.col("s_acctbal") > -500, 0).otherwise(2).alias("c"))
    return spark.createDataFrame([(CL.silhouette(d, ["a", "b"], "c"),)], "silhouette double")


@register("cluster_transpose", """
WITH d AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, l_quantity, l_tax FROM lineitem),
a AS (SELECT c, avg(l_quantity) AS l_quantity, avg(l_tax) AS l_tax FROM d GROUP BY 1),
u AS (SELECT 'l_quantity' AS variable, c, l_quantity AS v FROM a UNION ALL SELECT 'l_tax', c, l_tax FROM a)
SELECT variable, max(v) FILTER (WHERE c = 0) AS "C0", max(v) FILTER (WHERE c = 1) AS "C1", max(v) FILTER (WHERE c = 2) AS "C2" FROM u GROUP BY 1""")
def q_cluster_transpose(spark, sf):
    """The profile of given clusters, features as rows."""
    c = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    feats = ["l_quantity", "l_tax"]
    return CL.transposed(CL.profile(lineitem(spark, sf).withColumn("prediction", c), feats), feats, 3)
