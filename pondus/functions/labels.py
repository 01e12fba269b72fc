"""Display labels (P20–P23) and rule-based cluster names (M19) as expressions.

Result tables are small (one row per category, variable or cluster), but the labelling
is still written as column expressions and joins, so it applies to any table size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .expr import col, lookup

# Display labels of the activity status and the recoded education level.
ESTADO_LABELS = {0: "Sin dato / no relevado", 1: "Ocupado", 2: "Desocupado", 3: "Inactivo",
                 4: "Menor de 10 años"}
NIVEL_ED_LABELS = {1: "Primaria incompleta", 2: "Primaria completa", 3: "Secundaria incompleta",
                   4: "Secundaria completa", 5: "Superior universitaria incompleta",
                   6: "Superior universitaria completa", 7: "Sin instrucción", 9: "NS/NR"}
MISSING = "Sin dato"


def category_label(variable: str, value, books: Mapping[str, Mapping[int, str]] | None = None) -> Column:
    """P20: null → 'Sin dato'; integral codes through the variable's code book (falling
    back to the code as text); non-numeric text as is."""
    books = books or {"ESTADO": ESTADO_LABELS, "NIVEL_ED": NIVEL_ED_LABELS}
    v = col(value)
    as_int = v.cast("string").try_cast("double").cast("long")
    text = F.when(as_int.isNotNull(), as_int.cast("string")).otherwise(v.cast("string"))
    if variable in books:
        text = F.coalesce(lookup(books[variable], as_int.cast("int")), text)
    return F.when(v.isNull(), F.lit(MISSING)).otherwise(text)


def variable_names(df: DataFrame, variable_col: str, dictionary: DataFrame | None = None,
                   derived: Mapping[str, str] | None = None, out: str = "nombre",
                   full: bool = False) -> DataFrame:
    """Human name of a variable code: derived/frequent map → `_LABEL` suffix →
    dictionary ``desc`` (join) → one-hot ``BASE_VALUE`` as "Base = value" → the code.
    ``full`` gives "Name (CODE)" when a name was found."""
    derived = derived or {}
    v = F.upper(F.trim(F.col(variable_col)))
    base_label = F.regexp_extract(v, r"^(.*)_LABEL$", 1)
    oh_base = F.regexp_extract(v, r"^([A-Z_0-9]+?)_([A-Za-z0-9 .+\-]+)$", 1)
    oh_val = F.regexp_extract(v, r"^([A-Z_0-9]+?)_([A-Za-z0-9 .+\-]+)$", 2)
    d = df
    desc = F.lit(None).cast("string")
    if dictionary is not None:
        dim = dictionary.select(F.upper("variable").alias("_dv"), F.col("desc").alias("_desc"))
        d = d.join(dim, v == F.col("_dv"), "left")
        desc = F.col("_desc")
    m = lookup(derived, v) if derived else F.lit(None).cast("string")
    m_base = lookup(derived, base_label) if derived else F.lit(None).cast("string")
    m_oh = lookup(derived, oh_base) if derived else F.lit(None).cast("string")
    name = F.coalesce(
        m,
        F.when(base_label != "", F.concat(F.coalesce(m_base, base_label), F.lit(" (etiqueta)"))),
        desc,
        F.when(m_oh.isNotNull(), F.concat(m_oh, F.lit(" = "), oh_val)),
        F.col(variable_col))
    if full:
        name = F.when(F.lower(name) == F.lower(F.col(variable_col)), F.col(variable_col)) \
                .otherwise(F.concat(name, F.lit(" ("), F.col(variable_col), F.lit(")")))
    return d.withColumn(out, name).drop(*[c for c in ("_dv", "_desc") if c in d.columns])


def cluster_name(excl, mov, vuln, educ) -> Column:
    """M19 rule chain on a cluster's mean profile."""
    e, m, v, s = col(excl), col(mov), col(vuln), col(educ)
    return (F.when(e.isNotNull() & v.isNotNull() & (e >= 0.6) & (v >= 0.5),
                   "Exclusión digital y vulnerabilidad altas")
             .when(e >= 0.55, "Alta exclusión digital")
             .when((m >= 0.55) & (e.isNull() | (e < 0.4)), "Mayor movilidad social (proxy)")
             .when(v >= 0.55, "Alta vulnerabilidad sociolaboral")
             .when((s >= 0.6) & (e < 0.35), "Educación favorable e inclusión digital")
             .when((e < 0.33) & (m >= 0.45), "Inclusión digital y movilidad favorables")
             .otherwise("Perfil socio-digital intermedio"))


def index_reading(df: DataFrame, indicators: Mapping[str, bool], year: str = "anio") -> DataFrame:
    """The latest year's value of each 0–1 indicator (``max_by`` on the year), banded
    low/mid/high, with a direction-aware reading (``True`` = higher is better)."""
    from .coding import band_0_1
    last = df.agg(*[F.max_by(c, year).alias(c) for c in indicators], F.max(year).alias(year))
    long = last.unpivot([year], list(indicators), "indicador", "valor")
    better = lookup({k: v for k, v in indicators.items()}, F.col("indicador"))
    band = band_0_1("valor")
    reading = (F.when(F.col("valor").isNull(), F.lit("sin dato"))
                .when(band == "medio", F.lit("nivel intermedio"))
                .when((band == "alto") == better, F.lit("situación favorable"))
                .otherwise(F.lit("situación desfavorable")))
    return long.withColumns({"banda": band, "lectura": reading})
