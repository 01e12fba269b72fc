"""P0 cleaning chain on a person (or joined) table, as ``df.transform`` steps:
types (P1) → non-response to null (P2) → code labels (P3) → derived columns (P4–P6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import coding as C
from ..functions.expr import num
from ..operators.ordered import unweighted_quantiles


def normalize_types(df: DataFrame) -> DataFrame:
    """Lenient numeric coercion of the known numeric variables (NaN → null)."""
    return df.withColumns({c: num(c) for c in C.NUMERIC_VARIABLES if c in df.columns})


def nonresponse_null(df: DataFrame) -> DataFrame:
    """Codes 9/99/999/−9/−99 → null in the categorical variables that use them."""
    return df.withColumns({c: C.nonresponse_to_null(num(c)) for c in C.NONRESPONSE_VARIABLES
                           if c in df.columns})


def apply_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``<VAR>_LABEL`` for every labelled variable present.  The code book
    ``labels(variable, code, label)`` is a small dimension: its per-variable maps are
    collected once (bounded by the code book) and applied as map literals."""
    present = [c for c in df.columns if not c.endswith("_LABEL")]
    rows = labels.where(F.upper("variable").isin(present)).collect()
    books: dict[str, dict[str, str]] = {}
    for r in rows:
        key = str(r["code"]).strip()
        try:
            key = str(int(float(key)))
        except ValueError:
            pass
        books.setdefault(r["variable"].upper(), {})[key] = r["label"]
    out = {}
    for var, book in books.items():
        pairs = [x for k, v in book.items() for x in (F.lit(k), F.lit(v))]
        out[f"{var}_LABEL"] = F.create_map(*pairs)[C.code_key(var)]
    return df.withColumns(out)


def derived_columns(df: DataFrame) -> DataFrame:
    """Age group, head/status/education flags, income quintile label."""
    out = {}
    if "CH06" in df.columns:
        out["GRUPO_ETARIO"] = C.age_group(num("CH06"))
    if "CH03" in df.columns:
        out["ES_JEFE_HOGAR"] = C.eq_flag(num("CH03"), 1)
    if "ESTADO" in df.columns:
        e = num("ESTADO")
        out.update({"OCUPADO": C.eq_flag(e, 1), "DESOCUPADO": C.eq_flag(e, 2), "INACTIVO": C.eq_flag(e, 3)})
    if "NIVEL_ED" in df.columns:
        out.update({"EDUC_SUPERIOR_COMPLETA": C.in_flag(num("NIVEL_ED"), [6]),
                    "EDUC_SECUNDARIA_COMPLETA_O_MAS": C.in_flag(num("NIVEL_ED"), [4, 5, 6])})
    df = df.withColumns(out)
    if "IPCF" in df.columns:
        df = income_quintile_label(df)
    return df


def clean_persons(df: DataFrame, labels: DataFrame | None = None, *, nonresponse: bool = True,
                  derived: bool = True) -> DataFrame:
    out = df.transform(normalize_types)
    if nonresponse:
        out = out.transform(nonresponse_null)
    if labels is not None:
        out = apply_labels(out, labels)
    if derived:
        out = out.transform(derived_columns)
    return out


def income_quintile_label(df: DataFrame, col: str = "IPCF") -> DataFrame:
    """Unweighted interpolated quintile edges of positive incomes (exact, from the
    bucketed kernel, a scalar subquery) → right-closed labels, lowest included."""
    pos = F.when(num(col) > 0, num(col))
    cuts = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    q = unweighted_quantiles(df.select(pos.alias("_pos")), "_pos", cuts)
    edges = q.select(F.array(*[F.col(c) for c in q.columns])).scalar()
    return df.withColumn("QUINTIL_IPCF", C.edges_label(pos, edges, C.INCOME_QUINTILE_LABELS))
