"""Survey coding rules as column expressions.

Nothing here runs a job.  Rules whose *plan* depends on data (the 50 % education
rule, the median threshold) take the data-derived number as an argument; the plans
layer computes it with one small aggregate.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .expr import col, flag, isin_safe, num, row_mean

# ---------------------------------------------------------------------------
# Fixed values that must equal the survey's code book and the reference rules.
# ---------------------------------------------------------------------------
NONRESPONSE_CODES = [9, 99, 999, -9, -99]
NONRESPONSE_VARIABLES = ["CH07", "CH08", "CH11", "CH13", "CAT_OCUP", "II7", "IV1"]
NUMERIC_VARIABLES = [
    "CH06", "CH14", "ANO4", "TRIMESTRE", "AGLOMERADO", "REGION",
    "IX_TOT", "IX_MEN10", "IX_MAYEQ10", "IV2", "II1",
    "P21", "P47T", "TOT_P12", "ITF", "IPCF",
    "PONDERA", "PONDIH", "PONDII", "PONDIIO",
]
AGE_GROUP_EDGES = [-1, 4, 14, 29, 44, 64, 200]
AGE_GROUP_LABELS = ["0-4 años", "5-14 años", "15-29 años", "30-44 años", "45-64 años", "65+ años"]
INCOME_QUINTILE_LABELS = ["Q1 (más bajo)", "Q2", "Q3", "Q4", "Q5 (más alto)"]
EXCLUSION_LEVEL_EDGES = [-0.001, 0.25, 0.50, 0.75, 1.001]
EXCLUSION_LEVEL_LABELS = ["Inclusión", "Exclusión leve", "Exclusión moderada", "Exclusión severa"]
# generation-1 index: candidate columns per concept, first present wins
ACCESS_CANDIDATES = {
    "internet": ["IH_II_04"],
    "computadora": ["IH_II_03", "IV12_3"],
    "celular": ["IH_II_02", "IH_II_01"],
}
USE_CANDIDATES = {
    "usa_internet": ["IP_III_04"],
    "usa_computadora": ["IP_III_05"],
    "usa_celular": ["IP_III_06"],
}
SKILL_AGE_STEPS = [(30, 0.0), (45, 0.2), (60, 0.4), (75, 0.7)]  # age < bound -> score; else 0.9
SKILL_AGE_TOP = 0.9
SKILL_EDUCATION = {7: 1.0, 1: 0.9, 2: 0.7, 3: 0.5, 4: 0.3, 5: 0.15, 6: 0.0}
# generation-2 composite weights
MOBILITY_WEIGHTS = {"secundario_completo": 0.30, "superior": 0.20, "ocupado": 0.20,
                    "formal": 0.15, "quintil_alto": 0.15}
VULNERABILITY_WEIGHTS = {"no_secundario": 0.35, "desocupado": 0.25, "quintil_bajo": 0.25,
                         "idx_exclusion_digital": 0.15}
KPI_MIN_N = 150
KPI_WARN_N = 80
GAP_MIN_SEX = 30
GAP_MIN_DECILE = 20
BAND_EDGES = (0.33, 0.66)


# ---------------------------------------------------------------------------
# P1–P6 cleaning
# ---------------------------------------------------------------------------

def numeric_or_null(df: DataFrame, name: str) -> Column:
    """P1 ``_col``: lenient numeric, or a typed null column when absent."""
    return num(name) if name in df.columns else F.lit(None).cast("double")


def nonresponse_to_null(c, codes: Sequence[int] = NONRESPONSE_CODES) -> Column:
    """Codes 9/99/999/−9/−99 become null (null stays null)."""
    c = col(c)
    return F.when(~c.isin(list(codes)), c)


def code_key(c) -> Column:
    """P3 key normalisation: integer text loses zeros ("01" → "1"), numeric columns truncate
    toward zero (4.0 → "4"); any other text ("4.7", "1e30", words) stays trimmed text."""
    c = col(c)
    return F.coalesce(c.try_cast("bigint").cast("string"), F.trim(c.cast("string")))


def age_group(age) -> Column:
    """Right-closed bins (−1,4] (4,14] (14,29] (29,44] (44,64] (64,200]; outside → null."""
    a = col(age)
    e, lab = AGE_GROUP_EDGES, AGE_GROUP_LABELS
    out = None
    for i in range(len(lab)):
        cond = (a > e[i]) & (a <= e[i + 1])
        out = F.when(cond, F.lit(lab[i])) if out is None else out.when(cond, F.lit(lab[i]))
    return out


def eq_flag(c, value) -> Column:
    """P5: (c == value) as 0/1 with null → 0 (integer flag)."""
    return F.coalesce((col(c) == value).cast("int"), F.lit(0))


def in_flag(c, values: Iterable) -> Column:
    return isin_safe(c, values).cast("int")


def edges_label(x, edges: Column | Sequence, labels: Sequence[str]) -> Column:
    """Right-closed binning by ascending edges (lowest edge included); duplicate edges
    collapse their bin (the first edge hit wins).  ``edges`` may be an array column."""
    x = col(x)
    arr = edges if isinstance(edges, Column) else F.array(*[F.lit(float(e)) for e in edges])
    out = None
    for i in range(len(labels)):
        lo, hi = arr[i], arr[i + 1]
        cond = (x <= hi) & ((x >= lo) if i == 0 else (x > lo))
        out = F.when(cond, F.lit(labels[i])) if out is None else out.when(cond, F.lit(labels[i]))
    return out


# ---------------------------------------------------------------------------
# P7–P18 generation-2 flags and scores
# ---------------------------------------------------------------------------

def yes_no_exclusion(c, lacks_code: int = 1, has_code: int = 2) -> Column:
    """P7 (T1): 'lacks' code → 1.0, 'has' code → 0.0, anything else → null."""
    v = num(c) if isinstance(c, str) else c
    return F.when(v == has_code, F.lit(0.0)).when(v == lacks_code, F.lit(1.0))


def usage_exclusion(c) -> Column:
    """P8 (T19): 0 → 1.0 (did not use), > 0 → 0.0 (9 counts as used), negatives → null."""
    v = num(c) if isinstance(c, str) else c
    return F.when(v == 0, F.lit(1.0)).when(v > 0, F.lit(0.0))


def education_proxies(nivel_ed: Column, ch12: Column, use_nivel: bool | Column):
    """P10 (T6): with NIVEL_ED ≥4 / ≥6, else CH12 ∈ {4..9} / {6..9}; null → 0.

    ``use_nivel`` is the data-derived "more than half the rows have NIVEL_ED" decision,
    given as a Python bool or a boolean scalar column (scalar subquery)."""
    sec_n, sup_n = flag(nivel_ed >= 4), flag(nivel_ed >= 6)
    sec_c = isin_safe(ch12, [4, 5, 6, 7, 8, 9]).cast("double")
    sup_c = isin_safe(ch12, [6, 7, 8, 9]).cast("double")
    if isinstance(use_nivel, bool):
        return (sec_n, sup_n) if use_nivel else (sec_c, sup_c)
    return F.when(use_nivel, sec_n).otherwise(sec_c), F.when(use_nivel, sup_n).otherwise(sup_c)


def informal_proxy(ocupado: Column, pp07h: Column) -> Column:
    """Among the employed, PP07H == 2 → 1 else 0 (null counts 0); null otherwise."""
    return F.when(ocupado == 1, flag(pp07h == 2))


def mobility_score(sec, sup, ocu, inf, q_alto) -> Column:
    """.30·secondary + .20·higher + .20·employed + .15·(1−informal) + .15·top decile."""
    m = MOBILITY_WEIGHTS
    z = lambda c: F.coalesce(col(c), F.lit(0.0))
    return (z(sec) * m["secundario_completo"] + z(sup) * m["superior"] + z(ocu) * m["ocupado"]
            + (1 - F.coalesce(col(inf), F.lit(1.0))) * m["formal"] + z(q_alto) * m["quintil_alto"])


def vulnerability_score(sec, deso, q_bajo, idx) -> Column:
    """.35·(1−secondary) + .25·unemployed + .25·bottom decile + .15·digital index."""
    v = VULNERABILITY_WEIGHTS
    z = lambda c: F.coalesce(col(c), F.lit(0.0))
    return ((1 - z(sec)) * v["no_secundario"] + z(deso) * v["desocupado"]
            + z(q_bajo) * v["quintil_bajo"] + z(idx) * v["idx_exclusion_digital"])


def at_least(x, threshold) -> Column:
    """X ≥ threshold as int, null → 0."""
    return F.coalesce((col(x) >= threshold).cast("int"), F.lit(0))


def band_0_1(x) -> Column:
    """<.33 low, <.66 mid, else high; null → 'N/D'."""
    x = col(x)
    return (F.when(x.isNull(), F.lit("N/D")).when(x < BAND_EDGES[0], F.lit("bajo"))
            .when(x < BAND_EDGES[1], F.lit("medio")).otherwise(F.lit("alto")))


# ---------------------------------------------------------------------------
# I1–I5 generation-1 composite index of digital exclusion
# ---------------------------------------------------------------------------

def _first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def access_dimension(df: DataFrame) -> tuple[Column, float]:
    """Per concept the first present column, 2 → 1 (lacks), 1 → 0, else null;
    row mean; coverage = concepts found / 3.  Without ICT columns: proxy from low
    education and the two lowest income quintiles, coverage 0."""
    flags = []
    for cands in ACCESS_CANDIDATES.values():
        c = _first_present(df, cands)
        if c is not None:
            flags.append(yes_no_exclusion(c, lacks_code=2, has_code=1))
    if flags:
        return row_mean(flags), len(flags) / len(ACCESS_CANDIDATES)
    proxies = []
    if "NIVEL_ED" in df.columns:
        proxies.append(flag(num("NIVEL_ED") <= 3))
    if "QUINTIL_IPCF" in df.columns:
        proxies.append(flag(F.col("QUINTIL_IPCF").isin(INCOME_QUINTILE_LABELS[:2])))
    return (row_mean(proxies) if proxies else F.lit(None).cast("double")), 0.0


def skills_dimension(df: DataFrame) -> tuple[Column, float]:
    """Age step and education step, row mean (full precision); coverage n/2."""
    parts = []
    if "CH06" in df.columns:
        a = num("CH06")
        s = None
        for bound, score in SKILL_AGE_STEPS:
            s = F.when(a < bound, F.lit(score)) if s is None else s.when(a < bound, F.lit(score))
        parts.append(s.when(a >= SKILL_AGE_STEPS[-1][0], F.lit(SKILL_AGE_TOP)))
    if "NIVEL_ED" in df.columns:
        ne = num("NIVEL_ED")
        s = None
        for code, score in SKILL_EDUCATION.items():
            s = F.when(ne == code, F.lit(score)) if s is None else s.when(ne == code, F.lit(score))
        parts.append(s)
    if not parts:
        return F.lit(None).cast("double"), 0.0
    return row_mean(parts), len(parts) / 2


def use_dimension(df: DataFrame) -> tuple[Column, float]:
    """I4: three usage columns coded like I1 (2 → did not use); null when absent."""
    flags = []
    for cands in USE_CANDIDATES.values():
        c = _first_present(df, cands)
        if c is not None:
            flags.append(yes_no_exclusion(c, lacks_code=2, has_code=1))
    if not flags:
        return F.lit(None).cast("double"), 0.0
    return row_mean(flags), len(flags) / len(USE_CANDIDATES)


def exclusion_level(x) -> Column:
    """I5 level bins (−.001,.25] (.25,.5] (.5,.75] (.75,1.001]."""
    x = col(x)
    e, lab = EXCLUSION_LEVEL_EDGES, EXCLUSION_LEVEL_LABELS
    out = None
    for i in range(len(lab)):
        cond = (x > e[i]) & (x <= e[i + 1])
        out = F.when(cond, F.lit(lab[i])) if out is None else out.when(cond, F.lit(lab[i]))
    return out
