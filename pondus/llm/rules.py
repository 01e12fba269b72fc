"""Quality rules: decision lists learned by sequential covering.

One pass over the texts gives each document's statistics (counts only, a narrow table).  From
the labelled ones a list of rules is learned: a rule grows by the condition with the largest
FOIL gain, one threshold on one statistic at a time, until it covers no good row; it is then
pruned, last conditions first, on rows that growing never saw, and it stays only if it is
precise there.  Rows that it covers go, and the next rule grows from the rest.  The list
becomes one ordered Spark conditional expression, so the verdict is a projection of the
statistics without any Python.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import written

#: Labelled rows of each label that learning sees at most.
FIT_ROWS = 20_000
#: A rule needs this share of bad rows among those it covers, and so many of them, where it is pruned.
PRECISION, COVER = 0.95, 3
MAX_RULES, MAX_CONDITIONS = 32, 6
#: One of so many labelled rows prunes; the others grow rules.
FOLDS = 3

#: Base: at least this many words, at most this percentage of them in repeated windows.
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5

_SYMBOL = T.byte_class(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
_NOT_NEWLINE = ~T.byte_class((10, 10))
_CONTINUES = T.byte_class((0x80, 0xBF))
_CLASSES = {
    "word_chars": T.NON_SPACE & ~_CONTINUES,
    "n_symbols": _SYMBOL,
    "n_upper": T.byte_class((0x41, 0x5A)),
    "n_lower": T.byte_class((0x61, 0x7A)),
    "n_digits": T.byte_class((0x30, 0x39)),
    "n_stops": T.byte_class((ord("."), ord("."))),
    "n_marks": T.byte_class((ord("!"), ord("!")), (ord("?"), ord("?"))),
}
STATISTICS = ("n_words", *_CLASSES, "n_lines", "n_dup_lines", "n_distinct", "n_repeat_words", "longest_word")


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def features() -> dict[str, Column]:
    """What the conditions of a rule compare with a threshold, from the statistics."""
    return {
        "words": F.col("n_words").cast("double"),
        "chars_a_word": _share("word_chars", "n_words"),
        "symbols_a_char": _share("n_symbols", "word_chars"),
        "upper_a_char": _share("n_upper", "word_chars"),
        "lower_a_char": _share("n_lower", "word_chars"),
        "digits_a_char": _share("n_digits", "word_chars"),
        "stops_a_word": _share("n_stops", "n_words"),
        "marks_a_word": _share("n_marks", "n_words"),
        "words_a_line": _share("n_words", "n_lines"),
        "repeated_lines": _share("n_dup_lines", "n_lines"),
        "distinct_words": _share("n_distinct", "n_words"),
        "repeated_words": _share("n_repeat_words", "n_words"),
        "longest_word": F.col("longest_word").cast("double"),
    }


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = features()[self.feature]
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


class Rules(NamedTuple):
    """Documents that any rule (a conjunction) covers go; the first that does is named."""

    rules: list[tuple[Condition, ...]]

    def first(self) -> Column:
        """The text of the first rule that covers a row, else null."""
        out = None
        for rule in self.rules:
            every = rule[0].column()
            for c in rule[1:]:
                every = every & c.column()
            name = F.lit(" and ".join(map(str, rule)))
            out = F.when(every, name) if out is None else out.when(every, name)
        return F.lit(None).cast("string") if out is None else out


# --- statistics -----------------------------------------------------------------------------

def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.int64)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(some):
        out[some] = np.add.reduceat(mask, offsets[some], dtype=np.int64)
    return out


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    return np.diff(T.sets(rows, hashes, n)[1])


def _repeated(w: T.Words, window: int, n: int) -> np.ndarray:
    """Words of each row that lie in a window of words found twice or more in the row."""
    k = max(0, len(w.hash) - window + 1)
    at = np.flatnonzero(w.row[:k] == w.row[window - 1:window - 1 + k])
    rows, hashes = T.ngrams(w, window, short=False)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    r, h = rows[order], hashes[order]
    same = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(w.hash) + 1, np.int32)
    start = at[order[twice]]
    np.add.at(edge, start, 1)
    np.add.at(edge, start + window, -1)
    return np.bincount(w.row[np.cumsum(edge[:-1]) > 0], minlength=n)


def _slice(s: T.Slice) -> dict[str, np.ndarray]:
    n = len(s.offsets) - 1
    w, lines = T.words(s, T.NON_SPACE, lower=False), T.words(s, _NOT_NEWLINE, lower=False)
    at = np.searchsorted(w.start, lines.start)
    holds = np.append(w.start, len(s.data) + 1)[at] < lines.end  # a line with a word
    row, h = lines.row[holds], lines.hash[holds]
    n_lines = np.bincount(row, minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.row, w.end - w.start)
    return ({"n_words": np.diff(w.bounds)} | {c: _per_row(mask[s.data], s.offsets) for c, mask in _CLASSES.items()}
            | {"n_lines": n_lines, "n_dup_lines": n_lines - _distinct(row, h, n), "n_distinct": _distinct(w.row, w.hash, n),
               "n_repeat_words": _repeated(w, WINDOW, n), "longest_word": longest})


def _statistics(batches):
    for batch in batches:
        for s in T.slices(batch.column("text")):
            found = _slice(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, len(s.offsets) - 1), *[pa.array(found[c].astype(np.int64)) for c in STATISTICS]],
                                             ["doc_id", *STATISTICS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of every row's whole text, in one pass; a null text has no
    words.  Words and lines are compared by 64-bit hashes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _statistics, ", ".join(f"{c} long" for c in ("doc_id", *STATISTICS)))


# --- learning -------------------------------------------------------------------------------

def _best(x: np.ndarray, bad: np.ndarray) -> tuple[float, int, bool, float]:
    """(gain, feature, above, threshold) of the condition with the largest FOIL gain; thresholds
    lie half-way between neighbouring values, ties go to the first."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best = (0.0, -1, False, 0.0)
    if not p0 or not n0:
        return best
    before = np.log2(p0 / (p0 + n0))
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, b = x[order, f], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - before), 0.0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = float(gain[i]), f, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)
    return best


def covers(x: np.ndarray, rule) -> np.ndarray:
    """Rows that meet all (feature number, above, threshold)."""
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= x[:, f] > t if above else x[:, f] <= t
    return out


def _worth(x: np.ndarray, bad: np.ndarray, rule) -> float:
    c = covers(x, rule)
    p, n = int((c & bad).sum()), int((c & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def cover(x: np.ndarray, bad: np.ndarray, prunes: np.ndarray, precision: float, least: int) -> list[list[tuple[int, bool, float]]]:
    """Sequential covering: rules for the ``bad`` rows of ``x``; ``prunes`` marks the rows that
    judge a grown rule."""
    out, left = [], np.ones(len(x), bool)
    while len(out) < MAX_RULES:
        grow, judge = left & ~prunes, left & prunes
        rule, inside = [], grow.copy()
        while len(rule) < MAX_CONDITIONS:
            gain, f, above, t = _best(x[inside], bad[inside])
            if f < 0:
                break
            rule.append((f, above, t))
            inside &= covers(x, rule[-1:])
        if not rule:
            break
        best = max(range(len(rule), 0, -1), key=lambda n: _worth(x[judge], bad[judge], rule[:n]))
        rule = rule[:best]
        c = covers(x, rule) & judge
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        if p < least or p < precision * (p + n):
            break
        out.append(rule)
        left &= ~covers(x, rule)
    return out


def _learn(rows: pd.DataFrame, names: list[str], precision: float, least: int) -> pd.DataFrame:
    rows = rows.sort_values(["at", *names]).reset_index(drop=True)
    x, bad = rows[names].to_numpy(float), rows["label"].to_numpy(int) == 0
    found = cover(x, bad, rows["at"].to_numpy(np.int64) % FOLDS == 0, precision, least)
    flat = [(i, names[f], above, t) for i, rule in enumerate(found) for f, above, t in rule]
    return pd.DataFrame(flat, columns=["rule", "feature", "above", "threshold"])


def learn(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, precision: float = PRECISION, least: int = COVER) -> Rules:
    """Rules from ``stats`` (see :func:`statistics`) and ``labels`` (doc_id, quality: 1 good, 0
    bad).

    Labels that are null, other numbers or contradict each other are left out; at most
    ``fit_rows`` documents of each label take part, chosen by a hash, those with one id once.
    With one label or none there are no rules.
    """
    clean = (labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL")
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other"))
    n = {r["label"]: r["n"] for r in clean.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Rules([])
    # 0.9: the share keeps fewer than fit_rows rows of each label
    share = F.when(F.col("label") == 1, min(1.0, 0.9 * fit_rows / n[1]) if n[1] > fit_rows else 1.0).otherwise(min(1.0, 0.9 * fit_rows / n[0]) if n[0] > fit_rows else 1.0)
    at = F.pmod(F.xxhash64(F.lit("rules"), "doc_id"), F.lit(1 << 30))
    sample = clean.withColumn("at", at).filter(F.col("at") < share * (1 << 30))
    names = list(features())
    rows = (stats.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label", "at")  # at most 2 * fit_rows rows of three numbers
            .agg(F.min(F.struct(*STATISTICS)).alias("s")).select("label", "at", "s.*"))
    found = (rows.select("label", "at", *[c.alias(f) for f, c in features().items()]).withColumn("one", F.lit(0)).groupBy("one")
             .applyInPandas(lambda g: _learn(g, names, precision, least), "rule int, feature string, above boolean, threshold double").collect())
    rules: dict[int, list[Condition]] = {}
    for r in found:
        rules.setdefault(r["rule"], []).append(Condition(r["feature"], r["above"], r["threshold"]))
    return Rules([tuple(rules[i]) for i in sorted(rules)])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, **options) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule,
    held_out of every row of ``docs``.

    A row is kept if the base rules hold and no learned rule covers it; ``rule`` is the first that
    does.  Rules are learned from labels whose crc32(doc_id as text) modulo ``folds`` isn't
    ``held``.  A null or empty text has no words and fails the base; a null doc_id isn't held
    out; repeated rows are judged alike; extra columns are ignored; no rows give none.
    """
    out = F.crc32(F.col("doc_id").cast("string")) % folds == held
    stats = written(statistics(docs), "statistics")
    found = learn(stats, labels.filter(~out), **options)
    return stats.withColumns({"base_failed": base_failed(), "rule": found.first(), "held_out": F.coalesce(out, F.lit(False))}).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule", "held_out")
