"""Quality rules: statistics and rules against plain Python, accuracy on held-out labels."""

import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from conftest_llm import awkward
from pondus.llm import rules as R


def plain(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct)"""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines), len(set(w))


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct"]


def test_statistics(spark):
    texts = ["", None, "a b c d e a b c d e", "a b c d e f a b c d e f", "x " * 40, "one\ntwo\n one\none\n\n\none ", "ä # ü|<\r\nä # ü|<\r\n\r\n\r\n", "é" * 5000 + "\n" + "é" * 5000,
             "a\xa0b c \x0b\x0c\x1c d", " \n \n", "# * $ % & | < >", "Aa Aa Aa Aa Aa aa", "\n".join(f"line {i % 7} of it" for i in range(500)), "t" * 600_000 + " " + "u " * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: tuple(r[c] for c in COLS) for r in R.statistics(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_awkward_rows(spark):
    df = awkward(spark).withColumns({"n_words": F.lit("x"), "rule": F.lit(1), "kept": F.lit(2), "at": F.lit(3), "label": F.lit(4)})
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 0), (3, None), (7, 0), (8, 5)], "doc_id long, quality int").withColumn("n_words", F.lit(9))
    rows = R.judge(df, labels).collect()
    texts = [(r["doc_id"], r["text"]) for r in awkward(spark).collect()]
    want = sorted(((i, *plain(t)[:5]) for i, t in texts), key=repr)
    assert sorted(((r["doc_id"], *[r[c] for c in COLS[:5]]) for r in rows), key=repr) == want
    for r in rows:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["rule"] is None)
    none = df.limit(0)
    assert R.judge(none, labels).count() == 0 and R.judge(df, labels.limit(0)).filter("rule IS NOT NULL").count() == 0


def test_best_condition_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x, bad = rng.integers(0, 6, (40, 3)).astype(float), rng.random(40) < 0.4
        gain, *_ = R._best(x, bad)
        p0, n0 = bad.sum(), (~bad).sum()
        every = [0.0]
        for f in range(3):
            for t in np.arange(0.5, 6):
                for c in (x[:, f] > t, x[:, f] <= t):
                    p, n = (c & bad).sum(), (c & ~bad).sum()
                    if p and 0 < c.sum() < 40:
                        every.append(p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))))
        assert gain == pytest.approx(max(every))


def test_covering_finds_conjunctions_and_prunes_noise():
    rng = np.random.default_rng(6)
    x = rng.random((6000, 4))
    bad = ((x[:, 0] > 0.7) & (x[:, 1] <= 0.3)) | (x[:, 2] > 0.95)
    prunes = np.arange(6000) % 3 == 0
    found = R.cover(x, bad, prunes, 0.95, 3)
    hit = np.zeros(6000, bool)
    for rule in found:
        hit |= R.covers(x, rule)
    assert (hit == bad).mean() > 0.99 and len(found) <= 6
    assert R.cover(x, rng.random(6000) < 0.1, prunes, 0.95, 3) == []  # nothing to learn
    assert R.cover(x, np.zeros(6000, bool), prunes, 0.95, 3) == [] and R.cover(x[:0], bad[:0], prunes[:0], 0.95, 3) == []


def test_expression_is_the_list(spark):
    rows = [(i, *[int(v) for v in np.random.default_rng(i).integers(0, 50, len(R.STATISTICS))]) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("doc_id", *R.STATISTICS)))
    names = list(R.features())
    listed = [[("words", True, 20.0), ("symbols_a_char", False, 0.6)], [("distinct_words", True, 1.5)]]
    found = R.Rules([tuple(R.Condition(*c) for c in rule) for rule in listed])
    x = np.array([list(r) for r in df.orderBy("doc_id").select(*R.features().values()).collect()], float)
    hits = [R.covers(x, [(names.index(f), a, t) for f, a, t in rule]) for rule in listed]
    want = [str(found.rules[0][0]) + " and " + str(found.rules[0][1]) if a else str(found.rules[1][0]) if b else None for a, b in zip(*hits)]
    assert [r[0] for r in df.orderBy("doc_id").select(found.first()).collect()] == want


def test_query(spark):
    docs, labels = pd.read_parquet(f"{SF_SMALL}/documents.parquet"), pd.read_parquet(f"{SF_SMALL}/labels.parquet")
    rows = E.queries()["op12_quality_rules"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    text = dict(zip(docs.doc_id, docs.text))
    got = {r["doc_id"]: r for r in rows}
    assert all(tuple(got[i][c] for c in COLS[:5]) == plain(t)[:5] for i, t in text.items())
    quality = dict(zip(labels.doc_id, labels.quality))
    held = [i for i in quality if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held)
    whole = [i for i in held if not got[i]["base_failed"]]
    assert sum(got[i]["kept"] == (quality[i] == 1) for i in whole) / len(whole) > 0.9
    good = [i for i in whole if quality[i] == 1]
    assert sum(got[i]["kept"] for i in good) / len(good) > 0.97
