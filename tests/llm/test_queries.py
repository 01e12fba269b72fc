"""Registered queries and the pipeline on the smallest tables, against brute force."""

import hashlib
import math
import zlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
import corpus_pipeline
import helpers as H
from conftest import SF_SMALL
from pondus.llm import decontam, license_scan, pii

DOCS = pd.read_parquet(f"{SF_SMALL}/documents.parquet")
TEXT = dict(zip(DOCS.doc_id, DOCS.text))


def run(spark, name):
    return {r[0]: r for r in E.queries()[name](spark, SF_SMALL).collect()}


def test_every_operator_and_the_pipeline_are_registered():
    names = list(E.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "mixing sources to target weights"]


@pytest.mark.parametrize("name", ["op6_exact_topk", "op7_mixing", "op10_warc"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    want = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    got = E.queries()[name](spark, SF_SMALL)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_language_query(spark):
    got = run(spark, "op1_language_id")
    lang = dict(zip(DOCS.doc_id, DOCS.lang))
    assert set(got) == set(TEXT)
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in got)
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) / len(held) > 0.95


def test_license_query(spark):
    got = run(spark, "op2_license_scan")
    for i, text in TEXT.items():
        w = H.alnum_words(text)
        places = sorted(k for p in license_scan.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(places))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((places[0], places[-1]) if places else (None, None))


def test_join_query(spark):
    got = run(spark, "op3_ngram_jaccard_join")
    sets = {i: H.shingles(t) for i, t in TEXT.items()}
    assert {i: r["component_id"] for i, r in got.items()} == H.components(sets)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_quality_query(spark):
    got = run(spark, "op4_quality_classifier")
    labels = pd.read_parquet(f"{SF_SMALL}/labels.parquet")
    held = [(i, q) for i, q in zip(labels.doc_id, labels.quality) if got[i]["held_out"]]
    assert set(got) == set(TEXT) and sum(got[i]["predicted"] == q for i, q in held) / len(held) > 0.85


def test_pii_query(spark):
    got = run(spark, "op5_pii")
    for i, text in TEXT.items():
        base = H.base_pii(text)
        assert got[i]["base_sha256"] == H.base_sha(base) and got[i]["n_email"] == sum(k == 0 for _, k, _ in base)


def test_chat_query(spark):
    rows = E.queries()["op8_chat_formatting"](spark, SF_SMALL).collect()
    assert len(rows) == len(pd.read_parquet(f"{SF_SMALL}/conversations.parquet"))


def _brute_items(text, items):
    """Items whose question and answer n-grams a passage of the text holds by half."""
    w, found = H.alnum_words(text), set()
    for item, t in items:
        size = decontam.window_of(len(H.alnum_words(t)))
        parts = [H.alnum_words(p) for p in decontam.parts_of(t)]
        for a in range(0, max(1, len(w) - size // 2), size // 2):
            p = w[a:a + size]
            if all(not x or sum(any(p[k:k + n] == list(g) for k in range(len(p))) for g in grams) / len(grams) >= decontam.OVERLAP
                   for x in parts for n in [min(decontam.GRAM, len(x))] for grams in [{tuple(x[k:k + n]) for k in range(len(x) - n + 1)}]):
                found.add(item)
    return found


def test_decontamination_query(spark):
    items = pd.read_parquet(f"{SF_SMALL}/benchmark.parquet")
    items = list(zip(items.item_id, items.text))
    got = {}
    for r in E.queries()["op9_decontamination"](spark, SF_SMALL).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    for i, text in TEXT.items():
        planted = {k for k, t in items if t in text}
        assert planted <= got.get(i, set())
        if got.get(i, set()) - planted:
            assert got[i] - planted <= _brute_items(text, items)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = stage(spark, docs, SF_SMALL)
        docs = corpus_pipeline.written(docs, "test")
        out[name] = before, docs.toPandas()
    labels = pd.read_parquet(f"{SF_SMALL}/labels.parquet")
    before, after = out["quality classifier"]
    assert list(after.columns) == list(before.columns)
    good = set(labels[labels.quality == 1].doc_id)
    assert len(good & set(after.doc_id)) >= 0.98 * len(good) and len(after) < len(before)
    before, after = out["n-gram Jaccard join"]
    assert set(after.doc_id) == set(H.components({i: H.shingles(t) for i, t in zip(before.doc_id, before.text)}).values())
    before, after = out["benchmark decontamination"]
    items = pd.read_parquet(f"{SF_SMALL}/benchmark.parquet")
    items = list(zip(items.item_id, items.text))
    planted = {i for i, t in zip(before.doc_id, before.text) if any(x in t for _, x in items)}
    gone = set(before.doc_id) - set(after.doc_id)
    assert planted <= gone and all(_brute_items(TEXT[i], items) for i in gone - planted)
    before, after = out["PII"]
    assert list(after.columns) == list(before.columns) and set(after.doc_id) == set(before.doc_id)
    clean = dict(zip(after.doc_id, after.text))
    for i, t, n in zip(after.doc_id, after.text, after.n_chars):
        assert not H.base_pii(t) and n == len(t)
        if not H.base_pii(TEXT[i]):
            assert t == TEXT[i]
    assert any(pii.TAGS["email"] in t for t in clean.values()) or not any("@" in t for t in before.text)
    before, after = out["mixing sources to target weights"]
    size = before.assign(c=before.text.str.len()).groupby("source").c.sum()
    want = {}
    for i, s in zip(before.doc_id, before.source):
        rate = size.sum() / len(size) / size[s]
        parts = max(1, math.ceil(rate / 16))
        n = 0
        for part in range(1, parts + 1):
            u, mean = int(hashlib.md5(f"17|{i}|{part}".encode()).hexdigest()[:13], 16) / 2**52, rate / parts
            term = cum = math.exp(-mean)
            while cum <= u:
                n += 1
                term *= mean / (n if parts == 1 else n)
                cum += term
        if n:
            want[i] = n
    assert after.doc_id.value_counts().to_dict() == want
    assert list(after.columns)[:5] == list(before.columns)
