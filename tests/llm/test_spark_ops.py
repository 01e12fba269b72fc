"""The operators on small tables against brute force, and on awkward input."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

import helpers as H
from conftest_llm import DOCS, awkward, docs_of, near_copies
from pondus.llm import chat, decontam, langid, license_scan, mixing, ngram_join, pii, quality, topk, warc
from pondus.llm._spark import connected_components


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("listed", [2, 8])
def test_near_duplicates_agree_with_all_pairs(spark, listed, monkeypatch):
    monkeypatch.setattr(ngram_join, "LISTED", listed)
    texts = near_copies()
    sets = {i: H.shingles(t) for i, t in texts.items()}
    want = H.components(sets)
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs_of(spark, texts)).collect()}
    assert kept == set(want.values())


@pytest.mark.parametrize("tile, rows, listed, term", [(ngram_join.TILE_BYTES, ngram_join.ROWS, ngram_join.LISTED, ngram_join.TERM_BYTES), (4000, 7, 3, 32), (1 << 20, 5, 2, 0), (1 << 20, 9, 2, 4)])
def test_number_of_links_agrees_with_all_pairs(spark, tile, rows, listed, term, monkeypatch):
    monkeypatch.setattr(ngram_join, "LISTED", listed)
    monkeypatch.setattr(ngram_join, "TERM_BYTES", term)
    monkeypatch.setattr(ngram_join, "TILE_BYTES", tile)
    monkeypatch.setattr(ngram_join, "ROWS", rows)
    rng = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    texts = near_copies()
    for i in range(60):  # a large group of near copies, not all of which link
        copy = list(base)
        for k in rng.sample(range(len(copy)), rng.randint(0, 3)):
            copy[k] = f"r{rng.randrange(9999)}"
        texts[1000 + i] = " ".join(copy)
    sets = {i: H.shingles(t) for i, t in texts.items()}
    other = set(sets.values()) - {frozenset()}
    want = {i: sum(x != s and 100 * len(x & s) >= 75 * len(x | s) for x in other) if s else 0 for i, s in sets.items()}
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == want and max(want.values()) > 20


def test_near_duplicates_on_awkward_rows(spark):
    rows = ngram_join.near_duplicates(awkward(spark)).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == awkward(spark).count()
    assert all(r["component_id"] == 1 for r in by_id[1] + by_id[2])  # equal texts, one of them twice
    assert by_id[3][0]["n_shingles"] == 0 and by_id[3][0]["component_id"] == 3
    assert by_id[4][0]["component_id"] == 4 and by_id[5][0]["component_id"] == 5  # empty texts don't link
    assert by_id[None][0]["component_id"] == 1
    kept = ngram_join.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and r["doc_id"] < 6) == [1, 3, 4, 5]
    assert ngram_join.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_language_identification(spark):
    texts = {i: t for i, t in enumerate(DOCS["en"] * 12 + DOCS["de"] * 12)}
    langs = {i: "en" if i < 12 * len(DOCS["en"]) else "de" for i in texts}
    rows = [(i, f"{t} {i}", langs[i]) for i, t in texts.items()] + [(1000, None, "en"), (1001, "", "de"), (1002, "12 .. !", "en"), (1003, "the and of", None), (None, "the and", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i in texts:
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert by[i]["lang_pred"] == langs[i] and 0 <= by[i]["score"] <= 1
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["lang_pred"] == "en"
    assert by[None]["held_out"] is False
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_a_strange_text_is_rejected(spark):
    rows = [(i, f"{t} {i}", "en") for i, t in enumerate(DOCS["en"] * 20)] + [(999, "ψχω ζξθ φγη ψψχ ωωζ " * 20, None)]
    got = {r["doc_id"]: r["rejected"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[999] and not got[1]


def test_license_scan(spark):
    texts = {1: "x Under the MIT License y under-the mit license", 2: None, 3: "", 4: "Licensed under the Apache License, Version 2.0 (the License)",
             5: "Permission is granted, free of charge, hereby, to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without restriction",
             6: "nothing at all " * 50, 7: "CC BY NC cc by-nc", 8: "under the mit licensed"}
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    for i, t in texts.items():
        w, places = H.alnum_words(t), []
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            places += [(k, label) for k in range(len(w)) if w[k:k + len(p)] == p]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert r["first_word"] == min((k for k, _ in places), default=None) and r["last_word"] == max((k for k, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[5]["labels"] == "mit" and got[5]["n_base"] == 0 and got[5]["score"] >= 0.8
    assert got[6]["labels"] == "" and got[6]["score"] == 0
    assert license_scan.scan(awkward(spark)).count() == awkward(spark).count()
    assert license_scan.scan(awkward(spark).limit(0)).count() == 0


def _labelled(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(DOCS["en"]).split()[:rng.randint(5, 30)]) + f" {i}" for i in range(150)]
    bad = [" ".join(x + rng.choice(["%%%", "$$$"]) for x in rng.choice(DOCS["en"]).split()) for i in range(150)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(1000, None), (1001, ""), (None, "some words")]
    labels = [(i, 1 if i < 150 else 0, 0) for i in range(300)] + [(1000, None, 0), (5, 0, 0), (None, 1, 0), (7777, 1, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(0)).withColumn("score", F.lit(9.0)),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_quality_classifier(spark):
    docs, labels = _labelled(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 303
    got = {r["doc_id"]: r for r in rows}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in held) for i in range(300))
    assert sum(got[i]["predicted"] == (i < 150) for i in held) / len(held) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    assert got[1000]["score"] == got[1001]["score"] is not None
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["predicted"])
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_pii_base_columns(spark):
    texts = {1: "a@b.co and 1.2.3.4 and 4111 1111 1111 1111 +1 (377) 555-0271 éé c.d@x.org", 2: None, 3: "", 4: "clean text only", 5: "🙂 a@b.co"}
    got = {r["doc_id"]: r for r in pii.find(docs_of(spark, texts)).collect()}
    for i, t in texts.items():
        base = H.base_pii(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in base) for j in range(4)]
        assert got[i]["base_sha256"] == H.base_sha(base)
    assert pii.find(awkward(spark)).count() == awkward(spark).count()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs_of(spark, texts)).collect()}
    assert clean[5] == "🙂 [EMAIL]" and clean[4] == texts[4] and clean[2] is None and clean[3] == ""


@pytest.mark.parametrize("rows", [pii.BROADCAST_ROWS, 0])
def test_pii_disclosing_terms_agree_with_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = {}
    for i in range(400):
        w = [rng.choice(vocabulary) for _ in range(30)]
        if i % 40 == 0:  # a name that appears near one address only
            w[10:10] = ["Quillon", "anna@x.org"]
        elif i % 7 == 0:
            w[5:5] = [f"p{i % 3}@y.org"]
        texts[i] = " ".join(w)
    texts |= {500 + k: texts[7] for k in range(5)}  # copies prove nothing
    docs = docs_of(spark, texts)
    n = len(texts)
    contexts = {}
    for t in texts.values():
        w = t.split()
        for k, x in enumerate(w):
            if "@" in x:
                near = w[max(0, k - pii.CONTEXT):k] + w[k + 1:k + 1 + pii.CONTEXT]
                contexts.setdefault(x, set()).add(tuple(sorted(y.lower() for y in near if "@" not in y)))
    want = set()
    for e, found in contexts.items():
        for t in {x for c in found for x in c}:
            both = sum(t in c for c in found)
            holds = sum(t in x.lower().split() for x in texts.values())
            if both >= pii.SUPPORT and len(found) < n and math.log(n * both / (len(found) * holds)) / math.log(n / len(found)) >= pii.GENERALISE:
                want.add((e, t))
    assert ("anna@x.org", "quillon") in want
    pairs = pii.disclosing_terms(docs).collect()
    assert len(pairs) == len(want)
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Quillon" not in " ".join(got.values()) and got[1] == texts[1]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert any("drop:" in s or "term:" in s for s in spans.values()) and spans[1] == ""


def _filler(rng, n=30):
    return [f"word{rng.randrange(300)}" for _ in range(n)]


@pytest.mark.parametrize("rows", [pii.BROADCAST_ROWS, 0])
def test_pii_copies_do_not_hide_a_disclosing_name(spark, rows, monkeypatch):
    from pondus.llm import _spark
    monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
    if not rows:
        monkeypatch.setattr(pii, "if_small", lambda df: _spark.if_small(df, 0))
    rng = random.Random(3)
    texts = [" ".join(_filler(rng)) for _ in range(400)]
    for i in range(3):
        texts += [" ".join(_filler(rng, 4) + ["Quillon", "anna@x.org"] + _filler(rng, 4))] * 100
    docs = docs_of(spark, dict(enumerate(texts)))
    assert [r["share"] for r in pii.disclosing_terms(docs).collect()] == [pytest.approx(1.0)]
    assert "Quillon" not in " ".join(r["text"] for r in pii.sanitise(docs).collect())


@pytest.mark.parametrize("rows", [pii.BROADCAST_ROWS, 0])
def test_pii_terms_far_from_the_address(spark, rows, monkeypatch):
    from pondus.llm import _spark
    monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(pii, "ROWS", 50)
    if not rows:
        monkeypatch.setattr(pii, "if_small", lambda df: _spark.if_small(df, 0))
    rng = random.Random(5)
    texts = [" ".join(_filler(rng)) for _ in range(400)]
    for i in range(4):  # the name stands near the address in one text, and far away in all
        texts.append(" ".join((["Quillon"] if not i else []) + ["anna@x.org"] + _filler(rng, 25) + ["QUILLON", "then"] + _filler(rng, 12) + ["quillon"]))
    texts += [" ".join(_filler(rng) + [f"b{i % 9}@y.org", "c@z.org"] + _filler(rng, 5)) for i in range(60)]
    docs = docs_of(spark, dict(enumerate(texts)))
    holders, want = {}, {}
    for t in texts:
        for e in {x for x in t.split() if "@" in x}:
            holders.setdefault(e, []).append({x.lower() for x in t.split() if "@" not in x})
    n, holds = len(texts), [set(t.lower().split()) for t in texts]
    for e, found in holders.items():
        for t in set().union(*found):
            both, any_ = sum(t in f for f in found), sum(t in h for h in holds)
            share = math.log(n * both / (len(found) * any_)) / math.log(n / len(found))
            if both >= pii.SUPPORT and share >= 0.3:
                want[pii._entity(0, e), t] = share
    got = [r["share"] for r in pii.disclosing_terms(docs, generalise=0.3).collect()]
    assert len(want) > 2 and sorted(got) == pytest.approx(sorted(want.values()))
    clean = " ".join(r["text"] for r in pii.sanitise(docs).collect()).lower()
    assert "quillon" not in clean and "then" not in clean.split() and "@" not in clean


def test_pii_numbers_disclose_like_names(spark):
    rng = random.Random(6)
    texts = [" ".join(_filler(rng)) for _ in range(300)]
    texts += [" ".join(_filler(rng, 9) + ["staff", "447120", "anna@x.org"] + _filler(rng, 9)) for _ in range(4)]
    docs = docs_of(spark, dict(enumerate(texts)))
    terms = {r["term"] for r in pii.disclosing_terms(docs).collect()}
    assert len(terms) == 2  # staff and the number; no digits of the span itself
    assert "447120" not in " ".join(r["text"] for r in pii.sanitise(docs).collect())


def test_license_blocks_of_every_place(spark):
    label, words = license_scan.TEMPLATES[4]
    filler = [f"f{i}" for i in range(400)]
    text, starts = [], []
    for _ in range(50):
        text += filler
        starts.append(len(text))
        text += words.split()
    r = license_scan.scan(docs_of(spark, {1: " ".join(text), 2: " ".join(words.split() * 20)})).collect()
    blocks = [b for b in r[0]["blocks"] if b["label"] == label]
    assert len(blocks) == 50 and all(b["first_word"] <= a and b["end_word"] >= a + len(words.split()) and b["containment"] == 1 for a, b in zip(starts, blocks))
    assert [(b["first_word"], b["end_word"]) for b in r[1]["blocks"]] == [(0, 20 * len(words.split()))]
    assert r[0]["labels"] == r[1]["labels"] == label and r[0]["score"] == 1.0


def test_decontamination_by_items_without_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    items = spark.createDataFrame([(None, a), (None, b), (0, c), (7, None)], "item_id long, text string")
    docs = docs_of(spark, {1: f"x y {a} z {b} {c}", 2: "x y z " * 9, 3: f"p q {b} r"})
    got = [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()]
    assert sorted(got, key=str) == [(1, 0), (1, None), (1, None), (3, None)]
    assert [r["doc_id"] for r in decontam.remove_contaminated(docs, items).collect()] == [2]


def test_exact_topk_agrees_with_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)] + [(2000, None), (2001, [None] * 8), (2050, [float("nan")] * 8), (2100, [float("inf")] + [0.0] * 7), (None, rows[0][1]), rows[50], (2150, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    valid = {}
    for r in table.collect():
        if r["vec_id"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"]):
            valid[r["vec_id"]] = [math.floor(256 * x) for x in r["embedding"]]
    want = set()
    for q in valid:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(valid[q], v)), i) for i, v in valid.items() if i != q))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = topk.search(table, F.col("vec_id") % 50 == 0, cell_bytes=4000).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(table.limit(3), F.col("vec_id") % 50 == 0).count() == 2


def test_mixing_hits_its_weights(spark):
    rows = [(i, "x" * 100, "big" if i % 3 else "small") for i in range(6000)] + [(9000, None, "small"), (9001, "", None), (9002, "yy", None), (None, "abc", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("clash"))
    got = mixing.mix(docs, {"big": 1.0, "small": 3.0}, total=800_000.0).collect()
    size = {}
    for r in got:
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"] or "")
    assert set(size) == {"big", "small"} and abs(size["small"] / 600_000 - 1) < 0.05 and abs(size["big"] / 200_000 - 1) < 0.05
    counts = {}
    for r in got:
        counts.setdefault(r["doc_id"], []).append(r["copy"])
        assert r["n_copies"] >= 1
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in counts.values())
    mean = sum(len(c) for i, c in counts.items() if i is not None and i < 6000 and i % 3 == 0) / 2000
    assert abs(mean - 3) < 0.15
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_with_large_rates_and_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x", "s") for i in range(200)], "doc_id long, text string, source string")
    few = sorted(map(str, mixing.mix(docs, total=200 * 150.0).collect()))
    assert abs(len(few) / 200 - 150) < 5
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs, total=200 * 150.0).collect())) == few


def test_reply_order_links_quotations(spark):
    rows = [(1, 0, "user", "What is a fox?\nIt  runs."), (1, 1, "assistant", "An animal."), (1, 2, "user", "> an animal.\nWhich one?"),
            (1, 3, "assistant", ">> An animal.\n> Which one?\n\nA canine."), (1, 4, "user", "> it runs.\nDoes it?"), (1, 5, "user", "> unknown line\nHm"),
            (1, 6, "user", None), (1, 7, "user", "> An animal.\nagain"), (2, 0, "user", "> What is a fox?"), (None, 1, "user", "> x"), (3, None, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("line", F.lit(1))
    got = chat.reply_order(table).collect()
    assert len(got) == len(rows)
    one = {r["turn"]: r for r in got if r["conv_id"] == 1}
    assert {t: r["parent_turn"] for t, r in one.items()} == {0: None, 1: None, 2: 1, 3: 2, 4: 0, 5: None, 6: None, 7: 1}
    assert {t: (r["thread_turn"], r["depth"]) for t, r in one.items()} == {0: (0, 0), 1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (0, 1), 5: (5, 0), 6: (6, 0), 7: (1, 1)}
    assert one[3]["text"] == "A canine." and one[3]["n_quotes"] == 2 and one[3]["n_linked"] == 2
    order = [r["turn"] for r in sorted(one.values(), key=lambda r: (r["thread_turn"], r["turn"]))]
    assert order == [0, 4, 1, 2, 3, 7, 5, 6]
    assert one[6]["text"] is None and one[5]["text"] == "Hm" and one[5]["n_linked"] == 0
    assert chat.reply_order(table.limit(0)).count() == 0


def test_reply_order_latest_source_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(chat, "BUCKET", 4)
    rng = random.Random(6)
    rows, want = [], {}
    lines = ["aa", "bb", "cc"]
    for t in range(60):
        own, quoted = rng.choice([*lines, "zz"]), rng.choice([*lines, None])
        rows.append((1, t, "user", (f"> {quoted}\n" if quoted else "") + own))
        want[t] = max((u for u in range(t) if quoted and rows[u][3].split("\n")[-1] == quoted), default=None)
    got = chat.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["turn"]: r["parent_turn"] for r in got} == want
    roots = {}
    for t in range(60):
        roots[t] = t if want[t] is None else roots[want[t]]
    assert {r["turn"]: r["thread_turn"] for r in got} == roots


def test_contaminated_documents(spark):
    items = [(1, "Where does the quick fox run today. It runs over the lazy brown dog."), (2, "alpha beta gamma delta epsilon. zeta eta theta."), (3, None), (4, ""), (None, "x y z")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    filler = "some other words that are plain " * 30
    texts = {1: filler + items[0][1] + filler, 2: items[1][1].upper(), 3: filler, 4: None, 5: "", 6: filler + items[0][1] + items[1][1], 7: "the quick fox"}
    found = decontam.contaminated(docs_of(spark, texts), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 2), (6, 1), (6, 2)}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(spark, texts), benchmark).collect()} == {(1, 1), (2, 2), (6, 1), (6, 2)}
    left = decontam.remove_contaminated(docs_of(spark, texts), benchmark)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 7] and left.columns == docs_of(spark, texts).columns
    assert decontam.contaminated(docs_of(spark, texts), benchmark.limit(0)).count() == 0
    assert decontam.contaminated(docs_of(spark, texts).limit(0), benchmark).count() == 0
    parts = decontam.indexes(benchmark, part_bytes=20)
    assert len(parts) > 1 and sum(len(b.ids) for x in parts for b in x.blocks) == 3  # one without an id


def test_warc_archives(spark, tmpdir_path):
    rows = [(1, "http://a/1", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (3, None, "<p>same</p>"), (2, "u", None), (4, "u", ""), (6, "u", "ünï" * 1000), (None, "u", "<p>same</p>"), (7, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    segments = warc.write_archives(pages, segment=500)
    got = {r["page_id"]: r for r in warc.read_archives(segments).collect()}
    assert len(got) == len(rows) and all(r["error"] is None for r in got.values())
    for page, _, html in rows:
        data = (html or "").encode()
        assert got[page]["payload_bytes"] == len(data) and got[page]["payload_digest"] == warc.digest(data)
    assert {p: (r["record_type"], r["refers_to"]) for p, r in got.items()} == {
        1: ("revisit", 5), 5: ("response", None), 3: ("revisit", 5), 2: ("revisit", 4), 4: ("response", None), 6: ("response", None), None: ("revisit", 5), 7: ("response", None)}
    least = {r["page_id"]: r["record_type"] for r in warc.read_archives(warc.write_archives(pages, least=5)).collect()}
    assert least[2] == least[4] == "response" and least[1] == "revisit"
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    files = warc.export(segments, tmpdir_path).collect()
    assert len(files) == segments.count()
    assert sorted(map(str, warc.read_files(spark, tmpdir_path).collect())) == sorted(map(str, warc.read_archives(segments).collect()))


def test_quoted_passages_are_linked_however_their_lines_break(spark):
    a = "The fox runs over the hill and sleeps under a tree.\nIt wakes at noon."
    b = "First paragraph of the answer, rather long as it is.\n\nSecond paragraph, which someone quotes."
    rows = [(1, 0, "u", a), (1, 1, "u", b), (1, 2, "u", "It wakes at noon."),
            (1, 3, "u", "> the fox runs over the hill\n> and sleeps under a tree. It\n> wakes at noon.\nWhy?"),  # the whole of 0, broken anew
            (1, 4, "u", "> Second paragraph, which\n> someone quotes.\nWho?"),  # a paragraph of 1
            (1, 5, "u", ">> The fox runs over the hill and sleeps under a tree.\n>> It wakes at noon.\n> Why?\nBecause."),  # nested: 3, not 0
            (1, 6, "u", "> The fox runs over the hill and sleeps under a tree.\n> It wakes at noon.\nAgain"),  # the passage is of 0, its last line of 2 too
            (1, 7, "u", "> It wakes at noon.\n> Because.\nTwo sources"),  # lines of different messages, the latest of equals
            (1, 8, "u", "> nobody wrote this\nHm")]
    got = {r["turn"]: r for r in chat.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: r["parent_turn"] for t, r in got.items()} == {0: None, 1: None, 2: None, 3: 0, 4: 1, 5: 3, 6: 0, 7: 5, 8: None}
    assert [got[t]["text"] for t in (3, 4, 5)] == ["Why?", "Who?", "Because."] and [got[t]["n_quotes"] for t in (3, 5, 8)] == [1, 2, 1]
    assert [got[t]["n_linked"] for t in (3, 6, 7, 8)] == [0, 2, 2, 0]


def test_names_that_clash_with_helpers(spark, monkeypatch):
    names = ("_source", "_parts", "_cdf", "_salt", "_own", "_keep", "_id", "_key", "pair", "drop", "key")
    rows = [(i, f"mail bob{i % 3}@x.org about ticket 77{i % 3} now please, it is number {i} of them all", "s") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({n: F.lit(n) for n in names})
    assert mixing.mix(docs).columns == [*docs.columns, "copy", "n_copies", "shuffle_key"] and mixing.mix(docs).count() >= 0
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert mixing.mix(docs).filter("_source = '_source' AND _own = '_own'").count() == mixing.mix(docs).count()
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("_keep = '_keep'").count() == kept.count() > 0
    want = sorted(map(tuple, pii.sanitise(docs).collect()))
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == want


def test_repeated_ids_do_not_multiply_the_training_rows(spark):
    rows = [(i, f"{'good words here' if i % 2 else 'bad $$$ ###'} {i} {j}") for i in range(20) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    seen = []
    train = quality._train
    quality._train = lambda g, *a: (seen.append(len(g)), train(g, *a))[1]
    try:
        model = quality.fit(docs.coalesce(1), labels, fit_rows=50)
    finally:
        quality._train = train
    assert model.weight.any()
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model, F.lit(False)).collect()}
    assert all((s > 0.5) == (i % 2 == 1) for i, s in scores.items())
