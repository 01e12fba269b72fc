"""Functions of the operators that need no Spark."""

import gzip

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import helpers as H
from pondus.llm import chat, decontam, license_scan, pii, topk, warc

PIECES = st.lists(st.sampled_from(["a@b.co", "x.y@z-1.org.", "@", "a@b", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "0012-",
                                   "+1 (377) 555-0271", "+49", "+", "é", " ", ".", "-", "7", "(", "..", "word", "😀", "0445617099674829", "\n"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_base_spans_agree_with_plain_patterns(text):
    assert [(a, k, b) for a, k, b, _ in pii.base_spans(text)] == H.base_pii(text)


def test_base_spans_are_linear_in_long_runs():
    assert pii.base_spans("a" * 300_000 + " b@c " + "1" * 300_000 + "." * 10) == []
    assert len(pii.base_spans("a" * 100_000 + "@b.co")) == 1


def test_sanitised_replaces_overlaps_once():
    text = "mail a@b.co now"
    assert pii.sanitised(text, [(5, 11, "email"), (7, 15, "term")]) == "mail [EMAIL]"
    assert pii.sanitised(text, []) == text


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6), st.integers(1, 97))
def test_warc_round_trip(payloads, piece):
    stream = b"".join(warc.record(i, f"http://h/{i} ä\r\n", p) for i, p in enumerate(payloads)) + warc.record(9, None, payloads[0], refers_to=0, revisit=True)
    assert gzip.decompress(stream).startswith(b"WARC/1.1\r\n")
    got = list(warc.read_records(stream[i:i + piece] for i in range(0, len(stream), piece)))
    assert [r.error for r in got] == [None] * (len(payloads) + 1)
    assert [r.payload() for r in got[:-1]] == payloads
    assert got[-1].headers["warc-type"] == "revisit" and got[-1].payload() == b""
    assert got[-1].headers["warc-refers-to"] == got[0].headers["warc-record-id"]


def test_warc_faults_are_reported():
    import zlib
    good = warc.record(1, "u", b"hello")
    text = gzip.decompress(good)
    pack = lambda b: gzip.compress(b)
    assert [r.error for r in warc.read_records([pack(text.replace(b"hello", b"hallo"))])] == ["block digest"]
    assert [r.error for r in warc.read_records([pack(text[:-3])])] == ["the block doesn't have its Content-Length"]
    assert [r.error for r in warc.read_records([pack(b"junk")])] == ["no WARC header"]
    assert [r.error for r in warc.read_records([good, good[:-5]])][1].startswith("gzip: the stream ends")
    assert [r.error for r in warc.read_records([good, b"xx"])][1].startswith("gzip")
    assert list(warc.read_records([])) == []
    assert zlib  # the reader's decompressor


def test_chat_parse_levels():
    own, passages = chat.parse("hi\n> one\n> two\n>> deep\n> > deep too\n>three\nbye")
    assert own == "hi\nbye"
    assert passages == [(1, "one\ntwo"), (2, "deep\ndeep too"), (1, "three")]
    assert chat.parse("no quotes\n\n\n\nhere") == ("no quotes\n\n\n\nhere", [])
    assert chat.line_hashes(" A  b\n\na B ") == chat.line_hashes("a b")


def test_decontam_index_finds_planted_items_only():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, f"{prose(rng.integers(8, 40))}. {prose(rng.integers(4, 12))}.") for i in range(150)]
    index = _index(items)
    import pyarrow as pa

    from pondus.llm import _text as T
    docs = [prose(500) for _ in range(60)]
    planted = {}
    for d in range(0, 60, 3):
        item = items[int(rng.integers(150))]
        at = int(rng.integers(400))
        w = docs[d].split()
        docs[d] = " ".join(w[:at] + [item[1].upper()] + w[at:])
        planted[d] = item[0]
    found = {}
    for s in T.slices(pa.array([*docs, "", None])):
        for row, item, *_ in index.search(T.words(s, T.ALNUM)):
            found.setdefault(s.first + row, set()).add(item)
    assert found == {d: {i} for d, i in planted.items()}


def _index(items, **options):
    from collections import Counter
    frequency = Counter(int(t) for _, x in items for t in np.unique(decontam._hashes(x)))
    return decontam.Index(items, frequency, len(items), 30.0, **options)


def test_bounds_never_discard_what_brute_force_retrieves():
    """Block-max bounds against scores of every passage with every item."""
    import pyarrow as pa

    from pondus.llm import _text as T
    rng = np.random.default_rng(5)
    vocabulary = [f"t{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(3, 9))) + ". " + " ".join(rng.choice(vocabulary, 3))) for i in range(40)]
    index = _index(items, block=7, overlap=0.0, ratio=0.7)
    docs = [" ".join(rng.choice(vocabulary, rng.integers(1, 90))) for _ in range(30)]
    (s,) = T.slices(pa.array(docs))
    w = T.words(s, T.ALNUM)
    got = {(r, i) for r, i, *_ in index.search(w)}
    want = set()
    for r in range(len(docs)):
        h = w.hash[w.bounds[r]:w.bounds[r + 1]]
        for b in index.blocks:
            step, n = b.window // 2, len(h)
            for p in range(max(1, -(-(n - b.window) // step) + 1)):
                have = np.flatnonzero(np.isin(b.vocabulary, h[p * step:p * step + b.window]))
                score = np.zeros(len(b.ids))
                for v in have:
                    for k in range(b.start[v], b.start[v + 1]):
                        score[b.item[k]] += b.impact[k]
                want |= {(r, b.ids[k][1]) for k in np.flatnonzero(score >= b.need)}
    assert got == want and want


def test_an_item_is_found_alike_alone_and_among_others():
    """Its passages have its own length, whatever the other items are."""
    import pyarrow as pa

    from pondus.llm import _text as T
    item = (1, "red fox jumps. blue moon rises")
    others = [(k + 2, " ".join(f"w{k}x{i}" for i in range(n)) + ". end") for k, n in enumerate((3, 9, 40, 200))]
    frequency = {int(t): 1 for _, x in [item, *others] for t in np.unique(decontam._hashes(x))}
    filler = lambda n: " ".join(f"f{i}" for i in range(n))
    texts = [item[1], f"red fox jumps. {filler(60)} blue moon rises", f"{filler(31)} {item[1]} {filler(90)}", f"red fox jumps {filler(3)} blue moon rises"]
    (s,) = T.slices(pa.array(texts))
    w = T.words(s, T.ALNUM)
    found = []
    for items in ([item], [item, *others], [*others[:2], item], [*others, item]):
        for block in (1, 2, 64):
            index = decontam.Index(items, frequency, 5, 30.0, block=block)
            found.append([(r, *x) for r, i, *x in index.search(w) if i == 1])
    assert all(f == found[0] for f in found) and {f[0] for f in found[0]} == {0, 2, 3}
    assert [decontam.window_of(n) for n in (1, 8, 9, 12, 13, 16, 40, 100)] == [16, 16, 24, 24, 32, 32, 96, 256]


def test_license_blocks_agree_with_brute_force():
    rng = np.random.default_rng(11)
    templates = [("a", "one two three four five six"), ("b", "two four eight ten twelve"), ("c", "alpha beta")]
    times = dict(zip("one two three four five six eight ten twelve alpha beta".split(), range(11)))
    ordered = []
    for label, text in templates:
        w = sorted(set(text.split()), key=times.get)
        ordered.append(license_scan.Template(label, np.concatenate([license_scan._hashes(x) for x in w]), int(np.ceil(0.8 * len(w) - 1e-9))))
    join = license_scan._Join(ordered, {}, 8)
    for _ in range(300):
        text = rng.choice([*times, "x", "y", "z", "q", "r", "s"], rng.integers(0, 40)).tolist()
        hashes = license_scan._hashes(" ".join(text)) if text else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(join.vocabulary, hashes), len(join.vocabulary) - 1)
        ids = np.where(join.vocabulary[at] == hashes, at, -1)
        got = {(label, round(share, 9)) for label, _, _, share in join.row(ids)}
        want = {}
        for k in range(max(1, -(-(len(text) - 8) // 4) + 1)):
            block = set(text[4 * k:4 * k + 8])
            for (label, t), o in zip(templates, ordered):
                if len(block & set(t.split())) >= o.need:
                    want[label] = max(want.get(label, 0), len(block & set(t.split())) / len(o.words))
        assert got == {(k, round(v, 9)) for k, v in want.items()}


def test_exact_products_beyond_floats():
    a = np.array([[2 ** 40, 1]], np.int64)
    assert topk._exact(a, np.array([[2 ** 21, 3]], np.int64))[0, 0] == 2 ** 61 + 3


@pytest.mark.parametrize("text", ["One two. Three four!", "just words here", "", "Only one sentence."])
def test_question_and_answer_cover_the_item(text):
    q, a = decontam.parts_of(text)
    assert f"{q} {a}".split() == text.split()


def test_labels_do_not_depend_on_other_templates():
    texts = {
        "This package is released under the GPL license": set(),
        "he was released under bond and the license was revoked": set(),
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": {"cc-by"},
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": {"cc-by-nc"},
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license": {"cc-by-sa"},
        "Licensed under the Mozilla license version 2.0": set(),
        "Licensed under the Apache License, Version 2.0": {"apache-2"},
        "It is released, under the MIT license": {"mit"},
    }
    filler = " ".join(f"w{i}" for i in range(70))

    def labels(templates, text):
        ordered = [license_scan.Template(label, words := np.unique(license_scan._hashes(t)), int(np.ceil(0.8 * len(words) - 1e-9)), np.unique(license_scan._hashes(keys)), 2 * len(license_scan._hashes(t)))
                   for label, t, keys in templates]
        join = license_scan._Join(ordered, {})
        h = license_scan._hashes(text)
        at = np.minimum(np.searchsorted(join.vocabulary, h), len(join.vocabulary) - 1)
        return {x[0] for x in join.row(np.where(join.vocabulary[at] == h, at, -1))}

    keyed = [(*t, k) for t, k in zip(license_scan.TEMPLATES, license_scan.KEYS)]
    long = ("other", " ".join(f"v{i}" for i in range(150)), "v1")
    for text, want in texts.items():
        for t in (text, f"{filler} {text} {filler}"):
            assert labels(keyed, t) == want == labels([*keyed, long], t)


def test_long_texts_have_the_features_of_the_whole(monkeypatch):
    import pyarrow as pa

    from pondus.llm import _text as T, quality
    rng = np.random.default_rng(3)
    text = " ".join("".join(rng.choice(list("abcdé \n"), rng.integers(1, 9))) for _ in range(4000)) + " " + "z" * 3000 + " end " + "q" * 500
    (s,) = T.slices(pa.array([text]))

    def features(size):
        monkeypatch.setattr(quality, "_SLICE", size)
        out = np.zeros(quality.BUCKETS, np.int64)
        for rows, buckets in quality._features(s):
            assert (rows == 0).all()
            out += np.bincount(buckets, minlength=quality.BUCKETS)
        return out
    whole = features(1 << 30)
    assert all((features(size) == whole).all() for size in (1, 7, 100, 999, 20_000))
    batch = pa.RecordBatch.from_pydict({"text": ["ab " * 70_000 + "c", "", None], "label": pa.array([1, 0, 0], pa.int32()), "at": [1, 2, 3]})
    monkeypatch.setattr(quality, "_SLICE", 5000)
    bags = [r for b in quality._bags([batch]) for r in b.to_pylist()]
    counts = np.frombuffer(bags[0]["counts"], np.uint32)
    assert counts.max() >= 70_000 and bags[1]["counts"] == bags[2]["counts"] == b""


def test_row_blocks_multiply_exactly(monkeypatch):
    from pondus.llm import ngram_join as J
    rng = np.random.default_rng(9)
    rows = lambda n, most: [np.unique(rng.integers(0, most, rng.integers(1, 60))).astype(np.uint64) for _ in range(n)]
    monkeypatch.setattr(J, "PRODUCT", 50)
    monkeypatch.setattr(J, "COLUMNS", 16)
    for most in (20, 90, 100_000):  # dense, mixed, sparse
        left, right = rows(13, most), rows(9, most)
        got = J._overlap_counts(left, right)
        assert (got == [[len(np.intersect1d(a, b)) for b in right] for a in left]).all()
    label = J._merged(np.arange(8), np.array([0, 1, 2]), np.array([5, 6, 7]), np.array([[1, 0, 0], [1, 1, 0], [0, 0, 1]], bool))
    assert label.tolist() == [0, 0, 2, 3, 4, 0, 0, 2]
