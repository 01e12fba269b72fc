"""Prefix trie against a plain one, and tree contraction on awkward trees."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pondus.llm import trie


def rebuild(rows):
    """conv_id -> its rebuilt turns, rows are (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            k = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, k, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(c / 5) * 5
        out[c] = own.get(c - base, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs, nodes = rebuild(rows), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) if below else 1
        saved[p] = sum(saved[k] for k in below) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-12, 70):
        if rng.random() < 0.15:
            continue
        n = rng.choice([1, 2, 3, 5, 9, 12])
        for t in range(n):
            rows.append((c, t * 3 - 4, rng.choice(["user", "bot", None]), rng.choice(["hello", "", None, "grüße 🙂", "x"]) if rng.random() < 0.8 else f"t{rng.randrange(99)}"))
    rows += [(200, t, "user", f"turn {t}") for t in range(300)]  # a third of all rows
    rows += [(201, None, "user", "b"), (201, None, "user", "a"), (201, 7, "user", "same"), (201, 7, "user", "same"), (202, 1, "user", "y" * 300_000),
             (None, 1, "user", "nobody"), (None, None, None, None), (203, 1, None, None)] + [(204, 1, "user", "again")] * 40
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = conversations(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumns(
        {c: F.lit("z") for c in ("c", "k", "bytes", "n", "pos", "id", "parent", "part", "x1")})
    got = trie.prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1])) == brute(rows)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], df.schema)).count() == 0


def test_turnless_conversations(spark):
    c = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)  # its base is absent, its turns come too early
    rows = [(c, 1, "user", "a")]
    got = [tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == brute(rows)


def test_contraction(spark):
    rng = random.Random(3)
    parent, level = {}, {}
    def chain(start, n):  # noqa: E306
        for i in range(start + 1, start + n):
            parent[i], level[i] = i - 1, level[i - 1] + 1
    parent[0], level[0] = None, 0
    chain(0, 200)
    for i in range(1000, 1200):  # a star, and a random tree below it
        parent[i], level[i] = 150, level[150] + 1
    for i in range(1200, 1500):
        parent[i] = rng.choice([rng.randrange(1000, i), i - 1])
        level[i] = level[parent[i]] + 1
    parent[5000], level[5000] = None, 7  # other roots
    parent[6000], level[6000] = None, 0
    parent[6001], level[6001] = 6000, 1
    value = {i: rng.randrange(-5, 100) for i in parent}
    total, size = dict(value), {i: 1 for i in parent}
    for i in sorted(parent, key=lambda i: -level[i]):
        if parent[i] is not None:
            total[parent[i]] += total[i]
            size[parent[i]] += size[i]
    df = spark.createDataFrame([(i, p, level[i], value[i], 1) for i, p in parent.items()], "id long, parent long, level long, `a.b` long, one long")
    got = {r[0]: (r[1], r[2]) for r in trie.subtree_totals(df, ["a.b", "one"]).collect()}
    assert got == {i: (total[i], size[i]) for i in parent}
    assert trie.subtree_totals(df.limit(0), ["one"]).count() == 0
