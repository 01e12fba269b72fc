"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

Positions and prefixes come from two ordered scans: rows are sorted by ranges of (conversation,
order), so a long conversation is dealt to several tasks; each task counts or hashes along its
part, and the parts of one conversation are put together from one row per part.  A prefix is
known by the XOR of 128-bit hashes of its turns, each salted with its position, so no task
holds a conversation and equal prefixes group whatever conversations they stand in.

Subtree totals: rounds of rake (leaves add their total to their parent, as one grouped sum) and
compress (unary nodes whose neighbours in the chain don't go leave it, their value stays on the
edge), each a join on unique keys, until the root is left.  Then the rounds are walked back:
what left a chain in a round gets its total from the child below, which is known by then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._spark import discard, scratch, written

GROUP, MOST = 5, 9
#: Ids of one piece of a node's list of conversations.
PIECE = 4096
_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


# --- ordered scans --------------------------------------------------------------------------

def _column(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _starts(c: np.ndarray, last: int | None) -> np.ndarray:
    """True where another conversation begins."""
    out = np.ones(len(c), bool)
    out[1:] = c[1:] != c[:-1]
    out[0] = last is None or c[0] != last
    return out


def _count(batches):
    """The turns before each row in its conversation, within this part."""
    last, before, part = None, 0, TaskContext.get().partitionId()
    for batch in batches:
        if not batch.num_rows:
            continue
        c, n = _column(batch, "c"), _column(batch, "n")
        start = _starts(c, last)
        total = np.concatenate(([0], np.cumsum(n)))
        base = np.where(start, total[:-1], 0)  # of the row's conversation: what came before it here
        base = np.maximum.accumulate(np.where(start, base, -1))
        local = np.where(base < 0, total[:-1] + before, total[:-1] - base)
        last, before = int(c[-1]), int(local[-1] + n[-1])
        yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("k"), batch.column("bytes"), batch.column("n"), pa.array(local),
                                          pa.array(np.full(len(c), part, np.int32))], ["c", "k", "bytes", "n", "local", "part"])


def _hash(batches):
    """Prefix hashes with (x) and without (y) each row, within this part."""
    last, carry, part = None, np.zeros(2, np.uint64), TaskContext.get().partitionId()
    for batch in batches:
        if not batch.num_rows:
            continue
        c, pos = _column(batch, "c"), _column(batch, "pos").astype(np.uint64)
        k = np.frombuffer(b"".join(batch.column("k").to_pylist()), np.uint64).reshape(-1, 2)
        start = _starts(c, last)
        row = np.maximum.accumulate(np.where(start, np.arange(len(c)), -1))
        out = [batch.column("c"), batch.column("pos"), batch.column("bytes"), batch.column("ends")]
        for lane in range(2):
            v = T.mix(T.mix(k[:, lane] + _LANES[lane]) + T.mix(pos * _LANES[1 - lane]))
            total = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(v)))
            base = np.where(row < 0, carry[lane], total[np.maximum(row, 0)])  # row < 0: goes on from the last batch
            x = total[1:] ^ base
            carry[lane] = x[-1]
            out += [pa.array(x.view(np.int64)), pa.array((x ^ v).view(np.int64))]
        last = int(c[-1])
        yield pa.RecordBatch.from_arrays([*out, pa.array(np.full(len(c), part, np.int32))], ["c", "pos", "bytes", "ends", "x1", "y1", "x2", "y2", "part"])


def _h(c: str) -> Column:
    return (F.crc32(F.col(c).cast("string")) % MOST).cast("long")


def _base(c: str) -> Column:
    return F.col(c) - F.col(c) % GROUP


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, pos, k, bytes, ends) of every rebuilt turn, and (c, len) of every conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = (conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"), key.alias("k"), F.octet_length(text).cast("long").alias("bytes"))
             .filter("c IS NOT NULL").groupBy("c", "turn", "k").agg(F.max("bytes").alias("bytes"), F.count("*").alias("n")))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("k")]
    local = written(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _count, "c long, k binary, bytes long, n long, local long, part int"), "turns")
    own = Window.partitionBy("c")
    parts = local.groupBy("c", "part").agg(F.sum("n").alias("m")).withColumns({
        "before": F.coalesce(F.sum("m").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("m").over(own)})
    parts = written(parts.select("c", "part", "before", "total"), "parts")
    lengths = parts.groupBy("c").agg(F.max("total").alias("total"))
    taken = F.least(_h("c"), F.coalesce("base_total", F.lit(0)))  # turns that come from the base
    of_base = lengths.select(F.col("c").alias("base"), F.col("total").alias("base_total"))
    parts = parts.withColumn("base", _base("c")).join(of_base, "base", "left").withColumn("taken", taken).drop("base", "base_total")
    rows = (local.join(parts, ["c", "part"]).withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        "c", "k", "bytes", (F.col("rank") + F.col("before") + F.col("local")).alias("rank"), "taken", "total"))
    length = F.col("taken") + F.greatest(F.col("total") - _h("c"), F.lit(0))
    later = rows.filter(F.col("rank") > _h("c")).select("c", (F.col("rank") - _h("c") + F.col("taken")).alias("pos"), "k", "bytes", length.alias("len"))
    convs = lengths.withColumn("base", _base("c")).join(of_base, "base", "left").withColumn("taken", taken).select("c", "base", length.alias("len"))
    heads = rows.filter(F.col("rank") < MOST).select(F.col("c").alias("base"), F.col("rank").alias("pos"), "k", "bytes")
    first = convs.join(heads, "base").filter(F.col("pos") <= _h("c")).select("c", "pos", "k", "bytes", "len")  # at most nine conversations share a base
    return first.unionByName(later).withColumn("ends", F.col("pos") == F.col("len")).drop("len"), convs.select("c", "len")


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, pos, bytes, ends, x1, x2, y1, y2): the hash of every rebuilt prefix and of the one before."""
    local = written(turns.repartitionByRange("c", "pos").sortWithinPartitions("c", "pos").mapInArrow(
        _hash, "c long, pos long, bytes long, ends boolean, x1 long, y1 long, x2 long, y2 long, part int"), "prefixes")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (local.groupBy("c", "part").agg(F.max_by("x1", "pos").alias("x1"), F.max_by("x2", "pos").alias("x2"))
               .withColumns({"o1": F.expr("bit_xor(x1)").over(before), "o2": F.expr("bit_xor(x2)").over(before)}).filter("o1 IS NOT NULL").select("c", "part", "o1", "o2"))
    carried = F.broadcast(carried)  # a part goes on with one conversation at most, so there are no more rows than parts
    add = {f"{v}{i}": F.col(f"{v}{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0))) for v in "xy" for i in (1, 2)}
    return local.join(carried, ["c", "part"], "left").withColumns(add).drop("o1", "o2", "part")


# --- tree contraction -----------------------------------------------------------------------

def subtree_totals(tree: DataFrame, values: Sequence[str]) -> DataFrame:
    """(id, values): for every node of a forest the sums of ``values`` over its subtree.

    ``tree`` has id (unique, any type that joins and orders), parent (an id of the table; null
    at a root), level (a number that differs between neighbours, as the depth does) and
    the values.  Every round takes all leaves, and of a chain of unary nodes those with the
    lowest priority among their neighbours: the fewest trailing zeros of the level, then a hash.
    """
    v, e, c = [f"v{i}" for i in range(len(values))], [f"e{i}" for i in range(len(values))], [f"c{i}" for i in range(len(values))]
    kids = tree.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    state = tree.select("id", "parent", "level", *[F.col(f"`{x}`").alias(y) for x, y in zip(values, v)], *[F.lit(0).cast("long").alias(y) for y in e])
    state = written(state.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0))), "tree")
    used, pieces, spliced = [state], [], []
    while True:
        leaf = (F.col("kids") == 0) & F.col("parent").isNotNull()
        leaves = state.filter(leaf)
        pieces.append(leaves.select("id", *v))
        brought = leaves.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("gone"), *[F.sum(F.col(a) + F.col(b)).alias(x) for a, b, x in zip(v, e, c)])
        raked = written(state.filter(~leaf).join(brought, "id", "left").select(
            "id", "parent", "level", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"),
            *[(F.col(a) + F.coalesce(x, F.lit(0))).alias(a) for a, x in zip(v, c)], *e), "raked")
        used.append(raked)
        inner = raked.filter("parent IS NOT NULL")
        if not inner.limit(1).count():
            break
        only = inner.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("child")).filter("n = 1").select("id", "child")
        unary = written(inner.filter("kids = 1").join(only, "id").withColumn(
            "priority", F.struct(F.col("level").bitwiseAND(-F.col("level")), F.xxhash64("id"), F.col("id"))), "unary")
        below = unary.select(F.col("id").alias("child"), F.col("priority").alias("below"))
        stay = unary.join(below, "child").select(F.when(F.col("priority") < F.col("below"), F.col("child")).otherwise(F.col("id")).alias("id")).distinct()
        going = unary.join(stay, "id", "left_anti")
        above = going.select(F.col("child").alias("id"), F.col("id").alias("via"), F.col("parent").alias("up"), *[F.col(a).alias(x) for a, x in zip(v, c)],
                             *[F.col(b).alias(f"u{b}") for b in e])
        state = written(raked.join(going.select("id"), "id", "left_anti").join(above, "id", "left").select(
            "id", F.coalesce("up", "parent").alias("parent"), "level", "kids", *v, "via",
            *[(F.col(b) + F.col(x)).alias(x) for b, x in zip(e, c)],  # what via holds besides this node's total
            *[(F.col(b) + F.coalesce(F.col(x) + F.col(f"u{b}"), F.lit(0))).alias(b) for b, x in zip(e, c)]), "spliced")
        used += [unary, state]
        spliced.append(state.filter("via IS NOT NULL").select("id", "via", *c))
        state = state.drop("via", *c)
    known = raked.select("id", *v)  # the roots
    for round_ in range(len(spliced) - 1, -1, -1):
        known = known.unionByName(pieces[round_ + 1])
        back = written(spliced[round_].join(known, "id").select(F.col("via").alias("id"), *[(F.col(a) + F.col(x)).alias(a) for a, x in zip(v, c)]), "back")
        used.append(back)
        known = known.unionByName(back)
    out = written(known.unionByName(pieces[0]).select("id", *[F.col(a).alias(x) for a, x in zip(v, values)]), "totals")
    discard(*used)
    return out


# --- the trie -------------------------------------------------------------------------------

def _pieces(batches):
    """Sorted (pos, x1, x2, c): runs of at most PIECE ids of a node, comma-joined."""
    for batch in batches:
        if not batch.num_rows:
            continue
        pos, x1, x2, c = (_column(batch, n) for n in ("pos", "x1", "x2", "c"))
        first = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1]))))
        bounds = np.append(first, len(c))
        at = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(bounds[:-1], bounds[1:])])
        ends = np.minimum(at + PIECE, bounds[np.searchsorted(bounds, at, "right")])
        joined = [",".join(map(str, c[a:b].tolist())) for a, b in zip(at, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(pos[at]), pa.array(x1[at]), pa.array(x2[at]), pa.array(c[at]), pa.array(joined, pa.string())], ["pos", "x1", "x2", "c", "ids"])


def _digests(batches):
    """SHA-256 of each node's pieces in order, as they stream by."""
    node, sha, done = None, None, []

    def out():
        batch = pa.RecordBatch.from_pylist([{"pos": n[0], "x1": n[1], "x2": n[2], "sha": s} for n, s in done],
                                           pa.schema([("pos", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("sha", pa.string())]))
        done.clear()
        return batch

    for batch in batches:
        for *key, ids in zip(*(batch.column(n).to_pylist() for n in ("pos", "x1", "x2", "ids"))):
            if key != node:
                if sha is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield out()
    if sha is not None:
        done.append((node, sha.hexdigest()))
    yield out()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the root (depth 0) included:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; equal ones by the MD5 of ``<length of role>:<role>
    <text>``.  A null role or text is empty.  Repeated rows are turns of their own.  Rows with a null
    conv_id belong to no conversation; without any conversation there are no nodes.  Empty and
    very long texts are turns like others (only their hash and size leave the scan).  Extra
    columns are ignored.
    """
    spark = conversations.sparkSession
    scratch(spark)
    turns, convs = rebuilt(conversations)
    convs = written(convs, "convs")
    root = convs.agg(F.min("c").alias("c"), F.count("*").alias("n")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not root["n"]:
        return spark.createDataFrame([], schema)
    rows = prefixes(turns)
    node = ["pos", "x1", "x2"]
    nodes = rows.groupBy(*node).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min("y1").alias("y1"), F.min("y2").alias("y2"))
    top = spark.createDataFrame([(0, 0, 0, root["c"], root["n"], 0, None, None)], "pos long, x1 long, x2 long, conv_id long, n_convs long, bytes long, y1 long, y2 long")
    nodes = written(nodes.unionByName(top), "nodes")
    up = [(F.col("pos") - 1).alias("pos"), F.col("y1").alias("x1"), F.col("y2").alias("x2")]
    kids = nodes.filter("pos > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("pos") + 1).alias("pos"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(kids, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.filter("pos > 1").join(above, ["pos", "y1", "y2"]).unionByName(  # the root's children need no join
        nodes.filter("pos <= 1").withColumn("parent_conv_id", F.when(F.col("pos") == 1, F.lit(root["c"]).cast("long")))), "nodes")
    key = lambda c, d: F.struct(F.col(c).alias("c"), d.cast("long").alias("d"))
    totals = subtree_totals(nodes.select(
        key("conv_id", F.col("pos")).alias("id"), F.when(F.col("pos") > 0, key("parent_conv_id", F.col("pos") - 1)).alias("parent"), F.col("pos").alias("level"),
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = rows.filter("ends").select(*node, "c").unionByName(convs.filter("len = 0").select(*[F.lit(0).cast("long").alias(n) for n in node], "c"))
    pieces = ends.repartitionByRange(*node, "c").sortWithinPartitions(*node, "c").mapInArrow(_pieces, "pos long, x1 long, x2 long, c long, ids string")
    digests = pieces.repartition(*node).sortWithinPartitions(*node, "c").mapInArrow(_digests, "pos long, x1 long, x2 long, sha string")
    out = nodes.join(digests, node, "left").withColumn("id", key("conv_id", F.col("pos"))).join(totals, "id")
    return out.select("conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, k, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS r
  FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS bytes
        FROM conversations WHERE conv_id IS NOT NULL)),
lens AS (SELECT c, count(*) AS n FROM t GROUP BY c),
crc AS (
  SELECT c, c::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS v FROM lens
  UNION ALL
  SELECT c, s, i + 1, CASE WHEN w & 1 = 1 THEN xor(w >> 1, 3988292384::BIGINT) ELSE w >> 1 END
  FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(s, i // 8 + 1, 1))::BIGINT) ELSE v END AS w FROM crc WHERE i < 8 * length(s))),
convs AS (
  SELECT l.c, l.c - l.c % {GROUP} AS base, l.n, x.h, least(x.h, coalesce(b.n, 0)) AS taken
  FROM lens l JOIN (SELECT c, xor(v, 4294967295::BIGINT) % {MOST} AS h FROM crc WHERE i = 8 * length(s)) x USING (c) LEFT JOIN lens b ON b.c = l.c - l.c % {GROUP}),
turns AS (
  SELECT v.c, t.r AS pos, t.k, t.bytes FROM convs v JOIN t ON t.c = v.base AND t.r <= v.h
  UNION ALL
  SELECT v.c, t.r - v.h + v.taken, t.k, t.bytes FROM convs v JOIN t ON t.c = v.c AND t.r > v.h),
rows_ AS (
  SELECT c, pos, bytes, string_agg(k, ',') OVER (PARTITION BY c ORDER BY pos) AS kk FROM turns
  UNION ALL
  SELECT c, 0, 0, '' FROM convs),
labelled AS (
  SELECT c, pos, bytes, kk, min(c) OVER (PARTITION BY pos, kk) AS node, count(*) OVER (PARTITION BY pos, kk) AS n_convs,
         pos = max(pos) OVER (PARTITION BY c) AS ends, lag(pos) OVER (PARTITION BY c ORDER BY pos) AS up FROM rows_),
nodes AS (SELECT l.node AS conv_id, l.pos AS depth, p.node AS parent, l.n_convs, (l.n_convs - 1) * l.bytes AS saved
          FROM labelled l LEFT JOIN labelled p ON p.c = l.c AND p.pos = l.pos - 1 WHERE l.c = l.node),
kids AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (conv_id, depth)),
totals AS (SELECT l.node AS conv_id, l.pos AS depth, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(w.saved) AS saved
           FROM whole w JOIN labelled l ON l.c = w.conv_id AND l.pos <= w.depth GROUP BY ALL),
ends AS (SELECT node AS conv_id, pos AS depth, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM labelled WHERE ends GROUP BY ALL)
SELECT w.conv_id, w.depth::BIGINT AS depth, w.parent AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       t.n_leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM whole w JOIN totals t USING (conv_id, depth) LEFT JOIN ends e USING (conv_id, depth)
"""
