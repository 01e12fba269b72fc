"""Near-duplicate documents: exact Jaccard join on word n-grams.

The documents form a sparse incidence matrix with a row per document and a column per
n-gram.  An entry of its product with its transpose is the overlap of two documents, and
two documents link when ``100 * overlap >= threshold * union``.

1. *Equal rows* become one (grouped by a 128-bit hash of the set), so copies cost nothing.
2. *Columns.*  All documents order their n-grams alike, rare before frequent.  If A links
   with anything, one of the first ``|A| - ceil(t |A|) + 1`` n-grams is shared, so only these
   entries take part.  A frequent n-gram comes last and drops out of nearly every row.
3. *Wide columns*, of more than ``LISTED`` documents.  Their rows are put into blocks of bounded
   rows and bytes, those that share columns next to each other.  A tile is two blocks that
   have so much of wide columns in common that their sets are less to send than the pairs
   of entries; there the product of the two row blocks is accumulated over
   blocks of columns, for the rows whose sizes can link.  A tile returns one row per node: how
   many links it has there, and a member of its class.  No pair leaves a task.
4. *Narrow columns*, and wide ones of blocks that share little, give their pairs, unless a
   tile covers them.  A shared n-gram at places
   i and j bounds the overlap by ``min(i, j) + 1 + min(|A| - i, |B| - j) - 1``, and s shared
   columns by s plus what lies behind the entries that take part; a pair that can't reach
   ``t / (1 + t) * (|A| + |B|)`` is discarded before any set is read.  Overlaps of the others are
   counted exactly, each pair on its own, in tiles of two bounded blocks of rows.
5. Links become components; every link is counted once, by its tile or as a pair.

Only hashes that many documents share get an explicit rank; this table is bounded by the
``ranked`` parameter.  Any fixed order gives the same result, a better one only less work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import connected_components, discard, fresh, if_small, release, releasing, shared, written

#: A link needs 100 * overlap >= THRESHOLD * union.
THRESHOLD = 75
WORDS = 5
#: N-grams with a rank of their own: at most so many (16 bytes each).
RANKED = 1 << 18
#: Columns of up to so many documents give all their pairs at once.
LISTED = 32
#: Rows of a block, and bytes of their sets.
ROWS = 512
TILE_BYTES = 8 << 20
#: Bytes of a pair of entries in a shuffle.
TERM_BYTES = 32
#: Bytes of texts whose n-grams a task holds at once, if no single text is longer.
SLICE = 1 << 19
#: Terms of the sparse product that are summed at once, and columns of the dense one.
PRODUCT = 1 << 21
COLUMNS = 4096

_CLASS_SCHEMA = "doc_id long, n_shingles long, sig1 long, sig2 long, columns array<long>"


def _sets(batch_column, n: int, size: int = SLICE):
    for s in T.slices(batch_column, size):
        w = T.words(s, T.NON_SPACE)
        rows, hashes = T.ngrams(w, n)
        yield s, *T.sets(rows, hashes, len(s.offsets) - 1)


@releasing
def _repeated(batches, n):
    """(gram, times): n-grams that two documents or more of one slice have."""
    for batch in batches:
        for _, values, _ in _sets(batch.column("text"), n, 2 * SLICE):
            values = np.sort(values)
            first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, int)
            times = np.diff(np.r_[first, len(values)])
            many = times >= 2
            yield pa.RecordBatch.from_arrays([pa.array(values[first[many]].view(np.int64)), pa.array(times[many])], ["gram", "times"])


def frequent_ngrams(docs: DataFrame, n: int = WORDS, ranked: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that documents share most often, at most ``ranked``, sorted by hash, with
    their counts (lower bounds, over all documents).

    A histogram of the counts, by sixteenths of a power of two, gives the cut, so the driver
    gets no more than these rows."""
    counted = written(docs.select("text").mapInArrow(lambda it: _repeated(it, n), "gram long, times long")
                      .groupBy("gram").agg(F.sum("times").alias("times"))
                      .withColumn("step", F.floor(16 * F.log2("times")).cast("int")), "counted")
    total, cut = 0, None
    for r in sorted(counted.groupBy("step").agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r["n"]
        if total > ranked:
            break
        cut = r["step"]
    kept = counted.filter(F.col("step") >= cut if cut is not None else F.lit(False)).select("gram", "times").toArrow()
    discard(counted)
    gram, times = kept.column("gram").to_numpy().view(np.uint64), kept.column("times").to_numpy()
    order = np.argsort(gram)
    return gram[order], times[order]


def _signatures(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(T.mix(values ^ np.uint64(salt)), out=total[1:])
        out.append(T.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return out


@releasing
def _classes(batches, n, threshold, frequent):
    grams, times = frequent()
    for batch in batches:
        ids = batch.column("doc_id")
        for s, values, bounds in _sets(batch.column("text"), n):
            size = np.diff(bounds)
            sig1, sig2 = _signatures(values, bounds)
            place = np.minimum(np.searchsorted(grams, values), max(len(grams) - 1, 0))
            count = np.where(grams[place] == values, times[place], 0) if len(grams) else np.zeros(len(values), np.int64)
            row = np.repeat(np.arange(len(size)), size)
            order = np.argsort(count, kind="stable")  # values are in order of their hash already
            order = order[np.argsort(row[order], kind="stable")]
            length = np.where(size > 0, size - (threshold * size + 99) // 100 + 1, 0)
            kept = order[(np.arange(len(values)) - bounds[:-1][row]) < length[row]]
            columns = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(values[kept].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(s.first, len(size)).cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(sig1), pa.array(sig2), columns],
                ["doc_id", "n_shingles", "sig1", "sig2", "columns"])


@releasing
def _full_sets(batches, n):
    for batch in batches:
        for s, values, bounds in _sets(batch.column("text"), n):
            sig1, sig2 = _signatures(values, bounds)
            data = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int64)), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([pa.array(sig1), pa.array(sig2), data.cast(pa.binary())], ["sig1", "sig2", "grams"])


def _overlaps(pairs: pa.Table, sets: pa.Table, threshold: int) -> pa.Table:
    """The pairs of one tile that link; ``sets`` has the sorted set of each node once or more."""
    grams = {n.as_py(): np.frombuffer(v.as_buffer(), np.uint64) for n, v in zip(sets.column("node"), sets.column("grams"))}
    link = []
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
        x, y = sorted((grams[a], grams[b]), key=len)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        link.append(100 * both >= threshold * (len(x) + len(y) - both))
    if sets.nbytes > TILE_BYTES // 2:
        release()
    return pairs.select(["a", "b"]).filter(pa.array(link, pa.bool_()))


def _overlap_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The incidence product of two row blocks: overlaps of all their sets, rows x rows, summed
    over blocks of columns.  Sparse while few sets share a column, else dense."""
    sizes = [np.array([len(x) for x in rows]) for rows in (left, right)]
    values = np.concatenate((*left, *right))
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    row = np.concatenate([np.repeat(np.arange(len(z)), z) for z in sizes])
    split = int(sizes[0].sum())
    cl, rl, cr, rr = column[:split], row[:split], column[split:], row[split:]
    nl, nr = np.bincount(cl, minlength=len(times)), np.bincount(cr, minlength=len(times))
    both = (nl > 0) & (nr > 0)
    out = np.zeros((len(left), len(right)), np.int64)
    terms = int((nl * nr)[both].sum())
    if 4 * terms <= len(left) * len(right) * int(both.sum()) // 16:
        kl, kr = both[cl], both[cr]
        cl, rl, cr, rr = cl[kl], rl[kl], cr[kr], rr[kr]
        order = np.argsort(cr, kind="stable")
        cr, rr = cr[order], rr[order]
        first = np.searchsorted(cr, cl)
        many = np.searchsorted(cr, cl, "right") - first
        done = np.r_[0, np.cumsum(many)]
        a = 0
        while a < len(cl):
            b = max(a + 1, int(np.searchsorted(done, done[a] + PRODUCT, "right")) - 1)
            n = many[a:b]
            at = np.repeat(first[a:b] - (done[a:b] - done[a]), n) + np.arange(done[b] - done[a])
            out += np.bincount(np.repeat(rl[a:b], n) * len(right) + rr[at], minlength=out.size).reshape(out.shape)
            a = b
        return out
    number = np.cumsum(both) - 1
    for c in range(0, int(both.sum()), COLUMNS):
        dense = []
        for n, r, k in ((len(left), rl, cl), (len(right), rr, cr)):
            x = np.zeros((n, COLUMNS), np.float32)
            own = both[k] & (number[k] >= c) & (number[k] < c + COLUMNS)
            x[r[own], number[k[own]] - c] = 1
            dense.append(x)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _tile_links(tile: pa.Table, threshold: int) -> pa.Table:
    """(node, other, n_links): for the nodes of two blocks, their links across them (or within
    one), and a node that they reach by these links: the same one for all that it reaches."""
    rows: dict = {}
    for node, block, grams in zip(tile.column("node").to_pylist(), tile.column("block").to_pylist(), tile.column("grams")):
        rows.setdefault(node, (block, grams))
    t1, t2 = tile.column("t1")[0].as_py(), tile.column("t2")[0].as_py()
    nodes = sorted(rows)
    sets = {n: np.frombuffer(rows[n][1].as_buffer(), np.uint64) for n in nodes}
    parts = [sorted((n for n in nodes if rows[n][0] == t), key=lambda n: (len(sets[n]), n)) for t in ((t1,) if t1 == t2 else (t1, t2))]
    left, right = parts[0], parts[-1]
    la, lb = (np.array([len(sets[n]) for n in part]) for part in (left, right))
    total = {n: 0 for n in nodes}
    where = {n: i for i, n in enumerate(nodes)}
    label = np.arange(len(nodes))
    ia, ib = (np.array([where[n] for n in part], int) for part in (left, right))
    step = 128
    for a in range(0, len(left), step):
        # sizes are sorted: only so many of the other block can link with these
        lo = int(np.searchsorted(100 * lb, threshold * la[a])) if len(lb) else 0
        hi = int(np.searchsorted(threshold * lb, 100 * la[min(len(la), a + step) - 1], "right")) if len(lb) else 0
        if lo >= hi:
            continue
        mine, theirs = left[a:a + step], right[lo:hi]
        both = _overlap_counts([sets[n] for n in mine], [sets[n] for n in theirs])
        sa, sb = la[a:a + step, None], lb[None, lo:hi]
        link = 100 * both >= threshold * (sa + sb - both)
        if t1 == t2:
            link &= ia[a:a + step, None] != ib[None, lo:hi]
        for i, k in zip(mine, link.sum(axis=1).tolist()):
            total[i] += k
        if t1 != t2:
            for j, k in zip(theirs, link.sum(axis=0).tolist()):
                total[j] += k
        label = _merged(label, ia[a:a + step], ib[lo:hi], link)
    some = [n for n in nodes if total[n]]
    if tile.nbytes > TILE_BYTES // 2:
        release()
    return pa.table({"node": pa.array(some, pa.int64()), "other": pa.array([nodes[label[where[n]]] for n in some], pa.int64()), "n_links": pa.array([total[n] for n in some], pa.int64())})


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray, link: np.ndarray) -> np.ndarray:
    """``label`` (the smallest member of each class) after the links between a and b."""
    i, j = np.nonzero(link)
    i, j = a[i], b[j]
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return label
        small, large = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        root = np.arange(len(label))
        np.minimum.at(root, large, small)
        while True:  # to the smallest that it points at
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
        label = root[label]


def _bounded(a: str, b: str, threshold: int):
    """Size and place bounds of a pair that shares one n-gram; entries are structs."""
    sa, sb, ia, ib = (F.col(f"{x}.{y}") for x, y in ((a, "size"), (b, "size"), (a, "place"), (b, "place")))
    most = F.least(ia, ib) + 1 + F.least(sa - ia, sb - ib) - 1
    return (100 * F.least(sa, sb) >= threshold * F.greatest(sa, sb)) & ((100 + threshold) * most >= threshold * (sa + sb))


def _blocks(wide: DataFrame) -> DataFrame:
    """(node, size, block): the rows of wide columns in blocks of at most ``ROWS`` rows and
    about ``TILE_BYTES`` of sets.  Rows are ordered by their smallest wide column, then by
    size, so near copies stand together; places along that order come from a sum within
    each part and the sums of the parts before it."""
    spark = wide.sparkSession
    rows = wide.groupBy("node").agg(F.min("gram").alias("anchor"), F.max("size").alias("size"))
    cost = F.greatest(F.lit(1.0), F.col("size") * (8.0 * ROWS / TILE_BYTES))
    order = ["anchor", "size", "node"]
    local = written(rows.withColumn("cost", cost).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running, "node long, size long, upto double, part int"), "order")
    total, before = 0.0, []
    for r in local.groupBy("part").agg(F.max("upto").alias("upto")).orderBy("part").collect():  # a row for each part
        before.append((r["part"], total))
        total += r["upto"]
    parts = spark.createDataFrame(before, "part int, before double")
    return local.join(F.broadcast(parts), "part").select("node", "size", F.floor((F.col("before") + F.col("upto")) / ROWS).alias("block"))


def _running(batches):
    total, part = 0.0, TaskContext.get().partitionId()
    for batch in batches:
        upto = total + np.cumsum(batch.column("cost").to_numpy())
        total = float(upto[-1]) if len(upto) else total
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), pa.array(upto), pa.array(np.full(len(upto), part, np.int32))], ["node", "size", "upto", "part"])


def _tiles(wide: DataFrame, blocks: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """((t1, t2): the tiles, t1 <= t2; (gram, t1, t2): columns whose pairs are listed).

    Two blocks with wide columns in common are a tile if their sets are fewer bytes than the
    pairs of entries in these columns; blocks that share little list them.  Blocks whose
    sizes can't link are neither."""
    size = blocks.groupBy("block").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.sum(8 * F.col("size")).alias("bytes"))
    of = written(wide.join(blocks.select("node", "block"), "node").groupBy("gram", "block").agg(F.count("*").alias("n")), "column-blocks")
    both = of.select("gram", F.col("block").alias("t1"), F.col("n").alias("n1")).join(of.select("gram", F.col("block").alias("t2"), F.col("n").alias("n2")), "gram").filter("t1 <= t2")
    pairs = both.groupBy("t1", "t2").agg(F.sum(F.col("n1") * F.col("n2")).alias("terms"))
    for t in ("t1", "t2"):
        pairs = pairs.join(size.select(F.col("block").alias(t), *[F.col(c).alias(f"{c}_{t}") for c in ("low", "high", "bytes")]), t)
    pairs = written(pairs.filter(100 * F.least("high_t1", "high_t2") >= threshold * F.greatest("low_t1", "low_t2")).select(
        "t1", "t2", (TERM_BYTES * F.col("terms") >= F.col("bytes_t1") + F.col("bytes_t2")).alias("tile")), "block-pairs")
    return pairs.filter("tile").select("t1", "t2"), both.join(if_small(pairs.filter("NOT tile").select("t1", "t2")), ["t1", "t2"]).select("gram", "t1", "t2")


def near_duplicates(docs: DataFrame, n: int = WORDS, threshold: int = THRESHOLD, ranked: int = RANKED, count_links: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, group_id, n_links.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names.
    component_id is the smallest doc_id of all documents reachable by links, itself included;
    group_id names the component also where doc_ids repeat; n_links is the exact
    number of other distinct sets that the document links with (null without ``count_links``).

    A null or empty text, or one without words, has no n-grams, links with nothing and is
    its own component.  A null doc_id is kept as null and never is the smallest.  Repeated
    rows are copies.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = shared(spark, frequent_ngrams(docs, n, ranked))
    rows = written(docs.mapInArrow(lambda it: _classes(it, n, threshold, frequent), _CLASS_SCHEMA), "rows")
    key = ["sig1", "sig2"]
    nodes = written(rows.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"))
                    .withColumn("node", F.monotonically_increasing_id()), "nodes")

    # One entry for each column of each distinct row; copies of the chosen document repeat it.
    own = if_small(nodes.select("node", *key, F.col("doc_id").alias("own")))
    entries = (rows.join(own, key).filter(F.col("doc_id").eqNullSafe(F.col("own")))
               .select("node", F.col("n_shingles").alias("size"), F.posexplode("columns").alias("place", "gram"))
               .select("gram", "node", F.shiftleft("size", 32).bitwiseOR(F.col("place").cast("long")).alias("sized")).repartition("gram"))
    members = entries.groupBy("gram").agg(F.count("*").alias("members")).filter("members > 1")
    entries = written(entries.join(members, "gram").select(
        "gram", "node", F.shiftright("sized", 32).alias("size"), F.col("sized").bitwiseAND(F.lit((1 << 32) - 1)).alias("place"), "members"), "entries")

    def reaches(shared, sa, sb):
        """Whether so many shared columns, with everything behind them, can be a link."""
        behind = F.ceil(threshold * F.greatest(sa, sb) / 100) - 1
        return (100 + threshold) * (shared + behind) >= threshold * (sa + sb)

    # Rows of wide columns: blocks, and tiles of two blocks that have a wide column in common.
    wide = entries.filter(F.col("members") > LISTED)
    blocks = written(_blocks(wide), "blocks")
    tiles, thin = _tiles(wide, blocks, threshold)
    tiles = if_small(tiles)
    placed = if_small(blocks.select("node", "block"))
    sent = (tiles.select(F.col("t1").alias("block"), "t1", "t2").unionByName(tiles.filter("t1 != t2").select(F.col("t2").alias("block"), "t1", "t2"))
            .join(blocks.select("node", "block"), "block").join(nodes.select("node", *key), "node"))
    in_tiles = if_small(nodes.join(blocks.select("node"), "node", "left_semi").select(F.col("doc_id").alias("own")).distinct())
    sets = (docs.join(in_tiles, F.col("doc_id").eqNullSafe(F.col("own")), "left_semi").select("text")
            .mapInArrow(lambda it: _full_sets(it, n), "sig1 long, sig2 long, grams binary").join(if_small(sent), key).select("node", "block", "t1", "t2", "grams"))
    found_in_tiles = written(sets.groupBy("t1", "t2").applyInArrow(lambda x: _tile_links(x, threshold), "node long, other long, n_links long"), "tile-links")

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs that link, of (a, b) nodes.  Documents that share candidates form row
        blocks of bounded size; a tile is two of them, and a set goes once to each tile that
        has a pair of it.  Sets are made again for these documents only."""
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "pairs")
        ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
        named = written(nodes.join(ends.groupBy("node").agg(F.min("other").alias("other")), "node").withColumn("group", F.least("node", "other")).drop("other"), "named")
        blocks = named.groupBy("group").agg(F.ceil(F.sum("n_shingles") * 8 / TILE_BYTES).alias("blocks"))
        place = if_small(named.join(blocks, "group").select("node", F.struct("group", F.pmod(F.xxhash64("node"), "blocks").alias("block")).alias("place")))
        tiled = (pairs.join(place.select(F.col("node").alias("a"), F.col("place").alias("pa")), "a").join(place.select(F.col("node").alias("b"), F.col("place").alias("pb")), "b")
                 .select("a", "b", F.least("pa", "pb").alias("p"), F.greatest("pa", "pb").alias("q"))
                 .select("a", "b", F.col("p.group").alias("g1"), F.col("p.block").alias("b1"), F.col("q.group").alias("g2"), F.col("q.block").alias("b2")))
        tile = ["g1", "b1", "g2", "b2"]
        tiled = written(tiled, "tiled")
        sent = tiled.select(F.col("a").alias("node"), *tile).union(tiled.select("b", *tile)).distinct().toDF("node", *[f"s_{c}" for c in tile])
        ids = if_small(named.select(F.col("doc_id").alias("own")).distinct())
        sets = (docs.join(ids, F.col("doc_id").eqNullSafe(F.col("own")), "left_semi").select("text")
                .mapInArrow(lambda it: _full_sets(it, n), "sig1 long, sig2 long, grams binary")
                .join(if_small(named.select("node", *key)), key).select("node", "grams").join(if_small(sent), "node"))
        out = written(tiled.groupBy(*tile).cogroup(sets.groupBy(*[f"s_{c}" for c in tile])).applyInArrow(
            lambda x, y: _overlaps(x, y, threshold), "a long, b long"), "links")
        discard(pairs, named, tiled)
        return out

    # Narrow columns give all their pairs; those that a tile covers are settled there, and the
    # others share narrow columns only.
    narrow = entries.filter(F.col("members") <= LISTED)
    met = (narrow.select("gram", F.struct("size", "node", "place").alias("me")).join(narrow.select("gram", F.struct("size", "node", "place").alias("o")), "gram")
           .filter((F.col("o.node") < F.col("me.node")) & _bounded("me", "o", threshold)).select("me", "o"))
    of_block = wide.join(blocks.select("node", "block"), "node").select("gram", "block", F.struct("size", "node", "place").alias("entry"))
    met_wide = (thin.join(of_block.select("gram", F.col("block").alias("t1"), F.col("entry").alias("me")), ["gram", "t1"])
                .join(of_block.select("gram", F.col("block").alias("t2"), F.col("entry").alias("o")), ["gram", "t2"])
                .filter("t1 < t2 OR o.node < me.node").select("me", "o"))
    met = met.unionByName(met_wide.filter((F.col("o.node") != F.col("me.node")) & _bounded("me", "o", threshold)))
    small, large = F.least(F.struct("me.node", "me.size"), F.struct("o.node", "o.size")), F.greatest(F.struct("me.node", "me.size"), F.struct("o.node", "o.size"))
    met = (met.select(small["node"].alias("a"), small["size"].alias("sa"), large["node"].alias("b"), large["size"].alias("sb"))
           .groupBy("a", "sa", "b", "sb").agg(F.count("*").alias("shared")).filter(reaches(F.col("shared"), F.col("sa"), F.col("sb"))))
    for x in ("a", "b"):
        met = met.join(placed.select(F.col("node").alias(x), F.col("block").alias(f"t{x}")), x, "left")
    met = (met.withColumns({"t1": F.when(F.col("tb").isNotNull(), F.least("ta", "tb")), "t2": F.when(F.col("ta").isNotNull(), F.greatest("ta", "tb"))})
           .join(tiles, ["t1", "t2"], "left_anti").select("a", "b"))
    found = links(met)
    comp = connected_components(found.unionByName(found_in_tiles.select(F.col("node").alias("a"), F.col("other").alias("b"))))
    if count_links:
        degree = (found_in_tiles.select("node", "n_links").unionByName(found.select(F.col("a").alias("node"), F.lit(1).cast("long").alias("n_links")))
                  .unionByName(found.select(F.col("b").alias("node"), F.lit(1).cast("long").alias("n_links"))).groupBy("node").agg(F.sum("n_links").alias("n_links")))
    else:
        degree = comp.select("node", F.lit(None).cast("long").alias("n_links"))
    discard(entries)
    labels = (nodes.select(*key, "node", "doc_id").join(comp, "node", "left").join(degree, "node", "left")
              .withColumn("group_id", F.coalesce("component", "node")))
    smallest = labels.groupBy("group_id").agg(F.min("doc_id").alias("component_id"))
    labels = labels.join(smallest, "group_id").select(*key, "group_id", "component_id", "n_links")
    empty = F.col("n_shingles") == 0
    return rows.drop("columns").join(labels, key, "left").select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "group_id",
        (F.coalesce("n_links", F.lit(0)) if count_links else F.col("n_links")).alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id.

    Rows equal in doc_id and text stay once; a document with a null doc_id stays only if its
    group has no other id.  Columns are those of ``docs``.
    """
    groups = written(near_duplicates(docs, count_links=False, **options), "groups")
    (keep,) = fresh(docs, "_keep")
    kept = if_small(groups.select(F.col("component_id").alias(keep)).distinct())
    cols = docs.columns
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(keep)), "left_semi").select(*[F.col(f"`{c}`") for c in cols])
    repeated = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").count().filter("count > 1")
    return out.dropDuplicates(["doc_id", "text"]) if repeated.limit(1).count() else out
