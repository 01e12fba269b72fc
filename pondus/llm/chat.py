"""Chat formatting: quotations linked to their originals, replies in order, quotes taken out.

A line that begins with ``>`` marks is a quotation; the number of marks is its level, and a
run of lines of one level is a passage.  Passages and their paragraphs are normalised (case,
white space, line breaks) and hashed, and so are the paragraphs, lines and the whole of what a
message writes itself; a quotation is joined to the latest earlier message of its conversation
that wrote it, however its lines are broken.  Lines are hashed too, for passages cut out of
paragraphs or put together from several messages.  A message replies to the message that most
passages of its quotations of the lowest level come from, then most lines, the latest of
equals.  Replies form trees, whose roots come from
pointer jumping, and a conversation is ordered by (turn of the root, turn): each message
follows the one it answers, and quotations are gone from the texts.

"Latest earlier" runs over buckets of ``BUCKET`` turns: within a bucket, then over the last
turn of each bucket, so that one huge conversation with one repeated line isn't one group.
The result is ordered by ranges, which split such a conversation too.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut_lineage, written

BUCKET = 4096
_MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(text without quotations, [(level, passage)])."""
    own, passages = [], []
    last = 0
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level = m[1].count(">") if m else 0
        if level:
            rest = line[m.end():]
            if level == last:
                passages[-1][1].append(rest)
            else:
                passages.append((level, [rest]))
        else:
            own.append(line)
        last = level
    kept = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if passages else text
    return kept, [(level, "\n".join(lines)) for level, lines in passages]


def _hashes(parts) -> list[int]:
    """Signed 64-bit hashes of the distinct normalised parts, empty ones left out."""
    distinct = dict.fromkeys(n for x in parts if (n := " ".join(x.casefold().split())))
    return [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in distinct]


def line_hashes(text: str) -> list[int]:
    return _hashes(text.split("\n"))


def passage_hashes(text: str) -> list[int]:
    """Of the whole text and of its paragraphs."""
    return _hashes([text, *re.split(r"\n[^\S\n]*\n", text)])


def _kept(batches):
    for batch in batches:
        texts, counts = [], []
        for text in batch.column("text"):
            text = text.as_py()
            own, passages = parse(text or "")
            texts.append(own if text is not None else None)
            counts.append(len(passages))
        yield pa.RecordBatch.from_arrays([*map(batch.column, ("conv_id", "turn", "role")), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                                         ["conv_id", "turn", "role", "text", "n_quotes"])


def _hashed(batches):
    """(conv_id, turn, line, level, passage): what each message writes (level 0) and quotes."""
    for batch in batches:
        rows, found = [], []
        for i, text in enumerate(batch.column("text")):
            own, passages = parse(text.as_py() or "")
            out = {(h, 0, 0) for h in (*line_hashes(own), *passage_hashes(own))}
            for level, p in passages:
                out |= {(h, level, 0) for h in line_hashes(p)} | {(h, level, 1) for h in passage_hashes(p)}
            rows += [i] * len(out)
            found += out
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(at), batch.column("turn").take(at)] + [
            pa.array([x[k] for x in found], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))], ["conv_id", "turn", "line", "level", "passage"])


def _earlier(lines: DataFrame) -> DataFrame:
    """For every quoted (conv_id, turn, level, line, passage): ``source``, the latest earlier turn
    that wrote it, or null."""
    key = ["conv_id", "line"]
    quoted = lines.filter("level > 0").groupBy(*key).agg(F.min("turn").alias("_first"), F.max("turn").alias("_last"))
    used = lines.join(quoted, key).filter("level > 0 OR turn < _last").withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    wrote = F.when(F.col("level") == 0, F.col("turn"))
    near = Window.partitionBy(*key, "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    last = used.filter("level = 0").groupBy(*key, "bucket").agg(F.max("turn").alias("turn"))
    buckets = used.select(*key, "bucket").distinct().join(last, [*key, "bucket"], "left")
    far = buckets.withColumn("before", F.max("turn").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("turn")
    return (used.withColumn("near", F.max(wrote).over(near)).filter("level > 0").join(far, [*key, "bucket"])
            .select("conv_id", "turn", "level", "line", "passage", F.coalesce("near", "before").alias("source")))


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) by pointer jumping: the distance doubles each round."""
    now = cut_lineage(parents.select("conv_id", "turn", F.col("parent_turn").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        both = now.join(up, ["conv_id", "root"], "left")
        now = cut_lineage(both.select("conv_id", "turn", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
                                      F.col("_root").isNotNull().alias("moved")))
        if not now.filter("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def reply_order(messages: DataFrame) -> DataFrame:
    """A row per message, in reply order: conv_id, thread_turn (turn of its tree's root),
    turn, parent_turn (null: a root), depth (0: a root), role, text (without quotations),
    n_quotes (passages), n_linked (quoted lines with an original), formatted.

    ``messages`` has conv_id, turn, role, text; extra columns are ignored.  A null text stays
    null and quotes nothing.  Rows with a null conv_id or turn link with nothing.  Rows that
    repeat (conv_id, turn) share their links.  A quotation without an original is taken out of
    the text and counted in n_quotes only.  An empty table gives an empty result.
    """
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    lines = written(messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "text").mapInArrow(
        _hashed, "conv_id long, turn long, line long, level int, passage int").distinct(), "quotations")
    links = cut_lineage(_earlier(lines).filter("source IS NOT NULL"))
    votes = links.groupBy("conv_id", "turn", "level", "source").agg(F.sum("passage").alias("passages"), F.count_if(F.col("passage") == 0).alias("n"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct(-F.col("level"), "passages", "n", "source")).alias("parent_turn"))
    linked = links.groupBy("conv_id", "turn").agg(F.count_if(F.col("passage") == 0).alias("n_linked"))
    tree = _roots(parents).join(parents, ["conv_id", "turn"]).join(linked, ["conv_id", "turn"])
    role = F.coalesce("role", F.lit("unknown"))
    parsed = messages.mapInArrow(_kept, "conv_id long, turn long, role string, text string, n_quotes long")
    out = parsed.join(tree, ["conv_id", "turn"], "left").select(
        "conv_id", F.coalesce("root", "turn").alias("thread_turn"), "turn", "parent_turn", F.coalesce("depth", F.lit(0)).alias("depth"), "role", "text",
        "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.concat(F.lit("<|"), role, F.lit("|>\n"), F.coalesce("text", F.lit(""))).alias("formatted"))
    return out.repartitionByRange("conv_id", "thread_turn", "turn").sortWithinPartitions("conv_id", "thread_turn", "turn", "role", "text")
