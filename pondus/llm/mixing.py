"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Source s has size ``size(s)`` (characters) and target weight ``w(s)``, a share of the
``total`` characters to be produced, so its mean repetition rate is
``w(s) / sum(w) * total / size(s)``.  Each document draws its count from a Poisson
distribution with that mean: the inverse of the distribution at a number in [0, 1) that
hashes the seed and the document's id.  So the count depends on neither partitioning nor
retries.  A rate above ``PART`` is split into equal parts that add up, each with a draw of
its own, so rates may be of any size.  The copies are then dealt out and sorted by a second
hash, a global shuffle.

Sizes are pre-aggregated by source before their shuffle.  The rates (a row a source) are
broadcast if a count shows that they are few; otherwise the join shuffles, salted so that a
frequent source is spread over ``SALTS`` keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import fresh

#: Largest mean of one draw.
PART = 16.0
#: A cumulative probability this close to 1 ends the table; draws are multiples of 2**-52.
_TAIL = 2.0 ** -52
FEW_SOURCES = 20_000
SALTS = 64


def _uniform(seed: int, doc_id: Column, part: Column) -> Column:
    """13 hexadecimal digits of an md5, as a number in [0, 1)."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), part.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """source, size, rate, parts, cdf: a row for each source, a null one among them.

    ``weights`` gives target weights by source, 0 for sources that it doesn't name; without
    it all sources weigh the same.  ``total`` is by default the size of all documents, so that
    the output is as large as the input.  A source without characters has rate 0.
    """
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("double")).alias("size"))
    if weights is None:
        sized = sizes.withColumn("weight", F.when(F.col("size") > 0, 1.0).otherwise(0.0))
    else:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else F.lit(None).cast("map<string,double>")
        sized = sizes.withColumn("weight", F.when((F.col("size") > 0) & F.col("source").isNotNull(), F.coalesce(table[F.coalesce("source", F.lit(""))], F.lit(0.0))).otherwise(0.0))
    sums = sized.agg(F.sum("weight").alias("all_weights"), F.sum("size").alias("all_sizes"))
    budget = F.lit(float(total)) if total is not None else F.col("all_sizes")
    rated = sized.crossJoin(F.broadcast(sums)).withColumn(  # one row of sums
        "rate", F.when((F.col("weight") > 0) & (F.col("all_weights") > 0), F.col("weight") / F.col("all_weights") * budget / F.col("size")).otherwise(0.0))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    first = F.exp(-mean)
    state = F.struct(first.alias("term"), first.alias("sum"), F.array(first).alias("cdf"))
    # terms beyond the tail are 0 or vanish in the sum, so a fixed number of steps covers it
    steps = F.sequence(F.lit(1), F.lit(int(PART * 4 + 40)))
    step = F.aggregate(steps, state, lambda s, j: F.struct(
        (s["term"] * mean / j).alias("term"), (s["sum"] + s["term"] * mean / j).alias("sum"), F.concat(s["cdf"], F.array(s["sum"] + s["term"] * mean / j)).alias("cdf")),
        lambda s: F.filter(s["cdf"], lambda c: c < 1 - _TAIL))
    return rated.select("source", "size", "rate", "parts", step.alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 17) -> DataFrame:
    """The copies of ``docs`` in shuffled order: its columns, copy (from 1), n_copies and
    shuffle_key (32 hexadecimal digits).

    A document with count 0 doesn't appear.  Rows with the same doc_id get the same count; a
    null id counts as the id ``null``, a null text as empty, a null source as a source.  Input
    columns named like the three new ones are replaced; others stay.  An empty table stays empty.
    """
    cols = [c for c in docs.columns if c not in ("copy", "n_copies", "shuffle_key")]
    source, parts, cdf, salt, own = fresh(docs, "_source", "_parts", "_cdf", "_salt", "_own")
    table = rates(docs, weights, total).select(F.col("source").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    rows = docs.select(*[F.col(f"`{c}`") for c in cols])
    same = F.col("source").cast("string").eqNullSafe(F.col(source))
    if table.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        rows = rows.join(F.broadcast(table), same)
    else:
        salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(own, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")).join(
            salted, same & (F.col(own) == F.col(salt)))
    count = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0),
                        lambda n, part: n + F.size(F.filter(cdf, lambda c: c <= _uniform(seed, F.col("doc_id"), part))))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    return (rows.withColumn("n_copies", count).filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
            .withColumn("shuffle_key", key).select(*[F.col(f"`{c}`") for c in cols], "copy", "n_copies", "shuffle_key")
            .repartition("shuffle_key").sortWithinPartitions("shuffle_key"))


#: The same in DuckDB SQL, with the defaults of :func:`mix`.
SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source),
sums AS (SELECT sum(CASE WHEN size > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS w, sum(size) AS s FROM sizes),
rated AS (SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE / w * s / size ELSE 0.0 END AS rate FROM sizes, sums),
means AS (SELECT source, greatest(1, ceil(rate / 16.0))::INT AS parts, rate / greatest(1, ceil(rate / 16.0)) AS mean FROM rated),
cdf AS (
  SELECT source, parts, mean, 0 AS j, exp(-mean) AS term, exp(-mean) AS cum FROM means
  UNION ALL
  SELECT source, parts, mean, j + 1, term * mean / (j + 1), cum + term * mean / (j + 1) FROM cdf WHERE j < 104),
draws AS (
  SELECT d.doc_id, m.source, m.part,
         ('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || m.part), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN (SELECT source, unnest(range(1, parts + 1)) AS part FROM means) m ON d.source IS NOT DISTINCT FROM m.source),
counts AS (
  SELECT doc_id, t.source, count(*) AS n_copies FROM draws t JOIN cdf c ON t.source IS NOT DISTINCT FROM c.source
  AND c.cum <= t.u AND c.cum < 1 - 2.220446049250313e-16 GROUP BY doc_id, t.source)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, x.copy::INT AS copy, x.n_copies::INT AS n_copies,
       md5('17:order|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || x.copy) AS shuffle_key
FROM documents d JOIN (SELECT doc_id, source, n_copies, unnest(range(1, n_copies + 1)) AS copy FROM counts) x
  ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.source IS NOT DISTINCT FROM x.source
"""
