"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed words, word pairs and byte n-grams
(3 and 4 bytes); a linear layer and softmax give the probability of label 1.  Vectors and
layer are trained by stochastic gradient descent in numpy, in one Spark task, on a bounded
sample of the labelled rows.  Averages and layer are linear, so scoring needs one number
for each bucket and is a single pass over the texts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import releasing, shared, written

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Labelled rows of each label that training sees at most.
FIT_ROWS = 2000
SIZE, EPOCHS, RATE = 12, 6, 0.5
MIN_STEPS = 12_000
_SLICE = 1 << 18


class Model(NamedTuple):
    """Logit of label 1: mean of ``weight`` over a text's features, plus ``bias``."""

    weight: np.ndarray
    bias: float


def _spelled(data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(rows, hashes) of the 3- and 4-byte grams that begin before ``end``."""
    rows, hashes = [], []
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    value = T.BYTE_VALUE[T.LOWER[data]]
    gram = np.zeros(len(value), np.uint64)
    for n in range(4):
        k = max(0, len(value) - n)
        gram[:k] = (gram[:k] + value[n:]) * np.uint64(0x9E3779B97F4A7C15)
        gram[:k] ^= gram[:k] >> np.uint64(32)
        if n >= 2:
            k = min(k, end)
            same = row_of[:k] == row_of[n:n + k]
            rows.append(row_of[:k][same])
            hashes.append(gram[:k][same] * np.uint64(2 * n + 1))
    return rows, hashes


def _pair_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return after - before + T.GRAM_MULT[0]  # a repeated word is one feature, whatever the word


def _features(s: T.Slice):
    """(row, bucket) of every feature of a slice's texts, in pieces that bound the memory.

    A long text is cut where a word begins.  The next piece's first bytes complete the grams
    that begin before the cut, and the last word before it pairs with the next, so the
    pieces have the features of the whole text."""
    n, a, last = len(s.data), 0, None
    while a < n or a == 0:
        b = n
        if len(s.offsets) == 2 and n - a > 2 * _SLICE:  # a slice of several texts is short
            b = _cut(s.data, a + _SLICE)
        piece = s if a == 0 and b == n else T.Slice(s.first, s.data[a:b], np.array([0, b - a]))
        w = T.words(piece, T.NON_SPACE)
        rows, hashes = [w.row], [w.hash]
        pair = w.row[1:] == w.row[:-1]
        rows.append(w.row[1:][pair])
        hashes.append(_pair_hash(w.hash[:-1], w.hash[1:])[pair])
        if last is not None and len(w.hash):
            rows.append(w.row[:1])
            hashes.append(_pair_hash(last, w.hash[:1]))
        last = w.hash[-1:] if len(w.hash) else last
        ahead = s.data[a:b + 3] if piece is not s else s.data
        r, h = _spelled(ahead, np.array([0, len(ahead)]) if piece is not s else s.offsets, b - a)
        rows, hashes = np.concatenate(rows + r), np.concatenate(hashes + h)
        yield rows, ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        if b >= n:
            return
        a = b


def _cut(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that isn't inside a word; the end if there is none."""
    while at < len(data):
        space = np.flatnonzero(~T.NON_SPACE[data[at:at + _SLICE]])
        if len(space):
            return at + int(space[0])
        at += _SLICE
    return len(data)


@releasing
def _bags(batches):
    """(label, at, buckets, counts) of the training rows."""
    for batch in batches:
        for s in T.slices(batch.column("text"), _SLICE):
            n = len(s.offsets) - 1
            key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for r, b in _features(s):
                key, at = np.unique(np.concatenate((key, r * BUCKETS + b)), return_inverse=True)
                count = np.bincount(at.reshape(-1), weights=np.concatenate((count, np.ones(len(r), np.int64))), minlength=len(key)).astype(np.int64)
            bounds = np.searchsorted(key, np.arange(n + 1) * BUCKETS)
            pairs = list(zip(bounds[:-1], bounds[1:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(s.first, n), batch.column("at").slice(s.first, n),
                 pa.array([(key[a:b] % BUCKETS).astype(np.uint16).tobytes() for a, b in pairs], pa.binary()),
                 pa.array([count[a:b].astype(np.uint32).tobytes() for a, b in pairs], pa.binary())],
                ["label", "at", "buckets", "counts"])


def _train(group: pd.DataFrame, size: int, epochs: int, rate: float) -> pd.DataFrame:
    """SGD over the sample: ``epochs`` passes, more over a sample so small that they would be
    fewer than MIN_STEPS steps."""
    group = group.sort_values(["at", "buckets"]).reset_index(drop=True)
    y = group["label"].to_numpy(int)
    bags = [(np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(c, np.uint32).astype(np.float32)) for b, c in zip(group["buckets"], group["counts"])]
    bags = [(b, c / max(float(c.sum()), 1.0)) for b, c in bags]
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
    layer, bias = np.zeros((2, size), np.float32), np.zeros(2, np.float32)
    epochs = max(epochs, -(-MIN_STEPS // max(1, len(y))))
    step, steps = 0, max(1, epochs * len(y))
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            b, c = bags[i]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = c @ vectors[b]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer.T @ p
            layer -= lr * np.outer(p, hidden)
            bias -= lr * p
            vectors[b] -= lr * c[:, None] * back
    return pd.DataFrame({"weight": [(vectors @ (layer[1] - layer[0])).astype(np.float32).tobytes()], "bias": [float(bias[1] - bias[0])]})


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, size: int = SIZE, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """A model from ``labels`` (doc_id, quality 0 or 1) and the texts of ``docs``.

    Labels that are null, other numbers, or contradict each other are left out.  At most
    ``fit_rows`` ids of each label are chosen by a hash, on average; of the texts of one id
    one takes part.  With one label or none, every text scores 0.5.
    """
    labels = (labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL")
              .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other"))
    n = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    at = F.xxhash64(F.lit("quality"), "doc_id")
    # the share keeps fit_rows of each label on average; 1.2 times as many is never reached
    share = F.when(F.col("label") == 1, min(1.0, fit_rows / n[1])).otherwise(min(1.0, fit_rows / n[0]))
    sample = labels.withColumn("at", at).filter(F.pmod("at", F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("text", "label", "at")
    bags = written(rows.mapInArrow(_bags, "label int, at long, buckets binary, counts binary").withColumn("row", F.monotonically_increasing_id()), "bags")
    first = bags.groupBy("label", "at").agg(F.min("row").alias("row")).select("row")  # an id that repeats counts once
    found = (bags.join(F.broadcast(first), "row", "left_semi").drop("row").withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda g: _train(g, size, epochs, rate), "weight binary, bias double").collect())
    if not found:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(bytes(found[0]["weight"]), np.float32), found[0]["bias"])


@releasing
def _score(batches, model: Model):
    for batch in batches:
        text = batch.column("text")
        total, count = np.zeros(len(text)), np.zeros(len(text))
        for s in T.slices(text, _SLICE):
            for rows, buckets in _features(s):
                n, at = len(s.offsets) - 1, slice(s.first, s.first + len(s.offsets) - 1)
                total[at] += np.bincount(rows, weights=model.weight[buckets], minlength=n)
                count[at] += np.bincount(rows, minlength=n)
        z = total / np.maximum(count, 1) + model.bias
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*names, "score"])


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) for every row of ``docs``.

    A null text is an empty one; an empty one scores by the bias alone.  Rows with a null
    doc_id are scored like others; extra columns are ignored.
    """
    packed = shared(docs.sparkSession, model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _score(it, packed()), "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def train_rows(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, **options) -> Model:
    """A model from the labels whose crc32(doc_id as text) modulo ``folds`` isn't ``held``."""
    return fit(docs, labels.filter(_fold(folds) != held), **options)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, **options) -> DataFrame:
    """Learn from the labels outside the held-out fold and score every row of ``docs``.
    A row with a null doc_id isn't held out."""
    return score(docs, train_rows(docs, labels, folds, held, **options), F.coalesce(_fold(folds) == held, F.lit(False)))


@releasing
def _keep(batches, model: Model):
    for batch in batches:
        kept = [b.column("score").to_numpy() >= 0.5 for b in _score([pa.RecordBatch.from_arrays([batch.column("text")], ["text"])], model)]
        yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *kept])))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, in one pass, columns as they are."""
    packed = shared(docs.sparkSession, train_rows(docs, labels, **options))
    return docs.mapInArrow(lambda it: _keep(it, packed()), docs.schema)
