"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (1 to 3 bytes of the lower-cased text, every
ASCII byte that is no letter a blank), weighted ``log(1 + count) * idf`` and scaled to
length 1.  Each language has several centroids, found by spherical k-means, so that a
language may consist of different kinds of text.  A text gets the language of the centroid
with the largest cosine; if that cosine is below what nearly all training texts of the
centroid reach, the text is rejected (``rejected``), and ``lang_pred`` still names the
nearest language.

Document frequencies are counted over every training row.  Only the k-means runs on a
bounded sample: at most ``fit_rows`` rows a language, chosen by a hash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import shared

DIM_BITS = 13
DIM = 1 << DIM_BITS
#: Training rows a language that k-means sees at most.
FIT_ROWS = 1000
CENTROIDS = 4
#: Rejected below this quantile of the training cosines of a centroid, times the margin.
REJECT_QUANTILE, REJECT_MARGIN = 0.01, 0.7
UNDETERMINED = "und"

#: Letters and non-ASCII bytes as they are, everything else a blank.
_NORMAL = np.where(T.byte_class((0x61, 0x7A), (0x80, 0xFF)), np.arange(256), 0x20).astype(np.uint8)
_VALUE32 = (T.BYTE_VALUE >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ROWS, _PIECE = 256, 1 << 19


class Model(NamedTuple):
    languages: list[str]
    centroids: np.ndarray
    threshold: np.ndarray
    idf: np.ndarray


def _counts(column):
    """(first row, counts) for slices of rows: a row of DIM n-gram counts a text."""
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    for first in range(0, len(lower), _ROWS):
        part = lower.slice(first, _ROWS)
        for s in T.slices(part, _PIECE):
            rows = len(s.offsets) - 1
            total = np.zeros(rows * DIM, np.float32)
            for a in range(0, len(s.data), _PIECE):
                text = _NORMAL[s.data[a:a + _PIECE + 2]]
                own = min(_PIECE, len(s.data) - a)
                row = np.searchsorted(s.offsets, np.arange(a, a + own) if rows > 1 else np.zeros(0), "right") - 1 if rows > 1 else np.zeros(own, np.int64)
                end = s.offsets[1:][row]
                gram = np.zeros(own, np.uint32)
                blank = np.ones(own, bool)
                for n in range(3):
                    part_n = text[n:n + own]
                    k = len(part_n)
                    gram[:k] = (gram[:k] + _VALUE32[part_n]) * np.uint32(0x9E3779B1)
                    gram[:k] ^= gram[:k] >> np.uint32(15)
                    blank[:k] &= part_n == 0x20
                    ok = np.flatnonzero(~blank[:k] & (np.arange(a + n, a + n + k) < end[:k]))
                    bucket = (gram[ok] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - DIM_BITS)
                    total += np.bincount(row[ok] * DIM + bucket, minlength=rows * DIM)
            yield first + s.first, total.reshape(rows, DIM)


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(length, 1e-12)


def _document_frequency(batches):
    total = np.zeros(DIM, np.int64)
    for batch in batches:
        for _, counts in _counts(batch.column("text")):
            total += (counts > 0).sum(axis=0)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "rows"])


def _vectors(batches, idf):
    for batch in batches:
        for first, counts in _counts(batch.column("text")):
            x = _unit(counts, idf)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(first, len(x)), batch.column("at").slice(first, len(x)),
                 pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["lang", "at", "vector"])


def _cluster(group: pd.DataFrame, fit_rows: int, k: int) -> pd.DataFrame:
    """Spherical k-means of one language's sample; at most ``fit_rows`` rows."""
    group = group.sort_values(["at", "vector"]).head(fit_rows)
    x = np.stack([np.frombuffer(v, np.float16) for v in group["vector"]]).astype(np.float32)
    c = x[:1]
    while len(c) < min(k, len(x)):  # the next start is what the others reach least
        c = np.concatenate((c, x[[np.argmin((x @ c.T).max(axis=1))]]))
    near = np.zeros(len(x), int)
    for step in range(20):
        now = (x @ c.T).argmax(axis=1)
        if step and (now == near).all():
            break
        near = now
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].mean(axis=0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
    cosine = (x * c[near]).sum(axis=1)
    used = [j for j in range(len(c)) if (near == j).any()]
    return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c[j].astype(np.float32).tobytes() for j in used],
                         "threshold": [float(np.quantile(cosine[near == j], REJECT_QUANTILE)) * REJECT_MARGIN for j in used]})


def fit(train: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Model:
    """A model from ``train`` (doc_id, text, lang); rows with a null text or lang are left out.

    What comes to the driver is bounded by languages * centroids * DIM numbers.
    """
    train = train.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    n = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    df = (train.select("text").mapInArrow(_document_frequency, "bucket int, rows long")
          .groupBy("bucket").agg(F.sum("rows").alias("rows")).toPandas())
    rows = np.zeros(DIM)
    rows[df["bucket"].to_numpy(int)] = df["rows"].to_numpy()
    idf = (np.log((1 + sum(n.values())) / (1 + rows)) + 1).astype(np.float32)
    if not n:
        return Model([], np.zeros((0, DIM), np.float32), np.zeros(0), idf)
    share = F.create_map(*[F.lit(x) for lang, k in sorted(n.items()) for x in (lang, min(1.0, 1.2 * fit_rows / k))])
    sample = (train.withColumn("at", F.xxhash64(F.lit("langid"), "doc_id", "text"))
              .filter(F.pmod("at", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)))
    found = (sample.select("text", "lang", "at").mapInArrow(lambda it: _vectors(it, idf), "lang string, at long, vector binary")
             .groupBy("lang").applyInPandas(lambda g: _cluster(g, fit_rows, centroids), "lang string, centroid binary, threshold double")
             .toPandas().sort_values(["lang", "centroid"]))
    return Model(found["lang"].tolist(), np.stack([np.frombuffer(c, np.float32) for c in found["centroid"]]), found["threshold"].to_numpy(), idf)


def _predict(batches, model: Model):
    languages, centroids, threshold, idf = model
    names = np.array([*languages, UNDETERMINED], dtype=object)
    for batch in batches:
        text = batch.column("text")
        letters = pc.fill_null(pc.match_substring_regex(text.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
        best, score, rejected = np.full(len(text), len(languages)), np.zeros(len(text)), np.ones(len(text), bool)
        if languages:
            for first, counts in _counts(text):
                cosine = _unit(counts, idf) @ centroids.T
                near, at = cosine.argmax(axis=1), slice(first, first + len(cosine))
                value = cosine[np.arange(len(cosine)), near]
                best[at], score[at], rejected[at] = near, np.clip(value, 0, 1), value < threshold[near]
        best[~letters], score[~letters], rejected[~letters] = len(languages), 0.0, True
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)],
                                         ["doc_id", "held_out", "lang_pred", "score", "rejected"])


def predict(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine), rejected for every row of ``docs``.

    ``und`` with score 0, rejected: a null text, one without a letter, and any text if no
    language was learned.  The text alone decides; ties go to the first language by name.
    Rows with a null doc_id are predicted like others; extra columns are ignored.
    """
    packed = shared(docs.sparkSession, model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out")).mapInArrow(
        lambda it: _predict(it, packed()), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, folds: int = 5, **options) -> DataFrame:
    """Learn from the rows whose crc32(doc_id as text) isn't divisible by ``folds``, and
    predict every row.  A row with a null doc_id is neither held out nor learned from."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model = fit(docs.filter(fold != 0), **options)
    return predict(docs, model, F.coalesce(fold == 0, F.lit(False)))
