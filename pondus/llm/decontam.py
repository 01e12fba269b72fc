"""Benchmark decontamination: BM25 retrieval of test items, then overlap of their parts.

The test items form an inverted index with BM25 impacts.  An item's own length sets the length
of the training passages that are compared with it (a window of words, at least twice as
long as the item, half of it shared with the next), so its hits don't depend on what
other items there are.  Items with passages of one length are cut into blocks; a block keeps
the postings (item, impact) of each term and its largest impact.  Every training passage is
a query.  As in block-max WAND, the sum of the block's largest impacts over
the passage's terms bounds every item's score, so most passages are discarded without being
scored; it comes for all passages at once from sums over half passages, in place of cursors.
In the others, the postings of the half passages bound each item; what remains is scored
exactly, and every item with at least ``ratio`` of the score that it gives itself is retrieved.  A
retrieved item counts when the passage holds at least ``overlap`` of the word n-grams of its
question (all sentences but the last) and of its answer (the last sentence).

The index travels to the tasks.  Its size is bounded: a larger benchmark is cut into parts of
``PART_BYTES`` of text, each of which gets a pass over the documents; document frequencies
are those of the whole benchmark.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import releasing, shared

K1, B = 1.2, 0.75
#: Share of an item's own score, and of the n-grams of its question and answer.
RATIO, OVERLAP, GRAM = 0.5, 0.5, 3
BLOCK_ITEMS = 64
PART_BYTES = 8 << 20
_CHUNK = 1024
_SLICE = 1 << 18
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _hashes(text: str) -> np.ndarray:
    return next((T.words(s, T.ALNUM).hash for s in T.slices(pa.array([text]))), np.zeros(0, np.uint64))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(h))
    out = np.zeros(max(0, len(h) - n + 1) if n else 0, np.uint64)
    for j in range(n):
        out += h[j:j + len(out)] * T.GRAM_MULT[j]
    return np.unique(T.mix(out + np.uint64(n)))


def parts_of(text: str) -> tuple[str, str]:
    """(question, answer): the last sentence is the answer; a single sentence is halved."""
    sentences = [x for x in _SENTENCE.split(text.strip()) if x]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = text.split()
    return " ".join(words[:len(words) // 2]), " ".join(words[len(words) // 2:])


def window_of(words: int) -> int:
    """Words of the passages that an item of so many words is compared with: at least twice as
    many, in steps of a half power of two, so that items share them."""
    size = 16
    while size < 2 * words:
        size = size * 3 // 2 if size & (size - 1) == 0 else size // 3 * 4
    return size


class _Block:
    """Items with passages of ``window`` words.  ``start``, ``item`` and ``impact`` are the
    postings: those of vocabulary place v stand from start[v] to start[v + 1]."""

    def __init__(self, items, idf, average, ratio, gram):
        self.ids = [(False, i, "") if i is not None else (True, 0, t) for i, t, _ in items]  # without an id, the text is the key
        self.window = window_of(max(len(h) for _, _, h in items))
        self.vocabulary = np.unique(np.concatenate([h for _, _, h in items]))
        self.maybe = np.zeros(1 << 16, bool)  # by a hash's low bits
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        places, owners, impacts = [], [], []
        for k, (_, _, h) in enumerate(items):
            term, tf = np.unique(h, return_counts=True)
            places.append(np.searchsorted(self.vocabulary, term))
            owners.append(np.full(len(term), k))
            impacts.append([idf[int(t)] for t in term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / average))))
        place, self.item, self.impact = np.concatenate(places), np.concatenate(owners), np.concatenate(impacts)
        order = np.argsort(place, kind="stable")
        place, self.item, self.impact = place[order], self.item[order], self.impact[order]
        self.start = np.searchsorted(place, np.arange(len(self.vocabulary) + 1))
        self.most = np.maximum.reduceat(self.impact, self.start[:-1])
        self.need = ratio * np.bincount(self.item, weights=self.impact, minlength=len(items)) - 1e-4
        self.parts = [tuple(_grams(_hashes(p), gram) for p in parts_of(t)) for _, t, _ in items]
        self.lengths = sorted({min(gram, len(_hashes(p))) for _, t, _ in items for p in parts_of(t)} - {0})

    def scores(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores of all items for ``n`` rows, each given by its distinct terms (vocabulary places)."""
        many = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        k = len(self.ids)
        return np.bincount(np.repeat(row, many) * k + self.item[at], weights=self.impact[at], minlength=n * k).reshape(n, k)


class Index:
    """Blocks of items: ``items`` are (id, text); ``frequency`` and ``n`` are those of the
    whole benchmark."""

    def __init__(self, items, frequency: dict[int, int], n: int, average: float, ratio=RATIO, overlap=OVERLAP, gram=GRAM, block=BLOCK_ITEMS):
        items = sorted(((i, t, h) for i, t in items if len(h := _hashes(t))), key=lambda x: (len(x[2]), x[0] is None, x[0] or 0, x[1]))
        idf = {t: float(np.log(1 + (n - df + 0.5) / (df + 0.5))) for t, df in frequency.items()}
        self.overlap = overlap
        windows = np.array([window_of(len(h)) for _, _, h in items], int)
        self.blocks = [_Block([items[i] for i in own[k:k + block]], idf, average, ratio, gram)
                       for own in (np.flatnonzero(windows == size) for size in np.unique(windows)) for k in range(0, len(own), block)]

    def _score(self, w, block, live, row, left, right, half, term, first_half, best):
        """Items whose bounds survive in passages whose blocks did, then exact scores and overlaps."""
        used = np.unique(np.concatenate((left[live], right[live])))
        low, high = np.searchsorted(half, used), np.searchsorted(half, used, "right")
        many = high - low
        picked = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        scores = block.scores(np.repeat(np.arange(len(used)), many), term[picked], len(used))
        bound = scores[np.searchsorted(used, left[live])] + scores[np.searchsorted(used, right[live])]
        step = block.window // 2
        for p in live[(bound >= block.need).any(axis=1)]:
            a = int(w.bounds[row[p]] + step * (left[p] - first_half[row[p]]))
            b = min(a + block.window, int(w.bounds[row[p] + 1]))
            held = np.flatnonzero(np.isin(block.vocabulary, w.hash[a:b]))
            score = block.scores(np.zeros(len(held), np.int64), held, 1)[0]
            have = None
            for k in np.flatnonzero(score >= block.need):
                if have is None:
                    have = np.concatenate([_grams(w.hash[a:b], n) for n in block.lengths])
                question, answer = (float(np.isin(g, have).mean()) if len(g) else 1.0 for g in block.parts[k])
                if min(question, answer) >= self.overlap:
                    key = (int(row[p]), block.ids[k])
                    new = (float(score[k]), int(a - w.bounds[row[p]]), question, answer)
                    if key not in best or new[0] > best[key][0]:
                        best[key] = new

    def search(self, w: T.Words):
        """(row, item, first word, score, question overlap, answer overlap) of the best passage
        for each row and item."""
        best: dict[tuple[int, int], tuple] = {}
        count = np.diff(w.bounds)
        for block in self.blocks:
            v, step = block.vocabulary, block.window // 2
            known = np.flatnonzero(block.maybe[w.hash & np.uint64(0xFFFF)])
            at = np.minimum(np.searchsorted(v, w.hash[known]), len(v) - 1)
            hit = v[at] == w.hash[known]
            known, ids = known[hit], at[hit]
            # half passages, and each of their terms once
            halves = -(-count // step)
            first_half = np.cumsum(halves) - halves
            half = first_half[w.row[known]] + (known - w.bounds[w.row[known]]) // step
            pairs = np.unique(half * len(v) + ids)
            half, term = pairs // len(v), pairs % len(v)
            most = np.bincount(half, weights=block.most[term], minlength=int(halves.sum()) + 1)
            passages = np.where(count > 0, np.maximum(1, halves - 1), 0)
            row = np.repeat(np.arange(len(count)), passages)
            left = first_half[row] + np.arange(len(row)) - np.repeat(np.cumsum(passages) - passages, passages)
            right = np.where(left + 1 < first_half[row] + halves[row], left + 1, len(most) - 1)
            live = np.flatnonzero(most[left] + most[right] >= block.need.min())
            for c in range(0, len(live), _CHUNK):
                self._score(w, block, live[c:c + _CHUNK], row, left, right, half, term, first_half, best)
        return [(row, None if item[0] else item[1], first, score, q, a) for (row, item), (score, first, q, a) in sorted(best.items())]


@releasing
def _terms(batches):
    for batch in batches:
        for s in T.slices(batch.column("text"), _SLICE):
            w = T.words(s, T.ALNUM)
            values, bounds = T.sets(w.row, w.hash, len(s.offsets) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["term"])


def indexes(benchmark: DataFrame, part_bytes: int = PART_BYTES, **options) -> list[Index]:
    """The index, in parts of bounded size.  Null and empty texts match nothing;
    items without an id count like others."""
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL").distinct()
    n, size, words = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.avg(F.size(F.split("text", r"\s+")))).first()
    parts = max(1, -(-size // part_bytes))
    frequency = items.select("text").mapInArrow(_terms, "term long").groupBy("term").agg(F.count("*").alias("df"))
    out = []
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        used = own.select("text").mapInArrow(_terms, "term long").distinct()
        df = {int(np.int64(r["term"]).view(np.uint64)): r["df"] for r in frequency.join(used, "term").collect()}
        out.append(Index([(r["item_id"], r["text"]) for r in own.collect()], df, n, float(words or 1), **options))
    return [x for x in out if x.blocks]


@releasing
def _retrieve(batches, index: Index):
    for batch in batches:
        found = []
        for s in T.slices(batch.column("text"), _SLICE):
            found += [(s.first + x[0], *x[1:]) for x in index.search(T.words(s, T.ALNUM))]
        rows = [x[0] for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64()))] + [
            pa.array([x[k] for x in found], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64()), (5, pa.float64()))],
            ["doc_id", "item_id", "first_word", "score", "question_overlap", "answer_overlap"])


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, first_word, score, question_overlap, answer_overlap): every document
    with every test item that it holds, and the passage with the best score, the first of ties.

    Null and empty texts and items match nothing; an item with a null id is reported with it,
    each of these texts on its own; a document with a null id is reported with
    it; repeated rows are reported each; extra columns are ignored.  Without items or
    documents the result is empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"
    out = []
    for index in indexes(benchmark, **options):
        packed = shared(docs.sparkSession, index)
        out.append(rows.mapInArrow(lambda it, packed=packed: _retrieve(it, packed()), schema))
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], schema)


@releasing
def _clean(batches, index: Index):
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for s in T.slices(batch.column("text"), _SLICE):
            for x in index.search(T.words(s, T.ALNUM)):
                keep[s.first + x[0]] = False
        yield batch.filter(pa.array(keep))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a test item; columns as they are, no shuffle."""
    for index in indexes(benchmark, **options):
        packed = shared(docs.sparkSession, index)
        docs = docs.mapInArrow(lambda it, packed=packed: _clean(it, packed()), docs.schema)
    return docs
