r"""Personal data: base patterns, and terms that give a protected entity away.

Base spans are e-mail addresses, IP addresses, card and phone numbers.  Each distinct value
is a protected entity.  Words of a text that holds an entity can disclose it (a name, a
ticket number), which the corpus shows: with N different texts, n(e) that hold the entity,
n(t) that hold the term and n(e,t) that hold both, the term reveals

    PMI(t; e) = log(N n(e,t) / (n(e) n(t)))    of    IC(e) = log(N / n(e)).

In every text that holds e, each occurrence of a term is generalised (span ``term``) where
``PMI / IC`` reaches ``GENERALISE``, and removed (span ``drop``) from ``REMOVE`` on.  Copies
of a text count once, words of digits only are terms like others, and a term needs ``SUPPORT`` different texts with the entity.  A text
without base spans stays as it is.

With n(e,t) <= n(e), a term above the threshold g has ``n(t) <= N^(1-g) n(e)^g``, so frequent
words drop out before pairs are formed.  The corpus is read six times (copies, entities,
candidate terms, their frequencies, pairs, result); numbers per entity, term and pair are
summed in the tasks first, and texts are shuffled only if what a broadcast should hold is too much.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import _text as T
from ._spark import BROADCAST_ROWS, fresh, if_small, releasing, shared, written

# The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")

#: Words beside a span within which the brute-force test looks; the operator takes whole texts.
CONTEXT = 8
SUPPORT = 3
#: Keys that a task holds before it sums them.
ROWS = 1 << 20
GENERALISE, REMOVE = 0.8, 0.95
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "drop": ""}


def _emails(text: str):
    """Matches of the e-mail pattern, in time linear in the text: each is found by its @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, value) in code points, by start and kind; leftmost and not
    overlapping within a kind; a match that fails its check is dropped without a retry."""
    found = [(a, 0, b, text[a:b].lower()) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end(), m[0]) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end(), digits))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end(), digits))
    return sorted(found)


class _Words:
    """The words of one text outside its base spans; offsets in code points."""

    def __init__(self, text: str, spans):
        data = np.frombuffer(text.encode(), np.uint8)
        self.w = w = T.words(T.Slice(0, data, np.array([0, len(data)])), T.ALNUM)
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        self.at = lambda byte: np.searchsorted(chars, byte)
        to_byte = np.append(chars, len(data))
        start, end = (to_byte[[s[k] for s in spans]] for k in (0, 2))
        free = np.ones(len(w.start), bool)
        for a, b in zip(start, end):
            free[np.searchsorted(w.end, a, "right"):np.searchsorted(w.start, b)] = False
        self.free = np.flatnonzero(free)

    def terms(self) -> np.ndarray:
        return self.w.hash[self.free]


def _entity(kind: int, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{KINDS[kind]}:{value}".encode(), digest_size=8).digest(), "little")


def _pair(entity: int, terms: np.ndarray) -> np.ndarray:
    return T.mix(terms ^ T.mix(np.array([entity], np.uint64)))


def _held(base) -> np.ndarray:
    """The entities of a text, each once."""
    return np.unique(np.array([_entity(kind, value) for kind, value in {(s[1], s[3]) for s in base}], np.uint64))


def _summed(keys: list[np.ndarray], weights: np.ndarray, names: list[str]):
    """A record batch of the distinct keys and the sums of their weights."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(order) else np.zeros(0, int)
    total = np.add.reduceat(weights[order], first) if len(order) else np.zeros(0)
    return pa.RecordBatch.from_arrays([*[pa.array(k[first].view(np.int64)) for k in keys], pa.array(total)], names)


@releasing
def _sums(batches, of, names: list[str]):
    """The sums of weights by the keys that ``of`` gives for the base spans and text of each
    row (several times, of bounded size), summed whenever ``ROWS`` have come together."""
    keys: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in names[1:]]
    weights, rows = [np.zeros(0)], 0
    for batch in batches:
        for text, weight in zip(batch.column("text"), batch.column("weight").to_pylist()):
            text = text.as_py()
            if not (base := base_spans(text)):
                continue
            for found in of(text, base):
                for k, own in zip(keys, found):
                    k.append(own)
                weights.append(np.full(len(found[0]), weight))
                rows += len(found[0])
                if rows >= ROWS:
                    yield _summed([np.concatenate(k) for k in keys], np.concatenate(weights), names)
                    keys, weights, rows = [[np.zeros(0, np.uint64)] for _ in keys], [np.zeros(0)], 0
    yield _summed([np.concatenate(k) for k in keys], np.concatenate(weights), names)


def _within(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of ``values`` in ``sorted_values``, -1 for others."""
    if not len(sorted_values):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[at] == values, at, -1)


def _entities(text, base):
    yield (_held(base),)


def _near(text, base, entities):
    """The terms of a text that holds one of the sorted ``entities`` (of any, with None)."""
    if entities is None or (_within(entities, _held(base)) >= 0).any():
        yield (np.unique(_Words(text, base).terms()),)


def _both(text, base, entities, terms):
    """(entity, term) of a text.  ``entities`` are sorted hashes and the greatest n(t) for each,
    ``terms`` sorted hashes and n(t); without one of them, nothing is left out by it."""
    held, most = _held(base), None
    if entities is not None:
        at = _within(entities[0], held)
        held, most = held[at >= 0], entities[1][at[at >= 0]]
    if not len(held):
        return
    own = np.unique(_Words(text, base).terms())
    if terms is not None:
        at = _within(terms[0], own)
        own, n = own[at >= 0], terms[1][at[at >= 0]]
    for k, entity in enumerate(held):
        mine = own[n <= most[k]] if terms is not None and most is not None else own
        if len(mine):
            yield np.full(len(mine), entity), mine


@releasing
def _frequency(batches, terms: np.ndarray):
    """(term, n): weight of this task's texts that hold each of the sorted ``terms``."""
    total = np.zeros(len(terms))
    for batch in batches:
        weight = batch.column("weight").to_numpy()
        for s in T.slices(batch.column("text")):
            w = T.words(s, T.ALNUM)
            at = np.minimum(np.searchsorted(terms, w.hash), len(terms) - 1)
            hit = terms[at] == w.hash
            row, at = np.divmod(np.unique(w.row[hit] * len(terms) + at[hit]), len(terms))
            total += np.bincount(at, weight[s.first + row], len(terms))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(terms[seen].view(np.int64)), pa.array(total[seen])], ["term", "n_term"])


@releasing
def _all_terms(batches):
    for batch in batches:
        weight = batch.column("weight").to_numpy()
        for s in T.slices(batch.column("text")):
            w = T.words(s, T.ALNUM)
            values, bounds = T.sets(w.row, w.hash, len(s.offsets) - 1)
            each = np.repeat(weight[s.first:s.first + len(bounds) - 1], np.diff(bounds))
            values, at = np.unique(values, return_inverse=True)
            n = np.bincount(at, each, len(values))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["term", "n_term"])


def _weighted(docs: DataFrame) -> tuple[DataFrame, int]:
    """(text, weight), and the number of different texts.  The copies of a text share a weight
    of 1, so sums of weights (rounded) count different texts and no text is shuffled; only if
    very many texts have copies, the join with their numbers shuffles.  Texts are told apart
    by 128 bits; a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))
    copies = written(docs.groupBy("h", "g").agg(F.count("*").alias("n_copies")), "copies")
    several = if_small(copies.filter("n_copies > 1"))
    return docs.join(several, ["h", "g"], "left").select("text", F.coalesce(1 / F.col("n_copies"), F.lit(1.0)).alias("weight")), copies.count()


def disclosing_terms(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, share): hashes of the terms that disclose an entity, and the share of
    its information content that they reveal."""
    docs, n_texts = _weighted(docs)
    spark, n = docs.sparkSession, float(n_texts)

    def sums(of, schema: str) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        out = docs.mapInArrow(lambda it: _sums(it, of(), names), schema)
        return out.groupBy(*names[:-1]).agg(F.round(F.sum(names[-1])).alias(names[-1]))

    def sorted_columns(df: DataFrame, *columns: str):
        """The hashes of the first column sorted, the others in their order; None if too many."""
        if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            return None
        table = df.select(*columns).toArrow()
        key, *others = (table.column(c).to_numpy() for c in columns)
        order = np.argsort(key.view(np.uint64))
        return key.view(np.uint64)[order], *[x[order] for x in others]

    # The greatest n(t) with which a term can disclose an entity (less a rounding error).
    most = (1 + 1e-9) * n ** (1 - generalise) * F.col("n_entity") ** generalise
    entities = written(sums(lambda: _entities, "entity long, n_entity double")
                       .filter((F.col("n_entity") >= support) & (F.col("n_entity") < n)).withColumn("most", most), "entities")
    greatest = entities.agg(F.max("most")).first()[0]
    if greatest is None:
        return entities.select("entity", F.col("entity").alias("term"), F.lit(0.0).alias("share")).limit(0)
    few = shared(spark, sorted_columns(entities, "entity", "most"))

    def near():
        own = few()
        return lambda text, base: _near(text, base, own and own[0])
    candidates = written(sums(near, "term long, n_near double").filter((F.col("n_near") >= support) & (F.col("n_near") <= greatest)).select("term"), "candidates")
    if (listed := sorted_columns(candidates, "term")) is not None:
        terms = shared(spark, listed[0])
        counted = docs.mapInArrow(lambda it: _frequency(it, terms()), "term long, n_term double") if len(listed[0]) else candidates.withColumn("n_term", F.lit(0.0))
    else:
        counted = docs.mapInArrow(_all_terms, "term long, n_term double").join(candidates, "term", "left_semi")
    counted = written(counted.groupBy("term").agg(F.round(F.sum("n_term")).alias("n_term")).filter(F.col("n_term") <= greatest), "counted")
    rare = shared(spark, sorted_columns(counted, "term", "n_term"))

    def both():
        own, known = few(), rare()
        return lambda text, base: _both(text, base, own, known)
    pairs = sums(both, "entity long, term long, n_both double").filter(F.col("n_both") >= support)
    share = F.log(n * F.col("n_both") / (F.col("n_entity") * F.col("n_term"))) / F.log(n / F.col("n_entity"))
    return pairs.join(if_small(entities), "entity").join(if_small(counted), "term").select("entity", "term", share.alias("share")).filter(F.col("share") >= generalise)


class _Terms:
    """Disclosing (entity, term) pairs as sorted hashes, and whether their words are dropped."""

    def __init__(self, key: np.ndarray, drop: np.ndarray):
        order = np.argsort(key)
        self.key, self.drop = key[order], drop[order]

    def spans(self, text: str, base) -> list[tuple[int, int, str]]:
        if not base or not len(self.key):
            return []
        words = _Words(text, base)
        terms, place = np.unique(words.terms(), return_inverse=True)
        found, drop = np.zeros(len(terms), bool), np.zeros(len(terms), bool)
        for entity in _held(base):
            at = _within(self.key, _pair(entity, terms))
            found |= at >= 0
            drop |= (at >= 0) & self.drop[at]
        hit = found[place]
        start, end = (words.at(x[words.free[hit]]).tolist() for x in (words.w.start, words.w.end))
        return [(a, b, "drop" if d else "term") for a, b, d in zip(start, end, drop[place][hit])]


def all_spans(text: str, terms: _Terms) -> tuple[list, list[tuple[int, int, str]]]:
    """Base spans, and every span (start, end, kind) by start, then kind as listed."""
    base = base_spans(text)
    order = {k: i for i, k in enumerate((*KINDS, "term", "drop"))}
    spans = [(a, b, KINDS[kind]) for a, kind, b, _ in base] + terms.spans(text, base)
    return base, sorted(spans, key=lambda x: (x[0], order[x[2]]))


def sanitised(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind's tag; overlapping spans by the first's."""
    out, end = [], 0
    for a, b, kind in spans:
        if a >= end:
            out += [text[end:a], TAGS[kind]]
        end = max(end, b)
    return "".join((*out, text[end:]))


def _pairs(batches):
    """Each disclosing pair as one hash."""
    for batch in batches:
        entity, term = (batch.column(c).to_numpy().view(np.uint64) for c in ("entity", "term"))
        yield pa.RecordBatch.from_arrays([pa.array(T.mix(term ^ T.mix(entity)).view(np.int64)), batch.column("drop")], ["pair", "drop"])


@releasing
def _own_pairs(batches):
    """(doc_id, key, pair): the pairs of an entity and a term that each text holds."""
    for batch in batches:
        rows, found = [], [np.zeros(0, np.uint64)]
        for i, text in enumerate(batch.column("text")):
            text = text.as_py() or ""
            if spans := base_spans(text):
                terms = np.unique(_Words(text, spans).terms())
                own = np.unique(np.concatenate([_pair(entity, terms) for entity in _held(spans)]))
                rows += [i] * len(own)
                found.append(own)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "key", "pair"])


def _rows(batch, terms, mine):
    """The batch, and the terms of each of its rows: shared ones, or the row's own, in its
    column ``mine``."""
    if mine is None:
        return batch, [terms] * batch.num_rows
    own = [x.as_py() or [] for x in batch.column(mine)]
    return batch.drop_columns([mine]), [_Terms(np.array([x["pair"] for x in r], np.int64).view(np.uint64), np.array([x["drop"] for x in r], bool)) for r in own]


@releasing
def _find(batches, terms, mine=None):
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        batch, each = _rows(batch, terms, mine)
        for text, own in zip(batch.column("text"), each):
            base, spans = all_spans(text.as_py() or "", own)
            for kind in range(4):
                cols[kind].append(sum(s[1] == kind for s in base))
            listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in base)
            cols[4].append(hashlib.sha256(listed.encode()).hexdigest())
            cols[5].append(",".join(f"{k}:{a}:{b}" for a, b, k in spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols)]],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def _with_terms(docs: DataFrame, apply, schema, support: int, generalise: float, remove: float) -> DataFrame:
    """``docs`` through ``apply(batches, terms)``.  Up to BROADCAST_ROWS disclosing pairs travel
    in a broadcast; if there are more, each text's own pairs are joined with them, and the few that are left go along with the text."""
    flagged = written(disclosing_terms(docs, support, generalise).withColumn("drop", F.col("share") >= remove)
                      .mapInArrow(_pairs, "pair long, drop boolean"), "flagged")
    if flagged.count() <= BROADCAST_ROWS:
        few = flagged.toArrow()
        terms = shared(docs.sparkSession, _Terms(few.column("pair").to_numpy().view(np.uint64), few.column("drop").to_numpy(zero_copy_only=False)))
        return docs.mapInArrow(lambda it: apply(it, terms()), schema)
    key, id_, mine = F.xxhash64("text"), *fresh(docs, "_id", "_own")
    key_ = fresh(docs.withColumn(id_, F.lit(0)), "_key")[0]
    own = docs.select("doc_id", key.alias("key"), "text").mapInArrow(
        _own_pairs, StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("key", LongType()), StructField("pair", LongType())]))
    own = (own.distinct().join(flagged, "pair").groupBy(F.col("doc_id").alias(id_), F.col("key").alias(key_))
           .agg(F.collect_list(F.struct("pair", "drop")).alias(mine)))
    rows = docs.join(own, F.col("doc_id").eqNullSafe(F.col(id_)) & (key == F.col(key_)), "left")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], mine).mapInArrow(lambda it: apply(it, None, mine), schema)


def find(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null text is an empty one: no spans, the hash of the empty string.  Null and repeated
    ids stay as they are; extra columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_terms(docs, _find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
                       support, generalise, remove)


@releasing
def _replace(batches, terms, mine=None):
    for batch in batches:
        batch, each = _rows(batch, terms, mine)
        at = batch.schema.get_field_index("text")
        texts = []
        for text, own in zip(batch.column(at), each):
            text = text.as_py()
            spans = all_spans(text, own)[1] if text else []
            texts.append(sanitised(text, spans) if spans else text)
        arrays = [*batch.columns]
        arrays[at] = pa.array(texts, batch.schema.field(at).type)
        if "n_chars" in batch.schema.names:  # the documents table's own length of the text
            k = batch.schema.get_field_index("n_chars")
            old = batch.column(at)
            arrays[k] = pa.array([n.as_py() if new == was.as_py() else len(new) for n, new, was in zip(batch.column(k), texts, old)], batch.schema.field(k).type)
        yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)


def sanitise(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with every span of every text replaced; other texts and columns as they are
    (n_chars, if there, follows a changed text)."""
    return _with_terms(docs, _replace, docs.schema, support, generalise, remove)
