"""License scan: exact set-similarity join of text blocks with license templates.

For each template a text is cut into overlapping blocks of words, twice as long as the template,
so that every run of its length lies within one.  A block matches a template when it holds at
least ``threshold`` of the template's distinct words, among them its key words: those that
name the license.  Of templates so alike that a text of one reaches the threshold of another,
the one that holds more of its words wins where their blocks overlap, so a license isn't taken for
its sibling.  All words are ordered by their frequency in the whole corpus, rare first, and

* *prefix*: of the first ``|T| - ceil(t |T|) + 1`` words of a template one must be present,
  so a block without any of these rare words isn't looked at;
* *length*: a block needs ``ceil(t |T|)`` distinct template words;
* *position*: with the first common word at place i of the ordered template and place j of the
  block's ordered words, the overlap is at most ``min(|T| - i, |B| - j)``.

The templates are a parameter of bounded size and travel to the tasks; the corpus is read
twice, once for the frequencies and once for the join, and never shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import shared

# Phrases that count wherever their words stand consecutively.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Opening words of public licenses, matched by containment.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
]
# The words without which a text is none of these, in the same order.
KEYS = [
    "permission granted software",
    "mit license",
    "apache 2",
    "apache 2",
    "redistribution source binary",
    "gnu general public license",
    "mozilla 2",
    "creative commons attribution",
    "creative commons sharealike",
    "creative commons noncommercial",
    "rights reserved",
]
THRESHOLD = 0.8


class Template(NamedTuple):
    label: str
    words: np.ndarray  # distinct hashes, rare first
    need: int
    keys: np.ndarray = np.zeros(0, np.uint64)  # hashes of the words that must be there
    size: int = 0  # words of its blocks


def _hashes(text: str) -> np.ndarray:
    (s,) = T.slices(pa.array([text]))
    return T.words(s, T.ALNUM).hash


def _count(batches, vocabulary: np.ndarray):
    total = np.zeros(len(vocabulary), np.int64)
    for batch in batches:
        for s in T.slices(batch.column("text")):
            h = T.words(s, T.ALNUM).hash
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["word", "times"])


def ordered_templates(docs: DataFrame, templates, threshold: float) -> list[Template]:
    """The templates with their words in order of corpus frequency, ties by hash."""
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[_hashes(t[1]) for t in templates]]))
    if not len(vocabulary):
        return []
    times = np.zeros(len(vocabulary), np.int64)
    for r in (docs.select("text").mapInArrow(lambda it: _count(it, vocabulary), "word int, times long")
              .groupBy("word").agg(F.sum("times").alias("times")).collect()):
        times[r["word"]] = r["times"]
    out = []
    for label, text, *keys in templates:
        words = np.unique(_hashes(text))
        if len(words):
            words = words[np.lexsort((words, times[np.searchsorted(vocabulary, words)]))]
            key = np.unique(_hashes(keys[0])) if keys else words[:0]
            out.append(Template(label, words, max(1, int(np.ceil(threshold * len(words) - 1e-9))), key[np.isin(key, words)], 2 * len(_hashes(text))))
    return out


class _Join:
    """Templates prepared for the tasks; with ``size``, all have blocks of that length."""

    def __init__(self, templates: list[Template], phrases: dict[str, str], size: int | None = None):
        self.templates, self.sizes = templates, [size or t.size for t in templates]
        self.phrases = [(_hashes(p), label) for p, label in phrases.items()]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t.words for t in templates]]))
        self.place = [np.searchsorted(self.vocabulary, t.words) for t in templates]
        self.keys = [np.searchsorted(self.vocabulary, t.keys) for t in templates]
        self.rank = self._ranks()
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}  # block length -> word -> (template, place)
        for k, t in enumerate(templates):
            for i, word in enumerate(self.place[k][:len(t.words) - t.need + 1]):
                self.prefix.setdefault(self.sizes[k], {}).setdefault(int(word), []).append((k, i))
        self.rare = {size: np.isin(np.arange(len(self.vocabulary)), list(words)) for size, words in self.prefix.items()}
        self.any_rare = np.zeros(len(self.vocabulary), bool)
        for rare in self.rare.values():
            self.any_rare |= rare
        share = lambda k, j: np.isin(self.place[j], self.place[k]).mean()
        self.alike = [[j for j, u in enumerate(templates) if u.label != t.label and (share(k, j) * len(u.words) >= u.need or share(j, k) * len(t.words) >= t.need)]
                      for k, t in enumerate(templates)]

    def _ranks(self) -> np.ndarray:
        """One order of the vocabulary that agrees with every template's (all follow the corpus)."""
        after: dict[int, set[int]] = {}
        for places in self.place:
            for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
                after.setdefault(a, set()).add(b)
        rank, done = np.zeros(len(self.vocabulary), np.int64), []
        seen: set[int] = set()
        for first in range(len(self.vocabulary)):
            stack = [(first, iter(sorted(after.get(first, ()))))] if first not in seen else []
            seen.add(first)
            while stack:
                word, rest = stack[-1]
                for nxt in rest:
                    if nxt not in seen:
                        seen.add(nxt)
                        stack.append((nxt, iter(sorted(after.get(nxt, ())))))
                        break
                else:
                    done.append(word)
                    stack.pop()
        rank[done[::-1]] = np.arange(len(done))
        return rank

    def row(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """The best of ``blocks`` for each template, the first of ties."""
        found = self.blocks(ids)
        return [(self.templates[k].label, *max(blocks, key=lambda x: x[2])) for k, blocks in sorted(found.items())]

    def blocks(self, ids: np.ndarray) -> dict[int, list[tuple[int, int, float]]]:
        """(first word, end, containment) of every block that holds a template, for each
        template found in a text whose words are the vocabulary places ``ids``, -1 for others.
        Overlapping blocks of one template become one, with the highest containment; blocks
        where a sibling holds more of its words are left out."""
        known = np.flatnonzero(ids >= 0)
        found: dict[int, list[tuple[int, int, float]]] = {}
        for size, rare in self.rare.items():
            seeds = known[rare[ids[known]]]
            if len(seeds):
                self._of_size(ids, known, seeds, size, rare, found)
        out = {}
        for k, blocks in found.items():
            words = len(self.templates[k].words)
            kept = [(a, b, x) for a, b, x in blocks if not any(
                c < b and a < d and (y, y * len(self.templates[j].words)) > (x, x * words) for j in self.alike[k] for c, d, y in found.get(j, ()))]
            if kept:
                out[k] = kept
        return out

    def _of_size(self, ids, known, seeds, size, rare, found) -> None:
        step = max(1, size // 2)
        last = max(0, (len(ids) - size + step - 1) // step)  # the block that reaches the end
        low = np.clip((seeds - size + step) // step, 0, last)
        for block in np.unique(np.concatenate((low, np.minimum(low + 1, last), np.minimum(seeds // step, last)))):
            a, b = block * step, min(len(ids), block * step + size)
            inside = known[np.searchsorted(known, a):np.searchsorted(known, b)]
            have = np.zeros(len(self.vocabulary), bool)
            have[ids[inside]] = True
            ranks = np.sort(self.rank[have])
            candidates: dict[int, int] = {}
            for word in np.flatnonzero(have & rare):
                for k, i in self.prefix[size].get(int(word), ()):
                    candidates[k] = min(i, candidates.get(k, i))
            for k, i in candidates.items():
                t = self.templates[k]
                behind = len(ranks) - int(np.searchsorted(ranks, self.rank[self.place[k][i]]))  # the block's words from that one on
                if min(behind, len(t.words) - i) < t.need or not have[self.keys[k]].all():
                    continue
                share = float(have[self.place[k]].sum()) / len(t.words)
                if share * len(t.words) >= t.need - 1e-9:
                    blocks = found.setdefault(k, [])
                    if blocks and a < blocks[-1][1]:
                        first, _, most = blocks.pop()
                        blocks.append((first, int(b), max(most, share)))
                    else:
                        blocks.append((int(a), int(b), share))


def _scan(batches, join: _Join):
    for batch in batches:
        cols: list[list] = [[] for _ in range(8)]
        for s in T.slices(batch.column("text")):
            w = T.words(s, T.ALNUM)
            n = len(s.offsets) - 1
            hits = [[] for _ in range(n)]
            for phrase, label in join.phrases:
                k = max(0, len(w.hash) - len(phrase) + 1)
                same = np.ones(k, bool) if len(phrase) else np.zeros(k, bool)
                for j, h in enumerate(phrase):
                    same &= w.hash[j:j + k] == h
                at = np.flatnonzero(same)
                at = at[w.row[at] == w.row[at + len(phrase) - 1]]
                for p in at:
                    hits[w.row[p]].append((int(p - w.bounds[w.row[p]]), label))
            at = np.minimum(np.searchsorted(join.vocabulary, w.hash), max(0, len(join.vocabulary) - 1))
            ids = np.where(join.vocabulary[at] == w.hash, at, -1) if len(join.vocabulary) else np.full(len(at), -1)
            rare = ids >= 0
            rare[rare] = join.any_rare[ids[rare]]
            seeded = np.bincount(w.row[rare], minlength=n) > 0
            for r in range(n):
                found = join.blocks(ids[w.bounds[r]:w.bounds[r + 1]]) if seeded[r] else {}
                own = [(join.templates[k].label, *x) for k, blocks in sorted(found.items()) for x in blocks]
                base = sorted({label for _, label in hits[r]})
                for c, v in zip(cols, (int(w.bounds[r + 1] - w.bounds[r]), len(hits[r]), min((p for p, _ in hits[r]), default=None), max((p for p, _ in hits[r]), default=None),
                                       ",".join(base), ",".join(sorted({*base, *(x[0] for x in own)})), max([1.0 if base else 0.0, *(x[3] for x in own)]),
                                       [dict(zip(("label", "first_word", "end_word", "containment"), x)) for x in own])):
                    c.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
                 pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                         ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """``templates`` are (label, text) or (label, text, key words).  A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score and blocks (every block that holds a template, overlapping ones merged).

    n_base counts every place of a phrase; labels are those of phrases and templates, without
    repeats, sorted, comma-joined; score is the best containment, 1 with a phrase, 0 with
    nothing.  A null or empty text has no words, nulls for the places and empty labels.  Rows
    with null or repeated ids stay as they are; extra columns are ignored.
    """
    if templates is TEMPLATES:
        templates = [(*t, k) for t, k in zip(TEMPLATES, KEYS)]
    ordered = ordered_templates(docs, templates, threshold)
    join = shared(docs.sparkSession, _Join(ordered, phrases))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda it: _scan(it, join()),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "blocks array<struct<label: string, first_word: long, end_word: long, containment: double>>")
