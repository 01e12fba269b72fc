"""Fixtures of the llm tests."""

import random

from pyspark.sql import functions as F

DOCS = {
    "en": ["the cat and the dog went to the house of the man with the hat", "she was in the garden when the rain began and they ran home", "there is nothing that would be better than this for the people", "we have been there with them and it was a good thing to do"],
    "de": ["der hund und die katze gehen in das haus und schlafen nicht", "ich habe das nicht gewusst aber wir sind mit dem zug gefahren", "es ist nicht einfach die sprache zu lernen und zu sprechen", "die kinder spielen im garten und der vater liest ein buch"],
}


def docs_of(spark, texts):
    """documents with columns that clash with the operators' own names."""
    return (spark.createDataFrame(list(texts.items()), "doc_id long, text string")
            .withColumns({"node": F.lit("n"), "gram": F.lit(1), "size": F.lit(2), "score": F.lit("s"), "term": F.lit(0.5), "a": F.lit(1), "item_id": F.lit(7)}))


def awkward(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [(1, "one two three four five six"), (2, "One two  three four five six"), (2, "One two  three four five six"), (3, None), (4, ""), (5, " \n\t "), (6, "a b"), (7, long),
            (8, "x" * 2_000_000), (None, "one two three four five six"), (9, "ünï çödé 🙂   　")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("n"), "copy": F.lit(1), "own": F.lit(2), "source": F.lit(None).cast("string")})


def near_copies():
    """Groups of near copies around the threshold, a passage that many share, short texts."""
    rng = random.Random(8)
    word = lambda: f"t{rng.randrange(4000)}"
    passage = [word() for _ in range(25)]
    texts, i = {}, 0
    for group in range(12):
        base = [word() for _ in range(rng.randint(20, 90))]
        for _ in range(rng.choice([2, 3, 14])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += [word() for _ in range(rng.randint(1, 10))]
            texts[i] = " ".join(copy)
            i += 1
    for _ in range(40):  # the passage and a tail: some link, some don't
        texts[i] = " ".join(passage + [word() for _ in range(rng.randint(0, 14))])
        i += 1
    for t in ("a", "A", "a b", "a  B", "b a", "", None, "a b c d e", "a b c d e f", "x " * 50):
        texts[i] = t
        i += 1
    for k in (3, 9, 30):  # copies
        texts[i] = texts[k].upper()
        i += 1
    return texts
