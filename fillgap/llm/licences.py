"""Licence scans with a positional rare-token index.

The words of all licence phrases are a small vocabulary. One pass over all documents counts how many of them hold each
word of it. Every phrase is posted, with relative positions, under its rarest words, those of highest inverse document
frequency. A second pass orders each document's licence words by that frequency, takes them from the top as far as the
phrases need of which the document has all words, and notes where these words stand. Each posting turns the places of
its word into places where the phrase would have to start; a phrase's candidates are the intersection of its postings,
and those remain at which the whole mandatory phrase stands. A longer template around the phrase scores by the weight
of its words that stand in place. Both passes are narrow: nothing but the word counts is shuffled. Only DataFrame
functions run here.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that stand for a label by themselves.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Label: (template, the phrase of it that has to be there).
TEMPLATES = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "affero general public license version 3"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc 4 0"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "cc by sa 4 0"),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "lgpl": ("licensed under the gnu lesser general public license", "gnu lesser general public license"),
    "mit": ("released under the mit license", "mit license"),
    "mpl-2.0": ("subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2 0"),
}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def vocabulary() -> list[str]:
    return sorted({w for phrase in BASE.values() for w in phrase.split()} | {w for template, _ in TEMPLATES.values() for w in template.split()})


def word_weights(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every word of the vocabulary, counted over all documents. One row a word reaches the driver."""
    present = docs.select(F.array_append(F.array_intersect(words_of(F.col("text")), _strings(vocabulary())), F.lit("")).alias("present"))
    counts = dict(present.select(F.explode("present").alias("word")).groupBy("word").count().collect())
    total = counts.pop("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary()}


#: Under how many of its words a phrase is posted.
POSTINGS = 3


def postings(phrase: list[str], weights: dict[str, float]) -> list[tuple[str, int]]:
    """The phrase's rarest words with their positions in it, rarest first; ties go by position."""
    return sorted(((w, i) for i, w in enumerate(phrase)), key=lambda x: (-weights[x[0]], x[1]))[:POSTINGS]


def _complete(phrase: list[str]) -> Column:
    return F.size(F.array_except(_strings(sorted(set(phrase))), F.col("present"))) == 0


def _rarest(phrases: list[list[str]], weights: dict[str, float]) -> Column:
    """The document's rarest licence words: as many of them as the phrases need of which it has all words."""

    def depth(phrase: list[str]) -> Column:
        return F.greatest(F.lit(0), *[F.array_position("present", w) for w in sorted({w for w, _ in postings(phrase, weights)})])

    return F.slice("present", F.lit(1), F.greatest(F.lit(0), *[F.when(_complete(p), depth(p)) for p in phrases]).cast("int"))


def _places_of(rarest: str) -> Column:
    """Where these words stand."""
    at = F.array_compact(F.transform("words", lambda w, i: F.when(F.array_contains(rarest, w), F.struct(w.alias("word"), i.alias("at")))))
    return F.when(F.size(rarest) > 0, at).otherwise(F.array().cast("array<struct<word:string,at:int>>"))


def _starts(phrase: list[str], weights: dict[str, float]) -> Column:
    """Places where the phrase stands: its postings intersected by relative position, then the whole phrase compared."""

    def posted(word: str, offset: int) -> Column:
        return F.transform(F.filter("rare", lambda x: x["word"] == word), lambda x: x["at"] - offset)

    starts = reduce(F.array_intersect, [posted(*x) for x in postings(phrase, weights)])
    found = F.filter(starts, lambda s: (s >= 0) & (F.slice("words", F.greatest(s + 1, F.lit(1)), F.lit(len(phrase))) == _strings(phrase)))
    return F.when(_complete(phrase), found).otherwise(F.array().cast("array<int>"))


def _in_place(starts: str, template: list[str], phrase: list[str], weights: dict[str, float]) -> Column:
    """The largest share of the template's weight whose words stand in place around one of the starts; 0 without a start."""
    shift = next(i for i in range(len(template)) if template[i : i + len(phrase)] == phrase)
    total = sum(weights[w] for w in template)

    def share(s: Column) -> Column:
        hit = F.lit(0.0)
        for i, w in enumerate(template):
            hit = hit + F.when((s + (i - shift) >= 0) & (F.get("words", s + (i - shift)) == w), F.lit(weights[w])).otherwise(F.lit(0.0))
        return F.least(hit / total, F.lit(1.0))

    return F.when(F.size(starts) > 0, F.array_max(F.transform(starts, share))).otherwise(0.0)


def scan(docs: DataFrame) -> DataFrame:
    """Licence phrases and labels of every document.

    Input: doc_id, text; other columns are ignored. Output, one row for every input row: doc_id, n_words, n_base (places
    of base phrases), first_word and last_word (the smallest and largest of their starts; null without any),
    base_labels, labels (distinct, sorted, comma-joined; '' without any), score (1 where a base phrase stands, else the
    share of the best template's weight that stands in place). Null text counts as empty, repeated rows are scanned
    each, and no rows give no rows. Texts are scanned whole, whatever their length.
    """
    weights = word_weights(docs)
    rarest_first = sorted(weights, key=lambda w: (-weights[w], w))
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("present", F.array_intersect(_strings(rarest_first), F.col("words")))
    phrases = [p.split() for p in [*BASE.values(), *(must for _, must in TEMPLATES.values())]]
    rows = rows.withColumn("rarest", _rarest(phrases, weights)).withColumn("rare", _places_of("rarest"))
    base = {label: f"base{i}" for i, label in enumerate(sorted(BASE))}
    own = {label: f"own{i}" for i, label in enumerate(sorted(TEMPLATES))}
    rows = rows.select(
        "doc_id", "words",
        *[_starts(BASE[label].split(), weights).alias(c) for label, c in base.items()],
        *[_starts(TEMPLATES[label][1].split(), weights).alias(c) for label, c in own.items()],
    )
    places = F.concat(*base.values())
    shares = [_in_place(c, *(x.split() for x in TEMPLATES[label]), weights) for label, c in own.items()]

    def labels(of: dict[str, str]) -> Column:
        return F.array(*[F.when(F.size(c) > 0, F.lit(label)) for label, c in of.items()])

    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(labels(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels(base | own)), ",").alias("labels"),
        F.round(F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.greatest(*shares)), 9).alias("score"),
    )
