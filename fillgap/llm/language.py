"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram binds its letters: the vector of each is rolled by its place
and they are multiplied. A document is the bundle, the sum, of its n-grams' vectors, and so is a language's prototype
over a sample of its documents. A document gets the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgap.llm.common import columns_of, cut, drawn, held_out

DIMENSIONS = 512
GRAM = 3
UNKNOWN = "und"
KEPT_GRAMS = 1 << 15  # vectors of a byte a dimension that a task keeps before it starts its table anew
AT_ONCE = 1 << 12  # vectors that are added up at once

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """By code point: is it a letter?"""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def codes_of(text: str) -> np.ndarray:
    """Lower-case letters of the whole text as code points; whatever stands between them is one space, as are both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, 32).astype(np.int64)
    codes = np.concatenate(([32], codes, [32]))
    return codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng([20, int(code)]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


class Grams:
    """Vectors of n-grams, made once each."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.letters = dimensions, {}
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.empty(0, np.int64), np.empty((0, self.dimensions), np.int8)

    def _letter(self, code: int, roll: int) -> np.ndarray:
        if (code, roll) not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[code, roll] = np.roll(letter_vector(code, self.dimensions), roll)
        return self.letters[code, roll]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """Rows for sorted distinct keys: three code points of 21 bits each."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            new = keys[~known]
            if len(self.keys) + len(new) > KEPT_GRAMS:
                self._clear()
                new = keys
            made = np.ones((len(new), self.dimensions), np.int8)
            for place in range(GRAM):
                codes, which = np.unique((new >> (21 * (GRAM - 1 - place))) & 0x1FFFFF, return_inverse=True)
                made *= np.stack([self._letter(c, GRAM - 1 - place) for c in codes])[which]
            order = np.argsort(np.concatenate((self.keys, new)), kind="stable")
            self.keys, self.rows = np.concatenate((self.keys, new))[order], np.concatenate((self.rows, made))[order]
            at = np.searchsorted(self.keys, keys)
        return self.rows[at]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The document's vector; None without a letter."""
        codes = codes_of(text) if text else np.empty(0, np.int64)
        if len(codes) < GRAM:
            return None
        total = np.zeros(self.dimensions)
        for start in range(0, len(codes) - GRAM + 1, 1 << 20):  # very long texts part by part
            part = codes[start : start + (1 << 20) + GRAM - 1]
            keys, n = np.unique((part[:-2] << 42) | (part[1:-1] << 21) | part[2:], return_counts=True)
            for k in range(0, len(keys), AT_ONCE):
                total += n[k : k + AT_ONCE].astype(np.float32) @ self.vectors(keys[k : k + AT_ONCE]).astype(np.float32)
        return total


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v)
    return v / length if length else v


def _bundles(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each part of the sample the sum of the unit vectors of each language, one row a dimension."""
    grams, sums = Grams(), {}
    for df in rows:
        for text, lang in zip(df["text"], df["lang"], strict=True):
            if (v := grams.bundle(text)) is not None:
                sums[lang] = sums.get(lang, 0) + _unit(v)
    for lang, v in sums.items():
        yield pd.DataFrame({"lang": lang, "dimension": np.arange(len(v)), "value": v})


class Model:
    def __init__(self, langs: list[str], prototypes: np.ndarray):
        self.langs, self.prototypes = langs, prototypes


def share_of(count: Column, wanted: int) -> Column:
    """The share of ``count`` rows that makes about ``wanted``; above 0 for any count."""
    return F.least(F.lit(1.0), F.lit(float(wanted)) / count)


def fit(docs: DataFrame, docs_per_language: int = 1_500, seed: int = 2) -> Model:
    """Prototypes from about ``docs_per_language`` documents of each language at most, outside the held-out fifth.

    docs: doc_id, text, lang. Rows with null text, lang or id are not learned from. The driver gets one vector for each
    language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count()
    share = cut(counts.select(F.col("lang").alias("l"), share_of(F.col("count"), docs_per_language).alias("share")))
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(share) if share.count() <= 10_000 else share, F.col("lang") == F.col("l"))
    sample = sample.where(drawn(F.col("share"), "doc_id", seed=seed)).select("text", "lang")
    sums = sample.mapInPandas(_bundles, "lang string, dimension int, value double").groupBy("lang", "dimension").agg(F.sum("value").alias("value")).toPandas()
    if not len(sums):
        return Model([], np.empty((0, DIMENSIONS)))
    grid = sums.pivot(index="lang", columns="dimension", values="value").sort_index()
    return Model(list(grid.index), np.stack([_unit(v) for v in grid.to_numpy()]))


def _predictor(model: Model):
    grams: list[Grams] = []

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not grams:
            grams.append(Grams())
        langs, scores = [], []
        for text in texts:
            v = grams[0].bundle(text) if model.langs else None
            if v is None:
                langs.append(UNKNOWN)
                scores.append(0.0)
            else:
                cosines = model.prototypes @ _unit(v)
                best = int(np.argmax(cosines))
                langs.append(model.langs[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The language of every document's whole text.

    Input: doc_id, text; other columns are ignored. Output, one row for every input row: doc_id, held_out, lang_pred (a
    learned language, the first by name among equals; ``und`` if the text is null or has no letter, or nothing could be
    learned), score (cosine, not below 0; 0 for ``und``). Repeated rows are predicted alike; no rows give no rows.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _predictor(model)("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def in_known_language(docs: DataFrame, model: Model, least: float = 0.02) -> DataFrame:
    """The documents whose language is known by a cosine of ``least`` at least, with all their columns.

    Texts that are null or have no letter go. Repeated rows and rows with a null id are judged by their text like others.
    No rows give no rows, and a model without languages keeps none.
    """
    found = docs.withColumn("__language", _predictor(model)("text"))
    kept = (F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.score") >= least)
    return found.where(kept).select(*columns_of(docs))
