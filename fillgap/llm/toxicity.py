"""Toxicity by a weighted finite-state grammar over clauses.

A clause becomes a string of token classes: insult, threat verb, target, negation, reported speech, other. Five small
transducers read it in a row: one marks what stands shortly after a negation, one what stands after a word of reported
speech, one insults that follow a target, one counts threat verbs that a target follows and takes that target, and one
counts insults, aimed or not. Their composition is one machine, built once; it reads a clause in a single pass and
yields its matches by kind, whose weights are the clause's score. A document's matches of each kind, how dense the plain
ones stand and the score of its strongest clause give the log-odds of its label. No kind counts against a label:
negated and reported matches weigh less than plain ones, but never cancel them.

Labels teach two things, from a bounded sample of labelled rows: words and word beginnings that are many times more
frequent in toxic documents, in many different contexts, join the insults; and a logistic regression sets the weights.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgap.llm.common import columns_of, cut, drawn, held_out

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "itynro"

#: Words of the grammar's classes.
WORDS = {
    INSULT: "idiot idiots moron morons loser losers scum trash clown clowns stupid worthless pathetic disgusting imbecile dumbass bastard bastards vermin",
    THREAT: "kill hurt destroy beat stab shoot burn murder strangle smash",
    TARGET: "you your yourself he she him her they them their these those u du dich dir euch ihr vous toi tu te ti usted ustedes",
    NEGATION: "not never nobody nicht kein keine niemals pas jamais nunca jamás",
    REPORT: "said says saying claimed claims called quoted reported wrote allegedly sagte behauptete disait écrivait dijo afirmó",
}
CLASS = {w: c for c, words in WORDS.items() for w in words.split()}
CLAUSE = re.compile(r"[.!?;:\n]+")
TOKEN = re.compile(r"[^\W\d_]+")

#: Kinds of matches, and what one of each adds to its clause's score.
MATCHES = ["insults", "threats", "negated", "reported", "aimed"]
CLAUSE_WEIGHTS = np.array([1.0, 1.0, 0.125, 0.25, 0.5])
#: Matches of the document, the share of plain ones among its words, and its strongest clause.
FEATURES = [*MATCHES, "density", "strongest"]
#: Log-odds before anything is learned: of the bias, and of each feature.
PRIOR = np.array([-3.0, 6.0, 6.0, 1.0, 1.5, 2.0, 0.0, 0.0])


class Transducer:
    """States, and for each state and input symbol the next state, the output symbol and the weights (one a feature)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def compose(self, other: Transducer) -> Transducer:
        def step(state, symbol):
            mine, out, w = self.step(state[0], symbol)
            theirs, out, v = other.step(state[1], out)
            return (mine, theirs), out, tuple(map(sum, zip(w, v, strict=True)))

        return Transducer((self.start, other.start), step)

    def table(self, symbols: str) -> dict:
        """All reachable transitions between numbered states, the start being 0; no weights are ()."""
        numbers, found = {self.start: 0}, {}
        states = [self.start]
        for state in states:
            for x in symbols:
                after, out, w = self.step(state, x)
                if after not in numbers:
                    numbers[after] = len(states)
                    states.append(after)
                found[numbers[state], x] = numbers[after], out, w if any(w) else ()
        return found


ZERO = (0,) * len(MATCHES)


def _weights(**counts: int) -> tuple:
    return tuple(counts.get(f, 0) for f in MATCHES)


def _negation(window: int = 3) -> Transducer:
    """Marks insults and threats within ``window`` tokens after a negation."""

    def step(left, x):
        after = window if x == NEGATION else max(0, left - 1)
        marked = left > 0 and x in (INSULT, THREAT)
        return after, x + "-" if marked else x, ZERO

    return Transducer(0, step)


def _reported() -> Transducer:
    """Marks insults and threats anywhere after a word of reported speech in the clause."""

    def step(seen, x):
        marked = seen and x[0] in (INSULT, THREAT)
        return seen or x == REPORT, x + "r" if marked else x, ZERO

    return Transducer(False, step)


def _targets(window: int = 4) -> Transducer:
    """Marks insults fewer than ``window`` tokens after a target."""

    def step(left, x):
        left = max(0, left - 1)
        return window if x == TARGET else left, x + "t" if x[0] == INSULT and left else x, ZERO

    return Transducer(0, step)


def _kind(plain: str, marks: str) -> str:
    return "negated" if "-" in marks else "reported" if "r" in marks else plain


def _threats(window: int = 4) -> Transducer:
    """Counts threat verbs that a target follows, and marks that target as taken."""

    def step(state, x):
        left, marks = max(0, state[0] - 1), state[1]
        if x[0] == THREAT:
            return (window, x[1:]), OTHER, ZERO
        if x == TARGET:
            return (0, ""), x + "+" if left else x, _weights(**{_kind("threats", marks): 1}) if left else ZERO
        return (left, marks if left else ""), x, ZERO

    return Transducer((0, ""), step)


def _insults(window: int = 4) -> Transducer:
    """Counts insults; a plain one is aimed if it is marked by a target or one that no threat has taken follows."""

    def step(left, x):
        left = max(0, left - 1)
        if x[0] == INSULT:
            kind, near = _kind("insults", x), "t" in x
            plain = kind == "insults"
            return window if plain and not near else 0, OTHER, _weights(**{kind: 1, "aimed": int(plain and near)})
        if x[0] == TARGET:
            return 0, OTHER, _weights(aimed=1) if left and x == TARGET else ZERO
        return left, OTHER, ZERO

    return Transducer(0, step)


MACHINE = _negation().compose(_reported()).compose(_targets()).compose(_threats()).compose(_insults()).table(INSULT + THREAT + TARGET + NEGATION + REPORT + OTHER)


def hits_of(learned: tuple[str, ...] = ()) -> re.Pattern:
    """Words that a clause needs for any match: insults, threat verbs and what was learned (a trailing ``*``: any ending)."""
    fixed = [re.escape(w) for w, c in CLASS.items() if c in (INSULT, THREAT)]
    return re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(fixed + [re.escape(x.rstrip("*")) + r"[^\W\d_]*" * x.endswith("*") for x in learned], key=len, reverse=True)) + r")(?![^\W\d_])")


def matched_clauses(text: str | None, hits: re.Pattern) -> Iterator[tuple[int, str, np.ndarray]]:
    """Number, lower-cased text and matches by kind of each clause of a whole text in which the grammar finds any."""
    if not text or not hits.search(low := text.lower()):
        return
    for number, clause in enumerate(CLAUSE.split(low)):
        if hits.search(clause):
            state, total = 0, None
            for token in TOKEN.findall(clause):
                kind = CLASS.get(token) or (INSULT if hits.fullmatch(token) else OTHER)
                state, _, w = MACHINE[state, kind]
                if w:
                    total = np.add(w, total) if total is not None else np.array(w, float)
            if total is not None:
                yield number, clause, total


def clause_matches(text: str | None, hits: re.Pattern) -> np.ndarray:
    """The grammar's matches by kind, summed over the clauses of a whole text."""
    return sum((n for _, _, n in matched_clauses(text, hits)), np.zeros(len(MATCHES)))


def clause_score(matches: np.ndarray) -> float:
    return float(CLAUSE_WEIGHTS @ matches)


def features_of(text: str | None, hits: re.Pattern) -> np.ndarray:
    """log(1 + n) of each kind, and on the same scale a hundred times the plain matches' share of the words and the highest score of a clause.

    A match more never adds less.
    """
    n, strongest = np.zeros(len(MATCHES)), 0.0
    for _, _, own in matched_clauses(text, hits):
        n, strongest = n + own, max(strongest, clause_score(own))
    words = 20 + (text.count(" ") + text.count("\n") if text else 0)
    return np.log1p(np.append(n, [100 * (n[0] + n[1]) / words, strongest]))


def _features(learned: tuple[str, ...]):
    hits = hits_of(learned)

    @F.pandas_udf(", ".join(f"{f} double" for f in FEATURES))
    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(np.array([features_of(t, hits) for t in texts]).reshape(-1, len(FEATURES)), columns=FEATURES)

    return features


BITS = 62
PER_DOCUMENT = 16  # occurrences of one term in one document that count as evidence


def _beginnings(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each part of the sample: words and word beginnings, how often they occur under either label, and what stands before them in toxic documents as bits.

    The key '' has all words of either label.
    """
    clean, toxic, context = Counter(), Counter(), {}
    for df in rows:
        for text, label in zip(df["text"], df["label"], strict=True):
            tokens = TOKEN.findall(text.lower())
            counts, bits = Counter({"": len(tokens)}), {}
            for before, w in zip(["", *tokens], tokens, strict=False):
                if len(w) >= 4:
                    bit = 1 << zlib.crc32(before.encode()) % BITS
                    for key in (w, *(w[:n] + "*" for n in range(4, min(9, len(w) + 1)))):
                        counts[key] += 1
                        bits[key] = bits.get(key, 0) | bit
            known = toxic if label else clean
            for key, n in counts.items():
                known[key] += min(n, PER_DOCUMENT) if key else n
            if label:
                for key, b in bits.items():
                    context[key] = context.get(key, 0) | b
    keys = list(clean.keys() | toxic.keys())
    if keys:
        yield pd.DataFrame({"key": keys, "clean": [clean[k] for k in keys], "toxic": [toxic[k] for k in keys], "bits": [context.get(k, 0) for k in keys]})


def learn_terms(sample: DataFrame, odds: float = 8.0, least: float = 24.0) -> tuple[str, ...]:
    """Words and beginnings that mark the toxic rows of the sample; of those that cover each other the clearest one.

    A term has to be ``odds`` times as frequent under the label as elsewhere, and so often that chance would do it with
    exp(-``least``) at most. Copies of one document share rare words; in them a word has the same few neighbours over
    and over, so that a term's occurrences count as no more than the different words before it.
    """
    counts = sample.select("text", "label").mapInPandas(_beginnings, "key string, clean long, toxic long, bits long")
    counts = cut(counts.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_count(F.bit_or("bits")).alias("contexts")))
    every = counts.where("key = ''").first()
    if every is None or not every["toxic"] or not every["clean"]:
        return ()
    chance = (F.col("clean") + 1) * F.lit(every["toxic"] / every["clean"])
    different = F.when(F.col("contexts") < BITS, -BITS * F.log(1 - F.col("contexts") / F.lit(float(BITS)))).otherwise(F.col("toxic"))
    weight = F.least(F.lit(1.0), different / F.col("toxic"))
    evidence = weight * (F.col("toxic") * F.log(F.col("toxic") / chance) - F.col("toxic") + chance)
    rows = counts.where((F.col("key") != "") & (F.col("toxic") >= odds * chance)).select("key", evidence.alias("evidence"))
    chosen: list[str] = []
    for row in rows.where(F.col("evidence") >= least).orderBy(F.desc("evidence"), F.length("key"), "key").toLocalIterator():
        key = row["key"].rstrip("*")
        if not any(key.startswith(c[:-1]) if c.endswith("*") else row["key"].endswith("*") and c.startswith(key) for c in chosen) and not any(row["key"].endswith("*") and c.startswith(key) for c in chosen):
            chosen.append(row["key"])
    return tuple(chosen)


def _fit(x: np.ndarray, y: np.ndarray, spread: float = 3.0) -> np.ndarray:
    """Logistic regression with a normal prior around PRIOR, by Newton's method; features that would weigh less than nothing weigh nothing."""
    x = np.hstack([np.ones((len(x), 1)), x])
    free = np.ones(len(PRIOR), bool)
    while True:
        w = np.where(free, PRIOR, 0.0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (y - p) - (w - PRIOR) / spread**2
            hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread**2
            step = np.zeros(len(w))
            step[free] = np.clip(np.linalg.solve(hess[np.ix_(free, free)], grad[free]), -2, 2)
            w = w + step
            if abs(step).max() < 1e-6:
                break
        less = free & (w < 0) & (np.arange(len(w)) > 0)
        if not less.any():
            return w
        free &= ~less


class Model:
    """Learned terms and weights; ``score`` is a column of log-odds turned into 0..1."""

    def __init__(self, terms: tuple[str, ...], weights: np.ndarray):
        self.terms, self.weights = terms, weights

    def score(self, text: Column) -> Column:
        found = _features(self.terms)(text)
        odds = F.lit(float(self.weights[0]))
        for f, w in zip(FEATURES, self.weights[1:], strict=True):
            odds = odds + found[f] * F.lit(float(w))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = 2_000, clean_docs: int = 6_000, seed: int = 1) -> Model:
    """Learn from labelled documents outside the held-out fifth, about ``toxic_docs`` and ``clean_docs`` of them at most.

    docs: doc_id, text; labels: doc_id, toxic. Rows with a null text, label or id are not learned from. Without rows of
    both labels the grammar keeps its own words and weights.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, toxic_docs / max(1, n.get(1, 0))).otherwise(clean_docs / max(1, n.get(0, 0)))
    known = known.where(drawn(share, "doc_id", seed=seed))
    # So many ids fit into a broadcast, and no text is shuffled.
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id").select("text", (F.col("label") == 1).cast("int").alias("label"))
    sample = cut(sample).repartition(48)  # few enough documents for a task to count all their beginnings
    terms = learn_terms(sample)
    rows = sample.select("label", _features(terms)("text").alias("f")).select("label", "f.*").toPandas()
    if rows["label"].nunique() < 2:
        return Model(terms, PRIOR)
    return Model(terms, _fit(rows[FEATURES].to_numpy(), rows["label"].to_numpy(dtype=float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Toxicity of every document's whole text.

    Input: doc_id, text; other columns are ignored. Output, one row for every input row: doc_id, held_out, score (0 to
    1), predicted (1 if score >= 0.5). Null and empty texts have no matches and get the score of the bias. Repeated rows
    score alike, null ids are not held out, and no rows give no rows.
    """
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clauses(docs: DataFrame, model: Model) -> DataFrame:
    """The clauses in which the grammar finds matches, each with its score.

    Input: doc_id, text; other columns are ignored. Output, one row for every such clause of every input row: doc_id,
    clause (its number in the text, from 0), text (lower-cased), one count a kind of match, clause_score (the counts by
    CLAUSE_WEIGHTS). Null and empty texts and texts without matches give no rows; repeated rows give theirs each.
    """
    hits = hits_of(model.terms)
    fields = "doc_id long, clause int, text string, " + ", ".join(f"{m} long" for m in MATCHES) + ", clause_score double"
    names = ["doc_id", "clause", "text", *MATCHES, "clause_score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                rows = ((None if pd.isna(doc) else int(doc), k, clause, *n.astype(int).tolist(), clause_score(n)) for k, clause, n in matched_clauses(text, hits))
                while some := list(islice(rows, 10_000)):
                    yield pd.DataFrame(some, columns=names).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).mapInPandas(run, fields)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below 0.5, with all their columns.

    Null and empty texts have no matches and stay, as does every row of a repeated document; null ids are judged by
    their text like others. No rows give no rows.
    """
    scored = docs.withColumn("__toxicity", model.score(F.col("text")))
    return scored.where(F.col("__toxicity") < 0.5).select(*columns_of(docs))
