"""Ranked lexical search by the threshold algorithm over blocks of documents.

1. One pass over the whole texts counts every document's words and keeps those that an item asks for. Documents become
   blocks of bounded size, a row each: a forward index, from document to its terms. Nothing is shuffled for that.
2. Counts over all documents give each term its weight.
3. In a block each term has a list, sorted by impact, what an occurrence adds to a score. An item reads its terms'
   lists in turns, the same depth in all; a document that turns up in any of them is looked up in the forward index and
   gets its whole score. What no list has shown yet can't score above the sum of the impacts that the lists have come to;
   reading ends when this threshold falls strictly below the k-th best score.
4. A few blocks go first. The k-th best score of each item among them is a floor for all other blocks, which return
   only what reaches it and end earlier for it.

Items go in batches of about ``terms_at_once`` terms, which is what a broadcast and the driver hold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fillgap.llm.common import cut

#: What is no letter, digit or part of a character beyond ASCII parts words; A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FIRST_TURN = 16  # one of so many blocks goes first
BLOCKS = "turn int, docs long, words long, ids array<long>, lengths binary, counts binary, terms binary, times binary"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def item_terms(items: DataFrame, id_col: str) -> DataFrame:
    """item, term: the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [[t.decode("utf-8", "replace") for t in set(terms_of(x.as_py()))] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["item", "terms"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("item"), "text").mapInArrow(run, f"item {kind}, terms array<string>")
    return rows.select("item", F.explode("terms").alias("term")).distinct()


def _packed(sent, block_docs: int, block_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        part, no = TaskContext.get().partitionId(), 0
        docs = words = 0
        ids, lengths, counts, terms, times = [], [], [], [], []

        def block() -> pa.RecordBatch:
            turn = 0 if (part + no) % FIRST_TURN == 0 else 1
            blobs = [np.array(lengths, np.int64), np.array(counts, np.int32), np.array(terms, np.int32), np.array(times, np.int64)]
            row = [pa.array([turn], pa.int32()), pa.array([docs], pa.int64()), pa.array([words], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)]
            return pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                docs, words = docs + 1, words + len(found)
                held = [(number[t], c) for t, c in Counter(found).items() if t in number]
                if held:
                    ids.append(doc_id)
                    lengths.append(len(found))
                    counts.append(len(held))
                    terms += [t for t, _ in held]
                    times += [c for _, c in held]
                    if len(ids) >= block_docs or len(terms) >= block_terms:
                        yield block()
                        no += 1
                        docs = words = 0
                        ids, lengths, counts, terms, times = [], [], [], [], []
        if docs:
            yield block()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, df of each block."""
    for batch in batches:
        for blob in batch.column(0):
            terms, df = np.unique(np.frombuffer(blob.as_py(), np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df.astype(np.int64))], names=["term", "df"])


def length_norms(lengths: np.ndarray, docs: int, words: int) -> np.ndarray:
    """m of each document: 50 plus 50 times its length in average lengths, in whole numbers."""
    if int(lengths.max(initial=0)) * 50 * docs < 1 << 63:
        return 50 + (50 * docs * lengths) // words
    return np.array([50 + (50 * docs * n) // words for n in lengths.tolist()], np.int64)


class Block:
    """Documents as a forward index, and the lists of their terms by falling impact."""

    def __init__(self, counts: np.ndarray, terms: np.ndarray, times: np.ndarray, norms: np.ndarray, weights: np.ndarray):
        doc = np.repeat(np.arange(len(counts)), counts)
        self.terms, self.counts, self.begin = terms, counts, np.cumsum(counts) - counts
        self.impact = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * norms[doc]))
        order = np.lexsort((-self.impact, terms))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.lists = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.asked, self.seen = np.zeros(len(weights), bool), np.zeros(len(counts), bool)

    def look_up(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of documents for the terms that are asked for."""
        n = self.counts[docs]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(self.begin[docs] - first, n)
        return np.add.reduceat(np.where(self.asked[self.terms[at]], self.impact[at], 0), first)

    def search(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores among which are all of the best ``k`` that score ``floor`` or more."""
        at, ends = self.lists[terms], self.lists[terms + 1]
        there = ends > at
        terms, at, ends = terms[there], at[there], ends[there]
        docs, scores, step, kth = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 2 * k, 0
        self.asked[terms] = True
        while len(at):
            upto = np.minimum(at + step, ends)
            shown = np.unique(np.concatenate([self.list_doc[a:b] for a, b in zip(at, upto, strict=True)]))
            shown = shown[~self.seen[shown]]
            if len(shown):
                self.seen[shown] = True
                docs.append(shown)
                scores.append(self.look_up(shown))
                known = np.concatenate(scores)
                kth = int(np.partition(known, len(known) - k)[len(known) - k]) if len(known) >= k else 0
            left = upto < ends
            threshold = int(self.list_impact[upto[left] - 1].sum())
            if not left.any() or threshold < max(kth, floor):
                break
            at, ends, step = upto[left], ends[left], 2 * step
        self.asked[terms] = False
        found, score = np.concatenate(docs), np.concatenate(scores)
        self.seen[found] = False
        good = (score > 0) & (score >= max(kth, floor))
        return found[good], score[good]


def _searched(items, stats, weights, floors, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, words = stats
        for batch in batches:
            for row in batch.to_pylist():
                lengths, counts, terms, times = (np.frombuffer(row[c], t) for c, t in (("lengths", np.int64), ("counts", np.int32), ("terms", np.int32), ("times", np.int64)))
                if not len(counts):
                    continue
                block = Block(counts, terms, times, length_norms(lengths, docs, words), weights.value)
                ids = np.array([math.inf if i is None else i for i in row["ids"]], object)  # no id stands last
                out = []
                for no, asked in enumerate(items.value):
                    found, score = block.search(asked, k, int(floors.value[no]))
                    best = sorted(zip((-score).tolist(), ids[found].tolist(), strict=True))[:k]
                    out += [(no, None if i == math.inf else i, -s) for s, i in best]
                columns = [pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["no", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", terms_at_once: int = 500_000, block_docs: int = 16_384, block_terms: int = 1_000_000) -> DataFrame:
    """The ``k`` documents of highest score for each item, with integer scores from counts over all documents.

    Input: docs with doc_id (long) and text, items with an id and text; other columns are ignored. Output: item_id, rank
    (from 1), doc_id, score (above 0), highest first, ties to the smaller doc_id. Null and wordless texts count nowhere.
    Rows that repeat a doc_id are documents of their own; a null id stands last among equal scores. Rows that repeat an
    item's id, the null one too, are one item with the terms of all of them. Fewer matches than ``k`` give all there are;
    without documents, items or terms there are no rows.
    """
    spark = docs.sparkSession
    wanted = cut(item_terms(items, id_col))
    kind = wanted.schema["item"].dataType
    batches = max(1, -(-wanted.count() // terms_at_once))
    out = None
    for b in range(batches):
        some = wanted.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == b)
        found = _of_batch(docs, some.orderBy("item").collect(), kind, k, block_docs, block_terms)  # about terms_at_once rows
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField("item", kind)])).withColumns({"rank": F.lit(0), "doc_id": F.lit(0).cast("long"), "score": F.lit(0).cast("long")})
    return out.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def _of_batch(docs: DataFrame, wanted: list, kind: T.DataType, k: int, block_docs: int, block_terms: int) -> DataFrame | None:
    """item, rank, doc_id, score for the items of a batch, given as rows of (item, term) in the order of items."""
    spark = docs.sparkSession
    numbers = {t: i for i, t in enumerate(sorted({r["term"].encode() for r in wanted}))}
    if not numbers:
        return None
    groups = [(item, np.array([numbers[r["term"].encode()] for r in rows], np.int64)) for item, rows in groupby(wanted, key=lambda r: r["item"])]
    context = spark.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = cut(rows.mapInArrow(_packed(context.broadcast(numbers), block_docs, block_terms), BLOCKS))
    total = blocks.agg(F.sum("docs"), F.sum("words")).first()
    if not total[0]:
        return None
    weights = np.full(len(numbers), math.floor(1000 * math.log(2 * total[0] + 2)), np.int64)
    for r in blocks.select("terms").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term asked for
        weights[r["term"]] = math.floor(1000 * math.log((2 * total[0] + 2) / (2 * r["df"] + 1)))
    weights, asked = context.broadcast(weights), context.broadcast([terms for _, terms in groups])

    def scan(turn: int, floors: np.ndarray) -> DataFrame:
        return blocks.where(F.col("turn") == turn).mapInArrow(_searched(asked, tuple(total), weights, context.broadcast(floors), k), "no int, doc_id long, score long")

    floors = np.zeros(len(groups), np.int64)
    early = cut(_best(scan(0, floors), k))
    for r in early.where(F.col("rank") == k).select("no", "score").collect():  # one row an item
        floors[r["no"]] = r["score"]
    best = _best(early.drop("rank").unionByName(scan(1, floors)), k)
    schema = T.StructType([T.StructField("no", T.IntegerType()), T.StructField("item", kind)])
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(groups)], schema)
    return cut(best).join(F.broadcast(names), "no").select("item", "rank", "doc_id", "score")
