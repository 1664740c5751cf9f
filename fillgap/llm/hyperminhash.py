"""Near-duplicates by HyperMinHash: registers of leading zeros and mantissa bits, banded, estimated, then verified.

Every n-gram's hash picks a register; of the hashes that pick it a register keeps the smallest, as the number of its
leading zeros and the bits that follow the first one. A register that nothing picks gets the smallest of all hashes of
the set under a seed of its own, so that small sets fill all registers too. Two sets of similarity t agree in a register
with probability t, plus a little because different hashes may look alike in so few bits.

1. One pass over the whole texts gives each document its set's size, a fingerprint and its registers. Documents of one
   fingerprint are one vertex from here on, so exact copies of any number cost one.
2. Bands of registers are keys; the vertices that share a key are a list. With ``BANDS`` bands of ``ROWS`` registers, two
   sets of similarity 0.8 share none with a probability of 5 in 10^9.
3. Each vertex is compared with one centre of its lists, first the one that most others meet, ``stars`` times over,
   which joins large groups of near copies at the cost of a few comparisons a vertex.
4. What is still apart meets in cells of bounded size, each pair of a list in one cell. There the estimate of the
   similarity, with chance agreements taken off, leaves out what lies ``MARGIN`` below the limit, five deviations.
   A cell names the vertices that have such a pair, never the pairs.
5. These vertices meet in their cells again with their full sets. A pair that isn't connected yet is confirmed there, and
   a cell returns the links that join what was apart, fewer than it has vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgap.llm.common import cut
from fillgap.llm.hashing import SpanHasher, mixed
from fillgap.llm.jaccard import cells_of, compare, components, fingerprint, in_cells, named_vertices, sets_of, shingles

BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10  # bits of a register; the number of leading zeros, 32 at most, takes the other six
MARGIN = 0.14


def _chance() -> float:
    """How often the registers of unlike sets agree by chance, when few hashes pick each: the squares of all values' shares."""
    return float((0.25 ** (np.arange(32) + 1.0)).sum() / (1 << MANTISSA))


CHANCE = _chance()


SEEDS = mixed(np.arange(REGISTERS, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
LOW = np.uint64(0xFFFFFFFF)


def registers(grams: np.ndarray) -> np.ndarray:
    """Two bytes a register: leading zeros above, mantissa below. The set must not be empty."""
    own = mixed(grams ^ np.uint64(0x2545F4914F6CDD1D))
    at = (own >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)
    least = np.full(REGISTERS, 1 << 32, np.uint64)
    np.minimum.at(least, at.astype(np.int64), own & LOW)
    empty = np.flatnonzero(least == 1 << 32)
    if len(empty):  # few hashes leave many registers empty and many hashes none, so this is 20,000 of them at most
        least[empty] = (mixed(own[None, :] ^ SEEDS[empty][:, None]) & LOW).min(1)
    zeros = 32 - np.frexp(least.astype(np.float64))[1]
    rest = (least << np.minimum(zeros + 1, 32).astype(np.uint64)) & np.uint64(0xFFFFFFFF)  # what follows the first one
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (rest >> np.uint64(32 - MANTISSA)).astype(np.uint16)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, from its number and its registers."""
    rows = found.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed((key << np.uint64(16)) ^ (key >> np.uint64(48)) ^ rows[:, i])
    return key.view(np.int64)


def similarity(agree: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that so many equal registers tell, without the chance agreements."""
    return (agree / REGISTERS - CHANCE) / (1 - CHANCE)


def _profiles(n: int):
    """doc_id, n, both halves of the set's fingerprint, registers and band keys of every row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in rows:
            sizes, half, other, found = [], [], [], []
            for text in batch.column(1):
                grams = shingles(text.as_py(), n, hasher)
                marks = fingerprint(grams) if len(grams) else (None, None)
                sizes.append(len(grams))
                half.append(marks[0])
                other.append(marks[1])
                found.append(registers(grams).tobytes() if len(grams) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(half, pa.int64()), pa.array(other, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "half", "other", "registers"])

    return run


def bands(vertices: DataFrame) -> DataFrame:
    """hash (the band's key), vertex, n, weight (what the vertex's lists hold in all) of the keys that two vertices or more share."""

    @F.pandas_udf("array<long>")
    def keys(found: pd.Series) -> pd.Series:
        return pd.Series([band_keys(np.frombuffer(x, np.uint16)) for x in found])

    rows = cut(vertices.select("vertex", "n", F.explode(keys("registers")).alias("hash")))
    shared = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = cut(rows.join(shared, "hash").select("hash", "vertex", "n", "c"))
    weights = lists.groupBy("vertex").agg(F.sum("c").alias("weight"))
    return cut(lists.drop("c").join(weights, "vertex"))


def possible(percent: int, m: Column, n: Column) -> Column:
    """The larger set isn't too large for the smaller one."""
    return F.least(m, n) * 100 >= percent * F.greatest(m, n)


def star_pairs(lists: DataFrame, labels: DataFrame, turn: int, percent: int) -> DataFrame:
    """For every vertex one of another component to compare with: the centre that it meets in most of its lists.

    A list's centre is, in the first turn, the vertex whose lists hold most, and any vertex in later turns.
    """
    rows = lists.join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))
    rows = rows.withColumn("rank", F.col("weight") if turn == 0 else F.xxhash64(F.lit(turn), "vertex"))
    centres = rows.groupBy("hash").agg(F.max(F.struct("rank", F.col("vertex").alias("centre"), F.col("label").alias("of"), F.col("n").alias("m"))).alias("c")).select("hash", "c.centre", "c.of", "c.m")
    meets = rows.join(centres, "hash").where("label <> of").where(possible(percent, F.col("m"), F.col("n")))
    best = meets.groupBy("vertex", "centre").agg(F.count(F.lit(1)).alias("times")).groupBy("vertex").agg(F.max(F.struct("times", "centre")).alias("m"))
    return best.select(F.least("vertex", "m.centre").alias("a"), F.greatest("vertex", "m.centre").alias("b")).distinct()


def likely(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose registers tell a similarity of the limit less MARGIN or more."""

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        agree = np.array([np.count_nonzero(np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)) for a, b in zip(x, y, strict=True)], float)
        return pd.Series(similarity(agree) >= percent / 100 - MARGIN)

    at = lambda v, r: vertices.select(F.col("vertex").alias(v), F.col("registers").alias(r))
    return cut(pairs.join(at("a", "x"), "a").join(at("b", "y"), "b").where(close("x", "y")).select("a", "b"))


CELL_KEY = ["hash", "i", "j", "of", "side"]


def _close(percent: int, size, label, rows, i: int, at) -> tuple[np.ndarray, np.ndarray]:
    """Of the places ``at`` those that are apart from i, of like size, and whose registers agree often enough, with how often."""
    least = ((percent / 100 - MARGIN) * (1 - CHANCE) + CHANCE) * REGISTERS
    at = at[(label[at] != label[i]) & (np.minimum(size[at], size[i]) * 100 >= percent * np.maximum(size[at], size[i]))]
    agree = np.count_nonzero(rows[at] == rows[i], axis=1)
    return at[agree >= least], agree[agree >= least]


def _cells(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """The columns of each cell, its registers as a matrix, and for the places of one side those that they meet."""
    for *held, marks, few, many, one_part in cells_of(batches, [*columns, "registers"]):
        rows = np.frombuffer(b"".join(marks), np.uint16).reshape(-1, REGISTERS)
        n = len(marks)
        yield *held, rows, few, (lambda i, n=n, many=many, one=one_part: np.arange(i + 1, n) if one else np.arange(n)[many])


def _touched(percent: int):
    """The rows of cells that have a partner there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *key, vertex, size, label, rows, few, met in _cells(batches, [*CELL_KEY, "vertex", "n", "label"]):
            good = np.zeros(len(vertex), bool)
            for i in few:
                found, _ = _close(percent, size, label, rows, i, met(i))
                good[found] = True
                good[i] |= len(found) > 0
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (*key, vertex)], names=[*CELL_KEY, "vertex"])

    return run


def _shared_with(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the other sets shares with x; sets are sorted."""
    y = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def _linked(percent: int, at_once: int = 256):
    """a, b: similar pairs of a cell's vertices, as many as join what was apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vertex, size, label, grams, rows, few, met in _cells(batches, ["vertex", "n", "label", "grams"]):
            sets, label, links = [np.frombuffer(g, np.uint64) for g in grams], label.copy(), []
            for i in few:
                found, agree = _close(percent, size, label, rows, i, met(i))
                found = found[np.argsort(-agree, kind="stable")]
                step = 1  # the likeliest by itself, as it often settles the others
                while len(found):
                    some, found = found[:step], found[step:]
                    both = _shared_with(sets[i], [sets[k] for k in some])
                    for k in some[100 * both >= percent * (size[some] + size[i] - both)]:
                        if label[k] != label[i]:
                            links.append((min(vertex[i], vertex[k]), max(vertex[i], vertex[k])))
                            label[label == label[k]] = label[i]
                    found, step = found[label[found] != label[i]], at_once
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def classes(docs: DataFrame, n: int = 4, percent: int = 80, stars: int = 3, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Classes of documents that chains of pairs with a Jaccard similarity of ``percent`` / 100 or more connect.

    Input: doc_id (long), text; other columns are ignored. Output, one row for every input row: doc_id, n_shingles,
    component_id (the smallest doc_id of its class), kept (doc_id = component_id). Null or wordless texts have no n-grams
    and are alone, with their own doc_id. Rows that repeat a doc_id are compared each; rows with a null id come back
    alone, with a null component, and are kept. No rows give no rows. N-grams are compared by 64-bit hashes, sets of
    them by 128 bits. The limit has to be high enough for the bands: 0.7 or more.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = cut(rows.mapInArrow(_profiles(n), "doc_id long, n long, half long, other long, registers binary"))
    named, vertices, doubtful = named_vertices(profile)
    marked = named.where(F.col("vertex").isNotNull()).groupBy("vertex").agg(F.first("n").alias("n"), F.first("registers").alias("registers"))
    marked = cut(marked)
    lists = bands(marked)
    edges, labels = None, lists.select("vertex", F.col("vertex").alias("label")).limit(0)
    for turn in range(stars):
        pairs = likely(star_pairs(lists, labels, turn, percent), marked, percent)
        now = compare(sets_of(rows, vertices, pairs, n, doubtful), pairs, percent)
        edges = now if edges is None else edges.union(now)
        labels = components(edges)

    labelled = cut(lists.join(labels, "vertex", "left").select("hash", "vertex", "n", F.coalesce("label", "vertex").alias("label")))
    cells, buckets = in_cells(labelled, ["vertex", "n", "label"])
    known = marked.select("vertex", "registers")
    dealt = cells.join(known, "vertex").withColumn("bucket", F.pmod(F.xxhash64("hash", "i", "j", "of"), F.lit(buckets)))
    touched = cut(dealt.groupBy("bucket").applyInArrow(_touched(percent), "hash long, i int, j int, of int, side int, vertex long"))
    needed = touched.select(F.col("vertex").alias("a"), F.col("vertex").alias("b")).distinct()
    sets = sets_of(rows, vertices, needed, n, doubtful)
    whole = touched.join(marked.join(labels, "vertex", "left").select("vertex", "n", "registers", F.coalesce("label", "vertex").alias("label")), "vertex")
    buckets = max(64, int((touched.join(marked, "vertex").agg(F.sum("n")).first()[0] or 0) * 8 / bucket_bytes))
    whole = whole.join(sets, "vertex").withColumn("bucket", F.pmod(F.xxhash64("hash", "i", "j", "of"), F.lit(buckets)))
    edges = edges.union(cut(whole.groupBy("bucket").applyInArrow(_linked(percent), "a long, b long")))
    labels = components(edges)
    whole = vertices.join(labels, "vertex", "left").select("vertex", "doc_id", F.coalesce("label", "vertex").alias("label"))
    least = whole.join(whole.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("vertex", "component_id")
    out = named.select("doc_id", "n", "vertex").join(least, "vertex", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
