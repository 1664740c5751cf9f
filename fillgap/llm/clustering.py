"""Centroid clustering of vectors in whole numbers.

Components become floor(scale * x), and everything from there on is exact. Vectors are packed once into blocks, one row
each; a round sends the centroids to all tasks, and every block finds its vectors' nearest centroids with one matrix
product, |x|^2 - 2 x.c + |c|^2. Doubles hold these numbers exactly while all of them stay below 2^53, which the largest
components tell beforehand; the vectors beyond that are compared in integers, of 64 bits or of any size. Sums and counts
by centroid, which is all that leaves a block, are added in a tree of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillgap.llm.common import cut

EXACT = 1 << 53
LARGEST = (1 << 63) - 1
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept_vectors(df: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """id, x (array of double): the vectors with exactly ``dim`` components, all of them finite."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("x").isNotNull() & (F.size("x") == dim) & ~F.coalesce(bad, F.lit(False)))


def in_blocks(rows: DataFrame, dim: int, block_rows: int) -> DataFrame:
    """ids, data: blocks of vectors in the order in which a task reads them, ``block_rows`` at most; nothing moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, block_rows):
                some = batch.slice(s, block_rows)
                x = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.reshape(-1, dim).tobytes()])], names=["ids", "data"])

    return rows.select("id", "x").mapInArrow(run, "ids array<long>, data binary")


def whole(x: float, scale: float) -> int:
    """floor(scale * x) in whole numbers of any size."""
    return floor(Fraction(x) * Fraction(scale))


def nearest(x: np.ndarray, centroids: list[list[int]], scale: float) -> tuple[np.ndarray, np.ndarray | list[int]]:
    """The number of the nearest centroid of every row, the smallest of equals, and the squared distance to it."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    top = max((abs(a) for c in centroids for a in c), default=0)
    reach = np.abs(v).max(1, initial=0) + float(top)  # no term of the expansion exceeds reach^2 * components
    with np.errstate(over="ignore"):
        bound = reach * reach * max(1, x.shape[1])
    fast, middle = bound < EXACT, (bound >= EXACT) & (bound < float(1 << 62))
    cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    if fast.any():
        c, y = np.array(centroids, np.float64), v[fast]
        d = np.einsum("ij,ij->i", y, y)[:, None] - 2 * (y @ c.T) + np.einsum("ij,ij->i", c, c)
        cluster[fast] = d.argmin(1)
        distance[fast] = d.min(1).astype(np.int64)
    if middle.any():
        y = v[middle].astype(np.int64)
        d = np.stack([((y - np.array(c, np.int64)) ** 2).sum(1) for c in centroids], 1)
        cluster[middle], distance[middle] = d.argmin(1), d.min(1)
    rest = np.flatnonzero(~fast & ~middle)
    if len(rest):
        distance = distance.astype(object)
        for i in rest:
            y = [whole(a, scale) for a in x[i].tolist()]
            d = [sum((a - b) ** 2 for a, b in zip(y, c, strict=True)) for c in centroids]
            distance[i] = min(d)
            cluster[i] = d.index(distance[i])
    return cluster, distance


def sums_by_cluster(x: np.ndarray, cluster: np.ndarray, k: int, scale: float) -> tuple[list[int], np.ndarray]:
    """Counts, and sums of the whole components as integers of any size."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    counts = np.bincount(cluster, minlength=k).tolist()
    if np.abs(v).max(initial=0) * max(1, len(v)) < EXACT:
        member = (cluster[:, None] == np.arange(k)).astype(np.float64)
        return counts, (member.T @ v).astype(np.int64).astype(object)
    sums = np.zeros((k, x.shape[1]), object)
    for row, c in zip(x.tolist(), cluster.tolist(), strict=True):
        sums[c] = sums[c] + np.array([whole(a, scale) for a in row], object)
    return counts, sums


def _added(a, b):
    if a is None or b is None:
        return a if b is None else b
    return [x + y for x, y in zip(a[0], b[0], strict=True)], a[1] + b[1]


def _vectors(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, dim)


def moved(blocks: RDD, centroids: list[list[int]], dim: int, scale: float) -> list[list[int]]:
    """The floors of the means of the vectors nearest to each centroid; a centroid without vectors stays."""
    sent = blocks.context.broadcast(centroids)

    def summed(acc, block):
        x = _vectors(block.data, dim)
        return _added(acc, sums_by_cluster(x, nearest(x, sent.value, scale)[0], len(sent.value), scale))

    total = blocks.treeAggregate(None, summed, _added)
    if total is None:
        return centroids
    return [[s // n for s in row] if n else c for n, row, c in zip(total[0], total[1].tolist(), centroids, strict=True)]


def inertias(blocks: RDD, centroids: list[list[int]], dim: int, scale: float) -> list[int]:
    """The sum of squared distances in each cluster."""
    sent = blocks.context.broadcast(centroids)

    def summed(acc, block):
        cluster, distance = nearest(_vectors(block.data, dim), sent.value, scale)
        own = [0] * len(sent.value) if acc is None else list(acc)
        for c, d in zip(cluster.tolist(), distance.tolist(), strict=True):
            own[c] += d
        return own

    def both(a, b):
        return (b if a is None else a) if a is None or b is None else [x + y for x, y in zip(a, b, strict=True)]

    return blocks.treeAggregate(None, summed, both) or [0] * len(centroids)


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1, block_rows: int = 2_048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Assigns every vector of ``dim`` finite components to one of ``k`` centroids after ``rounds`` rounds.

    Centroids start as the vectors with the smallest SHA-256 of ``<seed>:<id>``. Input: an id and an array of numbers;
    other columns are ignored. Output, a row for every vector kept: vec_id, cluster (from 0, ties to the smaller),
    distance (squared), cluster_inertia, inertia (of all), centroid_sha256 (of the components in decimal, joined by
    commas). Null vectors, other lengths and vectors with null or non-finite components take no part. Rows with a null
    id are clustered but start no centroid unless fewer than ``k`` others are there; rows that repeat an id are rows of
    their own, in the order of their components as starts. With fewer than ``k`` vectors each is a centroid; no rows
    give no rows. Vectors of any size are compared exactly; distances and sums above 2^63 - 1 come out as that number.
    """
    spark = df.sparkSession
    rows = kept_vectors(df, dim, id_col, vector_col)
    named = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), "x")
    first = named.orderBy(F.col("hash").asc_nulls_last(), "x").limit(k).collect()  # k rows
    centroids = [[whole(a, scale) for a in r["x"]] for r in first]
    if not centroids:
        return spark.createDataFrame([], OUT)
    table = cut(in_blocks(rows, dim, block_rows))
    blocks = table.rdd
    for _ in range(rounds):
        centroids = moved(blocks, centroids, dim, scale)
    inside = inertias(blocks, centroids, dim, scale)
    whole_sum = min(sum(inside), LARGEST)
    inside = [min(x, LARGEST) for x in inside]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                found, distance = nearest(_vectors(batch.column(1)[i].as_py(), dim), centroids, scale)
                at = found.tolist()
                columns = [ids, pa.array(at, pa.int32()), pa.array([min(d, LARGEST) for d in distance.tolist()], pa.int64())]
                columns += [pa.array([inside[c] for c in at], pa.int64()), pa.array([whole_sum] * len(at), pa.int64()), pa.array([names[c] for c in at], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return table.mapInArrow(assigned, OUT)
