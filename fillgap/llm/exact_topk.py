"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments, and each segment is summarised by its mean and its standard deviation. For segments of
n components, the squared distance is at least  n * ((mean - mean')^2 + (deviation - deviation')^2), summed over the
segments; as the lengths of both vectors are known, a lower bound of the distance is an upper bound of the inner
product. Few long segments give a cheap bound and many short ones a close bound.

Vectors of like statistics make blocks, whose statistics lie in a box. Every query first meets one block of its like,
which gives it a k-th best score; of the other pairs of blocks only those are visited whose boxes' bound reaches the
least of these scores. In a visit the bounds are worked out from coarse to fine; a pair stays while its bound reaches the
query's k-th best exact score so far, and the survivors' scores are computed exactly. What the bounds leave out can't be
among the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillgap.llm.common import best_of, cut, distinct_vectors, vector_rows

LEVELS = (1, 4, 16)  # segments
LARGEST = (1 << 63) - 1


def quantised(df: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v (array of long): floor(scale * x) of every component x; vectors with null or non-finite components are left out."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return rows.select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def largest(x: np.ndarray) -> int:
    """The largest absolute value of whole numbers, the smallest long included."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def profile(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose product with another row's profile is an upper bound of the inner product."""
    cuts = np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            out += [x[:, a:b].mean(1) * np.sqrt(b - a), x[:, a:b].std(1) * np.sqrt(b - a)]
    return np.stack(out, 1) if out else np.zeros((len(x), 1))


def best_in_block(q: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query all candidates that can't be told from its best k by their exact scores: positions in x, ties kept."""
    bounds = [(profile(q, s), profile(x, s)) for s in LEVELS]
    slack = 1e-9 * (1 + np.abs(q).sum(1).max(initial=0) * np.abs(x).max(initial=0))
    first = bounds[-1][0] @ bounds[-1][1].T if len(x) <= k else None
    coarse = bounds[0][0] @ bounds[0][1].T
    found = []
    for i in range(len(q)):
        if first is not None:
            found.append(np.arange(len(x)))
            continue
        # a floor for the k-th best: exact scores of those that look best at the coarse level
        start = np.argpartition(-coarse[i], min(4 * k, len(x)) - 1)[: 4 * k]
        floor = np.partition(x[start] @ q[i], len(start) - k)[len(start) - k]
        stay = np.flatnonzero(coarse[i] + slack >= floor)
        for qs, xs in bounds[1:]:
            bound = xs[stay] @ qs[i]
            top = stay[np.argpartition(-bound, min(2 * k, len(stay)) - 1)[: 2 * k]]
            exact = x[top] @ q[i]
            if len(top) >= k:
                floor = max(floor, np.partition(exact, len(top) - k)[len(top) - k])
            stay = stay[bound + slack >= floor]
        score = x[stay] @ q[i]
        found.append(stay[score >= np.partition(score, len(stay) - k)[len(stay) - k]] if len(stay) > k else stay)
    return found


def bound_of_boxes(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """An upper bound of all products between the profiles of two boxes: the best corner in each dimension. Boxes are rows."""
    best = np.maximum.reduce([a * b for a in (lo, hi) for b in (other_lo, other_hi)])
    return best.sum(-1) + 1e-12 * np.abs(best).sum(-1)


CELLS = 256


def in_blocks(rows: DataFrame, block_rows: int, parts: int, seed: int) -> DataFrame:
    """Adds ``block``: vectors of one length whose coarse statistics are alike, about ``block_rows`` of them.

    The cell of a vector is the signs of the means of four segments and the class of its norm, or fewer than these for
    less than ``parts`` cells. A cell of any size is dealt over as many blocks as it needs.
    """
    quarter = F.greatest(F.lit(1), F.ceil(F.size("v") / 4)).cast("int")
    add = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    signs = F.lit(0)
    for i in range(4):
        signs = signs * 2 + (add(F.slice("v", quarter * i + 1, quarter)) > 0).cast("int")
    norm = F.log2(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)) + 1)
    cells = rows.withColumn("cell", F.struct("width", F.floor(signs * F.lit(min(16, parts) / 16)).alias("side"), F.floor(norm * (2 if parts > 16 else 0)).alias("norm")))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("dealt"))
    dealt = cells.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, "cell")
    return dealt.withColumn("block", F.struct("cell.*", F.pmod(F.xxhash64(F.lit(seed), "id", "mark"), F.col("dealt")).alias("part"))).drop("cell", "dealt")


def boxes(rows: DataFrame) -> DataFrame:
    """block, lo, hi: between which values the finest profiles of a block's vectors lie, widened for rounding."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for block, own in df.groupby("block"):
                p = profile(np.stack(own["v"].to_numpy()).astype(np.float64), LEVELS[-1]) if own["width"].iloc[0] else np.zeros((1, 1))
                yield pd.DataFrame({"block": [block], "lo": [p.min(0)], "hi": [p.max(0)]})

    named = rows.select(F.to_json("block").alias("block"), "width", "v")
    each = named.mapInPandas(run, "block string, lo array<double>, hi array<double>")
    at = each.select("block", F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "x"))
    met = at.groupBy("block", "d").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    return met.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "lo"))), lambda x: x["lo"]).alias("lo"), F.transform(F.sort_array(F.collect_list(F.struct("d", "hi"))), lambda x: x["hi"]).alias("hi"))


def search(df: DataFrame, is_query, k: int = 20, scale: float = 64.0, block_rows: int = 8_192, query_rows: int = 1_024, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 8) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each row that ``is_query`` picks by its id, itself left out.

    Input: a long id and an array of numbers; other columns are ignored. Output: query_id, rank (from 1), vec_id, score
    (long), highest first, ties to the smaller id. Rows with a null id or a vector that is null or holds null or
    non-finite components take no part; zero and empty vectors do. Vectors of different lengths have no product: each
    length is searched by itself. Fewer rows than ``k`` give all there are; no rows give no rows. A row that repeats an id
    with another vector is a row of its own, as query and as candidate; a row that repeats both counts once. Products
    whose terms add up to 2^53 or more in absolute value are worked out in whole numbers of any size. A component that
    no long can hold counts as the nearest long, and so does a product, whose lower end is -(2^63 - 1).
    """
    spark = df.sparkSession
    rows = vector_rows(quantised(df, scale, id_col, vector_col))
    schema = "query_id long, query_mark long, id long, mark long, score long"
    parts = max(1, min(CELLS, rows.count() // block_rows))
    once = cut(in_blocks(distinct_vectors(rows, k), block_rows, parts, seed).withColumn("cb", F.to_json("block")))
    queries = rows.where(is_query(F.col("id"))).select("id", "mark", "width", "v")
    asked = cut(in_blocks(queries, query_rows, parts, seed + 1).select(F.col("id").alias("query_id"), F.col("mark").alias("query_mark"), "width", "v", F.to_json("block").alias("qb"), "block"))

    def scan(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            ids, marks = c["id"].to_numpy(), c["mark"].to_numpy()
            x = np.stack(c["v"].to_numpy())
            large = largest(x) * x.shape[1]
            for s in range(0, len(q), 128):
                some = q.iloc[s : s + 128]
                y = np.stack(some["v"].to_numpy())
                if large * largest(y) < 1 << 53:
                    close = best_in_block(y.astype(np.float64), x.astype(np.float64), k + 1)
                else:
                    close = [np.arange(len(x))] * len(y)
                for i, at in enumerate(close):
                    if not len(at):
                        score = np.empty(0, np.int64)
                    elif large * largest(y[i]) >= 1 << 53:
                        score = np.array([max(-LARGEST, min(LARGEST, s)) for s in x[at].astype(object) @ y[i].astype(object)], np.int64)
                    else:
                        score = x[at] @ y[i]
                    row = some.iloc[i]
                    floor = row["floor"]
                    over = np.ones(len(at), bool) if floor is None or floor != floor else score >= max(-LARGEST, min(LARGEST, int(floor)) - (abs(int(floor)) >> 50))
                    out.append(pd.DataFrame({"query_id": row["query_id"], "query_mark": row["query_mark"], "id": ids[at][over], "mark": marks[at][over], "score": score[over]}))
        found = pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "query_mark", "id", "mark", "score")})
        return found.astype(dict.fromkeys(found.columns, "int64"))

    best = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "id", "mark")

    def visited(pairs: DataFrame, near: DataFrame) -> DataFrame:
        """What is best after the queries of each pair's block have met its candidates."""
        floors = near.groupBy("query_id", "query_mark").agg(F.when(F.count(F.lit(1)) >= k + 1, F.min("score")).alias("floor"))
        mine = asked.select("query_id", "query_mark", "width", "v", "qb").join(floors, ["query_id", "query_mark"], "left").join(pairs, "qb")
        theirs = once.select("id", "mark", "v", "cb").join(pairs, "cb")
        found = mine.groupBy("qb", "cb").cogroup(theirs.groupBy("qb", "cb")).applyInPandas(scan, schema)
        return cut(near.unionByName(found).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"))

    # Blocks of queries and of candidates, with their boxes; of equal lengths only.
    ours = cut(boxes(asked).join(asked.groupBy(F.col("qb").alias("block")).agg(F.first("width").alias("width"), F.first("block.side").alias("side"), F.first("block.norm").alias("norm")), "block").withColumnRenamed("block", "qb"))
    theirs = cut(boxes(once).join(once.groupBy(F.col("cb").alias("block")).agg(F.first("width").alias("width"), F.first("block.side").alias("side"), F.first("block.part").alias("part")), "block").withColumnRenamed("block", "cb"))

    @F.pandas_udf("double")
    def bound(lo: pd.Series, hi: pd.Series, other_lo: pd.Series, other_hi: pd.Series) -> pd.Series:
        return pd.Series([float(bound_of_boxes(*(np.asarray(x) for x in row))) for row in zip(lo, hi, other_lo, other_hi, strict=True)], dtype=float)

    pairs = ours.select("qb", "width", "side", F.col("lo").alias("a"), F.col("hi").alias("b")).join(theirs.select("cb", "width", F.col("side").alias("other_side"), "part", "lo", "hi"), "width")
    pairs = cut(pairs.select("qb", "cb", ((F.col("side") == F.col("other_side")) & (F.col("part") == 0)).alias("first"), bound("a", "b", "lo", "hi").alias("bound")))
    # First one block of each like cell, which gives every query a k-th best score; then the blocks whose bound reaches it.
    near = visited(pairs.where("first").select("qb", "cb"), spark.createDataFrame([], schema))
    least = near.groupBy("query_id", "query_mark").agg(F.when((F.count(F.lit(1)) >= k + 1) & (F.min("score") > -LARGEST), F.min("score")).alias("floor"))
    floors = asked.select("qb", "query_id", "query_mark").join(least, ["query_id", "query_mark"], "left").groupBy("qb").agg(F.when(F.count("floor") == F.count(F.lit(1)), F.min("floor")).alias("floor"))
    rest = pairs.where("not first").join(floors, "qb").where(F.col("floor").isNull() | (F.col("bound") + 1e-9 * (1 + F.abs("bound")) >= F.col("floor")))
    near = visited(cut(rest.select("qb", "cb")), near)
    return best_of(near, once, k)
