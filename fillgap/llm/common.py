"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fillgap.session import cut, shared_dir  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_row_id(*cols: Column, seed: int, modulus: int) -> Column:
    """A repeatable pseudo-random number in 0..modulus-1 for a row."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(modulus)).cast("long")


def drawn(share: Column | float, *cols: Column | str, seed: int) -> Column:
    """True for about ``share`` of the rows, by a hash of the columns; shares may be as small as 1 in 10 ** 18."""
    steps = float(1 << 62)
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 62)) / F.lit(steps) < share


def buckets_for(rows: int, per_bucket: int = 20_000) -> int:
    return max(1, math.ceil(rows / per_bucket))


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``keys`` in two levels, so that no key has to fit into one task.

    Rows are summed inside (keys, bucket); the totals of the buckets, one row each, are summed per key and added.
    """
    valued = df.withColumn("__v", value)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = valued.groupBy(*keys, bucket).agg(F.sum("__v").alias("__t"))
    totals = totals.withColumn("__before", F.sum("__t").over(before) - F.col("__t")).drop("__t")
    ranked = valued.withColumn("__inside", F.sum("__v").over(inside) - F.col("__v"))
    return ranked.join(totals, [*keys, bucket]).withColumn(out, F.col("__before") + F.col("__inside")).drop("__v", "__before", "__inside")


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the documents: those that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def columns_of(df: DataFrame) -> list[str]:
    """All column names in a form that select() takes, whatever dots and backticks they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def vector_rows(rows: DataFrame) -> DataFrame:
    """id, v, width and mark, a hash of v, of the distinct rows (id, v): rows that repeat an id with another vector are rows of their own."""
    return cut(rows.select("id", "v").distinct().withColumns({"width": F.size("v"), "mark": F.xxhash64("v")}))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """v, width, mark, id (the smallest of v's ids), ids (the smallest ``k`` + 1 of them): all that a top-k search can return of equal vectors."""
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.select("id", "v").withColumn("__n", first).where(F.col("__n") <= k + 1)  # cut down before the shuffle as well
    once = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return once.withColumns({"id": F.element_at("ids", 1), "width": F.size("v"), "mark": F.xxhash64("v")})


def best_of(scored: DataFrame, once: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` rows of each query from scores of distinct vectors; the query's own row is left out.

    scored: query_id, query_mark, id, mark, score.
    """
    each = scored.join(once.select("id", "mark", "ids"), ["id", "mark"]).select("query_id", "query_mark", "score", "mark", F.explode("ids").alias("id"))
    each = each.where((F.col("id") != F.col("query_id")) | (F.col("mark") != F.col("query_mark")))
    order = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
