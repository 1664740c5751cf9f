"""Sort keys and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def natural_key(name: Column) -> Column:
    """A string whose order is the natural one: runs of digits by value, everything else by bytes.

    A run of digits becomes 0, its number of digits in ten places, and its digits without leading zeros.
    """

    def key(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        return F.when(run.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(run)

    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), key), "")


def safe_file_name(name: Column) -> Column:
    """Every byte but letters, digits, dot, dash and underscore becomes an underscore; an empty name becomes ``unnamed``."""
    by_byte = F.decode(F.encode(name, "UTF-8"), "ISO-8859-1")
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, F.lit("unnamed")).otherwise(F.regexp_replace(by_byte, r"[^A-Za-z0-9._-]", "_"))


def is_haplotype(name: Column) -> Column:
    return name.contains("_hap") | name.contains("_alt")


def running_sum(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one within ``keys``, in the order of ``order``.

    ``bucket`` has to rise with the order. Rows are summed within buckets, and the buckets before are one row each, so no
    task needs all rows of a key.
    """
    parted = [*keys, "__bucket"]
    rows = rows.withColumns({"__bucket": bucket, "__value": value})
    buckets_before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*parted).agg(F.sum("__value").alias("__sum"))
    sums = sums.select(*parted, F.coalesce(F.sum("__sum").over(buckets_before), F.lit(0)).alias("__before"))
    before = Window.partitionBy(*parted).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum("__value").over(before), F.lit(0)))
    return rows.join(sums, parted).withColumn(out, (F.col("__before") + F.col("__inside")).cast("long")).drop("__bucket", "__value", "__inside", "__before")


def ranked(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], out: str) -> DataFrame:
    """Adds ``out``: the rank from 0 within ``keys``, as ``running_sum`` does."""
    return running_sum(rows, keys, bucket, order, F.lit(1), out)
