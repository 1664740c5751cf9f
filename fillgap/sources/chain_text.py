"""Chain files: a header line with scores and ends, then lines of block size and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillgap.sources.net_text import numbered


def parse_chains(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chains, metadata) of lines; chains are numbered in the order of the file, metadata are its ``#`` lines.

    Rows of one chain meet by its number, so a file of any size is dealt over all tasks.
    """
    rows = numbered(lines, r"^chain[ \t]").withColumn("t", F.filter(F.split("text", "[ \t]+"), lambda x: x != ""))
    t = lambda i: F.get("t", F.lit(i))
    long = lambda i: t(i).try_cast("long")
    heads = rows.where("role = 'header'").select(
        "file_id", F.col("net_id").alias("n"), t(12).try_cast("decimal(20,0)").alias("chain_id"), long(1).alias("score"), t(2).alias("reference_name"), long(3).alias("reference_size"), t(4).alias("reference_strand"),
        long(5).alias("reference_start"), long(6).alias("reference_end"), t(7).alias("query_name"), long(8).alias("query_size"), t(9).alias("query_strand"), long(10).alias("query_start"), long(11).alias("query_end"),
    )
    zero = F.lit(0).cast("long")
    block = F.struct("line_no", long(0).alias("size"), F.coalesce(long(1), zero).alias("gap_reference"), F.coalesce(long(2), zero).alias("gap_query"))
    blocks = rows.where("role = 'record' and net_id is not null").groupBy("file_id", F.col("net_id").alias("n")).agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    blocks = blocks.withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["size"].alias("size"), b["gap_reference"].alias("gap_reference"), b["gap_query"].alias("gap_query"))))
    chains = heads.join(blocks, ["file_id", "n"], "left").withColumn("input_ordinal", F.col("n").cast("long")).drop("n")
    return chains, rows.where("role = 'comment'").select("file_id", "line_no", F.col("text").alias("line"))
