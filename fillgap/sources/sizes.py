"""Ordered sizes of sequences: side, ordinal, name, size."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgap.session import cut
from fillgap.sources.net_text import numbered, read_lines
from fillgap.sources.ranges import files_of, opened, readable

SCHEMA = "side string, ordinal int, name string, size long"


def in_memory(spark: SparkSession, side: str, pairs: Iterable[tuple[str, int]]) -> DataFrame:
    return unique(spark.createDataFrame([(side, i, n, s) for i, (n, s) in enumerate(pairs)], SCHEMA))


def from_text(spark: SparkSession, side: str, path: str) -> DataFrame:
    return parse_sizes(read_lines(spark, [path]), side)


def parse_sizes(lines: DataFrame, side: str) -> DataFrame:
    """Two columns, name and size; blank lines and those that start with # are skipped. The ordinal is the line's number."""
    rows = numbered(lines, "^(?!)").where("role = 'record'")
    t = F.filter(F.split("text", "[ \t]+"), lambda x: x != "")
    return unique(rows.select(F.lit(side).alias("side"), (F.col("line_no") - 1).cast("int").alias("ordinal"), F.get(t, F.lit(0)).alias("name"), F.get(t, F.lit(1)).cast("long").alias("size")))


def from_twobit(spark: SparkSession, side: str, path: str) -> DataFrame:
    """Names and lengths from a 2bit file of any size, of which only the index and four bytes a sequence are read.

    Offsets of 64 bits (version 1) and either order of bytes will do. A file that Python can't open is read whole.
    """
    (file,) = files_of(spark, [path])
    if not readable(file):
        entries = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_whole_index, "ordinal int, name string, size long")
        return unique(entries.select(F.lit(side).alias("side"), "ordinal", "name", "size"))
    index = cut(spark.createDataFrame([(file,)], "path string").mapInArrow(_twobit_index, "path string, ordinal int, name string, start long, swapped boolean"))
    tasks = max(1, index.count() // 10_000)
    entries = index.repartitionByRange(tasks, "start").sortWithinPartitions("start").mapInArrow(_twobit_lengths, "ordinal int, name string, size long")
    return unique(entries.select(F.lit(side).alias("side"), "ordinal", "name", "size"))


MAGIC = 0x1A412743


def twobit_entries(file: BinaryIO, step: int = 1 << 16) -> Iterator[tuple[str, int, bool]]:
    """(name, offset, bytes swapped) of a 2bit file's index, read in small steps from its start."""
    head = file.read(16)
    order = "<" if struct.unpack("<I", head[:4])[0] == MAGIC else ">"
    magic, version, n = struct.unpack(order + "III", head[:12])
    if magic != MAGIC or version > 1:
        raise ValueError("not a 2bit file")
    width, kind, held, at = (8, "Q", b"", 0) if version else (4, "I", b"", 0)
    for _ in range(n):
        while at >= len(held) or len(held) < at + 1 + held[at] + width:
            data = file.read(step)
            if not data:
                raise ValueError("the 2bit file ends inside its index")
            held, at = held[at:] + data, 0
        end = at + 1 + held[at]
        yield held[at + 1 : end].decode(), struct.unpack(order + kind, held[end : end + width])[0], order == ">"
        at = end + width


def _twobit_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with opened(path) as file:
                rows = list(twobit_entries(file))
            columns = [pa.array([path] * len(rows)), pa.array(range(len(rows)), pa.int32()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_())))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "ordinal", "name", "start", "swapped"])


def _twobit_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four bytes at each sequence's offset."""
    for batch in batches:
        found, file, at = [], None, None
        for path, start, swapped in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "swapped")), strict=True):
            if path != at:
                if file:
                    file.close()
                file, at = opened(path), path
            file.seek(start)
            found.append(struct.unpack(">I" if swapped else "<I", file.read(4))[0])
        if file:
            file.close()
        yield pa.RecordBatch.from_arrays([batch.column("ordinal"), batch.column("name"), pa.array(found, pa.int64())], names=["ordinal", "name", "size"])


def _whole_index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in parts:
        for data in df["content"]:
            rows = [(i, name, struct.unpack(">I" if swapped else "<I", data[start : start + 4])[0]) for i, (name, start, swapped) in enumerate(twobit_entries(io.BytesIO(data)))]
            yield pd.DataFrame(rows, columns=["ordinal", "name", "size"])


def unique(sizes: DataFrame) -> DataFrame:
    """The sizes; names that occur twice on a side fail."""
    again = [r["name"] for r in sizes.groupBy("side", "name").count().where("count > 1").limit(1).collect()]
    if again:
        raise ValueError(f"sequence {again[0]!r} occurs twice")
    return sizes
