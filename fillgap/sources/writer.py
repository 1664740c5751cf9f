"""Nets as text: one line a record, indented by depth, with attributes in their fixed order."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from fillgap.functions.ordering import running_sum, safe_file_name
from fillgap.operators.view import flat
from fillgap.schema import ATTRIBUTES
from fillgap.session import cut
from fillgap.sources.ranges import join_files, readable

PART_LINES = 1 << 19  # lines of a part of a text, some 40 MB
CHUNK = 1_000  # orders of sections whose sizes are summed up in one row


def _shortest(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else format(Decimal(repr(float(v))), "f"))


def number_text(x: Column) -> Column:
    """The shortest decimal without exponent; whole numbers and those of two places, nearly all scores, never leave the JVM."""
    whole = (x == F.rint(x)) & (F.abs(x) < 1e18)
    hundredths = (x == F.round(x, 2)) & (F.abs(x) < 1e12)  # fewer than 16 digits name one number
    places = F.rtrim(x.cast("decimal(20,2)").cast("string"), F.lit("0"))
    return F.when(whole, x.cast("decimal(20,0)").cast("string")).when(hundredths, places).otherwise(F.pandas_udf(_shortest, "string")(F.when(~(whole | hundredths), x)))


def record_line(records: DataFrame, whole_scores: bool = False) -> Column:
    """depth + 1 spaces, seven fields, known attributes in order, then undocumented pairs in the order of input."""
    present = set(records.columns)
    parts = [F.concat(F.repeat(F.lit(" "), F.col("depth") + 1), F.col("kind")), *[F.col(c).cast("string") for c in ("reference_start", "reference_size", "query_name", "query_strand", "query_start", "query_size")]]
    for name, key, kind in ATTRIBUTES:
        if name in present:
            text = number_text(F.col(name)) if kind == "double" and not whole_scores else F.col(name).cast("decimal(20,0)").cast("string") if kind == "double" else F.col(name).cast("string")
            parts.append(F.when(F.col(name).isNotNull(), F.concat(F.lit(key + " "), text)))
    if "extras" in present:
        extras = F.array_join(F.transform("extras", lambda x: F.concat_ws(" ", x["key"], x["value"])), " ")
        parts.append(F.when(F.size("extras") > 0, extras))
    return F.concat_ws(" ", *parts)  # nulls are left out


def text_lines(sections: DataFrame, records: DataFrame, order: str = "net_id") -> DataFrame:
    """(section order, pos, line): headers have pos -1. Sections without records keep their header."""
    heads = sections.select(F.col(order).alias("section"), F.lit(-1).cast("long").alias("pos"), F.concat_ws(" ", F.lit("net"), "reference_name", F.col("section_size").cast("string")).alias("line"))
    body = records.select(F.col(order).alias("section"), F.col("pos").cast("long").alias("pos"), record_line(records).alias("line"))
    return heads.unionByName(body)


def in_order(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Lines dealt by ranges of their order and sorted within, so that part files in order of their names are the text."""
    return lines.repartitionByRange(*columns).sortWithinPartitions(*columns)


def in_places(lines: DataFrame, sections: DataFrame, order: str) -> DataFrame:
    """``in_order`` by section and pos, where sections know how many records they have: those numbers tell a line's part, so
    no line is made twice, as a sample of ranges would have it. Numbers that are not right only make parts uneven.
    """
    if "record_count" not in sections.columns or not isinstance(sections.schema[order].dataType, NumericType):
        return in_order(lines, ["section", "pos"])
    sizes = sections.groupBy(F.col(order).alias("section")).agg(F.sum(F.coalesce("record_count", F.lit(0)) + 1).cast("long").alias("__n"))
    total, n = sizes.agg(F.sum("__n"), F.count(F.lit(1))).first()
    each = min(max(-((total or 0) // -lines.sparkSession.sparkContext.defaultParallelism), PART_LINES // 8), PART_LINES)
    parts = max(1, -((total or 0) // -each))
    sizes = running_sum(sizes, [], F.floor(F.col("section") / CHUNK), ["section"], F.col("__n"), "__first").select("section", "__n", "__first")
    place = F.col("__first") + F.greatest(F.least(F.col("pos") + 1, F.col("__n") - 1), F.lit(0))
    part = F.least(F.coalesce(F.floor(place / each), F.lit(0)), F.lit(parts - 1)).cast("int")  # metadata is in the first
    dealt = lines.join(F.broadcast(sizes) if n <= 1_000_000 else sizes, "section", "left").withColumn("__part", part).drop("__n", "__first")
    return dealt.repartitionById(parts, "__part").sortWithinPartitions("section", "pos")


def with_metadata(lines: DataFrame, metadata: list[str]) -> DataFrame:
    """Metadata lines before all sections."""
    if not metadata:
        return lines
    first = lines.sparkSession.createDataFrame([(i - len(metadata), m) for i, m in enumerate(metadata)], "pos long, line string")
    return first.select(F.lit(-1).cast(lines.schema["section"].dataType).alias("section"), "pos", "line").unionByName(lines)


def write_nets(sections: DataFrame, records: DataFrame, path: str, order: str = "net_id", metadata: list[str] = (), compression: str = "none") -> None:
    """Write one data set of text parts in order: part files follow ranges of (section, pos), so reading them by name gives the file."""
    lines = with_metadata(text_lines(sections, records, order), metadata)
    in_places(lines, sections, order).select("line").write.option("compression", compression).text(path)


def write_net_file(sections: DataFrame, records: DataFrame, path: str, order: str = "net_id", metadata: list[str] = (), gzip: bool | None = None) -> None:
    """Write one file, gzip if its name ends with .gz or if asked for."""
    _write_ordered(in_places(with_metadata(text_lines(sections, records, order), metadata), sections, order), path, gzip)


def write_lines_file(lines: DataFrame, columns: list[str], path: str, gzip: bool | None = None) -> None:
    """Write the column ``line`` in order of ``columns`` as one file."""
    _write_ordered(in_order(lines, columns), path, gzip)


def _write_ordered(lines: DataFrame, path: str, gzip: bool | None = None) -> None:
    """One file of lines that are in order.

    The parts are sorted and written by all tasks next to the file; a task then puts their bytes together under a
    temporary name, part after part, and the file appears under its own name when it is whole. Parts are gzip, members of
    a file that is; others are inflated on the way. The driver copies nothing, except into stores that only Spark can open.
    """
    packed = path.endswith(".gz") if gzip is None else gzip
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lines.select("line").write.option("compression", _compression(packed, path)).text(parts)
    _joined(lines.sparkSession.createDataFrame([(parts, path)], "folder string, target string"), path, packed)
    _delete(lines.sparkSession, parts)


def _compression(packed: bool, path: str) -> str:
    """Parts are on disk beside what becomes of them, so they are small where tasks put them together."""
    return "gzip" if packed or readable(path) else "none"


def _joined(targets: DataFrame, path: str, packed: bool) -> None:
    """Each target from the parts of its folder, a task a target."""
    spark = targets.sparkSession
    if readable(path):
        join_files(targets, not packed).agg(F.sum("bytes")).collect()
        return
    with ThreadPoolExecutor(16) as pool:
        for _ in pool.map(lambda r: _join_parts(spark, r["folder"], r["target"]), targets.toLocalIterator()):
            pass  # errors come up here


def _delete(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """The part files of ``folder`` as one file, as a file system's merge command does, through the driver."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = jvm.org.apache.hadoop.fs
    where, whole, rising = paths.Path(folder), paths.Path(target), paths.Path(f"{folder}.tmp")
    fs = whole.getFileSystem(conf)
    out = fs.create(rising, True)
    try:
        for part in sorted((s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")), key=lambda x: x.getName()):
            stream = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            finally:
                stream.close()
    finally:
        out.close()
    fs.delete(whole, False)
    if not fs.rename(rising, whole):
        raise OSError(f"{target} can't be written")


def section_text(sections: DataFrame, records: DataFrame) -> DataFrame:
    """net_id and the whole text of each section. For sections that fit into memory; write_nets is the way for large ones."""
    lines = text_lines(sections, records)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(F.col("section").alias("net_id")).agg(F.concat(joined, F.lit("\n")).alias("text"))


def section_digests(sections: DataFrame, records: DataFrame) -> DataFrame:
    """net_id, bytes and digest (md5) of each section's text. Lines arrive sorted, batch by batch, and none is kept; the
    digest depends on their order, so a section is one task's work."""
    lines = text_lines(sections, records)
    kind = lines.schema["section"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        section, size, digest = None, 0, hashlib.md5(usedforsecurity=False)
        for batch in batches:
            if batch.num_rows:
                section, text = batch["section"][0], ("\n".join(batch["line"].to_pylist()) + "\n").encode()
                size += len(text)
                digest.update(text)
        yield pa.RecordBatch.from_arrays([pa.array([section.as_py()], section.type), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], ["net_id", "bytes", "digest"])

    ordered = lines.repartition("section").sortWithinPartitions("section", "pos")
    return ordered.groupBy("section").applyInArrow(run, f"net_id {kind}, bytes long, digest string")


def flat_lines(records: DataFrame) -> DataFrame:
    """Tab-separated lines of the flat view, -1 for an absent chain or parent."""
    rows = flat(records)
    return rows.select("reference_name", "pos", F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("line"))


def split_names(sections: DataFrame, suffix: str = ".net") -> DataFrame:
    """Adds ``file``: the section's safe name, the second of a name with .1 before the suffix, the third with .2, and so on.

    A numbered name may be the plain name of another section. Names that can meet in this way have the same stem, the
    safe name without numbers at its end; they go through one task a stem, in order of the sections.
    """
    safe = safe_file_name(F.col("reference_name"))
    base = sections.withColumn("__base", safe).withColumn("__stem", F.regexp_replace(safe, r"(\.[0-9]+)+$", ""))

    def number(rows: pa.Table) -> pa.Table:
        rows, used, next_free, names = rows.sort_by("net_id"), set(), {}, []
        for stem in rows["__base"].to_pylist():
            n = next_free.get(stem, 0)
            while (name := f"{stem}.{n}" if n else stem) in used:
                n += 1
            next_free[stem] = n
            used.add(name)
            names.append(name + suffix)
        return pa.table({"net_id": rows["net_id"], "file": pa.array(names, pa.string())})

    schema = f"net_id {sections.schema['net_id'].dataType.simpleString()}, file string"
    names = base.select("net_id", "__base", "__stem").groupBy("__stem").applyInArrow(number, schema)
    return sections.join(names, "net_id")


def split(sections: DataFrame, records: DataFrame, path: str, suffix: str = ".net", gzip: bool = False) -> DataFrame:
    """Write every section into a file of its own under ``path``; returns the manifest.

    Lines are written by ranges of (section, pos), so that a long section is many tasks' work; the parts of a section
    then become its file.
    """
    spark = sections.sparkSession
    suffix = f"{suffix}.gz" if gzip and not suffix.endswith(".gz") else suffix
    named = cut(split_names(sections, suffix))
    lines = text_lines(sections, records).join(named.select(F.col("net_id").alias("section"), "file"), "section")
    parts = f"{path}/.parts-{uuid.uuid4().hex}"
    in_places(lines, sections, "net_id").select("file", "line").write.partitionBy("file").option("compression", _compression(gzip, path)).text(parts)
    targets = named.select(F.concat(F.lit(f"{parts}/file="), "file").alias("folder"), F.concat(F.lit(f"{path}/"), "file").alias("target"))
    _joined(targets.repartition(max(1, min(named.count(), 10_000)), "target"), path, gzip)
    _delete(spark, parts)
    return named.select("net_id", "reference_name", "section_size", "file", F.col("record_count").alias("records"))
