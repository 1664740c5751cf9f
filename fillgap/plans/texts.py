"""Queries on nets as text: lines written from the tables and read back, sections, errors and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillgap.functions.intervals import end_of
from fillgap.operators import tree, validate
from fillgap.plans import fixtures
from fillgap.plans.catalog import ISSUES
from fillgap.plans.oracle import LINES, NET
from fillgap.plans.registry import query
from fillgap.session import shared_dir
from fillgap.sources import net_text, ranges, writer
from fillgap.streaming import sections as streaming
from fillgap.streaming.sections import flat_events

READ = ["file_id", "net_id", "pos", "depth", "parent", "subtree_end", "kind", "reference_name", "reference_start", "reference_end", "query_name", "query_strand", "query_start", "query_end"]

#: Starts are 1,000 times an order's key, which passes u32 in long tables; the SQL has no such limit.
WIDE = net_text.ReaderOptions(wide=True)


@query(f"{LINES} SELECT net_id, pos, text AS line FROM line")
def record_lines(spark, sf_dir):
    return writer.text_lines(*_nets(spark, sf_dir)).select(F.col("section").alias("net_id"), "pos", "line")


@query(f"{LINES} SELECT net_id, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, md5(string_agg(text || chr(10), '' ORDER BY pos)) AS digest FROM line GROUP BY net_id")
def section_texts(spark, sf_dir):
    return writer.section_digests(*_nets(spark, sf_dir))


@query(f"""{LINES} SELECT t.file_id, t.ordinal AS net_id, n.pos, n.depth, n.parent, n.subtree_end, n.kind, n.reference_name, n.reference_start, n.reference_end, replace(n.query_name, ' ', '_') AS query_name, n.query_strand, n.query_start,
n.query_start + n.query_size AS query_end, n.chain_id, n.alignment_score, n.aligned_bases, n.net_type, n.reference_unsequenced, n.extra AS status FROM net n JOIN text t ON t.net_id = n.net_id AND t.pos = n.pos""")
def read_records(spark, sf_dir):
    """Lines parsed back: fields, attributes, undocumented pairs, and the tree from the indentation."""
    _, records, _ = net_text.parse(fixtures.net_lines(spark, sf_dir), WIDE)
    records = records.withColumn("reference_end", end_of(F.col("reference_start"), F.col("reference_size")))
    return records.select(*READ, F.col("chain_id").cast("long").alias("chain_id"), "alignment_score", "aligned_bases", "net_type", "reference_unsequenced", F.try_element_at(F.transform("extras", lambda x: x["value"]), F.lit(1)).alias("status"))


@query(f"""{LINES} SELECT t.file_id, t.ordinal AS net_id, s.reference_name, s.section_size, t.byte_start, s.record_count, s.root_count FROM sec s JOIN text t ON t.net_id = s.net_id AND t.pos = -1""")
def read_sections(spark, sf_dir):
    sections, _, _ = net_text.parse(fixtures.net_lines(spark, sf_dir), WIDE)
    return sections.select("file_id", "net_id", "reference_name", "section_size", "byte_start", "record_count", "root_count")


@query(f"""{LINES} SELECT file_id, ordinal AS net_id, split_part(text, ' ', 2) AS reference_name, CAST(split_part(text, ' ', 3) AS BIGINT) AS section_size, byte_start,
coalesce(lead(byte_start) OVER (PARTITION BY file_id ORDER BY ordinal), file_bytes) AS byte_end FROM text WHERE pos = -1""")
def read_index(spark, sf_dir):
    return net_text.section_index(fixtures.net_lines(spark, sf_dir))


@query(f"{LINES} SELECT line_no, byte_start, text FROM text WHERE net_id = 6")
def read_one_section(spark, sf_dir):
    lines = fixtures.net_lines(spark, sf_dir)
    return net_text.section_lines(lines, net_text.section_index(lines), "chr6").select("line_no", "byte_start", "text")


@query(f"""{LINES} SELECT n.pos, n.depth, n.kind, n.reference_start FROM net n WHERE net_id = (SELECT min(net_id) FROM sec WHERE net_id % 4 = 0)""")
def read_first_section(spark, sf_dir):
    sections, records, _ = net_text.parse(fixtures.net_lines(spark, sf_dir), WIDE)
    return net_text.first_section(sections, records)[1].select("pos", "depth", "kind", "reference_start")


BROKEN = f"""{LINES}, broken AS MATERIALIZED (
  SELECT file_id, net_id, pos, depth, CASE pos % 1009 WHEN 5 THEN regexp_replace(text, '(fill|gap)', 'fi11') WHEN 105 THEN text || ' odd' WHEN 205 THEN replace(text, ' + ', ' * ') WHEN 305 THEN replace(text, 'tN ', 'tN x') ELSE text END AS text FROM line
), again AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER w AS BIGINT) AS line_no, CAST(sum(strlen(text) + 1) OVER w - strlen(text) - 1 AS BIGINT) AS byte_start,
    CAST(count(*) FILTER (pos = -1) OVER w - 1 AS INTEGER) AS ordinal FROM broken WINDOW w AS (PARTITION BY file_id ORDER BY net_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), wrong AS (
  SELECT *, CASE pos % 1009 WHEN 5 THEN depth + 1 WHEN 105 THEN strlen(text) - 3 WHEN 205 THEN strpos(text, ' * ') WHEN 305 THEN strpos(text, 'tN x') + 2 END AS shift,
    CASE pos % 1009 WHEN 5 THEN 'InvalidRecordKind' WHEN 105 THEN 'OddAttributeCount' WHEN 205 THEN 'InvalidStrand' WHEN 305 THEN 'InvalidInteger' END AS kind FROM again
  WHERE pos >= 0 AND (pos % 1009 IN (5, 105) OR pos % 1009 = 205 AND contains(text, ' * ') OR pos % 1009 = 305 AND contains(text, 'tN x'))
)"""


@query(f"{BROKEN} SELECT file_id, ordinal AS net_id, line_no, byte_start + shift AS \"offset\", CAST(shift + 1 AS INTEGER) AS \"column\", kind, 'chr' || net_id AS section FROM wrong")
def read_errors(spark, sf_dir):
    """Lines with four kinds of faults, each with its token's byte, column and section."""
    lines, at = fixtures.net_lines(spark, sf_dir), (F.col("place") - 1) % 1009
    text = F.when(at == 5, F.regexp_replace("value", "^( +)(fill|gap)", "$1fi11")).when(at == 105, F.concat("value", F.lit(" odd"))).when(at == 205, F.replace("value", F.lit(" + "), F.lit(" * "))).when(at == 305, F.replace("value", F.lit("tN "), F.lit("tN x")))
    lines = lines.withColumn("value", F.when(F.col("place") > 0, F.coalesce(text, "value")).otherwise(F.col("value")))
    _, _, errors = net_text.parse(lines, net_text.ReaderOptions(mode=net_text.PERMISSIVE, wide=True))
    return errors.select("file_id", "net_id", "line_no", "offset", "column", "kind", "section")


@query(f"""{NET} SELECT net_id, CAST(-1 AS BIGINT) AS seq, 'start' AS event, NULL AS kind FROM sec UNION ALL SELECT net_id, pos, 'record', kind FROM net UNION ALL SELECT net_id, record_count, 'end', NULL FROM sec""")
def section_events(spark, sf_dir):
    records, sections, _ = fixtures.net(spark, sf_dir)
    return flat_events(sections, records).select("net_id", "seq", "event", "kind")


@query(f"""{NET} SELECT net_id, CAST(count(*) AS BIGINT) AS entered, CAST(count(*) AS BIGINT) AS "left", CAST(max(depth) + 1 AS INTEGER) AS deepest, CAST(sum(reference_size) FILTER (kind = 'gap') AS BIGINT) AS gap_bases FROM net GROUP BY net_id""")
def visitor_fold(spark, sf_dir):
    """A visitor that counts what it enters and leaves, the deepest open path, and the bases of gaps."""
    records = fixtures.net_orders(spark, sf_dir).select("net_id", "pos", "subtree_end", "kind", "reference_size")
    enter = lambda s, r: ([s[0] + 1, s[1], s[2] + 1, max(s[3], s[2] + 1), s[4] + (r["reference_size"] if r["kind"] == "gap" else 0)], True)
    leave = lambda s, r: [s[0], s[1] + 1, s[2] - 1, s[3], s[4]]
    return tree.fold(records, lambda: [0] * 5, enter, leave, lambda s: {"entered": s[0], "left": s[1], "deepest": s[3], "gap_bases": s[4]}, "entered long, `left` long, deepest int, gap_bases long")


SAYS = "CASE code " + " ".join(f"WHEN '{c}' THEN '{m}'" for c, m in validate.MESSAGES.items()) + " END"


@query(f"{ISSUES} SELECT net_id, anchor, rule, pos, concat_ws(chr(9), severity, code, net_id, pos, CASE WHEN detail <> '' THEN detail || ' ' ELSE '' END || {SAYS}) AS line FROM found")
def validation_report(spark, sf_dir):
    records, sections, parts, tops = fixtures.whole_net(spark, sf_dir)
    return validate.report_lines(validate.issues(records, sections, parts=parts, max_depth=2, tops=tops))


@query(f"""{NET}, s AS (SELECT net_id, CASE net_id % 5 WHEN 0 THEN 'a/b' WHEN 1 THEN 'a?b' WHEN 2 THEN 'a_b' WHEN 3 THEN 'c' ELSE '' END AS reference_name, CASE net_id % 5 WHEN 3 THEN 'c' WHEN 4 THEN 'unnamed' ELSE 'a_b' END AS base FROM sec),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY net_id) - 1 AS k FROM s) SELECT net_id, reference_name, base || CASE WHEN k > 0 THEN '.' || k ELSE '' END || '.net' AS file FROM k""")
def split_names_clash(spark, sf_dir):
    sections = fixtures.net(spark, sf_dir)[1]
    names = F.element_at(F.array(*[F.lit(x) for x in ("a/b", "a?b", "a_b", "c", "")]), (F.col("net_id") % 5 + 1).cast("int"))
    return writer.split_names(sections.withColumn("reference_name", names)).select("net_id", "reference_name", "file")


@query(f"{NET} SELECT reference_name, record_count AS records, reference_name || '.net' AS file FROM sec")
def split_manifest(spark, sf_dir):
    return writer.split_names(fixtures.net(spark, sf_dir)[1]).select("reference_name", F.col("record_count").alias("records"), "file")


FILE_ROWS = "SELECT net_id, pos, depth, kind, reference_start, chain_id FROM net"


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _nets(spark, sf_dir):
    records, sections, _ = fixtures.net(spark, sf_dir)
    return sections, fixtures.for_text(records)


def _read_back(spark, path):
    """Records by the number in their section's name, as files may hold sections in another order."""
    _, records = net_text.read_nets(spark, path, WIDE)
    net = F.regexp_extract("reference_name", "[0-9]+", 0).cast("int").alias("net_id")
    return records.select(net, "pos", "depth", "kind", "reference_start", F.col("chain_id").cast("long").alias("chain_id"))


@query(f"{NET} {FILE_ROWS}")
def file_round_trip(spark, sf_dir):
    """One plain file, put together by a task, and read again."""
    path = f"{_folder(spark)}/all.net"
    writer.write_net_file(*_nets(spark, sf_dir), path)
    return _read_back(spark, path)


@query(f"{NET} {FILE_ROWS}")
def gzip_content_round_trip(spark, sf_dir):
    """One gzip file without the ending, found by its content and inflated member after member."""
    path = f"{_folder(spark)}/all.net"
    writer.write_net_file(*_nets(spark, sf_dir), path, gzip=True)
    return _read_back(spark, path)


@query(f"{NET} {FILE_ROWS}")
def parts_round_trip(spark, sf_dir):
    """Text parts in order, read as one file after the other."""
    path = _folder(spark)
    writer.write_nets(*_nets(spark, sf_dir), path)
    lines = net_text.read_lines(spark, [path])
    # The parts are one text: a section may go on in the next part.
    joined = lines.select(F.lit(0).alias("file_id"), (F.col("file_id") * 1_000_000 + F.dense_rank().over(Window.partitionBy("file_id").orderBy("part"))).cast("long").alias("part"), "place", "value")
    _, records, _ = net_text.parse(joined, WIDE)
    net = F.regexp_extract("reference_name", "[0-9]+", 0).cast("int").alias("net_id")
    return records.select(net, "pos", "depth", "kind", "reference_start", F.col("chain_id").cast("long").alias("chain_id"))


@query(f"{LINES} SELECT 'chr' || net_id || '.net' AS file, CAST(count(*) AS BIGINT) AS lines, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM line GROUP BY net_id")
def split_files(spark, sf_dir):
    """A file for each section, put together by tasks, and read again."""
    folder = _folder(spark)
    writer.split(*_nets(spark, sf_dir), folder)
    rows = spark.read.text(f"{folder}/*.net").select(F.col("_metadata.file_path").alias("path"), "value")
    rows = rows.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value") + 1).cast("long").alias("bytes"))
    return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "lines", "bytes")


@query(f"{NET} SELECT pos, depth, kind, reference_start, chain_id FROM net WHERE net_id = 6")
def section_by_bytes(spark, sf_dir):
    """One section of a file, of which the index tells the bytes."""
    path = f"{_folder(spark)}/all.net"
    writer.write_net_file(*_nets(spark, sf_dir), path)
    _, records, _ = net_text.read_section(net_text.index_files(spark, [path]), "chr6", WIDE)
    return records.select("pos", "depth", "kind", "reference_start", F.col("chain_id").cast("long").alias("chain_id"))


@query(f"""{NET} SELECT net_id, CAST(-1 AS BIGINT) AS seq, 'start' AS event, CAST(NULL AS INTEGER) AS depth, CAST(NULL AS BIGINT) AS parent FROM sec
UNION ALL SELECT net_id, pos, 'record', depth, parent FROM net UNION ALL SELECT net_id, record_count, 'end', NULL, NULL FROM sec""")
def stream_in_pieces(spark, sf_dir):
    """A net of which pieces arrive one after the other, several in a batch; sections go over from batch to batch."""
    folder = _folder(spark)
    writer.write_nets(*_nets(spark, sf_dir), f"{folder}/parts")
    parts = sorted(spark.read.text(f"{folder}/parts").inputFiles())
    last = len(parts) - 1
    names = spark.createDataFrame([(p, f"{folder}/in/all.{i}{'.end' if i == last else ''}") for i, p in enumerate(parts)], "path string, target string")
    ranges.copy_files(names).collect()  # a row a part
    streaming.stream_sections(spark, f"{folder}/in", f"{folder}/out", f"{folder}/check", files_per_batch=3).awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    return rows.select(F.regexp_extract("reference_name", "[0-9]+", 0).cast("int").alias("net_id"), "seq", "event", "depth", "parent")
