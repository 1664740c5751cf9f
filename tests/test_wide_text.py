"""Text of tables whose keys make coordinates behind u32: written and read back as in the SQL, and refused by plain readers."""

import gzip
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fillgap import plans
from fillgap.plans import fixtures
from fillgap.sources import net_text, ranges, writer
from fillgap.streaming import sections as streaming
from tests.duck import same
from tests.test_large_keys import shifted  # noqa: F401

WIDE = net_text.ReaderOptions(wide=True)


@pytest.mark.parametrize("name", ["read_records", "read_sections", "read_first_section", "read_errors", "file_round_trip", "gzip_content_round_trip", "parts_round_trip", "section_by_bytes"])
def test_sql(spark, shifted, name):  # noqa: F811
    same(spark, shifted, plans.QUERIES[name], plans.SQL[name])


def test_limits(spark):
    text = b"net chr1 5000000000\n fill 4294967295 1 q + 0 1\n fill %d 1 q + 0 1\n fill %d 0 q + 0 1\n" % ((1 << 62) - 1, 1 << 62)
    kinds = [[r["kind"] for r in net_text.parse(net_text.lines_of(spark, [text]), o)[2].orderBy("line_no").collect()] for o in (net_text.ReaderOptions(), WIDE)]
    assert kinds == [["InvalidNetHeader", "CoordinateOverflow", "NumericOverflow", "NumericOverflow"], ["CoordinateOverflow", "NumericOverflow"]]


def test_members_are_tasks(spark, tmp_path):
    """Members of a gzip file are read by several tasks, lines that go over members come once, and what looks like a header is none."""
    text = b"".join(b"# %d \x1f\x8b\x08 line\n" % i for i in range(2_000)) + b"net x 5"
    inner = gzip.compress(b"inside\n")
    members = [text[:7], b"", text[7:9_000], text[9_000:9_003], text[9_003:20_005], inner + b"\n", text[20_005:]]
    (tmp_path / "a.net").write_bytes(b"".join(gzip.compress(m, 0) + b"\0" * (k % 3) for k, m in enumerate(members)))
    files = spark.createDataFrame([(0, str(tmp_path / "a.net"))], "file_id int, path string")
    rows = ranges.gzip_lines(files, piece=1_000)
    found = rows.withColumn("p", F.spark_partition_id()).orderBy("part", "place").collect()
    assert [r["value"].encode() for r in found] == [x.decode("utf-8", "replace").encode() for x in b"".join(members).split(b"\n")]
    assert len({r["part"] for r in found}) > 2 and len({r["p"] for r in found}) > 1
    (tmp_path / "b.net").write_bytes((tmp_path / "a.net").read_bytes()[:-20])
    with pytest.raises(Exception, match="ends inside a member"):
        ranges.gzip_lines(files.withColumn("path", F.lit(str(tmp_path / "b.net"))), piece=1_000).count()


def test_stream_by_arrays_is_the_stream_by_lines(monkeypatch):
    """Pieces cut anywhere, with headers, comments and faults, give the same events as line after line."""
    r, columns = random.Random(1), [c.split()[0] for c in streaming.STREAMED.split(", ")]

    def events(pieces, few):
        monkeypatch.setattr(streaming, "FEW", few)
        at, rows = streaming.OpenFile("f", None), []
        for n, piece in enumerate(pieces):
            at = streaming.OpenFile("f", at.state())
            at.take([(n, piece, n == len(pieces) - 1)])
            rows += at.rows + [tuple(None if pd.isna(x) else x for x in row) for t in at.tables for row in t[columns].itertuples(index=False)]
        return sorted(rows, key=lambda row: (row[8], row[3] != "end", str(row))), bool(at.tables)

    by_arrays = 0
    for _ in range(100):
        lines = [r.choice(["net c1 9", "net", "net x y", " net a 1", "network", "", "# c", "  # d", " \t", *[" " * r.randrange(1, 5) + "fill 1 2 q + 3 4"] * 20]) + r.choice(["", "", "\r"]) for _ in range(r.randrange(1, 60))]
        text = "\n".join(lines) + r.choice(["", "\n"])
        cuts = sorted(r.randrange(len(text) + 1) for _ in range(r.randrange(4)))
        pieces = [text[a:z] for a, z in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        rows, arrays = events(pieces, 1)
        by_arrays += arrays
        assert rows == events(pieces, 1 << 30)[0]
    assert by_arrays > 20


def test_parts_by_place_need_no_sample(spark, tmp_path, monkeypatch):
    """Lines are in order in parts of a size that the sections' numbers of records tell, and the plan has no range exchange."""
    monkeypatch.setattr(writer, "PART_LINES", 64)
    records, sections, _ = fixtures.net(spark, "/root/testdata/sf0.001")
    lines = writer.with_metadata(writer.text_lines(sections, fixtures.for_text(records)), ["#a", "#b"])
    dealt = writer.in_places(lines, sections, "net_id")
    assert "rangepartitioning" not in dealt._jdf.queryExecution().executedPlan().toString()
    rows = dealt.select("section", "pos", F.spark_partition_id().alias("p")).toLocalIterator()
    found = [(r["section"], r["pos"]) for r in rows]
    assert found == sorted(found) and len(found) == lines.count()
    wrong = writer.in_places(lines, sections.withColumn("record_count", F.lit(3)), "net_id").select("section", "pos").toLocalIterator()
    assert [(r["section"], r["pos"]) for r in wrong] == found
