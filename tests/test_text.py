"""Reading and writing net text."""

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from fillgap.operators import predicates, stats, tree, validate
from fillgap.sources import net_text, sizes, writer
from fillgap.sources.net_text import NetParseError, ReaderOptions
from fillgap.streaming.sections import pull_sections

NET = b"""## a file for tests

net s1 9000
 fill 40 3000 left - 700 2900 id 71 score 88000 ali 2500 qOver 12 type inv
  gap 300 60 left - 3200 10 tN 7 tR 0
  gap 900 500 left - 2100 450
   fill 950 200 right + 40 190 id 72 score 33.25 ali 150 type nonSyn
    gap 1000 30 right + 90 25
   # between records
   fill 1250 100 right + 300 100 id 73 score 1200 ali 90 qFar -33 qDup 0 zz top yy 5
 fill 5000 10 mid + 0 10 id 74 score 5 ali 9
net s2 120
net s3 700
 fill 0 700 mid + 11 650 id 75 score 61000 ali 640 type syn
"""


def text_of(sections, records):
    return "".join(r["text"] for r in writer.section_text(sections, records).orderBy("net_id").collect())


def lines_of(text):
    return [x for x in text.decode().split("\n") if x.strip() and not x.strip().startswith("#")]


def test_fields(spark):
    sections, records = net_text.read_bytes(spark, NET)
    found = sections.orderBy("net_id").select("reference_name", "section_size", "record_count", "root_count", "byte_start").collect()
    assert [tuple(r)[:4] for r in found] == [("s1", 9000, 7, 2), ("s2", 120, 0, 0), ("s3", 700, 1, 1)]
    assert [r["byte_start"] for r in found] == [NET.index(b"net s%d" % i) for i in (1, 2, 3)]
    rows = records.orderBy("net_id", "pos").collect()
    assert [r["depth"] for r in rows] == [0, 1, 1, 2, 3, 2, 0, 0]
    assert [r["parent"] for r in rows] == [None, 0, 0, 2, 3, 2, None, None]
    assert [r["subtree_end"] for r in rows] == [6, 2, 6, 5, 5, 6, 7, 1]
    assert rows[3]["alignment_score"] == 33.25 and rows[5]["query_far"] == -33 and rows[5]["query_dup"] == 0 and rows[0]["query_dup"] is None
    assert [tuple(x) for x in rows[5]["extras"]] == [("zz", "top"), ("yy", "5")]
    counts = records.select(predicates.presence_count().alias("n"), predicates.presence_mask().alias("m"), "net_id", "pos").orderBy("net_id", "pos").collect()
    assert [r["n"] for r in counts] == [5, 2, 0, 4, 0, 5, 3, 4] and counts[1]["m"] == (1 << 7) + (1 << 9)


def test_round_trip(spark):
    once = text_of(*net_text.read_bytes(spark, NET))
    assert once.split("\n")[:-1] == [x.replace("qOver 12 type inv", "qOver 12 type inv") for x in lines_of(NET)]
    assert text_of(*net_text.read_bytes(spark, once.encode())) == once


def test_tolerated(spark):
    crlf = NET.replace(b"\n", b"\r\n").rstrip(b"\r\n")
    assert text_of(*net_text.read_bytes(spark, crlf)) == text_of(*net_text.read_bytes(spark, NET))
    members = gzip.compress(NET[:200]) + gzip.compress(NET[200:])
    assert text_of(*net_text.read_bytes(spark, members)) == text_of(*net_text.read_bytes(spark, NET))
    sections, records = net_text.read_bytes(spark, b"# nothing here\n")
    assert sections.count() == 0 and records.count() == 0
    wide = b"".join(b" " * (3 * (len(x) - len(x.lstrip(b" ")))) + x.lstrip(b" ") for x in NET.splitlines(keepends=True))
    assert [r["depth"] for r in net_text.read_bytes(spark, wide)[1].orderBy("net_id", "pos").collect()] == [0, 1, 1, 2, 3, 2, 0, 0]


def test_very_many_widths(spark):
    text = b"net a 100000\n" + b"".join(b" " * (w + 1) + b"fill %d 1 q + 1 1\n" % w for w in range(90)) + b"".join(b" " * (w + 1) + b"gap %d 1 q + 1 1\n" % w for w in (40, 0, 70))
    rows = net_text.read_bytes(spark, text)[1].orderBy("pos").collect()
    assert [r["parent"] for r in rows] == [None, *range(89), 39, None, 91] and [r["depth"] for r in rows] == [*range(90), 40, 0, 1]
    assert rows[39]["subtree_end"] == 91 and rows[40]["subtree_end"] == 90


def test_roots_over_the_edges_of_chunks(spark, monkeypatch):
    expected = {n: [tuple(r) for r in net_text.read_bytes(spark, NET)[1].orderBy("net_id", "pos").select("net_id", "pos", "depth", "parent", "subtree_end").collect()] for n in (1,)}[1]
    monkeypatch.setattr(tree, "CHUNK", 2)
    records = net_text.read_bytes(spark, NET)[1]
    assert [tuple(r) for r in records.orderBy("net_id", "pos").select("net_id", "pos", "depth", "parent", "subtree_end").collect()] == expected
    near = {(r["net_id"], r["pos"]): (r["previous_sibling"], r["next_sibling"]) for r in tree.siblings(records).collect()}
    assert near == {(0, 0): (None, 6), (0, 1): (None, 2), (0, 2): (1, None), (0, 3): (None, 5), (0, 4): (None, None), (0, 5): (3, None), (0, 6): (0, None), (2, 0): (None, None)}


def test_files(spark, tmp_path):
    plain, packed, hidden = tmp_path / "a b.net", tmp_path / "b.net.gz", tmp_path / "c.net"
    plain.write_bytes(NET)
    packed.write_bytes(gzip.compress(NET))
    hidden.write_bytes(gzip.compress(NET))
    expected = text_of(*net_text.read_bytes(spark, NET))
    for path in (plain, packed, hidden):
        assert text_of(*net_text.read_nets(spark, str(path))) == expected
    sections, records = net_text.read_nets(spark, str(plain))
    writer.write_nets(sections, records, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == expected


def test_one_name_in_two_folders(spark, tmp_path):
    """Files are told apart by their whole paths, and keep the order in which they are given."""
    for folder, data in (("a", NET), ("b", gzip.compress(NET.replace(b"s1", b"t1")))):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.net").write_bytes(data)
    for order in (("a", "b"), ("b", "a")):
        sections, records = net_text.read_nets(spark, [str(tmp_path / f / "x.net") for f in order])
        names = [r["reference_name"] for r in sections.orderBy("file_id", "net_id").collect()]
        assert names == [n for f in order for n in (("s1" if f == "a" else "t1"), "s2", "s3")] and records.count() == 16
    assert net_text.read_nets(spark, str(tmp_path / "*"))[0].count() == 6


def test_one_file(spark, tmp_path):
    sections, records = net_text.read_bytes(spark, NET)
    expected = text_of(sections, records)
    writer.write_net_file(sections, records, str(tmp_path / "one.net"), metadata=["##m"])
    writer.write_net_file(sections, records, str(tmp_path / "one.net.gz"))
    assert (tmp_path / "one.net").read_text() == "##m\n" + expected and gzip.decompress((tmp_path / "one.net.gz").read_bytes()).decode() == expected
    writer.write_net_file(*net_text.first_section(sections, records), str(tmp_path / "one.net"))
    assert (tmp_path / "one.net").read_text() == expected[: expected.index("net s2")]
    assert not [p for p in tmp_path.iterdir() if "parts" in p.name]


def test_split(spark, tmp_path):
    text = NET.replace(b"net s2 120", b"net a/b 120").replace(b"net s3 700", b"net a?b 700") + b"net a_b.1 5\nnet a_b 6\nnet a_b 7\n"
    sections, records = net_text.read_bytes(spark, text)
    manifest = writer.split(sections, records, str(tmp_path / "s"), gzip=False).orderBy("net_id").collect()
    assert [(r["reference_name"], r["file"], r["records"]) for r in manifest] == [
        ("s1", "s1.net", 7), ("a/b", "a_b.net", 0), ("a?b", "a_b.1.net", 1), ("a_b.1", "a_b.1.1.net", 0), ("a_b", "a_b.2.net", 0), ("a_b", "a_b.3.net", 0),
    ]
    assert (tmp_path / "s" / "a_b.1.net").read_text().startswith("net a?b 700\n fill 0 700") and (tmp_path / "s" / "a_b.3.net").read_text() == "net a_b 7\n"
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.suffix == ".net") == sorted(r["file"] for r in manifest)
    writer.split(sections, records, str(tmp_path / "z"), gzip=True)
    assert gzip.decompress((tmp_path / "z" / "s1.net.gz").read_bytes()).decode().startswith("net s1 9000\n fill 40")


def test_index_of_headers(spark):
    lines = net_text.lines_of(spark, [NET])
    index = net_text.section_index(lines).orderBy("net_id").collect()
    for r in index:
        assert NET[r["byte_start"] : r["byte_end"]].decode().startswith(f"net {r['reference_name']} {r['section_size']}\n")
    assert index[-1]["byte_end"] == len(NET) and [r["byte_end"] for r in index[:-1]] == [r["byte_start"] for r in index[1:]]
    one = net_text.section_lines(lines, net_text.section_index(lines), "s3").orderBy("line_no").collect()
    assert [r["text"] for r in one] == lines_of(NET)[-2:]
    # Records are not looked at
    assert net_text.section_index(net_text.lines_of(spark, [b"net a 5\n fill oops\n"])).count() == 1
    with pytest.raises(NetParseError):
        net_text.section_index(net_text.lines_of(spark, [b"net a\n"]))


HEAD = b"net c 1000\n"
ONE = b" fill 1 2 q + 1 2"


#: text, kind, line, column, section, context
MALFORMED = [
    (ONE, "MissingNetHeader", 1, 2, None, "fill 1 2 q + 1 2"),
    (b"net c\n", "InvalidNetHeader", 1, 6, None, ""),
    (b"net c  x\n", "InvalidNetHeader", 1, 8, None, "x"),
    (HEAD + ONE + b"\nnet d 99999999999\n", "InvalidNetHeader", 3, 7, None, "99999999999"),
    (b"network c 5\n", "MissingNetHeader", 1, 1, None, "network c 5"),
    (HEAD + b" file 1 2 q + 1 2\n", "InvalidRecordKind", 2, 2, "c", "file"),
    (HEAD + b" fill 1 2 q + 1\n", "TooFewFields", 2, 16, "c", ""),
    (HEAD + b" fill 1 2 q x 1 2\n", "InvalidStrand", 2, 13, "c", "x"),
    (HEAD + b" fill 99999999999x 2 q + 1 2\n", "NumericOverflow", 2, 7, "c", "99999999999x"),
    (HEAD + b" fill 1   12x q + 1 2\n", "InvalidInteger", 2, 11, "c", "12x"),
    (HEAD + b" fill 1 2 q + 1 -2\n", "InvalidInteger", 2, 17, "c", "-2"),
    (HEAD + b" fill 4294967295 2 q + 1 2\n", "CoordinateOverflow", 2, 2, "c", ""),
    (HEAD + b"\tfill 1 2 q + 1 2\n", "TabIndentation", 2, 1, "c", ""),
    (HEAD + ONE + b" id\n", "OddAttributeCount", 2, 19, "c", "id"),
    (HEAD + ONE + b" id 5 x\n", "OddAttributeCount", 2, 24, "c", "x"),
    (HEAD + ONE + b" id x\n", "InvalidInteger", 2, 22, "c", "x"),
    (HEAD + ONE + b" tN 3 qN 3000000000 odd\n", "NumericOverflow", 2, 27, "c", "3000000000"),
    (HEAD + ONE + b" ali 1 score nan\n", "InvalidFloat", 2, 31, "c", "nan"),
    (HEAD + ONE + b" id 1 id 2\n", "DuplicateAttribute", 2, 24, "c", "id"),
    (HEAD + ONE + b"\nnet d 5\n fill 0 1 q + 0 1\n  gap 1 1 q + 1 1\n   fill 1 1 q + 1 1\n  gap 1 1 q + 1 1\n    gap 1 1 q + 1 1\n   gap 1 1 q + 1 1\n", "IndentationJump", 9, 1, "d", ""),
    (HEAD + ONE + b"\n   fill z 2 q + 1 2\n fill y 2 q + 1 2\n", "InvalidInteger", 3, 9, "c", "z"),
]


def test_malformed(spark):
    """Each text is a file of its own; its first error counts."""
    _, _, errors = net_text.parse(net_text.lines_of(spark, [m[0] for m in MALFORMED]))
    first = {}
    for e in errors.orderBy("file_id", "offset").collect():
        first.setdefault(e["file_id"], e)
    for i, (text, kind, line, column, section, context) in enumerate(MALFORMED):
        e = first[i]
        assert (e["kind"], e["line_no"], e["column"], e["section"], e["context"]) == (kind, line, column, section, context), text
        assert e["offset"] == sum(len(x) + 1 for x in text.split(b"\n")[: line - 1]) + column - 1


def test_the_first_error_is_raised(spark):
    with pytest.raises(NetParseError) as e:
        net_text.read_bytes(spark, HEAD + ONE + b"\n   fill z 2 q + 1 2\n fill y 2 q + 1 2\n")
    assert (e.value.kind, e.value.line, e.value.column, e.value.offset, e.value.section, e.value.context) == ("InvalidInteger", 3, 9, len(HEAD) + len(ONE) + 1 + 8, "c", "z")
    for empty in (b"", b"  \n\t\n"):
        with pytest.raises(NetParseError, match="EmptyInput"):
            net_text.read_bytes(spark, empty)


def first_errors(spark, texts, options):
    _, records, errors = net_text.parse(net_text.lines_of(spark, texts), options)
    first = {}
    for e in errors.orderBy("file_id", "offset").collect():
        first.setdefault(e["file_id"], (e["kind"], e["column"]))
    counts = {r["file_id"]: r["count"] for r in records.groupBy("file_id").count().collect()}
    return [first.get(i) for i in range(len(texts))], [counts.get(i, 0) for i in range(len(texts))]


def test_modes(spark):
    cases = (
        (HEAD + ONE + b" id 1 foo 3\n", "UnknownAttribute", 24), (HEAD + ONE + b" id 1 type odd\n", "UnknownNetType", 29), (HEAD + b" gap 1 2 q + 1 2\n", "StructuralViolation", 2), (HEAD + b"   fill 1 2 q + 1 2 id 4\n", "InvalidIndentation", 1),
        (HEAD + ONE + b" id 1\n    gap 1 2 q + 1 2\n", "InvalidIndentation", 1), (HEAD + ONE + b"\n", "StructuralViolation", 2),
        (HEAD + ONE + b" id 1\n  gap 1 2 q + 1 2\n   gap 1 2 q + 1 2\n", "StructuralViolation", 4), (HEAD + ONE + b" id 1\n  fill 1 2 q + 1 2 id 2\n", "StructuralViolation", 3),
        (HEAD + ONE + b" id 1\n  gap 1 2 q + 1 2\n   fill 1 2 q + 1 2 id 1\n  gap 1 2 q + 1 2\n fill 1 2 q + 1 2 id 3\n", None, 0),
    )
    texts = [c[0] for c in cases]
    assert first_errors(spark, texts, ReaderOptions(mode="strict"))[0] == [None if k is None else (k, c) for _, k, c in cases]
    assert first_errors(spark, texts, ReaderOptions(mode="permissive")) == ([None] * len(texts), [t.count(b"\n") - 1 for t in texts])
    twice = net_text.read_bytes(spark, HEAD + b"\tfill 1 2 q + 1 2 id 1 id 2\n", ReaderOptions(mode="permissive"))[1].first()
    assert twice["chain_id"] == 2
    deep = HEAD + b"".join(b" " * (i + 1) + b"fill 1 2 q + 1 2\n" for i in range(6))
    long = HEAD + ONE + b" id 123456789\n"
    assert first_errors(spark, [deep, long], ReaderOptions(max_depth=3, max_line_length=24))[0] == [("ExcessiveDepth", 6), ("LineTooLong", 1)]


def test_pulled_sections(spark):
    found = list(pull_sections(net_text.lines_of(spark, [NET])))
    assert [(s.reference_name, s.section_size, [r["pos"] for r in s.records]) for s in found] == [("s1", 9000, list(range(7))), ("s2", 120, []), ("s3", 700, [0])]
    assert list(pull_sections(net_text.lines_of(spark, [b"# nothing\n"]))) == []
    bad = NET.replace(b" fill 0 700 mid + 11", b" fill 0 7oo mid + 11")
    got = []
    with pytest.raises(NetParseError) as e:
        for s in pull_sections(net_text.lines_of(spark, [bad])):
            got.append(s.reference_name)
    assert got == ["s1", "s2"] and (e.value.kind, e.value.line, e.value.offset, e.value.column, e.value.section) == ("InvalidInteger", 2, len("net s3 700\n fill 0 "), 9, "s3")
    with pytest.raises(NetParseError) as e:
        list(pull_sections(net_text.lines_of(spark, [b"# x\n fill 1 2 q + 1 2\nnet a 5\n"])))
    assert (e.value.kind, e.value.line, e.value.offset) == ("MissingNetHeader", 1 - 1, 0)


def test_visitors(spark):
    records = net_text.read_bytes(spark, NET)[1]

    def widest(stop):
        """The deepest open path, and how often records were entered and left, until ``stop`` records were entered."""
        return tree.fold(
            records, lambda: [0, 0, 0, 0], lambda s, r: ([s[0] + 1, s[1], s[2] + 1, max(s[3], s[2] + 1)], s[0] + 1 < stop), lambda s, r: [s[0], s[1] + 1, s[2] - 1, s[3]],
            lambda s: {"entered": s[0], "left": s[1], "deepest": s[3]}, "entered int, left int, deepest int",
        )

    assert {tuple(r) for r in widest(100).collect()} == {(0, 7, 7, 4), (2, 1, 1, 1)}
    assert {tuple(r) for r in widest(3).collect()} == {(0, 3, 1, 2), (2, 1, 1, 1)}


def test_report(spark):
    sections, records = net_text.read_bytes(spark, NET)
    text = stats.report(records, sections).splitlines()
    assert text[0] == "reference nets       3" and "  depth 0            3" in text and "distinct chain ids   5" in text and "types:" in text and "  zz                 1" in text


def test_validation(spark):
    text = b"net c 100\n gap 90 20 q + 1 2 id 5\n  fill 10 5 q + 1 2\n fill 95 0 q + 1 2 id 1 tN -4\n"
    sections, records = net_text.read_bytes(spark, text)
    found = validate.issues(records, sections)
    assert {(r["code"], r["pos"]) for r in found.collect()} == {
        ("reference-out-of-bounds", 0), ("fill-gap-alternation", 0), ("gap-has-id", 0), ("child-outside-parent", 1), ("fill-gap-alternation", 1),
        ("missing-fill-id", 1), ("zero-sized-record", 2), ("negative-count", 2),
    }
    assert validate.issues(records, sections, "syntax").where(F.col("code") == "gap-has-id").count() == 0
    lines = [r["line"] for r in validate.report_lines(found, tsv=False).orderBy("net_id", "anchor", "rule", "pos").collect()]
    assert lines[0] == "[Error] reference-out-of-bounds (net 0, node 0): ends behind its section" and any("reference_unsequenced counts" in x for x in lines)
    assert validate.totals(found) == (1, 7) and validate.exit_status(found) == 1 and validate.exit_status(found.where("severity = 'warning'")) == 0


def test_sizes(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# sizes\nb 20\n\na\t10 extra\n")
    assert [(r["name"], r["size"]) for r in sizes.from_text(spark, "query", str(tmp_path / "s.txt")).orderBy("ordinal").collect()] == [("b", 20), ("a", 10)]
    for order, magic in (("<", 0x1A412743), (">", 0x1A412743)):
        names = [(b"one", 7), (b"two", 123456)]
        at, index, body = 16 + sum(5 + len(n) for n, _ in names), b"", b""
        for n, size in names:
            index += bytes([len(n)]) + n + struct.pack(order + "I", at + len(body))
            body += struct.pack(order + "IIII", size, 0, 0, 0) + bytes(-(-size // 4))
        (tmp_path / "s.2bit").write_bytes(struct.pack(order + "IIII", magic, 0, 2, 0) + index + body)
        assert [(r["name"], r["size"]) for r in sizes.from_twobit(spark, "reference", str(tmp_path / "s.2bit")).orderBy("ordinal").collect()] == [("one", 7), ("two", 123456)]
    with pytest.raises(ValueError, match="twice"):
        sizes.in_memory(spark, "query", [("a", 1), ("a", 2)])
