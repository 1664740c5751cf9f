"""Reads of byte ranges, streamed gzip, files put together by tasks, nets that arrive in pieces, and ids of 64 bits."""

import gzip
import io
import random
import struct

from pyspark.sql import functions as F

from fillgap import cli
from fillgap.operators import chain, interval
from fillgap.sources import net_text, ranges, sizes, writer
from fillgap.streaming import sections as streaming
from tests.test_text import NET


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    def __init__(self, data):
        super().__init__(data)
        self.count = 0

    def read(self, n=-1):
        data = super().read(n)
        self.count += len(data)
        return data


def test_lines_of_pieces():
    """Every line belongs to the piece in which it begins, wherever pieces are cut, and little more than the piece is read."""
    r = random.Random(1)
    lines = [bytes(r.choice(b"ab\xff ") for _ in range(r.choice([0, 1, 5, 40, 9_000]))) for _ in range(60)]
    for end in (b"\n", b""):
        data = b"\n".join(lines) + end
        place, expected = 0, []
        for x in lines:
            expected.append((place, x))
            place += len(x) + 1
        expected = expected if end or lines[-1] else expected[:-1]
        for piece in (1, 7, 1_000, 1 << 20):
            found = []
            for start in range(0, len(data), piece):
                stop = min(start + piece, len(data))
                file = Counted(data)
                own = list(ranges._lines_in(file, start, stop, start == 0))
                assert file.count <= piece + 1 + 4_096 + 9_001
                found += own
            assert found == expected


def test_one_section_by_its_bytes(spark, tmp_path):
    big = b"".join(b"net c%d 900000\n" % i + b"".join(b" fill %d 10 q + %d 10 id %d\n" % (k * 20, k, k + 1) for k in range(400)) for i in range(30))
    for name, data in (("a.net", NET), ("b b.net", big), ("c.net.gz", gzip.compress(big.replace(b"net c", b"net z"))), ("d.net", gzip.compress(big.replace(b"net c", b"net y")))):
        (tmp_path / name).write_bytes(data)
    index = net_text.index_files(spark, [str(tmp_path)])
    index.write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == 3 + 90
    at = index.where("reference_name = 'c17'").first()
    span = spark.createDataFrame([(0, at["path"], at["byte_start"], at["byte_end"])], "file_id int, path string, byte_start long, byte_end long")
    read = ranges.range_lines(span, 1_000)
    assert read.agg(F.sum(F.octet_length("value") + 1)).first()[0] == at["byte_end"] - at["byte_start"] < len(big) / 20 and read.select("part").distinct().count() > 5
    for name in ("c17", "z17", "y17", "s3"):
        sections, records, errors = net_text.read_section(index, name)
        assert [r["reference_name"] for r in sections.collect()] == [name] and records.count() == (1 if name == "s3" else 400) and errors.count() == 0


def test_twobit_larger_than_two_gigabytes(spark, tmp_path):
    """A sparse file of 5 GB with offsets of 64 bits: its index and four bytes a sequence are read."""
    names = [f"chr{i}" for i in range(500)]
    start = 16 + sum(1 + len(n) + 8 for n in names)
    at = {n: start + i * 10_000_000 for i, n in enumerate(names)}
    index = b"".join(bytes([len(n)]) + n.encode() + struct.pack(">Q", at[n]) for n in names)
    head = struct.pack(">IIII", 0x1A412743, 1, len(names), 0) + index
    with open(tmp_path / "g.2bit", "wb") as file:
        file.write(head)
        for i, n in enumerate(names):
            file.seek(at[n])
            file.write(struct.pack(">I", 1_000 + i))
        file.truncate(5_000_000_000)
    found = sizes.from_twobit(spark, "reference", str(tmp_path / "g.2bit")).orderBy("ordinal").collect()
    assert [(r["name"], r["size"]) for r in found] == [(n, 1_000 + i) for i, n in enumerate(names)]
    file = Counted(head + bytes(1 << 20))
    assert len(list(sizes.twobit_entries(file, 512))) == 500 and file.count <= len(head) + 512


def test_gzip_by_content(spark, tmp_path):
    """Members, bytes that are not UTF-8, padding, a last line without its end, and files that break off."""
    data = b"".join(b"# \xff\xfe line %d\n" % i for i in range(50_000)) + b"net x 5"
    packed = gzip.compress(data[:100_001]) + gzip.compress(b"") + gzip.compress(data[100_001:]) + b"\0" * 500
    (tmp_path / "a.net").write_bytes(packed)
    (tmp_path / "b.net.gz").write_bytes(gzip.compress(data))
    hidden, named = (net_text.read_lines(spark, [str(tmp_path / n)]).select(F.hex("value").alias("x"), F.row_number().over(streaming_order()).alias("n")) for n in ("a.net", "b.net.gz"))
    assert hidden.count() == 50_001 and hidden.exceptAll(named).isEmpty()
    assert max(map(len, ranges.inflated(io.BytesIO(gzip.compress(bytes(300 << 20)))))) <= 4 << 20  # 300 MB from 300 kB
    try:
        list(ranges.inflated(io.BytesIO(packed[:5_000])))
        raise AssertionError("a broken file was read")
    except EOFError:
        pass


def streaming_order():
    from pyspark.sql.window import Window

    return Window.partitionBy("file_id").orderBy("part", "place")


def test_files_put_together_by_tasks(spark, tmp_path, monkeypatch):
    """The driver copies no byte: 300 sections become files in executors."""
    monkeypatch.setattr(writer, "_join_parts", None)
    text = b"".join(b"net n%d 900\n fill %d 10 q + 0 10\n" % (i, i) for i in range(300))
    made = net_text.read_bytes(spark, text)
    writer.write_net_file(*made, str(tmp_path / "one.net"))
    assert (tmp_path / "one.net").read_bytes() == text
    manifest = writer.split(*made, str(tmp_path / "s")).collect()
    assert len(manifest) == 300 and (tmp_path / "s" / "n7.net").read_text() == "net n7 900\n fill 7 10 q + 0 10\n"
    assert len(list((tmp_path / "s").iterdir())) == 300


def test_a_stream_in_pieces(spark, tmp_path):
    """Sections that go on in later batches come out once, also when the query stops in between and pieces come late."""
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    cuts = [0, 30, 95, 96, 200, len(NET)]
    pieces = [NET[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]

    def arrive(net, *numbers):
        for n in numbers:
            (tmp_path / "in" / f"{net}.{n}{'.end' if n == len(pieces) - 1 else ''}").write_bytes(pieces[n])
        streaming.stream_sections(spark, folder, out, check, files_per_batch=1).awaitTermination(600)
        return spark.read.parquet(out).where(F.col("file") == net)

    assert arrive("a", 0).where("event = 'end'").count() == 0
    arrive("a", 1, 3)  # the third waits for the second
    arrive("b", 0, 1, 2, 3, 4)
    arrive("a", 2)
    sections, records = net_text.read_bytes(spark, NET)
    expected = [tuple(r) for r in streaming.flat_events(sections, records).orderBy("net_id", "seq").select("net_id", "seq", "event", "reference_name", "depth").collect()]
    parents = [tuple(r) for r in records.orderBy("net_id", "pos").select("net_id", "pos", "parent").collect()]
    for net in "ab":
        found = arrive("a", 4) if net == "a" else spark.read.parquet(out).where("file = 'b'")
        rows = found.orderBy("net_id", "seq").collect()
        assert [(r["net_id"], r["seq"], r["event"], r["reference_name"], r["depth"]) for r in rows] == expected
        assert [(r["net_id"], r["seq"], r["parent"]) for r in rows if r["event"] == "record"] == parents


def test_a_stream_holds_open_records_only():
    at = streaming.OpenFile("f", None)
    for n in range(200):
        at.take([(n, "net a 9\n" * (n == 0) + " fill 1 2 q + 3 4\n  gap 1 1 q + 3 1\n" * 50, False)])
        at = streaming.OpenFile("f", at.state())
    assert at.pos == 20_000 and len(at.indents) == 2 and len(str(at.state())) < 300
    at.take([(0, "again", False), (201, "x", False)])
    assert at.pos == 20_000 and len(at.waiting) == 1 and not at.rows
    bad = streaming.OpenFile("f", None)
    bad.take([(0, " fill 1 2 q + 3 4\nnet\n", True)])
    assert [(r[3], r[8]) for r in bad.rows] == [("error", 1), ("error", 2), ("end", 2)]


def test_ids_of_64_bits(spark, tmp_path, capsys):
    """Ids of 2^63 and 2^64 - 1 go from chain text to the nets of both sides."""
    ids = (1 << 63, (1 << 64) - 1, (1 << 63) - 1, 0)
    back = spark.createDataFrame([(str(i),) for i in ids], "i string").select(chain.unsigned_id(chain.signed_id(F.col("i").cast(chain.UNSIGNED))).cast("string").alias("i"))
    assert {r["i"] for r in back.collect()} == {str(i) for i in ids}
    (tmp_path / "c").write_text(f"chain 9000 t 1000 + 0 400 q 1000 + 0 400 {ids[1]}\n400\n\nchain 8000 t 1000 + 500 900 q 1000 - 0 400 {ids[0]}\n400\n\n")
    (tmp_path / "t").write_text("t 1000\n")
    (tmp_path / "q").write_text("q 1000\n")
    at = {n: str(tmp_path / n) for n in ("c", "t", "q", "r.net", "q.net")}
    assert cli.run(["net", "--chains", at["c"], "--reference-sizes", at["t"], "--query-sizes", at["q"], "--reference-net", at["r.net"], "--query-net", at["q.net"]], spark) == 0
    for name in ("r.net", "q.net"):
        found = (tmp_path / name).read_text()
        assert f"id {ids[0]} " in found and f"id {ids[1]} " in found


def test_intervals_of_all_lengths(spark):
    """Long and short intervals make a row for each level at most, dense bins are dealt, and pairs meet once."""
    r = random.Random(2)
    def some(n, first):
        out = []
        for i in range(n):
            start = r.choice([r.randrange(0, 4 * 10**9), r.randrange(0, 40_000), 1 << 20])
            out.append((first + i, r.randrange(2), start, min(start + r.choice([0, 1, 50, 20_000, 10**8, 3 * 10**9]), (1 << 32) - 1)))
        return out
    left, right = some(400, 0), some(300, 1_000)
    records = spark.createDataFrame([(n, i, s, e) for i, n, s, e in left], "net_id int, pos int, reference_start long, reference_end long")
    probes = spark.createDataFrame([(i, n, s, e) for i, n, s, e in right], "probe_id int, net_id int, other_start long, other_end long")
    met = {(b[0], a[0]) for a in left for b in right if a[1] == b[1] and a[2] < b[3] and b[2] < a[3]}
    held = {(b[0], a[0]) for a in left for b in right if a[1] == b[1] and a[2] <= b[2] and b[3] <= a[3]}
    for dense in (None, 10):
        for found, expected in ((interval.overlapping(records, probes, small=0, dense=dense), met), (interval.containing(records, probes, small=0, dense=dense), held)):
            pairs = [(x["probe_id"], x["pos"]) for x in found.collect()]
            assert len(pairs) == len(set(pairs)) and set(pairs) == expected
    rows = records.select("net_id", "pos", F.col("reference_start").alias("start"), F.col("reference_end").alias("end"))
    near = interval.any_overlap_where(rows, probes, lambda: F.col("probe_id") % 3 == 0, small=0, dense=10)
    assert sorted(x["pos"] for x in near.collect()) == sorted({a for b, a in met if b % 3 == 0})
    binned = interval._in_bins(rows, "start", "end", "own")
    assert binned.count() <= 400 * interval.LEVELS and binned.where("own").count() == 400


def test_bins_take_one_row_of_each_record_where_probes_are_short(spark, monkeypatch):
    """Short probes ask for the bins of all levels, so records are a row each; long probes are asked for, and no pair is lost or met twice."""
    taken = []
    dealt = interval._dealt_join
    monkeypatch.setattr(interval, "_dealt_join", lambda a, *rest: taken.append(a.count()) or dealt(a, *rest))
    records = [(1, i, i * 997, i * 997 + (1 << i % 20)) for i in range(300)]
    rows = spark.createDataFrame(records, "net_id int, pos long, reference_start long, reference_end long")
    for sizes, wide in (((1, 30, 20_000), False), ((1, 30, 400_000, 1 << 31), True)):
        probes = [(k, 1, k * 1_201, k * 1_201 + sizes[k % len(sizes)]) for k in range(200)]
        taken.clear()
        found = interval.overlapping(rows, spark.createDataFrame(probes, "probe_id int, net_id int, other_start long, other_end long"), small=0)
        expected = sorted((k, p) for k, _, s, e in probes for _, p, a, b in records if a < e and s < b)
        assert sorted((r["probe_id"], r["pos"]) for r in found.collect()) == expected
        assert taken[0] == len(records) and (len(taken) == 2) == wide
