"""Streams equal batches, and the commands run end to end."""

import gzip

from fillgap import cli
from fillgap.sources import net_text
from fillgap.streaming.sections import flat_events, stream_nets
from tests.test_chains import CHAINS
from tests.test_text import NET


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.net").write_bytes(gzip.compress(NET) if i == 1 else NET)
    stream_nets(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check"), files_per_batch=2).awaitTermination(600)
    found = spark.read.parquet(str(tmp_path / "out" / "records")).select("path", "reference_name", "pos", "kind", "depth", "parent", "subtree_end").collect()
    batch = net_text.read_bytes(spark, NET)[1].select("reference_name", "pos", "kind", "depth", "parent", "subtree_end").collect()
    assert len(found) == 3 * len(batch)
    for path in {r["path"] for r in found}:
        assert {tuple(r)[1:] for r in found if r["path"] == path} == {tuple(r) for r in batch}


def test_events(spark):
    sections, records = net_text.read_bytes(spark, NET)
    rows = flat_events(sections, records).orderBy("net_id", "seq").collect()
    assert [r["event"] for r in rows] == ["start"] + ["record"] * 7 + ["end", "start", "end", "start", "record", "end"]


def test_commands(spark, tmp_path, capsys):
    a, b, listed = tmp_path / "a.net", tmp_path / "b.net", tmp_path / "list.txt"
    a.write_bytes(NET)
    b.write_bytes(NET.replace(b"net s3", b"net s10"))
    listed.write_text(f"{a}\n\n  {b}\n")

    def out(*argv, code=0):
        assert cli.run(list(argv), spark) == code
        return capsys.readouterr().out.splitlines()

    assert [x.strip().split()[0] for x in out("filter", "--net", str(a), "--kind", "fill", "--min-score", "8000")] == ["net", "fill", "net", "net", "fill"]
    assert len(out("filter", "--net", str(a), "--chain", "72", "--policy", "retain-ancestors")) == 6
    assert out("view", "--net", str(a), "--reference", "s3", "--flat") == ["s3\t0\t0\tfill\t0\t700\tmid\t11\t661\t75\t-1"]
    assert out("view", "--net", str(a), "--region", "1000-1010", "--max-depth", "2")[:3] == ["net s1 9000", " fill 40 3000 left - 700 2900 id 71 score 88000 ali 2500 qOver 12 type inv", "  gap 900 500 left - 2100 450"]
    for given in (("--nets", f"{a},{b}"), ("--file", str(listed))):
        assert [x for x in out("merge", *given, "--duplicates", "keep-first", "--sort") if x.startswith("net")] == ["net s1 9000", "net s2 120", "net s3 700", "net s10 700"]
    assert cli.run(["merge", "--nets", f"{a},{b}"], spark) == 1 and "s1" in capsys.readouterr().err
    assert "records              8" in out("stats", "--net", str(a))
    assert out("validate", "--net", str(a), "--mode", "compatible", "--tsv") == []
    assert [x for x in out("sort", "--net", str(b), "--records", "reference", "--validate") if x.startswith("net")] == ["net s1 9000", "net s2 120", "net s10 700"]
    assert out("split", "--net", str(a), "--out", str(tmp_path / "s"), "--manifest", str(tmp_path / "m.tsv")) == []
    assert (tmp_path / "m.tsv").read_text().splitlines()[1].split("\t") == ["s1", "9000", f"{tmp_path}/s/s1.net", "7"]
    assert out("sort", "--net", str(a), "--out", str(tmp_path / "sorted.net.gz")) == []
    assert gzip.decompress((tmp_path / "sorted.net.gz").read_bytes()).decode().splitlines()[0] == "net s1 9000"
    assert out("sort", "--net", str(a), "--out", str(tmp_path / "parts"), "--parts") == [] and (tmp_path / "parts").is_dir()
    assert cli.run(["filter", "--net", str(listed)], spark) == 1


def test_net_command(spark, tmp_path, capsys):
    chains, t, q = tmp_path / "c.chain", tmp_path / "t.sizes", tmp_path / "q.sizes"
    chains.write_bytes(CHAINS)
    t.write_text("ref\t2000\n")
    q.write_text("qry\t3000\nalt1\t5000\n")
    base = ["net", "--chains", str(chains), "--reference-sizes", str(t), "--query-sizes", str(q)]
    outs = {x: str(tmp_path / f"{x}.net") for x in ("r", "q", "raw", "rawq")}
    assert cli.run([*base, "--reference-net", outs["r"], "--query-net", outs["q"]], spark) == 0
    assert (tmp_path / "r.net").read_text().splitlines()[:3] == ["##about=made for these tests", "net ref 2000", " fill 400 850 qry - 2150 750 id 31 score 9000 ali 500"]
    assert (tmp_path / "q.net").read_text().splitlines()[1] == "net qry 3000"
    assert cli.run([*base, "--preset", "ccr", "--reference-net", outs["r"], "--raw-net-out", outs["raw"]], spark) == 0
    assert not (tmp_path / "r.net").read_text().startswith("##") and (tmp_path / "raw.net").read_text().startswith("##about")
    assert "id 33" in (tmp_path / "raw.net").read_text() or "id 34" in (tmp_path / "raw.net").read_text()
    assert cli.run([*base, "--reference-net", outs["r"]], spark) == 1 and "--query-net" in capsys.readouterr().err
    assert cli.run([*base, "--reference-only", "--reference-net", outs["r"], "--raw-query-net-out", outs["rawq"]], spark) == 1
    q.write_text("qry\t3000\n")
    assert cli.run([*base, "--reference-only", "--reference-net", outs["r"]], spark) == 1 and "MissingSequence" in capsys.readouterr().err
