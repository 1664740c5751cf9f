"""The reader in small chunks of lines against a plain stack, and how much of the text it moves."""

import random

import numpy as np
from pyspark.sql import functions as F

from fillgap.sources import nesting, net_text, writer


def _text(seed, sections=4, n=30):
    rng, lines = random.Random(seed), []
    for s in range(sections):
        lines.append(f"net chr{s} 1000000")
        width = 1
        for i in range(rng.randrange(n)):
            width = max(1, width + rng.choice((-3, -2, -1, 0, 0, 1, 2)))
            lines.append(rng.choice(("", "", "", "# note\n")) + " " * width + f"fill {i} 1 q + 0 1 id {i}" + rng.choice(("", " odd", "\r")))
    return "\n".join(lines).encode()


def _plain(data):
    """(net_id, line_no, pos, parent, subtree_end, depth) by a stack over all lines."""
    out, net, pos, stack = [], -1, 0, []
    for k, line in enumerate(data.decode().split("\n")):
        if line.startswith("net"):
            net, pos, stack = net + 1, 0, []
        elif line.strip() and not line.startswith("#") and not line.endswith("odd"):
            width = len(line) - len(line.lstrip(" "))
            while stack and stack[-1][0] >= width:
                stack.pop()
            out.append([net, k + 1, pos, stack[-1][1] if stack else None, pos + 1, len(stack)])
            stack.append((width, pos, out[-1]))
            pos += 1
            for _, _, above in stack[:-1]:
                above[4] = pos
    return sorted(map(tuple, out), key=lambda r: r[1])


def test_chunks_of_lines(spark, monkeypatch):
    data = _text(5)
    for chunk in (1, 3, 1 << 16):
        monkeypatch.setattr(nesting, "CHUNK", chunk)
        monkeypatch.setattr(net_text, "CHUNK", chunk)
        _, records, errors = net_text.parse(net_text.lines_of(spark, [data]), net_text.ReaderOptions(mode=net_text.PERMISSIVE))
        rows = sorted((r["net_id"], r["pos"], r["parent"], r["subtree_end"], r["depth"]) for r in records.collect())
        assert rows == sorted((n, p, u, e, d) for n, _, p, u, e, d in _plain(data))
        lines = data.decode().split("\n")
        assert sorted(r["line_no"] for r in errors.collect()) == [k + 1 for k, x in enumerate(lines) if x.endswith("odd")]
        starts = {r["line_no"]: r["byte_start"] for r in net_text.numbered(net_text.lines_of(spark, [data])).collect()}
        assert starts == {k + 1: sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))}


def _shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")()).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


def test_text_moves_once(spark):
    """Names that don't compress are written to a shuffle once by the parser, and never by the index."""
    name = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{k}")), 256) for k in range(16)])
    body = spark.range(2_000).select(F.lit(0).alias("file_id"), F.lit(0).cast("long").alias("part"), (F.col("id") + 1).alias("place"), F.concat(F.lit(" fill 1 1 "), name, F.lit(" + 0 1")).alias("value"))
    lines = spark.createDataFrame([(0, 0, 0, "net chr1 100")], body.schema).union(body)
    size = 2_000 * 1_024
    for ask, most in ((lambda: net_text.parse(lines)[1], 1.3), (lambda: net_text.section_index(lines), 0.1)):
        before = _shuffled(spark)
        assert ask().count() > 0
        assert _shuffled(spark) - before < most * size


def test_two_places_stay_in_spark(spark):
    values = [0.1, -12.5, 1234.56, 0.07, 1e-7, 123456789012.34, 0.30000000000000004, 2.5e11, 1e22, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(writer.number_text(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in rows] == [writer._shortest(__import__("pandas").Series([v]))[0].removesuffix(".0") if v is not None else None for v in values]


def test_arrays_walk_as_a_stack_does():
    """Chunks by arrays against a stack, with what is open before them, records with errors and headers anywhere."""
    r = random.Random(3)
    for _ in range(3_000):
        n, inside, stack, frame = r.randrange(14), r.random() < 0.8, [], (0, -1, 0, 0)
        marks, indents = (np.array([r.choice(c) for _ in range(n)], np.int64) for c in ((0, 1, 2, 2, 2, 2, 3), range(5)))
        for _ in range(r.randrange(4) if inside else 0):
            width = frame[0] + r.randrange(1, 3)
            frame = (width, frame[1] + r.randrange(1, 3), width + r.randrange(2), frame[3] + r.randrange(1, 3))
            stack.append(frame)
        base = frame[3] + r.randrange(3)
        found, left, pos = nesting.walk(marks, indents, list(stack), frame[1] + 1, inside, base)
        expected, open_, count = nesting._stacked(marks.tolist(), indents.tolist(), list(stack), frame[1] + 1, inside, base)
        assert all((found[c] == expected[c]).all() for c in nesting.NAMES) and (left, pos) == (open_, count)


def test_lines_of_one_task_are_dealt(spark, monkeypatch):
    """Chunks of a file that one task reads are several tasks' work."""
    monkeypatch.setattr(nesting, "CHUNK", 10)
    lines = net_text.lines_of(spark, [_text(5)]).coalesce(1)
    plan = nesting.nested_lines(lines.select("file_id", "part", "place", F.lit(2).alias("mark"), F.lit(1).alias("indent"), F.lit(1).alias("bytes")), [])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(file_id" in plan


def test_signs_and_fields_of_plain_lines(spark):
    text = b"net chr1 9\n fill 0 9 score + 1 2 score -1.50 ali 7 tN -3 a score\n  gap 007 1 id - 0 1 tN +3 a b c d\n fill 3 4 q + 5 6 id 18 id 19\n"
    rows = net_text.parse(net_text.lines_of(spark, [text]), net_text.ReaderOptions(mode=net_text.PERMISSIVE))[1].orderBy("pos").collect()
    assert [(r["query_name"], r["reference_start"], r["chain_id"] and int(r["chain_id"]), r["alignment_score"], r["aligned_bases"], r["reference_unsequenced"], [tuple(x) for x in r["extras"]]) for r in rows] == [
        ("score", 0, None, -1.5, 7, -3, [("a", "score")]), ("id", 7, None, None, None, 3, [("a", "b"), ("c", "d")]), ("q", 3, 19, None, None, None, []),
    ]
