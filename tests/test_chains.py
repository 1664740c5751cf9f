"""Chains to nets: small cases, all kinds of malformed chains, and random chains against a greedy over single positions."""

import random

import pytest
from pyspark.sql import functions as F

from fillgap.operators import chain, construct
from fillgap.sources import chain_text, net_text, sizes
from fillgap.sources.writer import section_text

CHAINS = b"""##about=made for these tests
chain 9000 ref 2000 + 400 1250 qry 3000 - 100 850 31
250 350 250
250

chain 7000 ref 2000 + 640 1010 alt1 5000 + 2000 2300 32
120 130 60
120

chain 2500 ref 2000 + 700 720 qry 3000 + 10 30 33
20

chain 2400 ref 2000 + 1240 1700 qry 3000 + 1500 1960 34
460

"""
REF, QRY, ALT = ("ref", 2000), ("qry", 3000), ("alt1", 5000)


def read(spark, text):
    chains, meta = chain_text.parse_chains(net_text.lines_of(spark, [text]))
    return chains.withColumn("chain_id", F.col("chain_id").cast("long")), meta


def known(spark, reference=(REF,), query=(QRY, ALT)):
    return sizes.in_memory(spark, "reference", reference).union(sizes.in_memory(spark, "query", query))


def test_chain_text(spark):
    chains, meta = read(spark, CHAINS)
    rows = chains.orderBy("input_ordinal").collect()
    assert [(r["chain_id"], r["score"], len(r["blocks"])) for r in rows] == [(31, 9000, 2), (32, 7000, 2), (33, 2500, 1), (34, 2400, 1)]
    assert tuple(rows[0]["blocks"][0]) == (250, 350, 250) and [r["line"] for r in meta.collect()] == ["##about=made for these tests"]


def test_both_sides(spark):
    made = construct.generate(read(spark, CHAINS)[0], known(spark))
    text = {side: "".join(r["text"] for r in section_text(*getattr(made, side)).orderBy("net_id").collect()) for side in ("reference", "query")}
    # By hand: 31 leaves the gap 650-1000; 32 fills 650-1000 of it with 220 of its 240 bases; 34 starts behind 31.
    assert text["reference"].splitlines() == [
        "net ref 2000",
        " fill 400 850 qry - 2150 750 id 31 score 9000 ali 500",
        "  gap 650 350 qry - 2400 250",
        "   fill 650 350 alt1 + 2010 280 id 32 score 6417 ali 220",
        "    gap 760 130 alt1 + 2120 60",
        " fill 1250 450 qry + 1510 450 id 34 score 2348 ali 450",
    ]
    assert text["query"].splitlines()[0] == "net qry 3000" and " fill 2150 750 ref - 400 850 id 31 score 9000 ali 500" in text["query"].splitlines()
    # The other side of a gap of a minus chain spans both blocks there.
    assert "  gap 2400 250 ref - 400 850" in text["query"].splitlines()
    assert [x for x in text["query"].splitlines() if x.startswith("net")] == ["net qry 3000", "net alt1 5000"]


def test_post_filter_and_raw_copy(spark):
    options = construct.NetOptions(min_score=0, post_filter=8000, side=chain.REFERENCE, capture_raw=True)
    low = CHAINS.replace(b"chain 7000", b"chain 8900")
    made = construct.generate(read(spark, low)[0], known(spark), options, ["##about\n"])
    kept = [(r["kind"], r["chain_id"], r["depth"]) for r in made.reference[1].orderBy("pos").collect()]
    assert kept == [("fill", 31, 0), ("gap", None, 1), ("fill", 32, 2), ("gap", None, 3)]
    assert made.raw_reference[1].count() > len(kept) and made.query is None and made.raw_query is None
    assert made.metadata == [] and made.raw_metadata == ["##about"]
    over = construct.generate(read(spark, CHAINS)[0], known(spark), construct.NetOptions(min_score=0, post_filter=9001, side=chain.REFERENCE))
    assert over.reference[0].count() == 0  # with a post-filter an empty section goes
    bare = construct.generate(read(spark, CHAINS)[0], known(spark), construct.NetOptions(min_fill=500, min_score=0, side=chain.REFERENCE))
    assert bare.reference[1].where("kind = 'fill'").count() == 1


def test_a_section_of_dropped_fills_keeps_its_header(spark):
    one = b"chain 5000 ref 2000 + 0 400 qry 3000 + 0 15 1\n10 385 0\n5\n"
    rows = construct.generate(read(spark, one)[0], known(spark), construct.NetOptions(min_fill=100, side=chain.REFERENCE)).reference
    assert [r["reference_name"] for r in rows[0].collect()] == ["ref"] and rows[1].count() == 0


@pytest.mark.parametrize(
    ("old", "new", "wrong"),
    [
        (b"chain 7000", b"chain 9001", (32, "UnsortedScores")),
        (b" 33\n", b" 31\n", (31, "DuplicateChainId")),
        (b"ref 2000 + 640", b"ref 2000 - 640", (32, "InvalidReferenceStrand")),
        (b"ref 2000 + 1240", b"none 2000 + 1240", (34, "MissingSequence")),
        (b"alt1 5000", b"alt1 5001", (32, "SizeMismatch")),
        (b"\n20\n", b"\n", (33, "MalformedBlocks")),
        (b"\n20\n", b"\n0 10 10\n10\n", (33, "MalformedBlocks")),
        (b"\n20\n", b"\n20 5 5\n", (33, "MalformedBlocks")),
        (b"250 350 250", b"250 351 250", (31, "MalformedBlocks")),
        (b"+ 1240 1700 qry 3000 + 1500 1960", b"+ 1640 2100 qry 3000 + 1500 1960", (34, "MalformedBlocks")),
    ],
)
def test_errors(spark, old, new, wrong):
    found = chain.chain_errors(read(spark, CHAINS.replace(old, new, 1))[0], known(spark)).collect()
    assert [(r["chain_id"], r["kind"]) for r in found] == [wrong] and found[0]["reason"]


def test_no_errors(spark):
    assert chain.chain_errors(read(spark, CHAINS)[0], known(spark)).count() == 0
    rising = read(spark, CHAINS.replace(b"chain 7000", b"chain 9001"))[0]
    assert chain.chain_errors(rising, known(spark), score_order=False).count() == 0


def test_rounding(spark):
    df = spark.createDataFrame([(2999.6,), (2998.5,), (2999.5,)], "x double").select(chain.display_score(F.col("x")).alias("y"))
    assert [r["y"] for r in df.collect()] == [3000, 2998, 3000]


SIZE = 600


def random_chains(seed, n=60):
    """(id, score, reference name, query name, strand, blocks of (reference start, query start, size)) with falling scores."""
    r, out = random.Random(seed), []
    for i in range(n):
        blocks, a, q = [], r.randrange(SIZE - 60), r.randrange(SIZE - 60)
        for _ in range(r.randint(1, 6)):
            size = r.randint(1, 25)
            if a + size > SIZE or q + size > SIZE:
                break
            blocks.append((a, q, size))
            a, q = a + size + r.choice([0, 3, r.randint(0, 90)]), q + size + r.choice([0, 2, r.randint(0, 40)])
        if blocks:
            out.append((i, r.randint(10, 900), f"r{r.randrange(2)}", f"q{r.randrange(2)}", r.choice("+-"), blocks))
    return sorted(out, key=lambda c: -c[1])


def as_table(spark, chains):
    rows = []
    for k, (i, score, ref, query, strand, blocks) in enumerate(chains):
        dense = [(s, blocks[j + 1][0] - a - s, blocks[j + 1][1] - q - s) if j + 1 < len(blocks) else (s, 0, 0) for j, (a, q, s) in enumerate(blocks)]
        last = blocks[-1]
        rows.append((i, k, score, ref, SIZE, blocks[0][0], last[0] + last[2], query, SIZE, blocks[0][1], last[1] + last[2], strand, dense))
    schema = "chain_id long, input_ordinal long, score long, reference_name string, reference_size long, reference_start long, reference_end long, query_name string, query_size long, query_start long, query_end long, query_strand string, blocks array<struct<size:bigint,gap_reference:bigint,gap_query:bigint>>"
    return spark.createDataFrame(rows, schema)


def plain_nets(chains, side, options):
    """Position by position: which stretch each free position is in. Rows by name: kind, chain, interval, the other side's, depth, aligned."""
    found = {}
    for name in sorted({c[2] if side == chain.REFERENCE else c[3] for c in chains}):
        stretch, under, rows = [0] * SIZE, {0: None}, []
        for i, score, ref, query, strand, blocks in chains:
            if score < options.min_score:
                break
            if (ref if side == chain.REFERENCE else query) != name:
                continue
            # blocks from left to right on this side, as positions here and there
            forward = [(a, q if strand == "+" else SIZE - q - s, s) for a, q, s in blocks]
            pairs = sorted(forward if side == chain.REFERENCE else [(q, a, s) for a, q, s in forward])
            at = {}
            for here, there, s in pairs:
                for k in range(s):
                    at[here + k] = there + k if strand == "+" else there + s - 1 - k
            low, high = pairs[0][0], pairs[-1][0] + pairs[-1][2]
            for old in sorted({x for x in stretch[low:high] if x is not None}):
                places = [p for p in range(SIZE) if stretch[p] == old]
                bases = [p for p in places if p in at]
                if not bases or bases[-1] + 1 - bases[0] < options.min_fill:
                    continue
                first, last = bases[0], bases[-1] + 1
                others = [at[p] for p in bases]
                fill = {"kind": "fill", "chain": i, "start": first, "end": last, "other": (min(others), max(others) + 1), "above": under[old], "aligned": len(bases), "whole": first <= low and last >= high, "score": score, "total": len(at)}
                rows.append(fill)
                for p in places:
                    stretch[p] = None
                for a, z in ((places[0], first), (last, places[-1] + 1)):
                    if z - a >= options.min_space:
                        new = len(under)
                        under[new] = under[old]
                        stretch[a:z] = [new] * (z - a)
                for (h, t, s), (hn, tn, sn) in zip(pairs[:-1], pairs[1:], strict=True):
                    a, z = h + s, hn
                    if places[0] < a and z < places[-1] + 1 and z - a >= options.min_space:
                        other = (t + s, tn) if strand == "+" else (tn + sn, t) if side == chain.REFERENCE else (tn, t + s)
                        gap = {"kind": "gap", "chain": i, "start": a, "end": z, "other": other, "above": fill, "aligned": 0}
                        rows.append(gap)
                        new = len(under)
                        under[new] = gap
                        stretch[a:z] = [new] * (z - a)
        found[name] = rows
    return found


def depth(row):
    return 0 if row["above"] is None else 1 + depth(row["above"])


def good(row, options):
    """Whether the row and all above it stay."""
    if row is None:
        return True
    raw = row.get("score", 0) if row.get("whole") else row.get("score", 0) * row["aligned"] / row.get("total", 1)
    return (row["kind"] == "gap" or raw >= options.min_score and row["aligned"] >= options.min_fill) and good(row["above"], options)


@pytest.mark.parametrize("side", [chain.REFERENCE, chain.QUERY])
@pytest.mark.parametrize(("seed", "space", "fill", "score", "at_once"), [(1, 25, 12, 100, None), (2, 10, 5, 0, 3), (3, 3, 1, 300, 7), (4, 60, 30, 0, 1)])
def test_against_single_positions(spark, monkeypatch, side, seed, space, fill, score, at_once):
    """Whole sequences in one task, and in rounds that place the best one or two chains of a stretch before the others are dealt."""
    if at_once:
        monkeypatch.setattr(construct, "AT_ONCE", at_once)
        monkeypatch.setattr(construct, "FIRST", (at_once + 1) // 2)
        monkeypatch.setattr("fillgap.operators.scan.PART_ROWS", 40)
    options = construct.NetOptions(min_space=space, min_fill=fill, min_score=score)
    chains = random_chains(seed)
    plain = plain_nets(chains, side, options)
    table = as_table(spark, chains)
    found = construct.placed(table, side, options).collect()
    expected = sorted((n, r["kind"], r["chain"], r["start"], r["end"], *r["other"], depth(r), r["aligned"]) for n, rows in plain.items() for r in rows)
    assert sorted((r["primary_name"], r["kind"], r["chain_id"], r["start"], r["end"], r["other_start"], r["other_end"], r["depth"], r["aligned"]) for r in found) == expected and len(expected) > 10
    tree = construct.build(table, side, options).collect()
    kept = sorted((n, r["start"], depth(r), r["kind"], r["chain"]) for n, rows in plain.items() for r in rows if good(r, options))
    assert [(r["primary_name"], r["start"], r["depth"], r["kind"], r["chain_id"]) for r in sorted(tree, key=lambda r: (r["primary_name"], r["pos"]))] == kept


def test_a_chain_that_spans_the_sequence(spark):
    """One long chain with 400 gaps, and 30 chains in each gap: after it is placed, every gap is a task of its own."""
    width = 1_000
    long = [(i * width, i * width, 10) for i in range(401)]
    chains = [(1, 10**9, "r0", "q0", "+", long)]
    r = random.Random(4)
    for g in range(400):
        for k in range(30):
            at = g * width + 20 + r.randrange(0, 900)
            chains.append((10 + 30 * g + k, 10**6 - 30 * g - k, "r0", "q0", "+", [(at, at, r.randrange(5, 60))]))
    rows = [(n, i, score, ref, 500_000, s[0][0], s[-1][0] + s[-1][2], q, 500_000, strand, s[0][1], s[-1][1] + s[-1][2], [(z, 0 if k == len(s) - 1 else s[k + 1][0] - a - z, 0 if k == len(s) - 1 else s[k + 1][1] - b - z) for k, (a, b, z) in enumerate(s)]) for n, (i, score, ref, q, strand, s) in enumerate(chains)]
    table = spark.createDataFrame(rows, "input_ordinal long, chain_id long, score long, reference_name string, reference_size long, reference_start long, reference_end long, query_name string, query_size long, query_strand string, query_start long, query_end long, blocks array<struct<size:long,gap_reference:long,gap_query:long>>")
    options = construct.NetOptions(min_score=0, side=chain.REFERENCE)
    columns = ["root", "depth", "kind", "chain_id", "start", "end", "other_start", "other_end", "aligned"]
    whole = construct.placed(table, chain.REFERENCE, options, at_once=10**6).select(columns)
    cut = construct.placed(table, chain.REFERENCE, options, at_once=100, first=1)
    assert sorted(map(tuple, cut.select(columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    most = cut.where("depth > 1").groupBy("low").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert most[0] <= 60 and most[1] == 400


def test_stretches_need_positions(spark):
    chains = [(1, 9, "r0", "q0", "+", [(0, 0, 10), (10, 30, 10)])]
    with pytest.raises(Exception, match="without positions"):
        construct.placed(as_table(spark, chains), chain.REFERENCE, construct.NetOptions(min_space=0, min_fill=0, min_score=0)).collect()


def test_chains_by_sequence(spark):
    rows = {r["name"]: (r["chains"], r["first_chain"], r["last_chain"]) for r in chain.by_sequence(read(spark, CHAINS)[0], chain.QUERY).collect()}
    assert rows == {"qry": (3, 31, 34), "alt1": (1, 32, 32)}
