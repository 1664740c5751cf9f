"""Window operators against plain stacks on random forests."""

import random

import pytest
from pyspark.sql import functions as F

from fillgap.operators import arrange, context, policies, scan, tree


def forest(seed, nets=3, deep=6):
    r, rows = random.Random(seed), []
    for n in range(nets):
        depth = root = -1
        for pos in range(r.randint(1, 60)):
            depth = 0 if pos == 0 else r.randint(0, min(deep, depth + 1))
            root += depth == 0
            rows.append((n, root, pos, depth, r.random() < 0.6, r.randint(0, 30), r.randint(0, 5)))
    return rows


def plain(rows):
    out = []
    for i, (n, root, pos, depth, *rest) in enumerate(rows):
        parent = next((rows[k][2] for k in range(i - 1, -1, -1) if rows[k][0] == n and rows[k][3] < depth), None)
        end = next((rows[k][2] for k in range(i + 1, len(rows)) if rows[k][0] == n and rows[k][3] <= depth), None)
        out.append((n, pos, parent, 1 + max(x[2] for x in rows if x[0] == n) if end is None else end))
    return out


SCHEMA = "net_id int, root int, pos int, depth int, m boolean, reference_start int, reference_size int"


#: Whole trees, and trees cut into parts of three records.
CUTS = (None, 3)


def cut_by(df, rows):
    return scan.WHOLE if rows is None else scan.parts_of(df, rows)


@pytest.mark.parametrize("rows", CUTS)
@pytest.mark.parametrize("wide", [32, -1])
def test_topology(spark, monkeypatch, rows, wide):
    monkeypatch.setattr(tree, "WIDE", wide)
    for seed in (1, 2):
        made = forest(seed)
        df = spark.createDataFrame(made, SCHEMA)
        parts = cut_by(df, rows)
        assert bool(parts) == (rows is not None)
        found = tree.topology(df, parts=parts)
        assert sorted(map(tuple, found.select("net_id", "pos", "parent", "subtree_end").collect()), key=str) == sorted(plain(made), key=str)


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("wide", [32, -1])
def test_policies(spark, monkeypatch, cut, wide):
    for m in (tree, policies):
        monkeypatch.setattr(m, "WIDE", wide)
    rows = forest(5, nets=4)
    info = {(n, p): (parent, end) for n, p, parent, end in plain(rows)}
    m = {(r[0], r[2]): r[4] for r in rows}

    def above(n, p):
        while (p := info[n, p][0]) is not None:
            yield p

    keep = {
        policies.PRUNE: lambda n, p: m[n, p] and all(m[n, a] for a in above(n, p)),
        policies.RETAIN: lambda n, p: any(m[n, q] for q in range(p, info[n, p][1])),
        policies.PROMOTE: lambda n, p: m[n, p],
    }
    df = tree.topology(spark.createDataFrame(rows, SCHEMA)).withColumn("was", F.col("pos"))
    for policy, stays in keep.items():
        kept = [(r[0], r[2]) for r in rows if stays(r[0], r[2])]
        new, count = {}, {}
        for n, p in kept:
            new[n, p] = count.get(n, 0)
            count[n] = new[n, p] + 1
        expected = set()
        for n, p in kept:
            over = [a for a in above(n, p) if (n, a) in new]
            expected.add((n, p, new[n, p], len(over), new[n, over[0]] if over else None))
        parts = cut_by(df, cut)
        out = policies.filter_records(df, F.col("m"), policy, parts=parts)
        found = out.select("net_id", "was", "pos", "depth", "parent").collect()
        assert {tuple(r) for r in found} == expected and len(found) == len(expected)
        tops = {}
        for n, _, p, depth, _ in sorted(expected, key=lambda r: (r[0], r[2])):
            tops[n, p] = p if depth == 0 else tops[n, p - 1]
        assert {(r["net_id"], r["pos"]): r["root"] for r in out.collect()} == tops


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("wide", [32, -1])
def test_sorted_siblings(spark, monkeypatch, cut, wide):
    monkeypatch.setattr(arrange, "WIDE", wide)
    rows = forest(9, nets=2)
    info = {(n, p): parent for n, p, parent, _ in plain(rows)}
    key = {(r[0], r[2]): (r[5], r[6], r[2]) for r in rows}

    def walk(n, parent):
        for _, p in sorted((key[n, p], p) for (k, p), q in info.items() if k == n and q == parent):
            yield p
            yield from walk(n, p)

    df = tree.topology(spark.createDataFrame(rows, SCHEMA)).withColumns({"was": F.col("pos"), "kind": F.lit("fill"), "query_name": F.lit("q"), "query_start": F.lit(0)})
    found = arrange.sort_records(df, parts=cut_by(df, cut)).orderBy("net_id", "pos").collect()
    for n in (0, 1):
        assert [r["was"] for r in found if r["net_id"] == n] == list(walk(n, None))
    shape = spark.createDataFrame([tuple(r[c] for c in ("net_id", "root", "pos", "depth", "parent", "subtree_end")) for r in found], "net_id int, root int, pos int, depth int, p long, e long")
    assert tree.topology(shape).where("parent is distinct from p or subtree_end <> e").count() == 0


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("wide", [32, -1])
def test_ancestors_and_the_nearest(spark, monkeypatch, cut, wide):
    monkeypatch.setattr(tree, "WIDE", wide)
    rows = forest(21, nets=3, deep=9)
    up = {(n, p): parent for n, p, parent, _ in plain(rows)}
    marked = {(r[0], r[2]) for r in rows if r[4]}
    df = tree.topology(spark.createDataFrame(rows, SCHEMA)).withColumn("kind", F.when(F.col("m"), "fill").otherwise("gap"))
    parts = cut_by(df, cut)

    def above(n, p):
        while (p := up[n, p]) is not None:
            yield p

    found = tree.nearest_enclosing(df, F.col("m"), {"pos": "near", "reference_start": "near_start"}, parts=parts).collect()
    start = {(r[0], r[2]): r[5] for r in rows}
    for r in found:
        near = next((a for a in above(r["net_id"], r["pos"]) if (r["net_id"], a) in marked), None)
        assert (r["near"], r["near_start"]) == (near, None if near is None else start[r["net_id"], near])
    assert len(found) == len(rows)
    asked = df.where("reference_start % 3 = 0")
    got = {tuple(r) for r in tree.ancestors(df, asked, parts).select("net_id", "pos", "ancestor", "ancestor_kind", "ancestor_depth", "steps").collect()}
    depth = {(r[0], r[2]): r[3] for r in rows}
    assert got == {(r[0], r[2], a, "fill" if (r[0], a) in marked else "gap", depth[r[0], a], k + 1) for r in rows if r[5] % 3 == 0 for k, a in enumerate(above(r[0], r[2]))}
    family = {}
    for (n, p), q in up.items():
        family.setdefault((n, q), []).append(p)
    beside = {(n, p): (([None, *c, None])[i], ([None, *c, None])[i + 2]) for (n, _), c in family.items() for i, p in enumerate(c)}
    assert {(r["net_id"], r["pos"]): (r["previous_sibling"], r["next_sibling"]) for r in tree.siblings(df, parts).collect()} == beside


def test_one_deep_path_and_one_wide_root(spark):
    """5,000 levels below one root, and a root with 20,000 children: pairs are as many as there are ancestors."""
    deep = spark.range(5_000).selectExpr("0 AS net_id", "0L AS root", "id AS pos", "cast(id AS int) AS depth", "if(id % 10 = 0, 'fill', 'gap') AS kind", "id AS chain_id", "id AS reference_start", "10000 - id AS reference_end")
    deep = tree.topology(deep)
    assert deep.where("parent is distinct from if(pos = 0, null, pos - 1) or subtree_end <> 5000").count() == 0
    near = tree.nearest_enclosing(deep, F.col("kind") == "fill", {"pos": "near"})
    assert near.where("near is distinct from if(pos = 0, null, 10 * floor((pos - 1) / 10))").count() == 0
    assert tree.ancestors(deep, deep.where("pos in (4999, 17)")).count() == 4_999 + 17
    contexts = context.fill_contexts(deep)
    assert contexts.count() == 500 and contexts.where("pos > 0 and (enclosing_fill <> pos - 10 or parent_gap <> pos - 1)").count() == 0
    kept = policies.filter_records(deep, F.col("pos") % 2 == 0, policies.PROMOTE)
    assert kept.count() == 2_500 and kept.where("depth <> pos or subtree_end <> 2500 or parent is distinct from if(pos = 0, null, pos - 1)").count() == 0
    wide = tree.topology(spark.range(20_001).selectExpr("0 AS net_id", "0L AS root", "id AS pos", "if(id = 0, 0, 1) AS depth", "'gap' AS kind"))
    pairs = tree.ancestors(wide, wide, scan.parts_of(wide, 1_000))
    assert pairs.count() == 20_000 and pairs.where("ancestor <> 0 or steps <> 1").count() == 0


def test_parts_spread_one_tree(spark):
    """One root with 60,000 records is cut, and no task of a window gets more than a part and the sums of all."""
    n, rows = 60_000, 4_000
    df = spark.range(n).selectExpr("0 AS net_id", "0L AS root", "id AS pos", "cast(if(id = 0, 0, 1 + id % 3) AS int) AS depth", "id % 7 <> 0 AS m", "id AS reference_start", "5 AS reference_size")
    df = tree.topology(df, parts=scan.parts_of(df, rows))
    parts = scan.parts_of(df, rows)
    marked = parts.mark(df)
    sizes = [r["n"] for r in marked.groupBy(scan.PART).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == n // rows and max(sizes) == rows
    for policy in (policies.PRUNE, policies.RETAIN, policies.PROMOTE):
        cut, whole = (policies.filter_records(df, F.col("m") | (F.col("pos") == 0), policy, parts=p) for p in (parts, scan.WHOLE))
        columns = ["pos", "depth", "parent", "subtree_end", "root", "reference_start"]
        assert cut.select(columns).exceptAll(whole.select(columns)).isEmpty() and cut.count() == whole.count() > n / 2


def test_nothing(spark):
    df = tree.topology(spark.createDataFrame([], SCHEMA))
    assert policies.filter_records(df, F.col("m")).count() == 0
