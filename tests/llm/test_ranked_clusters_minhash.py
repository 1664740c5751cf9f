"""Ranked search, clustering and HyperMinHash against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillgap.llm import clustering, hyperminhash, queries, ranked
from tests.duck import same
from tests.llm.edge import CLASHES, LONG, ROWS, documents, nothing


@pytest.mark.parametrize("name", ["op11_ranked", "op12_clusters", "op13_hyperminhash"])
def test_sql(spark, name):
    same(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.SQL[name])


# Ranked search


def plain_terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain_ranks(docs, items, k):
    """(item, rank, doc, score) by scoring every document for every item."""
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total, df = len(counted), sum(x for _, _, x in counted), Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, c, length in counted:
            m = 100 - 50 + (50 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def items_of(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"item_id {kind}, text string").withColumns({c: F.lit("clash") for c in [*CLASHES, "rank", "term", "item", "doc_id"]})


def test_ranked_edges(spark):
    items = [(1, "The cat, the LICENSE and İstanbul's ½"), (2, None), (3, ""), (4, "!?"), (5, "zzzzqqq"), (6, "Hund"), (6, "cat"), (None, "x licensed"), (1, "The cat, the LICENSE and İstanbul's ½")]
    found = sorted((tuple(r) for r in ranked.search(documents(spark), items_of(spark, items), k=4).collect()), key=str)
    assert found == plain_ranks([(r[0], r[1]) for r in ROWS], items, 4) and len(found) > 5
    assert ranked.search(nothing(spark), items_of(spark, items)).count() == 0
    none = ranked.search(documents(spark), items_of(spark, items).limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    names = [("a", "the cat"), (None, "Hund")]
    found = sorted((tuple(r) for r in ranked.search(documents(spark), items_of(spark, names, "string"), k=4).collect()), key=str)
    assert found == plain_ranks([(r[0], r[1]) for r in ROWS], names, 4)


def test_ranked_in_any_blocks_and_batches(spark):
    r = random.Random(11)
    words = [f"w{int(r.expovariate(0.05))}" for _ in range(400)]
    docs = [(i // 2 if i % 7 == 0 else i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(500)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(80)]  # ties
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for i in range(12)] + [(99, "w1 w3")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    expected = plain_ranks(docs, items, 10)
    for options in ({}, {"block_docs": 7}, {"block_docs": 40, "terms_at_once": 20}):
        found = sorted((tuple(x) for x in ranked.search(df, items_of(spark, items), k=10, **options).collect()), key=str)
        assert found == expected, options


def test_ranked_stops_early():
    """A rare term decides, and the long list of a common one is read to a small depth only."""
    n = 20_000
    terms = np.concatenate([np.zeros(n, np.int64), np.ones(30, np.int64)])
    doc = np.concatenate([np.arange(n), np.arange(30) * 7])
    order = np.lexsort((terms, doc))
    block = ranked.Block(np.bincount(doc, minlength=n), terms[order], np.ones(n + 30, np.int64), np.full(n, 100), np.array([10, 9_000]))
    looked = []
    look_up = block.look_up
    block.look_up = lambda docs: looked.append(len(docs)) or look_up(docs)
    found, score = block.search(np.array([0, 1]), 20, 0)
    assert set(np.arange(30) * 7) == set(found.tolist()) and len(set(score.tolist())) == 1 and sum(looked) < 200
    found, _ = block.search(np.array([0, 1]), 20, int(score[0]) + 1)  # a floor that nothing reaches
    assert len(found) == 0 and not block.seen.any() and not block.asked.any()


def test_length_norms_of_any_size():
    lengths = np.array([1, 10**7, 5 * 10**9])
    assert ranked.length_norms(lengths, 3 * 10**10, 10**13).tolist() == [50 + 50 * 3 * 10**10 * n // 10**13 for n in lengths.tolist()]


# Clusters


def plain_clusters(rows, k, rounds, dim=64):
    kept = [(i, [math.floor(64 * x) if abs(x) < 1e300 else int(x) * 64 for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = [c for c, _ in assign()]
        for c in range(len(centroids)):
            own = [v for (_, v), x in zip(kept, at, strict=True) if x == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at, top = assign(), (1 << 63) - 1
    inside = [sum(d for x, d in at if x == c) for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, min(d, top), min(inside[c], top), min(sum(inside), top), names[c]) for (i, _), (c, d) in zip(kept, at, strict=True)), key=str)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("id", "x", "ids", "data", "hash", "cluster", "label", "distance")})


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e8, 1e12, 1e200, 1e306])
def test_clusters_of_any_size(spark, scale):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=64) + 3 * (i % 5)]) for i in range(150)]
    rows += [(200 + i, [float(x) * scale for x in r.normal(size=64)]) for i in range(30)]
    found = sorted((tuple(x) for x in clustering.cluster(vectors(spark, rows), k=7, block_rows=20).collect()), key=str)
    assert found == plain_clusters(rows, 7, 3)


def test_clusters_edges(spark):
    r = np.random.default_rng(5)
    good = [[float(x) for x in r.normal(size=64)] for _ in range(12)]
    rows = [(i, v) for i, v in enumerate(good)] + [(3, good[0]), (3, good[3]), (None, good[1]), (None, good[2])]
    rows += [(50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 65), (54, [None] * 64), (55, [math.nan] + [0.0] * 63), (56, [math.inf] + [0.0] * 63), (57, [0.0] * 64)]
    for k in (4, 16, 40):
        assert sorted((tuple(x) for x in clustering.cluster(vectors(spark, rows), k=k).collect()), key=str) == plain_clusters(rows, k, 3)
    same_rows = [(i, [0.5] * 64) for i in range(9)]  # ties, and centroids that stay empty
    assert sorted((tuple(x) for x in clustering.cluster(vectors(spark, same_rows), k=3).collect()), key=str) == plain_clusters(same_rows, 3, 3)
    assert clustering.cluster(vectors(spark, rows).limit(0)).count() == 0
    assert clustering.cluster(vectors(spark, rows).where("vec_id > 49 and vec_id < 57")).count() == 0


def test_exact_border_of_doubles():
    """Around 2^53 the expansion in doubles would be off; the integers take over before."""
    x = np.array([[2.0**25 + 1] * 4, [2.0**24 + 3] * 4, [2.0**31 + 1] * 4, [1.0] * 4])
    centroids = [[2**25 - 1] * 4, [2**31 - 5] * 4, [0, 0, 0, 1]]
    cluster, distance = clustering.nearest(x, centroids, 1.0)
    for i, row in enumerate(x.astype(object)):
        d = [sum((int(a) - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centroids]
        assert (cluster[i], int(distance[i])) == (d.index(min(d)), min(d))


# HyperMinHash


def plain_classes(rows, n=4, percent=80):
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((i, {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()))
    label = {k: k for k in range(len(sets))}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x[0] is not None and y[0] is not None and x[1] and y[1] and 100 * len(x[1] & y[1]) >= percent * len(x[1] | y[1]):
                label[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(s), None if i is None else least[top(k)], i is None or least[top(k)] == i) for k, (i, s) in enumerate(sets)), key=str)


def found_classes(df, **options):
    return sorted((tuple(r) for r in hyperminhash.classes(df, **options).collect()), key=str)


def test_minhash_edges(spark):
    assert found_classes(documents(spark)) == plain_classes([(r[0], r[1]) for r in ROWS])
    assert found_classes(nothing(spark)) == []


def test_minhash_near_copies(spark, monkeypatch):
    r = random.Random(13)
    words = [f"w{i}" for i in range(300)]
    rows = [(9_000, LONG), (9_001, LONG + " more words at the end"), (9_002, LONG)]
    for group in range(30):
        base = [r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 8, 20, 60, 200]))]
        for copy in range(r.choice([1, 2, 6, 12])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(base) // 40])):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((group * 100 + copy, " ".join(text)))
    passage = " ".join(r.choice(words) for _ in range(120))
    rows += [(5_000 + i, passage + " " + " ".join(r.choice(words) for _ in range(r.choice([10, 25, 60])))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = plain_classes(rows)
    assert 40 < len({x[2] for x in expected}) < len(rows) - 20
    assert found_classes(df) == expected
    # Without the comparisons with centres the cells alone find every link, in cells of any size.
    monkeypatch.setattr("fillgap.llm.jaccard.CELL", 3)
    assert found_classes(df, stars=1) == expected


def test_registers_tell_the_similarity():
    r = np.random.default_rng(2)
    for shared, own in ((4, 1), (9, 2), (40, 5), (400, 100), (9_000, 2_000)):
        seen = []
        for _ in range(60):
            s, a, b = (r.integers(0, 2**63, k, dtype=np.uint64) for k in (shared, own, own))
            x, y = (hyperminhash.registers(np.unique(np.concatenate([s, z]))) for z in (a, b))
            seen.append(float(hyperminhash.similarity(np.array(np.count_nonzero(x == y)))))
        truth = shared / (shared + 2 * own)
        assert abs(np.mean(seen) - truth) < 0.02 and abs(np.array(seen) - truth).max() < hyperminhash.MARGIN
    unlike = [hyperminhash.registers(r.integers(0, 2**63, 500, dtype=np.uint64)) for _ in range(200)]
    agree = np.mean([np.count_nonzero(a == b) for a, b in zip(unlike[:100], unlike[100:], strict=True)]) / hyperminhash.REGISTERS
    assert agree < 10 * hyperminhash.CHANCE


def test_bands_miss_nothing():
    """Sets of similarity 0.8 share a band, whatever their size."""
    r = np.random.default_rng(6)
    for size in (8, 80, 800):
        for _ in range(300):
            s = r.integers(0, 2**63, size, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([s, r.integers(0, 2**63, size // 8, dtype=np.uint64)])) for _ in range(2))
            assert (hyperminhash.band_keys(hyperminhash.registers(a)) == hyperminhash.band_keys(hyperminhash.registers(b))).any()
