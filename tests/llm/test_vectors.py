"""Both vector searches and the URL filter."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fillgap.llm import ann, exact_topk, urls

VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)], 0) for i in range(60)]
    rows += [(100 + i, [1.0] * 8, 0) for i in range(40)]  # copies: ties
    rows += [(200, None, 0), (201, [0.0] * 8, 0), (202, [float("nan")] * 8, 0), (203, [None] * 8, 0), (204, [float("inf")] + [0.0] * 7, 0), (None, [1.0] * 8, 0), (205, [], 0)]
    return spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("id", "v", "cb", "qb", "score", "near", "width", "ids")})


def test_ann_is_exact_on_few_rows(spark):
    df = odd_vectors(spark)
    good = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect() if r["vec_id"] is not None and (r["vec_id"] < 200)}
    found = {}
    for r in ann.search(df, lambda i: i % 50 == 0, k=5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {0, 50, 100}
    for q, rows in found.items():
        cos = {i: float(v @ good[q] / (np.linalg.norm(v) * np.linalg.norm(good[q]))) for i, v in good.items() if i != q}
        best = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        rows.sort()
        assert [x[1] for x in rows] == best and all(abs(s - cos[i]) < 1e-12 for _, i, s in rows)


def other_lengths(spark):
    """Vectors of several lengths, ids that repeat with other vectors and with the same one, and very large components."""
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.normal(size=8)], 0) for i in range(80)]
    rows += [(100 + i, [float(x) for x in r.normal(size=3)], 0) for i in range(50)]
    rows += [(200, [1.0, 2.0], 0), (250, [1.0], 0), (0, [float(x) for x in r.normal(size=8)], 0), (0, [float(x) for x in r.normal(size=3)], 0), (50, rows[50][1], 0), (60, rows[7][1], 0)]
    rows += [(300 + i, [float(x) * 3e6 for x in r.normal(size=5)], 0) for i in range(30)]
    return spark.createDataFrame(rows, VECTORS)


def plain_search(df, asked, k, score, keep):
    """(query_id, rank, vec_id, score) of distinct rows, each length by itself."""
    rows = sorted({(r["vec_id"], tuple(r["embedding"])) for r in df.collect()})
    out = []
    for q in rows:
        if asked(q[0]):
            near = sorted(((score(q[1], x[1]), x[0]) for x in rows if x != q and len(x[1]) == len(q[1])), key=lambda s: (-s[0], s[1]))[:k]
            out += [(q[0], n + 1, i, keep(s)) for n, (s, i) in enumerate(near)]
    return sorted(out)


def test_ann_of_other_lengths(spark, monkeypatch):
    df = other_lengths(spark)

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        return round(float((a * b).sum() / np.linalg.norm(a) / np.linalg.norm(b)), 12)

    expected = plain_search(df, lambda i: i % 50 == 0, 5, cosine, lambda s: round(s, 9))
    for coded in (16, 1):  # with one codebook the other lengths are scanned without codes
        monkeypatch.setattr(ann, "CODED", coded)
        found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(df, lambda i: i % 50 == 0, k=5, block_rows=20, query_rows=2).collect())
        assert found == expected


def test_exact_search_of_other_lengths(spark):
    df = other_lengths(spark)
    product = lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=True))
    expected = plain_search(df, lambda i: i % 20 == 0, 20, product, lambda s: s)
    assert max(abs(s) for *_, s in expected) > 1 << 53
    for blocks, asked in ((10, 4), (8_192, 1_024)):
        assert sorted(map(tuple, exact_topk.search(df, lambda i: i % 20 == 0, k=20, block_rows=blocks, query_rows=asked).collect())) == expected


def test_exact_search_beyond_longs(spark):
    """Components and products that no long can hold count as the nearest long."""
    r = np.random.default_rng(8)
    rows = [(i, [float(x) * s for x in r.normal(size=4)]) for i, s in enumerate([1.0, 1e9, 1e17, 1e300] * 15)]
    low, top = -(1 << 63), (1 << 63) - 1
    whole = {i: [max(low, min(top, math.floor(64 * x) if abs(x) < 1e300 else int(x) * 64)) for x in v] for i, v in rows}
    product = lambda a, b: max(-top, min(top, sum(x * y for x, y in zip(whole[a], whole[b], strict=True))))
    expected = []
    for q in range(0, 60, 20):
        best = sorted(((product(q, i), i) for i in whole if i != q), key=lambda s: (-s[0], s[1]))
        expected += [(q, n + 1, i, s) for n, (s, i) in enumerate(best[:45])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for blocks in (8, 8_192):
        assert sorted(map(tuple, exact_topk.search(df, lambda i: i % 20 == 0, k=45, block_rows=blocks, query_rows=2).collect())) == sorted(expected)


def test_boxes_bound_all_products():
    r = np.random.default_rng(4)
    q, x = r.normal(size=(40, 64)) + 1, r.normal(size=(90, 64)) - 0.5
    p, s = exact_topk.profile(q, 16), exact_topk.profile(x, 16)
    assert exact_topk.bound_of_boxes(p.min(0), p.max(0), s.min(0), s.max(0)) >= (q @ x.T).max()


def test_exact_search_of_clusters(spark):
    """Where the bounds of boxes spare most pairs of blocks, the result is that of brute force."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(6, 16)) * 20
    rows = [(i, [float(x) for x in centres[i % 6] + r.normal(size=16) * 0.1], 0) for i in range(600)]
    df = spark.createDataFrame(rows, VECTORS)
    product = lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=True))
    found = exact_topk.search(df, lambda i: i % 20 == 0, k=5, block_rows=30, query_rows=10)
    assert sorted(map(tuple, found.collect())) == plain_search(df, lambda i: i % 20 == 0, 5, product, lambda s: s)


def test_ann_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    x = np.stack([r["embedding"] for r in rows]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = {r["vec_id"]: k for k, r in enumerate(rows)}
    found = ann.search(df, lambda i: i % 50 == 0, k=5, block_rows=1_000, query_rows=30).toPandas()
    hit = 0
    for q, part in found.groupby("query_id"):
        s = x @ x[at[q]]
        s[at[q]] = -9
        hit += len({rows[k]["vec_id"] for k in np.argsort(-s)[:5]} & set(part.vec_id))
    assert hit / len(found) >= 0.9


def test_ann_recall_on_a_large_table(spark):
    """50,000 made vectors in loose clusters, each of 64 components."""
    r = np.random.default_rng(50)
    n = 50_000
    x = (r.normal(size=(400, 64))[r.integers(0, 400, n)] + 0.7 * r.normal(size=(n, 64))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))}))
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    asked = np.arange(0, n, 50)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -9
    best = np.argpartition(-near, 5, axis=1)[:, :5]
    found = ann.search(df, lambda i: i % 50 == 0, k=5).toPandas().groupby("query_id").vec_id.agg(set)
    hit = sum(len(set(b.tolist()) & found.get(i, set())) for i, b in zip(asked.tolist(), best, strict=True))
    print("recall of", n, "vectors", hit / best.size)
    assert hit / best.size >= 0.95


def test_ann_of_any_size(spark):
    """Components near the ends of the doubles, in one table with common ones: cosines are those of the scaled vectors."""
    r = np.random.default_rng(12)
    rows = [(i, [float(x) * s for x in r.normal(size=8)]) for i, s in enumerate([1e-320, 1e-200, 1.0, 1e200, 1e307] * 20)]
    unit = {i: np.array([x / max(map(abs, v)) for x in v]) for i, v in rows}
    cosine = lambda a, b: float(unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]))
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 10 == 0, k=5).toPandas()
    assert len(found) == 50
    for q, part in found.groupby("query_id"):
        score = {i: cosine(q, i) for i in unit if i != q}
        part = part.sort_values("rank")
        assert np.allclose(part.score, sorted(score.values(), reverse=True)[:5]) and np.allclose(part.score, [score[i] for i in part.vec_id])


def test_ann_in_tight_clusters_and_beside_one_direction(spark):
    """Thousands of vectors whose codes are alike, and ones that all point nearly the same way: the nearest are those of brute force."""
    r = np.random.default_rng(31)
    tight = r.normal(size=(2, 32))[np.arange(3_000) % 2] + 1e-4 * r.normal(size=(3_000, 32))
    beside = 50 + r.normal(size=(3_000, 32))
    for x in (tight, beside):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        found = ann.search(df, lambda i: i % 300 == 0, k=5, block_rows=700).toPandas()
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = unit[::300] @ unit.T
        near[np.arange(10), np.arange(0, 3_000, 300)] = -9
        want = [set(n.tolist()) for n in np.argsort(-near, axis=1)[:, :5]]
        assert sum(len(w & set(found[found.query_id == 300 * i].vec_id)) for i, w in enumerate(want)) >= 49  # of 50; rounding may swap one


def test_ann_keeps_the_same_in_any_number_of_rounds(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    one, many = (sorted(map(tuple, ann.search(df, lambda i: i % 50 == 0, k=5, keep=30, block_rows=n).collect())) for n in (5_000, 150))
    assert one == many
    assert ann.kept_of(10, 200) == ann.kept_of(50_000, 200) == 200 and ann.kept_of(5_000_000, 200) == 2_000


def test_exact_search(spark):
    df = odd_vectors(spark)
    good = {r["vec_id"]: np.floor(64 * np.array(r["embedding"], float)).astype(int) for r in df.collect() if r["vec_id"] is not None and (r["vec_id"] < 200 or r["vec_id"] == 201)}
    found = {}
    for r in exact_topk.search(df, lambda i: i % 20 == 0, k=20, block_rows=30, query_rows=3).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in good if i % 20 == 0}
    for q, rows in found.items():
        score = {i: int(v @ good[q]) for i, v in good.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert sorted(rows) == [(k + 1, i, score[i]) for k, i in enumerate(best)]


def test_bounds_hold():
    r = np.random.default_rng(2)
    q, x = r.normal(size=(5, 64)), r.normal(size=(50, 64))
    for s in exact_topk.LEVELS:
        assert (exact_topk.profile(q, s) @ exact_topk.profile(x, s).T >= q @ x.T - 1e-9).all()


def test_searches_of_nothing(spark):
    none = odd_vectors(spark).limit(0)
    assert ann.search(none, lambda i: i % 50 == 0).count() == 0
    assert exact_topk.search(none, lambda i: i % 20 == 0).count() == 0


def test_url_rules(spark):
    cases = {
        "http://A.Example.COM/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/?q": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://x.www.example.com/en/a#b": ("x.www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "http://other.com": ("other.com", "", None, None),
        "http://other.com/": ("other.com", "/", "com/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://b.net/es/1?x": ("b.net", "/es/1", "net/es/", "block"),
        "http://b.net/esx": ("b.net", "/esx", None, None),
        "http://com/x://y.net/fr/": ("com", "/x://y.net/fr/", "com/", "allow"),
        "mailto:x": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "http://c.net?a/fr/": ("c.net", "", None, None),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "label", "features", "s1")})
    rows = {r["page_id"]: r for r in urls.judge(df).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert urls.judge(df.limit(0)).count() == 0


def test_url_trees_learn_the_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = urls.judge(pages).toPandas()
    free = rows[rows.rule.isna()]
    assert len(rows) == pages.count() and len(free) and free.score.between(0, 1).all() and ((free.score > 0.5) == (free.verdict == "block")).all()


def test_url_trees_judge_hosts_without_labels(spark):
    """Hosts of a suffix that no rule names: only length, digits, depth and parameters tell their URLs apart."""
    r = random.Random(11)
    rules = (("block", "net", "/go/"), ("allow", "net", "/read/"))

    def url(bad, host, path):
        if bad:
            return f"http://{host}/{path}{r.randrange(10**9, 10**12)}-{r.randrange(10**6)}?id={r.randrange(10**6)}&ref={r.randrange(10**4)}&t={r.randrange(10**9)}"
        return f"https://{host}/{path}" + "/".join(r.choice(["news", "garden", "travel", "music"]) for _ in range(r.randint(1, 3)))

    rows = []
    for i in range(4000):
        bad, host = r.random() < 0.4, f"h{r.randrange(300)}"
        known = i % 4 != 0
        rows.append((i, url(bad, host + (".net" if known else ".info"), ("go/" if bad else "read/") if known else r.choice(["a/", "b/"])), bad, known))
    pages = spark.createDataFrame([x[:2] for x in rows], "page_id long, url string")
    found = {x["page_id"]: x for x in urls.judge(pages, rules).collect()}
    held = [(found[i], bad) for i, _, bad, known in rows if not known]
    assert len(found) == len(rows) and all(found[i]["score"] == float(bad) for i, _, bad, known in rows if known)
    assert all(x["rule"] is None for x, _ in held) and np.mean([(x["verdict"] == "block") == bad for x, bad in held]) > 0.97


def test_url_suffixes_count_all_labelled_urls(spark):
    rules = (("allow", "x", "/a/"), ("block", "x", "/b/"))
    rows = [(f"http://h{100 + h}.x/{'ab'[h % 2]}/{i}", h) for h in range(200) for i in range(10)] + [(f"http://h{100 + h}.x/c/0", h) for h in range(200)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    found = {r["page_id"]: r for r in urls.judge(pages, rules, fit_urls=100).collect()}
    free = [(found[i], h) for i, (u, h) in enumerate(rows) if "/c/" in u]
    assert len(found) == len(rows) and all(r["rule"] is None and r["verdict"] == ("allow", "block")[h % 2] for r, h in free)


def test_url_suffix_shares(spark):
    rows = spark.createDataFrame([("x", "a.x", 0, 1.0)] * 2 + [("x", "a.x", 1, 1.0), ("x", "b.x", 1, 0.0), ("", "", 0, 0.0)], "s1 string, s2 string, fold long, label double")
    counts = urls.suffix_counts(rows)
    for small in (10, 0):
        shares = {held: {(r["s2"], r["fold"], round(r["suffix1"], 3), round(r["suffix2"], 3)) for r in urls.with_suffixes(rows, counts, held, small).collect()} for held in (False, True)}
        assert shares[False] == {("a.x", 0, 0.667, 0.8), ("a.x", 1, 0.667, 0.8), ("b.x", 1, 0.667, 0.333), ("", 0, 0.333, 0.333)}
        assert shares[True] == {("a.x", 0, 0.5, 0.667), ("a.x", 1, 0.75, 0.75), ("b.x", 1, 0.75, 0.5), ("", 0, 0.5, 0.5)}
