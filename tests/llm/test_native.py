"""Mixing, sharding and licences."""

import re

import pytest

from fillgap.llm import licences, mixing, queries, sharding
from tests.duck import duck, same
from tests.llm.edge import ROWS, documents, nothing

SF = "/root/testdata/sf0.001"


def targets(sizes, share=1.5, weights=(5, 2, 1), cap=2.0):
    """Plain water-filling; sizes by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rate = (total - sum(cap * sizes[s] for s in capped)) / max(1e-9, sum(w[s] for s in names if s not in capped))
        over = {s for s in names if s not in capped and rate * w[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else rate * w[s] for s in names}
        capped |= over


@pytest.mark.parametrize("table", ["driver", "edge"])
def test_mix(spark, table):
    docs = documents(spark) if table == "edge" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs, fan_in=8).toPandas()
    assert len(rows) == docs.count()
    words = {}
    for r in docs.select("source", "text").collect():
        words[r["source"]] = words.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want, taken = targets(words), {}
    for r in rows.itertuples():
        s = r.source if isinstance(r.source, str) else None
        assert r.source_size == words[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.mix(docs.repartition(2), fan_in=8).toPandas()
    columns = list(rows.columns)
    assert sorted(map(str, rows[columns].values.tolist())) == sorted(map(str, again[columns].values.tolist()))


def test_mix_of_nothing(spark):
    assert mixing.mix(nothing(spark)).count() == 0
    assert mixing.mixed_documents(nothing(spark)).count() == 0


def test_mixed_documents_are_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}


def test_mixed_documents_keep_null_ids_and_repeated_rows(spark):
    rows = [(None if i % 4 == 0 else i // 3, " ".join(f"w{i % 7}" for _ in range(i % 5)), "en", f"s{i % 2}") for i in range(240)]
    docs = documents(spark, rows)
    size = {s: sum(len(t.split()) for _, t, _, x in rows if x == s) for s in ("s0", "s1")}
    mixed = mixing.mixed_documents(docs, fan_in=8)
    assert mixed.columns == docs.columns
    found = [(r["doc_id"], r["text"], r["source"]) for r in mixed.collect()]
    want = []
    for r in mixing.mix(docs, fan_in=8).collect():
        want += [(r["doc_id"], r["source"], r["size"])] * (r["taken"] // r["size"] if r["size"] else 1)
    assert sorted(map(str, ((i, s, len(t.split())) for i, t, s in found))) == sorted(map(str, want))
    assert any(i is None and t for i, t, _ in found)
    for s, t in targets(size).items():
        assert t - 4 <= sum(len(x.split()) for _, x, y in found if y == s) <= t + 1  # one document in part at most
    again = [(r["doc_id"], r["text"], r["source"]) for r in mixing.mixed_documents(docs.repartition(3), fan_in=8).collect()]
    assert sorted(map(str, found)) == sorted(map(str, again))


@pytest.mark.parametrize("table", ["driver", "edge", "copies"])
def test_shards(spark, table):
    docs = {"edge": documents(spark), "driver": spark.read.parquet(f"{SF}/documents.parquet"), "copies": documents(spark, [(i, "same" if i % 3 == 0 else f"t{i % 150}", None, None) for i in range(400)])}[table]
    rows = sharding.shard(docs).toPandas()
    n = docs.count()
    assert len(rows) == n
    counts = rows.groupby("shard").size().reindex(range(16), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = sorted(len((r["text"] or "").encode()) + 1 for r in docs.select("text").collect())
    assert sorted(rows["size"]) == sizes and set(rows["law"]) == {"rows"} and rows["grown_shard"].isna().all()
    if table != "edge":
        cut = sharding.cut_links(docs, sharding.shard(docs)).toPandas()
        assert (cut[cut.n <= 4].shards == 1).mean() > 0.8
        assert (cut.shards <= -(-cut.n // (n // 16)) + 15).all()


def test_shards_of_nothing(spark):
    assert sharding.shard(nothing(spark)).count() == 0


def plain_licences(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    found, places = {}, []
    for label, phrase in [*licences.BASE.items(), *((k, m) for k, (_, m) in licences.TEMPLATES.items())]:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        if at:
            found[label] = at
            places += at if label in licences.BASE else []
    base = sorted(k for k in found if k in licences.BASE)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(found))


def test_licences(spark):
    docs = documents(spark, [*ROWS, (11, "cc cc by by cc by, all all rights reserved", None, None), (12, "Released under the MIT License. by the mit license", None, None)])
    rows = licences.scan(docs).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    expected = sorted(((i, *plain_licences(t)) for i, t in texts), key=str)
    found = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in rows), key=str)
    assert found == expected
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[11] == 1.0 and 0.5 < score[12] <= 1.0 and score[1] == 0.0
    assert licences.scan(nothing(spark)).count() == 0


def test_licences_of_the_driver(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {tuple(r)[:7] for r in licences.scan(docs).collect()}
    assert found == {(r["doc_id"], *plain_licences(r["text"])) for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - {"op9_jaccard"}))
def test_sql(spark, name):
    same(spark, "/root/testdata/sf0.01", queries.QUERIES[name], queries.SQL[name])


def test_tables_are_there():
    assert duck(SF).sql("select count(*) from documents").fetchall()[0][0] >= 200
