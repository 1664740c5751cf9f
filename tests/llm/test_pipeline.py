"""The pipeline against its stages done plainly, on a small table."""

import os
from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry
from fillgap.llm import language, mixing, toxicity
from fillgap.llm.common import cut, shared_dir
from tests.llm.edge import ROWS, documents, nothing
from tests.llm.test_native import targets
from tests.llm.test_texts import expected_ids, plain_classes, plain_one_of_each


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    good = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0").collect()}
    docs = docs.where(docs["doc_id"].isin(sorted(good)))
    known = {r["doc_id"] for r in language.predict(docs, language.fit(docs)).where("lang_pred <> 'und' and score >= 0.02").collect()}
    docs = docs.where(docs["doc_id"].isin(sorted(known)))
    firsts = {c for _, _, c in plain_classes([(r["doc_id"], r["text"]) for r in docs.collect()])}
    docs = docs.where(docs["doc_id"].isin(sorted(firsts)))
    mixed = mixing.mixed_documents(docs).collect()
    expected = sorted(str((r["doc_id"], *e)) for r, e in zip(mixed, expected_ids([r["text"] for r in mixed]), strict=True))
    assert sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, d).collect()) == expected


def key(rows):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in rows)


def test_edges_through_all_stages(spark):
    """Null ids, repeated rows, null and empty texts and clashing columns, stage by stage against plain versions."""
    d = "/root/testdata/sf0.001"
    a = " ".join(f"the and word{i} of" for i in range(30))
    more = [(20, a, "en", "a"), (20, a, "en", "a"), (21, a + " more", "en", None), (None, a, "en", "a"), (None, None, "en", "b"), (100022, "you idiot! you stupid moron, you scum, you are trash", "en", "a"), (23, "  ", "en", "a")]
    docs, columns = documents(spark, ROWS + more), documents(spark).columns
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(docs)
        before, out = docs.collect(), cut(stage(spark, docs, d))
        after = out.collect()
        if name == "toxicity":
            assert out.columns == columns
            model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
            bad = {r["text"] for r in docs.withColumn("s", model.score(docs["text"])).where("s >= 0.5").collect()}
            assert any("idiot" in t for t in bad) and key(after) == key(r for r in before if r["text"] not in bad)
        elif name == "language ID":
            assert out.columns == columns
            model = language.fit(docs)
            known = {r["text"] for r in docs.join(language.predict(docs, model).where("lang_pred <> 'und' and score >= 0.02").select("doc_id").distinct(), "doc_id").collect()}
            texts = {r["text"] for r in after}
            assert texts >= {t for t in known if t} and not any(t is None or not any(c.isalpha() for c in t) for t in texts)
            assert key(after) == key(r for r in before if r["text"] in texts)
        elif name == "n-gram Jaccard join":
            assert out.columns == columns
            assert Counter((r["doc_id"], r["text"]) for r in after) == Counter(plain_one_of_each([(r["doc_id"], r["text"]) for r in before]))
        elif name == "mixing sources":
            assert out.columns == columns and set(key(after)) <= set(key(before))
            assert all(n <= 2 * key(before)[k] for k, n in key(after).items())
            size = {}
            for r in before:
                size[r["source"]] = size.get(r["source"], 0) + len((r["text"] or "").split())
            for s, t in targets(size).items():
                words = [len((r["text"] or "").split()) for r in before if r["source"] == s]
                assert t - max(words) - 1 <= sum(len((r["text"] or "").split()) for r in after if r["source"] == s) <= t + 1
        else:
            assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
            assert sorted(str(tuple(r)) for r in after) == sorted(str((r["doc_id"], *e)) for r, e in zip(before, expected_ids([r["text"] for r in before]), strict=True))
        docs = out
    assert len(after) > 3


def test_nothing_through_all_stages(spark):
    shared = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    out = corpus_pipeline.run_on(spark, nothing(spark), "/root/testdata/sf0.001")
    assert out.count() == 0
    left = set(os.listdir(shared)) - before  # the last stage's table alone
    assert len(left) == 1 and all(left.copy().pop() in f for f in out.inputFiles())


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "n-gram Jaccard join", "mixing sources", "BPE encoding and decoding"]
    names = entry.queries()
    assert "pipeline" in names and all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 11))
