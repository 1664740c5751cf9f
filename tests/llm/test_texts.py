"""Toxicity, language, BPE and the Jaccard join."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from fillgap.llm import bpe, common, jaccard, language, queries, toxicity, urls
from tests.duck import same
from tests.llm.edge import LONG, ROWS, documents, nothing


def test_grammar():
    hits = toxicity.hits_of(("chlla*",))
    assert toxicity.clause_matches("You are an idiot.", hits).tolist() == [1, 0, 0, 0, 1]
    assert toxicity.clause_matches("He said that they were idiots. Fine!", hits).tolist() == [0, 0, 0, 1, 0]
    assert toxicity.clause_matches("It is not stupid", hits).tolist() == [0, 0, 1, 0, 0]
    assert toxicity.clause_matches("I will kill you", hits).tolist() == [0, 1, 0, 0, 0]
    assert toxicity.clause_matches("They kill weeds. You rest", hits).tolist() == [0, 0, 0, 0, 0]
    assert toxicity.clause_matches("una chllando aqui", hits).tolist() == [1, 0, 0, 0, 0]
    assert toxicity.clause_matches(None, hits).tolist() == toxicity.clause_matches("", hits).tolist() == [0] * 5


def plain_matches(text, learned=()):
    """The grammar's rules read off each clause without any machine."""
    found = dict.fromkeys(toxicity.MATCHES, 0)
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        tokens = re.findall(r"[^\W\d_]+", clause)
        kinds = [toxicity.CLASS.get(t) or ("i" if any(t == x or x[-1] == "*" and t.startswith(x[:-1]) for x in learned) else "o") for t in tokens]
        marks = []
        for i, k in enumerate(kinds):
            negated = any(x == "n" for x in kinds[max(0, i - 3) : i])
            marks.append(("negated" if negated else "reported" if "r" in kinds[:i] else None) if k in "it" else None)
        insult = threat = target = None  # where the last one of each kind that still waits stands
        for i, k in enumerate(kinds):
            insult, threat, target = (None if x is None or i - x > 4 else x for x in (insult, threat, target))
            insult, threat = (None if x is not None and i - x == 4 and k not in "y" else x for x in (insult, threat))
            if k == "i":
                near = target is not None and i - target < 4
                found[marks[i] or "insults"] += 1
                found["aimed"] += near and marks[i] is None
                insult = i if marks[i] is None and not near else None
            elif k == "t":
                threat = i
            elif k == "y":
                if threat is not None and i - threat < 4:
                    found[marks[threat] or "threats"] += 1
                elif insult is not None and i - insult < 4:
                    found["aimed"] += 1
                insult = threat = None
                target = i
    return [found[m] for m in toxicity.MATCHES]


def test_grammar_against_plain_rules():
    r = random.Random(5)
    words = "idiot stupid kill hurt you them not never said claimed chllando the a weather today house".split()
    hits = toxicity.hits_of(("chlla*",))
    for _ in range(3000):
        text = " ".join(r.choice(words) + r.choice(["", "", "", ",", ".", "!"]) for _ in range(r.randint(0, 14)))
        assert toxicity.clause_matches(text, hits).tolist() == plain_matches(text, ("chlla*",)), text


def test_clauses_are_scored(spark):
    model = toxicity.Model(("chlla*",), toxicity.PRIOR)
    long = "Fine weather. " * 4000 + "You idiot, I will kill you! " + "It is not stupid. " * 30
    rows = [*ROWS, (20, long, None, None), (20, long, None, None), (None, "He said: chllando. She claimed they are morons", None, None)]
    found = toxicity.clauses(documents(spark, rows), model).collect()
    hits = toxicity.hits_of(model.terms)
    want = []
    for i, text, *_ in rows:
        for k, clause in enumerate(re.split(r"[.!?;:\n]+", (text or "").lower())):
            n = plain_matches(clause, model.terms)
            if any(n):
                want.append((i, k, clause, *n, n[0] + n[1] + n[2] / 8 + n[3] / 4 + n[4] / 2))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str) and len(want) == 2 * 31 + 2
    strongest = max(r["clause_score"] for r in found if r["doc_id"] == 20)
    assert strongest == 1 + 1 + 0.5 and toxicity.features_of(long, hits)[-1] == pytest.approx(math.log1p(strongest))
    assert toxicity.clauses(nothing(spark), model).count() == 0


def test_marked_matches_cancel_nothing(spark):
    model = toxicity.Model((), toxicity.PRIOR)
    direct = "idiot here. " * 50
    rows = spark.createDataFrame([(0, direct), (1, direct + "It is not stupid. " * 500 + "She said moron. " * 500), (2, "It is not stupid. She said moron.")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert score[0] > 0.9 and score[1] > 0.9 and score[2] < 0.5


def test_terms_are_learned_evenly(spark):
    """No row count changes the rule: with more rows of the same kind the same terms are found."""
    r = random.Random(3)
    plain = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    for n in (60, 180, 220, 600):
        rows = []
        for i in range(n):
            words = [r.choice(plain) for _ in range(60)]
            if i % 4 == 0:
                for k in range(4):
                    words.insert(r.randrange(60), "zorg" + r.choice(plain)[:3])
            rows.append((" ".join(words), int(i % 4 == 0)))
        terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, label int"))
        assert any(t.rstrip("*").startswith("zorg") for t in terms) and all(t.startswith("zorg") for t in terms), (n, terms)


def is_prose(text):
    """Of 20 different words at least, and of letters and spaces for the most part; junk that carries a label says nothing to a reader."""
    return len(set(re.findall(r"[^\W\d_]+", text.lower()))) >= 20 and sum(c.isalpha() or c.isspace() for c in text) >= 0.88 * len(text)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    texts = docs.select("doc_id", "text").toPandas().set_index("doc_id").text
    toxic = rows[rows.toxic == 1]
    readable = toxic.doc_id.map(lambda i: is_prose(texts[i]))
    print("held-out toxic documents found:", (toxic.predicted == 1).sum(), "of", len(toxic), "; prose:", (toxic[readable].predicted == 1).sum(), "of", readable.sum())
    assert readable.mean() > 0.85 and (toxic[readable].predicted == 1).mean() > 0.95 and (rows[rows.toxic == 0].predicted == 0).mean() > 0.99
    assert (toxic.predicted == 1).mean() > 0.9  # with those that carry the label and hold tables of symbols or a word over and over


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark), labels)
    rows = toxicity.score(documents(spark), model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.score(nothing(spark), toxicity.fit(nothing(spark), labels)).count() == 0
    assert toxicity.without_toxic(documents(spark), model).columns == documents(spark).columns


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97


def plain_bundle(text):
    """A document's vector, n-gram by n-gram."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    letters = " " + " ".join(letters.split()) + " "
    if not letters.strip():
        return None
    total = np.zeros(language.DIMENSIONS)
    for i in range(len(letters) - 2):
        total += np.prod([np.roll(language.letter_vector(ord(c)), 2 - k) for k, c in enumerate(letters[i : i + 3])], axis=0)
    return total


def test_language_against_plain_vectors(spark):
    docs = documents(spark, [x for x in ROWS if x[1] is None or len(x[1]) < 1000])
    rows = docs.select("doc_id", "text", "lang").collect()
    sums = {}
    for r in rows:
        v = plain_bundle(r["text"])
        if r["lang"] and r["doc_id"] is not None and v is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            sums[r["lang"]] = sums.get(r["lang"], 0) + v / np.linalg.norm(v)
    expected = []
    for r in rows:
        v = plain_bundle(r["text"])
        cos = {lang: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for lang, p in sums.items()} if v is not None else {}
        best = max(sorted(cos), key=cos.get) if cos else "und"
        expected.append((r["doc_id"], best, round(max(0.0, cos.get(best, 0.0)), 6)))
    found = [(r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in language.predict(docs, language.fit(docs)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))


def test_shares_never_vanish(spark):
    """Samples of any number of rows keep their size: no language and no verdict gets lost."""
    n = spark.createDataFrame([(10**12,), (1_000,), (10**17,)], "n long").select("n", language.share_of(F.col("n"), 1_500).alias("s")).collect()
    assert {r["n"]: r["s"] for r in n} == {10**12: 1.5e-9, 1_000: 1.0, 10**17: 1.5e-14}
    shares = urls.sample_shares({"allow": 10**12, "block": 10**4}, 20_000)
    assert 1.9e4 < shares["allow"] * 10**12 < 2.1e4 and shares["block"] == 0.2
    drawn = spark.range(100_000).select(common.drawn(F.lit(0.01), "id", seed=1).cast("int").alias("d"), common.drawn(F.lit(1.0), "id", seed=1).cast("int").alias("e"))
    assert 800 < drawn.agg(F.sum("d")).first()[0] < 1_200 and drawn.agg(F.sum("e")).first()[0] == 100_000


def test_language_edges(spark):
    docs = documents(spark)
    model = language.fit(docs)
    rows = language.predict(docs, model).collect()
    assert len(rows) == len(ROWS) and set(model.langs) <= {"en", "de"}
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {2, 3, 4} and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(nothing(spark))).collect()} == {"und"}
    assert language.predict(nothing(spark), model).count() == 0
    assert language.in_known_language(docs, model).columns == docs.columns


def expected_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    out = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return [(len(i), " ".join(map(str, i)), t.decode(i, skip_special_tokens=False)) for i in out]


def test_bpe(spark):
    more = ["don't'S 'Tis 'rest ''ll", "a_b__c 1234 x²y ªº", "tab\tnew\nline\r\n", "ÀÉ ß × ÷ µ", "<|startoftext|> A <|endoftext|>!", "<|not|> 'd", "a\u00a0b\u3000c\u0085d", "ΑΣ ας", "e\u0301", "   "]
    docs = documents(spark, ROWS + [(100 + i, x, None, None) for i, x in enumerate(more)])
    path = public_tokenizers.path(queries.WORD_BPE)
    rows = bpe.encode_decode(docs, path).collect()
    texts = docs.select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(str((r["doc_id"], *e)) for r, e in zip(texts, expected_ids([r["text"] for r in texts]), strict=True))
    assert bpe.encode_decode(nothing(spark), path).count() == 0
    each = spark.createDataFrame([(1, k, int(i)) for k, i in enumerate(expected_ids([ROWS[0][1]])[0][1].split())], "doc_id long, pos int, id int")
    assert bpe.decode(each, path).first()["decoded"] == expected_ids([ROWS[0][1]])[0][2]


def plain_classes(rows, n=5):
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((i, {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if i is not None else None) for k, (i, s) in enumerate(sets)), key=str)


def variants():
    """Texts at all distances around the threshold, chains of them, and many documents with one passage."""
    base = [f"w{i}" for i in range(120)]
    out = []
    for k in range(30):
        words = list(base)
        for j in range(k):
            words[(j * 17) % 120] = f"z{k}x{j % 7}"
        out.append(" ".join(words))
        out.append(" ".join(base[k : k + 60]))
    passage = " ".join(f"p{i}" for i in range(60))
    out += [f"{passage} " + " ".join(f"own{k}w{i}" for i in range(50)) for k in range(25)]
    out += ["one two", "one two", "One TWO", "one two three four five", "one two three four five six", "a b", " ", "\t\n"]
    return out


def test_jaccard_around_the_threshold(spark):
    docs = documents(spark, [(i + 10, t, None, None) for i, t in enumerate(variants())] + [(5, LONG, None, None), (4, LONG + " more", None, None), (None, "one two", None, None), (3, None, None, None)])
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = sorted(map(tuple, jaccard.classes(docs).collect()), key=str)
    assert found == plain_classes(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {c for _, _, c in found if c is not None}


def test_jaccard_of_halves_that_agree(spark, monkeypatch):
    """Unlike sets whose fingerprints agree in one half stay apart."""
    whole = jaccard.fingerprint
    monkeypatch.setattr(jaccard, "fingerprint", lambda grams: (whole(grams)[0] % 5, whole(grams)[1]))
    docs = documents(spark, [(i + 10, t, None, None) for i, t in enumerate(variants())])
    found = sorted(map(tuple, jaccard.classes(docs).collect()), key=str)
    assert found == plain_classes([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_jaccard_of_long_lists(spark, monkeypatch):
    """Lists that are dealt into many cells and hot elements that are dealt by vertex lose no link."""
    monkeypatch.setattr(jaccard, "CELL", 3)
    monkeypatch.setattr(jaccard, "HOT", 2)
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(variants())])
    found = sorted(map(tuple, jaccard.classes(docs, stars=1, tries=1).collect()), key=str)
    assert found == plain_classes([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_cells_meet_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 4)
    rows = [(1, v, 100, 0, 0 if v < 10 else v) for v in range(30)] + [(2, v, 100, 0, v) for v in range(3)]
    cells = jaccard.in_cells(spark.createDataFrame(rows, "hash long, vertex long, n long, place long, label long"))
    found = [tuple(r) for r in cells.withColumn("b", F.lit(0)).groupBy("b").applyInArrow(jaccard._crossing(75), "a long, b long").collect()]
    expected = [(a, b) for a in range(30) for b in range(a + 1, 30) if not (a < 10 and b < 10)] + [(a, b) for a in range(3) for b in range(a + 1, 3)]
    assert sorted(set(found)) == sorted(set(expected))
    assert cells.groupBy("hash", "i", "j", "of").count().agg(F.max("count")).first()[0] <= 24


def plain_one_of_each(rows):
    """The rows that stay, as (doc_id, text); of rows alike in both one."""
    classes = plain_classes([(i, t) for i, t in rows])
    least = {c for _, _, c in classes if c is not None}
    keep = []
    for i, t in rows:
        if i is None or not (t or "").split():
            keep.append((i, t))
    seen = set()
    for i, t in rows:
        if i is not None and (t or "").split() and i in least and (i, t) not in seen:
            seen.add((i, t))
            keep.append((i, t))
    return keep


def test_one_of_each_with_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(7, a), (7, a), (7, b), (3, b), (3, b + " end"), (9, c), (9, c), (11, c), (None, a), (None, a), (5, None), (5, ""), (12, "x y"), (1, "x y"), (20, None)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect()]
    # 3 leads b's class, 9 leads c's, 7 leads a's alone, and 1 leads "x y"
    expected = [(7, a), (3, b), (9, c), (1, "x y"), (None, a), (None, a), (5, None), (5, ""), (20, None)]
    loose = sorted((i, t if t != b + " end" else b) for i, t in kept if i is not None and t)
    assert loose == sorted((i, t) for i, t in expected if i is not None and t)
    assert sorted(map(str, (x for x in kept if x[0] is None or not x[1]))) == sorted(map(str, (x for x in expected if x[0] is None or not x[1])))
    assert jaccard.one_of_each(nothing(spark)).count() == 0


def test_jaccard_of_nothing(spark):
    assert jaccard.classes(nothing(spark)).count() == 0


def test_jaccard_sql(spark):
    same(spark, "/root/testdata/sf0.001", queries.QUERIES["op9_jaccard"], queries.SQL["op9_jaccard"])
