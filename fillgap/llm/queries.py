"""The queries of this subpackage over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgap.llm import ann, bpe, clustering, exact_topk, hyperminhash, jaccard, language, licences, mixing, ranked, sharding, toxicity, urls
from fillgap.llm.common import table

WORD_BPE = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), digests=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.classes(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_language, op3_nearest, op4_shards, op5_bpe, op6_licences, op7_urls, op8_exact_topk, op9_jaccard, op10_mix, op11_ranked, op12_clusters, op13_hyperminhash)
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _licences_sql() -> str:
    """Places of every phrase by comparing slices of words, and the templates' shares of weight from counts over all documents."""
    phrases = {label: phrase.split() for label, phrase in [*licences.BASE.items(), *((k, must) for k, (_, must) in licences.TEMPLATES.items())]}
    names = {label: f"p{i}" for i, label in enumerate(sorted(phrases))}
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    places = ", ".join(f"CASE WHEN list_has_all(ws, {quoted(p)}) THEN list_filter(range(1, len(ws) - {len(p) - 2}), lambda i: ws[i:i + {len(p) - 1}] = {quoted(p)}) ELSE [] END AS {names[label]}" for label, p in phrases.items())
    shares = []
    for label, (template, must) in licences.TEMPLATES.items():
        words, shift = template.split(), next(i for i in range(99) if template.split()[i:][: len(must.split())] == must.split())
        weight = lambda w: f"(SELECT weight FROM weights WHERE word = '{w}')"
        hit = " + ".join(f"CASE WHEN i + {k - shift} >= 1 AND ws[i + {k - shift}] = '{w}' THEN {weight(w)} ELSE 0 END" for k, w in enumerate(words))
        shares.append(f"SELECT doc_id, part, least(({hit}) / ({' + '.join(weight(w) for w in words)}), 1) AS share FROM (SELECT doc_id, part, ws, unnest({names[label]}) AS i FROM found)")
    base = " || ".join(names[x] for x in licences.BASE)
    says = lambda labels: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN len({names[x]}) > 0 THEN '{x}' END" for x in sorted(labels)) + "], lambda x: x IS NOT NULL), ',')"
    return f"""
WITH w AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS part, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents
), weights AS MATERIALIZED (
  SELECT word, ln(((SELECT count(*) FROM w) + 1) / (count(DISTINCT part) + 1)) + 1 AS weight FROM (SELECT unnest({quoted(licences.vocabulary())}) AS word) LEFT JOIN (SELECT part, unnest(ws) AS word FROM w) USING (word) GROUP BY word
), found AS MATERIALIZED (SELECT *, {places} FROM w), shares AS ({" UNION ALL ".join(shares)}),
best AS (SELECT part, max(share) AS share FROM shares GROUP BY part)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len({base}) AS BIGINT) AS n_base, list_min({base}) - 1 AS first_word, list_max({base}) - 1 AS last_word,
  {says(licences.BASE)} AS base_labels, {says(phrases)} AS labels, round(CAST(CASE WHEN len({base}) > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE), 9) AS score
FROM found LEFT JOIN best USING (part)
"""


def _jaccard_sql(n: int, percent: int, more: str = "") -> str:
    """Classes by all shared n-grams and a recursive walk over the links."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')) END) AS grams FROM w
), s AS (SELECT doc_id, unnest(grams) AS gram FROM g),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (
  SELECT x, y FROM shared JOIN g a ON a.doc_id = x JOIN g b ON b.doc_id = y WHERE 100 * n >= {percent} * (len(a.grams) + len(b.grams) - n)
), ways AS (SELECT x, y FROM linked UNION SELECT y, x FROM linked),
reach AS (SELECT doc_id, doc_id AS other FROM g UNION SELECT r.doc_id, w.y FROM reach r JOIN ways w ON w.x = r.other)
SELECT g.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, min(other) AS component_id{more} FROM g JOIN reach USING (doc_id) GROUP BY g.doc_id, grams
"""


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds written out; all numbers of these vectors stay below 2^53."""
    squared = lambda a, b: f"(list_inner_product({a}, {a}) - 2 * list_inner_product({a}, {b}) + list_inner_product({b}, {b}))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT part, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT part, c, {squared('v.e', 't.e')} AS d FROM v, c{i} t) GROUP BY part)")
        if i < rounds:
            means = f"SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.c, unnest(e) AS x, unnest(range(1, 65)) AS i FROM a{i} a JOIN v USING (part)) GROUP BY c, i"
            moved = f"SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS e FROM ({means}) GROUP BY c"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.e, o.e) AS e FROM c{i} o LEFT JOIN ({moved}) m ON m.c = o.c)")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS part, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v ORDER BY h NULLS LAST, e LIMIT {k})
), {", ".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(t.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (part) JOIN c{rounds} t ON t.c = a.c
"""


TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


SQL = {
    "op6_licences": _licences_sql(),
    "op8_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op9_jaccard": _jaccard_sql(5, 75),
    "op11_ranked": f"""
WITH w AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS part, {TERMS} AS ws FROM documents),
total AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS words FROM w WHERE len(ws) > 0),
asked AS MATERIALIZED (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
times AS MATERIALIZED (SELECT part, term, count(*) AS tf FROM (SELECT part, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM asked) GROUP BY part, term),
weights AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM times, total GROUP BY term, docs),
hits AS (SELECT part, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(ws) * docs) // words))) AS impact FROM times JOIN weights USING (term) JOIN w USING (part), total),
scores AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN hits USING (term) JOIN w USING (part) GROUP BY item_id, doc_id, part),
ranks AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranks WHERE rank <= 50
""",
    "op12_clusters": _clusters_sql(),
    "op13_hyperminhash": _jaccard_sql(4, 80, ", min(other) = g.doc_id AS kept"),
}
