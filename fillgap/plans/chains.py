"""Queries on chains and on nets made of them. The placement itself is no SQL; the tests hold it against single positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgap.functions.ordering import is_haplotype
from fillgap.operators import chain, construct
from fillgap.plans import fixtures
from fillgap.plans.oracle import BLOCKS
from fillgap.plans.registry import QUERIES, Query, query
from fillgap.sources import chain_text, sizes


@query(f"""{BLOCKS} SELECT chain_id, CAST(number - 1 AS INTEGER) AS number, reference_start + CAST(coalesce(sum(size + gr) OVER w, 0) AS BIGINT) AS reference_start, reference_start + CAST(coalesce(sum(size + gr) OVER w, 0) AS BIGINT) + size AS reference_end,
query_start + CAST(coalesce(sum(size + gq) OVER w, 0) AS BIGINT) AS query_start, query_start + CAST(coalesce(sum(size + gq) OVER w, 0) AS BIGINT) + size AS query_end
FROM blocks JOIN chains USING (chain_id) WINDOW w AS (PARTITION BY chain_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def chain_blocks(spark, sf_dir):
    return chain.exploded_blocks(fixtures.chains_orders(spark, sf_dir))


@query(f"""{BLOCKS} SELECT chain_id, input_ordinal, score, query_name AS primary_name, CASE WHEN query_strand = '-' THEN 100000 - query_end ELSE query_start END AS primary_start,
CASE WHEN query_strand = '-' THEN 100000 - query_start ELSE query_end END AS primary_end, reference_start AS other_start, reference_end AS other_end, total_aligned FROM numbered""")
def chain_projection(spark, sf_dir):
    return chain.projected(fixtures.chains_orders(spark, sf_dir), chain.QUERY).select("chain_id", "input_ordinal", "score", "primary_name", "primary_start", "primary_end", "other_start", "other_end", "total_aligned")


@query(f"{BLOCKS} SELECT chain_id, input_ordinal, score, reference_name, query_name FROM numbered WHERE score >= 2000 AND query_name NOT LIKE '%\\_alt%' ESCAPE '\\'")
def chain_candidates(spark, sf_dir):
    return chain.candidates(fixtures.chains_orders(spark, sf_dir)).select("chain_id", "input_ordinal", "score", "reference_name", "query_name")


@query("SELECT o_orderkey AS chain_id, CAST(round_even(o_totalprice * 0.5, 0) AS BIGINT) AS displayed FROM orders")
def display_score(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain_id"), chain.display_score(F.col("o_totalprice") * 0.5).alias("displayed"))


def _constructed(side: str, options: construct.NetOptions = construct.NetOptions()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = construct.build(fixtures.chains_orders(spark, sf_dir), side, options)
        return out.select("net_id", "pos", "depth", "parent", "kind", "chain_id", "start", "end", "other_start", "other_end", "displayed", "aligned")

    return run


QUERIES["net_construct_reference"] = _constructed(chain.REFERENCE)
QUERIES["net_construct_query"] = _constructed(chain.QUERY)
QUERIES["net_construct_cleaner"] = _constructed(chain.REFERENCE, construct.CLEANER)


#: What is wrong with which chains: the first that fits, in the order of the checks.
WRONG = f"""{BLOCKS}, bad AS (
  SELECT *, CASE WHEN input_ordinal % 2 = 1 AND chain_id % 101 = 7 THEN 'UnsortedScores' WHEN chain_id % 103 = 7 THEN 'InvalidReferenceStrand' WHEN reference_name = 'chr3' THEN 'MissingSequence'
    WHEN query_name = 'q4' THEN 'SizeMismatch' WHEN chain_id % 107 = 7 OR chain_id % 109 = 7 OR chain_id % 113 = 7 OR chain_id % 127 = 7 THEN 'MalformedBlocks' END AS kind,
    CASE WHEN chain_id % 107 = 7 THEN 'no blocks' WHEN chain_id % 109 = 7 THEN 'an empty block' WHEN chain_id % 113 = 7 THEN 'a gap after the last block' ELSE 'blocks end elsewhere than the header says' END AS why FROM numbered
)"""


@query(f"{WRONG} SELECT input_ordinal, chain_id, kind, CASE kind WHEN 'MalformedBlocks' THEN why END AS reason FROM bad WHERE kind IS NOT NULL")
def chain_errors(spark, sf_dir):
    """Chains broken by rules on their ids, checked against sizes that lack a sequence and differ for another."""
    chains, i = fixtures.chains_orders(spark, sf_dir), F.col("chain_id")
    empty = F.transform("blocks", lambda b, k: b.withField("size", F.when(k == 0, 0).otherwise(b["size"])))
    last = F.size("blocks") - 1
    late = F.transform("blocks", lambda b, k: b.withField("gap_query", F.when(k == last, 5).otherwise(b["gap_query"])).cast("struct<size:bigint,gap_reference:bigint,gap_query:bigint>"))
    blocks = F.when(i % 107 == 7, F.array().cast("array<struct<size:bigint,gap_reference:bigint,gap_query:bigint>>")).when(i % 109 == 7, empty).when(i % 113 == 7, late).otherwise(F.col("blocks"))
    chains = chains.withColumns({"blocks": blocks, "reference_strand": F.when(i % 103 == 7, "-").otherwise("+"), "query_end": F.when(i % 127 == 7, F.col("query_end") + 1).otherwise(F.col("query_end"))})
    # Scores fall by two from chain to chain; the one before a chain that has to rise falls by three more.
    up = chains.select((F.col("input_ordinal") - 1).alias("input_ordinal"), ((i % 101 == 7) & (F.col("input_ordinal") % 2 == 1)).alias("rises"))
    chains = chains.join(up, "input_ordinal", "left").withColumn("score", -2 * F.col("input_ordinal") - F.when(F.coalesce("rises", F.lit(False)), 3).otherwise(0))
    known = chains.select(F.lit("reference").alias("side"), F.col("reference_name").alias("name")).where("name <> 'chr3'").union(chains.select(F.lit("query"), "query_name")).distinct()
    known = known.withColumn("size", F.when(F.col("name") == "q4", 100_001).otherwise(100_000))
    found = chain.chain_errors(chains, known)
    return found.select("input_ordinal", "chain_id", "kind", F.when(F.col("kind") == "MalformedBlocks", F.col("reason")).alias("reason"))


@query(f"{BLOCKS} SELECT query_name AS name, count(*) AS chains, min_by(chain_id, input_ordinal) AS first_chain, max_by(chain_id, input_ordinal) AS last_chain FROM numbered GROUP BY query_name")
def chains_by_sequence(spark, sf_dir):
    return chain.by_sequence(fixtures.chains_orders(spark, sf_dir), chain.QUERY)


@query(f"{BLOCKS} SELECT chain_id, query_name, query_name LIKE '%\\_alt%' ESCAPE '\\' AS haplotype FROM numbered")
def chain_haplotypes(spark, sf_dir):
    return fixtures.chains_orders(spark, sf_dir).select("chain_id", "query_name", is_haplotype(F.col("query_name")).alias("haplotype"))


@query(f"""{BLOCKS} SELECT n.chain_id, n.input_ordinal, n.score, n.reference_name, n.reference_start, n.reference_end, n.query_name, n.query_strand, n.query_start, n.query_end, count(*) AS n_blocks, CAST(sum(b.size) AS BIGINT) AS aligned,
CAST(sum(b.gr) AS BIGINT) AS gap_reference, CAST(sum(b.gq) AS BIGINT) AS gap_query FROM numbered n JOIN blocks b USING (chain_id) GROUP BY ALL""")
def chain_text_parsed(spark, sf_dir):
    """The chains written as lines of a chain file, with comments and blank lines between, and parsed back."""
    chains, _ = chain_text.parse_chains(fixtures.chain_lines(spark, sf_dir))
    gap = lambda c: F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b[c]).alias(c)
    return chains.select(
        F.col("chain_id").cast("long").alias("chain_id"), "input_ordinal", "score", "reference_name", "reference_start", "reference_end", "query_name", "query_strand", "query_start", "query_end",
        F.size("blocks").cast("long").alias("n_blocks"), chain.total_aligned(F.col("blocks")).alias("aligned"), gap("gap_reference"), gap("gap_query"),
    )


@query("SELECT 'reference' AS side, CAST(row_number() OVER (ORDER BY n_nationkey) * 2 - 1 AS INTEGER) AS ordinal, replace(n_name, ' ', '_') AS name, CAST(n_nationkey * 1000 + 17 AS BIGINT) AS size FROM nation")
def sizes_parsed(spark, sf_dir):
    """Lines of a sizes file, a comment before each; the ordinal is the line's."""
    nation = fixtures.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    line = F.explode(F.array(F.struct(F.lit(0).alias("j"), F.concat(F.lit("# "), F.col("n_name")).alias("value")), F.struct(F.lit(1).alias("j"), F.concat(F.lit(" "), F.col("n_name"), F.lit(" \t"), (F.col("k") * 1000 + 17).cast("string")).alias("value"))))
    named = nation.withColumn("n_name", F.translate("n_name", " ", "_"))
    lines = named.select("k", line.alias("x")).select(F.lit(0).alias("file_id"), F.lit(0).cast("long").alias("part"), (2 * F.col("k") + F.col("x.j")).alias("place"), "x.value")
    return sizes.parse_sizes(lines, "reference")
