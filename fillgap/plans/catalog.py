"""Queries on trees, filters, intervals, statistics and merging, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgap.functions import intervals
from fillgap.operators import arrange, construct, context, interval, policies, scan, stats, tree, validate, view
from fillgap.operators.predicates import NetPredicate, presence_count, presence_mask
from fillgap.plans import fixtures
from fillgap.plans.oracle import FILES, NATURAL, NET, PROBE, filtered, merged
from fillgap.plans.registry import QUERIES, SQL, Query, query
from fillgap.schema import COORD_MAX

DEPTH = 2  # of net_orders
FILTERED = ["net_id", "root", "pos", "depth", "parent", "subtree_end", "kind", "chain_id", "reference_start"]


def _filter(name: str, predicate: NetPredicate, policy: str, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records, _, parts = fixtures.net(spark, sf_dir)
        records = records.select(*FILTERED, predicate.matches().alias("matches"))  # what is kept is written once
        out = policies.filter_records(records, F.col("matches"), policy, DEPTH, parts)
        return out.select("net_id", "pos", "kind", "depth", "parent", "chain_id", "reference_start")

    QUERIES[name] = run
    SQL[name] = filtered({policies.PRUNE: "prune", policies.RETAIN: "retain", policies.PROMOTE: "promote"}[policy], condition)


_filter("filter_prune", NetPredicate(min_score=100_000, kinds=["fill"]), policies.PRUNE, "kind = 'fill' AND alignment_score >= 100000")
_filter("filter_retain", NetPredicate(types=["nonSyn"], min_ali=40), policies.RETAIN, "net_type = 'nonSyn' AND aligned_bases >= 40")
_filter("filter_promote", NetPredicate(kinds=["fill"], min_score=20_000, max_score=200_000), policies.PROMOTE, "kind = 'fill' AND alignment_score BETWEEN 20000 AND 200000")
_filter("pred_chain_ids", NetPredicate(chain_ids=[7, 32, 1_000_005, 1_000_100]), policies.RETAIN, "chain_id IN (7, 32, 1000005, 1000100)")
_filter("pred_type", NetPredicate(types=["top", "syn"], strand="+"), policies.PROMOTE, "net_type IN ('top', 'syn') AND query_strand = '+'")
_filter("pred_overlap", NetPredicate(reference_overlap=(50_000, 900_000)), policies.PRUNE, "reference_start < 900000 AND 50000 < reference_end")
_filter("pred_attr_presence", NetPredicate(require_attributes=["aligned_bases"], forbid_attributes=["query_far"], max_ali=10), policies.PROMOTE, "aligned_bases IS NOT NULL AND aligned_bases <= 10")
_filter("pred_depth_size", NetPredicate(min_depth=0, max_depth=1, min_reference_size=100, max_reference_size=1_000), policies.PRUNE, "depth BETWEEN 0 AND 1 AND reference_size BETWEEN 100 AND 1000")
_filter("pred_query_names", NetPredicate(query_names=["q1", "q2", "q3", "1-URGENT"]), policies.RETAIN, "query_name IN ('q1', 'q2', 'q3', '1-URGENT')")

ROW = "net_id, pos, kind, depth"


@query(f"{NET} SELECT {ROW}, parent, subtree_end FROM net")
def tree_parent(spark, sf_dir):
    records, _, parts = fixtures.net(spark, sf_dir)
    inside = tree.topology(records.drop("parent", "subtree_end"), DEPTH, parts=parts)
    return inside.select("net_id", "pos", "kind", "depth", "parent", "subtree_end")


@query("""
WITH e AS (
  SELECT user_id AS net_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, CAST(CAST(floor(value) AS BIGINT) % 5 + 1 AS INTEGER) AS indent FROM events
) SELECT net_id, pos, indent, (SELECT max(b.pos) FROM e b WHERE b.net_id = a.net_id AND b.pos < a.pos AND b.indent < a.indent) AS parent FROM e a
""")
def tree_parent_irregular(spark, sf_dir):
    return tree.nested_by_indent(tree.with_roots(fixtures.net_events(spark, sf_dir), ["net_id"], "pos")).select("net_id", "pos", "indent", "parent")


@query(f"{NET} SELECT {ROW}, CAST(subtree_end - pos AS BIGINT) AS subtree_len, subtree_end > pos + 1 AS has_children FROM net WHERE parent IS NULL OR kind = 'gap'")
def tree_subtree(spark, sf_dir):
    rows = fixtures.net_orders(spark, sf_dir).where("parent is null or kind = 'gap'")
    return rows.select("net_id", "pos", "kind", "depth", tree.subtree_len().alias("subtree_len"), tree.has_children().alias("has_children"))


@query(f"""{NET} SELECT {ROW}, lag(pos) OVER w AS previous_sibling, lead(pos) OVER w AS next_sibling FROM net WINDOW w AS (PARTITION BY net_id, parent ORDER BY pos)""")
def tree_siblings(spark, sf_dir):
    records, _, parts, tops = fixtures.whole_net(spark, sf_dir)
    return tree.siblings(records, parts, tops).select("net_id", "pos", "kind", "depth", "previous_sibling", "next_sibling")


@query(f"""{NET} SELECT n.net_id, n.pos, min(c.pos) AS first_child, max(c.pos) AS last_child, count(c.pos) AS n_children FROM net n LEFT JOIN net c ON c.net_id = n.net_id AND c.root = n.root AND c.parent = n.pos GROUP BY ALL""")
def tree_children(spark, sf_dir):
    return tree.child_ends(fixtures.net_orders(spark, sf_dir)).select("net_id", "pos", "first_child", "last_child", "n_children")


@query(f"""{NET} SELECT n.net_id, n.pos, a.pos AS ancestor, a.kind AS ancestor_kind, CAST(n.depth - a.depth AS INTEGER) AS steps
FROM net n JOIN net a ON a.net_id = n.net_id AND a.root = n.root AND a.pos < n.pos AND n.pos < a.subtree_end WHERE n.query_name = 'q5'""")
def tree_ancestors(spark, sf_dir):
    records, _, parts = fixtures.net(spark, sf_dir)
    return tree.ancestors(records, records.where("query_name = 'q5'"), parts).select("net_id", "pos", "ancestor", "ancestor_kind", "steps")


@query(f"""{NET} SELECT n.net_id, n.pos, CASE WHEN n.depth = 2 THEN g.parent WHEN n.depth = 1 THEN n.parent END AS enclosing_fill,
CASE WHEN n.depth = 2 THEN n.parent END AS enclosing_gap FROM net n LEFT JOIN net g ON g.net_id = n.net_id AND g.root = n.root AND g.pos = n.parent""")
def tree_enclosing_fill(spark, sf_dir):
    records, _, parts = fixtures.net(spark, sf_dir)
    rows = tree.nearest_enclosing(records, F.col("kind") == "fill", {"pos": "enclosing_fill"}, DEPTH, parts)
    return tree.nearest_enclosing(rows, F.col("kind") == "gap", {"pos": "enclosing_gap"}, DEPTH, parts).select("net_id", "pos", "enclosing_fill", "enclosing_gap")


@query(f"""{NET}, ev AS (
  SELECT net_id, pos, kind, 'enter' AS event, pos AS place, 1 AS o, depth AS d FROM net UNION ALL SELECT net_id, pos, kind, 'leave', subtree_end, 0, -depth FROM net
) SELECT net_id, pos, kind, event, CAST(row_number() OVER (PARTITION BY net_id ORDER BY place, o, d) - 1 AS BIGINT) AS seq FROM ev""")
def tree_events(spark, sf_dir):
    return tree.events(fixtures.net_orders(spark, sf_dir)).select("net_id", "pos", "kind", "event", F.col("seq").cast("long").alias("seq"))


@query(f"{NET} SELECT {ROW}, reference_start FROM net WHERE kind = 'gap' AND subtree_end > pos + 1")
def child_gaps_with_fills(spark, sf_dir):
    return tree.gaps(fixtures.net_orders(spark, sf_dir)).where(tree.has_children()).select("net_id", "pos", "kind", "depth", "reference_start")


@query(f"""{NET}, t AS (SELECT min(pos) AS p FROM net WHERE net_id = 3 AND depth = 0 AND subtree_end > pos + 2)
SELECT CAST(n.pos - t.pos AS BIGINT) AS pos, CAST(n.parent - t.pos AS BIGINT) AS parent, n.depth, n.kind, n.reference_start, CAST(n.subtree_end - t.pos AS BIGINT) AS subtree_end
FROM net n JOIN net t ON t.net_id = 3 AND t.pos = (SELECT p FROM t) AND n.net_id = 3 AND n.pos >= t.pos AND n.pos < t.subtree_end""")
def clone_subtree(spark, sf_dir):
    records = fixtures.net_orders(spark, sf_dir)
    at = records.where("net_id = 3 and depth = 0 and subtree_end > pos + 2").agg(F.min("pos")).first()[0]
    return tree.clone_subtree(records, 3, -1 if at is None else at).select("pos", "parent", "depth", "kind", "reference_start", "subtree_end")


@query(f"""{NET} SELECT reference_name, pos, depth, kind, reference_start, reference_end, query_name, query_start, query_start + query_size AS query_end, coalesce(chain_id, -1) AS chain_id, coalesce(parent, -1) AS parent FROM net WHERE depth <= 1""")
def view_flat(spark, sf_dir):
    return view.flat(fixtures.net_orders(spark, sf_dir).where("depth <= 1"))


@query(f"""{NET} SELECT (SELECT count(*) FROM sec) AS nets, count(*) AS records, count(*) FILTER (kind = 'fill') AS fills, count(*) FILTER (kind = 'gap') AS gaps,
CAST(sum(reference_size) FILTER (kind = 'fill') AS BIGINT) AS reference_bases, CAST(sum(query_size) FILTER (kind = 'fill') AS BIGINT) AS query_bases, max(depth) AS max_depth,
count(DISTINCT query_name) AS distinct_query_names, count(DISTINCT chain_id) AS distinct_chain_ids FROM net""")
def stats_summary(spark, sf_dir):
    records, sections, _ = fixtures.net(spark, sf_dir)
    return stats.summary(records, sections)


@query(f"{NET} SELECT depth, count(*) AS records FROM net GROUP BY depth")
def stats_depth(spark, sf_dir):
    return stats.records_per_depth(fixtures.net_orders(spark, sf_dir))


@query(f"{NET} SELECT net_type, count(*) AS records FROM net WHERE net_type IS NOT NULL GROUP BY net_type")
def stats_types(spark, sf_dir):
    return stats.type_counts(fixtures.net_orders(spark, sf_dir))


@query(f"{NET} SELECT 'status' AS key, count(extra) AS occurrences FROM net")
def stats_extras(spark, sf_dir):
    return stats.unknown_attribute_names(fixtures.net_orders(spark, sf_dir))


def issues_of(net: str, before: str = NET) -> str:
    return f"""{before}, row AS MATERIALIZED (
  SELECT n.*, p.reference_start AS ps, p.reference_end AS pe, lag(n.reference_start) OVER w AS bs, lag(n.reference_end) OVER w AS be, lag(n.reference_size) OVER w AS bz
  FROM {net} n LEFT JOIN {net} p ON p.net_id = n.net_id AND p.root = n.root AND p.pos = n.parent WINDOW w AS (PARTITION BY n.net_id, n.parent ORDER BY n.pos)
), found AS MATERIALIZED (
  SELECT 'error' AS severity, 'reference-out-of-bounds' AS code, net_id, pos, '' AS detail, pos AS anchor, 1 AS rule FROM row WHERE reference_size <> 0 AND reference_end > 10000000
  UNION ALL SELECT 'warning', 'zero-sized-record', net_id, pos, '', pos, 2 FROM row WHERE reference_size = 0
  UNION ALL SELECT 'warning', 'child-outside-parent', net_id, pos, '', pos, 3 FROM row WHERE reference_start < ps OR reference_end > pe
  UNION ALL SELECT 'warning', 'fill-gap-alternation', net_id, pos, '', pos, 4 FROM row WHERE (kind = 'fill') <> (depth % 2 = 0)
  UNION ALL SELECT 'warning', 'missing-fill-id', net_id, pos, '', pos, 5 FROM row WHERE kind = 'fill' AND chain_id IS NULL
  UNION ALL SELECT 'warning', 'gap-has-id', net_id, pos, '', pos, 6 FROM row WHERE kind = 'gap' AND chain_id IS NOT NULL
  UNION ALL SELECT 'warning', 'negative-count', net_id, pos, 'reference_unsequenced', pos, 7 FROM row WHERE reference_unsequenced < 0
  UNION ALL SELECT 'warning', 'sibling-order', net_id, pos, '', coalesce(parent, -1), 8 FROM row WHERE reference_start < bs
  UNION ALL SELECT 'warning', 'sibling-overlap', net_id, pos, '', coalesce(parent, -1), 9 FROM row WHERE reference_size <> 0 AND bz <> 0 AND reference_start < be AND bs < reference_end
)"""


ISSUES = issues_of("net")


@query(f"{ISSUES} SELECT severity, code, net_id, pos, detail, anchor, rule FROM found")
def validate_all(spark, sf_dir):
    records, sections, parts, tops = fixtures.whole_net(spark, sf_dir)
    return validate.issues(records, sections, parts=parts, max_depth=DEPTH, tops=tops)


@query(f"{ISSUES} SELECT net_id, count(*) AS issues FROM found WHERE code = 'sibling-overlap' GROUP BY net_id")
def validate_sibling_overlap(spark, sf_dir):
    records, sections, parts, tops = fixtures.whole_net(spark, sf_dir)
    return validate.issues(records, sections, parts=parts, max_depth=DEPTH, tops=tops).where("code = 'sibling-overlap'").groupBy("net_id").agg(F.count(F.lit(1)).alias("issues"))


@query(f"{NET} SELECT CAST(row_number() OVER (ORDER BY {NATURAL}, net_id) - 1 AS BIGINT) AS rank, net_id, reference_name, record_count FROM sec")
def sort_sections_natural(spark, sf_dir):
    return arrange.sort_sections(fixtures.net(spark, sf_dir)[1]).select("rank", "net_id", "reference_name", "record_count")


@query(f"{NET} SELECT CAST(row_number() OVER (ORDER BY reference_name, net_id) - 1 AS BIGINT) AS rank, net_id, reference_name, record_count FROM sec")
def sort_sections_lex(spark, sf_dir):
    return arrange.sort_sections(fixtures.net(spark, sf_dir)[1], arrange.LEXICOGRAPHIC).select("rank", "net_id", "reference_name", "record_count")


@query(f"""{NET}, k AS (
  SELECT net_id, root, pos AS old, depth, kind, reference_start, reference_size, query_name, query_start, chain_id,
    row_number() OVER (PARTITION BY net_id, parent ORDER BY reference_start, reference_size, kind, query_name, query_start, pos) AS r, parent FROM net
), path AS (
  SELECT k.*, CASE k.depth WHEN 0 THEN k.r WHEN 1 THEN p.r ELSE g.r END AS r0, CASE k.depth WHEN 0 THEN 0 WHEN 1 THEN k.r ELSE p.r END AS r1, CASE WHEN k.depth = 2 THEN k.r ELSE 0 END AS r2
  FROM k LEFT JOIN k p ON p.net_id = k.net_id AND p.old = k.parent LEFT JOIN k g ON g.net_id = k.net_id AND g.old = p.parent
) SELECT net_id, CAST(row_number() OVER (PARTITION BY net_id ORDER BY r0, r1, r2) - 1 AS BIGINT) AS pos, depth, kind, reference_start, reference_size, query_name, query_start, chain_id FROM path""")
def sort_records(spark, sf_dir):
    records, _, parts, tops = fixtures.whole_net(spark, sf_dir)
    return arrange.sort_records(records, DEPTH, parts, tops).select("net_id", "pos", "depth", "kind", "reference_start", "reference_size", "query_name", "query_start", "chain_id")


def three_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of three files: all, the even ones, and those below 5 with one of another name."""
    s = fixtures.net(spark, sf_dir)[1].select("net_id", "reference_name", "record_count")
    renamed = F.when(F.col("net_id") == 0, "chrNew").otherwise(F.col("reference_name"))
    first = s.withColumn("file_id", F.lit(0))
    second = s.where("net_id % 2 = 0").withColumns({"file_id": F.lit(1), "record_count": F.col("record_count") + 1})
    third = s.where("net_id < 5").withColumns({"file_id": F.lit(2), "record_count": F.col("record_count") + 2, "reference_name": renamed})
    return first.unionByName(second).unionByName(third)


def _merge(duplicates: str) -> Query:
    return lambda spark, sf_dir: arrange.merge_sections(three_files(spark, sf_dir), duplicates).select("rank", "file_id", "net_id", "reference_name", "record_count")


for _name, _how in (("all", arrange.KEEP_ALL), ("first", arrange.KEEP_FIRST), ("last", arrange.KEEP_LAST)):
    QUERIES[f"merge_keep_{_name}"], SQL[f"merge_keep_{_name}"] = _merge(_how), merged(_name)


@query(f"{FILES} SELECT CAST(row_number() OVER (ORDER BY {NATURAL}, file_id, net_id) - 1 AS BIGINT) AS rank, file_id, net_id, reference_name, record_count FROM files")
def merge_sorted(spark, sf_dir):
    return arrange.merge_sections(three_files(spark, sf_dir), arrange.KEEP_ALL, sort=True).select("rank", "file_id", "net_id", "reference_name", "record_count")


@query(f"{PROBE} SELECT probe_id, p.net_id, pos, reference_start AS start, reference_end AS \"end\" FROM net n JOIN probe p ON p.net_id = n.net_id AND reference_start < e AND s < reference_end")
def interval_overlap(spark, sf_dir):
    return interval.overlapping(fixtures.net_orders(spark, sf_dir), fixtures.probes(spark))


@query(f"{PROBE} SELECT probe_id, p.net_id, pos, reference_start AS start, reference_end AS \"end\" FROM net n JOIN probe p ON p.net_id = n.net_id AND reference_start < e AND s < reference_end")
def interval_overlap_binned(spark, sf_dir):
    return interval.overlapping(fixtures.net_orders(spark, sf_dir), fixtures.probes(spark), small=0)


@query(f"{NET} SELECT {ROW}, reference_start, reference_end FROM net WHERE reference_start < 60000 AND reference_end > 40000")
def interval_before_after(spark, sf_dir):
    rows = interval.ending_after(interval.starting_before(fixtures.net_orders(spark, sf_dir), 60_000), 40_000)
    return rows.select("net_id", "pos", "kind", "depth", "reference_start", "reference_end")


@query(f"{NET} SELECT chain_id, net_id, pos FROM net WHERE kind = 'fill' AND chain_id IN (SELECT chain_id FROM net WHERE net_id = 4 AND kind = 'fill')")
def chain_id_index(spark, sf_dir):
    records = fixtures.net_orders(spark, sf_dir)
    return interval.chain_occurrences(records, records.where("net_id = 4 and kind = 'fill'")).select("chain_id", "net_id", "pos")


@query(f"{FILES} SELECT reference_name, file_id, net_id, record_count FROM files QUALIFY row_number() OVER (PARTITION BY reference_name ORDER BY file_id, net_id) = 1")
def section_index(spark, sf_dir):
    rows = three_files(spark, sf_dir).withColumn("place", F.col("file_id") * 1_000 + F.col("net_id"))
    return interval.first_by_name(rows.withColumnRenamed("net_id", "of").withColumnRenamed("place", "net_id")).select("reference_name", "file_id", F.col("of").alias("net_id"), "record_count")


CONTEXT = f"""{NET}, c AS MATERIALIZED (
  SELECT n.net_id, n.pos, n.depth, coalesce(n.chain_id, 0) AS chain_id, n.parent AS parent_gap, g.reference_start AS gap_start, g.reference_end AS gap_end, t.pos AS enclosing_fill,
    t.chain_id AS enclosing_chain_id, t.reference_start AS enclosing_start FROM net n LEFT JOIN net g ON g.net_id = n.net_id AND g.root = n.root AND g.pos = n.parent LEFT JOIN net t ON t.net_id = n.net_id AND t.root = n.root AND t.pos = g.parent WHERE n.kind = 'fill'
)"""
CONTEXT_COLUMNS = ["net_id", "pos", "depth", "chain_id", "parent_gap", "gap_start", "gap_end", "enclosing_fill", "enclosing_chain_id", "enclosing_start"]


@query(f"{CONTEXT} SELECT * FROM c")
def fill_contexts(spark, sf_dir):
    records, _, parts = fixtures.net(spark, sf_dir)
    return context.fill_contexts(records, DEPTH, parts).select(*CONTEXT_COLUMNS)


@query(f"{CONTEXT} SELECT * FROM c WHERE depth > 0")
def nested_fill_contexts(spark, sf_dir):
    records, _, parts = fixtures.net(spark, sf_dir)
    return context.nested_fill_contexts(records, DEPTH, parts).select(*CONTEXT_COLUMNS)


@query(f"{CONTEXT} SELECT * FROM c WHERE parent_gap IS NOT NULL AND enclosing_chain_id IS NOT NULL")
def nested_fill_gap_contexts(spark, sf_dir):
    records, _, parts = fixtures.net(spark, sf_dir)
    return context.nested_fill_gap_contexts(records, DEPTH, parts).select(*CONTEXT_COLUMNS)


@query(f"""{NET}, f AS (SELECT chain_id, net_id, pos, lead(net_id) OVER w AS next_net_id, lead(pos) OVER w AS next_pos FROM net WHERE kind = 'fill' AND chain_id IS NOT NULL
WINDOW w AS (PARTITION BY chain_id ORDER BY net_id, reference_start, reference_end, pos)) SELECT * FROM f WHERE next_pos IS NOT NULL""")
def adjacent_occurrences(spark, sf_dir):
    return context.adjacent_occurrences(fixtures.net_orders(spark, sf_dir))


@query(f"{NET} SELECT DISTINCT net_id, chain_id FROM net WHERE kind = 'fill' AND chain_id IS NOT NULL")
def used_chain_ids(spark, sf_dir):
    return stats.used_chain_ids(fixtures.net_orders(spark, sf_dir), by_section=True)


SPANS = f"""{NET}, cuts AS MATERIALIZED (
  SELECT f.net_id, f.pos, f.chain_id, f.reference_start AS fs, g.reference_start AS cs, g.reference_end AS ce, 0 AS l FROM net f JOIN net g ON g.net_id = f.net_id AND g.root = f.root AND g.parent = f.pos AND g.kind = 'gap' AND g.subtree_end > g.pos + 1 WHERE f.kind = 'fill'
  UNION ALL SELECT net_id, pos, chain_id, reference_start, reference_end, reference_end, 1 FROM net WHERE kind = 'fill'
), spans AS (SELECT net_id, pos, chain_id, greatest(fs, coalesce(max(ce) OVER (PARTITION BY net_id, pos ORDER BY l, cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), fs)) AS start, cs AS "end" FROM cuts)"""


@query(f'{SPANS} SELECT net_id, pos, chain_id, start, "end" FROM spans WHERE start < "end"')
def uninterrupted_spans(spark, sf_dir):
    return context.uninterrupted_spans(fixtures.net_orders(spark, sf_dir))


@query(f"""{SPANS}, probe(probe_id, net_id, s, e) AS (VALUES (1, 0, 1000, 400000), (2, 3, 5250, 5250), (3, 5, 0, 9000), (4, 7, 30100, 30200), (5, 12, 100000, 2000000), (6, 24, 1000, 1100))
SELECT probe_id, net_id FROM probe p WHERE EXISTS (SELECT 1 FROM spans x WHERE x.start < x."end" AND x.net_id = p.net_id AND x.start < p.e AND p.s < x."end" AND x.chain_id % 2 = 1)""")
def any_overlap_where(spark, sf_dir):
    spans = context.uninterrupted_spans(fixtures.net_orders(spark, sf_dir)).select("net_id", F.col("chain_id").alias("span_chain"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    rows = fixtures.probes(spark).select("probe_id", "net_id", F.col("other_start").alias("start"), F.col("other_end").alias("end"))
    odd: Callable[[], Column] = lambda: F.col("span_chain") % 2 == 1
    return interval.any_overlap_where(rows, spans, odd, small=0).select("probe_id", "net_id")


def filter_non_nested(spark, sf_dir):
    records, _, parts = fixtures.net(spark, sf_dir)
    out = construct.non_nested(records.select(*FILTERED, "alignment_score"), 40_000, DEPTH, parts)
    return out.select("net_id", "pos", "kind", "depth", "parent", "chain_id", "reference_start")


QUERIES["filter_non_nested"] = filter_non_nested
SQL["filter_non_nested"] = filtered("promote", "CASE WHEN kind = 'fill' THEN coalesce(round_even(alignment_score, 0), 0) >= 40000 ELSE EXISTS (SELECT 1 FROM net p WHERE p.net_id = net.net_id AND p.root = net.root AND p.pos = net.parent AND p.kind = 'fill' AND round_even(p.alignment_score, 0) >= 40000) END")


@query(f"{NET} SELECT pos, kind, reference_start, depth FROM net WHERE net_id = 3 AND parent = (SELECT min(pos) FROM net WHERE net_id = 3 AND depth = 0 AND subtree_end > pos + 2)")
def tree_children_of_one(spark, sf_dir):
    records = fixtures.net_orders(spark, sf_dir)
    at = records.where("net_id = 3 and depth = 0 and subtree_end > pos + 2").agg(F.min("pos")).first()[0]
    return tree.children(records, 3, -1 if at is None else at).select("pos", "kind", "reference_start", "depth")


@query(f"{NET} SELECT pos, reference_start, subtree_end > pos + 1 AS has_children FROM net WHERE net_id = 5 AND kind = 'gap' AND parent = (SELECT max(pos) FROM net WHERE net_id = 5 AND depth = 0)")
def child_gaps_of_one(spark, sf_dir):
    records = fixtures.net_orders(spark, sf_dir)
    at = records.where("net_id = 5 and depth = 0").agg(F.max("pos")).first()[0]
    return tree.child_gaps(records, 5, -1 if at is None else at).select("pos", "reference_start", tree.has_children().alias("has_children"))


@query(f"{NET} SELECT {ROW}, reference_start FROM net WHERE depth = 2")
def tree_at_depth(spark, sf_dir):
    return tree.at_depth(fixtures.net_orders(spark, sf_dir), 2).select("net_id", "pos", "kind", "depth", "reference_start")


@query(f"{NET} SELECT {ROW}, parent IS NULL AS is_root, root FROM net WHERE net_id = 7 AND pos BETWEEN 10 AND 500")
def record_lookup(spark, sf_dir):
    rows = fixtures.net_orders(spark, sf_dir).where("net_id = 7 and pos between 10 and 500")
    return rows.select("net_id", "pos", "kind", "depth", F.col("parent").isNull().alias("is_root"), "root")


@query(f"""{NET} SELECT n.net_id, n.pos, CASE WHEN n.depth = 2 THEN g.parent WHEN n.depth = 1 THEN n.parent END AS enclosing_fill, CASE WHEN n.depth = 2 THEN t.chain_id WHEN n.depth = 1 THEN g.chain_id END AS enclosing_chain_id
FROM net n LEFT JOIN net g ON g.net_id = n.net_id AND g.root = n.root AND g.pos = n.parent LEFT JOIN net t ON t.net_id = n.net_id AND t.root = n.root AND t.pos = g.parent""")
def tree_enclosing_fill_with_id(spark, sf_dir):
    records, _, parts = fixtures.net(spark, sf_dir)
    return tree.enclosing_fill_with_id(records, DEPTH, parts).select("net_id", "pos", "enclosing_fill", "enclosing_chain_id")


@query(f"""{NET} SELECT net_id, pos, CAST((chain_id IS NOT NULL)::INT + (alignment_score IS NOT NULL)::INT + (aligned_bases IS NOT NULL)::INT + (net_type IS NOT NULL)::INT + (reference_unsequenced IS NOT NULL)::INT AS INTEGER) AS n,
CAST((chain_id IS NOT NULL)::INT + 2 * (alignment_score IS NOT NULL)::INT + 4 * (aligned_bases IS NOT NULL)::INT + 64 * (net_type IS NOT NULL)::INT + 128 * (reference_unsequenced IS NOT NULL)::INT AS INTEGER) AS mask FROM net""")
def attribute_presence(spark, sf_dir):
    return fixtures.net_orders(spark, sf_dir).select("net_id", "pos", presence_count().alias("n"), presence_mask().alias("mask"))


@query(f"""{NET} SELECT net_id, pos, greatest(reference_end - reference_start, 0) AS length, greatest(reference_start - reference_end, 0) AS turned, least(reference_start + 4294000000, 4294967295) AS saturated,
reference_start <= 50000 AND 50010 <= reference_end AS holds FROM net""")
def interval_arithmetic(spark, sf_dir):
    start, end = F.col("reference_start"), F.col("reference_end")
    rows = fixtures.net_orders(spark, sf_dir)
    return rows.select("net_id", "pos", intervals.length(start, end).alias("length"), intervals.length(end, start).alias("turned"), intervals.end_of(start, F.lit(COORD_MAX - 967_295)).alias("saturated"), intervals.contains(start, end, F.lit(50_000), F.lit(50_010)).alias("holds"))


_filter("filter_region", NetPredicate(reference_overlap=(200_000, 260_000), max_depth=1), policies.RETAIN, "reference_start < 260000 AND 200000 < reference_end AND depth <= 1")


def of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe for every supplier: 30 positions that lie in a gap, in a fill, or across."""
    key = F.col("s_suppkey").cast("long")
    start = key * 32 * 1000 + key % 7 * 100 + key % 90
    return fixtures.table(spark, sf_dir, "supplier").select(key.alias("probe_id"), (key % 25).cast("int").alias("net_id"), start.alias("other_start"), (start + 30).alias("other_end"))


SUPPLIERS = f"""{NET}, probe AS (SELECT s_suppkey AS probe_id, CAST(s_suppkey % 25 AS INTEGER) AS net_id, s_suppkey * 32000 + s_suppkey % 7 * 100 + s_suppkey % 90 AS s, s_suppkey * 32000 + s_suppkey % 7 * 100 + s_suppkey % 90 + 30 AS e FROM supplier
UNION ALL SELECT 1000000 + root, net_id, reference_start + 150, reference_start + 160 FROM net WHERE depth = 0 AND root % 17 = 0)"""


def _probes(spark: SparkSession, sf_dir: str, records: DataFrame) -> DataFrame:
    """Those of the suppliers, and one inside of every 17th root's first gap."""
    inside = records.where("depth = 0 and root % 17 = 0").select((F.lit(1_000_000) + F.col("root")).alias("probe_id"), "net_id", (F.col("reference_start") + 150).alias("other_start"), (F.col("reference_start") + 160).alias("other_end"))
    return of_suppliers(spark, sf_dir).union(inside)


def _containing(small: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = fixtures.net_orders(spark, sf_dir)
        return interval.containing(records, _probes(spark, sf_dir, records), small=small)

    return run


for _name, _size in (("interval_containing", interval.SMALL), ("interval_containing_binned", 0)):
    QUERIES[_name], SQL[_name] = _containing(_size), f"""{SUPPLIERS} SELECT probe_id, n.net_id, pos, reference_start AS start, reference_end AS "end" FROM net n JOIN probe p ON p.net_id = n.net_id AND reference_start <= s AND e <= reference_end"""


@query(f"""{SUPPLIERS} SELECT probe_id, n.net_id, pos, reference_start AS start, reference_end AS "end" FROM net n JOIN probe p ON p.net_id = n.net_id AND reference_start < e AND s < reference_end""")
def interval_overlap_many(spark, sf_dir):
    records = fixtures.net_orders(spark, sf_dir)
    return interval.overlapping(records, _probes(spark, sf_dir, records), small=0)


@query(f"""{NET} SELECT net_id, pos, reference_start AS start, reference_end AS "end", CAST(row_number() OVER (PARTITION BY net_id ORDER BY reference_start, reference_end, pos) - 1 AS BIGINT) AS rank FROM net""")
def interval_index_order(spark, sf_dir):
    return interval.ordered_index(fixtures.net_orders(spark, sf_dir))


@query(f"""{SPANS} SELECT net_id, pos, chain_id, start, "end", CAST(row_number() OVER (PARTITION BY net_id ORDER BY start, "end", pos) - 1 AS BIGINT) AS rank FROM spans WHERE start < "end" """)
def span_index_order(spark, sf_dir):
    return interval.ordered_spans(context.uninterrupted_spans(fixtures.net_orders(spark, sf_dir)))


SPAN_PROBES = f"{SPANS}{SUPPLIERS.removeprefix(NET)}"


@query(f"""{SPAN_PROBES} SELECT probe_id, x.net_id, pos, chain_id, start, "end" FROM spans x JOIN probe p ON p.net_id = x.net_id AND start < e AND s < "end" WHERE start < "end" """)
def spans_overlapping(spark, sf_dir):
    records = fixtures.net_orders(spark, sf_dir)
    return interval.spans_overlapping(context.uninterrupted_spans(records), _probes(spark, sf_dir, records), small=0)


@query(f"""{SPAN_PROBES} SELECT probe_id, coalesce(chain_id, 0) AS chain_id FROM spans x JOIN probe p ON p.net_id = x.net_id AND start < e AND s < "end" WHERE start < "end" """)
def chain_ids_overlapping(spark, sf_dir):
    records = fixtures.net_orders(spark, sf_dir)
    return interval.chain_ids_overlapping(context.uninterrupted_spans(records), _probes(spark, sf_dir, records))


@query(f"{CONTEXT} SELECT * FROM c WHERE net_id = 2 AND pos = (SELECT min(pos) FROM net WHERE net_id = 2 AND depth = 2)")
def fill_context_of_one(spark, sf_dir):
    records, _, parts = fixtures.net(spark, sf_dir)
    at = records.where("net_id = 2 and depth = 2").agg(F.min("pos")).first()[0]
    return context.fill_context(records, 2, at, DEPTH, parts).select(*CONTEXT_COLUMNS)


@query(f"{NET} SELECT DISTINCT chain_id FROM net WHERE kind = 'fill' AND chain_id IS NOT NULL")
def used_chain_ids_file(spark, sf_dir):
    return stats.used_chain_ids(fixtures.net_orders(spark, sf_dir))


@query(f"{ISSUES} SELECT severity, code, count(*) AS issues FROM found GROUP BY ALL")
def issue_counts(spark, sf_dir):
    records, sections, parts, tops = fixtures.whole_net(spark, sf_dir)
    return validate.counts(validate.issues(records, sections, parts=parts, max_depth=DEPTH, tops=tops))


NEGATIVE = f"{NET} " + " UNION ALL ".join(f"SELECT net_id, pos, '{a}' AS detail FROM net WHERE pos % {i + 3} - 1 < 0" for i, a in enumerate(validate.COUNTS))


@query(NEGATIVE)
def validate_negative_counts(spark, sf_dir):
    """All ten counts below 0 in turn."""
    records, sections, parts, tops = fixtures.whole_net(spark, sf_dir)
    counts = {a: (F.col("pos") % (i + 3) - 1).cast("int") for i, a in enumerate(validate.COUNTS)}
    return validate.issues(records.withColumns(counts), sections, parts=parts, max_depth=DEPTH, tops=tops.withColumns(counts)).where("code = 'negative-count'").select("net_id", "pos", "detail")


@query(f"{NET} SELECT key, count(*) AS occurrences FROM (SELECT CASE pos % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'status' END AS key FROM net WHERE depth = 2 UNION ALL SELECT 'b' FROM net WHERE depth = 2 AND pos % 3 = 1) GROUP BY key")
def stats_extras_many(spark, sf_dir):
    """Several undocumented keys, one of them twice in a record."""
    pair = lambda k: F.struct(F.lit(k).alias("key"), F.lit("x").alias("value"))
    extras = F.when(F.col("pos") % 3 == 0, F.array(pair("a"))).when(F.col("pos") % 3 == 1, F.array(pair("b"), pair("b"))).otherwise(F.array(pair("status")))
    return stats.unknown_attribute_names(fixtures.net_orders(spark, sf_dir).where("depth = 2").withColumn("extras", extras))


def three_nets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sections and records of three files: the sections below 20, those from 10 on moved by 7, and those below 5 of which one has another name."""
    records = fixtures.net_orders(spark, sf_dir)
    first = records.where("net_id < 20").withColumn("file_id", F.lit(0))
    second = records.where("net_id >= 10").withColumns({"file_id": F.lit(1), "reference_start": F.col("reference_start") + 7})
    third = records.where("net_id < 5").withColumns({"file_id": F.lit(2), "reference_name": F.when(F.col("net_id") == 0, "chrNew").otherwise(F.col("reference_name"))})
    every = first.unionByName(second).unionByName(third)
    sections = every.groupBy("file_id", "net_id", "reference_name").agg(F.count(F.lit(1)).alias("record_count"))
    return sections, every


THREE = f"""{NET}, rows AS MATERIALIZED (
  SELECT 0 AS file_id, net_id, reference_name, pos, depth, kind, reference_start FROM net WHERE net_id < 20 UNION ALL SELECT 1, net_id, reference_name, pos, depth, kind, reference_start + 7 FROM net WHERE net_id >= 10
  UNION ALL SELECT 2, net_id, CASE WHEN net_id = 0 THEN 'chrNew' ELSE reference_name END, pos, depth, kind, reference_start FROM net WHERE net_id < 5
), files AS MATERIALIZED (SELECT DISTINCT file_id, net_id, reference_name FROM rows), kept AS MATERIALIZED (SELECT file_id, net_id, reference_name, {{pick}}),
ranks AS (SELECT file_id, net_id, CAST(row_number() OVER (ORDER BY {{order}}) - 1 AS BIGINT) AS rank FROM kept)
SELECT rank, pos, file_id, reference_name, depth, kind, reference_start FROM rows JOIN ranks USING (file_id, net_id)"""
PICKS = {
    "all": "file_id AS pf, net_id AS pn FROM files",
    "first": "file_id AS pf, net_id AS pn FROM files QUALIFY row_number() OVER (PARTITION BY reference_name ORDER BY file_id, net_id) = 1",
    "last": "first_value(file_id) OVER w AS pf, first_value(net_id) OVER w AS pn FROM files WINDOW w AS (PARTITION BY reference_name ORDER BY file_id, net_id) QUALIFY row_number() OVER (PARTITION BY reference_name ORDER BY file_id DESC, net_id DESC) = 1",
}


def merged_records(sections: DataFrame, records: DataFrame, duplicates: str, sort: bool = False) -> DataFrame:
    kept = arrange.merge_sections(sections, duplicates, sort)
    return arrange.records_of(records, kept).select("rank", "pos", "file_id", "reference_name", "depth", "kind", "reference_start")


def _merge_records(duplicates: str, sort: bool) -> Query:
    return lambda spark, sf_dir: merged_records(*three_nets(spark, sf_dir), duplicates, sort)


for _name, _how, _sorted in (("all", arrange.KEEP_ALL, False), ("first", arrange.KEEP_FIRST, False), ("last", arrange.KEEP_LAST, False), ("sorted", arrange.KEEP_ALL, True)):
    QUERIES[f"merge_records_{_name}"] = _merge_records(_how, _sorted)
    SQL[f"merge_records_{_name}"] = THREE.format(pick=PICKS["all" if _sorted else _name], order=f"{NATURAL}, pf, pn" if _sorted else "pf, pn")


@query(f"{NET} SELECT CAST(row_number() OVER (ORDER BY net_id) - 1 AS BIGINT) AS rank, reference_name FROM sec")
def merge_error_without_duplicates(spark, sf_dir):
    """The policy that refuses duplicates lets all through where there are none."""
    sections = fixtures.net(spark, sf_dir)[1].withColumn("file_id", F.lit(0))
    return arrange.merge_sections(sections, arrange.ERROR).select("rank", "reference_name")


#: Records that break every rule here and there: (column, condition, new value), in turn.
FAULTS = (
    ("kind", "pos % 83 = 5", "if(kind = 'fill', 'gap', 'fill')"),
    ("chain_id", "pos % 79 = 7", "if(kind = 'fill', null, 5)"),
    ("reference_start", "pos % 89 = 3 and depth > 0", "reference_start + 5000"),
    ("reference_size", "pos % 97 = 1", "0"),
    ("reference_unsequenced", "pos % 71 = 2", "-1"),
)
_CASES = {c: f"CASE WHEN {when.replace('and', 'AND')} THEN {value} ELSE {c} END" for c, when, value in FAULTS}


def _faulty_sql() -> str:
    out, before = [], "net"
    for i, (c, _, _) in enumerate(FAULTS):
        case = _CASES[c].replace("if(kind = 'fill', 'gap', 'fill')", "CASE WHEN kind = 'fill' THEN 'gap' ELSE 'fill' END").replace("if(kind = 'fill', null, 5)", "CASE WHEN kind = 'fill' THEN NULL ELSE 5 END")
        out.append(f"f{i} AS (SELECT * REPLACE ({case} AS {c}) FROM {before})")
        before = f"f{i}"
    return f"{NET}, {', '.join(out)}, faulty AS MATERIALIZED (SELECT * REPLACE (least(reference_start + reference_size, {COORD_MAX}) AS reference_end) FROM {before})"


def faulty_net(spark: SparkSession, sf_dir: str) -> fixtures.Net:
    """A net in which every code of validation occurs."""
    records, sections, parts, tops = fixtures.whole_net(spark, sf_dir)

    def faulty(rows: DataFrame) -> DataFrame:
        for c, when, value in FAULTS:
            kind = rows.schema[c].dataType.simpleString()
            rows = rows.withColumn(c, F.expr(f"cast(case when {when} then {value} else {c} end as {kind})"))
        return rows.withColumn("reference_end", intervals.end_of(F.col("reference_start"), F.col("reference_size")))

    return fixtures.Net(faulty(records), sections, parts, faulty(tops))


@query(f"{issues_of('faulty', _faulty_sql())} SELECT severity, code, net_id, pos, detail, anchor, rule FROM found")
def validate_every_code(spark, sf_dir):
    records, sections, parts, tops = faulty_net(spark, sf_dir)
    return validate.issues(records, sections, parts=parts, max_depth=DEPTH, tops=tops)


@query(f"{issues_of('faulty', _faulty_sql())} SELECT severity, code, count(*) AS issues FROM found GROUP BY severity, code")
def issue_counts_every_code(spark, sf_dir):
    records, sections, parts, tops = faulty_net(spark, sf_dir)
    return validate.counts(validate.issues(records, sections, parts=parts, max_depth=DEPTH, tops=tops))


PART = 512  # positions of a part in the queries over one large root


def one_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A net whose sections have one root each, which holds all that were roots: trees of thousands of records."""
    records, sections, _ = fixtures.net(spark, sf_dir)
    keep = ["net_id", "kind", "reference_start", "chain_id", "alignment_score"]
    under = records.select(*keep, (F.col("pos") + 1).alias("pos"), (F.col("depth") + 1).alias("depth"), F.coalesce(F.col("parent") + 1, F.lit(0)).alias("parent"), (F.col("subtree_end") + 1).alias("subtree_end"))
    whole = sections.select("net_id", F.lit("fill").alias("kind"), F.lit(0).cast("long").alias("reference_start"), F.lit(0).cast("long").alias("chain_id"), F.lit(1e9).alias("alignment_score"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), (F.col("record_count") + 1).alias("subtree_end"))
    return under.unionByName(whole).withColumn("root", F.lit(0).cast("long"))


ONE = f"""{NET}, one AS MATERIALIZED (
  SELECT net_id, kind, reference_start, chain_id, alignment_score, pos + 1 AS pos, depth + 1 AS depth, coalesce(parent + 1, 0) AS parent, subtree_end + 1 AS subtree_end FROM net
  UNION ALL SELECT net_id, 'fill', 0, 0, 1e9, 0, 0, NULL, count(*) + 1 FROM net GROUP BY net_id
)"""


@query(f"""{ONE}, hit AS (SELECT *, coalesce(kind = 'gap' OR alignment_score >= 30000, false) AS m FROM one),
cut AS (SELECT *, max(CASE WHEN NOT m THEN subtree_end END) OVER (PARTITION BY net_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM hit),
num AS (SELECT *, CAST(row_number() OVER (PARTITION BY net_id ORDER BY pos) - 1 AS BIGINT) AS new FROM cut WHERE coalesce(c, 0) <= pos)
SELECT n.net_id, n.new AS pos, n.depth, p.new AS parent, n.kind, n.chain_id, n.reference_start FROM num n LEFT JOIN num p ON p.net_id = n.net_id AND p.pos = n.parent""")
def filter_prune_one_root(spark, sf_dir):
    """Prune in trees that are cut into parts of 512 positions."""
    records = one_root(spark, sf_dir)
    out = policies.filter_records(records, (F.col("kind") == "gap") | (F.col("alignment_score") >= 30_000), policies.PRUNE, DEPTH + 1, scan.parts_of(records, PART))
    return out.select("net_id", "pos", "depth", "parent", "kind", "chain_id", "reference_start")


@query(f"""{ONE}, up AS (
  SELECT net_id, pos, parent AS ancestor FROM one WHERE parent IS NOT NULL UNION ALL SELECT a.net_id, a.pos, b.parent FROM one a JOIN one b ON b.net_id = a.net_id AND b.pos = a.parent WHERE b.parent IS NOT NULL
  UNION ALL SELECT a.net_id, a.pos, c.parent FROM one a JOIN one b ON b.net_id = a.net_id AND b.pos = a.parent JOIN one c ON c.net_id = a.net_id AND c.pos = b.parent WHERE c.parent IS NOT NULL
) SELECT net_id, pos, count(*) AS ancestors, CAST(sum(ancestor) AS BIGINT) AS places FROM up GROUP BY net_id, pos""")
def ancestors_one_root(spark, sf_dir):
    """All pairs of a record and an ancestor in the same trees, as sums by record."""
    records = one_root(spark, sf_dir)
    pairs = tree.ancestors(records, records, scan.parts_of(records, PART), DEPTH + 1)
    return pairs.groupBy("net_id", "pos").agg(F.count(F.lit(1)).alias("ancestors"), F.sum("ancestor").alias("places"))
