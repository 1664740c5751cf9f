"""SQL that restates the queries for DuckDB, from the same tables."""

from __future__ import annotations

from fillgap.plans.fixtures import PROBES, SECTION_SIZE, TIES

NET = f"""
WITH ord AS (
  SELECT CAST(c_nationkey AS INTEGER) AS net_id, o_orderkey AS root, o_orderpriority AS qn, CASE WHEN o_orderstatus = 'F' THEN '+' ELSE '-' END AS strand, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey
), li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(TIES)}) AS rn, CAST(l_quantity AS BIGINT) AS q FROM lineitem
), rec AS MATERIALIZED (
  SELECT net_id, root, CAST(0 AS BIGINT) AS line, CAST(0 AS BIGINT) AS rn, 0 AS depth, 'fill' AS kind, root * 1000 AS reference_start, CAST(1000 AS BIGINT) AS reference_size, qn AS query_name,
    strand AS query_strand, root * 500 AS query_start, CAST(900 AS BIGINT) AS query_size, root AS chain_id, price AS alignment_score, CAST(NULL AS BIGINT) AS aligned_bases,
    CAST(NULL AS VARCHAR) AS net_type, CAST(NULL AS INTEGER) AS reference_unsequenced, CAST(NULL AS VARCHAR) AS extra FROM ord
  UNION ALL
  SELECT net_id, root, CAST(l_linenumber AS BIGINT), 0, 1, 'gap', root * 1000 + l_linenumber * 100, 100, qn, strand, root * 500 + l_linenumber * 50, 40, NULL, NULL, NULL, NULL, NULL, NULL
  FROM li JOIN ord ON l_orderkey = root WHERE rn = 1
  UNION ALL
  SELECT net_id, root, CAST(l_linenumber AS BIGINT), rn, 2, 'fill', root * 1000 + l_linenumber * 100 + q, 51 - q, 'q' || l_suppkey, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END,
    l_partkey * 10, 30, 1000000 + l_partkey, l_extendedprice, q, CASE l_returnflag WHEN 'A' THEN 'top' WHEN 'N' THEN 'syn' ELSE 'nonSyn' END, CAST(l_linenumber - 3 AS INTEGER), l_linestatus
  FROM li JOIN ord ON l_orderkey = root
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY net_id ORDER BY root, line, rn) - 1 AS BIGINT) AS pos, 'chr' || net_id AS reference_name,
    least(reference_start + reference_size, 4294967295) AS reference_end FROM rec
), net AS MATERIALIZED (
  SELECT *, CASE depth WHEN 1 THEN max(CASE WHEN depth = 0 THEN pos END) OVER w WHEN 2 THEN max(CASE WHEN depth = 1 THEN pos END) OVER w END AS parent,
    CASE depth WHEN 0 THEN coalesce(min(CASE WHEN depth = 0 THEN pos END) OVER a, max(pos) OVER p + 1) WHEN 1 THEN coalesce(min(CASE WHEN depth <= 1 THEN pos END) OVER a, max(pos) OVER p + 1) ELSE pos + 1 END AS subtree_end
  FROM placed WINDOW p AS (PARTITION BY net_id), w AS (PARTITION BY net_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY net_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), sec AS MATERIALIZED (
  SELECT net_id, reference_name, count(*) AS record_count, count(*) FILTER (depth = 0) AS root_count, CAST({SECTION_SIZE} AS BIGINT) AS section_size FROM net GROUP BY ALL
)
"""

#: Filters by policy: `m` marks the records that match; `k` those that stay, with their new depth.
_KEEP = {
    "prune": "m AND NOT EXISTS (SELECT 1 FROM hit a WHERE a.net_id = h.net_id AND a.root = h.root AND a.pos < h.pos AND h.pos < a.subtree_end AND NOT a.m)",
    "retain": "m OR EXISTS (SELECT 1 FROM hit a WHERE a.net_id = h.net_id AND a.root = h.root AND h.pos < a.pos AND a.pos < h.subtree_end AND a.m)",
    "promote": "m",
}


def filtered(policy: str, condition: str) -> str:
    return f"""{NET}, hit AS MATERIALIZED (SELECT *, coalesce({condition}, false) AS m FROM net),
stay AS MATERIALIZED (SELECT * FROM hit h WHERE {_KEEP[policy]}),
deep AS MATERIALIZED (
  SELECT s.net_id, s.pos AS old, s.kind, s.chain_id, s.reference_start, count(a.pos) AS depth, max(a.pos) AS above
  FROM stay s LEFT JOIN stay a ON a.net_id = s.net_id AND a.root = s.root AND a.pos < s.pos AND s.pos < a.subtree_end GROUP BY ALL
), num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY net_id ORDER BY old) - 1 AS pos FROM deep)
SELECT n.net_id, CAST(n.pos AS BIGINT) AS pos, n.kind, CAST(n.depth AS INTEGER) AS depth, CAST(p.pos AS BIGINT) AS parent, n.chain_id, n.reference_start
FROM num n LEFT JOIN num p ON p.net_id = n.net_id AND p.old = n.above"""


PROBE_ROWS = ", ".join(f"({a}, {b}, CAST({c} AS BIGINT), CAST({d} AS BIGINT))" for a, b, c, d in PROBES)
PROBE = f"{NET}, probe(probe_id, net_id, s, e) AS (VALUES {PROBE_ROWS})"

NATURAL = "array_to_string(list_transform(regexp_extract_all(reference_name, '([0-9]+|[^0-9]+)'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN '0' || lpad(CAST(length(ltrim(t, '0')) AS VARCHAR), 10, '0') || ltrim(t, '0') ELSE t END), '')"

#: Three files made of the sections: all, the even ones, and those below 5.
FILES = f"""{NET}, files AS MATERIALIZED (
  SELECT 0 AS file_id, net_id, reference_name, record_count FROM sec UNION ALL
  SELECT 1, net_id, reference_name, record_count + 1 FROM sec WHERE net_id % 2 = 0 UNION ALL
  SELECT 2, net_id, CASE WHEN net_id = 0 THEN 'chrNew' ELSE reference_name END, record_count + 2 FROM sec WHERE net_id < 5
)"""


def merged(duplicates: str) -> str:
    pick = {"all": "file_id AS pf, net_id AS pn FROM files", "first": "file_id AS pf, net_id AS pn FROM files QUALIFY row_number() OVER (PARTITION BY reference_name ORDER BY file_id, net_id) = 1"}
    pick["last"] = "first_value(file_id) OVER w AS pf, first_value(net_id) OVER w AS pn FROM files WINDOW w AS (PARTITION BY reference_name ORDER BY file_id, net_id) QUALIFY row_number() OVER (PARTITION BY reference_name ORDER BY file_id DESC, net_id DESC) = 1"
    return f"{FILES}, kept AS (SELECT file_id, net_id, reference_name, record_count, {pick[duplicates]}) SELECT CAST(row_number() OVER (ORDER BY pf, pn) - 1 AS BIGINT) AS rank, file_id, net_id, reference_name, record_count FROM kept"


BLOCKS = f"""
WITH b0 AS (
  SELECT l_orderkey AS chain_id, row_number() OVER w AS number, lead(l_linenumber) OVER w IS NULL AS last, CAST(l_quantity AS BIGINT) AS size, CAST(l_linenumber * 40 AS BIGINT) AS gr, l_partkey % 30 AS gq
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, {", ".join(TIES)})
), blocks AS MATERIALIZED (SELECT chain_id, number, size, CASE WHEN last THEN 0 ELSE gr END AS gr, CASE WHEN last THEN 0 ELSE gq END AS gq FROM b0),
sums AS (SELECT chain_id, sum(size + gr) AS r, sum(size + gq) AS q, sum(size) AS aligned FROM blocks GROUP BY chain_id),
chains AS MATERIALIZED (
  SELECT o_orderkey AS chain_id, CAST(floor(o_totalprice) AS BIGINT) AS score, 'chr' || c_nationkey AS reference_name, (o_orderkey * 7919) % 90000 AS reference_start,
    (o_orderkey * 7919) % 90000 + CAST(r AS BIGINT) AS reference_end, 'q' || (o_custkey % 20) || CASE WHEN o_custkey % 20 = 7 THEN '_alt' ELSE '' END AS query_name,
    (o_orderkey * 104729) % 90000 AS query_start, (o_orderkey * 104729) % 90000 + CAST(q AS BIGINT) AS query_end, CASE WHEN o_orderstatus = 'F' THEN '+' ELSE '-' END AS query_strand,
    CAST(aligned AS BIGINT) AS total_aligned
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN sums ON chain_id = o_orderkey
), numbered AS MATERIALIZED (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, chain_id) - 1 AS BIGINT) AS input_ordinal FROM chains)
"""

#: The nets as lines of text, by section and position (-1: the header), with the byte where each starts; a section is in file net_id % 4.
LINES = f"""{NET}, line AS MATERIALIZED (
  SELECT net_id, pos, net_id % 4 AS file_id, depth, kind, concat_ws(' ', repeat(' ', depth + 1) || kind, reference_start, reference_size, replace(query_name, ' ', '_'), query_strand, query_start, query_size,
    'id ' || chain_id, 'score ' || CASE WHEN alignment_score = floor(alignment_score) THEN CAST(CAST(alignment_score AS BIGINT) AS VARCHAR) ELSE CAST(alignment_score AS VARCHAR) END,
    'ali ' || aligned_bases, 'type ' || net_type, 'tN ' || reference_unsequenced, 'status ' || extra) AS text FROM net
  UNION ALL SELECT net_id, -1, net_id % 4, NULL, NULL, 'net ' || reference_name || ' ' || section_size FROM sec
), text AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER w AS BIGINT) AS line_no, CAST(sum(strlen(text) + 1) OVER w - strlen(text) - 1 AS BIGINT) AS byte_start, CAST(sum(strlen(text) + 1) OVER (PARTITION BY file_id) AS BIGINT) AS file_bytes,
    CAST(count(*) FILTER (pos = -1) OVER w - 1 AS INTEGER) AS ordinal FROM line WINDOW w AS (PARTITION BY file_id ORDER BY net_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""
