"""Columns of the tables that stand for alignment nets and chains."""

from __future__ import annotations

COORD_MAX = 4_294_967_295
WIDE_MAX = (1 << 62) - 1  # two of them add up to a long

#: Fixed values of the text format: attribute column, key on disk and type, in the order of writing.
ATTRIBUTES = (
    ("chain_id", "id", "decimal(20,0)"),
    ("alignment_score", "score", "double"),
    ("aligned_bases", "ali", "long"),
    ("query_far", "qFar", "int"),
    ("query_over", "qOver", "int"),
    ("query_dup", "qDup", "int"),
    ("net_type", "type", "string"),
    ("reference_unsequenced", "tN", "int"),
    ("query_unsequenced", "qN", "int"),
    ("reference_masked", "tR", "int"),
    ("query_masked", "qR", "int"),
    ("reference_new_masked", "tNewR", "int"),
    ("query_new_masked", "qNewR", "int"),
    ("reference_old_masked", "tOldR", "int"),
    ("query_old_masked", "qOldR", "int"),
    ("reference_tandem", "tTrf", "int"),
    ("query_tandem", "qTrf", "int"),
)
ATTRIBUTE_COLUMNS = [name for name, _, _ in ATTRIBUTES]
EXTRAS = "array<struct<key:string,value:string>>"
KNOWN_TYPES = ("top", "syn", "inv", "nonSyn")

POSITIONAL = ["kind", "reference_start", "reference_size", "query_name", "query_strand", "query_start", "query_size"]

#: A subtree of a root never leaves (net_id, root), so windows over trees are dealt by these two and not by section.
TREE = ["net_id", "root"]
