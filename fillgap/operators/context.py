"""Chains in the context of the tree around their fills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillgap.operators.scan import Parts
from fillgap.operators.tree import has_children, nearest_enclosing, with_parent
from fillgap.schema import TREE
from fillgap.session import cut


def fill_contexts(records: DataFrame, max_depth: int | None = None, parts: Parts | None = None) -> DataFrame:
    """Every fill with its parent gap and its nearest enclosing fill.

    net_id, pos, depth, chain_id (0 without one), parent_gap (position of the direct parent if that is a gap),
    enclosing_fill (position), enclosing_chain_id, and the three intervals' starts and ends.
    """
    records = with_parent(records, {"kind": "__pk", "reference_start": "__ps", "reference_end": "__pe"}, max_depth, parts)
    near = {"pos": "enclosing_fill", "chain_id": "enclosing_chain_id", "reference_start": "enclosing_start", "reference_end": "enclosing_end"}
    rows = nearest_enclosing(records, F.col("kind") == "fill", near, max_depth, parts).where("kind = 'fill'")
    gap = F.col("__pk") == "gap"
    return rows.select(
        *TREE, "pos", "depth", F.coalesce("chain_id", F.lit(0)).alias("chain_id"),
        F.when(gap, F.col("parent")).alias("parent_gap"), F.when(gap, F.col("__ps")).alias("gap_start"), F.when(gap, F.col("__pe")).alias("gap_end"),
        "enclosing_fill", "enclosing_chain_id", "enclosing_start", "enclosing_end", "reference_start", "reference_end", F.col("chain_id").isNotNull().alias("has_id"),
    )


def fill_context(records: DataFrame, net_id: int, pos: int, max_depth: int | None = None, parts: Parts | None = None) -> DataFrame:
    """The context of one fill; an error if there is no such record in the section or it is a gap."""
    one = cut(fill_contexts(records.where((F.col("net_id") == net_id)), max_depth, parts).where(F.col("pos") == pos))  # a row, worked out once
    if one.isEmpty():
        raise ValueError(f"section {net_id} has no fill at {pos}")
    return one


def nested_fill_contexts(records: DataFrame, max_depth: int | None = None, parts: Parts | None = None) -> DataFrame:
    return fill_contexts(records, max_depth, parts).where("depth > 0")


def nested_fill_gap_contexts(records: DataFrame, max_depth: int | None = None, parts: Parts | None = None) -> DataFrame:
    """Fills right under a gap with an enclosing fill, both fills with chain ids."""
    return fill_contexts(records, max_depth, parts).where("parent_gap is not null and enclosing_fill is not null and has_id and enclosing_chain_id is not null")


def adjacent_occurrences(records: DataFrame) -> DataFrame:
    """Consecutive fills of a chain by section, start, end and position; pairs may cross sections."""
    along = Window.partitionBy("chain_id").orderBy("net_id", "reference_start", "reference_end", "pos")
    fills = records.where("kind = 'fill' and chain_id is not null").select("chain_id", "net_id", "pos", "reference_start", "reference_end")
    nexts = fills.withColumns({"next_net_id": F.lead("net_id").over(along), "next_pos": F.lead("pos").over(along)})
    return nexts.where("next_pos is not null").select("chain_id", "net_id", "pos", "next_net_id", "next_pos")


def uninterrupted_spans(records: DataFrame) -> DataFrame:
    """net_id, pos of the fill, chain_id, start, end: a fill's interval without its child gaps that have children.

    Gaps are cut out from left to right; what lies between the largest end so far and the next gap is a span. Gaps are
    not clipped to the fill; empty spans are left out.
    """
    fills = records.where("kind = 'fill'").select(*TREE, "pos", "chain_id", F.col("reference_start").alias("fs"), F.col("reference_end").alias("cs"), F.col("reference_end").alias("ce"), F.lit(1).alias("last"))
    nothing = F.lit(None)
    cuts = records.where((F.col("kind") == "gap") & has_children() & F.col("parent").isNotNull())
    cuts = cuts.select(*TREE, F.col("parent").alias("pos"), nothing.alias("chain_id"), nothing.alias("fs"), F.col("reference_start").alias("cs"), F.col("reference_end").alias("ce"), F.lit(0).alias("last"))
    whole = Window.partitionBy(*TREE, "pos").orderBy("last", "cs", "ce")
    every, before = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), whole.rowsBetween(Window.unboundedPreceding, -1)
    line = fills.unionByName(cuts).withColumns({"own": F.last(F.when(F.col("last") == 1, F.struct("chain_id", "fs"))).over(every), "reached": F.max("ce").over(before)})
    line = line.where("own is not null").withColumn("start", F.greatest("own.fs", F.coalesce("reached", "own.fs")))
    return line.where("start < cs").select("net_id", "pos", "own.chain_id", "start", F.col("cs").alias("end"))
