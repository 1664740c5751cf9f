"""What happens to the relatives of records that a filter keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgap.operators.scan import WHOLE, Parts, parts_of, running
from fillgap.operators.tree import WIDE, complete, deepest, open_marked
from fillgap.schema import TREE
from fillgap.session import cut

PRUNE, RETAIN, PROMOTE = "prune", "retain-ancestors", "promote"


def kept_by(records: DataFrame, policy: str) -> DataFrame:
    """The records that stay, of those with ``__met``: with their matching ancestors only, as an ancestor of a match, or by themselves."""
    met = F.col("__met")
    if policy == PRUNE:  # no record that fails is still open here
        rows = running(records, {"__cut": ("max", F.when(~met, F.col("subtree_end")))}, inclusive=True)
        return rows.where(F.coalesce("__cut", F.lit(0)) <= F.col("pos")).drop("__cut")
    if policy == RETAIN:  # the next match lies inside the subtree
        rows = running(records, {"__next": ("min", F.when(met, F.col("pos")))}, backward=True, inclusive=True)
        return rows.where(F.col("__next") < F.col("subtree_end")).drop("__next")
    if policy == PROMOTE:
        return records.where(met)
    raise ValueError(f"unknown policy {policy!r}")


def with_kept_above(records: DataFrame, max_depth: int, parts: Parts = WHOLE) -> DataFrame:
    """Records with ``__met`` whose depth becomes the number of such records above. Up to WIDE levels of small trees
    these are columns of one window; deeper trees and parts count what is open."""
    if parts or max_depth > WIDE:
        return open_marked(records, "__met", "depth", parts).where("__met")
    rows = running(records, {f"__k{d}": ("last", F.when(F.col("depth") == d, F.col("__met"))) for d in range(max_depth)}) if max_depth else records
    above = F.lit(0)
    for d in range(max_depth):
        above = above + F.when((F.col("depth") > d) & F.col(f"__k{d}"), 1).otherwise(0)
    return rows.withColumn("depth", above).where("__met").drop(*[f"__k{d}" for d in range(max_depth)])


def rebuild(kept: DataFrame, max_depth: int | None = None, parts: Parts = WHOLE, order: str | list[str] = "pos") -> DataFrame:
    """Positions, parents and ends of what was kept, from its order and its depth; sections count from 0.

    New roots never leave the tree of the old one, so all windows run over (net_id, root) as before, in the order that
    the records have already; at last ``root`` becomes the new root's position.
    """
    rows = kept
    if order == "pos":
        rows, order = rows.withColumn("__was", F.col("pos")), "__was"
    rows = running(rows, {"rpos": ("sum", F.lit(1).cast("long"))}, order=order)
    out = complete(rows, max_depth, None, order, parts, "__top")
    return out.withColumn("root", F.col("__top")).drop("__top", "__was")


def filter_records(records: DataFrame, condition: Column, policy: str = PRUNE, max_depth: int | None = None, parts: Parts | None = None) -> DataFrame:
    """The records that stay under a policy, as sections of their own.

    records: net_id, root, pos, depth, parent, subtree_end and any other columns. Output: the same columns with new pos,
    depth, parent and subtree_end; root is the position of the new root. Sections that lose all records have no rows here;
    their headers are in the sections table. No rows give no rows; a null condition counts as false. Trees with more
    records than a task should hold are worked on in ``parts``, by their positions alone, which join the records last.
    """
    parts = parts_of(records) if parts is None else parts
    max_depth = deepest(records) if max_depth is None else max_depth
    met = F.coalesce(condition, F.lit(False)).alias("__met")
    made = ["pos", "depth", "parent", "subtree_end", "rpos"]
    if parts:
        rows = cut(parts.mark(records.select(*TREE, "pos", "depth", "subtree_end", met, F.col("root").alias("__root"), F.col("pos").alias("__from"))))
    else:
        rows = records.withColumn("__met", met)
    kept = with_kept_above(rows, max_depth, parts) if policy == PROMOTE else kept_by(rows, policy)
    out = rebuild(kept.drop("__met", "parent", "subtree_end", "rpos"), max_depth, parts, "__from" if parts else "pos")
    if parts:
        old = records.withColumnsRenamed({"pos": "__from", "root": "__root"}).drop(*made)
        out = old.join(out.select("net_id", "__root", "__from", "root", *made), ["net_id", "__root", "__from"]).drop("__root", "__from")
    return out
