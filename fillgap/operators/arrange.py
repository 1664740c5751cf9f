"""Order of sections and siblings, and merging of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillgap.functions.ordering import natural_key, running_sum
from fillgap.operators.scan import PART, Parts, parts_of, running
from fillgap.operators.tree import WIDE, deepest
from fillgap.schema import TREE
from fillgap.session import cut

PRESERVE, LEXICOGRAPHIC, NATURAL = "preserve", "lexicographic", "natural"
KEEP_ALL, KEEP_FIRST, KEEP_LAST, ERROR = "keep-all", "keep-first", "keep-last", "error"


def sort_sections(sections: DataFrame, order: str = NATURAL) -> DataFrame:
    """Adds ``rank`` (from 0): by input order, name bytes or natural order; equal names stay in input order. One row a section."""
    key = {PRESERVE: F.lit(0), LEXICOGRAPHIC: F.col("reference_name"), NATURAL: natural_key(F.col("reference_name"))}[order]
    return sections.withColumn("rank", (F.row_number().over(Window.orderBy(key, "net_id")) - 1).cast("long"))


SIBLING_KEYS = ["reference_start", "reference_size", "kind", "query_name", "query_start", "pos"]


def _shifted(records: DataFrame, parts: Parts) -> DataFrame:
    """Adds ``__shift``: how far behind its parent a record comes, 1 and the room of its earlier siblings; 0 for roots."""
    room = F.col("subtree_end") - F.col("pos")
    if parts:  # many siblings meet by ranges of starts
        inner = running_sum(records.where("parent is not null"), [*TREE, "parent"], F.floor(F.col("reference_start") / (1 << 16)), SIBLING_KEYS, room, "__shift")
        return cut(inner.withColumn("__shift", F.col("__shift") + 1).unionByName(records.where("parent is null").withColumn("__shift", F.lit(0).cast("long"))))
    before = Window.partitionBy(*TREE, "parent").orderBy(*SIBLING_KEYS).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("__shift", F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.coalesce(F.sum(room).over(before), F.lit(0)) + 1))


def sort_records(records: DataFrame, max_depth: int | None = None, parts: Parts | None = None, tops: DataFrame | None = None) -> DataFrame:
    """Every list of siblings by start, size, kind, query name and query start; equals stay in order.

    A record's new position is its place among its siblings' subtrees added up along its ancestors: each record adds the
    room of earlier siblings over its own subtree. Parents and ends move with their records. Roots are ranked by ranges of
    their starts. ``root`` becomes the new root's position. Large trees are worked on in ``parts``, by their keys alone.
    ``tops`` are the roots among the records, where they are at hand without them.
    """
    parts = parts_of(records) if parts is None else parts
    if max_depth is None:
        max_depth = deepest(records)
    made = ["pos", "parent", "subtree_end", "rpos"]
    rows = records
    if parts:
        rows = cut(parts.mark(records.select(*dict.fromkeys([*TREE, "depth", "parent", "subtree_end", *SIBLING_KEYS])).withColumn("__from", F.col("pos"))))
    rows = _shifted(rows, parts)
    if max_depth <= WIDE:
        held = F.col("__shift")
        rows = running(rows, {f"__s{d}": ("last", F.when(F.col("depth") == d, held)) for d in range(max_depth)}) if max_depth else rows
        sums = [F.when(F.col("depth") > d, F.col(f"__s{d}")).otherwise(0) for d in range(max_depth)]
        rows = rows.withColumn("rpos", reduce(lambda a, b: a + b, sums, held)).drop(*[f"__s{d}" for d in range(max_depth)])
    else:
        opening = rows.withColumns({"at": F.col("pos"), "opens": F.lit(1), "add": F.col("__shift")})
        closing = rows.select(*TREE, *[c for c in [PART] if c in rows.columns], F.col("subtree_end").alias("at"), F.lit(0).alias("opens"), (-F.col("__shift")).alias("add"))
        closing = parts.moved(closing, F.col("at"))
        line = running(opening.unionByName(closing, allowMissingColumns=True), {"rpos": ("sum", F.col("add"))}, inclusive=True, order=["at", "opens"])
        rows = line.where("opens = 1").drop("at", "opens", "add")
    # Roots: one row each, with the room of their trees.
    tops = (records if tops is None else tops).where("parent is null").select(*TREE, (F.col("subtree_end") - F.col("pos")).alias("__room"), *SIBLING_KEYS)
    offsets = running_sum(tops, ["net_id"], F.floor(F.col("reference_start") / (1 << 16)), SIBLING_KEYS, F.col("__room"), "__offset").select(*TREE, "__offset")
    # A record's end follows from its room, and its parent stands before it by its shift.
    new = F.col("rpos") + F.col("__offset")
    rows = rows.join(offsets, TREE).withColumns({"parent": F.when(F.col("parent").isNotNull(), new - F.col("__shift")), "subtree_end": new + F.col("subtree_end") - F.col("pos"), "pos": new})
    rows = rows.drop("__shift", "__offset").withColumn("__new", F.col("pos") - F.col("rpos"))
    if not parts:
        return rows.withColumn("root", F.col("__new")).drop("__new")
    old = records.withColumnsRenamed({"pos": "__from"}).drop(*made)
    return old.join(rows.select(*TREE, "__from", "__new", *made), [*TREE, "__from"]).withColumn("root", F.col("__new")).drop("__from", "__new")


def merge_sections(sections: DataFrame, duplicates: str = KEEP_ALL, sort: bool = False) -> DataFrame:
    """Sections of several files, with (file_id, net_id) as the order of input: adds ``rank`` from 0 to those that stay.

    ``keep-last`` puts the content of the last section of a name where the first one was. ``error`` fails on any name
    that occurs twice, even within one file. Root lists are never joined.
    """
    place = F.struct("file_id", "net_id")
    named = Window.partitionBy("reference_name")
    rows = sections.withColumns(
        {"__place": F.min(place).over(named) if duplicates == KEEP_LAST else place, "__first": F.min(place).over(named), "__last": F.max(place).over(named), "__self": place}
    )
    if duplicates == KEEP_FIRST:
        rows = rows.where(F.col("__self") == F.col("__first"))
    elif duplicates == KEEP_LAST:
        rows = rows.where(F.col("__self") == F.col("__last"))
    elif duplicates == ERROR:
        fine = F.col("__first") == F.col("__last")
        rows = rows.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("duplicate section "), "reference_name")).cast("boolean")))
    order = [natural_key(F.col("reference_name")), F.col("__place"), F.col("__self")] if sort else [F.col("__place"), F.col("__self")]
    return rows.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")).drop("__place", "__first", "__last", "__self")


def records_of(records: DataFrame, sections: DataFrame) -> DataFrame:
    """Records of the sections that stay, with the sections' rank; the sections are one row each, so this is a broadcast or a plain join."""
    return records.join(sections.select("file_id", "net_id", "rank"), ["file_id", "net_id"])
