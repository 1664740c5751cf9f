"""Running sums, extremes and last values along trees, in parts where a tree is larger than one task should hold.

A small tree is a window's partition. A large one is cut into parts of positions. Each part is summed up in one row, what
the parts before it (or behind it) come to is worked out over those rows, and every record combines that with what its own
part holds before it: a prefix scan in two levels. A part's row says of every depth which record was the last there and
where the first one stands that is no deeper, which is all that parents and ends of subtrees need of other parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillgap.schema import TREE
from fillgap.session import cut

PART = "__part"
PART_ROWS = 1 << 16


@dataclass(frozen=True)
class Parts:
    """The trees that are cut, as (net_id, root) or None, and the positions of a part."""

    trees: DataFrame | None
    rows: int

    def __bool__(self) -> bool:
        return self.trees is not None

    def mark(self, records: DataFrame, place: str = "pos") -> DataFrame:
        """Adds the number of the record's part, -1 in trees that aren't cut; nothing if none is."""
        if self.trees is None:
            return records
        large = self.trees.withColumn("__large", F.lit(True))
        return records.join(large, TREE, "left").withColumn(PART, F.when(F.col("__large"), F.floor(F.col(place) / self.rows)).otherwise(-1)).drop("__large")

    def moved(self, records: DataFrame, place: Column) -> DataFrame:
        """The same marks for rows that stand elsewhere in their tree now."""
        return records.withColumn(PART, F.when(F.col(PART) >= 0, F.floor(place / self.rows)).otherwise(-1)) if self else records


WHOLE = Parts(None, PART_ROWS)


def parts_of(records: DataFrame, rows: int | None = None) -> Parts:
    """Trees with more than ``rows`` records, which the roots, the positions in the tree or a count tell, whatever is there."""
    rows = rows or PART_ROWS
    if {"parent", "subtree_end"} <= set(records.columns):
        large = records.where(F.col("parent").isNull() & (F.col("subtree_end") - F.col("pos") > rows)).select(*TREE)
    elif "rpos" in records.columns:
        large = records.where(F.col("rpos") == rows).select(*TREE)
    else:
        large = records.groupBy(*TREE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).select(*TREE)
    return Parts(cut(large) if large.count() else None, rows)  # one job that reads few columns; mostly there is none


def running(records: DataFrame, values: dict[str, tuple[str, Column]], backward: bool = False, inclusive: bool = False, keys: list[str] = TREE, order: list[str] | str = "pos", against: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Adds a column for each of ``values``: the sum, max, min or last value that isn't null, over the rows before this one.

    Rows go by ``order`` within ``keys``, from the end if ``backward``; this row counts if ``inclusive``. ``against`` are
    values that run the other way and don't build on ``values``: both take one deal. Records with parts are written once, so that what comes next reads them and doesn't work all of this out again.
    """
    order = [order] if isinstance(order, str) else order
    parted = PART in records.columns
    by = [*keys, PART] if parted else keys
    runs = [(values, backward), *([(against, not backward)] if against else [])]
    values = {n: how for part, _ in runs for n, how in part.items()}
    window = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.last(v, True)}
    out = records
    for part, back in runs:
        way = F.desc if back else F.asc
        along = Window.partitionBy(*by).orderBy(*[way(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        out = out.withColumns({n: window[how](v).over(along) for n, (how, v) in part.items()})
    if not parted:
        return out.withColumns({n: F.coalesce(n, F.lit(0)) for n, (how, _) in values.items() if how == "sum"})
    totals, before = [], []
    for part, back in runs:
        pick, way = (F.min_by, F.desc) if back else (F.max_by, F.asc)
        whole = window | {"last": lambda v, pick=pick: pick(v, F.when(v.isNotNull(), F.struct(*order)))}
        totals += [whole[how](v).alias(f"__of_{n}") for n, (how, v) in part.items()]
        beyond = Window.partitionBy(*keys).orderBy(way(PART)).rowsBetween(Window.unboundedPreceding, -1)
        before += [window[how](F.col(f"__of_{n}")).over(beyond).alias(f"__of_{n}") for n, (how, _) in part.items()]
    sums = records.where(F.col(PART) >= 0).groupBy(*by).agg(*totals).select(*by, *before)
    both = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "max": F.greatest, "min": F.least, "last": F.coalesce,
    }
    out = out.join(sums, by, "left").withColumns({n: both[how](F.col(n), F.col(f"__of_{n}")) for n, (how, _) in values.items()})
    return cut(out.drop(*[f"__of_{n}" for n in values]))
