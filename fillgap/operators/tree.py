"""Trees as intervals of preorder positions: topology and navigation by window functions.

A record's subtree is the run of positions [pos, subtree_end). Windows are dealt by (net_id, root): subtrees never leave
their root, so a long section is many small windows instead of one large one, and the tree of a root that holds more than
a task should is cut into parts (``scan``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from fillgap.functions.ordering import running_sum
from fillgap.operators.scan import PART, Parts, parts_of, running
from fillgap.schema import TREE
from fillgap.session import cut

WIDE = 32  # depths up to this one are columns of a single window
CHUNK = 1 << 16  # places of a section that one task handles where no root parts them


def place_sections(records: DataFrame) -> DataFrame:
    """Adds ``pos`` from the order of roots, which are numbers, and ``rpos``, the position in the root's subtree."""
    return records.join(offsets_of(records), TREE).withColumn("pos", F.col("__offset") + F.col("rpos")).drop("__offset")


def offsets_of(records: DataFrame) -> DataFrame:
    """How many records stand in the section before each root: one row a root, summed by ranges of roots."""
    sizes = records.groupBy(*TREE).agg(F.count(F.lit(1)).alias("__n"))
    return running_sum(sizes, ["net_id"], F.floor(F.col("root") / CHUNK), ["root"], F.col("__n"), "__offset").select(*TREE, "__offset")


def complete(records: DataFrame, max_depth: int | None = None, offsets: DataFrame | None = None, order: str | list[str] = "pos", parts: Parts | None = None, top: str | None = None) -> DataFrame:
    """Adds pos, parent and subtree_end from ``rpos`` and ``depth``, and ``top`` as ``topology`` does.

    All windows run over positions within the root's tree, so records are dealt once, by (net_id, root); what stands
    before the root is added last. ``order`` may name other columns in whose order the records are already. Without
    ``offsets`` what the windows give is written once, so that counting it and moving it don't work all of it out again.
    """
    inside = topology(records.withColumn("pos", F.col("rpos")), max_depth, order, parts, top)
    if offsets is None and PART not in inside.columns:  # parts are written already
        inside = cut(inside)
    moved = {c: F.col(c) + F.col("__offset") for c in ("pos", "parent", "subtree_end", *([top] if top else []))}
    return inside.join(offsets_of(inside) if offsets is None else offsets, TREE).withColumns(moved).drop("__offset")


def deepest(records: DataFrame) -> int:
    return records.agg(F.max("depth")).first()[0] or 0


def topology(records: DataFrame, max_depth: int | None = None, order: str | list[str] = "pos", parts: Parts | None = None, top: str | None = None) -> DataFrame:
    """Adds parent (null for roots) and subtree_end, both in ``pos``, from ``depth``; ``top`` names a column for the last record of depth 0.

    ``max_depth`` and the trees that are cut into ``parts`` are asked of the data if they aren't given. Up to WIDE levels
    take one pass forward and one backward; deeper trees meet level by level, whatever their depth.
    """
    order = [order] if isinstance(order, str) else order
    parts = parts_of(records) if parts is None and PART not in records.columns else parts
    if parts and PART not in records.columns:
        keys = [*TREE, "pos"]
        narrow = cut(parts.mark(records.select(*keys, "depth", *dict.fromkeys(c for c in order if c not in keys and c != "depth"))))
        return records.join(topology(narrow, max_depth, order, parts, top).select(*keys, "parent", "subtree_end", *([top] if top else [])), keys)
    if max_depth is None:
        max_depth = deepest(records)
    depth, pos = F.col("depth"), F.col("pos")
    ends = {"__last": ("max", pos)}
    if max_depth > WIDE:
        if top:
            records = running(records, {top: ("last", F.when(depth == 0, pos))}, inclusive=True, order=order)
        return _topology_by_level(running(records, ends, backward=True, order=order))
    above = {f"__u{d}": ("last", F.when(depth == d, pos)) for d in range(max_depth)}
    behind = {f"__n{d}": ("last", F.when(depth <= d, pos)) for d in range(max_depth + 1)} | ends
    out = running(records, above, order=order, against=behind) if above else running(records, behind, backward=True, order=order)
    parent = F.get(F.array(*[F.col(f"__u{d}") for d in range(max_depth)]), depth - 1) if max_depth else F.lit(None).cast("long")
    found = {"parent": F.when(depth > 0, parent), "subtree_end": F.coalesce(F.get(F.array(*[F.col(f"__n{d}") for d in range(max_depth + 1)]), depth), F.coalesce("__last", pos) + 1)}
    if top:
        found[top] = F.when(depth > 0, F.col("__u0")).otherwise(pos) if max_depth else pos
    return out.withColumns(found).drop("__last", *[f"__u{d}" for d in range(max_depth)], *[f"__n{d}" for d in range(max_depth + 1)])


def _topology_by_level(records: DataFrame) -> DataFrame:
    """Every record meets the level above as a child, and closes its own level and those below as a successor."""
    keys = dict.fromkeys([*TREE, "pos", *(c for c in [PART] if c in records.columns)])
    own = records.select(*keys, F.col("depth").alias("k"), F.lit(0).alias("role"))
    child = records.where("depth > 0").select(*keys, (F.col("depth") - 1).alias("k"), F.lit(1).alias("role"))
    met = running(own.union(child), {"parent": ("last", F.when(F.col("role") == 0, F.col("pos")))}, keys=[*TREE, "k"], order=["pos", "role"])
    parents = met.where("role = 1").select(*TREE, "pos", "parent")
    before = running(records.select(*keys, "depth"), {"p": ("last", F.col("depth"))}, order="pos")
    closing = before.where("p >= depth").select(*keys, F.explode(F.sequence("depth", "p")).alias("k"), F.lit(0).alias("role"))
    events = own.withColumn("role", F.lit(1)).union(closing.select(own.columns))  # from the end, a record comes before what it closes
    closed = running(events, {"subtree_end": ("last", F.when(F.col("role") == 0, F.col("pos")))}, backward=True, keys=[*TREE, "k"], order=["pos", "role"])
    ends = closed.where("role = 1").select(*TREE, "pos", "subtree_end")
    out = records.join(parents, [*TREE, "pos"], "left").join(ends, [*TREE, "pos"], "left")
    return out.withColumn("subtree_end", F.coalesce("subtree_end", F.coalesce("__last", "pos") + 1)).drop("__last")


MANY_WIDTHS = 64


def with_roots(records: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Adds ``root``, the place of the record's root. A root is indented no more than any record before it in its section.

    Least indents and last roots run within chunks of places; what earlier chunks of the section hold is one row a chunk.
    """
    by_chunk = [*keys, "__chunk"]
    inside = Window.partitionBy(*by_chunk).orderBy(place)
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = records.withColumn("__chunk", F.floor(F.col(place) / CHUNK))
    least = rows.groupBy(*by_chunk).agg(F.min("indent").alias("__least"))
    least = least.select(*by_chunk, F.min("__least").over(before).alias("__before"))
    low = F.least(F.min("indent").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__before"))
    rows = rows.join(least, by_chunk).withColumn("__top", F.when(low.isNull() | (F.col("indent") <= low), F.col(place)))
    last = rows.groupBy(*by_chunk).agg(F.max("__top").alias("__last"))
    last = last.select(*by_chunk, F.max("__last").over(before).alias("__last"))
    here = F.max("__top").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(last, by_chunk).withColumn("root", F.coalesce(here, "__last")).drop("__chunk", "__before", "__top", "__last")


def beside_roots(records: DataFrame, columns: dict[str, str], previous: bool = True) -> DataFrame:
    """net_id and pos of every root with columns of the root before it in the section, or after; ``columns`` maps source to new name.

    Roots are neighbours within chunks of positions; over the edge of a chunk reaches one row a chunk.
    """
    keys = ["net_id", "__chunk"]
    tops = roots(records).select("net_id", "pos", *dict.fromkeys(c for c in columns if c not in ("net_id", "pos"))).withColumn("__chunk", F.floor(F.col("pos") / CHUNK))
    held = F.struct(*[F.col(c).alias(n) for c, n in columns.items()])
    inside, along = Window.partitionBy(*keys).orderBy("pos"), Window.partitionBy("net_id").orderBy("__chunk")
    step, edge = (F.lag, F.max_by) if previous else (F.lead, F.min_by)
    edges = tops.groupBy(*keys).agg(edge(held, "pos").alias("__edge"))
    edges = edges.select(*keys, step("__edge").over(along).alias("__edge"))
    met = tops.withColumn("__held", held).withColumn("__near", step("__held").over(inside)).join(edges, keys)
    return met.withColumn("__near", F.coalesce("__near", "__edge")).select("net_id", "pos", *[F.col(f"__near.{n}").alias(n) for n in columns.values()])


def widths_of(records: DataFrame) -> list[int]:
    """The different widths of indentation, one more than MANY_WIDTHS at most."""
    return sorted(r[0] for r in records.select("indent").distinct().limit(MANY_WIDTHS + 1).collect())


def nested_by_indent(records: DataFrame, widths: list[int] | None = None, parts: Parts | None = None) -> DataFrame:
    """Adds ``parent`` and ``subtree_end`` from ``indent`` of any widths: the parent is the nearest earlier record with a smaller one.

    Up to MANY_WIDTHS different widths, those of ``widths_of``, are a running value each, in parts where a tree is large;
    with more, a stack runs over each root's tree.
    """
    widths = widths_of(records) if widths is None else widths
    if len(widths) > MANY_WIDTHS:
        return _stacked(records)
    if not widths:
        return records.withColumns({"parent": F.lit(None).cast("long"), "subtree_end": F.col("pos")})
    parts = parts_of(records) if parts is None else parts
    if parts and PART not in records.columns:
        keys = [*TREE, "pos"]
        narrow = cut(parts.mark(records.select(*keys, "indent")))
        return records.join(nested_by_indent(narrow, widths, parts).select(*keys, "parent", "subtree_end"), keys)
    indent, pos = F.col("indent"), F.col("pos")
    rows = running(records, {f"__u{w}": ("last", F.when(indent < w, pos)) for w in widths})
    rows = running(rows, {f"__d{w}": ("last", F.when(indent <= w, pos)) for w in widths} | {"__last": ("max", pos)}, backward=True)
    at = lambda side: F.create_map(*[x for w in widths for x in (F.lit(w), F.col(f"__{side}{w}"))])[indent]
    rows = rows.withColumns({"parent": at("u"), "subtree_end": F.coalesce(at("d"), F.coalesce("__last", pos) + 1)})
    return rows.drop("__last", *[f"__{side}{w}" for side in "ud" for w in widths])


def _stacked(records: DataFrame) -> DataFrame:
    """Parents and ends by a stack over the rows of each root's tree, which Spark deals and sorts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("pos")
        pos, indent = t["pos"].to_pylist(), t["indent"].to_pylist()
        parent, end, stack = [None] * len(pos), [pos[-1] + 1] * len(pos), []
        for i, width in enumerate(indent):
            while stack and indent[stack[-1]] >= width:
                end[stack.pop()] = pos[i]
            parent[i] = pos[stack[-1]] if stack else None
            stack.append(i)
        out = t.select(TREE).append_column("pos", t["pos"]).append_column("parent", pa.array(parent, pa.int64())).append_column("subtree_end", pa.array(end, pa.int64()))
        yield from out.to_batches()

    kinds = {f.name: f.dataType for f in records.schema}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in TREE] + [T.StructField(k, T.LongType()) for k in ("pos", "parent", "subtree_end")])
    tree = records.select(*TREE, "pos", "indent").groupBy(*TREE).applyInArrow(run, schema)
    return records.join(tree, [*TREE, "pos"])


def roots(records: DataFrame) -> DataFrame:
    return records.where(F.col("parent").isNull())


def children(records: DataFrame, net_id: int, pos: int) -> DataFrame:
    """The direct children of one record."""
    return records.where((F.col("net_id") == net_id) & (F.col("parent") == pos))


def fills(records: DataFrame) -> DataFrame:
    return records.where(F.col("kind") == "fill")


def gaps(records: DataFrame) -> DataFrame:
    return records.where(F.col("kind") == "gap")


def child_gaps(records: DataFrame, net_id: int, pos: int) -> DataFrame:
    """The gaps right under one record; with ``has_children()`` those that hold records of their own."""
    return gaps(children(records, net_id, pos))


def at_depth(records: DataFrame, depth: int) -> DataFrame:
    return records.where(F.col("depth") == depth)


def has_children() -> Column:
    return F.col("subtree_end") > F.col("pos") + 1


def subtree_len() -> Column:
    return F.col("subtree_end") - F.col("pos")


def with_sibling(records: DataFrame, columns: dict[str, str], previous: bool = True, parts: Parts | None = None, tops: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """Adds columns of the sibling before a record, or after it; ``columns`` maps source to new name.

    Children of one record are met in order of positions, in parts where the tree is large; roots are siblings over
    their whole section. ``tops`` are the roots with all columns of ``records``, where they are at hand without them;
    otherwise the records are worked out once more for them. Where ``max_depth`` says that levels are few and no tree is cut,
    the sibling is the nearest record on the same level, if both have one parent: windows keep the order of positions.
    """
    parts = parts_of(records) if parts is None else parts
    tops = roots(records) if tops is None else tops.select(records.columns)
    held = F.struct(*[F.col(c).alias(n) for c, n in columns.items()])
    rows = records
    if parts:
        rows = parts.mark(records.select(*TREE, "pos", "parent", *[c for c in columns if c != "pos"]))
    if not parts and max_depth and max_depth <= WIDE:
        levels = range(1, max_depth + 1)
        met = running(rows, {f"__b{d}": ("last", F.when(F.col("depth") == d, F.struct(F.col("parent").alias("under"), held.alias("held")))) for d in levels}, backward=not previous)
        met = met.withColumn("__at", F.get(F.array(*[F.col(f"__b{d}") for d in levels]), F.col("depth") - 1))
        met = met.withColumn("__near", F.when(F.col("__at.under") == F.col("parent"), F.col("__at.held"))).drop("__at", *[f"__b{d}" for d in levels])
    else:
        met = running(rows, {"__near": ("last", F.when(F.col("parent").isNotNull(), held))}, backward=not previous, keys=[*TREE, "parent"])
    if parts:
        inner = met.where("parent is not null and __near is not null").select(*TREE, "pos", "__near")
        met = records.join(inner, [*TREE, "pos"], "left")
    # Only roots meet their neighbours in a join; all others stay where they are.
    beside = beside_roots(tops, columns, previous).select("net_id", "pos", F.struct(*columns.values()).alias("__near"))
    under = met.where("parent is not null")
    out = under.unionByName(tops.join(beside, ["net_id", "pos"], "left").select(under.columns))
    return out.withColumns({n: F.col(f"__near.{n}") for n in columns.values()}).drop("__near")


def with_parent(records: DataFrame, columns: dict[str, str], max_depth: int | None = None, parts: Parts | None = None) -> DataFrame:
    """Adds columns of the parent, null for roots; ``columns`` maps source to new name.

    Where ``max_depth`` says that levels are few and no tree is cut, the parent is the last record before on the level
    above, and no record moves; otherwise records meet their parents in a join.
    """
    held = F.struct(*[F.col(c).alias(n) for c, n in columns.items()])
    if max_depth is None or max_depth > WIDE or parts is None or parts:
        above = records.select(*TREE, F.col("pos").alias("parent"), *[F.col(c).alias(n) for c, n in columns.items()])
        return records.join(above, [*TREE, "parent"], "left")
    rows = running(records, {f"__p{d}": ("last", F.when(F.col("depth") == d, held)) for d in range(max_depth)})
    if not max_depth:
        return rows.withColumns({n: F.lit(None).cast(records.schema[c].dataType) for c, n in columns.items()})
    rows = rows.withColumn("__up", F.get(F.array(*[F.col(f"__p{d}") for d in range(max_depth)]), F.col("depth") - 1))
    return rows.withColumns({n: F.col(f"__up.{n}") for n in columns.values()}).drop("__up", *[f"__p{d}" for d in range(max_depth)])


def siblings(records: DataFrame, parts: Parts | None = None, tops: DataFrame | None = None) -> DataFrame:
    """Adds previous_sibling and next_sibling; roots are siblings over their whole section. ``tops`` as for ``with_sibling``."""
    parts = parts_of(records) if parts is None else parts
    if parts:
        return with_sibling(with_sibling(records, {"pos": "previous_sibling"}, True, parts), {"pos": "next_sibling"}, False, parts)
    beside = {"previous_sibling": (True, "max"), "next_sibling": (False, "min")}
    tops = roots(records) if tops is None else tops.select(records.columns)
    under, line = records.where("parent is not null"), tops
    for name, (previous, pick) in beside.items():
        under = running(under, {name: (pick, F.col("pos"))}, backward=not previous, keys=[*TREE, "parent"])
        line = line.join(beside_roots(tops, {"pos": name}, previous), ["net_id", "pos"], "left")
    return under.unionByName(line)


def child_ends(records: DataFrame) -> DataFrame:
    """Adds first_child, last_child and n_children."""
    by_parent = records.where("parent is not null").groupBy("net_id", "parent").agg(F.min("pos").alias("first_child"), F.max("pos").alias("last_child"), F.count(F.lit(1)).alias("n_children"))
    out = records.join(by_parent.withColumnRenamed("parent", "pos"), ["net_id", "pos"], "left")
    return out.withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def ancestors(records: DataFrame, rows: DataFrame, parts: Parts | None = None, max_depth: int | None = None) -> DataFrame:
    """(net_id, root, pos, ancestor, ancestor_kind, ancestor_depth, steps) for the given rows, nearest first by ``steps``.

    A row has one ancestor at each depth above its own, the last record there before it, and asks for just those: the work
    is that of the pairs found and of the records in the rows' trees, whatever the shape of the trees. If all records ask
    and ``max_depth`` says that levels are few, the last record of each level is a column, and pairs are made last.
    """
    parts = parts_of(records) if parts is None else parts
    if rows is records and max_depth and max_depth <= WIDE:
        line = parts.mark(records.select(*TREE, "pos", "depth", "kind"))
        line, levels = cut(line) if parts else line, range(max_depth)
        held = F.struct(F.col("pos").alias("ancestor"), F.col("kind").alias("ancestor_kind"))
        met = running(line, {f"__a{d}": ("last", F.when(F.col("depth") == d, held)) for d in levels}).where("depth > 0")
        met = met.select(*TREE, "pos", "depth", F.posexplode(F.slice(F.array(*[F.col(f"__a{d}") for d in levels]), F.lit(1), F.col("depth"))).alias("ancestor_depth", "found"))
        return met.select(*TREE, "pos", "found.*", "ancestor_depth", (F.col("depth") - F.col("ancestor_depth")).alias("steps"))
    trees = rows.select(*TREE).distinct()
    above = records.join(trees, TREE, "left_semi").select(*TREE, "pos", F.col("depth").alias("k"), F.struct(F.col("pos").alias("ancestor"), F.col("kind").alias("ancestor_kind"), F.col("depth").alias("ancestor_depth")).alias("held"), F.lit(None).cast("int").alias("below"))
    asking = rows.where("depth > 0").select(*TREE, "pos", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("k"), F.lit(None).alias("held"), F.col("depth").alias("below"))
    line = parts.mark(above.union(asking))
    met = running(line, {"found": ("last", F.col("held"))}, keys=[*TREE, "k"]).where("below is not null")
    return met.select(*TREE, "pos", "found.*", (F.col("below") - F.col("found.ancestor_depth")).alias("steps"))


def open_marked(records: DataFrame, mark: str, out: str, parts: Parts) -> DataFrame:
    """Adds ``out``: how many records above have the column ``mark`` set. Needs pos and subtree_end, and parts where trees are cut."""
    ends = records.where(F.col(mark)).select(*TREE, *[c for c in [PART] if c in records.columns], F.col("subtree_end").alias("at"), F.lit(0).alias("opens"), F.lit(-1).alias("step"))
    ends = parts.moved(ends, F.col("at")) if PART in records.columns else ends
    starts = records.withColumns({"at": F.col("pos"), "opens": F.lit(1), "step": F.when(F.col(mark), 1).otherwise(0)})
    line = running(starts.unionByName(ends, allowMissingColumns=True), {out: ("sum", F.col("step"))}, order=["at", "opens"])
    return line.where("opens = 1").withColumn(out, F.col(out).cast("int")).drop("at", "opens", "step")


def nearest_enclosing(records: DataFrame, condition: Column, columns: dict[str, str], max_depth: int | None = None, parts: Parts | None = None) -> DataFrame:
    """Adds columns of the nearest ancestor that meets ``condition``, null without one; ``columns`` maps source to new name.

    Up to WIDE levels the last record of each level that meets the condition is remembered along with its end; the nearest
    ancestor is the deepest of those still open. In deeper trees a record counts the ancestors that meet the condition,
    n; of the records that meet it, the last one before with n - 1 such ancestors is the nearest: no depth costs more.
    """
    parts = parts_of(records) if parts is None else parts
    if max_depth is None:
        max_depth = deepest(records)
    kinds = {n: records.schema[c].dataType for c, n in columns.items()}
    if max_depth == 0:
        return records.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items()})
    if parts or max_depth > WIDE:
        keys = [*TREE, "pos"]
        narrow = records.select(*dict.fromkeys([*keys, "subtree_end", *columns]), F.coalesce(condition, F.lit(False)).alias("__met"))
        counted = cut(open_marked(parts.mark(narrow), "__met", "__n", parts))
        held = F.struct(*[F.col(c).alias(n) for c, n in columns.items()])
        line = [*keys, *[c for c in [PART] if c in counted.columns]]
        owners = counted.where("__met").select(*line, F.col("__n").alias("k"), held.alias("held"), F.lit(False).alias("asks"))
        asking = counted.where("__n > 0").select(*line, (F.col("__n") - 1).alias("k"), F.lit(None).alias("held"), F.lit(True).alias("asks"))
        found = running(owners.union(asking), {"__found": ("last", F.col("held"))}, keys=[*TREE, "k"]).where("asks")
        out = records.join(found.select(*keys, "__found"), keys, "left")
        return out.withColumns({n: F.col(f"__found.{n}") for n in kinds}).drop("__found")
    held = F.struct(F.col("subtree_end").alias("__to"), *[F.col(c).alias(n) for c, n in columns.items()])
    out = running(records, {f"__a{d}": ("last", F.when((F.col("depth") == d) & condition, held)) for d in range(max_depth)})
    found = F.lit(None)
    for d in range(max_depth):
        found = F.when((F.col("depth") > d) & (F.col(f"__a{d}.__to") > F.col("pos")), F.col(f"__a{d}")).otherwise(found)
    out = out.withColumn("__found", found)
    return out.withColumns({n: F.col(f"__found.{n}") for n in kinds}).drop("__found", *[f"__a{d}" for d in range(max_depth)])


def enclosing_fill_with_id(records: DataFrame, max_depth: int | None = None, parts: Parts | None = None) -> DataFrame:
    """Adds enclosing_fill and enclosing_chain_id of the nearest fill above that has a chain id."""
    return nearest_enclosing(records, (F.col("kind") == "fill") & F.col("chain_id").isNotNull(), {"pos": "enclosing_fill", "chain_id": "enclosing_chain_id"}, max_depth, parts)


def clone_subtree(records: DataFrame, net_id: int, pos: int) -> DataFrame:
    """The subtree of one record as a section of its own: positions and depths start at 0."""
    top = records.where((F.col("net_id") == net_id) & (F.col("pos") == pos)).select("net_id", F.col("root").alias("root"), F.col("pos").alias("__from"), F.col("subtree_end").alias("__to"), F.col("depth").alias("__depth"))
    inside = records.join(F.broadcast(top), TREE).where((F.col("pos") >= F.col("__from")) & (F.col("pos") < F.col("__to")))
    return (
        inside.withColumn("parent", F.when(F.col("pos") > F.col("__from"), F.col("parent") - F.col("__from")))
        .withColumn("subtree_end", F.col("subtree_end") - F.col("__from"))
        .withColumn("depth", (F.col("depth") - F.col("__depth")).cast("int"))
        .withColumn("pos", F.col("pos") - F.col("__from"))
        .drop("__from", "__to", "__depth")
    )


def events(records: DataFrame) -> DataFrame:
    """Enter and leave events of every record with ``seq``, their order in the section.

    When ``pos`` is entered, pos records were entered and those with subtree_end <= pos were left before; a record is
    left after all of its subtree was entered and left. Both counts follow from pos, depth and subtree_end alone.
    """
    enter = records.select("net_id", "pos", "depth", "kind", F.lit("enter").alias("event"), (2 * F.col("pos") - F.col("depth")).alias("seq"))
    leave = records.select("net_id", "pos", "depth", "kind", F.lit("leave").alias("event"), (2 * F.col("subtree_end") - F.col("depth") - 1).alias("seq"))
    return enter.union(leave)


def fold(records: DataFrame, start: Callable[[], object], enter: Callable[[object, dict], tuple[object, bool]], leave: Callable[[object, dict], object], finish: Callable[[object], dict], schema: str) -> DataFrame:
    """A visitor's walk over each section: records are entered in preorder and left after their subtrees.

    ``start()`` makes a section's state, ``enter(state, record)`` returns the state and whether to go on, ``leave`` the
    state, and ``finish(state)`` one row of ``schema``, to which net_id is added. After a stop no record is entered or
    left. The state of a section depends on the order of all its records, so a section is one task's work; its events
    arrive sorted, batch by batch, and only the open records are held.
    """
    columns = list(dict.fromkeys(["net_id", "pos", "subtree_end", *records.columns]))
    kinds = to_arrow_schema(T.StructType([records.schema["net_id"], *T.StructType.fromDDL(schema)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, going, net, open_ = start(), True, None, []
        for batch in batches:
            for row in batch.to_pylist():
                net = row["net_id"]
                while going and open_ and open_[-1]["subtree_end"] <= row["pos"]:
                    state = leave(state, open_.pop())
                if going:
                    state, going = enter(state, row)
                    open_.append(row)
        while going and open_:
            state = leave(state, open_.pop())
        yield pa.RecordBatch.from_pylist([{"net_id": net, **finish(state)}], schema=kinds)

    kind = records.schema["net_id"].dataType.simpleString()
    ordered = records.select(*columns).repartition("net_id").sortWithinPartitions("net_id", "pos")
    return ordered.groupBy("net_id").applyInArrow(run, f"net_id {kind}, {schema}")
