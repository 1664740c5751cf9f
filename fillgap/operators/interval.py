"""Interval lookups: joins by overlap and containment, by bins on several levels where both sides are large."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgap.functions.intervals import contains, overlaps
from fillgap.functions.ordering import ranked
from fillgap.session import cut

SMALL = 100_000
FINEST, STEP, LEVELS = 14, 3, 7  # bins of 2^14 positions, each level eight times as wide, the last one all of a section
NEAR = 8  # finest bins from which on an interval is long
DENSE = 50_000  # rows of one bin that one task meets


def _level(start: Column, end: Column) -> Column:
    """The finest level on which the interval lies in one bin."""
    last = F.greatest(start, end - 1)
    found = F.lit(LEVELS - 1)
    for i in range(LEVELS - 2, -1, -1):
        shift = FINEST + STEP * i
        found = F.when(F.shiftright(start, shift) == F.shiftright(last, shift), F.lit(i)).otherwise(found)
    return found


def _place(position: Column, level: int) -> Column:
    return F.shiftright(position, FINEST + STEP * level) if level < LEVELS - 1 else F.lit(0).cast("long")


def _bin(level: int, position: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), _place(position, level).alias("place"))


def _own_bin(start: str, end: str) -> Column:
    """The bin (level, place) that holds the interval, on the finest level."""
    low, level = F.col(start).cast("long"), _level(F.col(start).cast("long"), F.col(end).cast("long"))
    found = _bin(LEVELS - 1, low)
    for i in range(LEVELS - 1):
        found = F.when(level == i, _bin(i, low)).otherwise(found)
    return found


def _in_bins(rows: DataFrame, start: str, end: str, own: str) -> DataFrame:
    """A row for the interval's own bin and for each wider one around it: __bin (level, place), and ``own`` on its own level."""
    low, level = F.col(start).cast("long"), _level(F.col(start).cast("long"), F.col(end).cast("long"))
    around = F.filter(F.array(*[_bin(i, low) for i in range(LEVELS)]), lambda b: b["level"] >= level)
    return rows.select("*", F.posexplode(around).alias(own, "__bin")).withColumn(own, F.col(own) == 0)


def _long(start: str, end: str) -> Column:
    low, last = F.col(start).cast("long"), F.greatest(F.col(start), F.col(end) - 1).cast("long")
    return _place(last, 0) - _place(low, 0) >= NEAR


def _met_bins(start: str, end: str) -> Column:
    """The bins of every level that a short interval reaches into; of a long one its own and those around that."""
    low, last = F.col(start).cast("long"), F.greatest(F.col(start), F.col(end) - 1).cast("long")
    level = _level(low, F.col(end).cast("long"))
    levels = []
    for i in range(LEVELS):
        at = F.lit(i).alias("level")
        places = F.transform(F.sequence(_place(low, i), _place(last, i)), lambda p: F.struct(at, p.alias("place")))  # noqa: B023  called at once
        levels.append(F.when(~_long(start, end) | (level <= i), places).otherwise(F.array().cast("array<struct<level:int,place:bigint>>")))
    return F.flatten(F.array(*levels))


def binned_join(left: DataFrame, right: DataFrame, met: Column, how: str = "inner", dense: int | None = None) -> DataFrame:
    """Pairs of rows with equal ``__key`` (left) and ``__other_key`` (right) for which ``met`` holds, if that takes a common position.

    left has __start and __end, right __other_start and __other_end. Every interval of the left lies in one bin of the
    level that fits its length, however long it is, and is one row there. An interval of the right asks the bins of all
    levels that it reaches into, a few rows where it is short. One that spans many of the finest bins asks its own and the
    wider ones alone, and what lies in its own asks for it; only if there are such does the left take more rows. So a pair
    meets once. Bins that hold more than ``dense`` rows of the left are counted and dealt over several tasks.
    """
    right = cut(right)
    a = left.withColumn("__bin", _own_bin("__start", "__end"))
    b = right.withColumn("__other_bin", F.explode(_met_bins("__other_start", "__other_end")))
    found = _dealt_join(a, b, met, how, dense or DENSE)
    wide = right.where(_long("__other_start", "__other_end"))
    if wide.isEmpty():
        return found
    a = _in_bins(left, "__start", "__end", "__own").where(~F.col("__own")).drop("__own")
    return found.unionByName(_dealt_join(a, wide.withColumn("__other_bin", _own_bin("__other_start", "__other_end")), met, how, dense or DENSE))


def _dealt_join(a: DataFrame, b: DataFrame, met: Column, how: str, dense: int) -> DataFrame:
    full = a.groupBy("__key", "__bin").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > dense)
    full = cut(full.select(F.col("__key").alias("__full_key"), F.col("__bin").alias("__full_bin"), F.ceil(F.col("__n") / dense).cast("int").alias("__dealt")))
    if full.isEmpty():
        return a.join(b, (F.col("__key") == F.col("__other_key")) & (F.col("__bin") == F.col("__other_bin")) & met, how).drop("__bin", "__other_bin")
    a = a.join(full, F.col("__key").eqNullSafe(F.col("__full_key")) & (F.col("__bin") == F.col("__full_bin")), "left")
    a = a.withColumn("__deal", F.coalesce(F.pmod(F.xxhash64("__start", "__end", F.monotonically_increasing_id()), F.col("__dealt")).cast("int"), F.lit(0))).drop("__full_key", "__full_bin", "__dealt")
    b = b.join(full, F.col("__other_key").eqNullSafe(F.col("__full_key")) & (F.col("__other_bin") == F.col("__full_bin")), "left")
    b = b.withColumn("__other_deal", F.explode(F.sequence(F.lit(0), F.coalesce("__dealt", F.lit(1)) - 1))).drop("__full_key", "__full_bin", "__dealt")
    same = (F.col("__key") == F.col("__other_key")) & (F.col("__bin") == F.col("__other_bin")) & (F.col("__deal") == F.col("__other_deal"))
    return a.join(b, same & met, how).drop("__bin", "__other_bin", "__deal", "__other_deal")


def overlap_join(left: DataFrame, right: DataFrame, key: str = "net_id", how: str = "inner", condition: Column | None = None, small: int = SMALL, dense: int | None = None) -> DataFrame:
    """Pairs of rows of the same key whose intervals overlap; ``how`` is inner or left_semi.

    left has start and end, right has other_start and other_end; no other names may occur on both sides. A right side of
    at most ``small`` rows is broadcast; otherwise both are dealt by key and bin (``binned_join``).
    """
    if how not in ("inner", "left_semi"):
        raise ValueError(f"no {how} overlap join")
    met = overlaps(F.col("start"), F.col("end"), F.col("other_start"), F.col("other_end"))
    met = met if condition is None else met & condition
    if small and right.limit(small + 1).count() <= small:
        return left.join(F.broadcast(right.withColumnRenamed(key, "__key")), (F.col(key) == F.col("__key")) & met, how).drop("__key")
    a = left.withColumns({"__key": F.col(key), "__start": F.col("start"), "__end": F.col("end")})
    b = right.withColumnRenamed(key, "__other_key").withColumns({"__other_start": F.col("other_start"), "__other_end": F.col("other_end")})
    if how == "left_semi":
        a = a.withColumn("__row", F.monotonically_increasing_id())
        return binned_join(a, b, met, how, dense).dropDuplicates(["__row"]).select(*left.columns)
    return binned_join(a, b, met, how, dense).select(*left.columns, *[c for c in right.columns if c != key])


def overlapping(records: DataFrame, probes: DataFrame, **options) -> DataFrame:
    """probe_id and position of every record whose interval overlaps a probe (net_id, probe_id, other_start, other_end)."""
    rows = records.select("net_id", "pos", F.col("reference_start").alias("start"), F.col("reference_end").alias("end"))
    return overlap_join(rows, probes, **options).select("probe_id", "net_id", "pos", "start", "end")


def containing(records: DataFrame, probes: DataFrame, small: int = SMALL, dense: int | None = None) -> DataFrame:
    """Records whose interval holds all of a probe; many probes meet them by section and bin, each pair in one."""
    rows = records.select("net_id", "pos", F.col("reference_start").alias("start"), F.col("reference_end").alias("end"))
    met = contains(F.col("start"), F.col("end"), F.col("other_start"), F.col("other_end"))
    if small and probes.limit(small + 1).count() <= small:
        found = rows.join(F.broadcast(probes), "net_id").where(met)
    else:  # what holds a probe reaches the position where the probe starts, or ends there
        a = rows.withColumns({"__key": F.col("net_id"), "__start": F.col("start"), "__end": F.col("end") + 1})
        b = probes.withColumnRenamed("net_id", "__other_key").withColumns({"__other_start": F.col("other_start"), "__other_end": F.col("other_start") + 1})
        found = binned_join(a, b, met, dense=dense)
    return found.select("probe_id", "net_id", "pos", "start", "end")


def starting_before(records: DataFrame, position: int) -> DataFrame:
    return records.where(F.col("reference_start") < position)


def ending_after(records: DataFrame, position: int) -> DataFrame:
    return records.where(F.col("reference_end") > position)


def chain_occurrences(records: DataFrame, chain_ids: DataFrame | None = None) -> DataFrame:
    """Fills by chain id; with ``chain_ids`` only of those."""
    fills = records.where("kind = 'fill' and chain_id is not null")
    return fills if chain_ids is None else fills.join(chain_ids.select("chain_id").distinct(), "chain_id", "left_semi")


def first_by_name(sections: DataFrame) -> DataFrame:
    """The section index: the first section of every name."""
    return sections.groupBy("reference_name").agg(F.min_by(F.struct(*[c for c in sections.columns if c != "reference_name"]), "net_id").alias("s")).select("reference_name", "s.*")


def any_overlap_where(rows: DataFrame, spans: DataFrame, predicate: Callable[[], Column], **options) -> DataFrame:
    """Rows (net_id, start, end, ...) that overlap a span (net_id, other_start, other_end, ...) for which the predicate holds."""
    return overlap_join(rows, spans, how="left_semi", condition=predicate(), **options)


def ordered_index(records: DataFrame) -> DataFrame:
    """A section's intervals in the order of an index: start, then end, then position; ``rank`` counts from 0.

    Ranks run within ranges of starts; the ranges before are one row each.
    """
    rows = records.select("net_id", "pos", F.col("reference_start").alias("start"), F.col("reference_end").alias("end"))
    return ranked(rows, ["net_id"], F.floor(F.col("start") / (1 << 16)), ["start", "end", "pos"], "rank")


def ordered_spans(spans: DataFrame) -> DataFrame:
    """Uninterrupted spans by start and end, those alike in order of their fills; ``rank`` counts from 0 in each section."""
    return ranked(spans, ["net_id"], F.floor(F.col("start") / (1 << 16)), ["start", "end", "pos"], "rank")


def spans_overlapping(spans: DataFrame, probes: DataFrame, **options) -> DataFrame:
    """probe_id with every span that overlaps the probe (net_id, probe_id, other_start, other_end)."""
    return overlap_join(spans, probes, **options).select("probe_id", "net_id", "pos", "chain_id", "start", "end")


def chain_ids_overlapping(spans: DataFrame, probes: DataFrame, **options) -> DataFrame:
    """probe_id and chain_id of every overlapping span, as often as there are spans; 0 for fills without an id."""
    return spans_overlapping(spans, probes, **options).select("probe_id", F.coalesce("chain_id", F.lit(0)).alias("chain_id"))
