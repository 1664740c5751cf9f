"""Sharding by balanced label propagation: linked documents move towards each other under quotas.

Documents are linked when their texts are equal. Every document starts in a shard given by its id. In each round a
group of linked documents names the shard, among those with room, that holds most of its members, as each member would
by counting its neighbours' labels; its members in shards with fewer of them move there as far as the quota reaches,
group by group. All members of a group in one shard are alike, so the rounds work on one row for each group with its
count in every shard, and a group of any size costs as much as a pair. Unlinked documents have no wishes and fill what
is left. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillgap.llm.common import buckets_for, cut, fold_row_id, running_total


def _sum(longs: Column) -> Column:
    return F.aggregate(longs, F.lit(0).cast("long"), lambda a, x: a + x)


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _round(state: DataFrame, room: list[int], buckets: int, seed: int) -> DataFrame:
    """One round: state has key and the counts in the shards; room is what each shard can still take."""
    rooms, none = _longs(room), F.lit(0).cast("long")

    def rank(c: Column, s: Column) -> Column:
        return F.struct(c.alias("c"), F.xxhash64(F.lit(seed), "key", s).alias("tie"), s.alias("s"))

    wishes = F.transform("counts", lambda c, s: F.when(F.element_at(rooms, s + 1) > 0, rank(c, s)))
    state = state.withColumn("best", F.array_max(F.filter(wishes, lambda x: x.isNotNull())))
    state = state.withColumn("to", F.col("best.s")).withColumn("moves", F.transform("counts", lambda c, s: F.when(rank(c, s) < F.col("best"), c).otherwise(none)))
    state = state.withColumn("bucket", fold_row_id(F.col("key"), seed=seed, modulus=buckets))
    state = running_total(state, ["to"], "bucket", [F.xxhash64(F.lit(seed), "key"), F.col("key")], _sum(F.col("moves")), "before")
    granted = F.greatest(none, F.least(_sum(F.col("moves")), F.element_at(rooms, F.col("to") + 1) - F.col("before")))
    state = state.withColumn("granted", granted)
    gone = F.transform("moves", lambda m, s: F.least(m, F.greatest(none, F.col("granted") - _sum(F.slice("moves", F.lit(1), s)))))
    state = state.withColumn("gone", gone)
    after = F.transform("counts", lambda c, s: c - F.element_at("gone", s + 1) + F.when(F.col("to") == s, F.col("granted")).otherwise(none))
    return state.select("key", after.alias("counts"))


def shard(docs: DataFrame, n_shards: int = 16, rounds: int = 4, seed: int = 4) -> DataFrame:
    """Put every document into one of ``n_shards`` shards whose row counts differ by one at most (law ``rows``).

    Input: doc_id, text; other columns are ignored. Output, one row for every input row: doc_id, size (UTF-8 bytes plus
    1; null text counts as empty), text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null under
    this law). Null ids and repeated rows are documents of their own; equal texts, null and empty being equal, are one
    group. A group larger than a shard's quota is spread over as many shards as it needs. No rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    )
    total = base.count()
    buckets = buckets_for(total)
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    # A salt holds a document's first shard and parts large groups, so that counts and ranks never need a whole group in a task.
    base = base.withColumn("salt", fold_row_id(F.col("doc_id"), seed=seed, modulus=n_shards * buckets))
    cells = base.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("c"))
    first = [F.sum(F.when(F.col("salt") % n_shards == s, F.col("c")).otherwise(0)) for s in range(n_shards)]
    state = cut(cells.groupBy("key").agg(F.sum("c").alias("n"), F.array(*first).alias("counts")).where("n > 1").select("key", "counts"))

    def loads(df: DataFrame) -> list[int]:
        return [x or 0 for x in df.agg(*[F.sum(F.element_at("counts", s + 1)) for s in range(n_shards)]).first()]

    held = loads(state)
    for i in range(rounds):
        # Quotas are wide at first, so that groups can pass each other, and close round by round.
        wide = 1 + 0.5 * (rounds - 1 - i) / max(1, rounds - 1)
        room = [max(0, int(q * wide) - x) for q, x in zip(quota, held, strict=True)]
        if not any(room):
            break
        state = cut(_round(state, room, buckets, seed + i))
        held = loads(state)
    # Where a shard holds more linked documents than it may, the groups beyond its quota join the unlinked ones.
    for full in [s for s in range(n_shards) if held[s] > quota[s]]:
        state = state.withColumn("bucket", fold_row_id(F.col("key"), seed=seed, modulus=buckets)).withColumn("one", F.lit(1))
        state = running_total(state, ["one"], "bucket", [F.col("key")], F.element_at("counts", full + 1), "before")
        kept = F.greatest(F.lit(0).cast("long"), F.least(F.element_at("counts", full + 1), F.lit(quota[full]) - F.col("before")))
        state = state.withColumn("which", F.lit(full)).withColumn("kept", kept)
        state = cut(state.select("key", F.transform("counts", lambda c, s: F.when(s == F.col("which"), F.col("kept")).otherwise(c)).alias("counts")))
        held[full] = quota[full]
    room = [q - x for q, x in zip(quota, held, strict=True)]

    # Ranks of a group's members decide: the first of them go to shard 0 as far as it has counts, the next to shard 1, and so on.
    ends = F.transform("counts", lambda c, s: _sum(F.slice("counts", F.lit(1), s + 1)))
    by_salt = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.withColumn("start", F.sum("c").over(by_salt) - F.col("c")).join(state.select("key", ends.alias("ends")), "key").select("key", "salt", "start", "ends")
    member = base.join(placed, ["key", "salt"], "left")
    rank = F.col("start") + F.row_number().over(Window.partitionBy("key", "salt").orderBy("doc_id", "size")) - 1
    member = member.withColumn("rank", rank)
    linked = F.when(F.col("rank") < F.element_at("ends", -1), F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    member = member.select("doc_id", "size", "text_crc32", "key", F.coalesce("rank", F.lit(0)).alias("rank"), linked.alias("linked"))

    # What is left over is dealt in order of groups, so that most of them stay together; large ones are many buckets.
    filling = member.withColumn("bucket", fold_row_id(F.col("key"), F.floor(F.col("rank") / 20_000), seed=seed + 50, modulus=buckets)).withColumn("one", F.lit(1))
    filling = running_total(filling, ["one"], "bucket", [F.col("key"), F.col("rank"), F.col("doc_id")], F.col("linked").isNull().cast("long"), "free_rank")
    fill, reach = F.lit(n_shards - 1), sum(room)
    for s in range(n_shards - 1, -1, -1):
        fill = F.when(F.col("free_rank") < reach, F.lit(s)).otherwise(fill)
        reach -= room[s]
    sharded = cut(filling.select("doc_id", "size", "text_crc32", F.coalesce("linked", fill).cast("int").alias("shard")))
    sharded = sharded.withColumn("bucket", fold_row_id(F.col("doc_id"), F.col("size"), seed=seed + 90, modulus=buckets))
    sharded = running_total(sharded, ["shard"], "bucket", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], F.lit(1).cast("long"), "slot")
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(docs: DataFrame, sharded: DataFrame) -> DataFrame:
    """By group of equal texts: its documents, and its shards; what the propagation keeps small."""
    groups = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).join(sharded.select("doc_id", "shard"), "doc_id")
    return groups.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shard").alias("shards")).where("n > 1")
