"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source deserves the same share of copies, target / source size, which is seldom whole. The whole
part is granted at once. The rest of each document is a mass of words between 0 and the document's size; two documents
at a time, one hands words to the other, at odds that leave both expectations as they were, until one of them holds
none or all of its words. The words of a source are therefore the same after every step. Documents meet in blocks of
about ``fan_in``; the one unfinished document of each block goes to the next level, so the levels form a reduction tree
whose height is the logarithm of the rows. Only DataFrame functions run here.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fillgap.llm.common import columns_of, cut

WORDS = r"[^\x20\x09-\x0D]+"
KEY = "struct<mark:bigint,row:bigint>"
ITEM = f"struct<id:bigint,size:bigint,key:{KEY},mass:double>"
DONE = f"array<struct<id:bigint,size:bigint,key:{KEY},full:boolean>>"


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), cap: float = 2.0) -> DataFrame:
    """Targets by source from rows of (source, size): one row per source with source, n_docs, source_size, weight, target.

    Sources take the weights in turn, by code point and null last, and share ``share`` times all words by weight. None
    gets above ``cap`` times its size; what it can't take is shared anew among the others by weight. One row per source
    meets in one task here, never rows of documents. Without any word all targets are 0.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy(F.lit(1))
    fullest = Window.partitionBy(F.lit(1)).orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # If all sources before this one stop at their limits, the others get `rate` words for each unit of weight.
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - (F.sum("limit").over(fullest) - F.col("limit"))
    rest = F.sum("weight").over(everything) - (F.sum("weight").over(fullest) - F.col("weight"))
    per = per.withColumn("rate", left / rest)
    fits = F.col("rate") * F.col("weight") <= F.col("limit")
    per = per.withColumn("rate", F.min_by(F.when(fits, F.col("rate")), F.when(fits, F.col("limit") / F.col("weight"))).over(everything))
    target = F.coalesce(F.least(F.col("rate") * F.col("weight"), F.col("limit")), F.col("limit"))
    return per.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def _settle(items, seed: int):
    """Fold a block: (unfinished document, finished documents)."""

    def item(of, mass):
        return F.struct(of["id"].alias("id"), of["size"].alias("size"), of["key"].alias("key"), mass.alias("mass")).cast(ITEM)

    def step(acc, x):
        c, done = acc["carry"], acc["done"]
        to_x, to_c = F.least(c["mass"], x["size"] - x["mass"]), F.least(c["size"] - c["mass"], x["mass"])
        u = F.pmod(F.xxhash64(F.lit(seed), c["id"], x["id"], c["size"], x["size"]), F.lit(1 << 30)) / F.lit(float(1 << 30))
        give = u * (to_x + to_c) < to_c
        c_left, x_left = c["mass"] <= x["size"] - x["mass"], x["mass"] <= c["size"] - c["mass"]

        def both(carry, finished, full):
            one = F.struct(finished["id"].alias("id"), finished["size"].alias("size"), finished["key"].alias("key"), F.lit(full).alias("full"))
            return F.struct(carry.alias("carry"), F.concat(done, F.array(one)).cast(DONE).alias("done"))

        return (
            F.when(c.isNull(), F.struct(x.cast(ITEM).alias("carry"), done.alias("done")))
            .when(give & c_left, both(item(x, x["mass"] + c["mass"]), c, False))
            .when(give, both(item(c, c["mass"] - to_x), x, True))
            .when(x_left, both(item(c, c["mass"] + x["mass"]), x, False))
            .otherwise(both(item(x, x["mass"] - to_c), c, True))
        )

    start = F.struct(F.lit(None).cast(ITEM).alias("carry"), F.array().cast(DONE).alias("done"))
    return F.aggregate(items, start, step)


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), cap: float = 2.0, fan_in: int = 128, seed: int = 20) -> DataFrame:
    """How many words the mix takes of each document.

    Input: doc_id (long), text, source; other columns are ignored, whatever their names. Output, one row for every
    input row: doc_id, source, size (words; 0 for null or empty text), source_size, target (of the source), taken.
    ``taken`` is a multiple of ``size`` but for at most one document of each source, which takes the words left over.
    Documents without words take 0. Repeated rows and null ids are rows of their own; no rows give no rows. The draw
    depends on ``seed`` and the rows alone, so runs agree.
    """
    taken = _taken(docs, F.lit(None).cast(KEY), share, weights, cap, fan_in, seed)
    return taken.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def _taken(docs: DataFrame, key: Column, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), cap: float = 2.0, fan_in: int = 128, seed: int = 20) -> DataFrame:
    """``mix`` with the ``key`` of each row: its row number, after a mark that orders rows of one id and size."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("id"), "source", words.alias("size"), key.alias("key")))
    per = cut(source_targets(sized, share, weights, cap).withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    most = per.agg(F.max("n_docs")).first()[0] or 0
    few = F.broadcast if per.count() <= 10_000 else (lambda df: df)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio)
    rows = sized.join(few(per), sized["source"].eqNullSafe(per["source"])).select(
        "no", "n_docs", "id", "size", "key", ((ratio - whole) * F.col("size")).alias("mass")
    )
    parted = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    finished = [rows.where(~parted).select("no", "id", "size", "key", F.when(F.col("mass") > 0, F.col("size")).otherwise(0).cast("long").alias("extra"))]
    left, level = rows.where(parted), 0
    while True:
        blocks = F.ceil(F.col("n_docs") / F.lit(float(fan_in ** (level + 1))))
        block = F.pmod(F.xxhash64(F.lit(seed + level), "id", "size", "mass"), blocks)
        items = F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "id").alias("h"), "id", "size", "mass", "key")))
        items = F.transform(items, lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["key"].alias("key"), x["mass"].alias("mass")))
        folded = cut(
            left.groupBy("no", "n_docs", block.alias("block")).agg(items.alias("items")).select("no", "n_docs", _settle(F.col("items"), seed + level).alias("s")).select("no", "n_docs", "s.*")
        )
        done = folded.select("no", F.explode("done").alias("d"))
        finished.append(done.select("no", "d.id", "d.size", "d.key", F.when(F.col("d.full"), F.col("d.size")).otherwise(0).cast("long").alias("extra")))
        left = folded.select("no", "n_docs", "carry.*")
        if most <= fan_in ** (level + 1):
            break
        level += 1
    finished.append(left.select("no", "id", "size", "key", F.round("mass").cast("long").alias("extra")))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    out = out.join(few(per), "no")
    return out.select("id", "source", "size", "key", "source_size", "target", (whole * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: every document as many times as the mix takes it whole.

    Documents that the mix takes in part or not at all are left out; a row taken twice appears twice. Rows with a null
    id and repeated rows of an id are rows of their own here too. Documents without words stay as they are.
    """
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    key = F.struct(F.xxhash64("text").alias("mark"), F.col("__row").alias("row"))
    taken = _taken(rows, key, **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    taken = taken.select(F.col("key.row").alias("__row"), copies.alias("__copies")).where(F.col("__copies") > 0)
    kept = rows.join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return kept.select(*columns_of(docs))
