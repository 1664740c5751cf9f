"""Alignment chains: checks, absolute blocks, projections, and which chains are tried for a net."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgap.functions.ordering import is_haplotype

REFERENCE, QUERY = "reference", "query"


def absolute_blocks(chains: DataFrame) -> DataFrame:
    """Adds ``spans``: for each block its start and end on both sides, running sums of sizes and gaps."""

    def step(acc: Column, b: Column) -> Column:
        r, q = acc["r"], acc["q"]
        span = F.struct(r.alias("reference_start"), (r + b["size"]).alias("reference_end"), q.alias("query_start"), (q + b["size"]).alias("query_end"))
        return F.struct((r + b["size"] + b["gap_reference"]).alias("r"), (q + b["size"] + b["gap_query"]).alias("q"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    spans = "array<struct<reference_start:bigint,reference_end:bigint,query_start:bigint,query_end:bigint>>"
    start = F.struct(F.col("reference_start").alias("r"), F.col("query_start").alias("q"), F.array().cast(spans).alias("spans"))
    folded = F.aggregate("blocks", start, step)
    return chains.withColumn("spans", folded["spans"])


def exploded_blocks(chains: DataFrame) -> DataFrame:
    """One row a block with its absolute ends: chain_id, number, reference_start, reference_end, query_start, query_end."""
    return absolute_blocks(chains).select("chain_id", F.posexplode("spans").alias("number", "s")).select("chain_id", "number", "s.*")


def total_aligned(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + b["size"])


def projected(chains: DataFrame, side: str) -> DataFrame:
    """The chain as one side sees it: primary and other interval and blocks in order of the primary side.

    On the minus strand query coordinates run backwards from the sequence's end, and the query side reads blocks in reverse.
    """
    minus = F.col("query_strand") == "-"
    size = F.col("query_size")

    def forward(start: Column, end: Column) -> tuple[Column, Column]:
        return F.when(minus, size - end).otherwise(start), F.when(minus, size - start).otherwise(end)

    rows = absolute_blocks(chains)
    q_start, q_end = forward(F.col("query_start"), F.col("query_end"))

    def block(b: Column) -> Column:
        qs, qe = forward(b["query_start"], b["query_end"])
        mine, theirs = (b["reference_start"], b["reference_end"]), (qs, qe)
        if side == QUERY:
            mine, theirs = theirs, mine
        return F.struct(mine[0].alias("start"), mine[1].alias("end"), theirs[0].alias("other_start"), theirs[1].alias("other_end"))

    spans = F.transform("spans", block)
    if side == QUERY:
        spans = F.when(minus, F.reverse(spans)).otherwise(spans)
        primary, p_start, p_end, other, o_start, o_end = "query_name", q_start, q_end, "reference_name", F.col("reference_start"), F.col("reference_end")
    else:
        primary, p_start, p_end, other, o_start, o_end = "reference_name", F.col("reference_start"), F.col("reference_end"), "query_name", q_start, q_end
    return rows.select(
        "chain_id", "input_ordinal", "score", "query_strand", F.col(primary).alias("primary_name"), F.col(other).alias("other_name"), F.col("query_name").alias("query_name"),
        F.col("reference_size" if side == REFERENCE else "query_size").alias("primary_size"), p_start.alias("primary_start"), p_end.alias("primary_end"), o_start.alias("other_start"), o_end.alias("other_end"),
        total_aligned(F.col("blocks")).alias("total_aligned"), spans.alias("spans"),
    )


def chain_errors(chains: DataFrame, sizes: DataFrame | None = None, score_order: bool = True) -> DataFrame:
    """input_ordinal, chain_id, kind and reason of what is wrong, one row a chain: the first check that fails.

    Checks in order: scores may not rise, ids are unique, the reference strand is plus, names and sizes are those of
    ``sizes`` (side, name, size), there are blocks and none is empty, the last gaps are 0, blocks end where the header
    says, and that is inside the sequence. Ordinals have no gaps, so a chain meets the one before it in an ordinary join.
    """
    rows = chains
    checks: list[tuple[Column, str, str]] = []
    if score_order:
        before = chains.select((F.col("input_ordinal") + 1).alias("input_ordinal"), F.col("score").alias("__before"))
        rows = rows.join(before, "input_ordinal", "left")
        checks.append((F.col("score") > F.col("__before"), "UnsortedScores", "scores rise"))
    firsts = chains.groupBy("chain_id").agg(F.min("input_ordinal").alias("__first"))
    rows = rows.join(firsts, "chain_id")
    checks.append((F.col("input_ordinal") > F.col("__first"), "DuplicateChainId", "the id occurred before"))
    if "reference_strand" in chains.columns:
        checks.append((F.col("reference_strand") != "+", "InvalidReferenceStrand", "the reference strand is not plus"))
    if sizes is not None:
        for side, name, size in ((REFERENCE, "reference_name", "reference_size"), (QUERY, "query_name", "query_size")):
            known = sizes.where(F.col("side") == side).select(F.col("name").alias(name), F.col("size").alias(f"__{side}"))
            rows = rows.join(F.broadcast(known) if known.count() <= 1_000_000 else known, name, "left")
            checks += [(F.col(f"__{side}").isNull(), "MissingSequence", f"no size for the {side}"), (F.col(f"__{side}") != F.col(size), "SizeMismatch", f"another size for the {side}")]
    last = F.element_at("blocks", -1)
    reach = lambda gap: F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["size"] + b[gap])
    ends = [F.col(f"{side}_start") + reach(f"gap_{side}") != F.col(f"{side}_end") for side in (REFERENCE, QUERY)]
    outside = [(F.col(f"{side}_start") >= F.col(f"{side}_end")) | (F.col(f"{side}_end") > F.col(f"{side}_size")) for side in (REFERENCE, QUERY)]
    malformed = (
        (F.coalesce(F.size("blocks"), F.lit(0)) <= 0, "no blocks"), (F.exists("blocks", lambda b: b["size"] <= 0), "an empty block"), ((last["gap_reference"] != 0) | (last["gap_query"] != 0), "a gap after the last block"),
        (ends[0] | ends[1], "blocks end elsewhere than the header says"), (outside[0] | outside[1], "the chain leaves its sequence"),
    )
    checks += [(test, "MalformedBlocks", reason) for test, reason in malformed]
    found = F.coalesce(*[F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))) for test, kind, reason in checks])
    return rows.select("input_ordinal", "chain_id", found.alias("f")).where("f is not null").select("input_ordinal", "chain_id", "f.kind", "f.reason")


def by_sequence(chains: DataFrame, side: str = REFERENCE) -> DataFrame:
    """How many chains each sequence has, and the first and last of them by input order."""
    name = F.col("reference_name" if side == REFERENCE else "query_name").alias("name")
    return chains.groupBy(name).agg(F.count(F.lit(1)).alias("chains"), F.min_by("chain_id", "input_ordinal").alias("first_chain"), F.max_by("chain_id", "input_ordinal").alias("last_chain"))


def candidates(chains: DataFrame, min_score: float = 2000, haplotypes: bool = False) -> DataFrame:
    """Chains that are tried: those before the first one below ``min_score``, without haplotype queries unless asked for.

    Scores fall in input order, so the chains before the first low one are those that aren't low.
    """
    stop = chains.where(F.col("score") < min_score).agg(F.min("input_ordinal").alias("stop"))
    rows = chains.crossJoin(F.broadcast(stop)).where("stop is null or input_ordinal < stop").drop("stop")  # one row
    return rows if haplotypes else rows.where(~is_haplotype(F.col("query_name")))


#: Ids are unsigned numbers of 64 bits in the format. Placement carries them as the long of the same bits.
UNSIGNED = "decimal(20,0)"


def signed_id(chain_id: Column) -> Column:
    wide = chain_id.cast("decimal(21,0)")
    return F.when(wide > (1 << 63) - 1, wide - F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(wide).cast("long")


def unsigned_id(chain_id: Column) -> Column:
    wide = chain_id.cast("decimal(21,0)")
    return F.when(wide < 0, wide + F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(wide).cast(UNSIGNED)


def display_score(score: Column) -> Column:
    """Round half to even."""
    return F.rint(score).cast("long")
