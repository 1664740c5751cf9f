"""Summary statistics of nets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(records: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: nets, records, fills, gaps, bases of fills, max_depth, distinct names and chain ids (of any record)."""
    fill = F.col("kind") == "fill"
    nets = sections.agg(F.count(F.lit(1)).alias("nets"))
    rest = records.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(fill).alias("fills"),
        F.count_if(~fill).alias("gaps"),
        F.coalesce(F.sum(F.when(fill, F.col("reference_size"))), F.lit(0)).alias("reference_bases"),
        F.coalesce(F.sum(F.when(fill, F.col("query_size"))), F.lit(0)).alias("query_bases"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.count_distinct("query_name").alias("distinct_query_names"),
        F.count_distinct("chain_id").alias("distinct_chain_ids"),
    )
    return nets.crossJoin(rest)  # one row each


def records_per_depth(records: DataFrame) -> DataFrame:
    """depth, records: every depth from 0 to the deepest."""
    counted = records.groupBy("depth").agg(F.count(F.lit(1)).alias("records"))
    deepest = records.agg(F.max("depth").alias("d")).where("d is not null").select(F.explode(F.sequence(F.lit(0), "d")).alias("depth"))
    return deepest.join(counted, "depth", "left").select("depth", F.coalesce("records", F.lit(0)).alias("records"))


def type_counts(records: DataFrame) -> DataFrame:
    return records.where("net_type is not null").groupBy("net_type").agg(F.count(F.lit(1)).alias("records"))


def unknown_attribute_names(records: DataFrame) -> DataFrame:
    """Occurrences of every undocumented key, not records."""
    return records.select(F.explode("extras").alias("x")).groupBy(F.col("x.key").alias("key")).agg(F.count(F.lit(1)).alias("occurrences"))


def used_chain_ids(records: DataFrame, by_section: bool = False) -> DataFrame:
    """Sorted distinct chain ids of fills, of each section or of all; one row an id."""
    keys = ["net_id", "chain_id"] if by_section else ["chain_id"]
    return records.where("kind = 'fill' and chain_id is not null").select(*keys).distinct()


#: Fixed layout of the report: label (21 wide) and column of the summary, around the counts by depth.
LABELS = (("reference nets", "nets"), ("records", "records"), ("  fills", "fills"), ("  gaps", "gaps"), ("max depth", "max_depth"))
LABELS_BELOW = (("distinct chain ids", "distinct_chain_ids"), ("distinct query names", "distinct_query_names"), ("reference bases", "reference_bases"), ("query bases", "query_bases"))


def report(records: DataFrame, sections: DataFrame) -> str:
    """The text of the stats command: one row for the whole input, and a line for each depth, type and undocumented key."""
    s = summary(records, sections).first().asDict()
    depths = [(f"  depth {r['depth']}", r["records"]) for r in records_per_depth(records).orderBy("depth").collect()]
    rows = [(label, s[c]) for label, c in LABELS] + depths + [(label, s[c]) for label, c in LABELS_BELOW]
    lines = [f"{label:<20} {n}" for label, n in rows]
    for title, table, key, n in (("types:", type_counts(records), "net_type", "records"), ("unknown attributes:", unknown_attribute_names(records), "key", "occurrences")):
        found = [f"  {r[key]:<18} {r[n]}" for r in table.orderBy(key).collect()]
        lines += [title, *found] if found else []
    return "\n".join(lines) + "\n"
