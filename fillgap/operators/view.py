"""Records as flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat(records: DataFrame) -> DataFrame:
    """The columns of the flat view; -1 for an absent chain or parent."""
    return records.select(
        "reference_name", "pos", "depth", "kind", "reference_start", "reference_end", "query_name", "query_start", "query_end",
        F.coalesce("chain_id", F.lit(-1)).alias("chain_id"), F.coalesce("parent", F.lit(-1)).alias("parent"),
    )
