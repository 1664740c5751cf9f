"""Time the headline operations over one scale factor and print one line of JSON.

Records and chains are made from the driver's tables once and read from Parquet by every operation, as a user's would be.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgap.operators import arrange, chain, construct, context, interval, policies, stats, validate
from fillgap.operators.predicates import NetPredicate
from fillgap.plans import fixtures

DEPTH = 2


def operations(records: DataFrame, sections: DataFrame, chains: DataFrame, probes: DataFrame) -> dict:
    strong = NetPredicate(min_score=100_000, kinds=["fill"]).matches()
    middling = NetPredicate(kinds=["fill"], min_score=20_000, max_score=200_000).matches()
    twice = [x.withColumn("file_id", F.lit(i)) for x in (sections, records) for i in (0, 1)]

    def merged() -> DataFrame:
        kept = arrange.merge_sections(twice[0].unionByName(twice[1]), arrange.KEEP_ALL)
        return arrange.records_of(twice[2].unionByName(twice[3]), kept)

    return {
        "filter_prune": lambda: policies.filter_records(records, strong, policies.PRUNE, DEPTH),
        "filter_promote": lambda: policies.filter_records(records, middling, policies.PROMOTE, DEPTH),
        "sort_records": lambda: arrange.sort_records(records, DEPTH),
        "merge_keep_all": merged,
        "stats_summary": lambda: stats.summary(records, sections),
        "validate_all": lambda: validate.issues(records, sections),
        "fill_contexts": lambda: context.fill_contexts(records, DEPTH),
        "uninterrupted_spans": lambda: context.uninterrupted_spans(records),
        "interval_overlap": lambda: interval.overlapping(records, probes),
        "net_construct_reference": lambda: construct.build(chains, chain.REFERENCE),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start, out = time.perf_counter(), tempfile.mkdtemp(prefix="spark-bench-")
    tables = {"records": fixtures.net_orders(spark, folder), "chains": fixtures.chains_orders(spark, folder)}
    for name, table in tables.items():
        table.write.parquet(f"{out}/{name}")
    records, chains = (spark.read.parquet(f"{out}/{name}") for name in tables)
    fixtures.sections_of(records).write.parquet(f"{out}/sections")
    run = operations(records, spark.read.parquet(f"{out}/sections"), chains, fixtures.probes(spark))
    n = {"records": records.count(), "chains": chains.count()}
    run["stats_summary"]().write.format("noop").mode("overwrite").save()  # a warm-up
    prepared = time.perf_counter() - start
    took = {}
    for name, operation in run.items():
        start = time.perf_counter()
        operation().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "prepare_sec": round(prepared, 3), **n}))


if __name__ == "__main__":
    main()
