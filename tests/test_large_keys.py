"""Queries on tables whose keys make coordinates behind u32, as copies with shifted keys do."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fillgap import plans
from fillgap.operators import scan
from fillgap.plans import fixtures
from fillgap.sources import writer
from tests.duck import TABLES, same

SF = "/root/testdata/sf0.001"
SHIFTED = {"orders": "o_orderkey + 10000000 AS o_orderkey", "lineitem": "l_orderkey + 10000000 AS l_orderkey"}


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shifted")
    for t in TABLES:
        replace = f"REPLACE ({SHIFTED[t]})" if t in SHIFTED else ""
        duckdb.sql(f"COPY (SELECT * {replace} FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["view_flat", "tree_parent"])
def test_sql(spark, shifted, name):
    same(spark, shifted, plans.QUERIES[name], plans.SQL[name])


def test_windows_over_trees_move_no_records(spark):
    """Records leave their deal by root, so a window over trees is no other exchange."""
    records, _, parts = fixtures.net(spark, SF)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert parts is scan.WHOLE
        assert exchanges(scan.running(records, {"n": ("sum", F.lit(1))})) == exchanges(records)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_section_digests_over_many_batches(spark):
    """Sections that arrive in many batches have the digest of their whole text."""
    records, sections, _ = fixtures.net(spark, SF)
    records = fixtures.for_text(records)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r["net_id"]: (r["bytes"], r["digest"]) for r in writer.section_digests(sections, records).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    texts = {r["net_id"]: r["text"].encode() for r in writer.section_text(sections, records).collect()}
    assert found == {i: (len(t), hashlib.md5(t).hexdigest()) for i, t in texts.items()}
