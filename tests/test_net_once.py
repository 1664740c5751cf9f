"""Queries on nets work records out once, and what they then do with roots and levels at hand is what a plain walk finds."""

import pytest
from pyspark.sql import functions as F

from fillgap import plans
from fillgap.operators import scan, tree
from fillgap.plans import fixtures
from tests.test_tree import SCHEMA, forest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["filter_prune", "filter_non_nested", "tree_siblings", "validate_all", "sort_records", "fill_context_of_one"])
def test_line_items_are_read_once(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") <= 1


def test_roots_are_those_of_the_records(spark):
    records, _, _, tops = fixtures.whole_net(spark, SF)
    named = [c for c in records.columns if c != "extras"]
    assert sorted(map(str, tree.roots(records).select(named).collect())) == sorted(map(str, tops.select(named).collect()))


def test_tasks_follow_the_records(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    records, sections, _ = fixtures.net(spark, SF)
    total = sections.agg(F.sum("record_count")).first()[0]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert records.rdd.getNumPartitions() == -(total // -500)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("n", [4, 1000])
def test_tasks_are_not_joined_by_compressed_bytes(spark, monkeypatch, n):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records, sections, _ = fixtures.net(spark, SF)
        sizes = records.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count"), F.count("p")).first()
        total = sections.agg(F.sum("record_count")).first()[0]
        assert sizes[0] < 1000 and sizes[1] <= -(total // -500)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("previous", [True, False])
def test_siblings_and_ancestors_by_level(spark, previous):
    made = tree.topology(spark.createDataFrame(forest(7), SCHEMA)).withColumn("kind", F.when(F.col("m"), "fill").otherwise("gap")).localCheckpoint()
    columns = {"pos": "p", "reference_start": "s"}
    key = lambda df: sorted(map(str, df.select("net_id", "pos", "p", "s").collect()))
    slow = tree.with_sibling(made, columns, previous, scan.WHOLE)
    assert key(tree.with_sibling(made, columns, previous, scan.WHOLE, tree.roots(made), 6)) == key(slow)
    pairs = lambda **k: sorted(map(tuple, tree.ancestors(made, made, **k).select("net_id", "pos", "ancestor", "ancestor_depth", "steps").collect()))
    assert pairs(parts=scan.WHOLE, max_depth=6) == pairs(parts=scan.parts_of(made, 3), max_depth=6) == pairs(parts=scan.WHOLE)
