"""Physical plans: what must not appear at scale, and what must."""

import re

import catalog
import pytest
from pyspark.sql import functions as F
from tapeloom.operators.ranking import latest_per_key, page
from tapeloom.sources.views import Views

catalog.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_join_and_no_single_task_window(spark, folder, name):
    text = plan(catalog.QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            assert not any("SinglePartition" in x for x in lines[i + 1 : i + 4]), name


def test_per_key_limits_trim_before_the_shuffle(spark, folder):
    text = plan(latest_per_key(Views(spark, folder).jobs, ["job_id"], [F.col("created_at").desc()]))
    partial, exchange = text.index("Partial"), text.index("Exchange")
    assert "WindowGroupLimit" in text and partial > exchange  # the plan prints top-down


def test_top_k_is_not_a_global_sort(spark, folder):
    text = plan(catalog.QUERIES["screen_all"](spark, folder))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_page_total_is_a_subquery(spark, folder):
    text = plan(page(Views(spark, folder).rel, [F.col("trade_date")], 0, 5))
    assert "Subquery" in text and "Window" not in text


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(Views(spark, folder).table("lineitem").where("l_quantity > 10").select("l_orderkey"))
    assert "GreaterThan(l_quantity,10.0)" in text
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double>", text)


def test_hot_join_keys_are_split(spark):
    """One key with a third of the rows: AQE splits its partition instead of leaving one task."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        facts = spark.range(0, 300_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("code"), F.sha2(F.col("id").cast("string"), 256).alias("body"))
        master = spark.range(0, 300_000, 1, 8).select(F.col("id").alias("code"), (F.col("id") * 2).alias("m"))
        counted = facts.join(master, "code", "left")
        assert counted.where("body IS NOT NULL").groupBy().agg(F.count("m")).first()[0] == 300_000
        done = facts.join(master, "code", "left")
        done._jdf.collectToPython()
        assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_skewed_keys_keep_whole_results(spark):
    """A third of the rows on one key: dedup and grouping stay exact."""
    from tapeloom.operators.ranking import representative
    df = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("o"))
    assert latest_per_key(df, ["k"], [F.col("o").desc()]).where("k = 1").first()["o"] == 89_997
    top = representative(df, ["k"], -F.col("o"), ["o"], "n").where("k = 1").first()
    assert (top["n"], top["o"]) == (30_001, 89_997)
