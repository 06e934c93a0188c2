"""The physical plans that large inputs depend on."""

import re

import pytest
from pyspark.sql import functions as F

from quillflow.operators.complete import complete
from quillflow.operators.dedup import dedup_first
from quillflow.operators.history import keep_newest, newest_first, select_history
from quillflow.operators.match import match_agents
from quillflow.plans.answer_queries import demo_client
from quillflow.plans.views import AGENTS, changes, executions
from quillflow.session import spread_small

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.fixture
def conf(spark):
    kept = {}

    def change(**values):
        for key, value in values.items():
            name = key.replace("__", ".")
            kept[name] = spark.conf.get(name, None)
            spark.conf.set(name, value)

    yield change
    for name, value in kept.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def test_match_reads_events_once_without_shuffle(spark):
    text = plan(match_agents(changes(spark, SMALL), AGENTS).select("event_id", "agent_id"))
    assert text.count("FileScan") == 1 and "hashpartitioning" not in text
    assert "BroadcastHashJoin" in text


def test_history_filter_reaches_the_files(spark):
    rows = select_history(executions(spark, SMALL), {"status": "failed"}, "started_at", "1996-01-01")
    text = plan(newest_first(rows, "started_at", "id", limit=10).select("id", "agent_id"))
    assert "TakeOrderedAndProject" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "o_totalprice" not in schema
    assert "o_orderdate" in text.split("PushedFilters")[1]


def test_duplicates_are_limited_before_the_shuffle(spark):
    text = plan(dedup_first(changes(spark, SMALL).select("event_id", "ts", "document_id"),
                            "document_id", "ts", "event_id"))
    partial, exchange = text.index("Partial"), text.index("Exchange hashpartitioning")
    assert exchange < partial  # printed from the result down to the scan


def test_newest_rows_sort_only_the_cut(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    text = plan(keep_newest(executions(spark, SMALL), "agent_id", "started_at", "id", 10))
    assert "_bucket" in text and "row_number" not in text


def test_hot_request_is_split_in_the_join_back(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1",
         spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
         spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="2KB",
         spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.2",
         spark__sql__adaptive__advisoryPartitionSizeInBytes="1KB",
         spark__sql__adaptive__coalescePartitions__enabled="false")
    ids = spark.range(0, 60000, 1, 8)
    prompt = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 500))
    requests = ids.select(
        F.col("id").alias("work_item_id"), F.lit("m").alias("model"), prompt.alias("prompt"),
        F.lit(None).cast("string").alias("system_prompt"), F.lit(0.0).alias("temperature"),
        F.lit(9).alias("max_tokens"))
    done = complete(requests, demo_client, tasks=4)
    assert len(done.collect()) == 60000
    assert "skew=true" in plan(done)


def test_only_small_inputs_are_spread(spark):
    small = spark.read.parquet(f"{SMALL}/events.parquet")
    assert "RoundRobin" in plan(spread_small(small))
    large = spark.range(10**12)
    assert "RoundRobin" not in plan(spread_small(large))
