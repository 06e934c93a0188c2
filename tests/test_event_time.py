"""Stateful operators on streams whose rows arrive out of order, over many micro-batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillflow.plans.flow_queries import with_state_conf
from quillflow.session import shared_folder
from quillflow.streaming.windows import (
    BucketAdmission, BudgetGate, SlidingAdmission, WindowDedup, label_stream, run_to_table)

START = dt.datetime(2024, 1, 1)
SCHEMA = "key string, id long, ts timestamp, need double"


def events(count: int, seed: int):
    """Rows of three keys, one of them with most rows; times repeat and lie days apart now and then."""
    pick, at, rows = random.Random(seed), 0, []
    for k in range(count):
        at += pick.choice([0, 1, 20, 300, 5000] + [90_000] * (k % 40 == 0))
        rows.append((pick.choice(["busy"] * 4 + ["calm", None]), k, START + dt.timedelta(seconds=at), float(pick.randint(1, 5))))
    return rows


def plain(processor, rows):
    """The same steps over the sorted rows of each key, in a loop that never forgets."""
    states, out = {}, {}
    for key, row_id, ts, need in sorted(rows, key=lambda r: (r[2], r[1])):
        micros = round((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
        states[key], out[row_id] = processor.step(states.get(key), micros, need)
    return out


def run(spark, batches, processor, lateness):
    """Labels of a stream of one file per micro-batch, and the folder of its checkpoint."""
    with_state_conf(spark)
    folder = shared_folder(spark, "feed")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        # Files are taken by time of writing.
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    labels = run_to_table(label_stream(stream, "key", "ts", "id", processor, "need", lateness))
    return {r.id: r.admitted for r in labels.where(F.coalesce("key", F.lit("")) != "closing").collect()}


def closing(rows, days: int = 60):
    return [("closing", -1, max(r[2] for r in rows) + dt.timedelta(days=days), 0.0)]


@pytest.mark.parametrize("processor", [
    WindowDedup(600), SlidingAdmission(3, 3600), BucketAdmission(0.002, 6.0), BudgetGate(40.0, 24 * 3600)],
    ids=lambda p: type(p).__name__)
def test_any_order_gives_the_batch_result(spark, processor):
    rows = events(240, 3)
    # Every batch holds rows of all times within the lateness of 40 days; then one row moves the watermark.
    mixed = list(rows)
    random.Random(5).shuffle(mixed)
    batches = [mixed[k::4] for k in range(4)] + [closing(rows)]
    assert run(spark, batches, processor, "40 days") == plain(processor, rows)


def test_small_lateness_and_forgotten_state(spark):
    """Rows up to two hours late are judged in order while earlier batches are already out."""
    rows = events(200, 8)
    order = sorted(rows, key=lambda r: r[2])
    late = [(r, r[2] + dt.timedelta(hours=random.Random(r[1]).uniform(0, 1.9))) for r in order]
    arrived = [r for r, _ in sorted(late, key=lambda x: x[1])]
    batches = [arrived[k:k + 25] for k in range(0, 200, 25)] + [closing(rows)]
    processor = WindowDedup(600)
    assert run(spark, batches, processor, "2 hours") == plain(processor, rows)


def test_states_run_out():
    dedup, sliding, bucket, budget = WindowDedup(10), SlidingAdmission(2, 10), BucketAdmission(0.5, 4.0), BudgetGate(5.0, 60)
    second = 1_000_000
    for processor, needs in ((dedup, [1, 1]), (sliding, [1, 1, 1]), (bucket, [3, 1, 1]), (budget, [4, 4, 4])):
        state = None
        for k, need in enumerate(needs):
            state, _ = processor.step(state, (100 + k) * second, float(need))
        ends = processor.expires(state)
        for need in (1.0, 4.0):
            assert processor.step(state, int(ends) + second, need)[1] == processor.step(None, int(ends) + second, need)[1]


def test_nothing_is_kept_for_silent_keys(spark):
    rows = [("a", 1, START, 1.0), ("b", 2, START, 1.0), ("a", 3, START + dt.timedelta(seconds=5), 1.0)]
    with_state_conf(spark)
    folder = shared_folder(spark, "feed")
    for part in (rows, closing(rows)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    labels = label_stream(stream, "key", "ts", "id", WindowDedup(600), "need", "1 hour")
    checkpoint = f"{folder}-checkpoint"
    labels.writeStream.format("parquet").option("path", f"{folder}-out").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    for name in ("state", "timer"):
        left = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
        assert {r["key"]["key"] for r in left.select("key").collect()} <= {"closing"}


def test_held_rows_are_packed(spark):
    """A hot key holds an entry of bytes per batch, not one per row; null ids are judged first and stay null."""
    with_state_conf(spark)
    folder = shared_folder(spark, "feed")
    rows = [("a", None if k == 7 else k, START + dt.timedelta(seconds=k // 3), 1.0) for k in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    checkpoint = f"{folder}-checkpoint"

    def go() -> None:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        label_stream(stream, "key", "ts", "id", SlidingAdmission(2, 3600), "need", "40 days").writeStream.format(
            "parquet").option("path", f"{folder}-out").option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start().awaitTermination()

    go()
    held = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    assert held.count() == 3
    spark.createDataFrame(closing(rows), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    go()
    found = spark.read.parquet(f"{folder}-out").where("key = 'a'").collect()
    assert {r.id for r in found} == {r[1] for r in rows} and len(found) == 300
    assert {r.id for r in found if r.admitted} == {0, 1}
