"""Windowed duplicates, limits and prefix sums against plain loops, with one hot key."""

import random
import re
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from quillflow.operators.dedup import dedup_first, dedup_window, mark_first
from quillflow.operators.failure import failure_runs
from quillflow.operators.history import keep_newest, newest_first
from quillflow.operators.limits import budget_gate, bucket_admission, sliding_admission
from quillflow.operators.scan import running_total


def make_rows(seed, count=4000, span=20000):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}", rng.randint(0, span),
             rng.randint(0, 9)) for i in range(count)]


ROWS = make_rows(7)
ORDERED = sorted(ROWS, key=lambda r: (r[2], r[0]))


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.createDataFrame(ROWS, "id long, key string, sec long, cost long")
    return df.withColumn("ts", F.timestamp_seconds("sec")).cache()


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


@pytest.mark.parametrize("window,slab", [(1, None), (60, None), (60, 60), (300, 900), (9000, None)])
def test_dedup_window(frame, window, slab):
    last, want = {}, set()
    for i, key, sec, _ in ORDERED:
        if key not in last or sec - last[key] >= window:
            last[key] = sec
            want.add(i)
    assert ids(dedup_window(frame, "key", "ts", "id", window, slab)) == want


def test_dedup_window_small_batches(spark, frame):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_dedup_window(frame, 60, 600)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dedup_first_keeps_rows_without_key(frame):
    some = frame.withColumn("key", F.when(F.col("id") % 50 > 0, F.col("key")))
    first = {}
    for i, key, _, _ in ORDERED:
        first.setdefault(i if i % 50 == 0 else key, i)
    assert ids(dedup_first(some, "key", "ts", "id")) == set(first.values())
    assert ids(mark_first(some, "key", "ts", "id", "first").where("first")) == set(first.values())


@pytest.mark.parametrize("window,rate", [(60, 3), (60, 20), (600, 5), (10, 1)])
def test_sliding_admission(frame, window, rate):
    held, want = defaultdict(deque), set()
    for i, key, sec, _ in ORDERED:
        recent = held[key]
        while recent and recent[0] <= sec - window:
            recent.popleft()
        if len(recent) < rate:
            recent.append(sec)
            want.add(i)
    assert ids(sliding_admission(frame, "key", "ts", "id", rate, window).where("admitted")) == want


@pytest.mark.parametrize("rate,capacity,need", [(0.1, 3, None), (0.01, 2, None), (0.5, 20, "cost")])
def test_bucket_admission(frame, rate, capacity, need):
    state, want = {}, set()
    for i, key, sec, cost in ORDERED:
        tokens = capacity
        if key in state:
            tokens = min(capacity, state[key][0] + (sec - state[key][1]) * rate)
        amount = 1 if need is None else cost
        if tokens >= amount:
            want.add(i)
            tokens -= amount
        state[key] = (tokens, sec)
    got = bucket_admission(frame, "key", "ts", "id", F.lit(rate), F.lit(float(capacity)),
                           need=None if need is None else F.col(need), slab_seconds=120)
    assert ids(got.where("admitted")) == want


@pytest.mark.parametrize("bucket", [60, 600, 100000])
def test_budget_gate(frame, bucket):
    spent, want = defaultdict(int), set()
    for i, key, sec, cost in ORDERED:
        if spent[key, sec // 7200] < 300:
            want.add(i)
        spent[key, sec // 7200] += cost
    gated = budget_gate(frame, ["key"], "ts", "id", F.col("cost"), F.lit(300), 7200, bucket)
    assert gated.count() == len(ROWS)
    assert ids(gated.where("admitted")) == want


def test_rows_without_key_are_kept(frame):
    some = frame.withColumn("key", F.when(F.col("id") % 50 > 0, F.col("key"))).withColumn(
        "ts", F.when((F.col("id") % 70 > 0) | F.col("key").isNull(), F.col("ts")))
    for out in (budget_gate(some, ["key"], "ts", "id", F.col("cost"), F.lit(300), 7200, 600),
                sliding_admission(some, "key", "ts", "id", 3, 60),
                running_total(some, ["key"], "ts", "id", F.col("cost"), "before", 600)
                .withColumn("admitted", F.lit(True))):
        assert out.count() == len(ROWS)
        assert out.where("key IS NULL AND NOT admitted").count() == 0
    flagged = bucket_admission(some, "key", "ts", "id", F.lit(0.1), F.lit(3.0))
    assert flagged.count() == len(ROWS)
    kept = dedup_window(some, "key", "ts", "id", 60)
    assert kept.where("key IS NULL").count() == sum(1 for r in ROWS if r[0] % 50 == 0)


def test_running_total(frame):
    total, want = defaultdict(int), {}
    for i, key, _, cost in ORDERED:
        want[i] = total[key]
        total[key] += cost
    out = running_total(frame, ["key"], "ts", "id", F.col("cost"), "before", 600)
    assert {r["id"]: r["before"] for r in out.collect()} == want


def test_keep_newest(frame):
    groups, want = defaultdict(list), set()
    for row in ORDERED:
        groups[row[1]].append(row[0])
    for members in groups.values():
        want.update(members[-50:])
    assert ids(keep_newest(frame, "key", "ts", "id", 50, 600)) == want


def test_failure_runs(frame):
    runs, want = defaultdict(list), []
    for i, key, sec, cost in ORDERED:
        if cost < 6:
            runs[key].append(sec)
        else:
            if len(runs[key]) >= 4:
                want.append((key, len(runs[key])))
            runs[key] = []
    want += [(key, len(run)) for key, run in runs.items() if len(run) >= 4]
    got = failure_runs(frame, ["key"], "ts", "id", F.col("cost") < 6, 4, 600)
    assert sorted((r["key"], r["failures"]) for r in got.collect()) == sorted(want)


def test_deep_pages_equal_sorted_rows(spark):
    """Ties, a very common time, rows without a time, and pages across all edges."""
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 7, 7, rng.randint(0, 10**6), rng.randint(0, 50), 4 * 10**15])) for i in range(4000)]
    frame = spark.createDataFrame(rows, "id int, us long").repartition(5).select(
        "id", F.timestamp_micros("us").alias("ts"))
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    for skip in (0, 19, 21, 640, 700, 1990, 2000, 2650, 3330, 3420, 3990, 4000, 5000):
        for limit in (1, 100, 900):
            got = [r["id"] for r in newest_first(frame, "ts", "id", skip, limit, deep=20).collect()]
            assert got == want[skip:skip + limit], (skip, limit)
    assert newest_first(frame.where("false"), "ts", "id", 30, 10, deep=20).count() == 0


def test_a_deep_page_orders_its_piece_only(spark):
    frame = spark.range(1_000_000).select("id", F.timestamp_micros(F.col("id") * 1000).alias("ts"))
    found = newest_first(frame, "ts", "id", 900_000, 50)
    assert [r["id"] for r in found.collect()] == list(range(99_999, 99_949, -1))
    kept = re.search(r"TakeOrderedAndProject\(limit=(\d+)", found._jdf.queryExecution().executedPlan().toString())
    assert int(kept.group(1)) <= 10_000 + 50
