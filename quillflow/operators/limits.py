"""Budgets, quotas and admission: which rows of a request log fit the limits.

These label rows; they do not wait or slow anything down.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quillflow.functions.keys import provider_of_model
from quillflow.operators.scan import MICROS, admit_until, micros, ordered_scan

# Default requests per minute by provider.
PROVIDER_REQUESTS_PER_MINUTE = {
    "openai": 60, "anthropic": 60, "google": 60, "azure": 60,
    "cohere": 100, "groq": 30, "mistral": 60,
}


def budget_gate(
    usage: DataFrame, keys: list[str], ts: str, row_id: str, spend: Column, limit: Column,
    window_seconds: int = 24 * 3600, bucket_seconds: int = 600, name: str = "admitted",
) -> DataFrame:
    """Refuse a row iff its key has already spent ``limit`` or more in this tumbling window.

    Spend is not negative, so counting refused rows too gives the same answer as counting
    admitted rows only: once the sum reaches the limit nothing later is admitted. A row without
    a key has no limit.
    """
    for key in keys:
        limit = F.when(F.col(key).isNotNull(), limit)
    started = usage.withColumn(
        "_window", micros(F.col(ts)) - F.pmod(micros(F.col(ts)), F.lit(window_seconds * MICROS)))
    gated = admit_until(
        started, [*keys, "_window"], ts, row_id, spend, limit, bucket_seconds, name=name)
    return gated.drop("_window")


def provider_limits(spark: SparkSession, overrides: dict[str, float] | None = None) -> DataFrame:
    """Limits table: provider, requests per minute, bucket capacity and refill rate."""
    limits = {**PROVIDER_REQUESTS_PER_MINUTE, **(overrides or {})}
    rows = [(p, float(n), n / 10.0, n / 60.0) for p, n in limits.items()]
    return spark.createDataFrame(
        rows, "provider string, requests_per_minute double, capacity double, rate double")


def join_quota(
    requests: DataFrame, limits: DataFrame, agent_limits: DataFrame | None = None
) -> DataFrame:
    """Attach provider limits by model and, when given, cost and token limits by agent.

    Limits are configuration with one row per provider or agent; whether they are broadcast
    is left to Spark, which knows their size.
    """
    out = requests
    if "provider" not in out.columns:
        out = out.withColumn("provider", provider_of_model(F.col("model")))
    out = out.join(limits, "provider", "left")
    return out if agent_limits is None else out.join(agent_limits, "agent_id", "left")


def sliding_admission(
    requests: DataFrame, key: str, ts: str, row_id: str, max_rate: int,
    window_seconds: float = 60.0, name: str = "admitted",
) -> DataFrame:
    """Admit iff fewer than ``max_rate`` admitted rows of the key lie in the trailing window.

    Time is cut into slabs of one window. A slab is calm when it and the slab before it hold at
    most ``max_rate`` rows: every row of it is admitted, whatever came earlier. Only stretches
    of busy slabs are scanned in order, each starting from the calm slab before it, and equal
    (key, time) rows enter the scan as one row with a count. Rows without key or time pass.
    """
    width = int(window_seconds * MICROS)
    at = micros(F.col(ts))
    slab = lambda c: ((c - F.pmod(c, F.lit(width))) / width).cast("long")
    timed = requests.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    ticks = timed.groupBy(F.col(key).cast("string").alias("_key"), at.alias("_at")).agg(
        F.count("*").alias("_n")).withColumn("_slab", slab(F.col("_at")))
    order = Window.partitionBy("_key").orderBy("_slab")
    slabs = (
        ticks.groupBy("_key", "_slab").agg(F.sum("_n").alias("_rows"))
        .withColumn("_prev_rows", F.when(F.lag("_slab").over(order) == F.col("_slab") - 1,
                                         F.lag("_rows").over(order)).otherwise(0))
        .withColumn("_busy", F.col("_rows") + F.col("_prev_rows") > max_rate)
        .withColumn("_prev_busy", F.coalesce(
            (F.lag("_slab").over(order) == F.col("_slab") - 1) & F.lag("_busy").over(order),
            F.lit(False)))
        .withColumn("_next_busy", F.coalesce(
            (F.lead("_slab").over(order) == F.col("_slab") + 1) & F.lead("_busy").over(order),
            F.lit(False)))
        .withColumn("_begin", F.last(
            F.when(F.col("_busy") & ~F.col("_prev_busy"), F.col("_slab")), ignorenulls=True)
            .over(order))
        .where("_busy OR _next_busy")
        .select("_key", "_slab", "_busy",
                F.when(F.col("_busy"), F.col("_begin")).otherwise(F.col("_slab") + 1).alias("_run"))
    )

    def make():
        # state: admitted (time, count) pairs of the trailing window, and their sum
        def step(state, times, counts, busy):
            recent, held = state or (deque(), 0)
            out = []
            for time, count, limited in zip(times, counts, busy, strict=True):
                while recent and recent[0][0] <= time - width:
                    held -= recent.popleft()[1]
                taken = min(count, max(max_rate - held, 0)) if limited else count
                if taken:
                    recent.append((time, taken))
                    held += taken
                out.append(taken)
            return (recent, held), out
        return step

    scanned = ordered_scan(
        ticks.join(slabs, ["_key", "_slab"]), ["_key", "_run"], ["_at"], make,
        ["_at", "_n", "_busy"], T.StructField("_taken", T.LongType()))
    taken = scanned.where("_busy").select("_key", "_at", "_taken")
    rows = requests.withColumn("_key", F.col(key).cast("string")).withColumn("_at", at)
    place = F.row_number().over(Window.partitionBy("_key", "_at").orderBy(row_id))
    return (
        rows.join(taken, ["_key", "_at"], "left")
        .withColumn(name, F.col("_taken").isNull() | (place <= F.col("_taken")))
        .drop("_key", "_at", "_taken")
    )


def bucket_admission(
    requests: DataFrame, key: str, ts: str, row_id: str, rate: Column, capacity: Column,
    need: Column | None = None, slab_seconds: float = 600.0, name: str = "admitted",
) -> DataFrame:
    """Token bucket without waiting: starts full, refills at ``rate``, admits iff enough is left.

    ``rate`` and ``capacity`` depend on the key only. After a pause of ``capacity / rate`` the
    bucket is full again whatever came before, so such pauses (found between slabs of time) cut
    a key into stretches that are scanned independently. Only key, time, id and need are scanned.
    A row without a key or a limit is admitted.
    """
    width = int(slab_seconds * MICROS)
    at = micros(F.col(ts))
    slim = requests.select(
        F.col(key).cast("string").alias("_key"), at.alias("_at"), F.col(row_id).alias("_id"),
        rate.cast("double").alias("_rate"), capacity.cast("double").alias("_capacity"),
        (F.lit(1.0) if need is None else need.cast("double")).alias("_need"),
    ).where(
        "_key IS NOT NULL AND _at IS NOT NULL AND _rate IS NOT NULL AND _capacity IS NOT NULL").withColumn(
        "_slab", ((F.col("_at") - F.pmod("_at", F.lit(width))) / width).cast("long"))
    order = Window.partitionBy("_key").orderBy("_slab")
    refill = F.try_divide(F.max("_capacity"), F.max("_rate")) * MICROS * 1.000001 + 1
    stretches = (
        slim.groupBy("_key", "_slab")
        .agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), refill.alias("_refill"))
        .withColumn("_fresh", F.col("_first") - F.lag("_last").over(order) >= F.col("_refill"))
        .withColumn("_run", F.last(
            F.when(F.col("_fresh"), F.col("_slab")), ignorenulls=True).over(order))
        .select("_key", "_slab", F.coalesce("_run", F.lit(-(1 << 60))).alias("_run"))
    )

    def make():
        # state: tokens left and the time of the last row
        def step(state, times, rates, capacities, needs):
            fill, most = rates[0], capacities[0]
            tokens, last = state or (most, times[0])
            out = []
            for time, amount in zip(times, needs, strict=True):
                tokens = min(most, tokens + (time - last) / MICROS * fill)
                last = time
                ok = tokens >= amount
                if ok:
                    tokens -= amount
                out.append(ok)
            return (tokens, last), out
        return step

    scanned = ordered_scan(
        slim.join(stretches, ["_key", "_slab"]), ["_key", "_run"], ["_at", "_id"], make,
        ["_at", "_rate", "_capacity", "_need"], T.StructField(name, T.BooleanType()))
    flags = scanned.select("_id", F.col(name).alias("_flag"))
    joined = requests.join(flags, requests[row_id] == F.col("_id"), "left")
    return joined.withColumn(name, F.coalesce("_flag", F.lit(True))).drop("_id", "_flag")


def retry_ratio(
    requests: DataFrame, ts: str, is_retry: Column, max_retries_per_second: float = 10.0,
    budget_ratio: float = 0.2,
) -> DataFrame:
    """Per second: requests, retries, their ratio, and whether further retries are blocked."""
    second = F.window(F.col(ts).cast("timestamp"), "1 second")
    counted = requests.groupBy(second.alias("_w")).agg(
        F.count(F.when(~is_retry, 1)).alias("requests"),
        F.count(F.when(is_retry, 1)).alias("retries"))
    ratio = F.when(F.col("requests") > 0, F.col("retries") / F.col("requests")).otherwise(0.0)
    return counted.select(
        F.col("_w.start").alias("second"), "requests", "retries",
        F.round(ratio, 6).alias("retry_ratio"),
        ((F.col("retries") >= max_retries_per_second)
         | ((F.col("requests") > 0) & (ratio >= budget_ratio))).alias("blocked"),
    )
