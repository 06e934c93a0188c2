"""The response cache as a kept table: what is live, what a run adds, and what has to go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillflow.operators.history import keep_newest
from quillflow.sources.tables import finished, read_batches, write_batch

ANSWER_COLUMNS = {
    "content": "string", "prompt_tokens": "bigint", "completion_tokens": "bigint", "total_tokens": "bigint",
    "cost_usd": "double", "latency_ms": "double", "finish_reason": "string"}
CACHE_SCHEMA = "call_key string, " + ", ".join(f"{n} {k}" for n, k in ANSWER_COLUMNS.items()) + (
    ", cached_at timestamp, used_at timestamp")


def live_cache(cache: DataFrame, as_of: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Entries that were cached within the ttl; use doesn't prolong it."""
    return cache.where(F.col("cached_at") >= as_of - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def refresh_cache(
    cache: DataFrame, results: DataFrame, as_of: Column, used_at: str = "completed_at",
    ttl_seconds: int = 3600, max_rows: int = 1000,
) -> DataFrame:
    """The cache after a run: one row per key.

    ``results`` are rows of ``complete``: good answers of shared calls. A known key keeps its answer and
    moves its last use; a new or expired one is cached at its first use. Then the ``max_rows``
    entries with the latest use stay, which is what a list with eviction of the least recently used
    holds in the end. Counts by second decide all but the entries of one second.
    """
    shared = results.where(
        F.col("error_type").isNull() & F.col("prompt").isNotNull() & ~F.startswith("call_key", F.lit("once:")))
    first = F.struct(*(F.col(n).cast(k).alias(n) for n, k in ANSWER_COLUMNS.items()))
    used = shared.groupBy("call_key").agg(
        F.min_by(first, used_at).alias("_new"), F.min(used_at).alias("_first"), F.max(used_at).alias("_last"))
    joined = live_cache(cache, as_of, ttl_seconds).join(used, "call_key", "full_outer")
    known = F.col("cached_at").isNotNull()
    rows = joined.select(
        "call_key",
        *(F.when(known, F.col(n)).otherwise(F.col(f"_new.{n}")).alias(n) for n in ANSWER_COLUMNS),
        F.coalesce("cached_at", "_first").alias("cached_at"), F.greatest("used_at", "_last").alias("used_at"))
    every = rows.withColumn("_all", F.lit(0))
    return keep_newest(every, "_all", "used_at", "call_key", max_rows, 1.0).drop("_all")


def load_cache(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The cache of the last finished batch (before a batch); empty before the first one."""
    found = [b for b in finished(spark, path, "batch") if before is None or b < before]
    return read_batches(spark, path, CACHE_SCHEMA, [f"{path}/batch={b}" for b in found[-1:]])


def save_cache(rows: DataFrame, path: str, batch_id: int) -> None:
    """Store the whole cache as the state after a batch."""
    write_batch(rows, path, batch_id)
