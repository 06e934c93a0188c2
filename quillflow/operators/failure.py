"""Failure flow: retries, dead letters, replay, stuck items, retention, failure runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillflow.functions.keys import retry_delay
from quillflow.operators.scan import running_total

# How long records are kept.
DEAD_LETTER_DAYS = 7
EXECUTION_DAYS = 7
KEY_HOURS = 24


def _seconds(seconds: Column | float) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def plan_retries(
    failed: DataFrame, at: str, base: Column | float = 1.0, limit: Column | float = 60.0,
) -> DataFrame:
    """Per failed item: retry or dead_letter, the next attempt, its delay and its time.

    An item is retried while ``attempt < max_attempts``.
    """
    again = F.col("attempt") < F.col("max_attempts")
    following = F.col("attempt") + 1
    delay = F.when(again, retry_delay(following, base, limit))
    return (
        failed.withColumn("next_step", F.when(again, "retry").otherwise("dead_letter"))
        .withColumn("next_attempt", F.when(again, following))
        .withColumn("delay_seconds", delay)
        .withColumn("scheduled_at", F.col(at) + _seconds(delay))
    )


def retry_items(planned: DataFrame) -> DataFrame:
    """The work items to run again."""
    chosen = planned.where(F.col("next_step") == "retry")
    return chosen.withColumn("attempt", F.col("next_attempt")).drop(
        "next_step", "next_attempt", "delay_seconds", "error", "error_type")


def due_retries(
    retries: DataFrame, executions: DataFrame, as_of: Column, row_id: str = "work_item_id",
) -> DataFrame:
    """Retries whose time has come and that have not run yet with their attempt number."""
    ran = executions.where(F.col("attempt") > 0).select(F.col("id").alias(row_id), "attempt")
    due = retries.where(F.col("scheduled_at") <= as_of)
    return due.join(ran, [row_id, "attempt"], "left_anti")


def dead_letters(planned: DataFrame, at: str, route: str = "route") -> DataFrame:
    """Items out of attempts, with what went wrong and where they came from."""
    chosen = planned.where(F.col("next_step") == "dead_letter")
    source = F.col(route) if route in planned.columns else F.lit(None).cast("string")
    return (
        chosen.withColumn("dlq_added_at", F.col(at))
        .withColumn("dlq_source_route", source)
        .withColumn("dlq_final_attempt", F.col("attempt"))
        .drop("next_step", "next_attempt", "delay_seconds", "scheduled_at")
    )


def replay_dead_letters(
    dead: DataFrame, chosen: DataFrame, as_of: Column, route: str, row_id: str,
) -> tuple[DataFrame, DataFrame]:
    """Move the chosen ids back to work with attempt 0. Returns (work rows, remaining dead)."""
    again = (
        dead.join(chosen, row_id, "left_semi")
        .withColumn("attempt", F.lit(0))
        .withColumn("dlq_retried_at", as_of)
        .withColumn("route", F.lit(route))
    )
    return again, delete_rows(dead, chosen, row_id)


def delete_rows(rows: DataFrame, chosen: DataFrame, row_id: str) -> DataFrame:
    """Rows whose id is not among the chosen ones."""
    return rows.join(chosen.select(row_id), row_id, "left_anti")


def stuck_items(
    dispatched: DataFrame, completed: DataFrame, as_of: Column, row_id: str, at: str,
    idle_seconds: int = 60,
) -> DataFrame:
    """Dispatched items without a completion that are idle long enough; claiming adds an attempt."""
    idle = F.unix_timestamp(as_of) - F.unix_timestamp(F.col(at))
    waiting = dispatched.where(idle >= idle_seconds).withColumn("idle_seconds", idle)
    open_ = waiting.join(completed.select(row_id), row_id, "left_anti")
    return open_.withColumn("attempt", F.col("attempt") + 1)


def keep_recent(rows: DataFrame, at: str, as_of: Column, seconds: float) -> DataFrame:
    """Rows not older than the retention period."""
    return rows.where(F.col(at) >= as_of - _seconds(seconds))


def failure_runs(
    executions: DataFrame, keys: list[str], ts: str, row_id: str, failed: Column,
    threshold: int = 5, bucket_seconds: float = 86400.0,
) -> DataFrame:
    """Runs of at least ``threshold`` failures in a row per key; a success ends a run.

    The rows of a run share the number of successes before them, so runs are an aggregate.
    """
    marked = executions.withColumn("_ok", (~failed).cast("long"))
    counted = running_total(marked, keys, ts, row_id, F.col("_ok"), "_run", bucket_seconds)
    runs = counted.where("_ok = 0").groupBy(*keys, "_run").agg(
        F.count("*").alias("failures"), F.min(ts).alias("first_failure"),
        F.max(ts).alias("last_failure"))
    return runs.where(F.col("failures") >= threshold).drop("_run")
