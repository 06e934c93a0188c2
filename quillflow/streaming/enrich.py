"""The flow on a stream: every micro-batch is enriched and applied, effectively once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillflow.operators.apply import fresh_only
from quillflow.operators.cache import load_cache, refresh_cache, save_cache
from quillflow.operators.complete import Client
from quillflow.operators.failure import dead_letters, due_retries, plan_retries, retry_items
from quillflow.plans.enrich import admit, dispatch, enrich, work_items
from quillflow.sources.catalog import Agent
from quillflow.sources.tables import (
    EXECUTION_SCHEMA, append_keys, execution_rows, live_keys, path_exists, read_batches, stage_in,
    write_batch)
from quillflow.streaming.targets import TargetStore


@dataclass(frozen=True)
class EnrichSink:
    """``foreachBatch`` target. ``root`` is a folder all executors share.

    A micro-batch may run again after a crash. Model answers, changes of targets, keys, executions,
    retries and dead letters are written per batch id, so the second run replaces what the first
    one did by the same. A key is kept only of a result that reached its target. Limits of agents
    count by event time: what earlier batches spent, and the rate within a batch. With ``cache_rows``
    answers are kept for the batches after it, as many as that.
    """

    agents: list[Agent]
    make_client: Callable[[], Client]
    root: str
    store: TargetStore
    key_ttl_seconds: int = 24 * 3600
    overlap: int = 1
    cache_rows: int = 0
    cache_ttl_seconds: int = 3600

    def __call__(self, changes: DataFrame, batch_id: int) -> None:
        spark = changes.sparkSession
        now = datetime.now(timezone.utc)
        as_of = F.lit(now).cast("timestamp")
        items = dispatch(work_items(changes, self.agents))
        seen = live_keys(spark, f"{self.root}/keys", now, self.key_ttl_seconds).where(
            F.col("batch") < batch_id)
        fresh = fresh_only(items, seen, as_of, ttl_seconds=self.key_ttl_seconds)

        stage = stage_in(f"{self.root}/stages/batch={batch_id}")
        if any(a.rate_limit_requests or a.cost_limit_usd or a.token_limit for a in self.agents):
            fresh = stage(fresh, "items")
            fresh = admit(fresh, self.agents, self._spent(fresh, batch_id))
        folder = f"{self.root}/cache"
        cache = load_cache(spark, folder, batch_id) if self.cache_rows else None
        results = enrich(fresh, self.agents, self.make_client, finished_at=as_of, stage=stage,
                         again=self._due(spark, batch_id, as_of), overlap=self.overlap,
                         cache=cache, cache_ttl_seconds=self.cache_ttl_seconds)
        results = stage(results.drop("parsed"), "results")
        if cache is not None:
            save_cache(refresh_cache(cache, results, as_of, ttl_seconds=self.cache_ttl_seconds,
                                     max_rows=self.cache_rows), folder, batch_id)
        # What is read of a report needs no texts.
        slim = results.drop("prompt", "system_prompt", "content", "schema_errors")
        report = stage(self.store.report(slim, self.agents), "report")

        self.store.append(report, batch_id)
        append_keys(report.where("written"), f"{self.root}/keys", batch_id, now)
        write_batch(execution_rows(report), f"{self.root}/executions", batch_id)
        planned = plan_retries(results.where(F.col("error_type").isNotNull()), "completed_at",
                               F.col("retry_delay_seconds"), F.col("retry_max_delay_seconds"))
        planned = planned.drop("answer")
        write_batch(retry_items(planned), f"{self.root}/retries", batch_id)
        write_batch(dead_letters(planned, "completed_at"), f"{self.root}/dead_letters", batch_id)

    def _spent(self, items: DataFrame, batch_id: int) -> DataFrame:
        """What earlier batches spent, from the hour of the first item on."""
        first = items.agg(F.date_trunc("hour", F.min("ts")).alias("at")).first()["at"]
        ran = read_batches(items.sparkSession, f"{self.root}/executions", EXECUTION_SCHEMA + ", batch int")
        return ran.where((F.col("batch") < batch_id) & (F.col("started_at") >= F.lit(first))).select(
            "agent_id", F.col("started_at").alias("ts"), "cost_usd", "total_tokens")

    def _due(self, spark: SparkSession, batch_id: int, as_of: Column) -> DataFrame | None:
        """Retries that earlier batches planned and that are due now."""
        folder = f"{self.root}/retries"
        if not path_exists(spark, folder):
            return None
        earlier = F.col("batch") < batch_id
        retries = spark.read.option("basePath", folder).parquet(folder).where(earlier)
        ran = read_batches(spark, f"{self.root}/executions", EXECUTION_SCHEMA + ", batch int")
        return due_retries(retries, ran.where(earlier), as_of)


def start_enrich(changes: DataFrame, sink: EnrichSink, checkpoint: str,
                 available_now: bool = False) -> StreamingQuery:
    """Start the flow on a stream of change events."""
    writer = changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
