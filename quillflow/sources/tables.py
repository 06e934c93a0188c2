"""Tables the flow writes: keys, work items, executions, dead letters, audit, targets.

Appends are idempotent per batch: a batch writes its own folder with overwrite, so a rerun of the
same batch replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Kinds of audit records.
AUDIT_ACTIONS = (
    "auth.success", "auth.failure", "auth.logout",
    "agent.created", "agent.updated", "agent.deleted", "agent.enabled", "agent.disabled",
    "execution.started", "execution.completed", "execution.failed", "execution.retried",
    "queue.purged", "dlq.item_retried", "dlq.item_deleted",
    "config.changed", "system.shutdown", "system.startup",
    "secret.accessed", "pii.detected", "permission.denied",
)


def write_batch(rows: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    """Append one batch; writing the same batch again replaces it."""
    folder = f"{path}/batch={batch_id}"
    gathered(rows, partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(folder)


def gathered(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of one output folder together, in as many tasks as their size needs.

    Without it every task writes a file into every folder; with a plain repartition one large
    folder would be one task.
    """
    return rows.hint("rebalance", *columns) if columns else rows


def write_work_items(items: DataFrame, path: str, batch_id: int) -> None:
    """Work items in one folder per route, so that a worker reads only its route."""
    write_batch(items, path, batch_id, ("route",))


def read_batches(spark: SparkSession, path: str, schema, folders: list[str] | None = None) -> DataFrame:
    """Everything the batches wrote, or some of their folders; an empty frame before the first one."""
    if folders is None:
        folders = [path] if path_exists(spark, path) else []
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", path).schema(schema).parquet(*folders)


def finished(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders ``name=<number>`` below a path that a write has finished, ascending."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    folders = [status.getPath().getParent().getName() for status in found or []]
    return sorted(int(folder.split("=")[1]) for folder in folders)


Stage = Callable[[DataFrame, str], DataFrame]


def stage_in(folder: str) -> Stage:
    """Store an intermediate result as files and go on from them.

    Later steps read the files instead of repeating the work before them (paid model calls
    among it) when a frame is used twice or an executor is lost. A stage that is already
    complete is not written again.
    """
    def stage(rows: DataFrame, name: str) -> DataFrame:
        spark, path = rows.sparkSession, f"{folder}/{name}"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    return stage


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


KEY_SCHEMA = "key string, agent_id string, work_item_id string, created_at timestamp"


def _hour(at: datetime) -> int:
    """Hours since 1970."""
    return int(at.timestamp() // 3600)


def append_keys(written: DataFrame, path: str, batch_id: int, created_at: datetime) -> None:
    """Store the keys of a batch below the hour of their making, so that old hours are never read."""
    rows = key_rows(written, F.lit(created_at).cast("timestamp"))
    write_batch(rows, f"{path}/hour={_hour(created_at)}", batch_id)


def live_keys(spark: SparkSession, path: str, as_of: datetime, ttl_seconds: int) -> DataFrame:
    """Keys made within the ttl: the folders of its hours and no others are listed and read."""
    first = _hour(as_of - timedelta(seconds=ttl_seconds))
    folders = [f"{path}/hour={hour}" for hour in range(first, _hour(as_of) + 1)]
    there = [folder for folder in folders if path_exists(spark, folder)]
    return read_batches(spark, path, KEY_SCHEMA + ", hour int, batch int", there)


def drop_keys(spark: SparkSession, path: str, as_of: datetime, ttl_seconds: int) -> int:
    """Delete the folders of all hours before the ttl whole; returns their number."""
    first = _hour(as_of - timedelta(seconds=ttl_seconds))
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/hour=*")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [status.getPath() for status in files.globStatus(where) or []
           if int(status.getPath().getName().split("=")[1]) < first]
    for folder in old:
        files.delete(folder, True)
    return len(old)


def key_rows(written: DataFrame, created_at: Column) -> DataFrame:
    """Idempotency records of written results: one per key, the first writer wins."""
    return (
        written.where(F.col("idempotency_key").isNotNull())
        .groupBy(F.col("idempotency_key").alias("key"))
        .agg(F.min(F.struct("work_item_id", "agent_id")).alias("_first"))
        .select("key", "_first.agent_id", "_first.work_item_id", created_at.alias("created_at"))
    )


EXECUTION_SCHEMA = (
    "id string, agent_id string, document_id string, status string, success boolean, "
    "written boolean, started_at timestamp, completed_at timestamp, duration_ms double, "
    "error string, error_type string, write_error string, attempt int, model string, provider string, "
    "total_tokens long, cost_usd double"
)


def execution_rows(results: DataFrame) -> DataFrame:
    """Execution history of finished work items, failed ones included."""
    success = F.col("error_type").isNull()
    refused = F.col("write_error") if "write_error" in results.columns else F.lit(None).cast("string")
    return results.select(
        F.col("work_item_id").alias("id"), "agent_id", "document_id",
        F.when(success, "completed").otherwise("failed").alias("status"),
        success.alias("success"),
        F.coalesce(F.col("written"), F.lit(False)).alias("written"),
        "started_at", "completed_at",
        F.col("latency_ms").alias("duration_ms"), "error", "error_type",
        refused.alias("write_error"), F.col("attempt").cast("int").alias("attempt"), "model", "provider",
        "total_tokens", "cost_usd")


def audit_rows(rows: DataFrame, action: str, at: Column, **columns: Column) -> DataFrame:
    """Audit records for rows: kind, actor, resource, details, success flag and error."""
    if action not in AUDIT_ACTIONS:
        raise ValueError(f"unknown audit action {action!r}")

    def pick(name: str, default: Column) -> Column:
        return columns.get(name, default).alias(name)

    text = F.lit(None).cast("string")
    return rows.select(
        at.alias("timestamp"), F.lit(action).alias("action"),
        pick("actor", text), pick("resource_type", text), pick("resource_id", text),
        pick("details", F.create_map().cast("map<string,string>")),
        pick("ip_address", text), pick("user_agent", text),
        pick("success", F.lit(True)), pick("error", text))
