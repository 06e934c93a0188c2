"""Target collections of a stream: a base table and the changes that were appended after it.

A micro-batch appends the results it wrote as change rows and touches nothing else. Reading a
target folds the changes over the base (merge on read); ``compact`` stores what is read as a new
base. Below a shared ``root``:

    base/target=<database.collection>/upto=<batch>/bucket=<b>/   documents, changes up to a batch in them
    changes/batch=<batch>/target=<database.collection>/         results of one batch

Spark's ``_SUCCESS`` marks tell finished folders; a batch that runs again replaces its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillflow.operators.apply import is_list
from quillflow.plans.enrich import apply_agents
from quillflow.sources.catalog import Agent
from quillflow.sources.tables import finished, gathered, read_batches, write_batch

CHANGES = {
    "agent_id": "string", "document_id": "string", "work_item_id": "string", "answer": "variant",
    "started_at": "timestamp", "completed_at": "timestamp", "model": "string", "provider": "string",
    "total_tokens": "bigint", "cost_usd": "double", "latency_ms": "double", "error_type": "string"}
CHANGE_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in CHANGES.items())


@dataclass(frozen=True)
class Target:
    """A collection that results are written to, with one row per ``id_col``."""

    database: str
    collection: str
    id_col: str

    @property
    def name(self) -> str:
        return f"{self.database}.{self.collection}"


@dataclass(frozen=True)
class TargetStore:
    """The targets below one folder that all executors share.

    Change rows hold whole answers, which the agents' write settings place when they are read. Before
    these settings change, ``compact`` fixes what the old ones say.
    """

    root: str
    targets: tuple[Target, ...]
    buckets: int = 64

    def create(self, target: Target, rows: DataFrame) -> None:
        """Store the first base of a target."""
        self._write_base(target, rows, -1)

    def _folder(self, target: Target) -> str:
        return f"{self.root}/base/target={target.name}"

    def _write_base(self, target: Target, rows: DataFrame, upto: int) -> None:
        dealt = rows.withColumn("bucket", bucket_of(F.col(target.id_col), self.buckets))
        gathered(dealt, ("bucket",)).write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self._folder(target)}/upto={upto}")

    def base(self, spark: SparkSession, target: Target) -> tuple[DataFrame, int]:
        """The newest finished base and the last batch whose changes it holds."""
        found = finished(spark, self._folder(target), "upto")
        if not found:
            raise ValueError(f"no table was created for {target.name}")
        return spark.read.parquet(f"{self._folder(target)}/upto={found[-1]}"), found[-1]

    def read(self, spark: SparkSession, target: Target, agents: list[Agent]) -> DataFrame:
        """The target with all changes of finished batches: the last write of each path, by batch."""
        return self._merged(spark, target, agents, finished(spark, f"{self.root}/changes", "batch"))

    def _merged(self, spark: SparkSession, target: Target, agents: list[Agent],
                batches: list[int]) -> DataFrame:
        base, upto = self.base(spark, target)
        later = [b for b in batches if b > upto]
        changes = read_batches(spark, f"{self.root}/changes", CHANGE_SCHEMA + ", batch int, target string",
                               [f"{self.root}/changes/batch={b}" for b in later])
        own = changes.where(F.col("target") == target.name)
        return apply_agents(base.drop("bucket"), own, agents, target.id_col, target.database,
                            target.collection, order_by=("batch", "completed_at", "started_at", "work_item_id"))

    def compact(self, spark: SparkSession, target: Target, agents: list[Agent]) -> int:
        """Store the target as read now as its new base; returns the last batch in it.

        An ordinary job beside the stream: readers go on with the old base until the new one is
        finished, and read the batches after it from the changes.
        """
        batches = finished(spark, f"{self.root}/changes", "batch")
        upto = batches[-1] if batches else -1
        if upto > self.base(spark, target)[1]:
            self._write_base(target, self._merged(spark, target, agents, batches), upto)
        return upto

    def append(self, report: DataFrame, batch_id: int) -> None:
        """Add the written rows of a report as the changes of one batch."""
        rows = report.where("written").select(
            *(F.col(name).cast(kind).alias(name) for name, kind in CHANGES.items()), "target")
        write_batch(rows, f"{self.root}/changes", batch_id, ("target",))

    def report(self, results: DataFrame, agents: list[Agent]) -> DataFrame:
        """Results with ``target``, ``written`` and, for good answers that reach no table, ``write_error``.

        Only the buckets that hold the ids of good results are read, and of them only the ids.
        """
        spark = results.sparkSession
        named = results.withColumn("target", F.concat_ws(".", "target_database", "target_collection"))
        good = F.col("error_type").isNull()
        touched = self._touched(named.where(good))
        known = spark.createDataFrame([], "target string, document_id string")
        for target in self.targets:
            ids = self.base(spark, target)[0].where(F.col("bucket").isin(touched.get(target.name, [])))
            known = known.unionByName(ids.select(
                F.lit(target.name).alias("target"), F.col(target.id_col).cast("string").alias("document_id")))
        known = known.distinct().withColumn("_known", F.lit(True))
        appending = [a.id for a in agents if a.strategy == "append"]
        reason = (
            F.when(~F.col("target").isin([t.name for t in self.targets]), "target_not_found")
            .when(is_list(F.col("answer")) & ~F.col("agent_id").isin(appending), "list_requires_append")
            .when(F.col("_known").isNull(), "document_not_found"))
        return (
            named.join(known, ["target", "document_id"], "left")
            .withColumn("write_error", F.when(good, reason))
            .withColumn("written", good & F.col("write_error").isNull())
            .drop("_known"))

    def _touched(self, good: DataFrame) -> dict[str, list[int]]:
        # At most one row per target and bucket.
        rows = good.where(F.col("target").isin([t.name for t in self.targets])).select(
            "target", bucket_of(F.col("document_id"), self.buckets).alias("bucket")).distinct().collect()
        found: dict[str, list[int]] = {}
        for row in rows:
            found.setdefault(row["target"], []).append(row["bucket"])
        return found


def bucket_of(row_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(row_id.cast("string")), F.lit(buckets)).cast("int")
