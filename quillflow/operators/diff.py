"""Differences between two snapshots of a table, and between two feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def snapshot_diff(
    old: DataFrame, new: DataFrame, row_id: str, updated_at: str | None = None,
) -> DataFrame:
    """Ids that were created, updated or deleted between two snapshots.

    A row is updated when its ``updated_at`` is newer; without those times, when its content
    hash differs. Only the id, the time and the hash are shuffled.
    """
    content = [c for c in new.columns if c not in (row_id, updated_at)]

    def slim(frame: DataFrame, suffix: str) -> DataFrame:
        time = F.col(updated_at) if updated_at else F.lit(None).cast("timestamp")
        text = F.to_json(F.struct(*sorted(content)), {"ignoreNullFields": "false"})
        return frame.select(F.col(row_id), F.lit(True).alias(f"_in{suffix}"),
                            time.alias(f"_at{suffix}"), F.sha2(text, 256).alias(f"_hash{suffix}"))

    joined = slim(old, "0").join(slim(new, "1"), row_id, "full_outer")
    timed = F.col("_at0").isNotNull() & F.col("_at1").isNotNull()
    changed = F.when(timed, F.col("_at1") > F.col("_at0")).otherwise(
        ~F.col("_hash0").eqNullSafe(F.col("_hash1")) | ~F.col("_at0").eqNullSafe(F.col("_at1")))
    kind = (F.when(F.col("_in0").isNull(), "created").when(F.col("_in1").isNull(), "deleted")
            .when(changed, "updated"))
    return joined.select(row_id, kind.alias("change")).where(F.col("change").isNotNull())


def distinct_namespaces(rows: DataFrame) -> DataFrame:
    return rows.select("database", "collection").distinct().orderBy("database", "collection")


def namespace_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Namespaces that the new feed adds or that only the old one has."""
    names = ["database", "collection"]
    before, after = old.select(*names).distinct(), new.select(*names).distinct()
    added = after.subtract(before).withColumn("change", F.lit("added"))
    removed = before.subtract(after).withColumn("change", F.lit("removed"))
    return added.unionByName(removed)
