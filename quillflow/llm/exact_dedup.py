"""Exact duplicates with heavy hitters split off.

Digests are computed once and written with their doc_id. A Misra-Gries sketch (Spark's
``approx_top_k``, merged from all tasks) names the frequent digests; their exact counts and
winners are then verified against all rows. The verified winners, at most ``HEAVY`` rows, are
broadcast and settle their copies without a shuffle. The rows left hold no digest with a
large share, so the ordinary shuffle by digest is even.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillflow.llm.common import fresh, lower_ascii, stored, text_or_empty

# Digests that may be broadcast (a digest and three numbers each), and counters of the sketch.
HEAVY, COUNTERS = 1_000, 4_000


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, text_hash) for every row of ``docs`` (doc_id, text).

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest doc_id stays (a null doc_id loses to any other); among rows
    that repeat this doc_id one is kept. text_hash is the hash of the text as it is (its
    xxhash64), which tells apart rows that repeat a doc_id. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.sha2(lower_ascii(text_or_empty()), 256).alias("text_sha256")
    ).withColumn("row", F.monotonically_increasing_id()), "digests")
    rows = rows.withColumn("mark", F.xxhash64("text_sha256"))
    frequent = rows.agg(F.expr(f"approx_top_k(mark, {HEAVY}, {COUNTERS})").alias("top")).select(
        F.explode("top.item").alias("mark"))
    heavy = stored(
        rows.join(F.broadcast(frequent), "mark", "left_semi").groupBy("text_sha256").agg(
            F.max(F.struct("doc_id", "row")).alias("winner"), F.count("*").alias("group_size"))
        .where("group_size > 1"), "heavy")
    # At most HEAVY rows on the broadcast side of both joins.
    settled = rows.join(F.broadcast(heavy), "text_sha256").select(
        "doc_id", F.col("winner")["doc_id"].alias("keep_id"), "group_size",
        (F.col("row") == F.col("winner")["row"]).alias("kept"), "text_sha256", "text_hash")
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    same = Window.partitionBy("text_sha256")
    order = same.orderBy(F.desc_nulls_last("doc_id"), F.desc("row"))
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordinary = rest.select(
        "doc_id", F.first("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"), "text_sha256", "text_hash")
    return settled.unionByName(ordinary)


def keep_last(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one of rows that repeat doc_id and text."""
    winner, text_hash, nth = fresh(docs, "winner_id", "winner_hash", "nth")
    # Keys without nulls: the window below then needs no shuffle of its own.
    key = lambda doc_id: F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))
    kept = exact_groups(docs).where("kept").select(
        key(F.col("doc_id")).alias(winner), F.col("text_hash").alias(text_hash)).distinct()
    rows = docs.join(kept, (key(docs["doc_id"]) == kept[winner]) & (F.xxhash64(docs["text"]) == kept[text_hash]))
    once = Window.partitionBy(winner, text_hash).orderBy(F.lit(1))
    return rows.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).drop(
        winner, text_hash, nth)
