"""Token ids of all documents in ascending doc_id order, with global offsets.

Documents are dealt by ranges of (doc_id, text hash) and encoded once. Each task counts the ids
before every document of its own partition; the partition totals (one row per partition) are summed
up in partition order, which gives the ids before each partition. The encoded rows are written to
the shared folder between the two passes, so a lost executor repeats single tasks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillflow.llm.bpe import slices
from quillflow.llm.common import row_slices, stored

# (part, place, doc_id, before, n, ids): ids as little-endian unsigned 16-bit integers.
RUN_SCHEMA = "part int, place long, doc_id long, before long, n long, ids binary"


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text, range-partitioned and sorted by doc_id; a null doc_id comes first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("tie"))
    return rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")


def encoded_runs(docs: DataFrame, vocabulary: Callable, path: str, end_id: int, purpose: str) -> DataFrame:
    """One written row per document with its ids, ``end_id`` last; null counts as the empty text."""
    schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()),
                        ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    end = end_id.to_bytes(2, "little")

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, part = vocabulary(path, forced=False), TaskContext.get().partitionId()
        place = before = 0
        for batch in (part for whole in batches for part in row_slices(whole)):
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = [i + end for i in encoder.encode([t or "" for t in texts[a:b]])]
                counts = [len(i) // 2 for i in ids]
                befores = []
                for count in counts:
                    befores.append(before)
                    before += count
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * (b - a), pa.int32()),
                    pa.array(range(place, place + b - a), pa.int64()), pa.array(names[a:b], pa.int64()),
                    pa.array(befores, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    schema=schema)
                place += b - a

    return stored(in_order(docs).select("doc_id", "text").mapInArrow(run, RUN_SCHEMA), purpose)


def part_offsets(totals: DataFrame) -> DataFrame:
    """(part, offset) from (part, n): the ids before each partition; one row per partition."""
    sums = totals.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
