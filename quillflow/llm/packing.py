"""Concatenate and cut: all documents as one stream of ids, cut into windows of fixed length.

Two passes: partition totals give every document's global offset (see ``token_runs``), then each
document is cut where the stream crosses a multiple of the length. Windows inside a partition and
windows across its edge are treated alike: every part of a document is a boundary record
(sequence, offset in it, length), and a sequence is its records put together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.bpe import word_vocabulary
from quillflow.llm.token_runs import encoded_runs, part_offsets

LENGTH = 2048
END_ID = 1
_FIELDS = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
           "sequence_id long, offset long")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents of ``docs`` (doc_id, text) in sequences of ``length`` ids.

    One row per piece: doc_id, start (ids of the document before it), length, ids (binary:
    little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset, and
    padded_length: ``length``, but a last sequence whose size is a power of two stays as it is.
    Every document ends with ``end_id``, so an empty or null text has one piece of one id.
    Rows that repeat a doc_id are documents of their own, side by side; a null doc_id comes first.
    Other columns are ignored. An empty table gives no pieces.
    """
    runs = encoded_runs(docs, word_vocabulary, path, end_id, "packed")
    offsets = part_offsets(runs.select("part", "n"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                        ("offset", pa.int64())])

    def cut(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc_id, first, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                wide, start = np.frombuffer(ids, "<u2").astype("<u4"), 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    size = min(n - start, length - offset)
                    data = wide[start:start + size].tobytes()
                    for column, value in zip(rows, (doc_id, start, size, data, n, sequence, offset)):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    # One row per partition on the broadcast side.
    placed = runs.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("first"), "n", "ids")
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rest = total % length
    last = rest if rest & (rest - 1) == 0 and rest else length
    return placed.mapInArrow(cut, _FIELDS).withColumn(
        "padded_length", F.when(F.col("sequence_id") == total // length, last).otherwise(length).cast("long"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) with the records of each sequence put together in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", F.expr("aggregate(parts, CAST('' AS BINARY), (a, p) -> a || p.ids)").alias("ids"))
