"""Helpers shared by the corpus operators: tables, written steps, text chunks."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Byte table that lower-cases A-Z and nothing else.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())

# Text bytes that one numpy pass works on; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
# Bytes of a batch of rows on its way to a Python worker; Spark's own bounds are 64 MB and 10,000 rows.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def per_worker(slot: str, key: tuple, make: Callable):
    """``make()`` once per Python process and key; a slot holds the value of its last key only.

    Functions travel to workers by value, so their modules hold no state from one task to the
    next; a module of this name does. One slot for all large states bounds a worker's memory.
    """
    state = vars(sys.modules.setdefault("_quillflow_worker", types.ModuleType("_quillflow_worker")))
    held = state.setdefault("held", {})
    if slot not in held or held[slot][0] != key:
        held.pop(slot, None)
        held[slot] = (key, make())
    return held[slot][1]


def let_slot_go(slot: str) -> None:
    """Free what a worker holds in a slot, for steps of another kind that run in the same process later."""
    held = vars(sys.modules.get("_quillflow_worker", types.ModuleType("none"))).get("held", {})
    if held.pop(slot, None) is not None:
        gc.collect()
        trim_worker()


def trim_worker() -> None:
    """Give freed memory back to the system, at the end of a task with large passing arrays: workers live on."""
    pa.default_memory_pool().release_unused()
    # Many small freed objects stay with the process unless the C library is told.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Let rows with texts pass to Python in batches of ``BATCH_BYTES``, unless the session has a bound of its own.

    An executor holds a batch of each task several times: where it grows, as it is sent, and in the worker.
    Plans read the setting as they run, so it stays set. It changes no result.
    """
    if spark.conf.get(BATCH_SETTING) == f"{64 << 20}b":  # Spark's default
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a step to the shared folder and read it back, which cuts the lineage.

    A lost executor costs the tasks that read from it, not the steps before. The files live as
    long as the folder in ``spark.checkpoint.dir``.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_count(rows: DataFrame, most: int) -> int:
    """The least n from which on there are at most ``most`` rows (n)."""
    sizes = rows.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).toArrow()
    n, total = sizes.column("n").to_numpy(), np.cumsum(sizes.column("count").to_numpy())
    fits = int(np.searchsorted(total, most, side="right"))
    return int(n[fits - 1]) if fits else 1 << 62


def dropped(*steps: DataFrame) -> None:
    """Delete written steps (results of ``stored``) that nothing reads any more."""
    for df in steps:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are written; it does so as their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have (in any case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def chunked(rows: Iterable[tuple], size: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Group (text bytes, ...) tuples so that a group holds about ``size`` bytes of text."""
    held, total = [], 0
    for row in rows:
        if held and total + len(row[0]) > size:
            yield held
            held, total = [], 0
        held.append(row)
        total += len(row[0])
    if held:
        yield held


def arrow_rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """Rows of (text bytes, other columns...); null text counts as empty."""
    at = [batch.schema.get_field_index(c) for c in ("text", *columns)]
    for part in row_slices(batch):
        for text, *rest in zip(*(part.column(i).to_pylist() for i in at)):
            yield ((text or "").encode("utf-8", "surrogatepass"), *rest)


def row_slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small parts of a batch, so that few texts at a time are Python objects."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
