"""Duplicate removal by key: over all time, and within a time window."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from quillflow.operators.scan import MICROS, micros, ordered_scan


def dedup_first(df: DataFrame, key: str, ts: str, row_id: str) -> DataFrame:
    """The first row of every key in (ts, id) order; rows without a key are all kept.

    The filter on the row number limits each key to one row per task before the shuffle, so a
    key with many copies sends one row per task.
    """
    alone = F.when(F.col(key).isNull(), F.col(row_id))
    order = Window.partitionBy(key, "_alone").orderBy(ts, row_id)
    numbered = df.withColumn("_alone", alone).withColumn("_place", F.row_number().over(order))
    return numbered.where("_place = 1").drop("_place", "_alone")


def mark_first(df: DataFrame, key: str, ts: str, row_id: str, name: str) -> DataFrame:
    """All rows, with a flag on the first row of each key (rows without a key are first)."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(F.struct(F.col(ts), F.col(row_id))).alias("_first"))
    chosen = first.select(F.col(f"_first.{row_id}").alias("_id"))
    joined = df.join(chosen, df[row_id] == F.col("_id"), "left")
    return joined.withColumn(name, F.col("_id").isNotNull() | F.col(key).isNull()).drop("_id")


# Time of the row that carries a slab's entering time; before every real one.
_ENTRY = -(1 << 62)


def _slab_exits(width: int, window: int):
    """Per (key, slab): where a chain of accepted times that enters the slab leaves it.

    A chain accepts a time ``a`` and next the first time at or after ``a + window``. Its entry
    into a slab is the first time at or after some point within the first window of the slab, so
    a table from those entry times to the last accepted time describes the whole slab.
    """

    def exits(slab: int, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = len(times)
        if count == 1:
            return times, times
        after = np.searchsorted(times, times + window)
        last = np.where(after < count, after, np.arange(count))
        while True:
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        entries = min(int(np.searchsorted(times, slab * width + window)) + 1, count)
        ends = last[:entries]
        keep = np.append(ends[1:] != ends[:-1], True)
        return times[:entries][keep], times[ends[keep]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The last group of a batch may go on in the next one.
        group, parts = None, []
        out: dict[str, list] = {"_key": [], "_slab": [], "_start": [], "_exit": []}

        def flush() -> None:
            times = parts[0] if len(parts) == 1 else np.concatenate(parts)
            starts, ends = exits(group[1], times)
            out["_key"] += [group[0]] * len(starts)
            out["_slab"] += [group[1]] * len(starts)
            out["_start"] += starts.tolist()
            out["_exit"] += ends.tolist()

        for batch in batches:
            if batch.empty:
                continue
            keys, slabs = batch["_key"].to_numpy(), batch["_slab"].to_numpy()
            times = batch["_at"].to_numpy()
            new = (keys[1:] != keys[:-1]) | (slabs[1:] != slabs[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(times)]
            for begin, end in zip(edges, edges[1:], strict=False):
                here = (keys[begin], int(slabs[begin]))
                if here != group:
                    if group is not None:
                        flush()
                    group, parts = here, []
                parts.append(times[begin:end])
            if out["_key"]:
                yield pd.DataFrame(out).astype({"_key": object})
                out = {name: [] for name in out}
        if group is not None:
            flush()
            yield pd.DataFrame(out).astype({"_key": object})

    return run


def dedup_window(
    df: DataFrame, key: str, ts: str, row_id: str, window_seconds: float,
    slab_seconds: float | None = None,
) -> DataFrame:
    """Drop a row iff an accepted row of its key is less than ``window_seconds`` older.

    Exact, and parallel inside one key: its time line is cut into slabs. A first pass tabulates
    each slab on its own, a short scan over those tables finds the accepted time that enters
    each slab, and a second pass accepts rows per slab. Equal (key, time) rows collapse before
    any shuffle. A slab's distinct times are held by one task, so lower ``slab_seconds`` for
    very dense keys (never below the window). Rows without a key or a time are kept.
    """
    window = int(window_seconds * MICROS)
    width = max(int((slab_seconds or 64 * window_seconds) * MICROS), window, 1)
    at = micros(F.col(ts))
    usable = F.col(key).isNotNull() & F.col(ts).isNotNull()
    slim = (
        df.where(usable)
        .groupBy(F.col(key).cast("string").alias("_key"), at.alias("_at"))
        .agg(F.min(row_id).alias("_id"))
        .withColumn("_slab", ((F.col("_at") - F.pmod("_at", F.lit(width))) / width).cast("long"))
    )
    table_schema = "_key string, _slab long, _start long, _exit long"
    tables = (
        # All columns of ``slim``, so that its shuffle is the same one as below and runs once.
        slim.repartition("_key", "_slab").sortWithinPartitions("_key", "_slab", "_at")
        .mapInPandas(_slab_exits(width, window), table_schema)
    )

    def enter():
        # state: last accepted before this slab, this slab, last accepted within it
        def step(state, slabs, starts, ends):
            entry, slab, found = state or (None, None, None)
            out = []
            for here, start, end in zip(slabs, starts, ends, strict=True):
                if here != slab:
                    entry, slab, found = (entry if found is None else found), here, None
                if found is None and (entry is None or start >= entry + window):
                    found = end
                out.append(entry)
            return (entry, slab, found), out
        return step

    entries = (
        ordered_scan(tables, ["_key"], ["_slab", "_start"], enter, ["_slab", "_start", "_exit"],
                     T.StructField("_entry", T.LongType()))
        .where("_entry IS NOT NULL").groupBy("_key", "_slab").agg(F.max("_entry").alias("_entry"))
    )

    def accept():
        # state: last accepted time; a slab starts with the one that enters it, if any
        def step(last, times, entered):
            out, at = [False] * len(times), 0
            if times[0] == _ENTRY:
                last, at = int(entered[0]), 1
            if last is not None:
                at = bisect_left(times, last + window, at)
            while at < len(times):
                out[at], last = True, times[at]
                at = bisect_left(times, last + window, at)
            return last, out
        return step

    # The entering time travels as the first row of its slab: no join, one shuffle.
    first_rows = entries.select("_key", F.lit(_ENTRY).alias("_at"), F.lit(None).cast(
        slim.schema["_id"].dataType).alias("_id"), "_slab", "_entry")
    rows = slim.withColumn("_entry", F.lit(None).cast("long")).unionByName(first_rows)
    accepted = ordered_scan(rows, ["_key", "_slab"], ["_at"], accept, ["_at", "_entry"],
                            T.StructField("_ok", T.BooleanType()))
    chosen = accepted.where("_ok").select(F.col("_id").alias("_chosen"))
    kept = df.join(chosen, df[row_id] == F.col("_chosen"), "left_semi")
    return kept.unionByName(df.where(~usable))
