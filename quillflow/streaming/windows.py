"""Event-time operators on streams: usage windows, duplicate removal, admission with state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillflow.session import shared_folder


def usage_windows(usage: DataFrame, width: str, lateness: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cost, tokens and requests per tumbling window (and key); closed windows are emitted once."""
    return (
        usage.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("_w"), *keys)
        .agg(F.sum("cost_usd").alias("cost_usd"), F.sum("total_tokens").alias("tokens"),
             F.count("*").alias("requests"))
        .select(F.col("_w.start").alias("window_start"), *keys, "cost_usd", "tokens", "requests")
    )


def dedup_within(items: DataFrame, key: str, ts: str, window: str) -> DataFrame:
    """One row per key within at least ``window`` of event time; state is dropped after it."""
    return items.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])


MICROS = 1_000_000
# Held rows are packed: an entry of the state is the bytes of many rows of this type.
HELD = T.StructType([T.StructField("rows", T.BinaryType())])
ROW = np.dtype([("at", "<i8"), ("id", "<i8"), ("need", "<f8")])
# Rows of an entry, and rows that are Python objects at a time.
PACKED_ROWS = 50_000
# Stands for a null id within a processor.
NO_ID = -(1 << 63)


class _Ordered(StatefulProcessor):
    """Label the rows of one key in (time, id) order, whatever batch they come in.

    A row is held until the watermark has passed its time, so nothing earlier can follow; a timer
    at the earliest held time judges all rows that are due. What is held is one key's rows of the
    lateness, 24 bytes each. A second timer drops the state when it can't matter any more.
    """

    state_type: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", self.state_type)
        self._held = handle.getListState("held", HELD)
        self._timer = handle.getValueState("timer", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
                        ) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                held = np.empty(len(part), ROW)
                for name in ROW.names:
                    held[name] = part[name].to_numpy()
                self._held.appendList(_packed(held))
                earliest = int(held["at"].min())
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake(_ceil_ms(first))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any
                           ) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self._timer.clear()
        held = np.frombuffer(b"".join(entry[0] for entry in self._held.get()) if self._held.exists() else b"", ROW)
        due, rest = _in_order(held[held["at"] <= passed * 1000]), held[held["at"] > passed * 1000]
        del held
        state = self._state.get() if self._state.exists() else None
        for start in range(0, len(due), PACKED_ROWS):
            part = due[start:start + PACKED_ROWS]
            flags = []
            for at, need in zip(part["at"].tolist(), part["need"].tolist(), strict=True):
                state, ok = self.step(state, at, need)
                flags.append(ok)
            yield pd.DataFrame({"key": key[0], "id": part["id"], "admitted": flags})
        if len(due):
            self._held.put(_packed(rest)) if len(rest) else self._held.clear()
        # Rows still held lie after the watermark, so a state that has run out by then is as good as none.
        ends = None if state is None else _ceil_ms(self.expires(state))
        if ends is None or ends <= passed:
            self._state.clear()
        else:
            self._state.update(state)
            self._wake(ends)
        if len(rest):
            self._wake(_ceil_ms(int(rest["at"].min())))

    def _wake(self, ms: int) -> None:
        """One timer per key, at the earliest time asked for."""
        before = self._timer.get()[0] if self._timer.exists() else None
        if before is None or ms < before:
            if before is not None:
                self._handle.deleteTimer(before)
            self._handle.registerTimer(ms)
            self._timer.update((ms,))

    def step(self, state: Any, at: int, need: float) -> tuple[Any, bool]:
        raise NotImplementedError

    def expires(self, state: Any) -> float:
        """The time in microseconds from which on ``state`` judges as no state does."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _ceil_ms(micros: float) -> int:
    return -int(-micros // 1000)


def _packed(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[start:start + PACKED_ROWS].tobytes(),) for start in range(0, len(rows), PACKED_ROWS)]


def _in_order(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["need"], rows["id"], rows["at"]))]


class WindowDedup(_Ordered):
    """Exact duplicate window: refuse a row less than ``window`` after an accepted one."""

    state_type = T.StructType([T.StructField("last", T.LongType())])

    def __init__(self, window_seconds: float) -> None:
        self.window = int(window_seconds * MICROS)

    def step(self, state: Any, at: int, need: float) -> tuple[Any, bool]:
        if state is None or at - state[0] >= self.window:
            return (at,), True
        return state, False

    def expires(self, state: Any) -> float:
        return state[0] + self.window


class SlidingAdmission(_Ordered):
    """At most ``max_rate`` admitted rows in the trailing window."""

    state_type = T.StructType([T.StructField("recent", T.ArrayType(T.LongType()))])

    def __init__(self, max_rate: int, window_seconds: float) -> None:
        self.max_rate, self.window = max_rate, int(window_seconds * MICROS)

    def step(self, state: Any, at: int, need: float) -> tuple[Any, bool]:
        recent = [] if state is None else [t for t in state[0] if t > at - self.window]
        ok = len(recent) < self.max_rate
        return (recent + [at] if ok else recent,), ok

    def expires(self, state: Any) -> float:
        return max(state[0], default=0) + self.window


class BucketAdmission(_Ordered):
    """Token bucket that starts full."""

    state_type = T.StructType(
        [T.StructField("tokens", T.DoubleType()), T.StructField("at", T.LongType())])

    def __init__(self, rate: float, capacity: float) -> None:
        self.rate, self.capacity = rate, capacity

    def step(self, state: Any, at: int, need: float) -> tuple[Any, bool]:
        tokens = self.capacity
        if state is not None:
            tokens = min(self.capacity, state[0] + (at - state[1]) / MICROS * self.rate)
        ok = tokens >= need
        return (tokens - need if ok else tokens, at), ok

    def expires(self, state: Any) -> float:
        # A second more than it takes to refill, for the rounding of the rate.
        return state[1] + ((self.capacity - state[0]) / self.rate + 1) * MICROS


class BudgetGate(_Ordered):
    """Refuse a row once its key has spent ``limit`` or more in the tumbling window; needs aren't negative."""

    state_type = T.StructType([T.StructField("window", T.LongType()), T.StructField("spent", T.DoubleType())])

    def __init__(self, limit: float, window_seconds: float) -> None:
        self.limit, self.window = limit, int(window_seconds * MICROS)

    def step(self, state: Any, at: int, need: float) -> tuple[Any, bool]:
        window = at // self.window
        spent = 0.0 if state is None or state[0] != window else state[1]
        return (window, spent + need), spent < self.limit

    def expires(self, state: Any) -> float:
        return (state[0] + 1) * self.window


# transformWithState keeps its state in RocksDB.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def label_stream(rows: DataFrame, key: str, ts: str, row_id: str, processor: StatefulProcessor,
                 need: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """(key, id, admitted) for the rows of a stream, by a per-key state machine in event time.

    A row is judged when the watermark, ``lateness`` behind the latest time seen, has passed it; rows
    that arrive later than that are dropped, as by any watermark. Rows without time can't be
    ordered and are dropped, too. A null key is a key of its own, a null id comes first.
    """
    slim = rows.select(
        F.col(key).cast("string").alias("key"), F.coalesce(F.col(row_id).cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(ts).cast("timestamp").alias("time"),
        (F.lit(1.0) if need is None else F.col(need).cast("double")).alias("need"))
    timed = slim.where("time IS NOT NULL").withWatermark("time", lateness).withColumn("at", F.unix_micros("time"))
    labels = timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType="key string, id long, admitted boolean",
        outputMode="Append", timeMode="EventTime")
    return labels.withColumn("id", F.nullif("id", F.lit(NO_ID)))


def run_to_table(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to its end into files in the shared folder and read them back."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "stream")
    running = (
        rows.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")
