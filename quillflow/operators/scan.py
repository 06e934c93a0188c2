"""Ordered work per key that stays parallel when one key holds most rows.

* ``bucket_totals`` / ``running_total`` / ``admit_until``: prefix sums in two levels. Rows are
  summed per (key, time bucket) first, so only the totals are ordered per key.
* ``ordered_scan``: a sequential step per key over sorted rows with small state. Callers cut a
  key into independent stretches first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_bucket(ts: Column, seconds: float) -> Column:
    """Epoch-aligned bucket number of a timestamp."""
    width = int(seconds * MICROS)
    at = micros(ts)
    return ((at - F.pmod(at, F.lit(width))) / width).cast("long")


def bucket_totals(
    df: DataFrame, keys: list[str], ts: str, value: Column, seconds: float,
    descending: bool = False, extra: tuple[Column, ...] = (),
) -> DataFrame:
    """Per (keys, ``_bucket``): ``_total`` and ``_before``, the total of all earlier buckets."""
    totals = df.groupBy(*keys, time_bucket(F.col(ts), seconds).alias("_bucket")).agg(
        F.sum(value).alias("_total"), *extra)
    order = F.col("_bucket").desc() if descending else F.col("_bucket")
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(totals.schema["_total"].dataType)
    return totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), zero))


def _join_totals(rows: DataFrame, totals: DataFrame, on: list[str]) -> DataFrame:
    """Join bucket totals to their rows; a NULL key is a key of its own, so no row is lost."""
    renamed = totals.withColumnsRenamed({c: f"{c}__" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"{c}__"))
    return rows.join(renamed, condition).drop(*[f"{c}__" for c in on])


def running_total(
    df: DataFrame, keys: list[str], ts: str, row_id: str, value: Column, name: str,
    seconds: float = 3600,
) -> DataFrame:
    """Sum of ``value`` over the rows of the key before this one, in (ts, id) order.

    The widest ordered group is one (key, bucket), not one key.
    """
    totals = bucket_totals(df, keys, ts, value, seconds).drop("_total")
    rows = df.withColumn("_bucket", time_bucket(F.col(ts), seconds))
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(ts, row_id)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = _join_totals(rows, totals, [*keys, "_bucket"])
    zero = F.lit(0).cast(totals.schema["_before"].dataType)
    total = F.col("_before") + F.coalesce(F.sum(value).over(inside), zero)
    return joined.withColumn(name, total).drop("_bucket", "_before")


def admit_until(
    df: DataFrame, keys: list[str], ts: str, row_id: str, value: Column, limit: Column,
    seconds: float = 3600, descending: bool = False, name: str = "admitted",
) -> DataFrame:
    """Flag rows whose preceding rows of the key sum to less than ``limit`` (NULL: no limit).

    ``value`` must not be negative and ``limit`` depends on the key only. All buckets but the
    one where the sum crosses the limit are decided whole; only that bucket's rows are sorted.
    """
    totals = bucket_totals(
        df, keys, ts, value, seconds, descending, (F.max(limit).alias("_limit"),))
    side = (
        F.when(F.col("_limit").isNull() | (F.col("_before") + F.col("_total") < F.col("_limit")), 1)
        .when(F.col("_before") >= F.col("_limit"), 0)
        .otherwise(-1)
    )
    totals = totals.withColumn("_side", side).drop("_total")
    rows = df.withColumn("_bucket", time_bucket(F.col(ts), seconds))
    on = [*keys, "_bucket"]
    whole = (
        _join_totals(rows, totals.where("_side >= 0").select(*on, "_side"), on)
        .select(*df.columns, (F.col("_side") == 1).alias(name))
    )
    order = [F.col(ts).desc(), F.col(row_id).desc()] if descending else [F.col(ts), F.col(row_id)]
    inside = (
        Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    split = _join_totals(rows, totals.where("_side < 0").select(*on, "_before", "_limit"), on)
    zero = F.lit(0).cast(totals.schema["_before"].dataType)
    spent = F.col("_before") + F.coalesce(F.sum(value).over(inside), zero)
    crossing = split.withColumn(name, spent < F.col("_limit")).select(*df.columns, name)
    return whole.unionByName(crossing)


Step = Callable[..., tuple[Any, list]]


def ordered_scan(
    df: DataFrame, keys: list[str], order: list[str], make_step: Callable[[], Step],
    columns: list[str], output: T.StructField,
) -> DataFrame:
    """Run ``step(state, *lists) -> (state, values)`` over each key's rows in order.

    A call gets the next rows of one key as one list per column of ``columns``, and the state its
    previous call left (None at the start of a key). The values become a new column. Memory is
    one Arrow batch and one key's state, whatever the size of the key.
    """
    schema = T.StructType([*df.schema.fields, output])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = make_step()
        current, state = None, None
        for batch in batches:
            if batch.empty:
                continue
            names = [batch[k].to_numpy() for k in keys]
            new = names[0][1:] != names[0][:-1]
            for name in names[1:]:
                new = new | (name[1:] != name[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
            lists = [batch[c].tolist() for c in columns]
            values = []
            for begin, end in zip(edges, edges[1:], strict=False):
                key = tuple(name[begin] for name in names)
                if key != current:
                    current, state = key, None
                state, more = step(state, *[rows[begin:end] for rows in lists])
                values += more
            batch[output.name] = pd.Series(values, index=batch.index, dtype=object)
            yield batch

    grouped = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return grouped.mapInPandas(run, schema)
