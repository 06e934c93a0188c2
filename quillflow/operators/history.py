"""Questions over executions, usage, events and audit records. ``as_of`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillflow.functions.pii import count_matches, patterns
from quillflow.operators.scan import MICROS, admit_until, micros

# Upper bounds of duration buckets, in seconds.
EXECUTION_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
AI_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)
HTTP_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)

MAX_PAGE = 1000


def select_history(
    rows: DataFrame, equals: dict[str, object] | None = None, ts: str | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Equality and inclusive time bounds; plain comparisons, so they reach the file scan."""
    for name, value in (equals or {}).items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if start is not None:
        rows = rows.where(F.col(ts) >= F.lit(start).cast(rows.schema[ts].dataType))
    if end is not None:
        rows = rows.where(F.col(ts) <= F.lit(end).cast(rows.schema[ts].dataType))
    return rows


def page(rows: DataFrame, order: list[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of an ordered listing; the limit is clamped to 1..1000."""
    return rows.orderBy(*order).offset(max(skip, 0)).limit(min(max(limit, 1), MAX_PAGE))


# Rows before a page that are sorted together with it, and pieces of time that are counted at once.
DEEP, PIECES = 10_000, 1024


def newest_first(rows: DataFrame, ts: str, row_id: str, skip: int = 0, limit: int = 100,
                 deep: int = DEEP) -> DataFrame:
    """One page, the newest rows first; rows without a time come last.

    A page behind more than ``deep`` rows is looked up first: counts of pieces of time tell the piece
    that holds its first row, which is cut again until it has few rows or a single time. Then only
    rows of the pieces of the page are ordered. Each look reads the times in the piece alone.
    """
    order = [F.col(ts).desc(), F.col(row_id)]
    if skip <= deep:
        return page(rows, order, skip, limit)
    wanted = min(max(limit, 1), MAX_PAGE)
    timed = rows.select(F.col(ts), micros(F.col(ts)).alias("_at")).where("_at IS NOT NULL")
    span = timed.agg(F.min("_at").alias("low"), F.max("_at").alias("high"), F.count("*").alias("rows")).first()
    if skip >= span["rows"]:
        return page(rows.where(F.col(ts).isNull()), [F.col(row_id)], skip - span["rows"], limit)
    low, high, before, held = span["low"], span["high"], 0, span["rows"]
    floor = low
    while held > deep and high > low:
        width = (high - low) // PIECES + 1
        inside = timed.where(_between(rows, ts, low, high))
        counts = inside.groupBy(F.expr(f"({high}L - _at) div {width}L").alias("piece")).count().collect()
        seen, found = before, None
        for piece, count in sorted(map(tuple, counts)):
            if found is None and seen + count > skip:
                found, before, held = piece, seen, count
            seen += count
            if seen >= skip + wanted:
                floor = max(floor, high - (piece + 1) * width + 1)
                break
        low, high = max(low, high - (found + 1) * width + 1), high - found * width
    chosen = _between(rows, ts, floor, high)
    if skip + wanted > span["rows"]:
        chosen = chosen | F.col(ts).isNull()
    return page(rows.where(chosen), order, skip - before, limit)


def _between(rows: DataFrame, ts: str, low: int, high: int) -> Column:
    """Times from ``low`` to ``high`` in microseconds, as a comparison that reaches the file scan."""
    kind = rows.schema[ts].dataType
    return F.col(ts).between(*(F.timestamp_micros(F.lit(at)).cast(kind) for at in (low, high)))


def list_tagged(
    records: DataFrame, ts: str, row_id: str, enabled_only: bool = False,
    tags: list[str] | None = None, equals: dict[str, object] | None = None,
    skip: int = 0, limit: int = 100, summary: list[str] | None = None,
) -> DataFrame:
    """Records with any of the tags, newest first, as a page of summary columns."""
    if enabled_only:
        records = records.where(F.col("enabled"))
    if tags:
        records = records.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    listed = newest_first(select_history(records, equals), ts, row_id, skip, limit)
    return listed.select(*summary) if summary else listed


def execution_stats(
    executions: DataFrame, as_of: str, hours: int = 24, agent_id: str | None = None,
) -> DataFrame:
    """Per status: count, average duration and the total, since ``as_of`` less ``hours``.

    The cutoff is truncated to the hour. The total is a sum over the few status rows.
    """
    kind = executions.schema["started_at"].dataType
    cutoff = (F.date_trunc("hour", F.lit(as_of).cast("timestamp"))
              - F.make_dt_interval(hours=F.lit(hours))).cast(kind)
    recent = select_history(executions, {"agent_id": agent_id}).where(F.col("started_at") >= cutoff)
    by_status = recent.groupBy("status").agg(
        F.count("*").alias("count"), F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"))
    # One row per status is left here, so the window over all of them is tiny.
    return by_status.withColumn("total", F.sum("count").over(Window.partitionBy()))


def _window_start(ts: str, seconds: int) -> Column:
    at = micros(F.col(ts))
    return F.timestamp_micros(at - F.pmod(at, F.lit(seconds * MICROS)))


def usage_global(
    usage: DataFrame, cost_limit: float | None = None, window_seconds: int = 86400,
) -> DataFrame:
    """Cost, tokens and requests per window, and the share of the limit that is used."""
    totals = usage.groupBy(_window_start("ts", window_seconds).alias("window_start")).agg(
        F.sum("cost_usd").alias("total_cost_usd"), F.sum("total_tokens").alias("total_tokens"),
        F.count("*").alias("request_count"))
    share = (F.round(F.col("total_cost_usd").cast("double") / F.lit(cost_limit), 6)
             if cost_limit else F.lit(None).cast("double"))
    return totals.withColumn("cost_utilization", share)


def usage_by(usage: DataFrame, *keys: str) -> DataFrame:
    """Cost, tokens and requests per agent, model or other label."""
    return usage.groupBy(*keys).agg(
        F.sum("cost_usd").alias("cost_usd"), F.sum("total_tokens").alias("tokens"),
        F.count("*").alias("requests"))


def average_tokens(usage: DataFrame) -> DataFrame:
    """Tokens per request; 0 when there is none."""
    requests, tokens = F.count("*"), F.sum("total_tokens")
    return usage.agg(
        requests.alias("request_count"),
        F.round(F.when(requests > 0, tokens / requests).otherwise(0.0), 6)
        .alias("avg_tokens_per_request"))


def top_agents(usage: DataFrame, n: int = 10, by: str = "cost") -> DataFrame:
    """The ``n`` agents with the highest cost or token use."""
    measure = "cost_usd" if by == "cost" else "tokens"
    return usage_by(usage, "agent_id").orderBy(F.col(measure).desc(), "agent_id").limit(n)


def agent_stats(usage: DataFrame) -> DataFrame:
    """Per agent: runs, successes, failures, tokens, cost, latency, last run and last error.

    The numbers need one hash aggregate. The last error is text, which would turn that aggregate
    into a sort of all rows, so it is taken from the failed rows alone.
    """
    failed = ~F.col("ok")
    numbers = usage.groupBy("agent_id").agg(
        F.count("*").alias("total"),
        F.count(F.when(F.col("ok"), 1)).alias("successful"),
        F.count(F.when(failed, 1)).alias("failed"),
        F.sum("total_tokens").alias("tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
        F.max("ts").alias("last_execution"))
    errors = usage.where(failed & F.col("error").isNotNull()).groupBy("agent_id").agg(
        F.max_by("error", F.struct("ts", "id")).alias("last_error"))
    return numbers.join(errors, "agent_id", "left")


def cache_stats(lookups: DataFrame) -> DataFrame:
    """Hits, misses and hit rate of cache lookups; the rate is 0 when there are none."""
    hits = F.count(F.when(F.col("cache_hit"), 1))
    total = F.count("*")
    return lookups.agg(
        hits.alias("hits"), (total - hits).alias("misses"),
        F.round(F.when(total > 0, hits / total).otherwise(0.0), 3).alias("hit_rate"))


def dispatch_stats(items: DataFrame, first: Column) -> DataFrame:
    return items.agg(F.count(F.when(first, 1)).alias("dispatched"),
                     F.count(F.when(~first, 1)).alias("deduplicated"))


def counter(rows: DataFrame, labels: list[str], value: Column | None = None,
            name: str = "total") -> DataFrame:
    """A counter by labels: rows, or the sum of a value."""
    return rows.groupBy(*labels).agg(
        (F.count("*") if value is None else F.sum(value)).alias(name))


def token_counter(usage: DataFrame, labels: list[str], kinds: dict[str, str]) -> DataFrame:
    """Tokens by labels and type; ``kinds`` maps a type name to its column."""
    summed = usage.groupBy(*labels).agg(*[F.sum(c).alias(k) for k, c in kinds.items()])
    return summed.unpivot(labels, list(kinds), "type", "tokens")


def duration_histogram(rows: DataFrame, labels: list[str], seconds: Column,
                       buckets: tuple[float, ...] = EXECUTION_BUCKETS) -> DataFrame:
    """Cumulative bucket counts, sum and count per label, in one aggregation pass."""
    counts = [F.count(F.when(seconds <= b, 1)).alias(str(b)) for b in buckets]
    wide = rows.groupBy(*labels).agg(
        *counts, F.count(seconds).alias("+Inf"),
        F.round(F.sum(seconds.cast("decimal(28,6)")), 6).alias("duration_sum"),
        F.count(seconds).alias("duration_count"))
    names = [f"{b}" for b in buckets] + ["+Inf"]
    return wide.unpivot([*labels, "duration_sum", "duration_count"],
                        [F.col(f"`{n}`") for n in names], "le", "bucket_count")


def queue_depth(items: DataFrame, as_of: Column, labels: list[str], ts: str) -> DataFrame:
    """Waiting items per route (and consumer): count and seconds since the last one."""
    return items.groupBy(*labels).agg(
        F.count("*").alias("pending"),
        (F.unix_timestamp(as_of) - F.unix_timestamp(F.max(ts))).alias("idle_seconds"))


def failures_by_type(dead: DataFrame) -> DataFrame:
    return dead.groupBy("error_type").agg(F.count("*").alias("count"))


def feed_lag(changes: DataFrame, as_of: Column, ts: str = "ts") -> DataFrame:
    """Per namespace: last event and whole seconds since then."""
    return changes.groupBy("database", "collection").agg(F.max(ts).alias("last_event")).withColumn(
        "lag_seconds", F.unix_timestamp(as_of) - F.unix_timestamp("last_event"))


def detection_counts(rows: DataFrame, text: str, chosen: dict[str, str] | None = None) -> DataFrame:
    """Matches of each personal-data type over all rows, in one pass."""
    found = chosen or patterns()
    sums = rows.agg(*[
        F.sum(count_matches(F.col(text), n, p)).cast("long").alias(n) for n, p in found.items()])
    return sums.unpivot([], list(found), "type", "detections")


def live_keys(keys: DataFrame, as_of: Column, ttl_seconds: int = 24 * 3600) -> DataFrame:
    """Number of tracked idempotency keys that have not expired."""
    live = keys.where(F.col("created_at") > as_of - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return live.agg(F.count("*").alias("tracked_keys")).withColumn(
        "ttl_seconds", F.lit(ttl_seconds))


def keep_newest(rows: DataFrame, route: str, ts: str, row_id: str, count: int,
                bucket_seconds: float = 3600.0) -> DataFrame:
    """The newest ``count`` rows of every route.

    Whole time buckets are kept or dropped by their counts; only the bucket at the cut is sorted.
    """
    flagged = admit_until(rows, [route], ts, row_id, F.lit(1).cast("long"), F.lit(count),
                          bucket_seconds, descending=True, name="_keep")
    return flagged.where("_keep").drop("_keep")
