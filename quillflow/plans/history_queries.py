"""Queries over executions, usage, queues and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillflow.functions.keys import provider_of_model, retry_delay, retryable, stable_fraction
from quillflow.operators import history as h
from quillflow.operators.failure import (
    dead_letters, delete_rows, failure_runs, keep_recent, plan_retries, replay_dead_letters,
    retry_items, stuck_items)
from quillflow.plans.registry import query
from quillflow.plans.views import (
    CHANGES, EXECUTIONS, MOMENT_SQL, USAGE, changes, executions, moment, usage)
from quillflow.sources.tables import audit_rows

AS_OF = "1999-06-15 10:30:00"
EVENTS_AS_OF = "2024-02-01 00:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp")


@query("exec_stats", f"""
WITH {EXECUTIONS}, s AS (SELECT status, count(*) AS count, round(avg(duration_ms), 2) AS avg_duration_ms
  FROM executions WHERE started_at >= date_trunc('hour', TIMESTAMP '{AS_OF}') - INTERVAL 2400 HOUR
  GROUP BY status)
SELECT *, CAST(sum(count) OVER () AS BIGINT) AS total FROM s""")
def exec_stats(spark: SparkSession, folder: str) -> DataFrame:
    return h.execution_stats(executions(spark, folder), AS_OF, hours=2400)


@query("exec_stats_by_agent", f"""
WITH {EXECUTIONS}, s AS (SELECT status, count(*) AS count, round(avg(duration_ms), 2) AS avg_duration_ms
  FROM executions WHERE agent_id = 'a7' AND started_at >= date_trunc('hour', TIMESTAMP '{AS_OF}') - INTERVAL 9600 HOUR
  GROUP BY status)
SELECT *, CAST(sum(count) OVER () AS BIGINT) AS total FROM s""")
def exec_stats_agent(spark: SparkSession, folder: str) -> DataFrame:
    return h.execution_stats(executions(spark, folder), AS_OF, hours=9600, agent_id="a7")


@query("history_page", f"""
WITH {EXECUTIONS}
SELECT id, agent_id, status, strftime(started_at, {MOMENT_SQL}) AS started_at FROM executions
WHERE status = 'failed' AND started_at >= TIMESTAMP '1996-01-01' AND started_at <= TIMESTAMP '1999-12-31'
ORDER BY executions.started_at DESC, id LIMIT 50 OFFSET 100""")
def history_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = h.select_history(executions(spark, folder), {"status": "failed", "agent_id": None},
                            "started_at", "1996-01-01", "1999-12-31")
    return h.newest_first(rows, "started_at", "id", skip=100, limit=50).select(
        "id", "agent_id", "status", moment("started_at").alias("started_at"))


@query("history_deep_page", f"""
WITH {EXECUTIONS}, spot AS (SELECT count(*) * 3 // 5 AS skip FROM executions)
SELECT id, agent_id, strftime(started_at, {MOMENT_SQL}) AS started_at FROM (
  SELECT *, row_number() OVER (ORDER BY started_at DESC, id) AS place FROM executions), spot
WHERE place > skip AND place <= skip + 1000""")
def history_deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """A full page three fifths down the history."""
    rows = executions(spark, folder)
    return h.newest_first(rows, "started_at", "id", rows.count() * 3 // 5, 1000, deep=500).select(
        "id", "agent_id", moment("started_at").alias("started_at"))


@query("history_by_id", f"WITH {EXECUTIONS} SELECT id, agent_id, status, attempt FROM executions WHERE id = 77")
def by_id(spark: SparkSession, folder: str) -> DataFrame:
    return h.select_history(executions(spark, folder), {"id": 77}).select(
        "id", "agent_id", "status", "attempt")


@query("history_total", f"""
WITH {EXECUTIONS} SELECT count(*) AS total FROM executions WHERE agent_id = 'a3'""")
def history_total(spark: SparkSession, folder: str) -> DataFrame:
    return h.select_history(executions(spark, folder), {"agent_id": "a3"}).agg(
        F.count("*").alias("total"))


@query("agent_stats", f"""
WITH {USAGE}
SELECT agent_id, count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed,
  CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd,
  round(avg(latency_ms), 2) AS avg_latency_ms, strftime(max(ts), {MOMENT_SQL}) AS last_execution,
  arg_max(error, (ts, id)) FILTER (NOT ok) AS last_error
FROM usage GROUP BY agent_id""")
def agent_stats(spark: SparkSession, folder: str) -> DataFrame:
    return h.agent_stats(usage(spark, folder)).withColumn(
        "last_execution", moment("last_execution")).withColumn(
        "cost_usd", F.col("cost_usd").cast("double"))


@query("usage_global", f"""
WITH {USAGE}
SELECT strftime(date_trunc('day', ts), {MOMENT_SQL}) AS window_start,
  CAST(sum(cost_usd) AS DOUBLE) AS total_cost_usd, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  count(*) AS request_count, round(CAST(sum(cost_usd) AS DOUBLE) / 25.0, 6) AS cost_utilization
FROM usage GROUP BY date_trunc('day', ts)""")
def usage_global(spark: SparkSession, folder: str) -> DataFrame:
    out = h.usage_global(usage(spark, folder), cost_limit=25.0)
    return out.withColumn("window_start", moment("window_start")).withColumn(
        "total_cost_usd", F.col("total_cost_usd").cast("double"))


_BY = "CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS requests"


@query("usage_by_agent", f"WITH {USAGE} SELECT agent_id, {_BY} FROM usage GROUP BY agent_id")
def usage_by_agent(spark: SparkSession, folder: str) -> DataFrame:
    return h.usage_by(usage(spark, folder), "agent_id").withColumn(
        "cost_usd", F.col("cost_usd").cast("double"))


@query("usage_by_model", f"WITH {USAGE} SELECT model, {_BY} FROM usage GROUP BY model")
def usage_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return h.usage_by(usage(spark, folder), "model").withColumn(
        "cost_usd", F.col("cost_usd").cast("double"))


@query("average_tokens", f"""
WITH {USAGE} SELECT count(*) AS request_count,
  round(CAST(sum(total_tokens) AS DOUBLE) / count(*), 6) AS avg_tokens_per_request FROM usage""")
def average_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return h.average_tokens(usage(spark, folder))


@query("top_agents", f"""
WITH {USAGE} SELECT agent_id, {_BY} FROM usage GROUP BY agent_id
ORDER BY sum(usage.cost_usd) DESC, agent_id LIMIT 3""")
def top_agents(spark: SparkSession, folder: str) -> DataFrame:
    return h.top_agents(usage(spark, folder), 3).withColumn(
        "cost_usd", F.col("cost_usd").cast("double"))


@query("top_agents_by_tokens", f"""
WITH {USAGE} SELECT agent_id, {_BY} FROM usage GROUP BY agent_id
ORDER BY sum(total_tokens) DESC, agent_id LIMIT 4""")
def top_by_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return h.top_agents(usage(spark, folder), 4, by="tokens").withColumn(
        "cost_usd", F.col("cost_usd").cast("double"))


@query("event_counter", f"""
WITH {CHANGES} SELECT database, collection, operation, count(*) AS total FROM changes GROUP BY ALL""")
def event_counter(spark: SparkSession, folder: str) -> DataFrame:
    return h.counter(changes(spark, folder), ["database", "collection", "operation"])


@query("execution_counter", f"""
WITH {EXECUTIONS} SELECT agent_id, status, count(*) AS total FROM executions GROUP BY ALL""")
def execution_counter(spark: SparkSession, folder: str) -> DataFrame:
    return h.counter(executions(spark, folder), ["agent_id", "status"])


_PROVIDER = """CASE WHEN contains(model, '/') THEN split_part(model, '/', 1)
  WHEN regexp_matches(lower(model), '^(gpt-|o1|o3)') THEN 'openai'
  WHEN starts_with(lower(model), 'claude') THEN 'anthropic'
  WHEN starts_with(lower(model), 'gemini') THEN 'google'
  WHEN regexp_matches(lower(model), '^(llama|mixtral)') THEN 'groq'
  WHEN starts_with(lower(model), 'mistral') THEN 'mistral'
  WHEN starts_with(lower(model), 'command') THEN 'cohere' ELSE 'unknown' END"""


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return usage(spark, folder).withColumn("provider", provider_of_model(F.col("model"))).withColumn(
        "status", F.when(F.col("ok"), "success").otherwise("error"))


@query("request_counter", f"""
WITH {USAGE} SELECT {_PROVIDER} AS provider, model,
  CASE WHEN ok THEN 'success' ELSE 'error' END AS status, count(*) AS total FROM usage GROUP BY ALL""")
def request_counter(spark: SparkSession, folder: str) -> DataFrame:
    return h.counter(_labelled(spark, folder), ["provider", "model", "status"])


@query("cost_counter", f"""
WITH {USAGE} SELECT {_PROVIDER} AS provider, model, CAST(sum(cost_usd) AS DOUBLE) AS total
FROM usage GROUP BY ALL""")
def cost_counter(spark: SparkSession, folder: str) -> DataFrame:
    return h.counter(_labelled(spark, folder), ["provider", "model"], F.col("cost_usd")).withColumn(
        "total", F.col("total").cast("double"))


@query("token_counter", f"""
WITH {USAGE}, t AS (SELECT {_PROVIDER} AS provider, model, CAST(sum(prompt_tokens) AS BIGINT) AS p,
  CAST(sum(completion_tokens) AS BIGINT) AS c FROM usage GROUP BY ALL)
SELECT provider, model, 'prompt' AS type, p AS tokens FROM t
UNION ALL SELECT provider, model, 'completion', c FROM t""")
def token_counter(spark: SparkSession, folder: str) -> DataFrame:
    return h.token_counter(_labelled(spark, folder), ["provider", "model"],
                           {"prompt": "prompt_tokens", "completion": "completion_tokens"})


@query("processed_counter", f"""
WITH {EXECUTIONS} SELECT 'work:priority:' || priority AS queue, status, count(*) AS total
FROM executions GROUP BY ALL""")
def processed_counter(spark: SparkSession, folder: str) -> DataFrame:
    rows = executions(spark, folder).withColumn(
        "queue", F.concat(F.lit("work:priority:"), F.col("priority").cast("string")))
    return h.counter(rows, ["queue", "status"])


def _histogram_sql(source: str, label: str, seconds: str, buckets: tuple[float, ...]) -> str:
    parts = [(str(b), f"count(*) FILTER ({seconds} <= {b})") for b in buckets] + [("+Inf", "count(*)")]
    return " UNION ALL ".join(
        f"SELECT {label}, CAST(sum(CAST({seconds} AS DECIMAL(28,6))) AS DOUBLE) AS duration_sum, "
        f"count(*) AS duration_count, '{name}' AS le, {count} AS bucket_count FROM {source} GROUP BY 1"
        for name, count in parts)


@query("duration_histogram", f"WITH {EXECUTIONS} " + _histogram_sql(
    "executions", "agent_id", "(duration_ms / 10000)", h.EXECUTION_BUCKETS))
def duration_histogram(spark: SparkSession, folder: str) -> DataFrame:
    out = h.duration_histogram(executions(spark, folder), ["agent_id"], F.col("duration_ms") / 10000)
    return out.withColumn("duration_sum", F.col("duration_sum").cast("double"))


@query("request_histogram", f"WITH {USAGE} " + _histogram_sql(
    "usage", "model", "(latency_ms / 5)", h.AI_BUCKETS))
def request_histogram(spark: SparkSession, folder: str) -> DataFrame:
    out = h.duration_histogram(usage(spark, folder), ["model"], F.col("latency_ms") / 5, h.AI_BUCKETS)
    return out.withColumn("duration_sum", F.col("duration_sum").cast("double"))


@query("feed_lag", f"""
WITH {CHANGES} SELECT database, collection, strftime(max(ts), {MOMENT_SQL}) AS last_event,
  CAST(epoch(TIMESTAMP '{EVENTS_AS_OF}') - floor(epoch(max(ts))) AS BIGINT) AS lag_seconds
FROM changes GROUP BY 1, 2""")
def feed_lag(spark: SparkSession, folder: str) -> DataFrame:
    return h.feed_lag(changes(spark, folder), _at(EVENTS_AS_OF)).withColumn(
        "last_event", moment("last_event"))


@query("queue_depth", f"""
WITH {EXECUTIONS} SELECT agent_id, priority, count(*) AS pending,
  CAST(epoch(TIMESTAMP '2002-01-01') - epoch(max(started_at)) AS BIGINT) AS idle_seconds
FROM executions WHERE status = 'processing' GROUP BY 1, 2""")
def queue_depth(spark: SparkSession, folder: str) -> DataFrame:
    waiting = executions(spark, folder).where("status = 'processing'")
    return h.queue_depth(waiting, _at("2002-01-01"), ["agent_id", "priority"], "started_at")


@query("failures_by_type", f"""
WITH {EXECUTIONS} SELECT error_type, count(*) AS count FROM executions
WHERE status = 'failed' AND attempt >= 4 GROUP BY 1""")
def failures_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return h.failures_by_type(_dead(spark, folder))


@query("tracked_keys", f"""
WITH {EXECUTIONS} SELECT count(*) AS tracked_keys, 8640000 AS ttl_seconds FROM executions
WHERE started_at > TIMESTAMP '{AS_OF}' - INTERVAL 100 DAY""")
def tracked_keys(spark: SparkSession, folder: str) -> DataFrame:
    keys = executions(spark, folder).select(F.col("started_at").alias("created_at"))
    return h.live_keys(keys, _at(AS_OF), 8640000)


def _failed(spark: SparkSession, folder: str) -> DataFrame:
    return executions(spark, folder).where("status = 'failed'").withColumn(
        "error", F.concat(F.lit("failed: "), F.col("error_type"))).withColumn(
        "route", F.concat(F.lit("work:agent:"), F.col("agent_id")))


def _dead(spark: SparkSession, folder: str) -> DataFrame:
    return dead_letters(plan_retries(_failed(spark, folder), "started_at"), "started_at")


_DEAD = EXECUTIONS + """, dead AS (SELECT *, 'work:agent:' || agent_id AS source FROM executions
  WHERE status = 'failed' AND attempt >= max_attempts)"""


@query("retry_plan", f"""
WITH {EXECUTIONS}
SELECT id, CASE WHEN attempt < max_attempts THEN 'retry' ELSE 'dead_letter' END AS next_step,
  CASE WHEN attempt < max_attempts THEN attempt + 1 END AS next_attempt,
  CASE WHEN attempt < max_attempts THEN least(1.5 * pow(2, attempt), 10.0) END AS delay_seconds,
  CASE WHEN attempt < max_attempts THEN strftime(started_at + to_microseconds(
    CAST(least(1.5 * pow(2, attempt), 10.0) * 1000000 AS BIGINT)), {MOMENT_SQL}) END AS scheduled_at
FROM executions WHERE status = 'failed'""")
def retry_plan(spark: SparkSession, folder: str) -> DataFrame:
    out = plan_retries(_failed(spark, folder), "started_at", base=1.5, limit=10.0)
    return out.select("id", "next_step", "next_attempt", "delay_seconds",
                      moment("scheduled_at").alias("scheduled_at"))


@query("retry_items", f"""
WITH {EXECUTIONS} SELECT id, attempt + 1 AS attempt FROM executions
WHERE status = 'failed' AND attempt < max_attempts""")
def retried(spark: SparkSession, folder: str) -> DataFrame:
    return retry_items(plan_retries(_failed(spark, folder), "started_at")).select("id", "attempt")


@query("retry_decision", f"""
WITH {EXECUTIONS}
SELECT id, attempt < max_attempts AND error_type IN ('TimeoutError', 'AIRateLimitError') AS again,
  attempt < max_attempts AND error_type <> 'AIRateLimitError' AS again_unless_limited,
  least(0.5 * pow(3, attempt - 1), 20.0) AS delay, true AS jitter_in_range
FROM executions WHERE status = 'failed'""")
def retry_decision(spark: SparkSession, folder: str) -> DataFrame:
    kind, attempt, most = F.col("error_type"), F.col("attempt"), F.col("max_attempts")
    delay = retry_delay(attempt, 0.5, 20.0, 3.0)
    jittered = retry_delay(attempt, 0.5, 20.0, 3.0, jitter=stable_fraction(F.col("id")))
    return _failed(spark, folder).select(
        "id", retryable(kind, attempt, most).alias("again"),
        retryable(kind, attempt, most, allow=(), refuse=("AIRateLimitError",)).alias(
            "again_unless_limited"),
        retry_delay(attempt, 0.5, 20.0, 3.0).alias("delay"),
        jittered.between(delay, delay * 1.5).alias("jitter_in_range"))


@query("dead_letter_split", f"""
WITH {_DEAD}
SELECT id, 'failed: ' || error_type AS error, error_type, source AS dlq_source_route,
  attempt AS dlq_final_attempt, strftime(started_at, {MOMENT_SQL}) AS dlq_added_at FROM dead""")
def dead_letter_split(spark: SparkSession, folder: str) -> DataFrame:
    return _dead(spark, folder).select(
        "id", "error", "error_type", "dlq_source_route", "dlq_final_attempt",
        moment("dlq_added_at").alias("dlq_added_at"))


@query("dlq_replay", f"""
WITH {_DEAD}
SELECT id, CASE WHEN error_type = 'TimeoutError' THEN 0 ELSE attempt END AS attempt,
  CASE WHEN error_type = 'TimeoutError' THEN 'work:again' ELSE 'dead' END AS place FROM dead""")
def dlq_replay(spark: SparkSession, folder: str) -> DataFrame:
    dead = _dead(spark, folder)
    chosen = dead.where("error_type = 'TimeoutError'").select("id")
    work, rest = replay_dead_letters(dead, chosen, _at(AS_OF), "work:again", "id")
    return work.select("id", "attempt", F.col("route").alias("place")).unionByName(
        rest.select("id", "attempt", F.lit("dead").alias("place")))


@query("dlq_delete", f"WITH {_DEAD} SELECT id FROM dead WHERE error_type <> 'AIProviderError'")
def dlq_delete(spark: SparkSession, folder: str) -> DataFrame:
    dead = _dead(spark, folder)
    return delete_rows(dead, dead.where("error_type = 'AIProviderError'"), "id").select("id")


@query("dlq_page", f"""
WITH {_DEAD} SELECT id, agent_id, attempt, error_type FROM dead ORDER BY id LIMIT 100""")
def dlq_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = _dead(spark, folder)
    return h.page(rows, [F.col("id")]).select("id", "agent_id", "attempt", "error_type")


@query("stuck_items", f"""
WITH {EXECUTIONS}, idle AS (SELECT *, CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(started_at) AS BIGINT) AS idle_seconds
  FROM executions)
SELECT id, attempt + 1 AS attempt, idle_seconds FROM idle WHERE idle_seconds >= 60 AND status = 'processing'""")
def stuck(spark: SparkSession, folder: str) -> DataFrame:
    rows = executions(spark, folder)
    done = rows.where("status <> 'processing'")
    return stuck_items(rows, done, _at(AS_OF), "id", "started_at").select(
        "id", "attempt", "idle_seconds")


@query("purge_expired", f"""
WITH {EXECUTIONS} SELECT id FROM executions WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def purge(spark: SparkSession, folder: str) -> DataFrame:
    return keep_recent(executions(spark, folder), "started_at", _at(AS_OF), 7 * 86400).select("id")


@query("keep_newest", f"""
WITH {EXECUTIONS} SELECT id, agent_id FROM executions
QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY started_at DESC, id DESC) <= 100""")
def keep_newest(spark: SparkSession, folder: str) -> DataFrame:
    rows = executions(spark, folder).select("id", "agent_id", "started_at")
    return h.keep_newest(rows, "agent_id", "started_at", "id", 100, 7 * 86400).select("id", "agent_id")


@query("failure_runs", f"""
WITH {USAGE}, runs AS (SELECT agent_id, ts, ok, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (
    PARTITION BY agent_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM usage)
SELECT agent_id, count(*) AS failures, strftime(min(ts), {MOMENT_SQL}) AS first_failure,
  strftime(max(ts), {MOMENT_SQL}) AS last_failure
FROM runs WHERE NOT ok GROUP BY agent_id, coalesce(run, 0) HAVING count(*) >= 3""")
def runs_of_failures(spark: SparkSession, folder: str) -> DataFrame:
    rows = usage(spark, folder).select("id", "agent_id", "ts", "ok")
    out = failure_runs(rows, ["agent_id"], "ts", "id", ~F.col("ok"), threshold=3)
    return out.withColumn("first_failure", moment("first_failure")).withColumn(
        "last_failure", moment("last_failure"))


@query("audit_page", f"""
WITH {EXECUTIONS}
SELECT strftime(started_at, {MOMENT_SQL}) AS timestamp, agent_id AS actor,
  CAST(id AS VARCHAR) AS resource_id, false AS success, error_type AS error
FROM executions WHERE status = 'failed' AND started_at <= TIMESTAMP '{AS_OF}'
ORDER BY executions.started_at DESC, resource_id LIMIT 100""")
def audit_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = executions(spark, folder).where("status = 'failed'")
    audit = audit_rows(
        rows, "execution.failed", F.col("started_at"), actor=F.col("agent_id"),
        resource_type=F.lit("execution"), resource_id=F.col("id").cast("string"),
        success=F.lit(False), error=F.col("error_type"))
    found = h.select_history(audit, {"action": "execution.failed", "resource_type": "execution"},
                             "timestamp", end=AS_OF)
    return h.newest_first(found, "timestamp", "resource_id").select(
        moment("timestamp").alias("timestamp"), "actor", "resource_id", "success", "error")
