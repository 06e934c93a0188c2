"""Queries over usage against budgets, quotas and admission limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillflow.operators.limits import (
    bucket_admission, budget_gate, join_quota, provider_limits, retry_ratio, sliding_admission)
from quillflow.plans.registry import query
from quillflow.plans.views import MOMENT_SQL, USAGE, moment, usage


@query("budget_gate", f"""
WITH {USAGE}
SELECT id, agent_id, coalesce(sum(cost_usd) OVER (PARTITION BY agent_id, date_trunc('day', ts)
  ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.75 AS admitted
FROM usage""")
def cost_budget(spark: SparkSession, folder: str) -> DataFrame:
    rows = usage(spark, folder).select("id", "agent_id", "ts", "cost_usd")
    limit = F.lit("0.75").cast("decimal(18,6)")
    return budget_gate(rows, ["agent_id"], "ts", "id", F.col("cost_usd"), limit).select(
        "id", "agent_id", "admitted")


@query("token_budget", f"""
WITH {USAGE}
SELECT id, agent_id = 'a9' OR coalesce(sum(total_tokens) OVER (
  PARTITION BY agent_id, date_trunc('hour', ts) ORDER BY ts, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100 * CAST(substr(agent_id, 2) AS INT) AS admitted
FROM usage""")
def token_budget(spark: SparkSession, folder: str) -> DataFrame:
    limits = [(f"a{n}", 100 * n if n < 9 else None) for n in range(10)]
    table = spark.createDataFrame(limits, "agent_id string, token_limit long")
    rows = usage(spark, folder).select("id", "agent_id", "ts", "total_tokens", "model")
    limited = join_quota(rows, provider_limits(spark), table)
    return budget_gate(limited, ["agent_id"], "ts", "id", F.col("total_tokens"),
                       F.col("token_limit"), window_seconds=3600).select("id", "admitted")


@query("quota_join", f"""
WITH {USAGE}, p AS (SELECT id, CASE WHEN contains(model, '/') THEN split_part(model, '/', 1)
  WHEN regexp_matches(lower(model), '^(gpt-|o1|o3)') THEN 'openai'
  WHEN starts_with(lower(model), 'claude') THEN 'anthropic'
  WHEN starts_with(lower(model), 'gemini') THEN 'google'
  WHEN regexp_matches(lower(model), '^(llama|mixtral)') THEN 'groq'
  WHEN starts_with(lower(model), 'mistral') THEN 'mistral'
  WHEN starts_with(lower(model), 'command') THEN 'cohere' ELSE 'unknown' END AS provider FROM usage)
SELECT id, provider, CASE WHEN provider IN ('openai', 'anthropic', 'google', 'azure', 'mistral') THEN 60.0
  WHEN provider = 'cohere' THEN 100.0 WHEN provider = 'groq' THEN 30.0 END::DOUBLE AS requests_per_minute,
  CASE WHEN provider IN ('openai', 'anthropic', 'google', 'azure', 'mistral') THEN 6.0
  WHEN provider = 'cohere' THEN 10.0 WHEN provider = 'groq' THEN 3.0 END::DOUBLE AS capacity
FROM p""")
def quotas(spark: SparkSession, folder: str) -> DataFrame:
    rows = usage(spark, folder).select("id", "model")
    return join_quota(rows, provider_limits(spark)).select(
        "id", "provider", "requests_per_minute", "capacity")


@query("sliding_admission", f"""
WITH RECURSIVE {USAGE}, seq AS (
  SELECT id, agent_id, epoch_us(ts) AS at,
    row_number() OVER (PARTITION BY agent_id ORDER BY ts, id) AS n FROM usage),
walk AS (
  SELECT agent_id, 0::BIGINT AS n, -1::BIGINT AS id, []::BIGINT[] AS recent, false AS admitted
  FROM (SELECT DISTINCT agent_id FROM seq)
  UNION ALL
  SELECT w.agent_id, s.n, s.id,
    CASE WHEN len(list_filter(w.recent, lambda t: t > s.at - 21600000000)) < 4
      THEN list_append(list_filter(w.recent, lambda t: t > s.at - 21600000000), s.at)
      ELSE list_filter(w.recent, lambda t: t > s.at - 21600000000) END,
    len(list_filter(w.recent, lambda t: t > s.at - 21600000000)) < 4
  FROM walk w JOIN seq s ON s.agent_id = w.agent_id AND s.n = w.n + 1)
SELECT id, admitted FROM walk WHERE n > 0""")
def sliding(spark: SparkSession, folder: str) -> DataFrame:
    rows = usage(spark, folder).select("id", "agent_id", "ts")
    return sliding_admission(rows, "agent_id", "ts", "id", 4, 6 * 3600).select("id", "admitted")


@query("bucket_admission", f"""
WITH RECURSIVE {USAGE}, seq AS (
  SELECT id, agent_id, epoch_us(ts) AS tick,
    row_number() OVER (PARTITION BY agent_id ORDER BY ts, id) AS n FROM usage),
walk AS (
  SELECT agent_id, 0::BIGINT AS n, -1::BIGINT AS id, 0::BIGINT AS tick, 3.0::DOUBLE AS tokens,
    3.0::DOUBLE AS before
  FROM (SELECT DISTINCT agent_id FROM seq)
  UNION ALL
  SELECT agent_id, n, id, tick, CASE WHEN before >= 1.0 THEN before - 1.0 ELSE before END, before
  FROM (SELECT s.agent_id, s.n, s.id, s.tick, CASE WHEN w.n = 0 THEN 3.0::DOUBLE ELSE
      least(3.0::DOUBLE, w.tokens + (s.tick - w.tick)::DOUBLE / 1000000::DOUBLE * 0.0005::DOUBLE) END AS before
    FROM walk w JOIN seq s ON s.agent_id = w.agent_id AND s.n = w.n + 1))
SELECT id, before >= 1.0 AS admitted FROM walk WHERE n > 0""")
def bucket(spark: SparkSession, folder: str) -> DataFrame:
    rows = usage(spark, folder).select("id", "agent_id", "ts")
    return bucket_admission(rows, "agent_id", "ts", "id", F.lit(0.0005), F.lit(3.0)).select(
        "id", "admitted")


@query("retry_ratio", f"""
WITH {USAGE}
SELECT strftime(date_trunc('second', ts), {MOMENT_SQL}) AS second,
  count(*) FILTER (NOT is_retry) AS requests, count(*) FILTER (is_retry) AS retries,
  CASE WHEN count(*) FILTER (NOT is_retry) > 0 THEN
    round(count(*) FILTER (is_retry) / count(*) FILTER (NOT is_retry), 6) ELSE 0.0 END AS retry_ratio,
  count(*) FILTER (is_retry) >= 10 OR (count(*) FILTER (NOT is_retry) > 0 AND
    count(*) FILTER (is_retry) / count(*) FILTER (NOT is_retry) >= 0.2) AS blocked
FROM usage GROUP BY date_trunc('second', ts)""")
def retries(spark: SparkSession, folder: str) -> DataFrame:
    rows = retry_ratio(usage(spark, folder), "ts", F.col("is_retry"))
    return rows.withColumn("second", moment("second"))
