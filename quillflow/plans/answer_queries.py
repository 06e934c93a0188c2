"""Queries that parse, check and read model answers, and that call the model."""

from __future__ import annotations

import json
import zlib
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillflow.functions.answers import parse_answers, pick_field
from quillflow.operators.cache import ANSWER_COLUMNS, refresh_cache
from quillflow.operators.complete import complete, lookup_cache
from quillflow.operators.history import cache_stats
from quillflow.plans.registry import query
from quillflow.plans.views import (
    ANSWER_SCHEMA, ANSWERS, MOMENT_SQL, REQUESTS, USAGE, answers, moment, requests, usage)

# The SQL finds the JSON with the same patterns; RE2 needs no possessive forms.
_PARSED = ANSWERS + r""", texts AS (
  SELECT *, trim(content, E' \t\n\r') AS t,
    trim(regexp_extract(content, '(?is)```(?:json)?\s*\n?(.*?)\n?```', 1), E' \t\n\r') AS fenced,
    regexp_extract(content, '(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}') AS obj,
    regexp_extract(content, '(?s)\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]') AS arr,
    regexp_extract(replace(regexp_replace(regexp_replace(content, ',\s*([}\]])', '\1', 'g'),
      '(\{|,)\s*(\w+)\s*:', '\1 "\2":', 'g'), '''', '"'), '(?s)\{.*\}') AS fixed
  FROM answers),
parsed AS (SELECT *, CASE WHEN json_valid(t) THEN 'whole'
    WHEN fenced <> '' AND json_valid(fenced) THEN 'fenced'
    WHEN obj <> '' AND json_valid(obj) THEN 'object' WHEN arr <> '' AND json_valid(arr) THEN 'array'
    WHEN fixed <> '' AND json_valid(fixed) THEN 'repaired' ELSE 'raw' END AS parse_strategy FROM texts),
found AS (SELECT *, CASE parse_strategy WHEN 'whole' THEN t WHEN 'fenced' THEN fenced
    WHEN 'object' THEN obj WHEN 'array' THEN arr WHEN 'repaired' THEN fixed
    ELSE json_object('content', t, '_raw', true)::VARCHAR END::JSON AS j FROM parsed)"""


@query("parse_answers", f"""
WITH {_PARSED}
SELECT doc_id, parse_strategy, json_extract_string(j, '$.quality') AS quality,
  json_extract_string(j, '$.mood.toxic') AS toxic,
  CASE WHEN parse_strategy = 'array' THEN json_extract_string(j, '$[0]')
       ELSE json_extract_string(j, '$.tags[0]') END AS first_tag FROM found""")
def parsed(spark: SparkSession, folder: str) -> DataFrame:
    out = parse_answers(answers(spark, folder), "content")
    whole = F.try_variant_get("parsed", "$[0]", "string")
    return out.select(
        "doc_id", "parse_strategy", pick_field(F.col("parsed"), "quality").alias("quality"),
        pick_field(F.col("parsed"), "mood.toxic").alias("toxic"),
        F.coalesce(pick_field(F.col("parsed"), "tags.0"), whole).alias("first_tag"))


@query("parse_answers_strict", f"""
WITH {_PARSED}
SELECT doc_id, CASE WHEN parse_strategy = 'raw' THEN 'Could not extract JSON from response' END AS parse_error
FROM found""")
def strict(spark: SparkSession, folder: str) -> DataFrame:
    return parse_answers(answers(spark, folder), "content", strict=True).select("doc_id", "parse_error")


@query("validate_answers", f"""
WITH {_PARSED}
SELECT doc_id, CASE WHEN parse_strategy = 'raw' THEN ''
  WHEN parse_strategy = 'array' THEN 'Expected type ''object'', got ''list'''
  ELSE array_to_string(list_concat(['Missing required field: ''reason'''],
    list_concat(CASE WHEN quality <> 1 THEN ['quality.Value must be one of: [1]'] ELSE [] END,
    list_concat(['mood.toxic.Expected type ''boolean'', got ''int'''],
    list_filter(list_transform(range(0, json_array_length(j, '$.tags')::BIGINT), lambda i:
      CASE WHEN json_extract_string(j, '$.tags[' || i || ']') IN ('t0', 't1', 't2', 't3') THEN NULL
      ELSE 'tags.[' || i || '].Value must be one of: [''t0'', ''t1'', ''t2'', ''t3'']' END),
      lambda e: e IS NOT NULL)))), '; ') END AS errors
FROM found""")
def validated(spark: SparkSession, folder: str) -> DataFrame:
    out = parse_answers(answers(spark, folder), "content", ANSWER_SCHEMA)
    return out.select("doc_id", F.array_join("schema_errors", "; ").alias("errors"))


@query("pick_field", f"""
WITH {_PARSED}
SELECT doc_id, CASE WHEN parse_strategy = 'array' THEN -1
    ELSE coalesce(CAST(json_extract_string(j, '$.quality') AS INTEGER), -1) END AS quality,
  coalesce(CASE WHEN parse_strategy <> 'array' THEN json_extract_string(j, '$.tags[1]') END, 'none') AS second_tag
FROM found""")
def picked(spark: SparkSession, folder: str) -> DataFrame:
    out = parse_answers(answers(spark, folder), "content")
    return out.select(
        "doc_id", pick_field(F.col("parsed"), "quality", "int", -1).alias("quality"),
        pick_field(F.col("parsed"), "tags.1", "string", "none").alias("second_tag"))


def demo_client() -> Any:
    """A stand-in for a model: its answer depends on the prompt only."""

    def client(batch: list[dict[str, Any]]) -> list[dict[str, Any]]:
        out = []
        for request in batch:
            prompt = request["prompt"]
            if len(prompt) % 50 == 49:
                out.append({"error": "slow down", "error_type": "AIRateLimitError"})
                continue
            body = {"length": len(prompt), "model": request["model"]}
            out.append({
                "content": "Result: " + json.dumps(body), "prompt_tokens": len(prompt.split(" ")),
                "completion_tokens": 4, "cost_usd": 0.001, "latency_ms": float(zlib.crc32(
                    prompt.encode()) % 100), "finish_reason": "stop"})
        return out

    return client


@query("call_model", f"""
WITH {REQUESTS}
SELECT id, CASE WHEN length(prompt) % 50 = 49 THEN NULL ELSE length(prompt) END AS length,
  CASE WHEN length(prompt) % 50 = 49 THEN 'AIRateLimitError' END AS error_type,
  CASE WHEN length(prompt) % 50 <> 49 THEN len(string_split(prompt, ' ')) + 4 ELSE 0 END AS total_tokens
FROM requests""")
def called(spark: SparkSession, folder: str) -> DataFrame:
    rows = requests(spark, folder).withColumn("max_tokens", F.lit(100))
    done = parse_answers(complete(rows, demo_client, row_id="id", tasks=8), "content")
    return done.select("id", pick_field(F.col("parsed"), "length", "bigint").alias("length"),
                       "error_type", "total_tokens")


@query("distinct_calls", f"""
WITH {REQUESTS}
SELECT count(DISTINCT CASE WHEN temperature > 0 THEN 'once:' || id ELSE
  concat_ws(chr(1), model, prompt, coalesce(system_prompt, chr(2))) END) AS calls, count(*) AS requests
FROM requests""")
def distinct_calls(spark: SparkSession, folder: str) -> DataFrame:
    rows = requests(spark, folder).withColumn("max_tokens", F.lit(100))
    done = complete(rows, demo_client, row_id="id")
    return done.agg(F.count_distinct("call_key").alias("calls"), F.count("*").alias("requests"))


_LOOKUP = REQUESTS + f""", cache AS (
  SELECT model || ':' || prompt AS request_key,
    TIMESTAMP '2024-01-01 12:00:00' - to_seconds(max(id) % 7200) AS cached_at
  FROM requests WHERE turn = 0 GROUP BY 1),
looked AS (SELECT r.id, c.request_key IS NOT NULL AS cache_hit,
    strftime(c.cached_at, {MOMENT_SQL}) AS cached_at
  FROM requests r LEFT JOIN cache c ON c.request_key = r.model || ':' || r.prompt
    AND epoch(TIMESTAMP '2024-01-01 12:00:00') - epoch(c.cached_at) <= 3600)"""


def _lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = requests(spark, folder).withColumn("request_key", F.concat_ws(":", "model", "prompt"))
    noon = F.lit("2024-01-01 12:00:00").cast("timestamp")
    cache = rows.where("turn = 0").groupBy("request_key").agg(
        (noon - F.make_dt_interval(secs=(F.max("id") % 7200).cast("decimal(18,6)"))).alias("cached_at"))
    return lookup_cache(rows, cache, noon)


@query("cache_lookup", f"WITH {_LOOKUP} SELECT * FROM looked")
def cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _lookup(spark, folder).select("id", "cache_hit", moment("cached_at").alias("cached_at"))


@query("cache_refresh", f"""
WITH {USAGE}, calls AS (SELECT *, model || ':' || agent_id || ':' || (id % 97) AS call_key FROM usage),
until AS (SELECT max(ts) AS as_of FROM usage),
old AS (SELECT call_key, max(ts) AS was FROM calls, until WHERE id % 3 = 0 GROUP BY call_key, as_of
  HAVING max(ts) >= as_of - INTERVAL 6 DAY),
used AS (SELECT call_key, min(ts) AS begun, max(ts) AS ended FROM calls WHERE id % 3 > 0 GROUP BY call_key),
every AS (SELECT call_key, was, coalesce(was, begun) AS cached, coalesce(greatest(was, ended), was, ended) AS touched
  FROM old FULL JOIN used USING (call_key))
SELECT call_key, CASE WHEN was IS NULL THEN 'new' ELSE 'old' END AS content,
  strftime(cached, {MOMENT_SQL}) AS cached_at, strftime(touched, {MOMENT_SQL}) AS used_at
FROM every ORDER BY touched DESC, call_key DESC LIMIT 1000""")
def cache_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """A cache of a third of the usage after a run of the others, cut to the latest 1000 entries."""
    rows = usage(spark, folder).withColumn("call_key", F.concat_ws(":", "model", "agent_id", F.col("id") % 97))
    as_of = F.lit(rows.agg(F.max("ts")).first()[0])
    none = {n: F.lit(None).cast(k) for n, k in ANSWER_COLUMNS.items() if n not in rows.columns}
    answers = rows.withColumns({**none, "error_type": F.lit(None).cast("string"), "prompt": F.col("model")})
    old = answers.where("id % 3 = 0").groupBy("call_key").agg(
        F.max("ts").alias("cached_at"), F.max("ts").alias("used_at")).withColumns(
        {n: F.lit(None).cast(k) for n, k in ANSWER_COLUMNS.items()}).withColumn("content", F.lit("old"))
    run = answers.where("id % 3 > 0").withColumn("content", F.lit("new"))
    kept = refresh_cache(old, run, as_of, "ts", 6 * 24 * 3600, 1000)
    return kept.select("call_key", "content", moment("cached_at").alias("cached_at"), moment("used_at").alias("used_at"))


@query("cache_hit_rate", f"""
WITH {_LOOKUP}
SELECT count(*) FILTER (cache_hit) AS hits, count(*) FILTER (NOT cache_hit) AS misses,
  round(count(*) FILTER (cache_hit) / count(*), 3) AS hit_rate FROM looked""")
def hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    return cache_stats(_lookup(spark, folder))
