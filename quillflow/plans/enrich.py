"""The whole flow over one set of changes: match, key, render, call, parse, check, result rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from quillflow.functions.answers import parse_answers, schema_errors
from quillflow.functions.columns import let
from quillflow.functions.keys import default_key, provider_of_model, route_name
from quillflow.operators.apply import Write, apply_writes, effective_answer
from quillflow.operators.complete import Client, complete, render_prompts, template_key
from quillflow.operators.dedup import dedup_first, dedup_window
from quillflow.operators.limits import budget_gate, sliding_admission
from quillflow.operators.match import match_agents
from quillflow.sources.catalog import Agent
from quillflow.sources.tables import Stage


def work_items(
    changes: DataFrame, agents: list[Agent], event_id: str = "event_id", strategy: str = "by_agent",
) -> DataFrame:
    """Matched changes as work items with id, idempotency key, attempt 0 and route.

    Ids are derived from agent and event, so a rerun task makes the same ones.
    """
    matched = match_agents(changes, agents)
    active = [a for a in agents if a.enabled]
    dtype = matched.schema["full_document"].dataType
    key = default_key(F.col("agent_id"), F.col("document_id"), F.col("full_document"), dtype)
    return (
        matched
        .withColumn("work_item_id", F.md5(F.concat_ws(":", "agent_id", F.col(event_id).cast("string"))))
        .withColumn("attempt", F.lit(0))
        .withColumn("idempotency_key", F.when(
            F.col("deduplicate"), template_key(matched, active, key)))
        .withColumn("route", route_name(strategy))
    )


def dispatch(items: DataFrame, ts: str = "ts", agents: list[Agent] | None = None) -> DataFrame:
    """Work items without duplicates of the same idempotency key.

    Over all time, or with ``agents`` within the window of each agent: an item goes if an accepted
    one of its key is less than ``deduplicate_window_seconds`` older (0 keeps all). Each
    different window is a pass of its own over the items.
    """
    if agents is None:
        return dedup_first(items, "idempotency_key", ts, "work_item_id")
    windows: dict[int, list[str]] = {}
    for agent in agents:
        if agent.deduplicate and agent.deduplicate_window_seconds:
            windows.setdefault(agent.deduplicate_window_seconds, []).append(agent.id)
    out = items.where(~F.col("agent_id").isin([i for ids in windows.values() for i in ids]))
    for seconds, ids in windows.items():
        rows = items.where(F.col("agent_id").isin(ids))
        out = out.unionByName(dedup_window(rows, "idempotency_key", ts, "work_item_id", seconds))
    return out


def admit(items: DataFrame, agents: list[Agent], spent: DataFrame | None = None,
          ts: str = "ts") -> DataFrame:
    """Items with ``refused``: the setting of their agent that holds them back, or null.

    ``spent`` (agent_id, ts, cost_usd, total_tokens) are earlier executions: an item is refused once those
    that lie before it in its hour reach ``cost_limit_usd`` or ``token_limit``. Of the rest,
    ``rate_limit_requests`` are admitted per trailing minute.
    """
    out = items.withColumn("refused", F.lit(None).cast("string"))
    for setting, column in (("cost_limit_usd", "cost_usd"), ("token_limit", "total_tokens")):
        limits = {a.id: getattr(a, setting) for a in agents if getattr(a, setting) is not None}
        if limits and spent is not None:
            out = _within_budget(out, spent.select("agent_id", F.col(ts), F.col(column).alias("_spend")),
                                 limits, setting, ts)
    rates: dict[int, list[str]] = {}
    for agent in agents:
        if agent.rate_limit_requests is not None:
            rates.setdefault(agent.rate_limit_requests, []).append(agent.id)
    for rate, ids in rates.items():
        counted = F.when(F.col("agent_id").isin(ids) & F.col("refused").isNull(), F.col("agent_id"))
        out = sliding_admission(out.withColumn("_counted", counted), "_counted", ts, "work_item_id", rate,
                                name="_admitted")
        out = out.withColumn("refused", F.when(F.col("_admitted"), F.col("refused")).otherwise(
            F.lit("rate_limit_requests"))).drop("_counted", "_admitted")
    return out


def _within_budget(items: DataFrame, spent: DataFrame, limits: dict[str, float], setting: str,
                   ts: str) -> DataFrame:
    kind = spent.schema["_spend"].dataType
    # An execution at the time of an item comes after it.
    rows = items.withColumns({
        "_spend": F.lit(0).cast(kind), "_order": F.concat(F.lit("0"), F.col("work_item_id"))}).unionByName(
        spent.where(F.col("agent_id").isin(list(limits))).withColumn("_order", F.lit("1")),
        allowMissingColumns=True)
    limited = F.when(F.col("agent_id").isin(list(limits)), F.col("agent_id"))
    bound = F.create_map(*(F.lit(v) for pair in limits.items() for v in pair))
    gated = budget_gate(
        rows.withColumn("_limited", limited), ["_limited"], ts, "_order", F.coalesce("_spend", F.lit(0).cast(kind)),
        F.try_element_at(bound, F.col("_limited")), window_seconds=3600, name="_admitted")
    return gated.where(F.startswith("_order", F.lit("0"))).withColumn(
        "refused", F.coalesce("refused", F.when(~F.col("_admitted"), F.lit(setting)))).select(items.columns)


def check_answers(results: DataFrame, agents: list[Agent]) -> DataFrame:
    """Parse the answers once and check each against the schema of its agent."""
    parsed = parse_answers(results, "content").drop("schema_errors")
    errors: Column = F.array().cast("array<string>")
    from_json = F.col("parse_error").isNull() & (F.col("parse_strategy") != "raw")
    by_schema: dict[str, list[Agent]] = {}
    for agent in agents:
        if agent.response_schema:
            by_schema.setdefault(json.dumps(agent.response_schema), []).append(agent)
    for group in by_schema.values():
        own = from_json & F.col("agent_id").isin([a.id for a in group])
        check = let(F.col("parsed"), partial(schema_errors, schema=group[0].response_schema))
        errors = F.when(own, check).otherwise(errors)
    return parsed.withColumn("schema_errors", errors).withColumn(
        "answer", effective_answer(F.col("parsed"), F.col("content")))


# Requests of one calling task, so that a lost task repeats few paid calls.
CALLS_PER_TASK = 2000


def distinct_calls(requests: DataFrame) -> int:
    """About how many different calls the requests need, rather too many; equal prompts are one call when shared."""
    alone = F.coalesce(F.col("temperature") > 0, F.lit(False))
    prompt = F.when(~alone, F.xxhash64("agent_id", "prompt", "system_prompt"))
    found = requests.where("prompt IS NOT NULL").agg(
        F.count_if(alone).alias("alone"), F.approx_count_distinct(prompt, 0.02).alias("shared")).first()
    return found["alone"] + found["shared"] * 21 // 20


def enrich(
    items: DataFrame, agents: list[Agent], make_client: Callable[[], Client], *,
    finished_at: Column | None = None, cache: DataFrame | None = None, tasks: int | None = None,
    stage: Stage | None = None, extra: dict[str, Any] | None = None,
    again: DataFrame | None = None, overlap: int = 1, cache_ttl_seconds: int = 3600,
) -> DataFrame:
    """Result rows of work items: answer, checks, usage, and the error of a failed item.

    ``again`` adds requests that are due for a retry; their prompts exist already. The documents
    are needed for the prompts only and are dropped after them. ``stage`` stores
    the requests, which are read twice, and the answers, which must not be asked for again.
    Items that ``admit`` refused aren't asked; their result is an AgentLimitError.
    """
    active = [a for a in agents if a.enabled]
    requests = render_prompts(items, active, extra=extra).drop(
        "full_document", "update_description", "resume_token")
    if again is not None:
        requests = requests.unionByName(again.select(
            *(c for c in requests.columns if c != "refused")), allowMissingColumns=True)
    if stage is not None:
        requests = stage(requests, "requests")
        tasks = tasks or max(requests.sparkSession.sparkContext.defaultParallelism,
                             -(-distinct_calls(requests) // CALLS_PER_TASK))
    held = None
    if "refused" in requests.columns:
        held = requests.where("refused IS NOT NULL AND render_error IS NULL")
        requests = requests.where("refused IS NULL OR render_error IS NOT NULL").drop("refused")
    save = None if stage is None else partial(stage, name="answers")
    answered = complete(requests, make_client, tasks=tasks, overlap=overlap, cache=cache, save=save,
                        as_of=finished_at, ttl_seconds=cache_ttl_seconds)
    if held is not None:
        answered = answered.unionByName(held.withColumns({
            "error": F.concat(F.lit("reached "), F.col("refused")), "error_type": F.lit("AgentLimitError"),
            "provider": provider_of_model(F.col("model"))}).drop("refused"), allowMissingColumns=True)
    failed = F.col("render_error").isNotNull()
    answered = (
        answered
        .withColumn("error", F.coalesce("render_error", "error"))
        .withColumn("error_type", F.when(failed, "PromptRenderError").otherwise(F.col("error_type")))
        .withColumn("started_at", F.col("ts"))
        .withColumn("completed_at", F.col("ts") if finished_at is None else finished_at)
    )
    return check_answers(answered, active)


# SQL types of JSON schema types.
SQL_TYPES = {"string": "string", "number": "double", "integer": "bigint", "boolean": "boolean",
             "object": "variant", "null": "string"}


def sql_type(schema: dict[str, Any]) -> str:
    """SQL type of an answer field; untyped fields stay VARIANT."""
    if schema.get("type") == "array":
        return f"array<{sql_type(schema.get('items') or {})}>"
    return SQL_TYPES.get(schema.get("type", ""), "variant")


def write_of(agent: Agent, rest: str | None = "_fields") -> Write:
    """The write settings of an agent; answers without JSON fill the field ``content``.

    Answer fields without a type and without a column in the target become entries of ``rest``.
    """
    properties = (agent.response_schema or {}).get("properties", {})
    types = {name: sql_type(below) for name, below in properties.items()}
    types.setdefault("content", "string")
    for source in agent.fields or {}:
        types.setdefault(source, "variant")
    return Write(
        types=types, strategy=agent.strategy, fields=agent.fields, path=agent.path,
        array_field=agent.array_field, target_field=agent.target_field,
        include_metadata=agent.include_metadata, metadata_field=agent.metadata_field, rest=rest)


def apply_agents(
    target: DataFrame, results: DataFrame, agents: list[Agent], id_col: str, database: str,
    collection: str, keep: tuple[str, ...] = (),
    order_by: tuple[str, ...] = ("completed_at", "started_at", "work_item_id"),
) -> DataFrame:
    """The target collection with the successful results of every agent that writes to it.

    Answers never set the id and the columns in ``keep``. Answers of one batch complete together;
    by default the order of their events decides between them.
    """
    writes = [(F.col("agent_id") == a.id, write_of(a)) for a in agents
              if a.enabled and a.target == (database, collection)]
    good = results.where(F.col("error_type").isNull()).withColumn(id_col, F.col("document_id"))
    return apply_writes(target, good, id_col, writes, order_by=order_by, keep=keep) if writes else target
