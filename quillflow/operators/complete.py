"""Prompts for work items, the model call-out, and the response cache."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillflow.functions.keys import provider_of_model, request_key
from quillflow.functions.paths import Ref
from quillflow.functions.templates import Context, Rendered, compile_template, constant
from quillflow.functions.text import Filter
from quillflow.operators.cache import live_cache
from quillflow.operators.match import project_fields, projected_type
from quillflow.sources.catalog import Agent

Client = Callable[[list[dict[str, Any]]], list[dict[str, Any]]]

EVENT_FIELDS = ("operation", "database", "collection", "document_id", "namespace", "ts")


def item_context(items: DataFrame, agent: Agent, as_of: str | None = None,
                 extra: dict[str, Any] | None = None) -> Context:
    """Template variables of a work item: document, event, operation, agent, now, extras.

    An agent with a projection sees only those fields of the document.
    """
    column, dtype = F.col("full_document"), items.schema["full_document"].dataType
    if agent.projection:
        keep = list(agent.projection)
        column, dtype = project_fields(column, dtype, keep), projected_type(dtype, keep)
    document = Ref(column, dtype)
    present = [c for c in EVENT_FIELDS if c in items.columns]
    event = T.StructType([items.schema[c] for c in present])
    context: Context = {
        "document": document,
        "doc": document,
        "event": Ref(F.struct(*present), event),
        "operation": Ref(F.col("operation"), T.StringType()),
        "agent_id": Ref(F.col("agent_id"), T.StringType()),
    }
    if any("agent" in t for t in (agent.prompt, agent.system_prompt, agent.idempotency_key) if t):
        settings = {k: v for k, v in vars(agent).items() if isinstance(v, (str, int, float, bool))}
        context["agent"] = constant(settings)
    for name in ("document_id", "database", "collection"):
        context[name] = Ref(F.col(name), T.StringType())
    if as_of is not None:
        now = F.lit(as_of).cast("timestamp")
        context["now"] = context["timestamp"] = Ref(now, T.TimestampType())
    for name, value in (extra or {}).items():
        context[name] = constant(value)
    return context


def _by_agent(agents: list[Agent], make: Callable[[Agent], Column | None], kind: str) -> Column:
    result = F.lit(None).cast(kind)
    for agent in reversed(agents):
        value = make(agent)
        if value is not None:
            result = F.when(F.col("agent_id") == agent.id, value).otherwise(result)
    return result


def render_prompts(
    items: DataFrame, agents: list[Agent], as_of: str | None = None,
    extra: dict[str, Any] | None = None, filters: dict[str, Filter] | None = None,
) -> DataFrame:
    """Add prompt, system_prompt and render_error; a prompt with an error is NULL.

    ``filters`` adds template filters by name, each a function of a ``Ref``.
    """
    rendered: dict[tuple[str, str], Rendered] = {}
    for agent in agents:
        context = item_context(items, agent, as_of, extra)
        rendered[agent.id, "prompt"] = compile_template(agent.prompt, context, filters)
        if agent.system_prompt:
            rendered[agent.id, "system"] = compile_template(agent.system_prompt, context, filters)

    def part(kind: str, field: str) -> Column:
        return _by_agent(agents, lambda a: getattr(rendered.get((a.id, kind)), field, None), "string")

    return (
        items.withColumn("prompt", part("prompt", "text"))
        .withColumn("system_prompt", part("system", "text"))
        .withColumn("render_error", F.coalesce(part("prompt", "error"), part("system", "error")))
    )


def template_key(items: DataFrame, agents: list[Agent], fallback: Column) -> Column:
    """Idempotency key of each item: its agent's template, or ``fallback`` on any error."""
    def make(agent: Agent) -> Column | None:
        if not agent.idempotency_key:
            return None
        return compile_template(agent.idempotency_key, item_context(items, agent)).text

    return F.coalesce(_by_agent(agents, make, "string"), fallback)


def chat_messages(prompt: Column, system_prompt: Column) -> Column:
    """Messages of a request: the system text when there is one, then the user text."""
    system = F.struct(F.lit("system").alias("role"), system_prompt.alias("content"))
    user = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.filter(F.array(system, user),
                    lambda m: (m["role"] == "user") | (F.coalesce(m["content"], F.lit("")) != ""))


ANSWER_SCHEMA = T.StructType([
    T.StructField("call_key", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("cost_usd", T.DoubleType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("finish_reason", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("error_type", T.StringType()),
])

REQUEST_FIELDS = ("model", "prompt", "system_prompt", "temperature", "max_tokens")
# Fields that a request may have besides; the first two are part of what is asked.
ASKED_FIELDS, OPTIONAL_FIELDS = ("response_format", "extra_params"), ("response_format", "extra_params", "timeout_seconds")


def call_model(calls: DataFrame, make_client: Callable[[], Client], batch: int = 10,
               overlap: int = 1) -> DataFrame:
    """Send each row of ``calls`` once. A failed call becomes an error row, not a failed task.

    The client gets up to ``batch`` requests at a time, and each task has up to ``overlap`` such calls
    under way, each with a client of its own. With a column ``timeout_seconds`` a call may take
    as long as the most patient of its requests allows; a late one gives TimeoutError rows,
    and its client, which may still be busy, is left to itself.
    """

    def one(client: Client, requests: list[dict[str, Any]]) -> list[dict[str, Any]]:
        try:
            answers = client(requests)
            if len(answers) != len(requests):
                raise ValueError("the client must return one answer per request")
            return answers
        except Exception as error:  # noqa: BLE001 - any client error belongs to its rows
            if len(requests) > 1:
                return [a for r in requests for a in one(client, [r])]
            return [{"error": str(error), "error_type": type(error).__name__}]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = threading.local()
        callers: list[_Caller] = []

        def send(requests: list[dict[str, Any]]) -> list[dict[str, Any]]:
            if getattr(own, "client", None) is None:
                own.client, own.caller = make_client(), None
            limits = [r["timeout_seconds"] for r in requests if r.get("timeout_seconds")]
            if len(limits) < len(requests):
                return one(own.client, requests)
            if own.caller is None:
                own.caller = _Caller(partial(one, own.client))
                callers.append(own.caller)
            try:
                return own.caller.send(requests, max(limits))
            except queue.Empty:
                own.client = None
                return [{"error": f"no answer within {r['timeout_seconds']:g} s", "error_type": "TimeoutError"}
                        for r in requests]

        with ThreadPoolExecutor(overlap) as pool:
            for frame in batches:
                keys = frame.pop("call_key").tolist()
                columns = [[None if v is None or v != v else v for v in frame[c].tolist()]
                           for c in frame.columns]
                requests = [dict(zip(frame.columns, values, strict=True))
                            for values in zip(*columns, strict=True)]
                chunks = [requests[start:start + batch] for start in range(0, len(keys), batch)]
                answers = [a for some in pool.map(send, chunks) for a in some]
                yield _answer_frame(keys, answers)
        for caller in callers:
            caller.asked.put(None)

    return calls.mapInPandas(run, ANSWER_SCHEMA)


class _Caller:
    """A thread that makes the calls of one client in turn, so that a late one can be left behind."""

    def __init__(self, call: Callable[[list[dict[str, Any]]], list[dict[str, Any]]]) -> None:
        self.asked: queue.SimpleQueue = queue.SimpleQueue()
        self.done: queue.SimpleQueue = queue.SimpleQueue()
        threading.Thread(target=self._run, args=(call,), daemon=True).start()

    def _run(self, call: Callable[[list[dict[str, Any]]], list[dict[str, Any]]]) -> None:
        while (requests := self.asked.get()) is not None:
            self.done.put(call(requests))

    def send(self, requests: list[dict[str, Any]], seconds: float) -> list[dict[str, Any]]:
        self.asked.put(requests)
        return self.done.get(timeout=seconds)


def _answer_frame(keys: list[str], answers: list[dict[str, Any]]) -> pd.DataFrame:
    out = {name: [a.get(name) for a in answers] for name in ANSWER_SCHEMA.names}
    out["call_key"] = keys
    good = [kind is None for kind in out["error_type"]]
    out["content"] = [(c or "") if ok else c for c, ok in zip(out["content"], good, strict=True)]
    spent = zip(out["total_tokens"], out["prompt_tokens"], out["completion_tokens"], strict=True)
    out["total_tokens"] = [t or (p or 0) + (c or 0) for t, p, c in spent]
    out["cost_usd"] = [c or 0.0 for c in out["cost_usd"]]
    return pd.DataFrame(out, dtype=object)


def with_call_key(requests: DataFrame, row_id: str = "work_item_id") -> DataFrame:
    """Equal deterministic requests share a key; a request with temperature keeps its own."""
    shared = request_key(F.col("model"), F.col("prompt"), F.col("system_prompt"),
                         F.col("temperature"), max_tokens=F.col("max_tokens"),
                         **{c: F.col(c) for c in ASKED_FIELDS if c in requests.columns})
    alone = F.concat(F.lit("once:"), F.col(row_id).cast("string"))
    return requests.withColumn("call_key", F.coalesce(shared, alone))


def lookup_cache(
    requests: DataFrame, cache: DataFrame, as_of: Column, ttl_seconds: int = 3600,
    key: str = "request_key",
) -> DataFrame:
    """Left join with the response cache; ``cache_hit`` needs a key and an age within the ttl.

    The cache holds one row per key. A hot key on the request side is split by the adaptive
    skew join, as both inputs of the join are plain shuffles.
    """
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.col("cached_at"))
    fresh = cache.where(age <= ttl_seconds)
    return requests.join(fresh, key, "left").withColumn("cache_hit", F.col("cached_at").isNotNull())


def complete(
    requests: DataFrame, make_client: Callable[[], Client], row_id: str = "work_item_id",
    tasks: int | None = None, batch: int = 10, overlap: int = 1, cache: DataFrame | None = None,
    save: Callable[[DataFrame], DataFrame] | None = None, as_of: Column | None = None,
    ttl_seconds: int = 3600,
) -> DataFrame:
    """Answer every request row, sending each distinct request once.

    ``tasks`` is the number of tasks that call (default: one per core), ``overlap`` the calls that each has
    under way. ``cache`` (call_key and the answer columns) answers known requests without a call; with
    ``as_of`` only entries within the ttl do. ``save`` stores the answers of this call (a written
    table or a checkpoint) and returns the stored frame, so that a lost executor does not repeat
    paid calls further down the plan.
    """
    keyed = with_call_key(requests, row_id)
    if cache is not None and as_of is not None:
        cache = live_cache(cache, as_of, ttl_seconds)
    wanted = (
        keyed.where(F.col("prompt").isNotNull())
        .groupBy("call_key").agg(
            *[F.first(c).alias(c) for c in REQUEST_FIELDS],
            *[F.max(c).alias(c) for c in OPTIONAL_FIELDS if c in keyed.columns])
    )
    if cache is not None:
        wanted = wanted.join(cache.select("call_key"), "call_key", "left_anti")
    # Few bytes can be many slow calls, so partitions are not merged by their size here.
    wanted = wanted.repartition(
        tasks or requests.sparkSession.sparkContext.defaultParallelism, "call_key")
    answers = call_model(wanted, make_client, batch, overlap)
    if save is not None:
        answers = save(answers)
    if cache is not None:
        known = cache.select([F.col(f.name).cast(f.dataType).alias(f.name)
                              if f.name in cache.columns
                              else F.lit(None).cast(f.dataType).alias(f.name)
                              for f in ANSWER_SCHEMA.fields])
        answers = answers.unionByName(known)
    return keyed.join(answers, "call_key", "left").withColumn(
        "provider", provider_of_model(F.col("model")))
