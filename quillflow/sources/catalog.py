"""Agent catalog: configuration records read on the driver, plus a small frame for joins.

The catalog is configuration, not data. It decides the shape of the plan (filters and templates
become Columns) and is joined as a small table.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

OPERATIONS = ("insert", "update", "replace", "delete")
STRATEGIES = ("merge", "replace", "append", "nested")


class CatalogError(ValueError):
    """A configuration record is not usable."""


@dataclass(frozen=True)
class Agent:
    """One enrichment rule: what to watch, what to ask, how to write the answer."""

    # The defaults of the settings.
    id: str
    database: str
    collection: str
    prompt: str
    name: str = ""
    description: str = ""
    operations: tuple[str, ...] = ("insert", "update")
    filter: dict[str, Any] | None = None
    projection: tuple[str, ...] | None = None
    provider: str = "openai"
    model: str = "gpt-4o-mini"
    system_prompt: str | None = None
    temperature: float = 0.7
    max_tokens: int = 2048
    response_schema: dict[str, Any] | None = None
    response_format: str | None = None
    extra_params: dict[str, Any] = field(default_factory=dict)
    strategy: str = "merge"
    target_database: str | None = None
    target_collection: str | None = None
    target_field: str | None = None
    fields: dict[str, str] | None = None
    path: str | None = None
    array_field: str | None = None
    idempotency_key: str | None = None
    include_metadata: bool = True
    metadata_field: str = "_ai_metadata"
    max_retries: int = 3
    retry_delay_seconds: float = 1.0
    retry_max_delay_seconds: float = 60.0
    timeout_seconds: float = 60.0
    rate_limit_requests: int | None = None
    cost_limit_usd: float | None = None
    token_limit: int | None = None
    priority: int = 0
    deduplicate: bool = True
    deduplicate_window_seconds: int = 300
    enabled: bool = True
    tags: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        bad = [op for op in self.operations if op not in OPERATIONS]
        checks = {
            "id needs 1 to 64 characters": not 1 <= len(self.id) <= 64,
            f"unknown operations {bad}": bool(bad),
            f"unknown strategy {self.strategy}": self.strategy not in STRATEGIES,
            "temperature must lie in 0..2": not 0 <= self.temperature <= 2,
            "max_tokens must be at least 1": self.max_tokens < 1,
            "max_retries must not be negative": self.max_retries < 0,
            "priority must lie in 0..10": not 0 <= self.priority <= 10,
            "delays and timeout must be positive": min(
                self.retry_delay_seconds, self.retry_max_delay_seconds, self.timeout_seconds) <= 0,
            "append needs array_field": self.strategy == "append" and not self.array_field,
            "nested needs path": self.strategy == "nested" and not self.path,
        }
        for message, failed in checks.items():
            if failed:
                raise CatalogError(f"agent {self.id!r}: {message}")

    @property
    def target(self) -> tuple[str, str]:
        return self.target_database or self.database, self.target_collection or self.collection

    @property
    def max_attempts(self) -> int:
        return self.max_retries + 1


def agent_from_dict(record: dict[str, Any]) -> Agent:
    """A nested record (watch / ai / write / execution sections) as an ``Agent``."""
    known = set(Agent.__dataclass_fields__)
    flat: dict[str, Any] = {}
    for key, value in record.items():
        section = value if key in ("watch", "ai", "write", "execution") else {key: value}
        flat.update({k: v for k, v in section.items() if k in known})
    for key in ("operations", "projection", "tags"):
        if isinstance(flat.get(key), list):
            flat[key] = tuple(flat[key])
    missing = [k for k in ("id", "database", "collection", "prompt") if k not in flat]
    if missing:
        raise CatalogError(f"missing {', '.join(missing)}")
    return Agent(**flat)


def load_agent_text(text: str, kind: str = ".yaml") -> Agent:
    if kind.lower() == ".json":
        record = json.loads(text)
    else:
        import yaml

        record = yaml.safe_load(text)
    if not isinstance(record, dict):
        raise CatalogError("an agent must be a mapping")
    return agent_from_dict(record)


def load_agents(path: str, recursive: bool = False) -> list[Agent]:
    """All agents of a YAML or JSON file, or of a folder of such files."""
    if os.path.isfile(path):
        files = [path]
    else:
        files = []
        for folder, _, names in os.walk(path):
            files += [os.path.join(folder, n) for n in names
                      if n.endswith((".yaml", ".yml", ".json"))]
            if not recursive:
                break
    agents = []
    for name in sorted(files):
        with open(name, encoding="utf-8") as handle:
            agents.append(load_agent_text(handle.read(), os.path.splitext(name)[1]))
    return agents


CATALOG_SCHEMA = T.StructType([
    T.StructField("agent_id", T.StringType(), False),
    T.StructField("watch_database", T.StringType(), False),
    T.StructField("watch_collection", T.StringType(), False),
    T.StructField("operations", T.ArrayType(T.StringType()), False),
    T.StructField("filter_id", T.IntegerType()),
    T.StructField("enabled", T.BooleanType(), False),
    T.StructField("deduplicate", T.BooleanType(), False),
    T.StructField("priority", T.IntegerType(), False),
    T.StructField("max_attempts", T.IntegerType(), False),
    T.StructField("retry_delay_seconds", T.DoubleType(), False),
    T.StructField("retry_max_delay_seconds", T.DoubleType(), False),
    T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("max_tokens", T.IntegerType()),
    T.StructField("timeout_seconds", T.DoubleType()),
    T.StructField("response_format", T.StringType()),
    T.StructField("extra_params", T.StringType()),
    T.StructField("target_database", T.StringType()),
    T.StructField("target_collection", T.StringType()),
])

# A catalog frame is hinted for broadcast only below this size.
BROADCAST_BYTES = 8 << 20


def distinct_filters(agents: list[Agent]) -> list[dict[str, Any]]:
    """Each different filter once, so the compiled predicate does not grow with copies."""
    texts: dict[str, dict[str, Any]] = {}
    for agent in agents:
        if agent.filter:
            texts.setdefault(json.dumps(agent.filter, sort_keys=True, default=str), agent.filter)
    return list(texts.values())


def catalog_frame(spark: SparkSession, agents: list[Agent]) -> DataFrame:
    """The columns of the catalog that joins need, hinted for broadcast when provably small."""
    filters = [json.dumps(f, sort_keys=True, default=str) for f in distinct_filters(agents)]
    rows = []
    for a in agents:
        key = json.dumps(a.filter, sort_keys=True, default=str) if a.filter else None
        rows.append((
            a.id, a.database, a.collection, list(a.operations),
            filters.index(key) if key is not None else None,
            a.enabled, a.deduplicate, a.priority, a.max_attempts,
            float(a.retry_delay_seconds), float(a.retry_max_delay_seconds),
            a.provider, a.model, float(a.temperature), a.max_tokens, float(a.timeout_seconds),
            a.response_format, json.dumps(a.extra_params, sort_keys=True) if a.extra_params else None,
            *a.target,
        ))
    if len({r[0] for r in rows}) != len(rows):
        raise CatalogError("agent ids must be unique")
    frame = spark.createDataFrame(rows, CATALOG_SCHEMA)
    size = sum(len(repr(r)) for r in rows) * 4
    return F.broadcast(frame) if size <= BROADCAST_BYTES else frame
