"""Keys, routes, provider names and retry columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Top-level fields that do not count towards a document's identity.
VOLATILE_PREFIXES = ("_ai_", "updated_at", "modified_at")


def _sorted_value(column: Column, dtype: T.DataType) -> Column:
    """The value with the fields of every struct in name order."""
    if isinstance(dtype, T.StructType):
        fields = [
            _sorted_value(column.getField(f.name), f.dataType).alias(f.name)
            for f in sorted(dtype.fields, key=lambda f: f.name)
        ]
        return F.when(column.isNotNull(), F.struct(*fields)) if fields else column
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return F.transform(column, lambda x: _sorted_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(column)))
    return column


def _starts_with_any(name: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | name.startswith(prefix)
    return found


def canonical_json(
    document: Column, dtype: T.DataType, volatile: tuple[str, ...] = VOLATILE_PREFIXES
) -> Column:
    """JSON text of a document with sorted keys and without volatile top-level fields."""
    def kept(name: str) -> bool:
        return not name.startswith(volatile) if volatile else True

    options = {"ignoreNullFields": "false"}
    if isinstance(dtype, T.StructType):
        fields = [
            _sorted_value(document.getField(f.name), f.dataType).alias(f.name)
            for f in sorted(dtype.fields, key=lambda f: f.name) if kept(f.name)
        ]
        text = F.to_json(F.struct(*fields), options) if fields else F.lit("{}")
        return F.coalesce(F.when(document.isNotNull(), text), F.lit("{}"))
    if isinstance(dtype, T.VariantType):
        entries = F.try_variant_get(document, "$", "map<string,variant>")
    else:
        entries = document
    if volatile:
        entries = F.map_filter(entries, lambda k, _: ~_starts_with_any(k, volatile))
    names = F.array_sort(F.map_keys(entries))
    parts = F.transform(names, lambda k: F.concat(
        F.to_json(k.cast("variant")), F.lit(":"), F.to_json(F.element_at(entries, k))))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")), F.lit("{}"))


def document_hash(
    document: Column, dtype: T.DataType, digits: int = 12,
    volatile: tuple[str, ...] = VOLATILE_PREFIXES,
) -> Column:
    """First hex digits of the md5 of the document's canonical text."""
    return F.substring(F.md5(canonical_json(document, dtype, volatile)), 1, digits)


def default_key(
    agent_id: Column, document_id: Column, document: Column, dtype: T.DataType,
    volatile: tuple[str, ...] = VOLATILE_PREFIXES,
) -> Column:
    """``agent:document:hash`` with 12 digits, ignoring volatile fields."""
    return composite_key(agent_id, document_id, document_hash(document, dtype, 12, volatile))


def dispatch_key(
    agent_id: Column, document_id: Column, document: Column, dtype: T.DataType
) -> Column:
    """``agent:document:hash`` with 8 digits over the whole document."""
    return composite_key(agent_id, document_id, document_hash(document, dtype, 8, ()))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def hashed_key(key: Column) -> Column:
    """First 32 hex digits of the key's sha-256."""
    return F.substring(F.sha2(key, 256), 1, 32)


def request_key(
    model: Column, prompt: Column, system_prompt: Column, temperature: Column,
    **extra: Column,
) -> Column:
    """Cache key of a model request; NULL (never shared) when the temperature is above 0."""
    parts = {"model": model, "prompt": prompt, "system_prompt": system_prompt,
             "temperature": temperature}
    parts |= {k: v for k, v in extra.items() if k != "api_key"}
    text = F.to_json(
        F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"})
    return F.when(~(temperature > 0), F.sha2(text, 256))


ROUTE_STRATEGIES = ("by_agent", "by_collection", "single", "partitioned", "by_priority")


def hash_partition(document_id: Column, partitions: int = 8) -> Column:
    """md5 of the id, as a big number, modulo ``partitions``; an empty id gives 0."""
    # Powers of two only need the low digits; other counts fold the digits four at a time.
    digest = F.md5(document_id)
    if partitions & (partitions - 1) == 0 and partitions <= 1 << 28:
        number = F.conv(F.substring(digest, 26, 7), 16, 10).cast("long") % partitions
    else:
        number = F.lit(0).cast("long")
        for start in range(1, 33, 4):
            part = F.conv(F.substring(digest, start, 4), 16, 10).cast("long")
            number = (number * 65536 + part) % partitions
    return F.when(F.coalesce(document_id, F.lit("")) == "", 0).otherwise(number).cast("int")


def route_name(strategy: str, prefix: str = "work", partitions: int = 8) -> Column:
    """Route of a work item from its agent_id, database, collection, document_id, priority."""
    def named(*parts: Column | str) -> Column:
        return F.concat(F.lit(f"{prefix}:"), *[F.lit(p) if isinstance(p, str) else p for p in parts])

    if strategy == "by_agent":
        return named("agent:", F.col("agent_id"))
    if strategy == "by_collection":
        return named("collection:", F.col("database"), ":", F.col("collection"))
    if strategy == "partitioned":
        return named("partition:", hash_partition(F.col("document_id"), partitions).cast("string"))
    if strategy == "by_priority":
        return named("priority:", F.col("priority").cast("string"))
    return F.lit(f"{prefix}:work")


def dead_letter_route(agent_id: Column | None = None, prefix: str = "work") -> Column:
    """Route for dead letters: per agent when one is known, else the global one."""
    everyone = F.lit(f"{prefix}:dlq")
    if agent_id is None:
        return everyone
    return F.when(agent_id.isNotNull(), F.concat(F.lit(f"{prefix}:dlq:agent:"), agent_id)).otherwise(
        everyone)


# Provider of a model name by its prefix, first match wins.
PROVIDER_PREFIXES = (
    (("gpt-", "o1", "o3"), "openai"),
    (("claude",), "anthropic"),
    (("gemini",), "google"),
    (("llama", "mixtral"), "groq"),
    (("mistral",), "mistral"),
    (("command",), "cohere"),
)


def provider_of_model(model: Column) -> Column:
    """Text before a slash, else by prefix, else ``unknown``."""
    result = F.when(model.contains("/"), F.substring_index(model, "/", 1))
    lowered = F.lower(model)
    for prefixes, provider in PROVIDER_PREFIXES:
        test = lowered.startswith(prefixes[0])
        for prefix in prefixes[1:]:
            test = test | lowered.startswith(prefix)
        result = result.when(test, provider)
    return result.otherwise("unknown")


def retry_delay(
    attempt: Column, base: Column | float = 1.0, limit: Column | float = 60.0,
    factor: float = 2.0, jitter: Column | None = None,
) -> Column:
    """Seconds before retry number ``attempt`` (1-based): ``min(base * factor^(attempt-1), limit)``.

    ``jitter`` is a column in 0..1; it adds up to half of the delay.
    """
    base = F.lit(base) if not isinstance(base, Column) else base
    limit = F.lit(limit) if not isinstance(limit, Column) else limit
    delay = F.least(base * F.pow(F.lit(factor), attempt - 1), limit)
    return delay if jitter is None else delay * (1 + jitter * 0.5)


def stable_fraction(*parts: Column) -> Column:
    """A fraction in 0..1 that depends on the row only, so a rerun task repeats it."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 20)) / float(1 << 20)


# Error types worth another try.
RETRYABLE = ("ConnectionError", "TimeoutError", "AIRateLimitError")


def retryable(
    error_type: Column, attempt: Column, max_attempts: Column,
    allow: tuple[str, ...] | None = RETRYABLE, refuse: tuple[str, ...] = (),
) -> Column:
    """Attempts left, type not refused, and type allowed (any type when ``allow`` is empty)."""
    decision = attempt < max_attempts
    if refuse:
        decision = decision & ~error_type.isin(*refuse)
    if allow:
        decision = decision & error_type.isin(*allow)
    return F.coalesce(decision, F.lit(False))
