"""Change events joined with the agents that watch them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillflow.functions.filters import compile_filter
from quillflow.sources.catalog import Agent, catalog_frame, distinct_filters


def document_present(column: Column, dtype: T.DataType) -> Column:
    """Is there a document? Null and ``{}`` both count as none."""
    present = column.isNotNull()
    if isinstance(dtype, T.VariantType):
        entries = F.try_variant_get(column, "$", "map<string,variant>")
        present = present & ~F.is_variant_null(column) & F.coalesce(F.size(entries) > 0, F.lit(True))
    elif isinstance(dtype, T.MapType):
        present = present & (F.size(column) > 0)
    return F.coalesce(present, F.lit(False))


def filter_gate(
    agents: list[Agent], document: Column, dtype: T.DataType, lenient: bool = False
) -> Column:
    """Does the event pass the filter of its agent (``filter_id``)?

    Without a document a delete fails a filter and any other operation passes it.
    """
    passes = F.lit(True)
    for number, condition in reversed(list(enumerate(distinct_filters(agents)))):
        compiled = compile_filter(condition, dtype, document, lenient)
        passes = F.when(F.col("filter_id") == number, compiled).otherwise(passes)
    present = document_present(document, dtype)
    return (
        F.when(F.col("filter_id").isNull(), True)
        .when(present, passes)
        .otherwise(F.col("operation") != "delete")
    )


def match_agents(changes: DataFrame, agents: list[Agent], lenient: bool = False) -> DataFrame:
    """One row per (event, enabled agent that accepts it).

    The catalog is joined on the namespace; the operation list and the filter of the matched
    agent are residual conditions of that join, so an event is read once however many agents
    there are. ``changes`` needs database, collection, operation and full_document.
    """
    active = [a for a in agents if a.enabled]
    catalog = catalog_frame(changes.sparkSession, active).drop("enabled")
    dtype = changes.schema["full_document"].dataType
    joined = changes.join(
        catalog,
        (F.col("database") == F.col("watch_database"))
        & (F.col("collection") == F.col("watch_collection"))
        & F.array_contains(F.col("operations"), F.col("operation")),
    )
    kept = joined.where(filter_gate(active, F.col("full_document"), dtype, lenient))
    return kept.drop("watch_database", "watch_collection", "operations", "filter_id")


def _below(name: str, paths: list[str]) -> list[str]:
    return [p[len(name) + 1:] for p in paths if p.startswith(name + ".")]


def projected_type(dtype: T.DataType, keep: list[str]) -> T.DataType:
    """Type of a document after ``project_fields``."""
    if not isinstance(dtype, T.StructType):
        return dtype
    fields = []
    for f in dtype.fields:
        below = _below(f.name, keep)
        if f.name in keep:
            fields.append(f)
        elif below and isinstance(f.dataType, T.StructType):
            fields.append(T.StructField(f.name, projected_type(f.dataType, below), f.nullable))
    return T.StructType(fields)


def project_fields(document: Column, dtype: T.DataType, keep: list[str]) -> Column:
    """Only the watched top-level or dotted fields of a document struct or VARIANT object.

    A VARIANT that is no object has no fields and becomes null.
    """
    if isinstance(dtype, T.VariantType):
        return _project_variant(document, keep)

    def pick(column: Column, struct: T.StructType, paths: list[str]) -> Column:
        chosen = []
        for f in struct.fields:
            if f.name in paths:
                chosen.append(column.getField(f.name).alias(f.name))
                continue
            below = _below(f.name, paths)
            if below and isinstance(f.dataType, T.StructType):
                chosen.append(pick(column.getField(f.name), f.dataType, below).alias(f.name))
        return F.when(column.isNotNull(), F.struct(*chosen))

    return pick(document, dtype, keep)


def _project_variant(value: Column, paths: list[str]) -> Column:
    names = sorted({p.split(".")[0] for p in paths})
    deep = {n: _below(n, paths) for n in names if n not in paths}

    def inner(key: Column, entry: Column) -> Column:
        out = entry
        for name, below in deep.items():
            out = F.when(key == name, _project_variant(entry, below)).otherwise(out)
        return out

    entries = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, _: k.isin(names))
    kept = F.map_filter(F.transform_values(entries, inner), lambda _, v: v.isNotNull()) if deep else entries
    return F.to_variant_object(kept)


def resolve_agents(items: DataFrame, agents: list[Agent]) -> DataFrame:
    """Attach each item's agent; ``outcome`` says ready, agent_not_found or agent_disabled.

    The two failures are final: they are never retried.
    """
    catalog = catalog_frame(items.sparkSession, agents).select(
        F.col("agent_id").alias("_id"), F.col("enabled").alias("_enabled"))
    joined = items.join(catalog, F.col("agent_id") == F.col("_id"), "left")
    outcome = (
        F.when(F.col("_id").isNull(), "agent_not_found")
        .when(~F.col("_enabled"), "agent_disabled")
        .otherwise("ready")
    )
    return joined.withColumn("outcome", outcome).drop("_id", "_enabled")
