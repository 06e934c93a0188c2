"""Model answers: find the JSON in the text, check it against a schema, pick fields.

Answers become VARIANT values. All steps are column expressions.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from quillflow.functions.columns import computed, let, strip
from quillflow.functions.paths import _variant_steps, variant_path

# Where JSON is looked for in a text, in this order after the text itself.
FENCED_BLOCK = r"(?isU)```(?:json)?\s*\n?(.*?)\n?```"
FIRST_OBJECT = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
FIRST_ARRAY = r"\[[^\[\]]*+(?:\[[^\[\]]*+\][^\[\]]*+)*+\]"

STRATEGIES = ("whole", "fenced", "object", "array", "repaired")


# What every JSON value starts with.
JSON_START = r"^[ \t\n\r]*[\[{\"0-9tfn-]"


def exact_json(text: Column) -> Column:
    """The variant iff the text is exactly one JSON value; JSON null stays a variant null.

    The parser stops after the first value, so the text is tried as the only array element and
    as a field value: both succeed only when it is one value and nothing more. A text that can't
    start a value isn't tried, as a failed parse costs many times a good one.
    """
    elements = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(text.rlike(JSON_START) & (F.size(elements) == 1), F.try_variant_get(field, "$.v", "variant"))


def repair_text(text: Column) -> Column:
    """Drop trailing commas, quote bare keys, turn single quotes, cut to the outer brackets."""
    fixed = F.regexp_replace(text, r"(?U),\s*([}\]])", "$1")
    fixed = F.regexp_replace(fixed, r"(?U)(\{|,)\s*(\w+)\s*:", '$1 "$2":')
    fixed = F.replace(fixed, F.lit("'"), F.lit('"'))
    from_object = F.regexp_extract(fixed, r"(?s)\{.*\}", 0)
    from_array = F.regexp_extract(fixed, r"(?s)\[.*\]", 0)
    return F.when(from_object != "", from_object).otherwise(from_array)


# Candidate texts by strategy, in order.
_CANDIDATES = {
    "whole": lambda text: text,
    "fenced": lambda text: strip(F.regexp_extract(text, FENCED_BLOCK, 1)),
    "object": lambda text: F.regexp_extract(text, FIRST_OBJECT, 0),
    "array": lambda text: F.regexp_extract(text, FIRST_ARRAY, 0),
    "repaired": repair_text,
}


def _first_json(text: Column, at: int = 0) -> Column:
    """Struct of strategy and value of the first candidate that parses; later ones are not tried."""
    kind = "struct<strategy:string,value:variant>"
    if at == len(STRATEGIES):
        return F.lit(None).cast(kind)
    name = STRATEGIES[at]
    value = let(_CANDIDATES[name](text), exact_json)
    return let(value, lambda v: F.when(
        v.isNotNull(), F.struct(F.lit(name).alias("strategy"), v.alias("value")))
        .otherwise(_first_json(text, at + 1)))


def parse_answers(
    df: DataFrame, content: str, schema: dict[str, Any] | None = None, strict: bool = False
) -> DataFrame:
    """Add ``parsed`` (VARIANT), ``parse_strategy``, ``parse_error`` and ``schema_errors``.

    The first strategy that parses wins. Nothing found: ``{"content": .., "_raw": true}`` with
    strategy ``raw``, or an error when strict. A blank text is always an error. Schema errors
    drop the answer only when strict.
    """
    kept = df.columns
    found = let(strip(F.coalesce(F.col(content), F.lit(""))), lambda text: F.struct(
        text.alias("text"), _first_json(text).alias("hit")))
    out = df.select(*kept, computed(found).alias("_found"))
    text, hit = F.col("_found.text"), F.col("_found.hit")
    good = hit.isNotNull() & ~F.is_variant_null(hit["value"])
    raw = F.to_variant_object(F.struct(text.alias("content"), F.lit(True).alias("_raw")))
    fallback = F.lit(None).cast("variant") if strict else F.when(text != "", raw)
    strategy = F.when(good, hit["strategy"])
    message = F.when(text == "", "Empty response content")
    if strict:
        message = message.when(~good, "Could not extract JSON from response")
    else:
        strategy = strategy.when(text != "", "raw")
    out = out.select(
        *kept,
        F.when(good, hit["value"]).otherwise(fallback).alias("parsed"),
        strategy.alias("parse_strategy"),
        message.alias("parse_error"),
    )
    if not schema:
        return out.withColumn("schema_errors", F.array().cast("array<string>"))
    from_json = F.col("parse_strategy").isin(*STRATEGIES)
    out = out.withColumn("schema_errors", F.coalesce(
        F.when(from_json, let(F.col("parsed"), lambda v: schema_errors(v, schema))), F.array().cast("array<string>")))
    if strict:
        failed = F.size("schema_errors") > 0
        text = F.concat(F.lit("Schema validation failed: "), F.array_join("schema_errors", "; "))
        out = out.withColumn("parse_error", F.when(failed, text).otherwise(F.col("parse_error")))
        out = out.withColumn("parsed", F.when(~failed, F.col("parsed")))
    return out


def type_name(value: Column) -> Column:
    """Python type name of a variant, as error texts use it."""
    return let(F.schema_of_variant(value), lambda name: (
        F.when(name == "VOID", "NoneType")
        .when(name == "STRING", "str")
        .when(name == "BIGINT", "int")
        .when(name == "BOOLEAN", "bool")
        .when(name.startswith("OBJECT"), "dict")
        .when(name.startswith("ARRAY"), "list")
        .otherwise("float")))


# JSON schema types and the value types they accept.
SCHEMA_TYPES = {
    "string": ("str",), "number": ("int", "float"), "integer": ("int",), "boolean": ("bool",),
    "array": ("list",), "object": ("dict",), "null": ("NoneType",),
}


def _in_enum(value: Column, allowed: list[Any]) -> Column:
    kind = type_name(value)
    tests = [F.lit(False)]
    for item in allowed:
        if item is None:
            tests.append(kind == "NoneType")
        elif isinstance(item, bool):
            tests.append((kind == "bool") & (F.try_variant_get(value, "$", "boolean") == item))
        elif isinstance(item, (int, float)):
            same = F.try_variant_get(value, "$", "double") == float(item)
            tests.append(kind.isin("int", "float") & same)
        elif isinstance(item, str):
            tests.append((kind == "str") & (F.try_variant_get(value, "$", "string") == item))
        else:
            raise ValueError("enum values must be scalars")
    result = tests[0]
    for test in tests[1:]:
        result = result | F.coalesce(test, F.lit(False))
    return result


def _prefixed(prefix: Column, errors: Column) -> Column:
    return F.transform(errors, lambda e: F.concat(prefix, e))


def _below(prefix: str, schema: dict[str, Any]):
    return lambda v: _prefixed(F.lit(prefix), schema_errors(v, schema))


def schema_errors(value: Column, schema: dict[str, Any]) -> Column:
    """Array of error texts; a wrong type ends the check of that branch.

    Checked keywords: type, required, properties, items, enum. Others are ignored.
    """
    nothing = F.array().cast("array<string>")
    expected = schema.get("type")
    checks: list[Column] = []
    if expected == "object":
        for name in schema.get("required", []):
            absent = F.try_variant_get(value, variant_path([name]), "variant").isNull()
            checks.append(F.when(absent, F.array(F.lit(f"Missing required field: '{name}'"))))
        for name, below in schema.get("properties", {}).items():
            inner = F.try_variant_get(value, variant_path([name]), "variant")
            # One-element transform: the inner value is extracted once.
            checks.append(F.flatten(F.transform(
                F.filter(F.array(inner), lambda v: v.isNotNull()), _below(f"{name}.", below))))
    if expected == "array" and schema.get("items"):
        items = F.try_variant_get(value, "$", "array<variant>")
        checks.append(F.flatten(F.transform(items, lambda v, i: _prefixed(
            F.concat(F.lit("["), i.cast("string"), F.lit("].")),
            schema_errors(F.coalesce(v, F.parse_json(F.lit("null"))), schema["items"])))))
    if "enum" in schema:
        text = f"Value must be one of: {schema['enum']}"
        checks.append(F.when(~_in_enum(value, schema["enum"]), F.array(F.lit(text))))
    errors = F.concat(*[F.coalesce(c, nothing) for c in checks]) if checks else nothing
    if expected in SCHEMA_TYPES:
        name = type_name(value)
        wrong = F.concat(F.lit(f"Expected type '{expected}', got '"), name, F.lit("'"))
        errors = F.when(~name.isin(*SCHEMA_TYPES[expected]), F.array(wrong)).otherwise(errors)
    return errors


def pick_field(parsed: Column, path: str, kind: str = "string", default: Any = None) -> Column:
    """Value at a dot path (list indexes allowed), or the default when absent, null or no object."""
    value = let(parsed, lambda p: F.when(
        F.schema_of_variant(p).startswith("OBJECT"),
        F.try_variant_get(_variant_steps(p, path.split(".")), "$", kind)))
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))
