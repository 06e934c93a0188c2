"""Filter documents compiled to one Column on the driver.

Every clause yields true or false, never NULL, so negation is exact. A missing field and a null
field are the same thing. Booleans are not numbers here.
"""

from __future__ import annotations

import datetime as dt
import decimal
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from quillflow.functions.columns import let
from quillflow.functions.paths import Ref, resolve


class FilterError(ValueError):
    """The filter cannot be applied to documents of this schema."""


# Operators that are always refused.
REFUSED = ("$where", "$function", "$accumulator")

# Type names and codes, by kind.
TYPE_KINDS = {
    "double": "float", 1: "float",
    "string": "string", 2: "string",
    "object": "object", 3: "object",
    "array": "array", 4: "array",
    "bool": "bool", 8: "bool",
    "int": "int", 16: "int",
    "long": "int", 18: "int",
    "null": "null", 10: "null",
}

_ORDER = {
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
}


def _bool(value: bool) -> Column:
    return F.lit(bool(value))


def dtype_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(dtype, T.NullType):
        return "null"
    raise FilterError(f"type {dtype.simpleString()} cannot be filtered")


def value_kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (dt.datetime, dt.date)):
        return "time"
    if isinstance(value, (list, tuple)):
        return "array"
    raise FilterError(f"literal {value!r} is not supported in a filter")


def variant_kind(value: Column) -> Column:
    """Kind name of a variant: float, int, string, bool, object, array, time or null."""
    return let(F.schema_of_variant(value), lambda name: (
        F.when(name.isNull() | (name == "VOID"), "null")
        .when(name == "STRING", "string")
        .when(name == "BIGINT", "int")
        .when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "float")
        .when(name == "BOOLEAN", "bool")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .otherwise("time")))


def _comparable(ref: Ref, value: Any) -> Column | None:
    """The field as a column that may be compared with ``value``, or None when kinds differ."""
    kind = value_kind(value)
    if ref.is_variant:
        target = {"int": "decimal(38,9)", "float": "double", "string": "string",
                  "bool": "boolean", "time": "timestamp"}.get(kind)
        if target is None:
            raise FilterError("lists can be compared with typed fields only")
        wanted = ("int", "float") if kind in ("int", "float") else (kind,)
        if kind == "int":
            target = "double" if abs(value) < 2**53 else target
        return let(ref.column, lambda v: F.when(
            variant_kind(v).isin(*wanted), F.try_variant_get(v, "$", target)))
    have = dtype_kind(ref.dtype)
    numbers = ("int", "float")
    if have == kind or (have in numbers and kind in numbers):
        return ref.column
    if have == "time" and kind == "string":
        return ref.column
    return None


def _literal(ref: Ref, value: Any) -> Column:
    if not ref.is_variant and dtype_kind(ref.dtype) == "time":
        return F.lit(value).cast(ref.dtype)
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value]).cast(ref.dtype)
    return F.lit(value)


def _equal(ref: Ref, value: Any) -> Column:
    if value is None:
        return _bool(True) if ref.missing else ref.column.isNull()
    if ref.missing:
        return _bool(False)
    column = _comparable(ref, value)
    if column is None:
        return _bool(False)
    return column.eqNullSafe(_literal(ref, value))


def _ordered(ref: Ref, op: str, value: Any) -> Column:
    if ref.missing:
        return _bool(False)
    if value is None or isinstance(value, (list, tuple, bool)):
        raise FilterError(f"{op} needs a number, string or time, got {value!r}")
    column = _comparable(ref, value)
    if column is None:
        raise FilterError(f"{op} cannot compare {ref.dtype.simpleString()} with {value!r}")
    return F.coalesce(_ORDER[op](column, _literal(ref, value)), _bool(False))


def _member(ref: Ref, values: Any) -> Column:
    if not isinstance(values, (list, tuple)):
        raise FilterError("$in and $nin need a list")
    scalars = [v for v in values if v is not None and not isinstance(v, (list, tuple))]
    parts = [_equal(ref, v) for v in values if v is None or isinstance(v, (list, tuple))]
    by_kind: dict[str, list[Any]] = {}
    for value in scalars:
        kind = value_kind(value)
        by_kind.setdefault("number" if kind in ("int", "float") else kind, []).append(value)
    for group in by_kind.values():
        if ref.missing or ref.is_variant or dtype_kind(ref.dtype) == "time":
            parts.extend(_equal(ref, v) for v in group)
        elif (column := _comparable(ref, group[0])) is not None:
            parts.append(F.coalesce(column.isin(group), _bool(False)))
    found = _bool(False)
    for part in parts:
        found = found | part
    return found


def _has_type(ref: Ref, expected: Any) -> Column:
    if isinstance(expected, (list, dict)):
        raise FilterError("$type needs one name or code")
    kind = TYPE_KINDS.get(expected)
    if kind is None or isinstance(expected, bool):
        return _bool(False)
    if ref.missing:
        return _bool(kind == "null")
    if kind == "null":
        return ref.column.isNull()
    if ref.is_variant:
        return F.coalesce(variant_kind(ref.column) == kind, _bool(False))
    return ref.column.isNotNull() if dtype_kind(ref.dtype) == kind else _bool(False)


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """Python ``re`` meaning in Java: Unicode classes, ``\\n`` as the only line end."""
    return f"(?{'i' if ignore_case else ''}dU)" + pattern.replace("(?P<", "(?<")


def _matches(ref: Ref, expected: Any, options: str) -> Column:
    if isinstance(expected, dict):
        options = options + str(expected.get("$options", ""))
        expected = expected.get("$regex", "")
    if ref.missing:
        return _bool(False)
    if ref.is_variant:
        text = let(ref.column, lambda v: F.when(
            variant_kind(v).isin("string", "int"), F.try_variant_get(v, "$", "string")))
    elif dtype_kind(ref.dtype) in ("string", "int"):
        text = ref.column.cast("string")
    else:
        raise FilterError("$regex needs a string or integer field")
    return F.coalesce(text.rlike(java_regex(expected, "i" in options)), _bool(False))


def _field(ref: Ref, condition: Any, lenient: bool) -> Column:
    if not isinstance(condition, dict):
        return _equal(ref, condition)
    result = _bool(True)
    options = str(condition.get("$options", ""))
    for op, value in condition.items():
        if op in REFUSED:
            raise FilterError(f"operator {op} is not allowed")
        if op == "$options" and "$regex" in condition:
            continue
        if op == "$eq":
            clause = _equal(ref, value)
        elif op == "$ne":
            clause = ~_equal(ref, value)
        elif op in _ORDER:
            clause = _ordered(ref, op, value)
        elif op == "$in":
            clause = _member(ref, value)
        elif op == "$nin":
            clause = ~_member(ref, value)
        elif op == "$exists":
            present = _bool(False) if ref.missing else ref.column.isNotNull()
            clause = present == _bool(value)
        elif op == "$type":
            clause = _has_type(ref, value)
        elif op == "$regex":
            clause = _matches(ref, value, options)
        elif lenient:
            continue
        else:
            raise FilterError(f"unknown operator {op}")
        result = result & clause
    return result


def compile_filter(
    document: dict[str, Any],
    dtype: T.DataType,
    root: Column | None = None,
    lenient: bool = False,
) -> Column:
    """One true/false Column for a filter document over documents of type ``dtype``.

    Unknown operators are refused; ``lenient`` treats them as true instead.
    """
    result = _bool(True)
    for key, value in document.items():
        if key in REFUSED:
            raise FilterError(f"operator {key} is not allowed")
        if key in ("$and", "$or", "$nor"):
            clauses = [compile_filter(c, dtype, root, lenient) for c in value]
            if key == "$and":
                clause = _bool(True)
                for c in clauses:
                    clause = clause & c
            else:
                clause = _bool(False)
                for c in clauses:
                    clause = clause | c
                clause = ~clause if key == "$nor" else clause
        elif key == "$not":
            clause = ~compile_filter(value, dtype, root, lenient)
        elif key.startswith("$"):
            if not lenient:
                raise FilterError(f"unknown operator {key}")
            continue
        else:
            clause = _field(resolve(root, dtype, key), value, lenient)
        result = result & clause
    return result
