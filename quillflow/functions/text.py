"""Template filters as Column functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from quillflow.functions.columns import strip
from quillflow.functions.paths import Ref, resolve

# Strftime directives and their Spark date patterns.
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%p": "a", "%j": "DDD", "%a": "EEE", "%A": "EEEE",
    "%b": "MMM", "%B": "MMMM",
}


def text_of(ref: Ref) -> Column:
    """``str(value)``: numbers as written, True/False, ISO times, JSON for nested values."""
    column, dtype = ref.column, ref.dtype
    if isinstance(dtype, T.BooleanType):
        return F.initcap(column.cast("string"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        micro = F.date_format(column, "SSSSSS")
        return F.when(micro == "000000", whole).otherwise(F.concat(whole, F.lit("."), micro))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column, {"ignoreNullFields": "false"})
    if isinstance(dtype, T.VariantType):
        return F.coalesce(F.try_variant_get(column, "$", "string"), F.to_json(column))
    return column.cast("string")


def json_text(ref: Ref) -> Column:
    if isinstance(ref.dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(ref.column, {"ignoreNullFields": "false"})
    if isinstance(ref.dtype, T.VariantType):
        return F.to_json(ref.column)
    # A scalar is written as the only field of an object, then unwrapped.
    wrapped = F.to_json(F.struct(ref.column.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, 6, 2147483647).substr(F.lit(1), F.length(wrapped) - 6)


# Up to this many words are cut out by one pattern that reads no further into the text.
_PATTERN_WORDS = 200


def truncate_words(text: Column, count: int, suffix: str = "...") -> Column:
    """The first ``count`` words and the suffix; a text with no more words is unchanged."""
    if 1 <= count <= _PATTERN_WORDS:
        head = rf"(?U)\A\s*+((?:\S++\s++){{{count - 1}}}\S++)"
        more = text.rlike(rf"(?U)\A\s*+(?:\S++\s++){{{count}}}\S")
        words = F.split(F.regexp_extract(text, head, 1), r"(?U)\s+")
    else:
        words = F.split(strip(text), r"(?U)\s+")
        more = (F.size(words) > count) & (strip(text) != "")
        words = F.slice(words, 1, max(count, 0))
    short = F.concat(F.array_join(words, " "), F.lit(suffix))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(more, short).otherwise(text)


def truncate(text: Column, length: int = 255, end: str = "...", leeway: int = 5) -> Column:
    """Unchanged up to ``length + leeway``, else cut at a space within ``length`` plus ``end``."""
    cut = F.substring(text, 1, length - len(end))
    kept = F.regexp_replace(cut, r"(?s)^(.*) [^ ]*$", "$1")
    return F.when(F.length(text) <= length + leeway, text).otherwise(F.concat(kept, F.lit(end)))


def default_if_none(value: Column, default: Any = "") -> Column:
    return F.coalesce(value, F.lit(default))


def format_date(ref: Ref, fmt: str = "%Y-%m-%d") -> Column:
    """Format a time; text is read as ISO and returned unchanged when it is not."""
    pattern = ""
    for directive, literal in re.findall(r"(%.?)|([^%]+)", fmt):
        if literal or directive == "%%":
            pattern += "'" + (literal or "%").replace("'", "''") + "'"
        elif directive in STRFTIME:
            pattern += STRFTIME[directive]
        else:
            raise ValueError(f"date directive {directive} is not supported")
    column = ref.column
    if isinstance(ref.dtype, T.StringType):
        time = F.try_to_timestamp(column)
        return F.coalesce(F.date_format(time, pattern), column, F.lit(""))
    if isinstance(ref.dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.coalesce(F.date_format(column, pattern), F.lit(""))
    return F.coalesce(text_of(ref), F.lit(""))


def list_to_text(items: Column, separator: str = ", ", last_separator: str | None = None) -> Column:
    joined = F.array_join(items, separator, "None")
    if last_separator:
        size = F.size(items)
        head = F.array_join(F.slice(items, F.lit(1), F.greatest(size - 1, F.lit(0))), separator, "None")
        tail = F.coalesce(F.get(items, size - 1), F.lit("None"))
        joined = F.when(size > 1, F.concat(head, F.lit(last_separator), tail)).otherwise(joined)
    return F.coalesce(joined, F.lit(""))


# Fixed value: longest text a sanitized field may keep.
SANITIZE_LENGTH = 10000


def sanitize(text: Column) -> Column:
    opened = F.replace(F.replace(text, F.lit("{{"), F.lit("{ {")), F.lit("}}"), F.lit("} }"))
    return F.coalesce(F.substring(opened, 1, SANITIZE_LENGTH), F.lit(""))


def first_n(ref: Ref, count: int) -> Ref:
    if isinstance(ref.dtype, T.ArrayType):
        return Ref(F.slice(ref.column, 1, count), ref.dtype)
    return Ref(F.substring(text_of(ref), 1, count), T.StringType())


def keys_of(ref: Ref) -> Ref:
    kind = T.ArrayType(T.StringType())
    if isinstance(ref.dtype, T.StructType):
        names = F.array(*[F.lit(n) for n in ref.dtype.names])
        return Ref(F.when(ref.column.isNotNull(), names).otherwise(F.array().cast(kind)), kind)
    if isinstance(ref.dtype, T.MapType):
        return Ref(F.coalesce(F.map_keys(ref.column), F.array().cast(kind)), kind)
    return Ref(F.array().cast(kind), kind)


def values_of(ref: Ref) -> Ref:
    kind = T.ArrayType(T.StringType())
    if isinstance(ref.dtype, T.StructType):
        parts = [text_of(Ref(ref.column.getField(f.name), f.dataType)) for f in ref.dtype.fields]
        return Ref(F.when(ref.column.isNotNull(), F.array(*parts)).otherwise(F.array().cast(kind)), kind)
    if isinstance(ref.dtype, T.MapType):
        values = F.map_values(ref.column)
        texts = F.transform(values, lambda v: text_of(Ref(v, ref.dtype.valueType)))
        return Ref(F.coalesce(texts, F.array().cast(kind)), kind)
    return Ref(F.array().cast(kind), kind)


def _text(function: Callable[..., Column]) -> Callable[..., Ref]:
    return lambda ref, *a, **k: Ref(function(text_of(ref), *a, **k), T.StringType())


def _list_to_text(ref: Ref, *args: Any, **named: Any) -> Ref:
    items = ref.column
    if isinstance(ref.dtype, T.ArrayType):
        items = F.transform(items, lambda v: text_of(Ref(v, ref.dtype.elementType)))
    return Ref(list_to_text(items, *args, **named), T.StringType())


def _extract(ref: Ref, path: str) -> Ref:
    if not isinstance(ref.dtype, (T.StructType, T.MapType, T.VariantType)):
        return Ref(F.lit(None).cast("string"), T.StringType())
    found = resolve(ref.column, ref.dtype, path, indexes=False)
    return Ref(F.lit(None).cast("string"), T.StringType()) if found.missing else found


Filter = Callable[..., Ref]

# Template filters by name. A caller passes its own dictionary to add more.
FILTERS: dict[str, Filter] = {
    "json": lambda r, *a, **k: Ref(json_text(r), T.StringType()),
    "tojson": lambda r, *a, **k: Ref(json_text(r), T.StringType()),
    "truncate_words": _text(truncate_words),
    "truncate": _text(truncate),
    "default_if_none": lambda r, d="": Ref(default_if_none(text_of(r), str(d)), T.StringType()),
    "default": lambda r, d="": Ref(default_if_none(text_of(r), str(d)), T.StringType()),
    "format_date": lambda r, fmt="%Y-%m-%d": Ref(format_date(r, fmt), T.StringType()),
    "extract_field": _extract,
    "list_to_text": _list_to_text,
    "sanitize": _text(sanitize),
    "first_n": first_n,
    "keys": keys_of,
    "values": values_of,
}
