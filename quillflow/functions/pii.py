"""Personal data in text and documents: masks of equal length, and detections."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from quillflow.functions.columns import let

# What is looked for, in this order.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}

# What a text must hold before a default pattern can match: a sign, or any decimal digit.
_SIGNS = {"email": "@"}
_DIGIT = r"\p{Nd}"
# Part of every match of a default pattern, which is found in less time than the pattern.
_PARTS = {"phone": r"[0-9]{4}", "ssn": r"\p{Nd}-\p{Nd}{2}-\p{Nd}", "credit_card": r"\p{Nd}{4}",
          "ip_address": r"\p{Nd}\.\p{Nd}"}

DETECTION = "array<struct<type:string,start:int,end:int,length:int>>"
FOUND = "array<struct<type:string,start:int,end:int,value:string>>"
PATH_DETECTION = "array<struct<type:string,start:int,end:int,length:int,path:string>>"


def patterns(
    custom: dict[str, str] | None = None, disabled: set[str] | None = None,
    only: list[str] | None = None,
) -> dict[str, str]:
    """The default patterns, with custom ones added or replaced and some switched off."""
    chosen = {**PATTERNS, **(custom or {})}
    return {k: "(?iU)" + v for k, v in chosen.items()
            if k not in (disabled or set()) and (not only or k in only)}


def _masked(text: Column, name: str, pattern: str, char: str) -> Column:
    return F.when(_may_match(text, name, pattern), _filled(text, pattern, char)).otherwise(text)


def _filled(text: Column, pattern: str, char: str) -> Column:
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    filled = F.zip_with(pieces, hits, lambda p, h: F.concat(
        p, F.coalesce(F.repeat(F.lit(char), F.length(h)), F.lit(""))))
    return F.array_join(filled, "")


def _spans(text: Column, name: str, pattern: str, with_value: bool) -> Column:
    found = _found_spans(text, name, pattern, with_value)
    return F.when(_may_match(text, name, pattern), found).otherwise(F.array().cast(FOUND if with_value else DETECTION))


def _found_spans(text: Column, name: str, pattern: str, with_value: bool) -> Column:
    """Start and end of every match, from the lengths of what lies between and within them."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.slice(F.arrays_zip(pieces.alias("p"), hits.alias("h")), F.lit(1), F.size(hits))
    kind = FOUND if with_value else DETECTION

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["p"])
        length = F.length(pair["h"])
        last = pair["h"].alias("value") if with_value else length.alias("length")
        span = F.struct(F.lit(name).alias("type"), start.alias("start"),
                        (start + length).alias("end"), last)
        return F.struct((start + length).alias("at"),
                        F.concat(state["out"], F.array(span)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(pairs, begin, add, lambda s: s["out"])


def _may_match(text: Column, name: str, pattern: str) -> Column:
    found = text.rlike(pattern)
    if patterns().get(name) != pattern:
        return found
    return (text.contains(_SIGNS[name]) if name in _SIGNS else text.rlike(_PARTS[name])) & found


def _mask_step(name: str, pattern: str, char: str):
    return lambda text: _masked(text, name, pattern, char)


def _detect_step(name: str, pattern: str, char: str):
    def step(state: Column) -> Column:
        found = F.struct(
            _filled(state["text"], pattern, char).alias("text"),
            F.concat(state["detections"], _found_spans(state["text"], name, pattern, False)).alias("detections"))
        return F.when(_may_match(state["text"], name, pattern), found).otherwise(state)

    return step


def _without_digits(chosen: dict[str, str]) -> dict[str, str]:
    """The patterns that may match a text without digits: all but the numeric default ones."""
    default = patterns()
    return {n: p for n, p in chosen.items() if n in _SIGNS or default.get(n) != p}


def mask_text(text: Column, chosen: dict[str, str] | None = None, char: str = "*") -> Column:
    """Replace every match by as many mask characters; later patterns see the masked text."""
    chosen = chosen or patterns()

    def chain(steps: dict[str, str]) -> Column:
        # The one-element array names the text of each step, so no step is computed twice.
        values = F.array(text)
        for name, pattern in steps.items():
            values = F.transform(values, _mask_step(name, pattern, char))
        return F.get(values, F.lit(0)) if steps else text

    return F.when(text.rlike(_DIGIT), chain(chosen)).otherwise(chain(_without_digits(chosen)))


def mask_and_detect(text: Column, chosen: dict[str, str] | None = None, char: str = "*") -> Column:
    """Struct of the masked ``text`` and its ``detections`` (type, start, end, length)."""
    chosen = chosen or patterns()

    def chain(steps: dict[str, str]) -> Column:
        states = F.array(F.struct(text.alias("text"), F.array().cast(DETECTION).alias("detections")))
        for name, pattern in steps.items():
            states = F.transform(states, _detect_step(name, pattern, char))
        return F.get(states, F.lit(0))

    return F.when(text.rlike(_DIGIT), chain(chosen)).otherwise(chain(_without_digits(chosen)))


def detect(text: Column, chosen: dict[str, str] | None = None) -> Column:
    """Matches of every pattern in the original text, with their value; nothing is masked."""
    parts = [F.coalesce(_spans(text, n, p, True), F.array().cast(FOUND))
             for n, p in (chosen or patterns()).items()]
    return F.concat(*parts)


def count_matches(text: Column, name: str, pattern: str) -> Column:
    """Number of matches of one pattern."""
    count = F.regexp_count(text, F.lit(pattern))
    if name in _SIGNS and patterns()[name] == pattern:
        count = F.when(text.contains(_SIGNS[name]), count)
    elif patterns().get(name) == pattern:
        count = F.when(text.rlike(_DIGIT), count)
    return F.coalesce(count, F.lit(0))


def _below(path: str | Column, name: str | Column) -> str | Column:
    """Path of an entry; a column below a map, whose keys are data."""
    if isinstance(path, str) and not path:
        return name
    if isinstance(path, str) and isinstance(name, str):
        return f"{path}.{name}"
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in (path, ".", name)))


def _processed(name: str | Column, path: str | Column, fields: list[str] | None) -> bool | Column:
    if fields is None or isinstance(name, str) and name in fields:
        return True
    if isinstance(path, str):
        return any(f.startswith(path) for f in fields)
    found = F.lit(False) if isinstance(name, str) else name.isin(fields)
    for f in fields:
        found = found | F.startswith(F.lit(f), path)
    return F.coalesce(found, F.lit(False))


# Levels of a VARIANT value that masks enter unless told otherwise; a deeper value is an error.
LEVELS = 8
ENTRY = "array<struct<key:string,at:int,value:variant>>"


def variant_depth(value: Column) -> Column:
    """Levels of objects and arrays in a VARIANT value, 0 for a scalar; ``levels`` of a mask for a table
    is their maximum."""
    text = F.regexp_replace(F.regexp_replace(F.to_json(value), r"\\.", ""), r'"[^"]*"', "")
    brackets = F.split(F.regexp_replace(text, r"[^\[\]{}]", ""), "")

    def step(state: Column, sign: Column) -> Column:
        at = state["at"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
        return F.struct(at.alias("at"), F.greatest(state["most"], at).alias("most"))

    return F.aggregate(brackets, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step, lambda s: s["most"])


def _opened(value: Column, then) -> Column:
    """``then(value, kind, entries)`` of a VARIANT: kind is O or A, or null for a scalar without entries.

    The entries of objects and arrays have one shape, so what follows stands once for both and a
    mask grows by a fixed amount per level.
    """
    def known(state: Column) -> Column:
        entries = F.when(state["o"].isNotNull(), F.transform(F.map_entries(state["o"]), lambda e: F.struct(
            e["key"].alias("key"), F.lit(None).cast("int").alias("at"), e["value"].alias("value")))).otherwise(
            F.transform(state["a"], lambda x, i: F.struct(
                F.lit(None).cast("string").alias("key"), i.alias("at"), x.alias("value"))))
        kind = F.when(state["o"].isNotNull(), "O").when(state["a"].isNotNull(), "A")
        return let(F.struct(state["v"].alias("v"), kind.alias("kind"), entries.cast(ENTRY).alias("entries")),
                   lambda s: then(s["v"], s["kind"], s["entries"]))

    return let(F.struct(value.alias("v"), F.try_variant_get(value, "$", "map<string,variant>").alias("o"),
                        F.try_variant_get(value, "$", "array<variant>").alias("a")), known)


def _entry_path(path: Column, entry: Column) -> Column:
    named = F.when(path == "", entry["key"]).otherwise(F.concat(path, F.lit("."), entry["key"]))
    return F.coalesce(named, F.concat(path, F.lit("["), entry["at"].cast("string"), F.lit("]")))


def _entry_entered(entry: Column, path: Column, fields: list[str] | None, recursive: bool) -> Column:
    """Items of a list always, entries of an object by name or path; without ``recursive`` no objects in them."""
    chosen = F.lit(True)
    if fields is not None:
        chosen = entry["key"].isin(fields)
        for f in fields:
            chosen = chosen | F.startswith(F.lit(f), path)
    if not recursive:
        chosen = chosen & F.try_variant_get(entry["value"], "$", "map<string,variant>").isNull()
    return entry["key"].isNull() | chosen


def _is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _too_deep(kind: str) -> Column:
    return F.raise_error(F.lit("a VARIANT value has more levels than the mask enters; raise levels")).cast(kind)


def mask_variant(
    value: Column, fields: list[str] | None = None, recursive: bool = True,
    chosen: dict[str, str] | None = None, char: str = "*", path: Column | None = None, levels: int = LEVELS,
) -> Column:
    """A VARIANT with every string masked, whatever objects and arrays it lies in.

    ``fields`` are names of keys or paths like ``a.b[0].c``; other entries of objects stay as they
    are. Empty objects and arrays, JSON null and other scalars are kept. A value with more than
    ``levels`` levels is an error, never a value in clear.
    """
    path = F.lit("") if path is None else path

    def walk(v: Column, path: Column, left: int) -> Column:
        def rebuilt(v: Column, kind: Column, entries: Column) -> Column:
            text = F.when(_is_text(v), mask_text(v.cast("string"), chosen, char).cast("variant")).otherwise(v)
            if left == 0:
                return F.when(kind.isNotNull(), _too_deep("variant")).otherwise(text)

            def entry(e: Column) -> Column:
                here = F.struct(_entry_path(path, e).alias("path"), e.alias("e"))
                return let(here, lambda h: F.struct(h["e"]["key"].alias("key"), F.when(
                    _entry_entered(h["e"], h["path"], fields, recursive),
                    walk(h["e"]["value"], h["path"], left - 1)).otherwise(h["e"]["value"]).alias("value")))

            done = F.when(kind.isNotNull(), F.transform(entries, entry))
            return let(F.struct(text.alias("t"), kind.alias("kind"), done.alias("d")), lambda s: F.when(
                s["kind"] == "O", F.to_variant_object(F.map_from_entries(s["d"]))).when(
                s["kind"] == "A", F.to_variant_object(F.transform(s["d"], lambda x: x["value"]))).otherwise(s["t"]))

        return _opened(v, rebuilt)

    return walk(value, path, levels)


def variant_detections(
    value: Column, fields: list[str] | None = None, recursive: bool = True,
    chosen: dict[str, str] | None = None, path: Column | None = None, levels: int = LEVELS,
) -> Column:
    """What ``mask_variant`` masks: type, start, end, length and path of each detection."""
    empty = F.array().cast(PATH_DETECTION)
    path = F.lit("") if path is None else path

    def walk(v: Column, path: Column, left: int) -> Column:
        def found(v: Column, kind: Column, entries: Column) -> Column:
            text = F.when(_is_text(v), _with_path(mask_and_detect(v.cast("string"), chosen)["detections"], path))
            if left == 0:
                return F.when(kind.isNotNull(), _too_deep(PATH_DETECTION)).otherwise(F.coalesce(text, empty))

            def entry(e: Column) -> Column:
                here = F.struct(_entry_path(path, e).alias("path"), e.alias("e"))
                return let(here, lambda h: F.when(
                    _entry_entered(h["e"], h["path"], fields, recursive),
                    walk(h["e"]["value"], h["path"], left - 1)).otherwise(empty))

            return F.coalesce(F.when(kind.isNotNull(), F.flatten(F.transform(entries, entry))).otherwise(text), empty)

        return _opened(v, found)

    return walk(value, path, levels)


def _with_path(found: Column, path: Column) -> Column:
    return F.transform(found, lambda d: F.struct(
        d["type"].alias("type"), d["start"].alias("start"), d["end"].alias("end"),
        d["length"].alias("length"), path.alias("path")))


def mask_document(
    value: Column, dtype: T.DataType, fields: list[str] | None = None, recursive: bool = True,
    chosen: dict[str, str] | None = None, char: str = "*", path: str | Column = "",
) -> Column:
    """Mask every string of a nested document; ``fields`` limits which fields and map keys are entered.

    A VARIANT in it is entered as ``mask_variant`` does, up to ``LEVELS`` levels.
    """
    if isinstance(dtype, T.VariantType):
        return mask_variant(value, fields, recursive, chosen, char, F.lit(path) if isinstance(path, str) else path)
    if isinstance(dtype, T.StringType):
        return mask_text(value, chosen, char)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda v: mask_document(
            v, dtype.elementType, fields, recursive, chosen, char, _item(path)))
    if isinstance(dtype, T.StructType):
        parts = []
        for f in dtype.fields:
            here = _below(path, f.name)
            inner = value.getField(f.name)
            nested = isinstance(f.dataType, (T.StructType, T.MapType))
            entered = _processed(f.name, here, fields)
            if entered is not False and (recursive or not nested):
                masked = mask_document(inner, f.dataType, fields, recursive, chosen, char, here)
                inner = masked if entered is True else F.when(entered, masked).otherwise(inner)
            parts.append(inner.alias(f.name))
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.MapType) and (recursive or not isinstance(dtype.valueType, (T.StructType, T.MapType))):
        def entry(key: Column, v: Column) -> Column:
            name = key.cast("string")
            here = _below(path, name)
            entered = _processed(name, here, fields)
            masked = mask_document(v, dtype.valueType, fields, recursive, chosen, char, here)
            return masked if entered is True else F.when(entered, masked).otherwise(v)

        return F.transform_values(value, entry)
    return value


def _item(path: str | Column) -> str | Column:
    return f"{path}[]" if isinstance(path, str) else F.concat(path, F.lit("[]"))


def document_detections(
    value: Column, dtype: T.DataType, fields: list[str] | None = None, recursive: bool = True,
    chosen: dict[str, str] | None = None,
) -> Column:
    """Detections of all strings of a nested document, with paths like ``a.b[0]``, VARIANT values included."""
    empty = F.array().cast(PATH_DETECTION)

    def walk(v: Column, kind: T.DataType, path: Column, plain: str | Column) -> Column:
        if isinstance(kind, T.VariantType):
            return variant_detections(v, fields, recursive, chosen, path)
        if isinstance(kind, T.StringType):
            return F.coalesce(_with_path(mask_and_detect(v, chosen)["detections"], path), empty)
        if isinstance(kind, T.ArrayType):
            each = F.transform(v, lambda x, i: walk(
                x, kind.elementType,
                F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), _item(plain)))
            return F.coalesce(F.flatten(each), empty)
        if isinstance(kind, T.StructType):
            parts = [empty]
            for f in kind.fields:
                here = _below(plain, f.name)
                nested = isinstance(f.dataType, (T.StructType, T.MapType))
                entered = _processed(f.name, here, fields)
                if entered is not False and (recursive or not nested):
                    below = F.lit(f.name) if isinstance(plain, str) and not plain else F.concat(path, F.lit(f".{f.name}"))
                    found = walk(v.getField(f.name), f.dataType, below, here)
                    parts.append(found if entered is True else F.when(entered, found).otherwise(empty))
            return F.concat(*parts)
        if isinstance(kind, T.MapType) and (recursive or not isinstance(kind.valueType, (T.StructType, T.MapType))):
            def entry(e: Column) -> Column:
                name = e["key"].cast("string")
                here = _below(plain, name)
                below = name if isinstance(plain, str) and not plain else F.concat(path, F.lit("."), name)
                found = walk(e["value"], kind.valueType, below, here)
                entered = _processed(name, here, fields)
                return found if entered is True else F.when(entered, found).otherwise(empty)

            return F.coalesce(F.flatten(F.transform(F.map_entries(v), entry)), empty)
        return empty

    return walk(value, dtype, F.lit(""), "")
