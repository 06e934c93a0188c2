"""Prompt templates turned into one Column per template.

A template holds text, ``{{ path | filter(args) }}`` placeholders and
``{% if path %} .. {% else %} .. {% endif %}``. Everything else is refused when the plan is built.
A placeholder that is NULL and has no filter for it makes the whole text NULL.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from quillflow.functions.paths import MISSING, Ref, resolve
from quillflow.functions.text import FILTERS, Filter, text_of

Context = dict[str, Ref]

_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
_PATH = re.compile(r"""[A-Za-z_]\w*(?:\.get\((?:'[^']*'|"[^"]*")\)|\.\w+|\[(?:'[^']*'|"[^"]*"|\d+)\])*$""")
_STEP = re.compile(r"""\.get\(['"]([^'"]*)['"]\)|\.(\w+)|\[['"]?([^'"\]]*)['"]?\]""")
_CALL = re.compile(r"(\w+)\s*(\(.*\))?$", re.DOTALL)
_PIPE = re.compile(r"""\|(?=(?:[^'"]|'[^']*'|"[^"]*")*$)""")


class TemplateError(ValueError):
    """The template uses something outside the supported subset."""


@dataclass(frozen=True)
class Rendered:
    """Text of a template (NULL when something is undefined) and the reason."""

    text: Column
    error: Column


def constant(value: Any) -> Ref:
    """A driver-side value (agent settings, extras) as a template variable."""
    if isinstance(value, dict):
        fields = {k: constant(v) for k, v in value.items()}
        if not fields:
            return Ref(F.lit("{}"), T.StringType())
        struct = F.struct(*[r.column.alias(k) for k, r in fields.items()])
        return Ref(struct, T.StructType([T.StructField(k, r.dtype) for k, r in fields.items()]))
    if isinstance(value, (list, tuple)):
        items = F.array(*[F.lit(str(v)) for v in value]).cast("array<string>")
        return Ref(items, T.ArrayType(T.StringType()))
    if isinstance(value, bool):
        return Ref(F.lit(value), T.BooleanType())
    if isinstance(value, int):
        return Ref(F.lit(value).cast("long"), T.LongType())
    if isinstance(value, float):
        return Ref(F.lit(value), T.DoubleType())
    return Ref(F.lit(value).cast("string"), T.StringType())


def _lookup(path: str, context: Context) -> Ref:
    path = path.strip()
    if not _PATH.match(path):
        raise TemplateError(f"not a plain variable: {path!r}")
    name = re.match(r"\w+", path).group()
    if name not in context:
        return MISSING
    ref = context[name]
    for match in _STEP.finditer(path[len(name):]):
        ref = resolve(ref.column, ref.dtype, next(g for g in match.groups() if g is not None))
        if ref.missing:
            return MISSING
    return ref


def _value(expression: str, context: Context, filters: dict[str, Filter]) -> Ref:
    path, *calls = _PIPE.split(expression)
    ref = _lookup(path, context)
    if ref.missing:
        ref = Ref(F.lit(None).cast("string"), T.StringType())
    for call in calls:
        match = _CALL.match(call.strip())
        if not match or match.group(1) not in filters:
            raise TemplateError(f"unknown filter {call.strip()!r}")
        args, named = (), {}
        if match.group(2):
            node = ast.parse("f" + match.group(2).strip(), mode="eval").body
            args = [ast.literal_eval(a) for a in node.args]
            named = {k.arg: ast.literal_eval(k.value) for k in node.keywords}
        ref = filters[match.group(1)](ref, *args, **named)
    return ref


def _truthy(ref: Ref) -> Column:
    column, dtype = ref.column, ref.dtype
    if isinstance(dtype, T.BooleanType):
        test = column
    elif isinstance(dtype, T.NumericType):
        test = column != 0
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        test = F.size(column) > 0
    elif isinstance(dtype, T.StringType):
        test = column != ""
    else:
        test = column.isNotNull()
    return F.coalesce(test, F.lit(False))


def _blocks(template: str) -> list[str]:
    # Block tags swallow the blanks before them on their line and the line end after them.
    template = re.sub(r"(?m)^[ \t]+(?=\{%)", "", template)
    template = re.sub(r"(%\})\n", r"\1", template)
    return [part for part in _TAG.split(template) if part]


def compile_template(
    template: str, context: Context, filters: dict[str, Filter] | None = None
) -> Rendered:
    """Split the template once and build its text and error columns."""
    known = {**FILTERS, **(filters or {})}
    parts = _blocks(template)

    def section(at: int, nested: bool) -> tuple[list[Rendered], int, str]:
        done: list[Rendered] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                expression = part[2:-2].strip("-").strip()
                text = text_of(_value(expression, context, known))
                missing = F.when(text.isNull(), F.lit(f"Undefined variable: {expression}"))
                done.append(Rendered(text, missing))
            elif part.startswith("{%"):
                words = part[2:-2].strip().split(None, 1)
                if words[0] in ("else", "endif") and nested:
                    return done, at, words[0]
                if words[0] != "if" or len(words) < 2:
                    raise TemplateError(f"unsupported block {part!r}")
                negate = words[1].startswith("not ")
                ref = _lookup(words[1][4:] if negate else words[1], context)
                test = F.lit(False) if ref.missing else _truthy(ref)
                test = ~test if negate else test
                yes, at, end = section(at, True)
                no: list[Rendered] = []
                if end == "else":
                    no, at, end = section(at, True)
                if end != "endif":
                    raise TemplateError("if without endif")
                first, second = joined(yes), joined(no)
                done.append(Rendered(
                    F.when(test, first.text).otherwise(second.text),
                    F.when(test, first.error).otherwise(second.error)))
            else:
                done.append(Rendered(F.lit(part), F.lit(None).cast("string")))
        return done, at, ""

    def joined(pieces: list[Rendered]) -> Rendered:
        if not pieces:
            return Rendered(F.lit(""), F.lit(None).cast("string"))
        return Rendered(F.concat(*[p.text for p in pieces]),
                        F.coalesce(*[p.error for p in pieces]))

    pieces, _, end = section(0, False)
    if end:
        raise TemplateError(f"unexpected {end}")
    whole = joined(pieces)
    return Rendered(trim_blank_lines(whole.text), whole.error)


def trim_blank_lines(text: Column) -> Column:
    """Drop blank lines at the start and at the end; a text of blank lines only becomes empty."""
    text = F.regexp_replace(text, r"(?U)\A(?:[^\S\n]*\n)+", "")
    text = F.regexp_replace(text, r"(?U)(?:\n[^\S\n]*)+\z", "")
    return F.when(text.rlike(r"(?U)\A[^\S\n]*\z"), "").otherwise(text)
