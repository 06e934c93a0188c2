"""Dot paths over typed and schemaless documents, resolved while the plan is built."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from quillflow.functions.columns import let


@dataclass(frozen=True)
class Ref:
    """A document field: its column and type, or no column when the schema lacks it."""

    column: Column | None
    dtype: T.DataType | None

    @property
    def missing(self) -> bool:
        return self.column is None

    @property
    def is_variant(self) -> bool:
        return isinstance(self.dtype, T.VariantType)


MISSING = Ref(None, None)


def variant_path(parts: list[str]) -> str:
    """``['a', 'b c']`` as ``$["a"]["b c"]``."""
    for part in parts:
        if '"' in part or "\\" in part:
            raise ValueError(f"field name not supported in a path: {part!r}")
    return "$" + "".join(f'["{part}"]' for part in parts)


def variant_field(value: Column, path: str) -> Column:
    """Variant at ``path``; JSON null and absence are both SQL NULL."""
    found = F.try_variant_get(value, path, "variant")
    return let(found, lambda v: F.when(~F.is_variant_null(v), v))


def _variant_steps(value: Column, parts: list[str]) -> Column:
    # A numeric step is a list index or an object key, whichever the value has.
    choices = [[f'["{p}"]', f"[{int(p)}]"] if p.isdigit() else [f'["{p}"]'] for p in parts]
    variant_path(parts)
    paths = ["$" + "".join(steps) for steps in itertools.product(*choices)]
    if len(paths) == 1:
        return variant_field(value, paths[0])
    return let(value, lambda v: F.coalesce(*[variant_field(v, p) for p in paths]))


def resolve(root: Column | None, dtype: T.DataType, path: str, *, indexes: bool = True) -> Ref:
    """Follow a dot path; a step that cannot exist gives ``MISSING``.

    ``root`` is None when the fields of ``dtype`` are the columns of the frame itself.
    """
    parts = path.split(".")
    column, current = root, dtype
    for depth, part in enumerate(parts):
        if isinstance(current, T.StructType):
            if part not in current.names:
                return MISSING
            column = F.col(f"`{part}`") if column is None else column.getField(part)
            current = current[part].dataType
        elif isinstance(current, T.MapType):
            column, current = F.try_element_at(column, F.lit(part)), current.valueType
        elif isinstance(current, T.ArrayType) and part.isdigit() and indexes:
            column, current = F.get(column, F.lit(int(part))), current.elementType
        elif isinstance(current, T.VariantType):
            rest = parts[depth:]
            if not indexes:
                return Ref(variant_field(column, variant_path(rest)), current)
            return Ref(_variant_steps(column, rest), current)
        else:
            return MISSING
    return Ref(column, current)
