"""Write strategies: answers applied to a target table as column rewrites."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillflow.functions.columns import let
from quillflow.functions.paths import variant_path


def _list(items: Column) -> Column:
    return F.coalesce(items, F.array())


def append_items(current: Column, items: Column) -> Column:
    """Push the items at the end; a missing array starts empty."""
    return F.concat(_list(current), items)


def append_one(current: Column, item: Column) -> Column:
    return append_items(current, F.array(item))


def append_capped(current: Column, items: Column, limit: int, position: int | None = 0) -> Column:
    """Insert at ``position`` and cap: position 0 keeps the first ``limit``, others the last.

    None is the end; a negative position counts from the end.
    """
    old = _list(current)
    if position == 0:
        return F.slice(F.concat(items, old), 1, limit)
    if position is None:
        merged = F.concat(old, items)
    else:
        size = F.size(old)
        at = F.least(F.lit(position), size) if position > 0 else F.greatest(size + position, F.lit(0))
        merged = F.concat(F.slice(old, F.lit(1), at), items, F.slice(old, at + 1, size))
    size = F.size(merged)
    return F.when(size <= limit, merged).otherwise(
        F.slice(merged, F.greatest(size - limit + 1, F.lit(1)), F.lit(limit)))


def append_unique(current: Column, items: Column) -> Column:
    """Add only items not present yet, each once; duplicates already stored stay."""
    old = _list(current)
    return F.concat(old, F.array_distinct(F.array_except(items, old)))


def update_first_match(
    items: Column, dtype: T.ArrayType, matches: Callable[[Column], Column],
    changes: dict[str, Column],
) -> Column:
    """Set fields of the first array element that matches; no match leaves the array."""
    hits = F.transform(items, lambda x: F.coalesce(matches(x), F.lit(False)))
    first = F.array_position(hits, True) - 1

    def rebuilt(element: Column) -> Column:
        struct: T.StructType = dtype.elementType
        parts = [changes[f.name].cast(f.dataType).alias(f.name) if f.name in changes
                 else element.getField(f.name).alias(f.name) for f in struct.fields]
        parts += [c.alias(n) for n, c in changes.items() if n not in struct.names]
        return F.struct(*parts)

    return F.transform(items, lambda x, i: F.when(i == first, rebuilt(x)).otherwise(x))


def increment(current: Column, amount: Column | int | float = 1) -> Column:
    """Add to a number; a missing one starts at 0."""
    amount = amount if isinstance(amount, Column) else F.lit(amount)
    return F.coalesce(current, F.lit(0)) + amount


# A tree of updates below a struct: a name maps to (value, flag) or to a deeper tree.
Update = tuple[Column, Column | None]
Tree = dict[str, "Update | Tree"]


def _flags(tree: Tree) -> list[Column | None]:
    found: list[Column | None] = []
    for node in tree.values():
        found += _flags(node) if isinstance(node, dict) else [node[1]]
    return found


def _nullable(dtype: T.DataType) -> T.DataType:
    """The type with nulls allowed in all elements and fields, as answers may lack any."""
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_nullable(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, _nullable(dtype.valueType))
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in dtype.fields])
    return dtype


def _updated(old: Column, dtype: T.DataType | None, update: Update) -> Column:
    value, flag = update
    if flag is None:
        return value
    if dtype is None:
        return F.when(flag, value)
    # A value that doesn't fit the type, such as an overflow, leaves the old one.
    new = F.coalesce(value.try_cast(_nullable(dtype)), F.when(value.isNotNull(), old))
    return F.when(flag, new).otherwise(old)


def set_fields(root: Column, dtype: T.DataType | None, tree: Tree) -> Column:
    """The struct with the fields of ``tree`` set; missing structs on the way are created.

    Where an update's flag is false the old value stays; without a flag the value is always set.
    All fields are set in one rebuild of the struct.
    """
    fields = {f.name: f.dataType for f in dtype.fields} if isinstance(dtype, T.StructType) else {}
    done = {name: root.getField(name) for name in fields}
    for name, node in tree.items():
        old = done.get(name, F.lit(None))
        if isinstance(node, dict):
            done[name] = set_fields(old, fields.get(name), node)
        else:
            done[name] = _updated(old, fields.get(name), node)
    built = F.struct(*[c.alias(n) for n, c in done.items()])
    flags = _flags(tree)
    if any(flag is None for flag in flags):
        return built
    anything = flags[0]
    for flag in flags[1:]:
        anything = anything | flag
    return F.when(anything if dtype is None else root.isNotNull() | anything, built)


def _put(tree: Tree, path: str, update: Update) -> None:
    *parents, name = path.split(".")
    for parent in parents:
        tree = tree.setdefault(parent, {})
        if not isinstance(tree, dict):
            raise ValueError(f"{path} is written both as a value and as a struct")
    tree[name] = update


def set_at_path(root: Column, dtype: T.DataType, path: str, value: Column) -> Column:
    """The struct ``root`` with ``value`` at a dot path."""
    tree: Tree = {}
    _put(tree, path, (value, None))
    return set_fields(root, dtype, tree)


@dataclass(frozen=True)
class Write:
    """How answers change the target.

    ``types`` names the answer fields and their SQL types. ``fields`` renames answer fields and
    drops the others. With ``rest`` no field is lost: fields that the target has are set there,
    and all others become entries of a VARIANT object of that name beside them.
    """

    types: dict[str, str]
    strategy: str = "merge"
    fields: dict[str, str] | None = None
    path: str | None = None
    array_field: str | None = None
    target_field: str | None = None
    include_metadata: bool = True
    metadata_field: str = "_ai_metadata"
    rest: str | None = None

    @property
    def mapping(self) -> dict[str, str]:
        """Answer field to target name."""
        return self.fields if self.fields else {name: name for name in self.types}

    def place(self, name: str) -> str:
        """Dot path in the target of a target name."""
        base = self.path if self.strategy == "nested" else self.target_field
        return f"{base}.{name}" if base else name


METADATA = ("work_item_id", "model", "provider", "total_tokens", "cost_usd", "latency_ms")


def effective_answer(parsed: Column, content: Column) -> Column:
    """The parsed answer, or ``{"content": text}`` when it is absent, raw or empty."""
    fallback = F.to_variant_object(F.struct(content.alias("content")))

    def choose(p: Column) -> Column:
        raw = F.coalesce(F.try_variant_get(p, "$._raw", "boolean"), F.lit(False))
        empty = p.isNull() | F.is_variant_null(p) | F.to_json(p).isin("{}", "[]")
        return F.when(empty | raw, fallback).otherwise(p)

    return let(parsed, choose)


def metadata_struct(processed_at: Column) -> Column:
    """Execution details kept next to the written fields."""
    return F.struct(
        processed_at.alias("processed_at"),
        F.col("work_item_id"), F.col("model"), F.col("provider"),
        F.col("total_tokens").alias("tokens"), F.col("cost_usd"), F.col("latency_ms"))


def is_list(answer: Column) -> Column:
    return F.schema_of_variant(answer).startswith("ARRAY")


def fold_results(
    results: DataFrame, id_col: str, writes: list[tuple[Column, Write]],
    order_by: tuple[str, ...] = ("completed_at", "work_item_id"), target: T.StructType | None = None,
) -> tuple[DataFrame, dict[str, str], dict[str, str], dict[str, str]]:
    """One row per document: the last write of every target path, by ``order_by``.

    A value that doesn't fit the type that ``target`` has at its path isn't a write, so the ones
    before it count.

    A write applies to the result rows its condition selects. ``results`` needs the id,
    ``answer`` (VARIANT), ``completed_at`` and ``work_item_id``. One aggregate that combines
    before the shuffle serves all writes; only an append keeps every answer of a document, as the
    target array does, and ``rest`` the unlisted fields of each. Also returned: folded column by
    set path, by appended path and by path of the unlisted fields.
    """
    order = F.struct(*order_by)
    others: dict[str, list[tuple[Column, Column]]] = {}
    answer = F.col("answer")
    listed = is_list(answer)
    cases: dict[str, list[tuple[Column, Column]]] = {}
    items: dict[str, list[tuple[Column, Column]]] = {}
    for chosen, write in writes:
        usable = chosen if write.strategy == "append" else chosen & ~listed
        if write.include_metadata:
            value = metadata_struct(F.col("completed_at"))
            cases.setdefault(write.metadata_field, []).append((usable, value))
        if write.strategy == "append":
            items.setdefault(write.array_field, []).append((usable, _append_items(answer, write)))
            continue
        for source, target_name in write.mapping.items():
            at = variant_path([source])
            value = F.try_variant_get(answer, at, write.types[source])
            # A value of another type leaves the old one; only a JSON null takes it away.
            null = F.is_variant_null(F.try_variant_get(answer, at, "variant"))
            dtype = None if target is None else _type_at(target, write.place(target_name))
            fits = value if dtype is None else value.try_cast(_nullable(dtype))
            found = usable & (fits.isNotNull() | null)
            cases.setdefault(write.place(target_name), []).append((found, value))
        if write.rest and not write.fields:
            others.setdefault(write.place(write.rest), []).append((usable, _unlisted(answer, write)))
    aggregates, sets, appends, rests = [], {}, {}, {}
    for number, (path, options) in enumerate(cases.items()):
        chain = F.when(options[0][0], F.struct(options[0][1].alias("v")))
        test = options[0][0]
        for found, value in options[1:]:
            chain, test = chain.when(found, F.struct(value.alias("v"))), test | found
        sets[path] = f"_set{number}"
        aggregates.append(F.max_by(chain, F.when(test, order)).alias(sets[path]))
    for number, (path, options) in enumerate(items.items()):
        chain = F.when(*options[0])
        for found, value in options[1:]:
            chain = chain.when(found, value)
        appends[path] = f"_append{number}"
        aggregates.append(F.flatten(_in_order(chain, order)).alias(appends[path]))
    for number, (path, options) in enumerate(others.items()):
        chain = F.when(*options[0])
        for found, value in options[1:]:
            chain = chain.when(found, value)
        rests[path] = f"_rest{number}"
        every = _in_order(F.when(F.cardinality(chain) > 0, chain), order)
        merged = F.aggregate(every, F.create_map().cast(OBJECT), over)
        aggregates.append(F.when(F.cardinality(merged) > 0, merged).alias(rests[path]))
    return results.groupBy(id_col).agg(*aggregates), sets, appends, rests


OBJECT = "map<string,variant>"


def _in_order(value: Column, order: Column) -> Column:
    """All values of a group that aren't null, by ``order``; VARIANT itself has no order."""
    def compare(a: Column, b: Column) -> Column:
        return F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)

    rows = F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("at"), value.alias("v"))))
    return F.transform(F.array_sort(rows, compare), lambda x: x["v"])


def over(old: Column, new: Column) -> Column:
    """The entries of ``new``, and those of ``old`` that ``new`` doesn't have."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def _unlisted(answer: Column, write: Write) -> Column:
    """The answer fields that have no type of their own."""
    return F.map_filter(F.try_variant_get(answer, "$", OBJECT), lambda k, _: ~k.isin(list(write.types)))


def _open_types(writes: list[Write], target: T.StructType, fixed: tuple[str, ...]) -> list[Write]:
    """Open writes also know the fields that the target has.

    Left to ``rest`` are the ``fixed`` columns, arrays that a write appends to, metadata, and
    structs below which another write sets fields.
    """
    declared = {w.place(place): w.types[source] for w in writes if w.strategy != "append"
                for source, place in w.mapping.items()}
    own = {w.metadata_field for w in writes} | {w.array_field for w in writes}
    own |= {w.place(w.rest) for w in writes if w.rest}
    deep = [p for p in (*declared, *own) if p and "." in p]

    def opened(write: Write) -> Write:
        if not write.rest or write.fields or write.strategy == "append":
            return write
        base = write.path if write.strategy == "nested" else write.target_field
        below = _type_at(target, base) if base else target
        types = {}
        for field in below.fields if isinstance(below, T.StructType) else ():
            at = write.place(field.name)
            if at not in own and at not in fixed and not any(p.startswith(at + ".") for p in deep):
                types[field.name] = declared.get(at, field.dataType.simpleString())
        return replace(write, types={**types, **write.types})

    return [opened(w) for w in writes]


def _type_at(dtype: T.DataType, path: str) -> T.DataType | None:
    """Type of the field at a dot path, None where there is none."""
    for name in path.split("."):
        if not isinstance(dtype, T.StructType) or name not in dtype.names:
            return None
        dtype = dtype[name].dataType
    return dtype


def _append_items(answer: Column, write: Write) -> Column:
    def shaped(value: Column) -> Column:
        if not write.types:
            return value
        return F.struct(*[
            F.try_variant_get(value, variant_path([source]), write.types[source]).alias(target)
            for source, target in write.mapping.items()])

    each = F.transform(F.try_variant_get(answer, "$", "array<variant>"), shaped)
    return F.when(is_list(answer), each).otherwise(F.array(shaped(answer)))


def apply_results(
    target: DataFrame, results: DataFrame, id_col: str, write: Write,
    condition: Column | None = None,
) -> DataFrame:
    """The target with the results applied; documents without a result are unchanged.

    Fields absent from an answer keep their old value, and an answer that is a list changes
    nothing unless it is appended. ``condition`` on the target row decides whether it changes.
    """
    return apply_writes(target, results, id_col, [(F.lit(True), write)], condition)


def apply_writes(
    target: DataFrame, results: DataFrame, id_col: str, writes: list[tuple[Column, Write]],
    condition: Column | None = None,
    order_by: tuple[str, ...] = ("completed_at", "work_item_id"), keep: tuple[str, ...] = (),
) -> DataFrame:
    """Several writes in one pass: one aggregate over the results and one join with the target.

    Answers never set the id and the columns in ``keep``.
    """
    fixed = (id_col, *keep)
    opened = _open_types([write for _, write in writes], target.schema, fixed)
    writes = [(chosen, write) for (chosen, _), write in zip(writes, opened)]
    folded, sets, appends, rests = fold_results(results, id_col, writes, order_by, target.schema)
    joined = target.join(folded, id_col, "left")
    act = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    tree: Tree = {}
    for path, name in sets.items():
        _put(tree, path, (F.col(f"{name}.v"), act & F.col(name).isNotNull()))
    for path, name in appends.items():
        old = F.col(path) if _type_at(target.schema, path) is not None else F.lit(None)
        _put(tree, path, (append_items(old, F.col(name)), act & (F.size(name) > 0)))
    for path, name in rests.items():
        merged = F.col(name)
        if _type_at(target.schema, path) is not None:
            old = F.coalesce(F.try_variant_get(F.col(path), "$", OBJECT), F.create_map().cast(OBJECT))
            merged = over(old, merged)
        _put(tree, path, (F.to_variant_object(merged), act & F.col(name).isNotNull()))
    schema = target.schema
    columns = {name: F.col(f"`{name}`") for name in target.columns}
    for name, node in tree.items():
        dtype = schema[name].dataType if name in schema.names else None
        old = columns.get(name, F.lit(None))
        if isinstance(node, dict):
            columns[name] = set_fields(old, dtype, node)
        else:
            columns[name] = _updated(old, dtype, node)
    return joined.select(*[c.alias(n) for n, c in columns.items()])


def write_report(results: DataFrame, target: DataFrame, id_col: str, write: Write) -> DataFrame:
    """Per result: was it written? False for an unknown document or a list without append."""
    known = target.select(F.col(id_col), F.lit(True).alias("_known"))
    joined = results.join(known, id_col, "left")
    listed = is_list(F.col("answer")) if write.strategy != "append" else F.lit(False)
    found = F.col("_known").isNotNull()
    reason = F.when(listed, "list_requires_append").when(~found, "document_not_found")
    return joined.withColumn("written", found & ~listed).withColumn(
        "write_error", reason).drop("_known")


def fresh_only(items: DataFrame, seen: DataFrame, as_of: Column, key: str = "idempotency_key",
               ttl_seconds: int = 24 * 3600) -> DataFrame:
    """Items whose key was not recorded within the ttl (items without a key always pass)."""
    live = seen.where(F.col("created_at") > as_of - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return items.join(live.select(F.col("key").alias(key)), key, "left_anti")
