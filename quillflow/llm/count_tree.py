"""N-gram Jaccard join with an R-tree over count vectors.

The shingles of a set are hashed into ``GROUPS`` groups; the counts per group are a point. What two sets
share is at most the sum of the lesser coordinates of their points. A leaf of the tree holds up to
``LEAF`` points and their bounds: per coordinate the largest count, the range of set sizes. The sum of
the lesser bounds of two leaves limits what any two of their points share, so two leaves that can't
reach the limit are never opened; the pairs of the others are tested on their points, and only
survivors are verified on full sets.

The tree is dealt out by shingles: in an order of all shingles, two sets of n and m elements that reach
the limit share one of the first n - ceil(limit n) + 1 of each. The order is that of the hashes, but the
shingles that ``HOT_FROM`` sets or more have there (the ``HOT_KEYS`` most frequent ones at most) come last,
so buckets don't grow with the input. Sets that share such a key lie in its part of the tree, a *bucket*; buckets are dealt by
ranges of (key, size) into leaves, so a large one spans many tasks. Where two sets first meet also bounds
what they share: what comes after it in both.

Equal sets are one node. Each bucket's least node is compared with the others first, which joins most of
the copies of one text; then the tree finds the pairs of different components. So copies don't become all
pairs, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import least_count, let_go, row_slices, stored, trim_worker
from quillflow.llm.components import components
from quillflow.llm.sieves import passes, sieve
from quillflow.llm.shingle_sets import picked, set_digests, set_rows, sets_of, verified

GROUPS, LEAF = 128, 128
# A count of this size or more is stored as this one and bounds nothing where two sets have it.
FULL = 255
# Keys that come last in the order of shingles: from so many sets on, and at most so many.
HOT_FROM, HOT_KEYS = 32, 1 << 17
# Pairs of points that are compared at once.
BLOCK = 1 << 15
_POINT_LISTS = ("nodes", "ns", "places", "labels")
_LEAF_FIELDS = ("key long, nodes array<long>, ns array<long>, places array<long>, labels array<long>, points binary, "
                "bounds binary, low long, high long, only long, part long")


def count_vector(items: np.ndarray) -> bytes:
    """Counts of a set's hashes by group, a byte each."""
    groups = (items & np.uint64(GROUPS - 1)).astype(np.int64)
    return np.minimum(np.bincount(groups, minlength=GROUPS), FULL).astype(np.uint8).tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prints(size: int, percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()),
                        ("d2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("point", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for items, doc_id, text_hash in set_rows(batch, size, "doc_id", "text_hash"):
                n = len(items)
                rest = (*set_digests(items), items[:prefix_length(n, percent)].view(np.int64), count_vector(items)) if n else (None,) * 4
                for held, value in zip(columns, (doc_id, text_hash, n, *rest)):
                    held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        trim_worker()

    return run, "doc_id long, text_hash long, n long, d1 long, d2 long, prefix array<long>, point binary"


def _cold_prefix(hot: np.ndarray, percent: int):
    """Size and first shingles of a set in the order that puts ``hot`` (sorted) last."""
    def values(items: np.ndarray) -> tuple[int, np.ndarray]:
        items = items.view(np.int64)
        late = hot[np.minimum(np.searchsorted(hot, items), len(hot) - 1)] == items
        return len(items), np.concatenate([items[~late], items[late]])[:prefix_length(len(items), percent)]

    return values


def _hot_keys(nodes: DataFrame) -> np.ndarray:
    """Keys that ``HOT_FROM`` prefixes or more have, sorted; of more than ``HOT_KEYS`` the most frequent ones."""
    keys = nodes.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    often = stored(keys.where(F.col("n") >= HOT_FROM), "often")
    return np.sort(often.where(F.col("n") >= least_count(often, HOT_KEYS)).select("key").toArrow().column("key").to_numpy())


def _with_hot(shared):
    """Rows (node, n, doc_id, text_hash, prefix), and whether a hot key is among the prefix."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            lists = batch.column(4)
            keys, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            found = np.concatenate(([0], np.cumsum(hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys)))
            ends = ends - ends[0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found[ends[1:]] > found[ends[:-1]])], names=[*batch.schema.names, "late"])

    return run


def _prefixes(rows: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, n, prefix) of all nodes; those with a hot key are read again."""
    hot = _hot_keys(nodes)
    if not len(hot):
        return nodes.select("node", "n", "prefix")
    shared = nodes.sparkSession.sparkContext.broadcast(hot)
    marked = nodes.select("node", "n", "doc_id", "text_hash", "prefix").mapInArrow(
        _with_hot(shared), "node long, n long, doc_id long, text_hash long, prefix array<long>, late boolean")
    places = stored(marked.where("late").select("node", "doc_id", "text_hash"), "changed")
    again = picked(rows, places, size, _cold_prefix(hot, percent), "n long, prefix array<long>")
    return stored(marked.where("NOT late").select("node", "n", "prefix").unionByName(again), "prefixes")


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose count vectors (node, n, point) allow the limit."""
    one = lambda name: points.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("point").alias(f"p_{name}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "n_a", "n_b", "p_a", "p_b")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = [batch.column(i).to_numpy() for i in (2, 3)]
                p = [_points(batch.column(i)) for i in (4, 5)]
                fits = _allowed(p[0], p[1], n[0], n[1], percent)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(fits)) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _points(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)


def _allowed(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Whether the summed coordinate minima reach the limit for these sizes (or bound nothing)."""
    least = np.minimum(left, right)
    shared = least.sum(axis=1, dtype=np.int64)
    return ((100 + percent) * shared >= percent * (n_left + n_right)) | (least == FULL).any(axis=1)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of up to ``LEAF`` rows of one key (key, node, n, place, label, point), sorted by key, as one row each."""
    fields = [f.split() for f in _LEAF_FIELDS.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, n, place, label = (batch.column(i).to_numpy() for i in range(5))
        points = _points(batch.column(5))
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        cuts = [c for a, b in zip(edges, edges[1:]) for c in range(a, b, LEAF)]
        rows: list[list] = [[] for _ in schema]
        for a, b in zip(cuts, [*cuts[1:], len(key)]):
            only = int(label[a]) if (label[a:b] == label[a]).all() else None
            # Whether the key may have more leaves: at its edge here, or in another batch.
            alone = a > 0 and b < len(key) and key[a - 1] != key[a] and key[b] != key[a]
            for column, value in zip(rows, (
                    int(key[a]), node[a:b], n[a:b], place[a:b], label[a:b], points[a:b].tobytes(),
                    points[a:b].max(axis=0).tobytes(), int(n[a:b].min()), int(n[a:b].max()), only, int(not alone))):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)


def _opened(percent: int):
    """Pairs of points of two leaves (the columns of a leaf twice) that differ in label and may reach the limit."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A leaf pair is about 1000 Python integers: few of them at a time.
            for row in (row for part in row_slices(batch, 8) for row in part.to_pylist()):
                nodes, ns, places, labels, nodes_2, ns_2, places_2, labels_2 = (
                    np.array(row[c], np.int64) for c in (*_POINT_LISTS, *(f"{c}_2" for c in _POINT_LISTS)))
                n, m = ns[:, None], ns_2[None, :]
                tail = np.minimum(n - places[:, None], m - places_2[None, :])
                open_ = (labels[:, None] != labels_2[None, :]) & ((100 + percent) * (1 + tail) >= percent * (n + m))
                if row["same"]:
                    open_ = np.triu(open_, 1)
                left, right = np.nonzero(open_)
                points, points_2 = (np.frombuffer(row[c], np.uint8).reshape(-1, GROUPS) for c in ("points", "points_2"))
                for at in range(0, len(left), BLOCK):
                    i, j = left[at:at + BLOCK], right[at:at + BLOCK]
                    fits = _allowed(points[i], points_2[j], ns[i], ns_2[j], percent)
                    a, b = nodes[i[fits]], nodes_2[j[fits]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        trim_worker()

    return run


def cross_pairs(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of nodes with different labels that share a key and may reach the limit.

    ``members``: (key, node, n, place, label), one row per node and key, place counting the node's
    keys in the common order; ``points``: (node, point). A bucket is cut into leaves by size; its largest
    component comes first, so that leaves of that component alone are skipped against each other.
    """
    parts = members.groupBy("key", "label").agg(F.count("*").alias("m"))
    largest = parts.groupBy("key").agg(F.max(F.struct("m", "label")).alias("big"), F.count("*").alias("labels")).where("labels > 1")
    order = (F.col("label") != F.col("big")["label"]).alias("apart")
    rows = members.join(largest.drop("labels"), "key").select("key", "node", "n", "place", "label", order).join(
        points.select("node", "point"), "node")
    dealt = rows.repartitionByRange("key", "apart", "n", "node").sortWithinPartitions("key", "apart", "n", "node")
    leaves = stored(dealt.select("key", "node", "n", "place", "label", "point").mapInArrow(
        _leaves, _LEAF_FIELDS).withColumn("leaf", F.monotonically_increasing_id()), "leaves")
    # Pairs of leaves are chosen by their bounds alone and then get their points.
    several = leaves.where("part = 1")
    outline = several.select("key", "leaf", "low", "high", "only", "bounds")
    other = outline.select("key", *(F.col(c).alias(f"{c}_2") for c in ("leaf", "low", "high", "only", "bounds")))
    near = outline.join(other, "key").where(
        f"leaf < leaf_2 AND NOT (only <=> only_2 AND only IS NOT NULL) AND 100 * high >= {percent} * low_2 AND 100 * high_2 >= {percent} * low")
    chosen = near.select("leaf", "leaf_2", "low", "low_2", "bounds", "bounds_2").mapInArrow(_near_leaves(percent), "leaf long, leaf_2 long")
    lists = [*_POINT_LISTS, "points"]
    one = several.select("leaf", *lists)
    two = several.select(F.col("leaf").alias("leaf_2"), *(F.col(c).alias(f"{c}_2") for c in lists))
    inside = leaves.where("only IS NULL").select(
        *lists, *(F.col(c).alias(f"{c}_2") for c in lists), F.lit(True).alias("same"))
    beside = chosen.join(one, "leaf").join(two, "leaf_2").select(
        *lists, *(f"{c}_2" for c in lists), F.lit(False).alias("same"))
    # Written, so that what follows sees a pair once, not once for each key that its nodes share.
    return stored(inside.unionByName(beside).mapInArrow(_opened(percent), "a long, b long").distinct(), "met")


def _near_leaves(percent: int):
    """Pairs of leaves (leaf, leaf_2, low, low_2, bounds, bounds_2) whose summed lesser bounds reach the limit."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fits = _allowed(_points(batch.column(4)), _points(batch.column(5)), batch.column(2).to_numpy(),
                                batch.column(3).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(fits)) for i in (0, 1)], names=["leaf", "leaf_2"])

    return run


def _shared_keys(prefixes: DataFrame) -> DataFrame:
    """(node, n, key, place) of all keys that several nodes have, and of few others.

    Keys are counted alone; a sieve of those found twice then thins the prefixes where they are read, so
    only rows that may meet are dealt out with their nodes.
    """
    twice = stored(prefixes.select(F.explode("prefix").alias("key")).groupBy("key").count().where("count > 1").select("key"), "twice")
    shared = prefixes.sparkSession.sparkContext.broadcast(sieve(twice))
    schema = pa.schema([(name, pa.int64()) for name in ("node", "n", "key", "place")])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            keys, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            maybe = passes(shared.value, keys)
            of = np.repeat(np.arange(len(sizes)), sizes)[maybe]
            yield pa.RecordBatch.from_arrays([
                pa.array(batch.column(0).to_numpy()[of]), pa.array(batch.column(1).to_numpy()[of]),
                pa.array(keys[maybe]), pa.array(place[maybe])], schema=schema)

    return prefixes.select("node", "n", "prefix").mapInArrow(run, "node long, n long, key long, place long")


def _starred(prefixes: DataFrame) -> DataFrame:
    """(key, node, n, place, c_node, c_n, c_place, m): the nodes of each key that several have, beside the
    least of them, and their number; written."""
    keys = _shared_keys(prefixes)
    centres = keys.groupBy("key").agg(F.min(F.struct("node", "n", "place")).alias("c"), F.count("*").alias("m")).where(
        "m > 1").select("key", *(F.col("c")[c].alias(f"c_{c}") for c in ("node", "n", "place")), "m")
    return stored(keys.join(centres, "key"), "members")


def joined_components(rows: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame | None:
    """(node, label) of the nodes (node, n, doc_id, text_hash, prefix, point) that have links; None without any pair."""
    points = nodes.select("node", "n", "point")
    prefixes = _prefixes(rows, nodes, size, percent)
    let_go(rows.sparkSession)
    starred = _starred(prefixes)
    let_go(rows.sparkSession)
    # What two sets share lies at or after the places where they first meet.
    meet = f"{100 + percent} * (1 + least(n - place, c_n - c_place)) >= {percent} * (n + c_n)"
    first = starred.where(f"node <> c_node AND {meet}").select(F.col("c_node").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stored(bounded(first, points, percent), "pairs")
    let_go(rows.sparkSession)
    sets, links = compared(rows, nodes, pairs, None, size, percent)
    labels = components(links)
    # Two members are compared already.
    rest = starred.where("node <> c_node AND m > 2").join(labels, "node", "left").select(
        "key", "node", "n", "place", F.coalesce("label", "node").alias("label"))
    more = stored(cross_pairs(rest, points, percent).join(pairs, ["a", "b"], "left_anti"), "cross")
    _, found = compared(rows, nodes, more, sets, size, percent)
    return components(links.union(found))


def compared(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, known: DataFrame | None, size: int,
              percent: int) -> tuple[DataFrame, DataFrame]:
    """Sets of all nodes compared so far, and the pairs that are links."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    if known is not None:
        wanted = stored(wanted.join(known.select("node"), "node", "left_anti"), "wanted")
    if known is None or not wanted.isEmpty():
        sets = sets_of(rows, nodes.select("node", "doc_id", "text_hash").join(wanted, "node", "left_semi"), size)
        known = sets if known is None else known.unionByName(sets)
    return known, stored(verified(pairs, known, percent), "links")


def jaccard_join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Rows link when their sets of ``size``-word shingles (A-Z lower-cased; fewer words make one
    shingle) overlap in at least ``percent`` % of their union; component_id is the least doc_id
    that links reach, the row's own included. Null and empty texts, and texts without words, have no
    shingles and are linked with nothing. Rows that repeat a doc_id are judged by their own text. A
    null doc_id names a component only if all its rows have none. Other columns are ignored. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    run, fields = _prints(size, percent)
    prints = stored(rows.mapInArrow(run, fields).withColumn("row", F.monotonically_increasing_id()), "prints")
    classes = stored(prints.where("n > 0").groupBy("d1", "d2").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
    nodes = stored(prints.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(
        F.col("row").alias("node"), "n", "doc_id", "text_hash", "prefix", "point"), "nodes")
    let_go(docs.sparkSession)
    labels = joined_components(rows, nodes, size, percent)
    linked = classes.join(labels, "node")
    least = linked.groupBy("label").agg(F.min("least").alias("component"))
    named = stored(classes.join(linked.select("node", "label"), "node", "left").join(least, "label", "left").select(
        "d1", "d2", F.coalesce("component", "least").alias("component")), "named")
    return prints.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
