"""Word shingle sets of documents as Spark tables: digests, sets of chosen texts, exact comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import arrow_rows, chunked, let_slot_go, row_slices, stored, trim_worker
from quillflow.llm.sieves import passes, sieve
from quillflow.llm.words import mix, shingles, word_hashes

_U = np.uint64
_SALT = _U(0x9E3779B97F4A7C15)
# Sets of this size or more are compared by fine counts first; the groups of these at most.
FINE_FROM, MOST_GROUPS = 512, 2048


def set_digests(items: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a sorted set, as signed integers."""
    place = mix(np.arange(1, len(items) + 1, dtype=np.uint64) * _SALT)
    mixed, n = mix(items ^ place), _U(len(items))
    lanes = np.array([mixed.sum(dtype=np.uint64) + n, (mixed * (place | _U(1))).sum(dtype=np.uint64) ^ n])
    first, second = mix(lanes).view(np.int64).tolist()
    return first, second


def set_rows(batch: pa.RecordBatch, size: int, *columns: str) -> Iterator[tuple]:
    """(sorted shingle hashes of the text, values of ``columns``) for the rows of a batch with a text."""
    for chunk in chunked(arrow_rows(batch, *columns)):
        words, first = word_hashes([row[0] for row in chunk])
        for i, row in enumerate(chunk):
            yield (shingles(words[first[i]:first[i + 1]], size), *row[1:])


def picked(rows: DataFrame, places: DataFrame, size: int, values: Callable, fields: str) -> DataFrame:
    """(node, *fields): ``values(items)`` for the shingle set of one text of each row of ``places``
    (node, doc_id, text_hash); ``rows``: (doc_id, text, text_hash).

    A sieve of the wanted places picks the texts where they are read, so texts aren't shuffled. Rows that
    repeat doc_id and text count once.
    """
    key = lambda doc_id: F.coalesce(doc_id, F.lit(0)).alias("want_id")
    wanted = places.select("node", key(F.col("doc_id")), F.col("text_hash").alias("want_hash"))
    mark = F.xxhash64("want_id", "want_hash").alias("mark")
    shared = rows.sparkSession.sparkContext.broadcast(sieve(wanted.select(mark.alias("key"))))
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    names = [f.split() for f in fields.split(", ")]
    schema = pa.schema([("want_id", pa.int64()), ("want_hash", pa.int64()), *((n, kinds[k]) for n, k in names)])

    def run(batches) -> Iterator[pa.RecordBatch]:
        let_slot_go("vocabulary")
        for batch in batches:
            maybe = batch.filter(pa.array(passes(shared.value, batch.column(3).to_numpy())))
            for part in row_slices(maybe, 1024):
                found = [(*at, *values(items)) for items, *at in set_rows(part, size, "want_id", "want_hash")]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
        trim_worker()

    keys = ["want_id", "want_hash"]
    texts = rows.select("text", key(F.col("doc_id")), F.col("text_hash").alias("want_hash")).select("text", *keys, mark)
    out = texts.mapInArrow(run, f"want_id long, want_hash long, {fields}").join(wanted, keys)
    # Copies of a row already lie together after the join.
    return out.dropDuplicates([*keys, "node"]).select("node", *(n for n, _ in names))


def sets_of(rows: DataFrame, places: DataFrame, size: int, purpose: str = "sets") -> DataFrame:
    """(node, items): the shingle sets of ``places`` (node, doc_id, text_hash); written."""
    return stored(picked(rows, places, size, lambda items: (items.view(np.int64),), "items array<long>"), purpose)


def fine_counts(items: np.ndarray) -> bytes:
    """Counts of a large set's hashes in a power of two of groups, a byte each: a few hashes a group up to ``MOST_GROUPS``."""
    groups = min(1 << max(0, len(items) // 4 - 1).bit_length(), MOST_GROUPS)
    counts = np.bincount((items & (groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_reach(left: bytes, right: bytes, n: int, m: int, percent: int) -> bool:
    """Whether the fine counts of sets of n and m hashes allow ``percent`` % (or bound nothing)."""
    a, b = (np.frombuffer(x, np.uint8) for x in (left, right))
    if (a == 255).any() or (b == 255).any():
        return True
    groups = min(len(a), len(b))
    a, b = (x.reshape(-1, groups).sum(axis=0, dtype=np.int64) for x in (a, b))
    return (100 + percent) * int(np.minimum(a, b).sum()) >= percent * (n + m)


def _fine_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in row_slices(batch):
            lists = part.column(1)
            keys, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            fine = [fine_counts(keys[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(fine, pa.binary())], names=["node", "n", "fine"])


def _finely_bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) but those of two large sets whose fine counts rule the limit out; written.

    The coarse counts of many groups of large sets are alike whatever is in them, and a large set is
    what makes a pair expensive to join.
    """
    large = stored(sets.where(F.size("items") >= FINE_FROM).select("node", "items").mapInArrow(
        _fine_points, "node long, n long, fine binary"), "fine")
    one = lambda name: large.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("fine").alias(f"f_{name}"))
    both = pairs.join(one("b"), "b", "left").join(one("a"), "a", "left").select("a", "b", "n_a", "n_b", "f_a", "f_b")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                n, m, left, right = (part.column(i).to_pylist() for i in range(2, 6))
                fits = [x is None or y is None or may_reach(x, y, i, j, percent) for i, j, x, y in zip(n, m, left, right)]
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(fits, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return stored(both.mapInArrow(run, "a long, b long"), "near")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap in at least ``percent`` % of their union."""
    pairs = _finely_bounded(pairs, sets, percent)
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - both
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * union).select("a", "b")
