"""Near-duplicate documents: fast similarity sketches, banding, verification on full shingle sets.

A sketch has ``COORDINATES`` bins. In round i below that number every shingle falls into one random
bin with a random value; in the rounds after, round ``COORDINATES`` + j puts every shingle into bin
j. A bin keeps the least (round, value). So every bin fills, even for one shingle, and the
number of equal bins of two sketches is concentrated around similarity * ``COORDINATES``.

Documents with the same shingle set are one *node* from the start. Two nodes that share a band
(``ROWS`` consecutive bins) are candidates: at similarity 0.8 a pair misses all 40 bands of 5 with
a probability below 2e-7. Candidates are not expanded into all pairs of a bucket. First the least
node of each bucket is compared with the others. Buckets that then lie within one component are
done. The nodes of the others meet again by their rarest shingles: of a set of n, two sets of
similarity 0.8 share one of the n - ceil(0.8 n) + 1 rarest, while text that many documents share is
never rare. Again the least node of each bucket is compared first; then all pairs of different
components are found whose summed counts by shingle group, and the place of the shingle where they
meet, allow the limit (``count_tree.cross_pairs``), before any set is joined. Every candidate pair is
thus compared, already connected, or proven to lie below the limit, so no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillflow.llm.common import fresh, let_go, let_slot_go, stored, trim_worker
from quillflow.llm.components import components
from quillflow.llm.count_tree import bounded, compared, count_vector, cross_pairs
from quillflow.llm.shingle_sets import set_digests, set_rows, sets_of
from quillflow.llm.words import mix

BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
_U = np.uint64
_SALT = _U(0x9E3779B97F4A7C15)
_VALUE_BITS = _U(52)


def sketch(items: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes."""
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    n, done = len(items), 0
    need = int(np.ceil(size * (np.log(size) + 3) / n))  # rounds that fill all bins of most sets
    while done < 2 * size:
        count = max(1, min(need, 2 * size - done, 200_000 // n + 1))
        rounds = np.arange(done, done + count, dtype=np.uint64)[:, None]
        hashes = mix(items[None, :] ^ mix(rounds * _SALT + _U(1)))
        bins = np.where(rounds < _U(size), hashes % _U(size), rounds - _U(size) * (rounds >= _U(size)))
        # The round in the high bits: an earlier round always wins.
        values = (rounds << _VALUE_BITS) | (hashes >> (_U(64) - _VALUE_BITS))
        np.minimum.at(out, bins.ravel().astype(np.int64), values.ravel())
        done += count
        if (out >> _VALUE_BITS < _U(done)).all():
            break
        need = max(1, need // 2)
    return out


def band_keys(coordinates: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = coordinates.reshape(bands, -1)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * _SALT)
    for k in range(parts.shape[1]):
        key = mix(key ^ (parts[:, k] * _SALT))
    return key.view(np.int64)


def _fingerprints(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()),
                        ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("point", pa.binary())])

    def run(batches):
        let_slot_go("vocabulary")
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for items, doc_id, text_hash in set_rows(batch, size, "doc_id", "text_hash"):
                rest = (*set_digests(items), band_keys(sketch(items)), count_vector(items)) if len(items) else (None,) * 4
                for held, value in zip(columns, (doc_id, text_hash, len(items), *rest)):
                    held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        trim_worker()

    return run, "doc_id long, text_hash long, n long, d1 long, d2 long, bands array<long>, point binary"


def _judged(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n, label, component) of every row; label and component are null without shingles."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    run, fields = _fingerprints(size)
    prints = stored(rows.mapInArrow(run, fields).withColumn("row", F.monotonically_increasing_id()), "prints")
    # One row per distinct shingle set; a row of it stands for it.
    classes = stored(prints.where("n > 0").groupBy("d1", "d2").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
    nodes = stored(prints.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(
        F.col("row").alias("node"), "n", "doc_id", "text_hash", "bands", "point"), "nodes")
    linked = classes.join(_linked(rows, nodes, size, percent), "node")
    least = linked.groupBy("label").agg(F.min("least").alias("component"))
    named = stored(classes.join(linked.select("node", "label"), "node", "left").join(least, "label", "left").select(
        "d1", "d2", F.coalesce("label", "node").alias("label"), F.coalesce("component", "least").alias("component")), "named")
    return prints.select("doc_id", "text_hash", "n", "d1", "d2").join(named, ["d1", "d2"], "left").drop("d1", "d2")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents whose sets of ``size``-word shingles (A-Z lower-cased) overlap in at least
    ``percent`` % of their union are linked; component_id is the least doc_id that links reach.
    Null and empty texts have no shingles and are linked with nothing. Rows that repeat a doc_id
    are judged by their own text and share the decision when the text is the same. A null doc_id
    is never a component's name unless all its rows have none. Other columns are ignored.
    An empty table gives an empty result.
    """
    name = F.coalesce("component", "doc_id")
    return _judged(docs, size, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (a null one last); of rows that
    repeat it, that of the least text hash. Rows without shingles all stay."""
    judged = stored(_judged(docs, size, percent), "judged")
    winner, text_hash, nth = fresh(docs, "winner_id", "winner_hash", "nth")
    key = lambda doc_id: F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("w")
    kept = judged.where("n > 0").groupBy("label").agg(first).select(
        key(F.col("w.doc_id")).alias(winner), F.col("w.text_hash").alias(text_hash), F.lit(True).alias(nth))
    empty = judged.where("n = 0").select(
        key(F.col("doc_id")).alias(winner), F.col("text_hash").alias(text_hash), F.lit(False).alias(nth)).distinct()
    rows = docs.join(kept.unionByName(empty), (key(docs["doc_id"]) == F.col(winner)) & (F.xxhash64(docs["text"]) == F.col(text_hash)))
    once = Window.partitionBy(winner, text_hash).orderBy(F.lit(1))
    single = rows.where(F.col(nth)).withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1)
    return single.drop(winner, text_hash, nth).unionByName(rows.where(~F.col(nth)).drop(winner, text_hash, nth))


def _linked(rows: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Components of the nodes that have a link."""
    banded = nodes.select("node", "n", F.explode("bands").alias("key"), F.lit(1).cast("long").alias("place"))
    starred = _starred(banded, "members")
    pairs = stored(bounded(_first_pairs(starred, percent), nodes, percent), "pairs")
    let_go(rows.sparkSession)
    sets, links = compared(rows, nodes, pairs, None, size, percent)
    rest = _unfinished(starred, components(links))
    open_ = stored(rest.select("node", "n", "label").distinct(), "open")
    sets = sets.unionByName(_more_sets(rows, nodes, open_, sets, size))
    # The nodes of unfinished buckets meet again by rare shingles.
    again = _starred(_rare_members(open_, sets, percent), "rare")
    more = stored(bounded(_first_pairs(again.join(open_.select("node", "label"), "node").join(
        open_.select(F.col("node").alias("c_node"), F.col("label").alias("c_label")), "c_node").where("label <> c_label"), percent)
        .join(pairs, ["a", "b"], "left_anti"), nodes, percent), "pairs")
    _, found = compared(rows, nodes, more, sets, size, percent)
    links = links.union(found)
    labels = components(links)
    members = again.where("node <> c_node AND m > 2").join(labels, "node", "left").select(
        "key", "node", "n", "place", F.coalesce("label", "node").alias("label"))
    last = stored(cross_pairs(members, nodes, percent).join(pairs.union(more), ["a", "b"], "left_anti"), "cross")
    _, found = compared(rows, nodes, last, sets, size, percent)
    return components(links.union(found))


def _starred(members: DataFrame, purpose: str) -> DataFrame:
    """Members (key, node, n, place) of keys that several nodes have, beside the least of them; written."""
    centres = members.groupBy("key").agg(F.min(F.struct("node", "n", "place")).alias("c"), F.count("*").alias("m")).where(
        "m > 1").select("key", *(F.col("c")[c].alias(f"c_{c}") for c in ("node", "n", "place")), "m")
    return stored(members.join(centres, "key"), purpose)


def _first_pairs(starred: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of centres and members that may reach the limit by what comes after their meeting place."""
    return starred.where(
        f"node <> c_node AND {100 + percent} * (1 + least(n - place, c_n - c_place)) >= {percent} * (n + c_n)").select(
        F.col("c_node").alias("a"), F.col("node").alias("b")).distinct()


def _more_sets(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    missing = wanted.select("node").join(sets.select("node"), "node", "left_anti")
    return sets_of(rows, nodes.select("node", "doc_id", "text_hash").join(missing, "node", "left_semi"), size)


def _rare_members(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The nodes (node, n) by those of their rarest shingles that a partner must share one of."""
    items = stored(sets.join(nodes.select("node"), "node", "left_semi").select(
        "node", F.explode("items").alias("key")), "items")
    often = items.groupBy("key").agg(F.count("*").alias("df"))
    place = Window.partitionBy("node").orderBy("df", "key")
    ranked = items.join(stored(often, "often"), "key").withColumn("place", F.row_number().over(place).cast("long"))
    return ranked.where("df > 1").join(nodes.select("node", "n"), "node").where(
        f"place <= n - ceil({percent} * n / 100) + 1").select("key", "node", "n", "place")


def _unfinished(starred: DataFrame, labels: DataFrame) -> DataFrame:
    """Members beside the centres of the buckets that still hold more than one component."""
    now = stored(starred.where("node <> c_node AND m > 2").join(labels, "node", "left").select(
        "key", "node", "n", F.coalesce("label", "node").alias("label")), "members")
    open_ = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return now.join(open_.select("key"), "key", "left_semi")
