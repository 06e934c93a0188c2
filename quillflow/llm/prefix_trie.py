"""Prefix trie of conversations, built as burst tries.

A conversation is its sequence of turns; a turn counts by role and text. A prefix is named by two
64-bit lanes, the exclusive or of one hash per (place, turn), so its name follows from that of the prefix
one turn shorter. Conversations are dealt by ranges of (conv_id, turn), so a long one spans many
tasks; what a task needs from those before it is one row per partition.

Equal conversations become one sequence with a weight. All sequences start in one *container* under
the root. A container holds the suffixes below its head; one with more than ``CONTAINER`` turns and
more than one sequence is burst: its members are dealt by their next turn ids to containers one turn
deeper. A round bursts 1, 2, 4, ... levels at once, so the number of rounds grows with the logarithm of the
depth; a member stops at the first head that is small enough. The heads on its way are nodes.

Remaining containers are gathered, sorted and swept: the rows of a container are sorted by depth and
prefix, equal neighbours become one node, and one sweep from the deepest level up adds each node to
its parent. A container of one sequence needs no gathering, however long: running sums of its turns
give its nodes. Sums over the subtree of a head follow from the owner of a node, its smallest member:
a head's subtree is what its members own from its depth on.

The SHA-256 of a list of ids is a chain; it is taken over pieces of ``LIST_BYTES`` that the tasks before
put together, so the task of a node with many ends reads few rows and holds one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillflow.llm.common import stored

# Turns that a container of several sequences may hold.
CONTAINER = 20_000
# Turns that a sweep takes at once, and bytes of one piece of a list of ids.
SWEEP_ROWS, LIST_BYTES = 100_000, 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "p1", "p2"]
_RUN_FIELDS = "conv_id long, place long, a long, b long, words long, part int, nth long, x1 long, x2 long, total long"
_NODE_FIELDS = ("depth long, p1 long, p2 long, q1 long, q2 long, owner long, n long, children long, leaves long, "
                "saved long, top boolean, parent_owner long")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, lanes and words of a conversation so far in this partition, for sorted rows
    (conv_id, place, a, b, words): the lanes are the exclusive or of a and of b."""
    part = TaskContext.get().partitionId()
    last, carried = None, (0, 0, 0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, a, b, words = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
        start = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        sizes = np.diff(start, append=len(conv))
        begin = np.repeat(start, sizes)
        sums = np.cumsum(words)
        x1, x2 = np.bitwise_xor.accumulate(a), np.bitwise_xor.accumulate(b)
        nth = np.arange(len(conv)) - begin + 1
        total = sums - (sums - words)[begin]
        x1, x2 = x1 ^ (x1 ^ a)[begin], x2 ^ (x2 ^ b)[begin]
        if conv[0] == last:
            more = slice(0, int(sizes[0]))
            nth[more] += carried[0]
            x1[more] ^= carried[1]
            x2[more] ^= carried[2]
            total[more] += carried[3]
        last, carried = conv[-1], (nth[-1], x1[-1], x2[-1], total[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(conv), part, np.int32)), *map(pa.array, (nth, x1, x2, total))],
            names=["conv_id", "place", "a", "b", "words", "part", "nth", "x1", "x2", "total"])


def _runs(sorted_rows: DataFrame, purpose: str) -> DataFrame:
    """Whole conversations' nth, x1, x2, total from those inside partitions."""
    rows = stored(sorted_rows.select("conv_id", "place", "a", "b", "words").mapInArrow(_running, _RUN_FIELDS), purpose)
    spans = rows.groupBy("conv_id", "part").agg(
        F.max(F.struct("nth", "x1", "x2", "total")).alias("s"), F.count("*").alias("rows")).select("conv_id", "part", "s.*")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(
        "conv_id", "part", F.sum("nth").over(before).alias("nth_before"), F.bit_xor("x1").over(before).alias("x1_before"),
        F.bit_xor("x2").over(before).alias("x2_before"), F.sum("total").over(before).alias("total_before")
    ).where("nth_before IS NOT NULL")
    # Only the first conversation of a partition goes on from another one: one row per partition at most.
    whole = rows.join(F.broadcast(carried), ["conv_id", "part"], "left")
    zero = F.lit(0).cast("long")
    return whole.select(
        "conv_id", "place", "a", "b", "words", (F.col("nth") + F.coalesce("nth_before", zero)).alias("nth"),
        F.col("x1").bitwiseXOR(F.coalesce("x1_before", zero)).alias("x1"),
        F.col("x2").bitwiseXOR(F.coalesce("x2_before", zero)).alias("x2"),
        (F.col("total") + F.coalesce("total_before", zero)).alias("total"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, words) of ``turns`` (conv_id, turn, role, text): the place in the
    conversation from 1 on, two hashes of role and text, the words of the text.

    A null turn comes first; equal turns are ordered by role, the first 64 characters of the text and
    a hash of it. Null role and text are empty. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.lit(0).cast("long").alias("place"), role.alias("role"), F.substring(text, 1, 64).alias("start"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "start", "a", "b"]
    dealt = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", "start").sortWithinPartitions(*order)
    return stored(_runs(dealt, "turns").select("conv_id", F.col("nth").alias("place"), "a", "b", "words"), "numbered")


def prefix_trie(turns: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The nodes of the trie of all conversations of ``turns`` (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256; see ``trie``. Ties, nulls and rows without conv_id as in ``numbered``; other columns
    are ignored and an empty table has no nodes, not even a root.
    """
    rows = numbered(turns)
    return trie(rows, rows.where("place = 1").select("conv_id"), container)


def _sequences(prefixes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each member ends, and one sequence (seq, weight, length, words in it) per distinct end."""
    none = members.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in (*NODE, "total")))
    ends = stored(prefixes.select("conv_id", *NODE, "total").unionByName(none).groupBy("conv_id").agg(
        F.max(F.struct(*NODE, "total")).alias("end")).select("conv_id", "end.*"), "ends")
    sequences = stored(ends.groupBy(*NODE).agg(
        F.min("conv_id").alias("seq"), F.count("*").alias("weight"), F.first("total").alias("whole")).select(
        "seq", "weight", F.col("depth").alias("length"), "whole"), "sequences")
    return ends, sequences


def _burst(rows: DataFrame, sequences: DataFrame, container: int) -> tuple[DataFrame, DataFrame]:
    """Heads (node, q1, q2, owner, n, words) and, per sequence, the head of its container:
    (seq, head, c1, c2, alone)."""
    zero = F.lit(0).cast("long")
    size = sequences.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), zero).alias("turns")).first()
    root = sequences.groupBy().agg(F.min("seq").alias("owner"), F.sum("weight").alias("n")).where("n > 0").select(
        *(zero.alias(c) for c in (*NODE, "q1", "q2")), "owner", "n", zero.alias("words"))
    if size["turns"] <= container or size["n"] <= 1:
        return stored(root, "heads"), sequences.select(
            "seq", zero.alias("head"), zero.alias("c1"), zero.alias("c2"), F.lit(size["n"] <= 1).alias("alone"))
    heads, stopped, open_, base, step = [root], [], rows, 0, 1
    # A member without turns ends at the root, above all containers.
    stopped.append(sequences.where("length = 0").select(
        "seq", zero.alias("head"), zero.alias("c1"), zero.alias("c2"), F.lit(True).alias("alone")))
    while True:
        near = open_.where(F.col("depth") <= base + step)
        found = stored(near.groupBy(*NODE, "q1", "q2").agg(
            F.min("seq").alias("owner"), F.sum("weight").alias("n"), F.first("words").alias("words"),
            F.count("*").alias("members"), F.sum(F.col("length") - F.col("depth")).alias("turns")), "found")
        large = (F.col("turns") > container) & (F.col("members") > 1)
        placed = near.join(found.select(*NODE, "members", large.alias("large")), NODE)
        # The first head on the way that needs no bursting; none: the member goes on below this round.
        stop = F.min(F.when(~F.col("large"), F.struct(F.col("depth").alias("head"), F.col("p1").alias("c1"),
                                                      F.col("p2").alias("c2"), (F.col("members") == 1).alias("alone"))))
        stops = stored(placed.groupBy("seq").agg(stop.alias("stop"), F.max("length").alias("length")), "stops")
        heads.append(found.join(stops.select(F.col("seq").alias("owner"), "stop"), "owner").where(
            "stop IS NULL OR depth <= stop.head").select(*NODE, "q1", "q2", "owner", "n", "words"))
        stopped.append(stops.where("stop IS NOT NULL").select("seq", "stop.*"))
        # One that ends where all heads were burst has no turns left for a container.
        zeros = stops.where(F.col("stop").isNull() & (F.col("length") <= base + step))
        stopped.append(zeros.select("seq", F.col("length").alias("head"), zero.alias("c1"), zero.alias("c2"),
                                    F.lit(True).alias("alone")))
        more = stops.where(F.col("stop").isNull() & (F.col("length") > base + step)).select("seq")
        if more.isEmpty():
            break
        base += step
        step *= 2
        open_ = stored(open_.where(F.col("depth") > base).join(more, "seq", "left_semi"), "open")
    every, places = heads[0], stopped[0]
    for more in heads[1:]:
        every = every.unionByName(more)
    for more in stopped[1:]:
        places = places.unionByName(more)
    return stored(every, "heads"), stored(places, "places")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole containers from rows sorted by (head, c1, c2, depth, p1, p2)."""
    names = ("head", "c1", "c2", "depth", "p1", "p2", "q1", "q2", "seq", "weight", "words")
    schema = pa.schema([(f.split()[0], pa.bool_() if f.endswith("boolean") else pa.int64()) for f in _NODE_FIELDS.split(", ")])

    def swept(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        size = len(rows["seq"])
        new = np.ones(size, bool)
        new[1:] = False
        for name in names[:6]:
            new[1:] |= rows[name][1:] != rows[name][:-1]
        first = np.flatnonzero(new)
        node = np.cumsum(new) - 1
        edge = np.ones(size, bool)
        edge[1:] = (rows["head"][1:] != rows["head"][:-1]) | (rows["c1"][1:] != rows["c1"][:-1]) | (rows["c2"][1:] != rows["c2"][:-1])
        box = np.cumsum(edge)
        # The turn before, of the same sequence in the same container, lies in the parent.
        order = np.lexsort((rows["depth"], rows["seq"], box))
        parent = np.full(len(first), -1)
        inner = rows["depth"][order] > rows["head"][order] + 1
        parent[node[order[1:]][inner[1:]]] = node[order[:-1]][inner[1:]]
        n = np.add.reduceat(rows["weight"], first)
        owner = np.minimum.reduceat(rows["seq"], first)
        depth = rows["depth"][first]
        saved = (n - 1) * rows["words"][first]
        children = np.bincount(parent[parent >= 0], minlength=len(first))
        leaves = (children == 0).astype(np.int64)
        level = np.argsort(-depth, kind="stable")
        for at in np.split(level, np.flatnonzero(np.diff(-depth[level])) + 1):
            at = at[parent[at] >= 0]
            np.add.at(leaves, parent[at], leaves[at])
            np.add.at(saved, parent[at], saved[at])
        top = parent < 0
        return pa.RecordBatch.from_arrays([
            *(pa.array(rows[c][first]) for c in ("depth", "p1", "p2", "q1", "q2")), pa.array(owner), pa.array(n),
            pa.array(children.astype(np.int64)), pa.array(leaves), pa.array(saved), pa.array(top),
            pa.array(owner[parent], mask=top)], schema=schema)

    held: list[dict[str, np.ndarray]] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({name: batch.column(i).to_numpy() for i, name in enumerate(names)})
        count += batch.num_rows
        if count >= SWEEP_ROWS:
            rows = {name: np.concatenate([h[name] for h in held]) for name in names}
            last = np.flatnonzero((rows["head"] != rows["head"][-1]) | (rows["c1"] != rows["c1"][-1]) | (rows["c2"] != rows["c2"][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield swept({name: rows[name][:cut] for name in names})
            held, count = [{name: rows[name][cut:] for name in names}], len(rows["seq"]) - cut
    if count:
        yield swept({name: np.concatenate([h[name] for h in held]) for name in names})


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the nodes at which conversations end."""
    def pieces(batches):
        key, ids, size = None, [], 0

        def piece():
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64()) for v in (*key, ids[0])] + [pa.array([",".join(map(str, ids))])],
                names=[*NODE, "first", "ids"])

        for batch in batches:
            for *node, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if ids and (node != key or size >= LIST_BYTES):
                    yield piece()
                    ids, size = [], 0
                key = node
                ids.append(conv)
                size += len(str(conv)) + 1
        if ids:
            yield piece()

    def hashed(batches):
        key, digest, done = None, None, [[], [], [], []]

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in done[:3]] + [pa.array(done[3], pa.string())],
                                             names=[*NODE, "ends_sha256"])
            for column in done:
                column.clear()
            return out

        def add():
            for column, value in zip(done, (*key, digest.hexdigest())):
                column.append(value)

        for batch in batches:
            for *node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if node != key:
                    if key is not None:
                        add()
                    key, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(done[0]) >= 10_000:
                yield rows()
        if key is not None:
            add()
        yield rows()

    fields = "depth long, p1 long, p2 long"
    parts = stored(ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(
        *NODE, "conv_id").mapInArrow(pieces, f"{fields}, first long, ids string"), "lists")
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, f"{fields}, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, place, a, b, words; places from 1 without gaps).

    ``members`` (conv_id) names every conversation once, those without turns included. A node stands
    for a distinct sequence of first turns: conv_id, the smallest conversation that starts with it;
    depth; parent_conv_id (null for the root); n_convs, all of these; n_children; n_leaves, childless nodes in its
    subtree; saved_tokens, the sum over its subtree of (n_convs - 1) * words of the last turn;
    ends_sha256, the hash of the ascending ids, joined by commas, of those that end there.
    """
    hashed = turns.select("conv_id", "place", F.xxhash64("a", "b", "place").alias("a"),
                          F.xxhash64("place", "b", "a").alias("b"), "words")
    dealt = hashed.repartitionByRange("conv_id", "place").sortWithinPartitions("conv_id", "place")
    prefixes = stored(_runs(dealt, "prefix_runs").select(
        "conv_id", F.col("place").alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
        F.col("x1").bitwiseXOR(F.col("a")).alias("q1"), F.col("x2").bitwiseXOR(F.col("b")).alias("q2"), "words", "total"), "prefixes")
    ends, sequences = _sequences(prefixes, members)
    rows = stored(prefixes.withColumnRenamed("conv_id", "seq").join(sequences, "seq"), "rows")
    heads, places = _burst(rows, sequences, container)

    # Below the heads: containers of one sequence from running sums, all others by a sweep.
    hung = stored(rows.join(places, "seq").where("depth > head"), "hung")
    alone = hung.where("alone").select(
        *NODE, "q1", "q2", F.col("seq").alias("owner"), F.col("weight").alias("n"),
        (F.col("depth") < F.col("length")).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
        ((F.col("weight") - 1) * (F.col("whole") - F.col("total") + F.col("words"))).alias("saved"),
        (F.col("depth") == F.col("head") + 1).alias("top"),
        F.when(F.col("depth") > F.col("head") + 1, F.col("seq")).alias("parent_owner"))
    gathered = hung.where("NOT alone").select(
        "head", "c1", "c2", *NODE, "q1", "q2", "seq", "weight", "words").repartition("head", "c1", "c2")
    swept = gathered.sortWithinPartitions("head", "c1", "c2", *NODE).mapInArrow(_sweep, _NODE_FIELDS)
    below = stored(alone.unionByName(swept), "below")

    # Heads: what lies below each, then sums over subtrees by the owners of nodes.
    child = below.where("top").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"),
                                      "leaves", "saved").unionByName(
        heads.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"),
                                        F.col("q2").alias("p2"), *(F.lit(0).cast("long").alias(c) for c in ("leaves", "saved"))))
    sums = child.groupBy(*NODE).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    own = stored(heads.join(sums, NODE, "left").select(
        *NODE, "q1", "q2", "owner", "n", F.coalesce("children", F.lit(0)).cast("long").alias("children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"),
        ((F.col("n") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved")), "own")
    way = rows.join(places.select("seq", "head"), "seq").where("depth <= head").select("seq", *NODE).unionByName(
        sequences.select("seq", *(F.lit(0).cast("long").alias(c) for c in NODE)))
    owned = own.select(F.col("owner").alias("seq"), "depth", "leaves", "saved")
    down = Window.partitionBy("seq").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    subtree = way.join(owned, ["seq", "depth"], "left").select(
        *NODE, F.sum("leaves").over(down).alias("leaves"), F.sum("saved").over(down).alias("saved")).groupBy(*NODE).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = heads.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                         F.col("owner").alias("parent_owner"))
    up = ["depth", "q1", "q2"]
    columns = [*NODE, "owner", "n", "children", "leaves", "saved", "parent_owner"]
    nodes = own.drop("leaves", "saved").join(subtree, NODE).join(above, up, "left").select(*columns)
    nodes = nodes.unionByName(below.where("top").drop("parent_owner").join(above, up, "left").select(*columns))
    nodes = nodes.unionByName(below.where("NOT top").select(*columns))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(_digests(ends), NODE, "left").select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations (rows of ``numbered``) that share first turns: c starts with the first h turns of
    c - c % ``group`` (all if it has fewer, none if it isn't there), h = crc32(c) % ``most``, and goes on
    with its own turns after its first h."""
    members = turns.where("place = 1").select("conv_id")
    starts = turns.where(F.col("place") < most).groupBy(F.col("conv_id").alias("base")).agg(
        F.collect_list(F.struct("place", "a", "b", "words")).alias("starts"))  # at most ``most`` - 1 turns
    taken = F.crc32(F.col("conv_id").cast("string")) % most
    plan = stored(members.withColumn("h", taken).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(
        starts, "base", "left").select("conv_id", "h", F.coalesce(
            F.filter("starts", lambda s: s["place"] <= F.col("h")), F.array().cast(starts.schema["starts"].dataType)).alias("shared")), "plan")
    first = plan.select("conv_id", F.inline("shared"))
    own = turns.join(plan.select("conv_id", "h", F.size("shared").alias("shared")), "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("shared")).cast("long").alias("place"), "a", "b", "words")
    return stored(first.unionByName(own), "rebuilt")
