"""Language model scores: a probabilistic suffix tree over words, whose root is the base score's unigram.

Tokens are words (A-Z lower-cased) and one end per text. A state is a context of 0 to ``DEPTH`` words that
precede a token. From the training documents

* a context is considered when it occurs at least ``MIN_COUNT`` times;
* its next words are kept from ``MIN_NEXT`` occurrences on; all other next words are one leftover mass;
* it is retained when its next words diverge from those of its suffix (one word shorter): the
  Kullback-Leibler divergence is at least ``DIVERGENCE`` nats and significant for its count, or when a
  longer retained context ends in it;
* P(w | s) = (n(s w) + (leftover(s) + PRIOR) * P(w | suffix of s)) / (n(s) + PRIOR), n(s w) = 0 where it
  isn't kept; P(w) of the root is (c + 1) / (N + V + 1). Each state's probabilities sum to the root's.

A token is scored in the longest retained context that ends before it. All counts are absolute, so the
tree grows with the corpus: it stays in written tables, one row per context and per kept next word.

A kept next word of s is kept in the suffix of s, too, and the suffix of a retained context is retained.
So the score is a sum of effects that are looked up one by one: log10(c + 1) of each token, the
back-off weight (leftover + PRIOR) / (n + PRIOR) of each retained context before it, and for each kept
next word what it adds to that. Those that occur ``HOT_FROM`` times or more, the ``HOT_WORDS`` most frequent
words and ``HOT_EFFECTS`` others at most, are broadcast. What is rarer is looked up where it lies: keys are dealt into buckets, a bucket's task has
its rare effects and every (key, document) that asks for one of them. These bounds and the sieves (Bloom
filters of a bounded size) decide where an effect is added, never whether.

Counts and look-ups go through shuffles as arrays of a bucket's keys (``bytes`` columns), sorted so that
a context is written once for its next words; as rows of their own they took more than twice the disk.

Words are told apart by 64-bit hashes; a sequence of words has the exclusive or of its words' hashes,
rotated by their distance: ``key`` = word ^ ctx.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type as to_spark

from quillflow.llm.common import arrow_rows, chunked, dropped, least_count, let_go, small_batches, stored
from quillflow.llm.sieves import passes, sieve
from quillflow.llm.words import mix, word_hashes

DEPTH = 3
MIN_COUNT, MIN_NEXT = 50, 2
DIVERGENCE = 0.02
PRIOR = 4.0
FOLDS, HELD_OUT = 7, 2
# What occurs so often is broadcast (rarer ones cost less to look up than a copy in every worker), and at most so many
# words and other effects.
HOT_FROM = 8
HOT_WORDS, HOT_EFFECTS = 1_000_000, 2_500_000
ROTATE = 7
# Counts or look-ups that a task gathers before it passes them on.
HELD_ROWS = 500_000
# Tokens of the corpus for a bucket of counts (a task holds one) and for one of look-ups (a task holds its rare effects).
COUNT_TOKENS, LOOK_TOKENS = 2_000_000, 16_000_000
# Look-ups in a row, so that a batch of rows is of a bounded size.
ASKED = 256
_END_HASH = int(mix(np.array([0xE0F], np.uint64)).view(np.int64)[0])
_SCORES = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
    ("n_known", pa.int64()), ("base", pa.float64()), ("gain", pa.float64())])
# What meets in a bucket of look-ups: scores so far (row to gain), rare effects (keys, values), and documents that ask
# for them (keys, rows from ``row`` on; a row has the task's number from bit 33 on). ``kind``: 0 scores, else below.
_WORD, _EFFECT, _ASK = 1, 2, 4
_DEALT = pa.schema([*_SCORES, ("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("rest", pa.binary())])
# Scores so far as rows, and answers: one row (its ``row`` is the task's first) with the sums of many of a task's documents.
_SUMS = pa.schema([*_SCORES, ("bucket", pa.int32()), ("sums", pa.binary())])
_COUNTS = pa.schema([("bucket", pa.int32()), ("ctxs", pa.binary()), ("runs", pa.binary()), ("keys", pa.binary()),
                     ("ns", pa.binary())])


def token_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and where each text begins (one more entry at the end)."""
    words, first = word_hashes(texts)
    at = np.arange(len(words)) + np.repeat(np.arange(len(texts)), np.diff(first))
    tokens = np.full(len(words) + len(texts), _END_HASH, np.int64)
    tokens[at] = words.view(np.int64)
    return tokens, first + np.arange(len(first))


class SuffixTree:
    """A whole tree in arrays, for a look at small corpora; scores come from the written tables.

    Node 0 is the empty context. Words are indexes into ``listed``; ``gain_keys`` are (node, word).
    """

    def __init__(self, words: DataFrame, tokens: int, vocabulary: int, levels: list[Level]):
        read = lambda df: [c.to_numpy() for c in df.toArrow().columns]
        hashes, counts = read(words.select("key", "n"))
        order = np.argsort(hashes)
        self.listed, self.counts = hashes[order], counts[order]
        self.tokens, self.vocabulary = tokens, vocabulary
        self.contexts = np.zeros(1, np.int64)
        self.retained, self.parent, self.backoff = np.ones(1, bool), np.zeros(1, np.int64), np.zeros(1)
        keys, gains = [np.empty(0, np.int64)], [np.empty(0)]
        for level in levels:
            contexts, suffix, backoff, retained = read(level.nodes.select("ctx", "suffix", "backoff", "retained"))
            self.parent = np.append(self.parent, self.nodes(suffix))
            self.contexts = np.append(self.contexts, contexts)
            self.backoff, self.retained = np.append(self.backoff, backoff), np.append(self.retained, retained)
            key, ctx, logp = read(level.grams.select("key", "ctx", "logp"))
            word = self.ids(key ^ ctx)
            keys.append((self.nodes(ctx) << 32) | word)
            gains.append(logp - np.log10((self.counts[word] + 1) / (tokens + vocabulary + 1)))
        order = np.argsort(np.concatenate(keys))
        self.gain_keys, self.gains = np.concatenate(keys)[order], np.concatenate(gains)[order]

    def nodes(self, contexts: np.ndarray) -> np.ndarray:
        order = np.argsort(self.contexts)
        return order[_find(self.contexts[order], contexts, -1)]

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        """Indexes of listed words; their number for any other word."""
        return _find(self.listed, tokens, len(self.listed))

    def gain(self, nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10(P(word | node) / P(word)): the kept next word of the longest suffix that has it."""
        out = np.zeros(len(nodes))
        nodes = nodes.copy()
        open_ = np.flatnonzero(nodes > 0)
        while len(open_):
            at = _find(self.gain_keys, (nodes[open_] << 32) | ids[open_], -1)
            hit = at >= 0
            out[open_[hit]] += self.gains[at[hit]]
            open_ = open_[~hit]
            out[open_] += self.backoff[nodes[open_]]
            nodes[open_] = self.parent[nodes[open_]]
            open_ = open_[nodes[open_] > 0]
        return out


class Level(NamedTuple):
    """Written contexts of one length (ctx, suffix, weight, backoff, own, retained) and their kept next
    words (key, ctx, suffix, n, own, logp, extra); ``own``: retained for its own next words, not for a longer
    context; ``extra``: logp less the suffix's logp and the backoff."""

    nodes: DataFrame
    grams: DataFrame


def _find(keys: np.ndarray, wanted: np.ndarray, missing: int) -> np.ndarray:
    """Places of ``wanted`` in the sorted ``keys``."""
    if not len(keys):
        return np.full(len(wanted), missing, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, missing)


def _merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns (key, columns that depend on it, count) with one row per key."""
    keys, *rest, counts = map(np.concatenate, zip(*held))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[first], *(c[order[first]] for c in rest), np.add.reduceat(counts[order], first)]


def _tallies(batches: Iterator[pa.RecordBatch], take: Callable, beside: int) -> Iterator[list[np.ndarray]]:
    """Columns (key, ``beside`` columns that depend on it, n) of some texts after others, one row per key in each.

    ``take(texts)`` gives the keys (a tuple of the columns with ``beside``)."""
    held: list = []
    size = 0
    for batch in batches:
        for chunk in chunked(arrow_rows(batch)):
            found = take([row[0] for row in chunk])
            keys, *rest = found if beside else (found,)
            keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
            if len(keys):
                held.append([keys, *(c[first] for c in rest), counts.astype(np.int64)])
            size += len(keys)
            if size > HELD_ROWS:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > HELD_ROWS // 2:
                    yield held[0]
                    held, size = [], 0
    if held:
        yield _merged(held)


def counted(docs: DataFrame, keys_of: Callable[[], Callable[[list[bytes]], np.ndarray]], purpose: str) -> DataFrame:
    """(key, n): how often ``keys_of()(texts)`` gives each key, over all texts; written.

    Tasks count in arrays of a bounded size before the shuffle.
    """
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for columns in _tallies(batches, keys_of(), 0):
            for a in range(0, len(columns[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a:a + 200_000]) for c in columns], schema=schema)

    return stored(docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), purpose)


def _cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of ``values`` from each edge to the next."""
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the keys as unsigned numbers."""
    return (((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _bucket_count(spark: SparkSession, tokens: int, each: int) -> int:
    """Buckets of about ``each`` tokens, one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-tokens // each))


def _dealt(rows: DataFrame, buckets: int, *order: str) -> DataFrame:
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", *order)


def _by_bucket(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[list]]:
    """For each bucket of a partition that is sorted by them: the values of these columns."""
    last, held = None, [[] for _ in columns]
    for batch in batches:
        of = batch.column("bucket").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(of)) + 1
        for a, b in zip([0, *edges], [*edges, len(of)]):
            if a == b:
                continue
            if last is not None and of[a] != last:
                yield held
                held = [[] for _ in columns]
            last = of[a]
            for to, name in zip(held, columns):
                to.extend(batch.column(name).slice(a, b - a))
    if last is not None:
        yield held


def _array(data: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(data.as_py(), kind)


def _joined(blobs: list, kind: type) -> np.ndarray:
    return np.concatenate([_array(x, kind) for x in blobs] or [np.empty(0, kind)])


def counted_grams(docs: DataFrame, grams_of: Callable[[], Callable[[list[bytes]], tuple]], least: int, buckets: int,
                  spread: np.ndarray) -> DataFrame:
    """(key, ctx, n): how often ``grams_of()(texts)`` = (keys, contexts) gives each, from ``least`` times on.

    A context's keys lie in one bucket, those of the contexts in ``spread`` (sorted) in all of them.
    """
    schema = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("n", pa.int64())])

    def pack(batches) -> Iterator[pa.RecordBatch]:
        for keys, ctx, n in _tallies(batches, grams_of(), 1):
            bucket = _bucket(np.where(_find(spread, ctx, -1) >= 0, keys, ctx), buckets)
            order = np.argsort((bucket << 40) | (ctx & ((1 << 40) - 1)))
            bucket, keys, ctx, n = bucket[order], keys[order], ctx[order], n[order]
            new = np.append(True, bucket[1:] != bucket[:-1])
            run = np.flatnonzero(new | np.append(True, ctx[1:] != ctx[:-1]))
            first = np.flatnonzero(new)
            edges, runs = np.append(first, len(keys)), np.append(np.searchsorted(run, first), len(run))
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[first].astype(np.int32)), _cut(ctx[run], runs),
                _cut(np.diff(run, append=len(keys)).astype(np.int32), runs), _cut(keys, edges),
                _cut(n.astype(np.int32), edges)], schema=_COUNTS)

    def add(batches) -> Iterator[pa.RecordBatch]:
        for ctxs, runs, keys, ns in _by_bucket(batches, "ctxs", "runs", "keys", "ns"):
            ctx = np.repeat(_joined(ctxs, np.int64), _joined(runs, np.int32))
            keys, ctx, n = _merged([[_joined(keys, np.int64), ctx, _joined(ns, np.int32).astype(np.int64)]])
            kept = np.flatnonzero(n >= least)
            for a in range(0, len(kept), 100_000):
                at = kept[a:a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (keys, ctx, n)], schema=schema)

    packed = docs.select("text").mapInArrow(pack, "bucket int, ctxs binary, runs binary, keys binary, ns binary")
    return _dealt(packed, buckets).mapInArrow(add, "key long, ctx long, n long")


def _rotated(keys: np.ndarray, by: int) -> np.ndarray:
    keys = keys.view(np.uint64)
    return ((keys << np.uint64(by)) | (keys >> np.uint64(64 - by))).view(np.int64)


def _rotated_column(key: Column) -> Column:
    return F.shiftleft(key, ROTATE).bitwiseOR(F.shiftrightunsigned(key, 64 - ROTATE))


def contexts_before(tokens: np.ndarray, first: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``depth`` words: places that so many words precede in their text, and their context's hash."""
    place = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    at, ctx = np.arange(len(tokens)), np.zeros(len(tokens), np.int64)
    for d in range(1, depth + 1):
        inside = place[at] >= d
        at = at[inside]
        ctx = ctx[inside] ^ _rotated(tokens[at - d], ROTATE * d)
        yield at, ctx


def _grams_of(shared, depth: int):
    """Next words of the contexts that pass the first sieve. What was found twice was also found twice behind
    the context one word shorter, so its shorter form passes the second sieve."""
    def start():
        bits, shorter = shared.value

        def keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            tokens, first = token_stream(texts)
            before = np.zeros(len(tokens), np.int64)
            for at, ctx in contexts_before(tokens, first, depth):
                last, before_at = before, at
                before = np.zeros(len(tokens), np.int64)
                before[at] = ctx
            maybe = passes(bits, ctx)
            at, ctx = before_at[maybe], ctx[maybe]
            maybe = passes(shorter, tokens[at] ^ last[at])
            return tokens[at[maybe]] ^ ctx[maybe], ctx[maybe]

        return keys

    return start


def fit_levels(docs: DataFrame, words: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT,
               divergence: float = DIVERGENCE, prior: float = PRIOR) -> tuple[int, int, list[Level]]:
    """Tokens, vocabulary and the written tree of ``docs`` (text) whose word counts (key, n) are ``words``."""
    spark = docs.sparkSession
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, vocabulary = size["n"], size["v"]
    root = F.log10((F.col("n") + F.lit(1.0)) / F.lit(float(tokens + vocabulary + 1)))
    shorter = words.select("key", F.lit(0).cast("long").alias("ctx"), F.lit(0).cast("long").alias("suffix"), "n",
                           root.alias("logp"))
    levels: list[Level] = []
    for d in range(1, depth + 1):
        # Every context is followed by a token, so it occurs as often as its words in a row.
        word = F.col("key").bitwiseXOR(F.col("ctx"))
        considered = shorter.where((F.col("n") >= min_count) & (word != _END_HASH))
        contexts = stored(considered.select(
            _rotated_column(F.col("key")).alias("ctx"),
            (_rotated_column(F.col("suffix").bitwiseXOR(word)) if d > 1 else F.lit(0).cast("long")).alias("suffix"),
            F.col("n").alias("weight")), f"contexts{d}")
        if contexts.isEmpty():
            break
        known = shorter if d > 1 else shorter.where(F.col("n") >= MIN_NEXT)
        shared = spark.sparkContext.broadcast((sieve(contexts.select(F.col("ctx").alias("key"))), sieve(known.select("key"))))
        buckets = _bucket_count(spark, tokens, COUNT_TOKENS)
        spread = contexts.where(F.col("weight") * (4 * buckets) >= tokens).select("ctx").toArrow().column("ctx").to_numpy()
        grams = counted_grams(docs, _grams_of(shared, d), MIN_NEXT, buckets, np.sort(spread))
        # Strangers that the sieve let through go when the nodes are joined.
        grams = grams.join(contexts.drop("weight"), "ctx") if d > 1 else grams.withColumn("suffix", F.lit(0).cast("long"))
        # The same next word of the suffix: it occurs there at least as often, so it is kept there.
        grams = stored(grams.withColumn("short", word.bitwiseXOR(F.col("suffix"))).join(
            shorter.select(F.col("key").alias("short"), F.col("logp").alias("short_logp")), "short").drop("short"), f"kept{d}")
        let_go(spark)
        q = F.pow(F.lit(10.0), F.col("short_logp"))
        sums = grams.groupBy("ctx").agg(
            F.sum("n").alias("kept"), F.count("*").alias("free"), F.sum(q).alias("q"),
            F.sum(F.col("n") * (F.log("n") - F.col("short_logp") * float(np.log(10.0)))).alias("a"))
        weight = F.col("weight").cast("double")
        leftover = F.greatest(F.col("weight") - F.coalesce("kept", F.lit(0)), F.lit(0)).cast("double")
        rest_q = F.least(F.greatest(1 - F.coalesce("q", F.lit(0.0)), F.lit(1e-12)), F.lit(1.0))
        distance = F.coalesce((F.col("a") - F.col("kept") * F.log(weight)) / weight, F.lit(0.0)) + F.when(
            leftover > 0, leftover / weight * F.log(leftover / weight / rest_q)).otherwise(0.0)
        free = F.coalesce("free", F.lit(0)).cast("double")
        nodes = stored(contexts.join(sums, "ctx", "left").select(
            "ctx", "suffix", "weight", F.log10((leftover + prior) / (weight + prior)).alias("backoff"),
            leftover.alias("leftover"),
            ((distance >= divergence) & (2 * weight * distance >= free + 4 * F.sqrt(2 * free))).alias("own")
        ).withColumn("retained", F.col("own")), f"nodes{d}")
        logp = F.log10((F.col("n") + (F.col("leftover") + prior) * q) / (weight + prior))
        shorter = stored(grams.join(nodes.select("ctx", "weight", "leftover", "backoff", "own"), "ctx").select(
            "key", "ctx", "suffix", "n", "own", logp.alias("logp"),
            (logp - F.col("short_logp") - F.col("backoff")).alias("extra")), f"next{d}")
        levels.append(Level(nodes, shorter))
        dropped(grams)
        del grams, contexts, considered, sums
        let_go(spark)
    # Whatever a retained context ends in is retained, too.
    for d in range(len(levels) - 1, 0, -1):
        used = levels[d].nodes.where("retained").select(F.col("suffix").alias("ctx")).distinct().withColumn("used", F.lit(True))
        nodes = levels[d - 1].nodes.join(used, "ctx", "left").withColumn(
            "retained", F.col("retained") | F.col("used").isNotNull()).drop("used")
        levels[d - 1] = levels[d - 1]._replace(nodes=stored(nodes, f"closed{d}"))
    return tokens, vocabulary, levels


def fit_tree(docs: DataFrame, words: DataFrame, **options) -> SuffixTree:
    """The whole tree on the driver."""
    return SuffixTree(words, *fit_levels(docs, words, **options))


def effects(levels: list[Level]) -> DataFrame | None:
    """(key, n, value) of the retained contexts (key: ctx) and of their kept next words; written."""
    found = None
    for nodes, grams in levels:
        kept = nodes.where("retained")
        later = grams.where("NOT own").join(kept.where("NOT own").select("ctx"), "ctx", "left_semi")
        rows = kept.select(F.col("ctx").alias("key"), F.col("weight").alias("n"), F.col("backoff").alias("value"))
        for part in (grams.where("own"), later):
            rows = rows.unionByName(part.select("key", "n", F.col("extra").alias("value")))
        found = rows if found is None else found.unionByName(rows)
    return found if found is None else stored(found, "effects")


def held_out(doc_id: Column) -> Column:
    """Documents kept out of training; a null doc_id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _sorted(effects: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(key, value) by key, for a table."""
    rows = effects.select("key", "value").toArrow()
    return _by_key(rows.column("key").to_numpy(), rows.column("value").to_numpy())


def _by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, with a last entry that is no key."""
    order = np.argsort(keys)
    return np.append(keys[order], (1 << 63) - 1), np.append(values[order], 0.0)


class _Table:
    """Values by key, 0 for others. Keys are hashes: their first bits tell about where one lies among the sorted."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(1, len(keys).bit_length())
        self.shift, self.half = 64 - bits, 1 << (bits - 1)
        self.start = np.cumsum(np.bincount((keys[:-1] >> self.shift) + self.half, minlength=1 << bits)).astype(np.int32)
        self.start = np.append(np.int32(0), self.start[:-1])

    def look_up(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values and whether the keys are there."""
        last = len(self.keys) - 1
        at = self.start[(wanted >> self.shift) + self.half].astype(np.int64)
        more = np.flatnonzero(self.keys[at] < wanted)
        while len(more):
            at[more] += 1
            more = more[self.keys[at[more]] < wanted[more]]
        there = (self.keys[at] == wanted) & (at < last)
        return np.where(there, self.values[at], 0.0), there


def _packed(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: small values leave runs of zeros."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unpacked(data: pa.Scalar, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(_array(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _rows(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    """A batch of these columns; the others are null."""
    return pa.RecordBatch.from_arrays([
        pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _ask(kind: int, keys: np.ndarray, rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Documents that ask for rare effects; sorted keys are passed on as differences, six bytes each."""
    order = np.argsort(keys.view(np.uint64))
    keys, rows = keys[order].view(np.uint64), rows[order]
    bucket = _bucket(keys, buckets)
    first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (np.arange(1, len(keys)) % ASKED == 0)))
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[first] = keys[first]
    base, parts = rows.min(), list(zip(first, [*first[1:], len(keys)]))
    rows = (rows - base).astype(np.uint32)
    return _rows(_DEALT, len(parts), bucket=bucket[first], kind=np.full(len(parts), kind | _ASK), row=np.full(len(parts), base),
                 keys=[_packed(steps[a:b]) for a, b in parts], rest=[_packed(rows[a:b]) for a, b in parts])


def _rare(effects: DataFrame, kind: int, buckets: int) -> DataFrame:
    """Effects (key, value) as arrays by bucket."""
    def pack(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append([batch.column(name).to_numpy() for name in ("key", "value")])
                size += batch.num_rows
            if size and (batch is None or size > HELD_ROWS):
                keys, values = map(np.concatenate, zip(*held))
                bucket = _bucket(keys, buckets)
                order = np.argsort(bucket)
                bucket = bucket[order]
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                edges = np.append(first, len(keys))
                yield _rows(_DEALT, len(first), bucket=bucket[first], kind=np.full(len(first), kind),
                            keys=_cut(keys[order], edges), rest=_cut(values[order], edges))
                held, size = [], 0

    return effects.select("key", "value").mapInArrow(pack, _ddl(_DEALT))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scores of a partition as they are, and what rare effects add to the documents that ask for them.

    A bucket's effects come before all that ask for them."""
    bucket, effects, tables = None, {}, {}
    for batch in batches:
        own = pc.equal(batch.column("kind"), 0)
        yield batch.filter(own).select(_SCORES.names)
        batch = batch.filter(pc.invert(own))
        of, kinds, base = (pc.fill_null(batch.column(name), 0).to_numpy() for name in ("bucket", "kind", "row"))
        keys, rest = batch.column("keys"), batch.column("rest")
        # The documents of one task at a time.
        task = np.where(kinds >= _ASK, base >> 33, -1)
        edges = np.flatnonzero((np.diff(of) != 0) | (np.diff(task) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(of)]):
            if a == b:
                continue
            if of[a] != bucket:
                bucket, effects, tables = of[a], {_WORD: [], _EFFECT: []}, {}
            if task[a] < 0:
                for i in range(a, b):
                    effects[kinds[i]].append((_array(keys[i], np.int64), _array(rest[i], np.float64)))
                continue
            found = []
            for kind in (_WORD, _EFFECT):
                if kind not in tables:
                    tables[kind] = _Table(*_by_key(*map(np.concatenate, zip(
                        (np.empty(0, np.int64), np.empty(0)), *effects.pop(kind)))))
                places = [i for i in range(a, b) if kinds[i] == kind | _ASK]
                wanted = [np.cumsum(_unpacked(keys[i], np.uint64), dtype=np.uint64) for i in places]
                rows = [_unpacked(rest[i], np.uint32).astype(np.int64) + (base[i] - (task[a] << 33)) for i in places]
                wanted, rows = (np.concatenate(x or [np.empty(0, np.int64)]).view(np.int64) for x in (wanted, rows))
                value, there = tables[kind].look_up(wanted)
                found.append((rows[there], value[there]))
            size = max((int(rows.max()) + 1 for rows, _ in found if len(rows)), default=0)
            known = np.bincount(found[0][0], minlength=size)
            added, gain = (np.bincount(rows, weights=values, minlength=size) for rows, values in found)
            row = np.unique(np.concatenate([rows for rows, _ in found]))
            yield _rows(_SCORES, len(row), row=row + (task[a] << 33), n_known=known[row], base=added[row], gain=gain[row])


def _grouped(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Scores as they are and answers as arrays, dealt by the task that read the documents."""
    for batch in _answers(batches):
        if not batch.num_rows:
            continue
        row = batch.column("row").to_numpy()
        task = row >> 33
        if not batch.column("n_tokens").null_count:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((task % buckets).astype(np.int32)),
                                              pa.nulls(len(row), pa.binary())], schema=_SUMS)
            continue
        known, base, gain = (batch.column(name).to_numpy() for name in ("n_known", "base", "gain"))
        sums = (row - (task << 33)).astype(np.uint32), known.astype(np.uint32), base, gain
        yield _rows(_SUMS, 1, row=task[:1] << 33, bucket=task[:1] % buckets, sums=[b"".join(map(_packed, sums))])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores with all answers added, from rows in order of ``row``; the documents of one task at a time."""
    task, held = None, []
    for batch in itertools.chain((b for b in batches if b.num_rows), [None]):
        of = batch.column("row").to_numpy() >> 33 if batch is not None else np.empty(0, np.int64)
        edges = np.flatnonzero(np.diff(of)) + 1
        for a, b in zip([0, *edges], [*edges, len(of)]):
            if held and (a == b or of[a] != task):
                yield _with_sums(pa.Table.from_batches(held))
                held = []
            if a < b:
                task = of[a]
                held.append(batch.slice(a, b - a))


def _with_sums(rows: pa.Table) -> pa.RecordBatch:
    scores = rows.filter(pc.is_valid(rows["n_tokens"])).select(_SCORES.names).combine_chunks()
    row = scores["row"].to_numpy()
    known, base, gain = (scores[name].to_numpy().copy() for name in ("n_known", "base", "gain"))
    for part in rows["sums"].drop_null():
        data = part.as_py()
        size = len(data) // 24
        at, n = (_unpacked(pa.scalar(data[k:k + 4 * size]), np.uint32).astype(np.int64) for k in (0, 4 * size))
        more, extra = (_unpacked(pa.scalar(data[k:k + 8 * size]), np.float64) for k in (8 * size, 16 * size))
        # A part has a document once.
        at = np.searchsorted(row, at + (row[0] >> 33 << 33))
        known[at] += n
        base[at] += more
        gain[at] += extra
    columns = {name: scores[name].combine_chunks() for name in ("row", "doc_id", "held_out", "n_tokens")}
    columns |= {"n_known": pa.array(known), "base": pa.array(base), "gain": pa.array(gain)}
    return pa.RecordBatch.from_pydict(columns, schema=_SCORES)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {to_spark(f.type).simpleString()}" for f in schema)


def score_texts(docs: DataFrame) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) by a model of the training documents among them.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null counts as empty: one
    token, the end. Repeated rows train repeatedly and are scored alike. Other columns are ignored.
    Without any training document nothing is known (V = N = 0). An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    training = rows.where("NOT held_out").select("text")
    small_batches(spark)
    words = counted(training, lambda: lambda texts: token_stream(texts)[0], "words")
    let_go(spark)
    total, vocabulary, levels = fit_levels(training, words)
    counts = words.select("key", "n", F.log10(F.col("n") + F.lit(1.0)).alias("value"))
    tree = effects(levels)
    tree = counts.limit(0) if tree is None else tree
    hot_word, hot_effect = (
        F.col("n") >= max(HOT_FROM, least_count(df, most)) for df, most in ((counts, HOT_WORDS), (tree, HOT_EFFECTS)))
    shared = spark.sparkContext.broadcast((
        _sorted(counts.where(hot_word)), _sorted(tree.where(hot_effect)), sieve(tree.select("key")),
        sieve(counts.where("n > 1").select("key")), len(levels)))
    # All that scores need of the tree is in the effects.
    dropped(*(step for level in levels for step in level))
    del levels
    let_go(spark)
    buckets = _bucket_count(spark, total, LOOK_TOKENS)

    def run(batches) -> Iterator[pa.RecordBatch]:
        words_of, effects_of, bits, twice, depth = shared.value
        words_of, effects_of = _Table(*words_of), _Table(*effects_of)
        row = TaskContext.get().partitionId() << 33
        held: dict[int, list] = {_WORD: [], _EFFECT: []}

        def asked(least: int) -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if sum(len(keys) for keys, _ in parts) > least:
                    yield _ask(kind, *map(np.concatenate, zip(*parts)), buckets)
                    parts.clear()

        for batch in batches:
            for chunk in chunked(arrow_rows(batch, "doc_id", "held_out")):
                tokens, first = token_stream([x[0] for x in chunk])
                lengths = np.diff(first)
                of = row + np.repeat(np.arange(len(chunk)), lengths)
                new = np.array([x[2] for x in chunk], bool)
                base, known = words_of.look_up(tokens)
                # A word of a training document that doesn't occur twice occurs once.
                at = np.flatnonzero(~known)
                once = ~passes(twice, tokens[at]) & ~np.repeat(new, lengths)[at]
                base[at[once]], known[at[once]] = np.log10(2.0), True
                at = at[~once]
                held[_WORD].append((tokens[at], of[at]))
                gain = np.zeros(len(tokens))
                # What is in the tree has its shorter forms there, too.
                inside, kept = np.ones(len(tokens), bool), np.ones(len(tokens), bool)
                for at, ctx in contexts_before(tokens, first, depth):
                    maybe = inside[at]
                    at, ctx = at[maybe], ctx[maybe]
                    maybe = passes(bits, ctx)
                    at, ctx = at[maybe], ctx[maybe]
                    inside = np.zeros(len(tokens), bool)
                    inside[at] = True
                    maybe = kept[at]
                    word_at, key = at[maybe], tokens[at[maybe]] ^ ctx[maybe]
                    maybe = passes(bits, key)
                    word_at, key = word_at[maybe], key[maybe]
                    kept = np.zeros(len(tokens), bool)
                    kept[word_at] = True
                    for place, key in ((at, ctx), (word_at, key)):
                        value, there = effects_of.look_up(key)
                        gain[place] += value
                        held[_EFFECT].append((key[~there], of[place[~there]]))
                sums = lambda values: np.add.reduceat(values, first[:-1])  # noqa: E731  every text has a token
                rows = np.arange(row, row + len(chunk))
                yield _rows(_DEALT, len(chunk), row=rows, doc_id=[x[1] for x in chunk], held_out=new, n_tokens=lengths,
                            n_known=sums(known.astype(np.int64)), base=sums(base), gain=sums(gain),
                            bucket=rows % buckets, kind=np.zeros(len(chunk), np.int32))
                row += len(chunk)
                yield from asked(HELD_ROWS)
        yield from asked(0)

    dealt = rows.mapInArrow(run, _ddl(_DEALT))
    for rest, kind in ((counts.where(~hot_word), _WORD), (tree.where(~hot_effect), _EFFECT)):
        dealt = dealt.unionByName(_rare(rest, kind, buckets))
    dealt = _dealt(dealt.withColumn("asks", F.col("kind") >= _ASK), buckets, "asks", "row").drop("asks")
    # The row of a document and what its rare effects add meet again where its task's rows are dealt to.
    sums = dealt.mapInArrow(lambda batches: _grouped(batches, buckets), _ddl(_SUMS))
    whole = stored(_dealt(sums, buckets, "row").mapInArrow(_summed, _ddl(_SCORES)), "scores")
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total + vocabulary + 1)))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known",
                        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"),
                        (base + F.col("gain")).alias("score"))
