"""The Jaccard join over count vectors against all pairs of sets."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from quillflow.llm import count_tree, shingle_sets

SCHEMA = "doc_id long, text string, node string, n long, label string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, size, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and label[i] != label[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    names = {}
    for (doc, _), x in zip(rows, label):
        if doc is not None:
            names[x] = min(names.get(x, doc), doc)
    return sorted(((doc, len(s), names.get(x, doc)) for (doc, _), s, x in zip(rows, sets, label)), key=repr)


def joined(spark, rows, size=4, percent=85):
    frame = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, count_tree.jaccard_join(frame, size, percent).collect()), key=repr)


def corpus(seed, groups, copies, words=60):
    """Groups of copies with a few changed words, a passage in many documents, single documents, odd texts."""
    pick = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Été", "日本"]
    say = lambda n: [pick.choice(vocabulary) for _ in range(n)]
    shared, rows = say(30), []
    for g in range(groups):
        base = say(pick.randint(8, words)) + (shared if g % 2 else [])
        for _ in range(copies):
            copy = list(base)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 3])):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += [" ".join(say(pick.randint(1, 50)) + shared) for _ in range(20)] + [" ".join(say(3)) for _ in range(10)]
    rows += [None, "", " \n\t ", "One TWO three", "one two  THREE", "a b c d " * 50, "w" * 50_000]
    numbered = list(enumerate(rows))
    return numbered + [numbered[0], (3, "another text of the same id"), (None, "no id here at all"), (None, rows[0])]


@pytest.mark.parametrize(("seed", "groups", "copies", "percent"), [(1, 6, 20, 85), (2, 2, 70, 80), (3, 30, 4, 95)])
def test_all_pairs(spark, monkeypatch, seed, groups, copies, percent):
    monkeypatch.setattr(count_tree, "LEAF", 8)
    rows = corpus(seed, groups, copies)
    assert joined(spark, rows, percent=percent) == expected(rows, 4, percent)


def test_hot_keys_come_last(spark, monkeypatch):
    """With few counters the shared passage is hot: its shingles move, no link is lost."""
    monkeypatch.setattr(count_tree, "LEAF", 4)
    calls = []
    found = count_tree._hot_keys

    def hot(nodes):
        keys = nodes.selectExpr("explode(prefix) AS key").groupBy("key").count().where("count > 3").toPandas()["key"]
        calls.append(len(keys))
        return np.sort(keys.to_numpy(np.int64))

    rows = corpus(4, 8, 12)
    monkeypatch.setattr(count_tree, "_hot_keys", hot)
    assert joined(spark, rows) == expected(rows, 4, 85)
    assert calls[0] > 10
    assert found is not hot


def test_counts_too_large_for_a_byte(spark, monkeypatch):
    monkeypatch.setattr(count_tree, "FULL", 2)
    rows = corpus(5, 5, 10)
    assert joined(spark, rows) == expected(rows, 4, 85)


def test_empty_table(spark):
    assert joined(spark, []) == []
    assert joined(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3000), st.integers(1, 3000))
def test_minima_bound_what_sets_share(seed, n, m):
    random_ = np.random.default_rng(seed)
    universe = random_.integers(0, 1 << 63, 4000, dtype=np.uint64)
    left, right = (np.unique(random_.choice(universe, k)) for k in (n, m))
    both = len(np.intersect1d(left, right))
    points = [np.frombuffer(count_tree.count_vector(s), np.uint8)[None] for s in (left, right)]
    for percent in (80, 85, 95):
        linked = 100 * both >= percent * (len(left) + len(right) - both)
        allowed = count_tree._allowed(*points, np.array([len(left)]), np.array([len(right)]), percent)[0]
        assert allowed or not linked


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9000), st.floats(0, 1), st.sampled_from([1, 3]))
def test_fine_counts_lose_no_link(seed, n, kept, grow):
    random_ = np.random.default_rng(seed)
    left = np.unique(random_.integers(0, 1 << 63, n, dtype=np.int64))
    right = np.unique(np.concatenate([left[:int(len(left) * kept)], random_.integers(0, 1 << 63, grow * (n // 10), dtype=np.int64)]))
    if len(right):
        both = len(np.intersect1d(left, right))
        fine = [shingle_sets.fine_counts(s) for s in (left, right)]
        for percent in (80, 85, 95):
            linked = 100 * both >= percent * (len(left) + len(right) - both)
            assert shingle_sets.may_reach(*fine, len(left), len(right), percent) or not linked


def test_large_sets_are_ruled_out_before_they_are_joined(spark):
    """Coarse counts of large sets are alike; fine ones tell a copy from another text."""
    random_ = np.random.default_rng(3)
    one, other = (np.sort(random_.integers(0, 1 << 62, 12_000, dtype=np.int64)) for _ in range(2))
    near = np.sort(np.concatenate([one[:11_500], random_.integers(0, 1 << 62, 500, dtype=np.int64)]))
    n = np.array([12_000])
    points = [np.frombuffer(count_tree.count_vector(s.view(np.uint64)), np.uint8)[None] for s in (one, other)]
    assert count_tree._allowed(*points, n, n, 85)[0]
    sets = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate((one, near, other, one[:9]))], "node long, items array<long>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3)], "a long, b long")
    assert sorted(map(tuple, shingle_sets._finely_bounded(pairs, sets, 85).collect())) == [(0, 1), (2, 3)]
    assert list(map(tuple, shingle_sets.verified(pairs, sets, 85).collect())) == [(0, 1)]


def test_hot_keys_are_counted_exactly(spark):
    """A key of as many prefixes as the limit is hot, whatever the size of the table."""
    few, enough = count_tree.HOT_FROM - 1, count_tree.HOT_FROM
    nodes = spark.range(3000).selectExpr(
        "id AS node", f"concat(array(-1 - id), IF(id < {enough}, array(7L), array()), IF(id < {few}, array(8L), array())) AS prefix")
    assert count_tree._hot_keys(nodes).tolist() == [7]


def test_pairs_that_share_many_keys_are_met_once(spark):
    members = spark.range(40).selectExpr("id AS key").crossJoin(spark.range(6).selectExpr("id AS node")).selectExpr(
        "key", "node", "100L AS n", "1L + key AS place", "node AS label")
    point = bytearray([1] * 100 + [0] * 28)
    points = spark.createDataFrame([(k, point) for k in range(6)], "node long, point binary")
    found = count_tree.cross_pairs(members, points, 85)
    assert found.count() == 15 and "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_leaf_pairs_are_opened_a_few_at_a_time():
    """A batch holds thousands of pairs of leaves; as Python objects all at once they take hundreds of MB."""
    leaf = {c: list(range(10**6, 10**6 + 128)) for c in ("nodes", "ns", "places")} | {"labels": [5] * 128, "points": bytes(128 * 128)}
    row = leaf | {f"{c}_2": v for c, v in leaf.items()} | {"same": False}
    batch = pa.RecordBatch.from_pylist([row] * 1000)
    tracemalloc.start()
    try:
        assert list(count_tree._opened(85)(iter([batch]))) == []
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()
