"""The prefix trie against nodes listed one by one in plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quillflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def conversations(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {conv: [turn[1:] for turn in sorted(turns)] for conv, turns in found.items()}


def with_shared_starts(found):
    out = {}
    for conv, turns in found.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (conv % 20 if conv >= 0 else -(-conv % 20))
        out[conv] = found.get(base, [])[:h] + turns[h:]
    return out


def expected(found):
    members, children, below = defaultdict(list), defaultdict(set), {}
    for conv, turns in found.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    rows = []
    for node in sorted(members, key=len, reverse=True):
        convs = members[node]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        under = [below[c] for c in children[node]]
        below[node] = (sum(u[0] for u in under) or 1, (len(convs) - 1) * words + sum(u[1] for u in under))
        ends = ",".join(map(str, sorted(c for c in convs if len(found[c]) == len(node))))
        rows.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
                     *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def built(spark, rows, container, rebuild=False):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    if not rebuild:
        return sorted(map(tuple, prefix_trie.prefix_trie(frame, container).collect()), key=repr)
    turns = prefix_trie.numbered(frame)
    members = turns.where("place = 1").select("conv_id")
    return sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(turns), members, container).collect()), key=repr)


@pytest.mark.parametrize(("count", "kinds", "container"), [(60, 2, 10), (150, 3, 40), (200, 1, 20), (200, 2, 100_000)])
def test_random_conversations(spark, count, kinds, container):
    pick = random.Random(count * kinds)
    rows = []
    for c in range(count):
        conv = pick.choice([c, -c, c * 7])
        for turn in range(pick.choice([1, 2, 5, 9, 30])):
            rows.append((conv, pick.choice([turn, turn, turn, None]), pick.choice(["u", None]) if kinds > 1 else "u",
                         " a b" * pick.randrange(kinds) or None))
    found = conversations(rows)
    assert built(spark, rows, container) == expected(found)
    assert built(spark, rows, container, rebuild=True) == expected(with_shared_starts(found))


def test_burst_stops_where_members_end(spark):
    """Prefixes that are conversations themselves, large heads, one long common stretch, a hot copy."""
    long = [("u", f"t{k}") for k in range(40)]
    found = {c: long + [("u", f"end {c}")] for c in range(30)}
    found |= {c: long[:c - 90] for c in range(100, 125)}
    found |= {c: [("u", "same"), ("a", "same")] for c in range(200, 500)}
    rows = [(c, k, role, text) for c, turns in found.items() for k, (role, text) in enumerate(turns)]
    assert built(spark, rows, 20) == expected(found)


def test_one_long_conversation(spark):
    rows = [(1, k, "u", f"w{k % 7} x") for k in range(5000)] + [(2, 0, "u", "w0 x")]
    assert built(spark, rows, 50) == expected(conversations(rows))


def test_edges(spark):
    assert built(spark, [], 10) == []
    rows = [(None, 1, "u", "x"), (5, None, None, None), (5, None, None, None), (6, 2, "u", "y" * 100_000), (6, 1, "a", "")]
    assert built(spark, rows, 1) == expected(conversations(rows))


def test_lists_of_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST_BYTES", 16)
    found = {c: [("u", "same")] for c in range(-50, 300)}
    rows = [(c, 0, role, text) for c, turns in found.items() for role, text in turns]
    assert built(spark, rows, 20) == expected(found)
