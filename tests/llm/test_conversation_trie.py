"""The trie of conversations against a plain one, and its bit vector against lists of children."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tarnsift.llm import conversation_trie as C
from tests.llm.cases import prose

SCHEMA = "conv_id long, turn int, role string, text string"


def rebuilt(rows, stride=100, heads=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in said.items():
        h = zlib.crc32(str(c).encode()) % heads
        b = c - int(np.fmod(c, stride))
        out[c] = said.get(b, [])[:h] + mine[h:]
    return out


def brute(rows, **more):
    convs = rebuilt(rows, **more)
    members, children = defaultdict(list), defaultdict(set)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                children[tuple(path[: d - 1])].add(tuple(path[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        own = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += not children[node]
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(node))))
        out.append((
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]),
            leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def some(seed=1, convs=150):
    """Few texts, so that prefixes are shared; copies, missing bases, odd turns, nulls and repeats."""
    r = random.Random(seed)
    texts = [prose(200 + k, 8) for k in range(4)] + ["", None, "😀é"]
    rows = []
    for c in [*r.sample(range(0, 1200), convs), -5, -100, -250, 0, 100]:
        rows += [(c, t, r.choice(["user", "assistant", None]), r.choice(texts)) for t in range(r.choice([1, 2, 3, 8, 9]))]
    rows += [(c, t, "user", f"same {t}") for c in range(3000, 3060) for t in range(6)]
    rows += [(7777, None, "user", "x"), (7777, None, "user", "a"), (7777, 3, "b", "a"), (7777, 3, "a", "b"), (7777, 3, "a", "b"), (None, 1, "user", "lost")]
    rows += [(5000, t, "user", f"long {t % 3}") for t in range(700)] + [(5001, t, "user", f"long {t % 3}") for t in range(650)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("light", [C.LIGHT, 300, 0])
def test_nodes_are_those_of_a_plain_trie(spark, light, monkeypatch):
    rows = list(dict.fromkeys(some())) + [(7777, 3, "a", "b")]
    if light == 300:  # ranges of few rows, so that conversations go over their ends; short blocks
        monkeypatch.setattr(C, "ROWS", 40)
        monkeypatch.setattr(C, "BLOCK", 16)
        monkeypatch.setattr(C, "FOREST", 50)
    if light == 0:
        monkeypatch.setattr(C, "LISTED", 3)
    got = C.trie(spark.createDataFrame(rows, SCHEMA).repartition(3), light=light)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_plain_conversations_empty_tables_and_more_columns(spark):
    rows = list(dict.fromkeys(some(2, 60)))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", depth int, part string")
    assert sorted(map(tuple, C.trie(df, heads=1).collect()), key=str) == brute(rows, heads=1)
    assert C.op13(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.op13(spark.createDataFrame([(None, None, None, None)], SCHEMA)).count() == 0
    one = C.op13(spark.createDataFrame([(3, None, None, None)], SCHEMA)).collect()
    assert sorted(map(tuple, one), key=str) == brute([(3, None, None, None)])


def test_bits_tell_children_and_parents():
    r = random.Random(3)
    for n in (1, 2, 3, 63, 64, 65, 500):
        parent = [-1] + [r.randrange(max(0, k - 20), k) for k in range(1, n)]
        level = [0] * n
        for k in range(1, n):
            level[k] = level[parent[k]] + 1
        order = C.level_order(np.array(level[1:]), np.array([p - 1 for p in parent[1:]]), np.arange(n - 1)) + 1
        rank = {0: 0} | {int(k): i + 1 for i, k in enumerate(order)}
        kids = [0] * n
        for k in range(1, n):
            kids[rank[parent[k]]] += 1
        tree = C.Louds(np.array(kids))
        assert tree.degree(np.arange(n)).tolist() == kids
        assert tree.parent(np.arange(1, n)).tolist() == [rank[parent[int(k)]] for k in order]
        assert [hi - lo for lo, hi in tree.levels()] == [level.count(v) for v in range(max(level) + 1)]
        own = np.array([r.randrange(100) for _ in range(n)])
        want = own.copy()
        leaves = np.array([int(k == 0) for k in kids])
        for k in range(n - 1, 0, -1):
            up = rank[parent[int(order[k - 1])]]
            want[up] += want[k]
            leaves[up] += leaves[k]
        assert C.rollups(tree, own).tolist() == [list(x) for x in zip(leaves.tolist(), want.tolist())]
