"""Near texts against brute force: fingerprints, links, groups and what stays."""

import random

import numpy as np
import pytest

from tarnsift.llm import near_dedup
from tests.llm.cases import awkward, docs, empty, prose, words
from tests.llm.test_dedup import lower, roots


def shingle_set(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for p in r.sample(range(len(w)), n):
        w[p] = f"edit{seed}x{p}"
    return " ".join(w)


def copies():
    """Texts with copies of many degrees of nearness, none of them near the bound itself."""
    rows, k = [], 0
    for base in range(12):
        text = prose(300 + base, 240)
        for n in (0, 1, 2, 3, 3, 2, 14, 20, 60):
            rows.append((k, edited(text, n, 1000 + k), "en", "s", 1))
            k += 1
    return rows


def near_roots(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    return roots(sets, lambda a, b: jaccard(a, b) >= 0.8)


def test_bits_are_the_majority_of_votes():
    texts = [(t or "").encode() for _, t, *_ in awkward()]
    h, n = near_dedup.shingles(texts)
    assert n.tolist() == [len(shingle_set(t.decode())) for t in texts]
    fp = near_dedup.simhash(h, n)
    at = np.cumsum(n) - n
    for k, (a, c) in enumerate(zip(at.tolist(), n.tolist(), strict=True)):
        own = h[a : a + c]
        assert len(set(own.tolist())) == c
        got = int.from_bytes(fp[k].tobytes(), "little")
        for j in (0, 1, 63, 64, 200, 511):
            salt = np.uint64((j // 64 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            ones = int(((near_dedup._mix(own + salt) >> np.uint64(j % 64)) & np.uint64(1)).sum())
            assert (got >> j & 1) == (2 * ones > c)


def test_a_bit_differs_as_often_as_the_angle_says():
    pairs = [(prose(k, 400), edited(prose(k, 400), 9, k)) for k in range(60)]
    fp = near_dedup.simhash(*near_dedup.shingles([t.encode() for p in pairs for t in p]))
    got = np.bitwise_count(fp[::2] ^ fp[1::2]).sum(1).mean()
    want = np.mean([near_dedup.differing(jaccard(*map(shingle_set, p))) for p in pairs])
    assert got == pytest.approx(512 * want, rel=0.1)


@pytest.mark.parametrize(("group", "crowd"), [(2000, 10_000), (10, 10_000), (2000, 30), (40, 10)])
def test_one_of_each_group_stays(spark, monkeypatch, group, crowd):
    monkeypatch.setattr(near_dedup, "GROUP", group)
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "MISSED", 1e-6)
    rows = copies()
    root = near_roots(rows)
    assert 12 <= len(set(root)) < len(rows)
    got = {r.doc_id for r in near_dedup.keep_first(docs(spark, rows)).collect()}
    assert got == {rows[k][0] for k, c in enumerate(root) if c == k}


def clusters(many=6, of=30):
    """Copies whose similarities lie on both sides of the bound."""
    r = random.Random(8)
    rows = [(None, edited(prose(400 + c, 300), r.randint(3, 6), 5000 + 100 * c + k)) for c in range(many) for k in range(of)]
    return [(k, t, "en", "s", 1) for k, (_, t) in enumerate(rows)]


@pytest.mark.parametrize(("group", "crowd", "members"), [(2000, 10_000, 2000), (10, 10_000, 2000), (2000, 20, 2000), (2000, 10_000, 7), (10, 10, 4)])
def test_clusters_across_the_bound(spark, monkeypatch, group, crowd, members):
    """Every pair that is near ends in one group, and none goes that is near nothing else."""
    monkeypatch.setattr(near_dedup, "GROUP", group)
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    rows = clusters()
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = near_roots(rows)
    got = {r.doc_id for r in near_dedup.keep_first(docs(spark, rows)).collect()}
    want = {k for k, c in enumerate(root) if c == k}
    near = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(near) > 300 and len(want) > 30
    both = [p for p in near if p[0] in got and p[1] in got]
    assert len(both) <= 0.05 * len(near) and want <= got
    gone = set(range(len(rows))) - got
    assert all(any(i in p for p in near) for i in gone)
    if group == 2000 and crowd == 10_000:
        assert got == want


def test_settled_sets_are_those_of_all_pairs():
    """Sets of all degrees of overlap, with labels before and with only some asked."""
    r = np.random.default_rng(4)
    for trial in range(60):
        m = int(r.integers(1, 40))
        pool = [r.choice(60, size=int(r.integers(0, 40)), replace=False) for _ in range(4)]
        sets = []
        for _ in range(m):
            x = pool[r.integers(4)]
            sets.append({*x[r.random(len(x)) > 0.1].tolist(), *r.choice(10**6, size=int(r.integers(0, 3))).tolist()})
        label = np.arange(m) if trial % 2 else r.integers(0, max(1, m // 2), m)
        asked = np.ones(m, bool) if trial % 3 else r.random(m) < 0.4
        h = np.array([x for s in sets for x in sorted(s)], np.uint64)
        got = near_dedup.settle(h, np.array([len(s) for s in sets]), label, asked)
        want = roots(list(range(m)), lambda i, j: label[i] == label[j] or ((asked[i] or asked[j]) and jaccard(sets[i], sets[j]) >= 0.8))
        one = lambda x: [x.index(v) for v in x]
        assert one(got.tolist()) == one(want)


def test_tries_follow_from_the_number_of_fingerprints():
    for n in (1, 2_000, 10**5, 10**7, 10**10):
        levels, many = near_dedup.tries(n)
        assert (1 - (1 - near_dedup.differing(0.8)) ** levels) ** many <= near_dedup.MISSED
        assert n / 2**levels <= near_dedup.GROUP


def test_awkward_rows(spark):
    df = docs(spark).selectExpr("*", "1 AS key", "array(2) AS `odd name`", "3 AS fp")
    out = near_dedup.keep_first(df)
    assert out.dtypes == df.dtypes
    rows = awkward()
    root = near_roots(rows)
    assert {r.doc_id for r in out.collect()} == {rows[k][0] for k, c in enumerate(root) if c == k}
    assert near_dedup.keep_first(empty(spark)).count() == 0
    same = [(1, "a b c d", "", "", 1)] * 2 + [(None, "q r s t", "", "", 1), (None, None, "", "", 1), (2, "", "", "", 1)]
    assert sorted(str(r.doc_id) for r in near_dedup.keep_first(docs(spark, same)).collect()) == ["1", "2", "None"]
