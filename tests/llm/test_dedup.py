"""Fingerprints, near-dedup, substring dedup and sharding against brute force."""

import random
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from tarnsift.llm import sharding, simhash, substring_dedup, trie_dedup
from tests.llm.cases import awkward, docs, empty, prose, words


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def fingerprint(text):
    w = words(lower(text))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def roots(values, near):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_op10(spark):
    rows = awkward()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in trie_dedup.op10(docs(spark)).collect()}
    fps = [fingerprint(t) for _, t, *_ in rows]
    comp = roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert got == {r[0]: (f"{f:016x}", rows[c][0]) for r, f, c in zip(rows, fps, comp, strict=True)}
    assert trie_dedup.op10(empty(spark)).count() == 0


@pytest.mark.parametrize(("crowd", "group"), [(40_000, 2_000), (60, 20)])
def test_links_join_what_brute_force_joins(spark, tmp_path, monkeypatch, crowd, group):
    monkeypatch.setattr(trie_dedup, "CROWD", crowd)
    monkeypatch.setattr(trie_dedup, "GROUP", group)
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(120)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 4))) for b in base[:10] for _ in range(20)]
    edge = [base[0] ^ (7 << 30), base[1] ^ (15 << 30), 0, (1 << 64) - 1, 7, 1 << 63]
    v = sorted({*base, *near, *edge}, key=lambda x: x - (x >> 63 << 64))
    signed = [x - (x >> 63 << 64) for x in v]
    entries = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    got = dict(trie_dedup.components(trie_dedup.links(entries, len(v)), f"file://{tmp_path}/c").collect())
    want = roots(v, lambda a, b: (a ^ b).bit_count() <= 3)
    assert got == {signed[i]: signed[c] for i, c in enumerate(want) if c != i}


def test_a_long_chain_is_one_component(spark, tmp_path):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert {r.root for r in trie_dedup.components(edges, f"file://{tmp_path}/c").collect()} == {0}


def test_op4(spark):
    rows = awkward()
    got = {r.doc_id: r for r in simhash.op4(docs(spark)).collect()}
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)]
        q = len(t) // 4
        edited = t[: len(t) - q] + (after[1] or "")[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha256(edited.encode()).hexdigest())
        a, e, n = (int(x, 16) for x in (r.fingerprint, r.edited_fingerprint, got[after[0]].fingerprint))
        assert r.near_edited == pytest.approx(1 - (a ^ e).bit_count() / 128)
        assert r.near_next == pytest.approx(1 - (a ^ n).bit_count() / 128)
        others = [int(x.fingerprint, 16) for x in got.values()]
        assert r.n_within == (sum((a ^ o).bit_count() <= 3 for o in others) if i % 100 == 0 else None)
    by_text = {}
    for i, t, *_ in rows:
        by_text.setdefault(t or "", set()).add(got[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert simhash.op4(empty(spark)).count() == 0


def test_op4_with_one_row_nulls_and_repeats(spark):
    one = simhash.op4(docs(spark, [(5, "only one text", "", "", 1)])).first()
    assert one.near_next == 1.0 and one.n_chars == 13
    some = simhash.op4(docs(spark, [(None, "a b", "", "", 1), (2, "c d", "", "", 1), (2, "c d", "", "", 1), (2, None, "", "", 1)]))
    assert sorted((str(r.doc_id), r.n_chars) for r in some.collect()) == [("2", 0), ("2", 3), ("2", 3), ("None", 3)]


@pytest.mark.parametrize("radius", [0, 3, 4])
def test_search_finds_all_within_the_radius(spark, radius):
    r = random.Random(4)
    base = [r.getrandbits(128) for _ in range(40)]
    v = sorted({b ^ sum(1 << k for k in r.sample(range(128), n)) for b in base for n in range(7)})
    signed = lambda x: x - (x >> 63 << 64)
    rows = [((signed(x >> 64), signed(x & (1 << 64) - 1)), 2) for x in v]
    index = spark.createDataFrame(rows, "fp struct<hi: long, lo: long>, n long")
    got = {tuple(q): n for q, n in simhash.within(index.select("fp"), index, radius).collect()}
    assert got == {f: 2 * sum((a ^ b).bit_count() <= radius for b in v) for (f, _), a in zip(rows, v, strict=True)}


def removed(rows, window=20):
    seen, out = set(), {}
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone |= set(range(p, p + window))
            seen.add(key)
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[i] = (len(w), len(gone), sha256(" ".join(kept).encode()).hexdigest())
    return out


def shared_passages():
    """Documents that share passages of many lengths, at word offsets of their own."""
    r = random.Random(6)
    passages = [prose(100 + k, n).split() for k, n in enumerate((19, 20, 21, 30, 60, 200))]
    rows = []
    for i in range(60):
        w = prose(1000 + i, r.randint(5, 80)).split()
        for p in r.sample(passages, r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = p
        rows.append((i, " ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize("make", [awkward, shared_passages])
@pytest.mark.parametrize(("flush", "tells", "least"), [(substring_dedup.FLUSH, 16, 50), (50, 1, 2), (50, 1, 1), (700, 2, 1)])
def test_op5(spark, make, flush, tells, least, monkeypatch):
    for name, value in (("FLUSH", flush), ("TELLS", tells), ("LEAST", least)):
        monkeypatch.setattr(substring_dedup, name, value)
    rows = make()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op5(docs(spark, rows)).collect()}
    assert got == removed(rows)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.op5(empty(spark)).count() == 0
    assert substring_dedup.spans(empty(spark)).count() == 0
    assert substring_dedup.rewrite(empty(spark)).count() == 0


def collided(spark, rows, make, monkeypatch):
    def weak(words):
        h = np.array([make(w) for w in words], np.uint64)
        return h, h

    monkeypatch.setattr(substring_dedup, "digests", weak)
    monkeypatch.setattr(substring_dedup, "FLUSH", 300)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op5(docs(spark, rows)).collect()}
    assert got == removed(rows)
    text = {i: words(t) for i, t, *_ in rows}
    for r in substring_dedup.spans(docs(spark, rows)).collect():
        assert text[r.doc_id][r.start : r.start + r.n_words] == text[r.source_doc_id][r.source_start : r.source_start + r.n_words]


@pytest.mark.parametrize("make", [lambda w: 7, lambda w: len(w) % 2, lambda w: w[-1]])
def test_equal_hashes_of_different_words_remove_nothing(spark, make, monkeypatch):
    """All words, half of them, or words of one ending have one hash: only the words decide."""
    collided(spark, shared_passages()[:25], make, monkeypatch)


def test_words_that_polynomial_hashes_confuse(spark):
    """Two words of 1,024 characters that agree in every polynomial hash modulo 2**64."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b, rest = a.translate(str.maketrans("ab", "ba")), prose(3, 24)
    rows = [(1, f"{a} {rest}", "", "", 1), (2, f"{b} {rest}", "", "", 1)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.op5(docs(spark, rows)).collect()}
    assert got == {i: n for i, (_, n, _) in removed(rows).items()} == {1: 0, 2: 24}
    short = [(i, " ".join(t.split()[:20]), "", "", 1) for i, t, *_ in rows]
    assert {r.n_removed for r in substring_dedup.op5(docs(spark, short)).collect()} == {0}


def test_spans_point_at_what_they_repeat(spark):
    rows = shared_passages()
    text = {i: words(t) for i, t, *_ in rows}
    found = substring_dedup.spans(docs(spark, rows)).collect()
    assert found
    for r in found:
        own = text[r.doc_id][r.start : r.start + r.n_words]
        assert own == text[r.source_doc_id][r.source_start : r.source_start + r.n_words]
        assert (r.source_doc_id, r.source_start) < (r.doc_id, r.start)


def test_rewrite_keeps_rows_and_columns(spark):
    rows = awkward()
    df = docs(spark, rows).selectExpr("*", "array(1) AS `odd name`", "'p' AS part", "'k' AS doc", "'b' AS blob", "1 AS c0", "2 AS left", "3 AS __doc", "4 AS __copy")
    out = substring_dedup.rewrite(df)
    assert out.dtypes == df.dtypes
    want = removed(rows)
    for r in out.collect():
        old = next(t for i, t, *_ in rows if i == r.doc_id)
        if want[r.doc_id][1]:
            assert sha256(r.text.encode()).hexdigest() == want[r.doc_id][2]
        else:
            assert r.text == old
        assert r["odd name"] == [1]


def test_rows_that_share_a_doc_id(spark):
    a, b, c = prose(1, 40), prose(2, 40), prose(4, 40)
    rows = [(1, a, "", "", 1), (1, a + " z", "", "", 1), (None, b, "", "", 1), (None, b, "", "", 1), (2, b, "", "", 1), (None, c, "", "", 1)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.op5(docs(spark, rows)).collect())
    # One of the two parts of document 1 repeats the other; the equal rows are one.
    ones = [x for x in got if x[0] == "1"]
    assert ones in ([("1", 40, 0), ("1", 41, 40)], [("1", 40, 40), ("1", 41, 0)])
    assert [x for x in got if x[0] != "1"] == [("2", 40, 40), ("None", 40, 0), ("None", 40, 0), ("None", 40, 0)]


def brute_fill(names, slots):
    prefs = []
    for n in names:
        o, s = sharding.preference(n, slots)
        prefs.append([(o + k * s) % slots for k in range(slots)])
    table = [None] * slots
    while None in table:
        for k, p in enumerate(prefs):
            if None in table:
                table[next(i for i in p if table[i] is None)] = k
    return table


def test_sharding_table():
    names = ("a", "b", "c", "d", "e")
    assert sharding.fill(names, 211) == brute_fill(names, 211)
    full = sharding.fill(sharding.SHARDS)
    n = np.bincount(full)
    assert n.max() - n.min() <= 1
    less = sharding.fill(sharding.SHARDS[:-1])
    moved = np.mean([a != b for a, b in zip(full, less, strict=True)])
    assert 1 / 64 <= moved < 4 / 64
    assert set(sharding.fill(("one",), 13)) == {0}
    for names in ((), ("a", "a"), tuple(map(str, range(14)))):
        with pytest.raises(ValueError):
            sharding.fill(names, 13)


def test_op9(spark):
    got = {r.doc_id: r for r in sharding.op9(docs(spark)).collect()}
    table = sharding.fill(sharding.SHARDS)
    assert set(got) == {i for i, *_ in awkward()} and all(r.shard == table[r.slot] for r in got.values())
    for i, r in got.items():
        h = xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)
        assert r.slot == (h - (h >> 63 << 64)) % sharding.SLOTS
    assert sharding.op9(empty(spark)).count() == 0
    df = docs(spark, [(None, "a", "", "", 1), (1, "b", "", "", 1), (1, "b", "", "", 1)]).selectExpr("*", "'x' AS slot", "1 AS `odd name`")
    out = sharding.place(df, ("doc_id",))
    rows = out.collect()
    assert len(rows) == 3 and "odd name" in out.columns and len({r.shard for r in rows if r.doc_id == 1}) == 1
