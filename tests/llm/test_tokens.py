"""Encoding, decoding, packing and token files against the tokenizers library."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnsift.llm import bpe, packing, token_store, tokens
from tests.llm.cases import awkward, docs, empty

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def ids_of(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("make", "path"), [(bpe.bpe, BYTE), (tokens.coder, BYTE), (tokens.coder, WORD)])
def test_coders_equal_the_library(library, make, path):
    r = random.Random(7)
    wide = [chr(i) for i in range(1, 0x300)] + list("日é😀́̀ΣςÅ")
    texts = ["".join(r.choices(wide, k=r.randint(1, 50))) for _ in range(800)]
    texts += ["".join(r.choices("ab 'stre\n<|endoftext|>1", k=r.randint(1, 50))) for _ in range(400)]
    texts += [t for _, t, *_ in awkward()]
    for t, got in zip(texts, make(path).encode(texts), strict=True):
        assert got == tokens.u32(ids_of(library, path, t)), t


def test_the_memo_turns_over(library, monkeypatch):
    for module in (tokens, bpe):
        monkeypatch.setattr(module, "MEMO", 20)
    for coder in (tokens.Coder(BYTE), bpe.PairIndexBpe(BYTE)):
        texts = [t for _, t, *_ in awkward()] * 2
        assert list(coder.encode(texts)) == [tokens.u32(ids_of(library, BYTE, t)) for t in texts]


def test_op3(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op3(docs(spark), BYTE).collect()}
    for i, t, *_ in awkward():
        ids = ids_of(library, BYTE, t)
        text = library[BYTE].decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), sha256(tokens.u32(ids)).hexdigest(), sha256(text.encode()).hexdigest())
    assert bpe.op3(empty(spark), BYTE).count() == 0


def test_encode_and_decode_round_trip(spark):
    df = docs(spark).selectExpr("*", "'x' AS ids", "1 AS `odd name`")
    back = bpe.decode(bpe.encode(df, BYTE), BYTE)
    assert "odd name" in back.columns
    assert all((r.text or "") == r.decoded for r in back.collect())


def check_packed(rows, want, length=1024):
    assert sorted(r[:5] for r in rows) == sorted(want)
    bins = defaultdict(list)
    for *_, n, _, s, o in rows:
        bins[s].append((o, n))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= length
    return len(bins)


@pytest.mark.parametrize("leaf", [packing.LEAF, 5])
def test_op6(spark, library, leaf):
    want = []
    for i, t, *_ in awkward():
        ids, at = [*ids_of(library, BYTE, t), 2], 0
        for k, n in enumerate([len(ids) % 1024] * (len(ids) % 1024 > 0) + [1024] * (len(ids) // 1024)):
            want.append((i, k, at, n, crc32(tokens.u32(ids[at : at + n]))))
            at += n
    out = packing.pack(packing.pieces(docs(spark), BYTE), leaf=leaf)
    rows = [tuple(r) for r in out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    bins = check_packed(rows, want)
    assert bins <= -(-sum(w[3] for w in want) // 1024) + (2 if leaf > 100 else 8)
    assert packing.op6(empty(spark), BYTE).count() == 0


@pytest.mark.parametrize("sizes", [[600] * 300 + [300] * 300, [1] * 2000, [1024] * 50, [513] * 100 + [511] * 100, [1000, 24] * 100])
def test_tree_merge_on_hard_sizes(spark, sizes):
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    out = packing.pack(items, leaf=16).collect()
    rows = [(r.item, 0, 0, r.length, 0, r.sequence_id, r.offset) for r in out]
    bins = check_packed(rows, [(k, 0, 0, n, 0) for k, n in enumerate(sizes)])
    assert bins <= 1.4 * -(-sum(sizes) // 1024) + len(sizes) // 16 + 1


def test_at_most_one_bin_is_half_empty_and_few_go_up():
    r = random.Random(3)
    for _ in range(50):
        sizes = [r.randint(1, 1024) for _ in range(r.randint(1, 300))]
        fill = packing.best_fit(sizes, 1024)[2]
        assert sum(fill) == sum(sizes) and sum(2 * f <= 1024 for f in fill) <= 1
        assert len(packing.carried(fill, 1024)) <= packing.FAN * 512 + 1


@pytest.mark.parametrize("segment", [token_store.SEGMENT, 700])
def test_op7(spark, library, segment, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT", segment)
    rows = awkward()
    got = sorted(tuple(r) for r in token_store.op7(docs(spark), WORD).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    want, at = [], 0
    for i, t, *_ in rows:
        ids = [*ids_of(library, WORD, t), 1]
        want.append((i, at, len(ids), crc32(tokens.u32(ids))))
        at += len(ids)
    assert got == want
    assert token_store.op7(empty(spark), WORD).count() == 0


def test_null_and_repeated_doc_ids_in_token_files(spark):
    df = docs(spark, [(None, "b", "", "", 1), (7, "a a", "", "", 1), (7, "a", "", "", 1), (7, "a", "", "", 1), (3, None, "", "", 1)])
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_store.op7(df, WORD).collect()))
    assert [(i, n) for _, i, n in got] == [(None, 2), (3, 1), (7, 2), (7, 2), (7, 3)]
    assert [s for s, *_ in got] == [0, 2, 3, 5, 7]


@pytest.mark.parametrize("counts", [[], [5], [1, 1], [1] * 300, [2**k for k in range(40)], [0, 3, 0, 1, 9]])
def test_huffman_codes(counts):
    c = np.array(counts, np.int64) if counts else np.zeros(3, np.int64)
    n = token_store.code_lengths(c, 12)
    used = c > 0
    assert (n[used] > 0).all() and (n[~used] == 0).all() and n.max(initial=0) <= 12
    assert (2.0 ** -n[used].astype(float)).sum() <= 1
    ids = np.repeat(np.arange(len(c)), np.minimum(c, 700))
    np.random.default_rng(1).shuffle(ids)
    codes = token_store.Codes(n)
    words, blocks = codes.encode(ids) if len(ids) else (np.zeros(0, np.uint32), np.zeros(0, np.uint64))
    assert (codes.decode(words, blocks, len(ids)) == ids).all()


def test_huffman_without_the_limit_is_optimal():
    import heapq

    r = random.Random(2)
    for _ in range(20):
        c = [r.randint(1, 1000) for _ in range(r.randint(2, 60))]
        heap, cost = list(c), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        assert int((token_store.code_lengths(np.array(c), 60) * np.array(c)).sum()) == cost
