"""Byte-pair encoding by a pair occurrence index, and decoding.

The distinct pre-tokens of a block of texts stand one after another in one list of symbols.
An index maps each mergeable pair, by its rank, to all its positions in the block. Active
ranks are applied in ascending order: every position listed under the rank is merged, and
only the pairs to its left and right change, so their lists alone are updated. A block costs
in proportion to its symbols, however often a pre-token occurs in it.

Blocks are runs of an Arrow batch (bounded characters, or one text); a bounded memo keeps the
ids of pre-tokens between blocks. Encoding is one map stage over the scan: no shuffle.

Defined cases: a null text counts as empty and has no ids; special tokens' strings in a text
get their own id, as in the library; repeated rows encode alike; an empty table gives an empty
result; further columns pass through ``encode``, except that columns named like its own are
replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnsift.llm.common import slices, small_batches
from tarnsift.llm.tokens import MEMO, Coder, Memo, byte_symbols, spans, u32


class PairIndexBpe(Coder):
    """A coder whose pre-tokens are encoded here; the library only cuts texts with code
    points from U+0300 on."""

    def __init__(self, path: str):
        super().__init__(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        if self.cut is None or self.lower:
            raise ValueError("a byte-level tokenizer file is needed")
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.byte_id = [vocab[c] for c in symbols]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        self.pair: list[tuple[int, int]] = []
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault((vocab[a], vocab[b]), len(self.made))
            self.made.append(vocab[a + b])
            self.pair.append((vocab[a], vocab[b]))
        self.bytes_of: dict[int, bytes] = {
            i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()
        }
        self.special_id = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special_id.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special_id, key=len, reverse=True))) + ")")
        self.back = back

    def new_memo(self) -> Memo:
        return Memo(lambda w: u32(next(self.merge([w.encode("utf-8")]))))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; the unseen pre-tokens of a block are one index."""
        for part in spans(texts):
            cut = [self.pieces(t) for t in part]
            self.learn(set(chain.from_iterable(c for c in cut if c)) - self.memo.keys())
            get = self.memo.__getitem__
            for t, c in zip(part, cut, strict=True):
                yield self.whole(t) if c is None else b"".join(map(get, c))

    def learn(self, words: set[str]) -> None:
        """Keep the ids of ``words``, none of them in the memo: one index for all unknown."""
        memo = self.memo
        if len(memo) + len(words) > MEMO // 2:
            memo.turn()
        order = []
        for w in words:
            if (ids := memo.old.get(w)) is None:
                order.append(w)
            else:
                memo[w] = ids
        for w, ids in zip(order, self.merge([w.encode("utf-8") for w in order]), strict=True):
            memo[w] = u32(ids)

    def merge(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of each word, all words merged together."""
        byte_id, ranks, made, pair = self.byte_id, self.ranks, self.made, self.pair
        sym: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(sym))
            sym.extend([byte_id[b] for b in w])
            sym.append(-1)  # ends a word; in no pair
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        rank_of = ranks.get
        for i, p in enumerate(zip(sym, sym[1:])):
            if (r := rank_of(p)) is not None:
                index.setdefault(r, []).append(i)
        heap = list(index)
        heapify(heap)
        while heap:
            r = heappop(heap)
            at = index.pop(r, None)
            if at is None:
                continue
            at.sort()
            (a, b), c = pair[r], made[r]
            for k, i in enumerate(at):
                j = nxt[i]
                if sym[i] != a or j >= n or sym[j] != b:
                    continue  # a neighbour took part of it
                sym[i], sym[j] = c, -2
                nxt[i] = q = nxt[j]
                if q < n:
                    prv[q] = i
                lower = False
                h = prv[i]
                if h >= 0 and (s := rank_of((sym[h], c))) is not None:
                    if s in index:
                        index[s].append(h)
                    else:
                        index[s] = [h]
                        heappush(heap, s)
                    lower = s < r
                if q < n and (s := rank_of((c, sym[q]))) is not None:
                    if s in index:
                        index[s].append(i)
                    else:
                        index[s] = [i]
                        heappush(heap, s)
                    lower |= s < r
                if lower and k + 1 < len(at):  # an earlier rank became active: it goes first
                    index[r] = at[k + 1 :]
                    heappush(heap, r)
                    break
        for s in starts:
            out, i = [], s
            while sym[i] != -1:
                out.append(sym[i])
                i = nxt[i]
            yield out

    def whole(self, text: str) -> bytes:
        """A text that the fast rule can't cut: specials apart, the library cuts the rest."""
        out = []
        for part in self.parts.split(text):
            if part in self.special_id:
                out.append(u32([self.special_id[part]]))
            elif part:
                cut = self.pieces(part)
                if cut is None:
                    shown = self.tokenizer.pre_tokenizer.pre_tokenize_str(part)
                    cut = [bytes(map(self.back.__getitem__, p)).decode("utf-8") for p, _ in shown]
                if new := set(cut) - self.memo.keys():
                    self.learn(new)
                out.append(b"".join(map(self.memo.__getitem__, cut)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids; malformed UTF-8 is replaced."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def bpe(path: str) -> PairIndexBpe:
    """One per tokenizer file and worker process."""
    return PairIndexBpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ids, the little-endian unsigned 32-bit ids of text as binary."""
    docs = small_batches(docs).drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = list(bpe(path).encode(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType())]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with decoded, the text of ids (null for null)."""
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if x is None else bpe(path).decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def op3(docs: DataFrame, path: str) -> DataFrame:
    """Digests of encode() and decode(), both run in one pass so that ids aren't carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for batch in slices(batches):
            n, a, b = [], [], []
            for ids in coder.encode(batch.column("text").to_pylist()):
                n.append(len(ids) // 4)
                a.append(sha256(ids).hexdigest())
                b.append(sha256(coder.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
