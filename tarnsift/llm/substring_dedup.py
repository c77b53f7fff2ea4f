"""Substring dedup by De Bruijn compaction over word k-mers.

Every window of WINDOW words is an edge of the De Bruijn graph of the corpus. An edge that
occurs again is a repeat of its first occurrence, the one of least (doc_id, start). Four steps:

1. Edges are dealt as graph compaction does it: by minimizer. An edge's minimizer is the least
   hash among its SEED-word k-mers, leftmost first, so equal edges share it, and neighbouring
   edges mostly do too. One record per minimizer occurrence carries all its edges; 64 bits of
   the minimizer and 48 bits of each edge tell them apart, made of two keyed SipHashes of each
   word. A bucket joins the records of its minimizers and finds the repeated edges.
2. Repeated edges join their documents. Neighbours whose sources are neighbours too compact to
   nonbranching paths, and each path takes the SHA-256 of its words.
3. Paths join the documents of their sources: the words at the source coordinates must have the
   same SHA-256. The same question of many copies is asked once.
4. Paths that hold are taken out of their documents. Where one doesn't, because hashes of
   different windows were equal, the windows of such paths and of their sources are compared by
   their words, as a join on the words themselves, and the repeats among them take their place.

Groups that could grow hot are cut down before they are shuffled: each map task sends only the
first occurrence of an edge among its own documents, so a passage in a third of all documents is
one record a task. A minimizer within a common line has other words around it in each document,
so its edges stay distinct; minimizers that a sixteenth of the documents shows to be heavy are
no keys, and each of their edges is a record by itself under its own hash. The sample decides
only where records go, the same for all tasks. Buckets and document parts are as many as the
bytes of the texts ask for, and a worker holds one at a time.

Defined cases: a null text counts as empty, has no word and keeps none; a null doc_id comes
first, as the least number does; rows that share a doc_id are parts of one document, in order of
a hash of their texts, and equal rows among them count as one and lose the same; texts of fewer
than WINDOW words keep all; a very long text is one row of its part; an empty table gives an
empty result; further columns are dropped by ``spans`` and ``kept`` and stay as they are in
``rewrite``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from zstandard import ZstdCompressor, ZstdDecompressor

from tarnsift.llm.common import drop, shared_dir, slices, stage, trim

WINDOW = 20
SEED = 10
SPAN = WINDOW - SEED + 1
#: Edges that a map task compares at once, bytes of text hashed at once, text sent at once.
FLUSH = 800_000
BYTES = 1_000_000
SEND = 8_000_000
#: Bytes of text for each bucket of records and each part of documents.
BUCKET_BYTES, PART_BYTES = 3_000_000, 12_000_000
#: One in so many documents tells heavy minimizers; a heavy one has so many records there at
#: least. No more than HEAVY a bucket, and MOST_HEAVY in all, are told, the heaviest first.
TELLS, LEAST, HEAVY, MOST_HEAVY = 16, 50, 8, 500_000
#: Sixteens of bits by which a bucket tells edges of one minimizer; the words decide.
CHECK = 3
KEYS = ("first key, fixed", "another, as long")
_NULL = -(1 << 63)
_U = np.uint64
_STEP, _STEP2 = 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB
_SALT = _U(0x9E3779B97F4A7C15)
#: A path: document, row, first word, edges; document, row and first word of its source.
PATH = ("doc", "row", "start", "n", "sdoc", "srow", "sstart")
ASKED = ("sdoc", "srow", "sstart", "n", "digest")
Render = Callable[[list[bytes], list[bytes]], tuple]
Digests = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _powers(base: int, n: int, memo: dict = {}) -> np.ndarray:  # noqa: B006  a cache per process
    """base**0 .. base**n modulo 2**64."""
    known = memo.get(base)
    if known is None or len(known) <= n:
        p = np.full(max(n + 1, 1 << 20), base & (1 << 64) - 1, np.uint64)
        p[0] = 1
        known = memo[base] = np.multiply.accumulate(p)
    return known[: n + 1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _ranges(values: np.ndarray, lo: np.ndarray, size: int, base: int) -> np.ndarray:
    """Mixed polynomial hashes of values[lo:lo + size], each range by itself."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n)[:n], out=sums[1:])
    inverse = pow(base, -1, 1 << 64)
    return _mix((sums[lo + size] - sums[lo]) * _powers(inverse, n)[lo])


def digests(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keyed 64-bit SipHashes of each of ``words`` (byte strings)."""
    return tuple(hash_array(words, hash_key=k, categorize=False) for k in KEYS)


def word_hashes(texts: list[bytes], make: Digests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of each word of all texts in order, and the number of words of each text."""
    cut = [t.split() for t in texts]
    n = np.array([len(c) for c in cut], np.int64)
    words = np.empty(int(n.sum()), object)
    words[:] = list(chain.from_iterable(cut))
    return *make(words), n


def edges(texts: list[bytes], make: Digests) -> tuple[np.ndarray, ...]:
    """Of every edge of all texts in order: index of its text, start, hash, second hash, hash of
    its minimizer and the minimizer's offset in it."""
    h, h2, n = word_hashes(texts, make)
    first = np.cumsum(n) - n
    count = np.maximum(n - WINDOW + 1, 0)
    of = np.repeat(np.arange(len(texts)), count)
    start = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = first[of] + start
    if not len(at):
        return of, start, *[np.zeros(0, np.uint64)] * 3, np.zeros(0, np.uint8)
    whole, check = _ranges(h, at, WINDOW, _STEP), _ranges(h2, at, WINDOW, _STEP2)
    seeds = _ranges(h, np.arange(len(h) - SEED + 1), SEED, _STEP)
    least, offset = seeds[at], np.zeros(len(at), np.uint8)
    for o in range(1, SPAN):
        x = seeds[at + o]
        less = x < least
        least, offset = np.where(less, x, least), np.where(less, np.uint8(o), offset)
    return of, start, whole, check, least, offset


def _part(doc: np.ndarray, row: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(doc.astype(np.uint64) ^ _mix(row.astype(np.uint64) + _SALT)) % _U(parts)).astype(np.int64)


def _cuts(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    if len(key):
        at = np.flatnonzero(key[1:] != key[:-1]) + 1
        yield from zip([0, *at.tolist()], [*at.tolist(), len(key)], strict=True)


def _pack(arrays: list[np.ndarray], raw: bytes = b"") -> bytes:
    """Arrays, ascending ones as differences, compressed; ``raw`` follows as it is."""
    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    body = ZstdCompressor(level=1).compress(b"".join(np.diff(a, prepend=a.dtype.type(0)).tobytes() for a in arrays))
    return np.array([len(arrays), len(body)], "<u4").tobytes() + head + body + raw


def _unpack(blob: bytes, kinds: list[str]) -> tuple[list[np.ndarray], memoryview]:
    n, size = np.frombuffer(blob, "<u4", 2).tolist()
    lens = np.frombuffer(blob, "<u4", n, 8).tolist()
    at = 8 + 4 * n
    body, out, p = ZstdDecompressor().decompress(blob[at : at + size]), [], 0
    for kind, k in zip(kinds, lens, strict=True):
        a = np.frombuffer(body, kind, k, p)
        out.append(np.cumsum(a, dtype=a.dtype))
        p += a.nbytes
    return out, memoryview(blob)[at + size :]


def _differ(*cols: np.ndarray) -> np.ndarray:
    """Whether each row but the first differs from the one before."""
    return np.logical_or.reduce([c[1:] != c[:-1] for c in cols])


def _paths(doc, row, pos, sdoc, srow, spos) -> list[np.ndarray]:
    """Repeated edges in any order compacted to PATH columns, in order of (doc, row, start): runs
    of neighbouring edges of which the sources are neighbours too. Of an edge told twice, as by
    equal rows, the least source counts; an edge is no repeat of itself. One that occurs several
    times in its document repeats the occurrence before, so a loop of words is one path."""
    other = (doc != sdoc) | (row != srow) | (pos != spos)
    cols = [x[other] for x in (doc, row, pos, sdoc, srow, spos)]
    order = np.lexsort(tuple(reversed(cols)))
    cols = [x[order] for x in cols]
    if len(order):
        once = np.append(True, _differ(*cols[:3]))
        cols = [x[once] for x in cols]
        by = np.lexsort((cols[2], cols[5], cols[4], cols[3], cols[1], cols[0]))
        more = np.flatnonzero(~_differ(*[x[by] for x in (*cols[:2], *cols[3:])]))
        own, before = by[more + 1], by[more]
        cols[3][own], cols[4][own], cols[5][own] = cols[0][own], cols[1][own], cols[2][before]
    doc, row, pos, sdoc, srow, spos = cols
    new = np.append(True, _differ(doc, row, sdoc, srow, spos - pos) | (np.diff(pos) != 1))[: len(doc)]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(doc)))
    return [x.astype("<i8") for x in (doc[at], row[at], pos[at], n, sdoc[at], srow[at], spos[at])]


def _edges_of(paths: list[np.ndarray]) -> list[np.ndarray]:
    """The edges of PATH columns: doc, row, pos, sdoc, srow, spos."""
    doc, row, start, n, sdoc, srow, sstart = paths
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    wide = [np.repeat(x, n) for x in (doc, row, start, sdoc, srow, sstart)]
    wide[2], wide[5] = wide[2] + k, wide[5] + k
    return wide


def _dealt(paths: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes]]:
    """Paths by document part."""
    part = _part(paths[0], paths[1], parts)
    order = np.argsort(part, kind="stable")
    part, cols = part[order], [x[order] for x in paths]
    for a, b in _cuts(part):
        yield int(part[a]), _pack([x[a:b] for x in cols])


def _again(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where elements stand that are equal to an earlier one in both columns, and the first such."""
    key = a ^ _mix(b.astype(np.uint64) + _SALT)
    by = np.argsort(key)
    head = np.append(True, _differ(key[by]))
    if (~head[1:] & _differ(a[by], b[by])).any():  # equal keys of different pairs
        by = np.lexsort((b, a))
        head = np.append(True, _differ(a[by], b[by]))
    at = np.flatnonzero(head)
    lead = np.repeat(np.minimum.reduceat(by, at), np.diff(np.append(at, len(by))))
    more = by != lead
    return by[more], lead[more]


def _anchors(of, pos, least, offset) -> np.ndarray:
    """Where a new occurrence of a minimizer begins among edges in order of (text, start)."""
    return np.append(True, _differ(of, pos + offset, least))


def _records(
    texts: tuple[np.ndarray, np.ndarray], held: list[tuple[np.ndarray, ...]], buckets: int, parts: int, heavy: np.ndarray
) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, document part or -1, blob) of a run of edges (of, pos, whole, check, least,
    offset); ``texts``: doc and row of the texts that ``of`` counts."""
    of, pos, whole, check, least, offset = (np.concatenate(x) for x in zip(*held, strict=True))
    # Texts in order of (doc, row), equal rows as one; then edges in order of (text, start).
    order = np.lexsort(texts[::-1])
    doc, row = (x[order] for x in texts)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    again = np.zeros(len(order), bool)
    again[1:] = ~_differ(doc, row)
    of = place[of]
    if (np.diff(of) < 0).any() or again.any():
        take = np.flatnonzero(~again[of])
        take = take[np.lexsort((pos[take], of[take]))]
        of, pos, whole, check, least, offset = (x[take] for x in (of, pos, whole, check, least, offset))
    more, src = _again(whole, check)
    if len(more):
        paths = _paths(doc[of[more]], row[of[more]], pos[more], doc[of[src]], row[of[src]], pos[src])
        for p, blob in _dealt(paths, parts):
            yield p % buckets, p, blob
    first = np.ones(len(of), bool)
    first[more] = False
    keep = np.flatnonzero(first)
    of, pos, whole, check, least, offset = (x[keep] for x in (of, pos, whole, check, least, offset))
    if len(heavy):
        hot = heavy[np.minimum(np.searchsorted(heavy, least), len(heavy) - 1)] == least
        least, offset = np.where(hot, _mix(whole ^ _SALT), least), np.where(hot, np.uint8(0), offset)
    at = np.flatnonzero(_anchors(of, pos, least, offset))
    bits = np.left_shift(1, SPAN - 1 - offset.astype(np.int64))
    mask = np.add.reduceat(bits, at).astype("<u2")
    seed, r_of, r_anchor = least[at], of[at], (pos + offset)[at]
    # A minimizer is a least hash, so small numbers are common: buckets need another hash.
    bucket = (_mix(seed ^ _SALT) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    n_edges = np.diff(np.append(at, len(of)))
    # Edges of the records in their new order.
    take = np.repeat(at[order] - (np.cumsum(n_edges[order]) - n_edges[order]), n_edges[order]) + np.arange(len(of))
    check = np.ascontiguousarray(check[take].astype("<u8").view("<u2").reshape(-1, 4)[:, :CHECK])
    ends = np.cumsum(n_edges[order])
    bucket = bucket[order]
    for a, b in _cuts(bucket):
        rows = order[a:b]
        e0, e1 = int(ends[a - 1]) if a else 0, int(ends[b - 1])
        raw = seed[rows].astype("<u8").tobytes() + check[e0:e1].tobytes()
        ids = [x[r_of[rows]].astype("<i8") for x in (doc, row)]
        yield int(bucket[a]), -1, _pack([*ids, r_anchor[rows].astype("<i8"), mask[rows]], raw)


def _found(blobs: list[bytes], parts: int) -> Iterator[tuple[int, bytes]]:
    """The repeated edges of a bucket's records, as paths."""
    cols, seeds, checks = [], [], []
    for b in blobs:
        arrays, raw = _unpack(b, ["<i8", "<i8", "<i8", "<u2"])
        cols.append(arrays)
        n = len(arrays[0])
        seeds.append(np.frombuffer(raw, "<u8", n))
        wide = np.zeros(((len(raw) - 8 * n) // (2 * CHECK), 4), "<u2")
        wide[:, :CHECK] = np.frombuffer(raw, "<u2", -1, 8 * n).reshape(-1, CHECK)
        checks.append(wide.view("<u8").ravel())
    doc, row, anchor, mask = map(np.concatenate, zip(*cols, strict=True))
    seed, check = np.concatenate(seeds), np.concatenate(checks)
    del cols, seeds, checks
    n_edges = np.bitwise_count(mask).astype(np.int64)
    first = np.cumsum(n_edges) - n_edges
    by = np.argsort(seed)
    new = np.append(True, seed[by][1:] != seed[by][:-1])
    group = np.empty(len(seed), np.int64)
    group[by] = np.cumsum(new) - 1
    keep = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(keep):
        return
    keep = keep[np.lexsort((anchor[keep], row[keep], doc[keep]))]
    # From records to edges, in order of (doc, row, start).
    rec, bit = np.nonzero((mask[keep][:, None] >> np.arange(SPAN, dtype="<u2")) & 1)
    nth = np.arange(len(rec)) - np.repeat(np.cumsum(n_edges[keep]) - n_edges[keep], n_edges[keep])
    value = check[first[keep][rec] + nth]
    pos = anchor[keep][rec] - (SPAN - 1) + bit
    dense = np.unique(group[keep], return_inverse=True)[1]
    again, src = _again(value, (dense[rec] << 4) | bit)
    if len(again):
        doc, row = doc[keep], row[keep]
        yield from _dealt(_paths(doc[rec[again]], row[rec[again]], pos[again], doc[rec[src]], row[rec[src]], pos[src]), parts)


def _bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _stored(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _loaded(texts: pa.Table) -> Iterator[pa.Table]:
    """The rows of a part, a blob at a time."""
    for blob in texts.column("blob"):
        yield pa.ipc.open_stream(blob.as_py()).read_all()


def _rows(t: pa.Table) -> Iterator[tuple[tuple[int, int], bytes]]:
    """(doc, row) and text of each row."""
    return zip(zip(t.column("doc").to_pylist(), t.column("row").to_pylist(), strict=True), _bytes(t.column("text")), strict=True)


def _index(doc: np.ndarray, row: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """Where each (doc, row) stands in sorted columns."""
    if not len(doc):
        return {}
    at = [0, *(np.flatnonzero(_differ(doc, row)) + 1).tolist(), len(doc)]
    keys = zip(doc[at[:-1]].tolist(), row[at[:-1]].tolist(), strict=True)
    return dict(zip(keys, zip(at, at[1:]), strict=True))


def _sha(words: list[bytes], start: int, n: int) -> bytes:
    """SHA-256 of the words of ``n`` edges from ``start`` on, joined by one space."""
    return sha256(b" ".join(words[start : start + n + WINDOW - 1])).digest()


def _numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def _heavy(slim: DataFrame, most: int) -> np.ndarray:
    """The heavy minimizers, sorted: ``most`` at most."""

    make = digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            of, start, _, _, least, offset = edges(_bytes(batch.column("text")), make)
            if not len(of):
                continue
            seeds, n = np.unique(least[_anchors(of, start, least, offset)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(n)], names=["seed", "n"])

    some = slim.where(F.pmod(F.xxhash64("doc", "row"), F.lit(TELLS)) == 0)
    counts = some.mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "seed").limit(most).collect()
    return np.sort(np.array([r.seed for r in often], np.int64).view(np.uint64))


class _Corpus:
    """Documents on their way: ``keyed`` has doc and row, which tell rows apart, text, and the
    further columns c0, c1 and so on, named by place so that no name can clash."""

    def __init__(self, docs: DataFrame):
        self.base = shared_dir(docs.sparkSession)
        self.others = [c for c in docs.columns if c != "text"]
        doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL).cast("long"))
        shared = docs.select(doc.alias("doc")).groupBy("doc").count().where("count > 1").limit(1).count()
        row = F.xxhash64(F.coalesce("text", F.lit(""))) if shared else F.lit(0).cast("long")
        more = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(self.others)]
        self.keyed = docs.select(doc.alias("doc"), row.alias("row"), "text", *more)
        size = self.keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets, self.parts = 1 + size // BUCKET_BYTES, 1 + size // PART_BYTES

    def named(self, df: DataFrame, names: list[str]) -> DataFrame:
        """``df`` with the documents' own column names again, in order of ``names``."""
        own = {c: f"c{k}" for k, c in enumerate(self.others)} | {"text": "text"}
        return df.select(*[F.col(own[c]).alias(c) for c in names])

    def texts(self, *more: str) -> DataFrame:
        """part and blob: rows of doc, row, text and ``more``, compressed."""
        parts = self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def send(t: pa.Table) -> pa.RecordBatch:
                part = _part(*_numbers(t, "doc", "row"), parts)
                order = np.argsort(part, kind="stable")
                part = part[order]
                cut = list(_cuts(part))
                blobs = [_stored(t.take(order[a:b])) for a, b in cut]
                return pa.RecordBatch.from_arrays([pa.array(part[[a for a, _ in cut]], pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"])

            held: list[pa.RecordBatch] = []
            for batch in batches:
                step = max(1, batch.num_rows * SEND // max(batch.nbytes, 1))
                for a in range(0, batch.num_rows, step):
                    held.append(batch.slice(a, step))
                    if sum(b.nbytes for b in held) >= SEND:
                        yield send(pa.Table.from_batches(held))
                        held = []
            if held:
                yield send(pa.Table.from_batches(held))

        return self.keyed.select(*dict.fromkeys(("doc", "row", "text", *more))).mapInArrow(run, "part long, blob binary")

    def repeats(self) -> DataFrame:
        """part and blob: repeated edges, as far as one bucket can compact them."""
        buckets, parts, make = self.buckets, self.parts, digests
        slim = self.keyed.select("doc", "row", "text")
        told = slim.sparkSession.sparkContext.broadcast(_heavy(slim, min(MOST_HEAVY, HEAVY * buckets)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []
            ids: list[tuple[np.ndarray, np.ndarray]] = []
            n = n_texts = 0

            def send() -> pa.RecordBatch:
                docs, rows = zip(*ids, strict=True)
                made = _records((np.concatenate(docs), np.concatenate(rows)), held, buckets, parts, told.value)
                k, p, b = zip(*made, strict=True)
                return pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int64()), pa.array(p, pa.int64()), pa.array(b, pa.binary())], names=["bucket", "part", "blob"]
                )

            for batch in slices(batches, 1000):
                doc, row, texts = batch.column("doc").to_numpy(), batch.column("row").to_numpy(), _bytes(batch.column("text"))
                a = 0
                while a < len(texts):
                    b, size = a, 0
                    while b < len(texts) and size < BYTES:
                        size += len(texts[b])
                        b += 1
                    of, *rest = edges(texts[a:b], make)
                    if len(of):
                        held.append((of + n_texts, *rest))
                        ids.append((doc[a:b], row[a:b]))
                        n, n_texts = n + len(of), n_texts + b - a
                    a = b
                    if n >= FLUSH:
                        yield send()
                        held, ids, n, n_texts = [], [], 0, 0
            if held:
                yield send()

        def match(df: pd.DataFrame) -> pd.DataFrame:
            done = df["part"] >= 0
            rows = list(zip(df["part"][done], df["blob"][done], strict=True))
            if not done.all():
                rows += _found(df["blob"][~done].tolist(), parts)
            trim()
            return pd.DataFrame(rows, columns=["part", "blob"])

        records = slim.mapInArrow(deal, "bucket long, part long, blob binary")
        return records.groupBy("bucket").applyInPandas(match, "part long, blob binary")

    def paths(self) -> DataFrame:
        """PATH columns with the part of the document and of its source, and digest: the SHA-256
        of the path's words."""
        parts = self.parts
        kind = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "spart", *PATH)] + [T.StructField("digest", T.BinaryType())])

        def compact(texts: pa.Table, told: pa.Table) -> pa.Table:
            got = [_unpack(b.as_py(), ["<i8"] * 7)[0] for b in told.column("blob")]
            cols = [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, "<i8")] * 7
            paths = _paths(*_edges_of(cols))
            at, made = _index(*paths[:2]), [b""] * len(paths[0])
            for rows in _loaded(texts) if at else ():
                for key, text in _rows(rows):
                    span = at.pop(key, None)
                    if span:
                        words = text.split()
                        for k in range(*span):
                            made[k] = _sha(words, int(paths[2][k]), int(paths[3][k]))
            own = _part(*paths[:2], parts), _part(*paths[4:6], parts)
            trim()
            return pa.table([*map(pa.array, (*own, *paths)), pa.array(made, pa.binary())], names=[f.name for f in kind])

        both = self.texts().groupBy("part").cogroup(self.repeats().groupBy("part"))
        return both.applyInArrow(compact, kind)

    def settled(self, paths: DataFrame, render: Render, fields: list[T.StructField], more: list[str]) -> tuple[DataFrame, DataFrame]:
        """Rows of ``fields`` and ``more``, and the paths whose words differ from their source's.
        ``render`` makes the values of ``fields`` of a row's words and the words left."""
        asks = paths.where("digest is not null").select(F.col("spart").alias("part"), *ASKED).distinct()

        def filled(df: DataFrame, *has: str) -> DataFrame:
            return df.select("part", *[F.col(c) if c in has else F.lit(None).cast(k).alias(c) for c, k in [*((c, "long") for c in PATH), ("digest", "binary")]])

        failed = [T.StructField(f"bad_{c}", T.BinaryType() if c == "digest" else T.LongType()) for c in ASKED]
        kept_types = {f.name: f for f in self.keyed.schema}
        schema = T.StructType([*failed, T.StructField("is_row", T.BooleanType()), *fields, *[kept_types[c] for c in more]])
        def run(texts: pa.Table, told: pa.Table) -> pa.Table:
            arrow = to_arrow_schema(schema)
            mine = told.filter(pc.is_valid(told.column("doc"))).sort_by([(c, "ascending") for c in PATH[:3]])
            asked = told.filter(pc.is_null(told.column("doc"))).sort_by([(c, "ascending") for c in ASKED[:3]])
            start, n = _numbers(mine, "start", "n")
            s_start, s_n = _numbers(asked, "sstart", "n")
            want = asked.column("digest").to_pylist()
            at, open_ = _index(*_numbers(mine, "doc", "row")), _index(*_numbers(asked, "sdoc", "srow"))
            out, bad = [], []
            for rows in _loaded(texts):
                made = []
                for key, text in _rows(rows):
                    words = text.split()
                    for k in range(*open_.pop(key, (0, 0))):
                        if _sha(words, int(s_start[k]), int(s_n[k])) != want[k]:
                            bad.append(k)
                    lo, hi = at.get(key, (0, 0))
                    made.append(render(words, _left(words, start[lo:hi], n[lo:hi])))
                cols = list(zip(*made, strict=True)) if made else [()] * len(fields)
                cells = [pa.nulls(len(rows), f.type) for f in list(arrow)[: len(ASKED)]] + [pa.array([True] * len(rows))]
                cells += [pa.array(c, arrow.field(f.name).type) for c, f in zip(cols, fields, strict=True)]
                cells += [rows.column(c).cast(arrow.field(c).type) for c in more]
                out.append(pa.table(cells, schema=arrow))
            wrong = asked.take(pa.array(bad, pa.int64()))
            cells = [wrong.column(c) for c in ASKED] + [pa.array([False] * len(bad))]
            cells += [pa.nulls(len(bad), f.type) for f in list(arrow)[len(cells) :]]
            out.append(pa.table(cells, schema=arrow))
            trim()
            return pa.concat_tables(out)

        told = filled(paths, *PATH[:4]).unionByName(filled(asks, *ASKED))
        both = self.texts(*more).groupBy("part").cogroup(told.groupBy("part")).applyInArrow(run, schema)
        done = stage(both, f"{self.base}/done-{'again' if 'exact' in paths.columns else 'first'}")
        names = [f.name for f in fields] + more
        bad = done.where("not is_row").select(*[F.col(f"bad_{c}").alias(c) for c in ASKED])
        return done.where("is_row").select(*names), bad

    def exact(self, paths: DataFrame, bad: DataFrame) -> DataFrame:
        """``paths`` with those of ``bad`` replaced by what their windows and their sources'
        windows repeat word by word."""
        wrong = paths.join(bad, list(ASKED), "left_semi")
        own = wrong.select("part", "doc", "row", "start", "n", F.lit(True).alias("own"))
        source = wrong.select(F.col("spart").alias("part"), F.col("sdoc").alias("doc"), F.col("srow").alias("row"), F.col("sstart").alias("start"), "n", F.lit(False).alias("own"))
        spots = own.unionByName(source).distinct()
        schema = "part long, doc long, row long, pos long, own boolean, words binary"

        def windows(texts: pa.Table, told: pa.Table) -> pa.Table:
            told = told.sort_by([(c, "ascending") for c in PATH[:3]])
            part, start, n = _numbers(told, "part", "start", "n")
            mine, at, out = told.column("own").to_pylist(), _index(*_numbers(told, "doc", "row")), []
            for rows in _loaded(texts) if at else ():
                for key, text in _rows(rows):
                    words = text.split()
                    for k in range(*at.pop(key, (0, 0))):
                        for p in range(int(start[k]), int(start[k] + n[k])):
                            out.append((int(part[k]), *key, p, mine[k], b" ".join(words[p : p + WINDOW])))
            cols = zip(*out, strict=True) if out else ((),) * 6
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
            return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "doc", "row", "pos", "own", "words"])

        cut = self.texts().groupBy("part").cogroup(spots.groupBy("part")).applyInArrow(windows, schema)
        cut = stage(cut.groupBy("part", "doc", "row", "pos", "words").agg(F.max("own").alias("own")), f"{self.base}/windows")
        first = cut.groupBy("words").agg(F.min(F.struct("doc", "row", "pos")).alias("f"))
        again = cut.where("own").join(first, "words").where("struct(doc, row, pos) <> f")
        again = again.select("part", "doc", "row", "pos", F.col("f.doc").alias("sdoc"), F.col("f.row").alias("srow"), F.col("f.pos").alias("spos"))
        line = ["part", "doc", "row", "sdoc", "srow", "off"]
        again = again.withColumn("off", F.col("spos") - F.col("pos"))
        again = again.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(*line).orderBy("pos")))
        made = again.groupBy(*line, "run").agg(F.min("pos").alias("start"), F.count("*").alias("n"))
        made = made.withColumn("sstart", F.col("start") + F.col("off")).withColumn("spart", F.lit(None).cast("long")).withColumn("digest", F.lit(None).cast("binary"))
        good = paths.join(bad, list(ASKED), "left_anti").withColumn("digest", F.lit(None).cast("binary"))
        both = good.unionByName(made.select(*good.columns)).withColumn("exact", F.lit(True))
        return stage(both, f"{self.base}/exact")

    def run(self, render: Render, fields: list[T.StructField], more: list[str]) -> tuple[DataFrame, DataFrame]:
        """Rows as ``settled`` has them, and the paths that were taken out."""
        paths = stage(self.paths(), f"{self.base}/paths")
        done, bad = self.settled(paths, render, fields, more)
        if bad.limit(1).count():
            paths = self.exact(paths, bad)
            done, _ = self.settled(paths, render, fields, more)
        return done, paths


def _left(words: list[bytes], start: np.ndarray, n: np.ndarray) -> list[bytes]:
    """``words`` without those of paths in order of their start."""
    if not len(start):
        return words
    left, done = [], 0
    for a, b in zip(start.tolist(), (start + n + WINDOW - 1).tolist(), strict=True):
        left += words[done:a]
        done = max(done, b)
    return left + words[done:]


def kept(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words left, joined by one space (or with
    ``digest`` the SHA-256 of that in lower-case hexadecimal)."""

    def render(words: list[bytes], left: list[bytes]) -> tuple:
        t = b" ".join(left)
        return len(words), len(words) - len(left), sha256(t).hexdigest() if digest else t.decode("utf-8")

    c = _Corpus(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    done, _ = c.run(render, fields, ["c0"])
    drop(docs.sparkSession, f"{c.base}/paths", f"{c.base}/windows", f"{c.base}/exact")
    return done.select(F.col("c0").alias("doc_id"), "n_words", "n_removed", "kept")


def spans(docs: DataFrame, least_edges: int = 1) -> DataFrame:
    """The repeated paths: doc_id, start and n_words of a span, and the doc_id and start of
    the text that it repeats, each of ``least_edges`` neighbouring edges or more."""
    _, paths = _Corpus(docs.select("doc_id", "text")).run(lambda words, left: (), [], [])
    real = lambda c: F.when(F.col(c) != _NULL, F.col(c))
    return paths.where(F.col("n") >= least_edges).select(
        real("doc").alias("doc_id"), "start", (F.col("n") + WINDOW - 1).alias("n_words"),
        real("sdoc").alias("source_doc_id"), F.col("sstart").alias("source_start"),
    )


def rewrite(docs: DataFrame) -> DataFrame:
    """``docs`` with text replaced by the words left, joined by one space, in the rows that
    lose any; the other rows and columns are as they were."""

    def render(words: list[bytes], left: list[bytes]) -> tuple:
        return (b" ".join(left).decode("utf-8") if len(left) < len(words) else None,)

    c = _Corpus(docs)
    more = ["text", *[f"c{k}" for k in range(len(c.others))]]
    done, _ = c.run(render, [T.StructField("left", T.StringType())], more)
    drop(docs.sparkSession, f"{c.base}/paths", f"{c.base}/windows", f"{c.base}/exact")
    return c.named(done.withColumn("text", F.coalesce("left", "text")), docs.columns)


def op5(docs: DataFrame) -> DataFrame:
    return kept(docs, digest=True).select(
        "doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256")
    )


def sql(source: str = "documents") -> str:
    """The query's rows in DuckDB's SQL, from ``source`` (doc_id unique, text)."""
    return rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM {source}
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM g
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM r WHERE n > 1)
), each AS (
  SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w
), k AS (
  SELECT e.doc_id, count(*) AS n, count(g.p) AS gone,
    coalesce(string_agg(CASE WHEN g.p IS NULL THEN x END, ' ' ORDER BY e.p), '') AS t
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
