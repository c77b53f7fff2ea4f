"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(v: Sequence[float]) -> Column:
    """A vector of the request as a constant."""
    return F.lit([float(x) for x in v]).cast("array<double>")


def dot(c: Column | str, q: Column | Sequence[float]) -> Column:
    q = q if isinstance(q, Column) else literal(q)
    return F.aggregate(F.zip_with(c, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def unit_score(cos: Column) -> Column:
    """Cosine on the scale of 0 to 1."""
    return (1 + cos) / 2


def l2_normalize(c: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(F.arrays_zip(c.alias("x"), F.array_repeat(norm, F.size(c)).alias("n")), lambda z: z["x"] / z["n"])).otherwise(c)


def to_binary(c: Column | str) -> Column:
    """Multi-vectors, arrays of arrays of numbers, as row-major little-endian float32 bytes."""

    @F.arrow_udf("binary")
    def run(a: pa.Array) -> pa.Array:
        at = np.asarray(a.values.offsets)[np.asarray(a.offsets)]
        flat = np.asarray(a.values.values)[at[0] : at[-1]].astype("<f4")
        ends = ((at - at[0]) * 4).astype("<i4")
        made = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        return pc.if_else(a.is_valid(), made, pa.scalar(None, pa.binary()))

    return run(c)


def from_binary(c: Column | str, k: Column | str) -> Column:
    """The ``k`` vectors of such bytes."""

    @F.arrow_udf("array<array<float>>")
    def run(a: pa.Array, n: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False) // 4
        rows = np.where(size > 0, pc.fill_null(n, 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        flat = np.frombuffer(b"".join(x for x in a.to_pylist() if x), "<f4")
        each = np.repeat(size // np.maximum(rows, 1), rows)
        inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)), pa.int32()), pa.array(flat, pa.float32()))
        ends = pa.array(np.append(0, np.cumsum(rows)), pa.int32())
        return pa.ListArray.from_arrays(ends, inner, mask=a.is_null()) if a.null_count else pa.ListArray.from_arrays(ends, inner)

    return run(c, k)


def random_projection(c: Column | str, target: int = 128, seed: int = 42) -> Column:
    """Vectors projected by a fixed Gaussian matrix over the root of ``target`` and brought back to
    unit length; vectors of that size stay."""

    @F.arrow_udf("array<float>")
    def run(a: pa.Array) -> pa.Array:
        # All vectors of a batch that have one size are one matrix product.
        size = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
        first, flat = np.asarray(a.offsets)[:-1], np.asarray(a.values, np.float32)
        out = np.where(a.is_valid().to_numpy(zero_copy_only=False), target, 0)
        ends = np.append(0, np.cumsum(out))
        made = np.zeros(ends[-1], np.float32)
        for n in np.unique(size[out > 0]).tolist():
            rows = np.flatnonzero((size == n) & (out > 0))
            v = flat[first[rows][:, None] + np.arange(n)]
            if n != target:
                # The published seed and generator give the same matrix.
                matrix = np.random.RandomState(seed).randn(n, target).astype(np.float32) / np.float32(np.sqrt(target))
                v = v @ matrix
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
            made[ends[rows][:, None] + np.arange(target)] = v
        mask = a.is_null() if a.null_count else None
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(made), mask=mask)

    return run(c)


def token_pooled(c: Column | str, factor: int = 3) -> Column:
    """Multi-vectors with each run of ``factor`` neighbours replaced by their mean."""
    c = (F.col(c) if isinstance(c, str) else c).cast("array<array<double>>")
    n = F.ceil(F.size(c) / factor).cast("int")
    runs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(c, i * factor + 1, factor))
    mean = lambda r: F.transform(
        F.aggregate(F.slice(r, 2, factor), r[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y)), lambda x: x / F.size(r)
    )
    return F.when(F.size(c) > 0, F.transform(runs, mean)).otherwise(c)
