"""Vectorised byte and word views over Arrow batches, shared by the corpus operators.

A batch is handled as one byte array with document offsets, in slices of a few megabytes, so numpy's temporaries
stay small however many rows Spark puts in a batch. A document longer than a slice forms a slice of its own.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.storage import boxed, named, partitions, unboxed, written  # noqa: F401

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
SLICE = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    size = max(1 << 16, 1 << int(n + 1).bit_length())
    if size > SLICE * 4:
        size = n + 1
    got = _powers.get(0)
    if got is None or len(got[0]) <= n:
        out = []
        for base in (BASE, BASE_INV):
            p = np.empty(size + 1, U64)
            p[0] = 1
            p[1:] = base
            out.append(np.multiply.accumulate(p, dtype=U64))
        if size <= SLICE * 4:
            _powers[0] = (out[0], out[1])
        return out[0], out[1]
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on all bits of x."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences give polynomial hashes of any stretch of values (see stretch_hash)."""
    p, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * p[: len(values)], out=out[1:], dtype=U64)
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hash of values[start:end], the same wherever the stretch stands."""
    _, inv = powers(len(prefix) - 1)
    return (prefix[end] - prefix[start]) * inv[start]


def as_binary(column: pa.Array) -> pa.Array:
    """Binary array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    return column.fill_null(b"") if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after another, and where each begins (one more than there are values)."""
    column = as_binary(column)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if offsets is not None and len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE, rows: int = 2000):
    """(first row, end row, bytes, offsets from 0) for stretches of rows of about limit bytes; every row is in one."""
    body, offs = flat(column)
    n, at = len(offs) - 1, 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        end = min(max(end, at + 1), at + rows, n)
        yield at, end, body[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


#: White space and ASCII punctuation.
MARKS = SPACE.copy()
MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def words(body: np.ndarray, offs: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a run of bytes that apart doesn't hold, within one row."""
    n = len(body)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~apart[body]
    first = np.zeros(n + 1, bool)
    first[offs[:-1][offs[:-1] < n]] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offs, s, "right") - 1


def word_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(stretch_hash(prefix_hash(body), start, end) + (end - start).astype(U64))


def lower(column: pa.Array) -> pa.Array:
    """Text in lower case, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(column.fill_null("") if column.null_count else column)


def runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal neighbours."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(ids)]))


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def i64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == U64 else values.astype(np.int64), pa.int64())
