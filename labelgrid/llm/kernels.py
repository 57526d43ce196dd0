"""Vectorised text kernels shared by the operators of this subpackage.

All of them work on the UTF-8 bytes of an Arrow string column, a bounded slice of rows at a time, so no Python string is
made for a word. Hashes are 64 bits, a polynomial over randomised bytes modulo 2**64 followed by a finalising mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_STEP = U64(0xD6E8FEB86659FD93)

#: space and the controls 9 to 13 end a word
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n of the base, or of its inverse, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        steps = np.full(size, _BASE if kind == "up" else _BASE_INV, dtype=np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on 64 bits (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text together stays near ``limit`` bytes; a longer single row stays whole."""
    if not batch.num_rows:
        return
    _, offsets = buffer(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if offs is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes where ``inside`` holds, broken at row ends: starts, ends, and each row's first run (n + 1)."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    off = np.ones(n + 2, bool)
    np.logical_not(inside, out=off[1 : n + 1])
    starts = np.flatnonzero(inside & (off[:n] | edge[:n]))
    ends = np.flatnonzero(inside & (off[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row."""
    return runs(data, offsets, ~WHITE[data])


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any span of the buffer follows."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", n)[:n], out=sums[1:])
    return sums


def hash_at(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    value = (sums[ends] - sums[starts]) * _power("down", len(sums))[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _STEP)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    return hash_at(byte_sums(data), starts, ends)


def gram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive word hashes (rows are not minded: the caller keeps windows inside a row)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    if n <= 8:
        out = np.full(m, n, np.uint64)
        for k in range(n):
            out = out * _STEP + hashes[k : k + m]
        return mix(out)
    size = len(hashes)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(hashes * _power("up", size)[:size], out=sums[1:])
    return mix((sums[n:] - sums[:m]) * _power("down", size)[:m] + U64(n))
