"""Vectorised views of text columns: bytes, words and rolling hashes of many documents at once.

A block is one contiguous byte buffer with document offsets, as Arrow holds a string column. All
hashes are polynomials over per-byte (or per-word) random 64-bit values modulo 2**64, so the hash
of any run is a difference of two prefix sums times an inverse power, without a Python loop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, grown by doubling."""
    held = _POWERS.get("up")
    if held is None or len(held) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.ones(size, U)
            done, step = 1, base
            while done < size:
                out[done : 2 * done] = out[:done] * U(step)
                step = step * step % (1 << 64)
                done *= 2
            _POWERS[name] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the hash depends on all bits of ``x``."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * BASE**i, with a leading zero."""
    up, _ = _powers(len(values) + 1)
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of [start, end); equal runs have equal hashes wherever they stand."""
    _, down = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U) * U(0xE7037ED1A0B428DB))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


class Block:
    """The bytes of some documents: ``data`` (uint8) and ``offsets`` (one more than documents)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def slice(self, a: int, b: int) -> Block:
        first, last = self.offsets[a], self.offsets[b]
        return Block(self.data[first:last], self.offsets[a : b + 1] - first)

    def doc(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def block_of(column: pa.Array) -> Block:
    """The block of an Arrow string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return Block(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Block(raw[o[0] : o[-1]], o - o[0])


def table_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Separators of words: blank and the control characters 0x09 to 0x0D.
BLANKS = table_of(b" \t\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs(block: Block, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes outside ``sep`` within a document: starts, ends, and for each document
    the number of its first run (one more entry than documents)."""
    inside = ~sep[block.data]
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, block.offsets)


def gather_runs(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values (block-wise prefix and suffix minima)."""
    n = len(values)
    if n < w:
        return values[:0]
    if w == 1:
        return values
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(rows, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def row_slices_of(block: Block, most: int):
    """Ranges of documents of at most ``most`` bytes; a longer document stands alone."""
    a, n = 0, len(block)
    while a < n:
        b = int(np.searchsorted(block.offsets, block.offsets[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b
