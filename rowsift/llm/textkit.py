"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of an Arrow string column, so a whole slice of documents
is tokenised, hashed and windowed by a few numpy calls.  Texts are never cut: a slice holds
whole documents, and one long document makes a slice of its own.

Hashes are polynomials over Z/2^64 with random byte values, followed by an avalanche step.
Because the base is odd it has an inverse, so the hash of any substring (or any run of words)
is a difference of two prefix sums, scaled back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xD6E8FEB86659FD93 | 1
_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)

#: A word is a run of ASCII letters, digits and non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: A token is a run of anything but blank, tab, line feed, form feed and carriage return.
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 12, 13, 32]] = False


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            self.up = np.cumprod(np.concatenate([[U(1)], np.full(n - 1, U(self.base))]))
            self.down = np.cumprod(np.concatenate([[U(1)], np.full(n - 1, U(self.inv))]))
        return self.up[:n], self.down[:n]


_powers, _powers2 = _Powers(_BASE), _Powers(_BASE2)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the finaliser of a well-known public hash)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x = x * U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def text_buffers(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "") if col.null_count else col
    if lower:
        col = pc.utf8_lower(col)
    big = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if offs is not None else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``most`` bytes of text and ``rows`` rows, one row at least."""
    if not batch.num_rows:
        return
    _, offs = text_buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = min(at + rows, max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end


class Tokens:
    """Words of a slice: byte ranges, 64-bit hashes and the word range of every document."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray = ALNUM):
        inside = table[buf]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(buf):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            full = offs[1:] > offs[:-1]
            before[offs[:-1][full]] = False
            after[offs[1:][full] - 1] = False
        self.buf = buf
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return substring_hashes(self.buf, self.start, self.end)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def substring_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; the length takes part, so no range hides in another."""
    up, down = _powers.get(len(buf) + 1)
    acc = np.empty(len(buf) + 1, dtype=np.uint64)
    acc[0] = 0
    np.cumsum(BYTE_VALUES[buf] * up[: len(buf)], out=acc[1:])
    return mix((acc[end] - acc[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; meaningful where k words of one document follow."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers.get(len(words) + 1)
    acc = np.empty(len(words) + 1, dtype=np.uint64)
    acc[0] = 0
    np.cumsum(words * up[: len(words)], out=acc[1:])
    return mix((acc[k:] - acc[:n]) * down[:n])


def run_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from start to end of each run; the number of words takes part."""
    up, down = _powers2.get(len(words) + 1)
    acc = np.empty(len(words) + 1, dtype=np.uint64)
    acc[0] = 0
    np.cumsum(words * up[: len(words)], out=acc[1:])
    return mix((acc[end] - acc[start]) * down[start] + (end - start).astype(np.uint64))


def window_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Positions from which k words follow within their document, in order."""
    n = np.maximum(np.diff(bounds) - k + 1, 0)
    total = int(n.sum())
    first = np.cumsum(n) - n
    return np.arange(total) + np.repeat(bounds[:-1] - first, n)


_POS_BITS = 26


def window_minima(grams: np.ndarray, w: int) -> np.ndarray:
    """For every position the place of the leftmost smallest of the w gram hashes from it on.

    Hashes are compared by their upper 38 bits and then by place, so equal passages choose
    the same place wherever they stand.  Any length will do: places are counted within chunks that overlap by a window.
    """
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    chunk = 1 << (_POS_BITS - 1)
    return np.concatenate([_minima(grams[a : min(a + chunk, n) + w - 1], w) + a for a in range(0, n, chunk)])


def _minima(grams: np.ndarray, w: int) -> np.ndarray:
    n = len(grams) - w + 1
    key = (grams & U((2**64 - 1) ^ (2**_POS_BITS - 1))) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    return (key[:n] & U(2**_POS_BITS - 1)).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def ragged_take(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of values[first[i] : first[i] + length[i]]."""
    total = int(length.sum())
    at = np.cumsum(length) - length
    return values[np.arange(total) + np.repeat(first - at, length)]
