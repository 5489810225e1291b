"""Words and shingles of Arrow text columns as numpy arrays, without Python strings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
BASE, INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h = h ^ (h >> U(27))
    h = h * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, dtype=U)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    size = 1 << max(16, (n - 1).bit_length())
    return _powers(size, base)[:n]


class Bytes:
    """UTF-8 bytes of a slice of texts: ``buf`` and the bounds ``at`` of each text in it."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buf, self.at = buf[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes of text each, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Words of texts: ``start`` and ``end`` in bytes, 64-bit ``hash``, bounds ``at`` of each text."""

    def __init__(self, own: Bytes):
        low = _LOWER[own.buf]
        n = len(low)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = _WORD[low]
        opens = inside[1:-1] & ~inside[:-2]
        closes = inside[1:-1] & ~inside[2:]
        first = own.at[:-1][own.at[:-1] < n]
        opens[first] = inside[1:-1][first]
        last = own.at[1:][own.at[1:] > 0] - 1
        closes[last] = inside[1:-1][last]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        total = np.zeros(n + 1, dtype=U)
        np.cumsum((low.astype(U) + U(1)) * powers(max(n, 1))[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * powers(max(n, 1), INVERSE)[self.start] if n else np.zeros(0, U))
        self.at = np.searchsorted(self.start, own.at)
        self.low = low


_LANES = [U(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(16)]


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, bounds of each text): n words each; a text of fewer, but not none, is one."""
    total, size = len(words.hash), np.diff(words.at)
    end = np.repeat(words.at[1:], size)
    h = np.zeros(total, dtype=U)
    place = np.arange(total)
    for k in range(n):
        inside = place + k < end
        h[inside] += words.hash[place[inside] + k] * _LANES[k]
    keep = place + n <= end
    short = words.at[:-1][(size > 0) & (size < n)]
    keep[short] = True
    count = np.where(size >= n, size - n + 1, (size > 0).astype(size.dtype))
    return mix(h[keep]), np.concatenate(([0], np.cumsum(count)))


def segment_min(values: np.ndarray, at: np.ndarray, empty: int | float) -> np.ndarray:
    """Minimum of each segment along axis 0; ``empty`` where a segment has no rows."""
    out = np.full((len(at) - 1, *values.shape[1:]), empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.minimum.reduceat(values, at[:-1][full], axis=0)
    return out
