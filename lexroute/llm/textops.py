"""Vectorised byte-level text primitives shared by the operators of this package.

Texts arrive as Arrow string columns; their UTF-8 buffers are viewed by numpy
without copying. A *word* is a maximal run of bytes outside space and
0x09-0x0D, all of which are ASCII, so words never cut a code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAAAAAAAAAAAAAAAB ^ 0x5DEECE66C]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base k and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get(k)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = _BASE[k] | 1
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            done = 1
            step = b
            while done < size:  # doubling: p[done:2*done] = p[:done] * b**done
                p[done : 2 * done] = p[:done] * np.uint64(step)
                step = step * step & _MASK
                done *= 2
            out.append(p)
        have = _POWERS[k] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Prefix:
    """Prefix sums from which the hash of any slice of a sequence follows in O(1)."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.power, self.inverse = _powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def byte_prefix(data: np.ndarray, which: int = 0) -> Prefix:
    return Prefix(_BYTE[which][data], which)


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after another, and n+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2] if len(col) else None
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(off: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes together; a longer text is alone in its range."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def blocks(col: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of ranges of a column of bounded size."""
    data, off = utf8(col)
    for a, b in pieces(off, most):
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n+1 values)."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(SPACE[data], out=inside[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    edge = off[(off > 0) & (off < len(data))]
    start = inside & ~before
    start[edge] = inside[edge]
    end = before & ~inside
    end[edge] = before[edge]
    s, e = np.flatnonzero(start[:-1]), np.flatnonzero(end)
    return s, e, np.searchsorted(s, off)


def local_index(first: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """For each element of a concatenation: the row it is of, and its index there."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row, np.arange(total) - first[row] if total else np.zeros(0, np.int64)


def words_of(text: str | None) -> list[str]:
    """The words of one text (the plain definition, for small data and tests)."""
    return [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
