"""Vectorised text kernels: words, their hashes and shingles, straight from Arrow's buffers.

Everything works on the UTF-8 bytes of whole texts. A word is a maximal run of bytes other than space and 9 to 13, which
is the same as a run of such code points, as no UTF-8 sequence of a larger code point holds those bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
BLOCK_BYTES = 1 << 21
#: Bytes whose running hashes are held at once, however long a text is.
SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
IN_WORD = np.ones(256, bool)
IN_WORD[[32, 9, 10, 11, 12, 13]] = False
#: ASCII letters and digits and every byte of other characters.
IN_NAME = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER_VALUES = _VALUES[_LOWER]
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; nulls count as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most so many bytes (or of one longer text): first row, end row, bytes, offsets."""
    data, at = text_buffers(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def packed(raw: bytes) -> bytes:
    """The bytes compressed, after their number."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True) if len(blob) > 8 else b""


def span_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """Hashes of byte ranges with ascending beginnings; equal bytes, equal hash. Worked out a segment of the data at a time.

    Memory is that of a segment and the longest range, which is short unless a text has no end of words.
    """
    out = np.empty(len(begin), U64)
    longest = int((end - begin).max()) if len(begin) else 0
    up, down = powers(SEGMENT + longest + 1)
    cuts = np.searchsorted(begin, np.arange(0, len(data) + SEGMENT, SEGMENT))
    for k in range(len(cuts) - 1):
        lo, hi = cuts[k], cuts[k + 1]
        if lo == hi:
            continue
        at = k * SEGMENT
        part = data[at : at + SEGMENT + longest]
        prefix = np.zeros(len(part) + 1, U64)
        np.cumsum(values[part] * up[: len(part)], out=prefix[1:])
        b, e = begin[lo:hi] - at, end[lo:hi] - at
        out[lo:hi] = mix((prefix[e] - prefix[b]) * down[b] + (e - b).astype(U64))
    return out


class Words:
    """The words of a block of texts: begin and end (in bytes), hash, and the range of words of each text."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = True, alphabet: np.ndarray = IN_WORD):
        inside = alphabet[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = at[1:] > at[:-1]
        for flags, edge in ((first, at[:-1][filled]), (last, at[1:][filled] - 1)):
            flags[edge] |= inside[edge]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.data, self.values = data, _LOWER_VALUES if lower else _VALUES
        self.bounds = np.searchsorted(self.begin, at)
        self.counts = np.diff(self.bounds)
        self.hash = self.span_hash(self.begin, self.end)

    def span_hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges with ascending beginnings; equal bytes, equal hash."""
        return span_hash(self.data, begin, end, self.values)

    def doc(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of each run of so many words, repeats included; of a shorter text, of all its words as one."""
        n, doc = len(self.hash), self.doc()
        left = np.repeat(self.bounds[1:], self.counts) - np.arange(n)
        takes = (left >= width) | (np.arange(n) == np.repeat(self.bounds[:-1], self.counts))
        start, taken = np.flatnonzero(takes), np.minimum(left[takes], width)
        total = taken.astype(U64)
        for k in range(width):
            at = np.minimum(start + k, n - 1)
            total = mix(total * U64(_BASE) + np.where(k < taken, self.hash[at], U64(0)))
        return doc[start], total


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order of row and value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]
