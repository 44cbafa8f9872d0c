"""Words of whole Arrow batches as numpy arrays, without a Python object for each word.

Words are maximal runs of bytes other than space and \\x09-\\x0D. Their 64-bit hashes come from a
polynomial over a table of random values, summed along the text, so any span costs O(1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18  # bytes hashed at once; bounds memory for texts of any length
PIECE = 2_000_000  # bytes of text that a task works on at once
PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME**i and PRIME**-i for i < n, modulo 2**64."""
    size = 1 << max(n - 1, 1).bit_length()
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (PRIME, INVERSE):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[size] = tuple(both)
    a, b = _powers[size]
    return a[:n], b[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads hash bits (a bijection on 64 bits)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses an offset."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = off[(off > 0) & (off < len(data))]
    first[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[cuts - 1] = solid[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of byte spans in rising order without overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + BLOCK, side="right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        part = data[a:b]
        p, q = powers(b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_TABLE[LOWER[part] if lower else part] * p, out=total[1:])
        out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * q[starts[i:j] - a]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


class Words:
    """Hashes of a batch's words; at[i] : at[i + 1] are those of its i-th text."""

    def __init__(self, column: pa.Array, lower: bool = True) -> None:
        self.data, self.off = buffers(column)
        self.starts, self.ends = word_spans(self.data, self.off)
        self.hash = span_hashes(self.data, self.starts, self.ends, lower)
        self.at = np.searchsorted(self.starts, self.off)
        self.n = np.diff(self.at)

    def text(self, i: int) -> np.ndarray:
        return self.hash[self.at[i] : self.at[i + 1]]


def field(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column, or with a dot in its path a field of a struct column."""
    name, _, inner = path.partition(".")
    return batch.column(name).field(inner) if inner else batch.column(name)


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about size bytes of a string column, at least one row each.

    What a batch took is given back to the system before the next one comes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(field(batch, column))
        i = 0
        while i < batch.num_rows:
            j = max(int(np.searchsorted(off, off[i] + size, side="right")) - 1, i + 1)
            yield batch.slice(i, j - i)
            i = j
        pa.default_memory_pool().release_unused()


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Order-dependent hash of several arrays of hashes."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = h * np.uint64(0xD6E8FEB86659FD93) + p
    return mix(h)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of size words; of the whole sequence if it is shorter."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    return np.unique(combine([words[i : len(words) - n + 1 + i] for i in range(n)]))


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
