"""Vectorised word splitting and hashing over the raw bytes of Arrow string columns.

Texts never become Python strings here: a batch is one byte buffer with document offsets, words are
(start, end) pairs and hashes are sums over prefix arrays, so the cost is a few nanoseconds a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.  Work arrays take about 40 times as much.
CHUNK_BYTES = 512 << 10

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[name] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that order and low bits of a hash are usable."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return body, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes each, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


@dataclass
class Words:
    """Words of consecutive documents: byte ranges into ``buf``; ``first[d]:first[d + 1]`` are those of document d."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.buf)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * _power("up", _BASE, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * _power("down", _INV, n + 1)[self.start])

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def split_words(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    n = len(buf)
    solid = ~separator[buf]
    begin, stop = solid.copy(), solid.copy()
    if n:
        begin[1:] &= ~solid[:-1]
        stop[:-1] &= ~solid[1:]
        full = np.flatnonzero(np.diff(offsets))
        begin[offsets[full]] = solid[offsets[full]]
        stop[offsets[full + 1] - 1] = solid[offsets[full + 1] - 1]
    start = np.flatnonzero(begin)
    return Words(buf, start, np.flatnonzero(stop) + 1, np.searchsorted(start, offsets))


def batches_of_words(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first document, end, words) for slices of a string column."""
    body, offsets = string_buffers(column)
    for i, j in slices(offsets):
        part = body[offsets[i] : offsets[j]]
        yield i, j, split_words(LOWER[part] if lower else part, offsets[i : j + 1] - offsets[i])


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive hashes; the caller drops those that cross documents."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, np.uint64(k * 2654435761 + seed), np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93) + np.uint64(2 * seed)
    for j in range(k):
        out = out * factor + h[j : j + n]
    return mix(out)


def inside(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of n positions, whether k words from there belong to one document."""
    ok = np.zeros(n, bool)
    if n:
        left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
        ok = left >= k
    return ok


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def joined(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: bytes and offsets (each document has one space at its end, unless empty)."""
    start, end = w.start[keep], w.end[keep]
    size = end - start + 1
    total = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(total[-1]) - np.repeat(total[:-1] - start, size)
    padded = np.concatenate((w.buf, np.array([0x20], np.uint8)))
    out = padded[index]
    out[total[1:] - 1] = 0x20
    kept_before = np.concatenate(([0], np.cumsum(keep)))
    return out, total[kept_before[w.first]]
