"""Words, hashes and windows of many texts at once, as numpy arrays over the Arrow buffers.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes are polynomials modulo 2^64 over a table of
random odd numbers, so that any window's hash is a difference of prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are scanned at a time; a longer text is scanned alone, whole.
STEP = 1 << 19
BYTE_BASE = 0x9E3779B97F4A7C15 | 5
WORD_BASE = 0xD1342543DE82EF95
WRAP = 1 << 64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of ``x`` over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)``; grown as needed, kept up to the usual step."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, STEP + 1024)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * STEP:
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, WRAP)


@dataclass
class Words:
    """Words of consecutive texts. ``first[i]:first[i + 1]`` are the words of text ``i``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[self.data] * powers(BYTE_BASE, n), out=total[1:])
        raw = (total[self.end] - total[self.start]) * powers(inverse(BYTE_BASE), n + 1)[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries; runs across texts are the caller's to leave out."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(WORD_BASE, n), out=total[1:])
    return mix((total[size:] - total[: n - size + 1]) * powers(inverse(WORD_BASE), n - size + 1))


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Which of the ``n - size + 1`` runs lie within one text."""
    n = int(first[-1])
    if n < size:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(n - size + 1) + size <= ends[: n - size + 1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets is not None and len(texts) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_, at


def spans(at: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``step`` bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, side="right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``data[at[i]:at[i + 1]]``."""
    lo, hi = int(at[0]), int(at[-1])
    data, at = data[lo:hi], at - lo
    n = len(data)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
    solid = (data != 32) & ((data - np.uint8(9)) >= 5)
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    if n:
        cuts = at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begins[cuts] |= solid[cuts]
        stops[cuts - 1] |= solid[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def scan(texts: pa.Array, lower: bool = False, step: int = STEP) -> Iterator[tuple[int, int, Words]]:
    """``(i, j, words of texts i to j)`` step by step."""
    data, at = buffers(texts)
    for i, j in spans(at, step):
        yield i, j, words(data, at[i : j + 1], lower)
