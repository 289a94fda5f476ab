"""Range asymmetric numeral system with a static table, many blocks and lanes at a time.

A block holds ``STEPS * LANES`` symbols in ``LANES`` interleaved states that share one run of
32-bit words. Blocks know nothing of each other, so any of them can be decoded alone; the
encoder and the decoder take all blocks of a segment one step at a time.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Frequencies sum to ``2 ** SCALE``; states stay in ``[2 ** 31, 2 ** 63)``.
SCALE, LANES, STEPS = 20, 32, 512
BLOCK = LANES * STEPS
LOW = np.uint64(1 << 31)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum ``2 ** SCALE``, at least 1 for every symbol that is there."""
    total, size = int(counts.sum()), 1 << SCALE
    if int((counts > 0).sum()) > size:
        raise ValueError("more symbols than the scale can hold")
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts.astype(float) * size / total)), 0).astype(np.int64)
    while (over := int(freq.sum()) - size) > 0:  # what the ones cost, the largest pay
        big = np.argsort(-freq, kind="stable")[: max(1, min(over, int((freq > 1).sum())))]
        freq[big] -= np.minimum(np.maximum(1, over // len(big)), freq[big] - 1)
    freq[int(np.argmax(freq))] += size - int(freq.sum())
    return freq


def encode(symbols: np.ndarray, freq: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(states, words, first)``: ``words[first[b]:first[b + 1]]`` are block ``b``'s; the last block is filled with ``pad``."""
    n = -(-len(symbols) // BLOCK)
    grid = np.full(n * BLOCK, pad, np.int64)
    grid[: len(symbols)] = symbols
    grid = grid.reshape(n, STEPS, LANES)
    freq, cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    x = np.full((n, LANES), LOW, np.uint64)
    words, sent = np.zeros((n, STEPS, LANES), np.uint32), np.zeros((n, STEPS, LANES), bool)
    for s in range(STEPS - 1, -1, -1):
        f = freq[grid[:, s, :]]
        out = x >= f << np.uint64(63 - SCALE)
        words[:, s, :], sent[:, s, :] = x.astype(np.uint32), out
        x = np.where(out, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + cum[grid[:, s, :]]
    return x, words[sent], np.r_[0, np.cumsum(sent.sum(axis=(1, 2)))]


def decode(states: np.ndarray, words: np.ndarray, first: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The symbols of whole blocks, padding included."""
    n = len(states)
    table = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq)
    freq, cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    words = np.r_[words.astype(np.uint64), np.zeros(LANES, np.uint64)]
    x, at = states.astype(np.uint64).copy(), first[:-1].copy()
    out = np.zeros((n, STEPS, LANES), table.dtype)
    for s in range(STEPS):
        slot = x & np.uint64((1 << SCALE) - 1)
        sym = table[slot]
        out[:, s, :] = sym
        x = freq[sym] * (x >> np.uint64(SCALE)) + slot - cum[sym]
        need = x < LOW
        take = at[:, None] + np.cumsum(need, axis=1) - need
        x = np.where(need, (x << np.uint64(32)) | words[np.minimum(take, len(words) - 1)], x)
        at += need.sum(axis=1)
    return out.reshape(-1)


def checksums(states: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(words[a:b].tobytes(), zlib.crc32(s.tobytes())) for s, a, b in zip(states, first[:-1], first[1:], strict=True)], np.uint32)
