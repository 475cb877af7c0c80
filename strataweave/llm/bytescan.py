"""Words and shingles of whole texts as 64-bit hashes, from Arrow's UTF-8 buffers with numpy alone.

A word's hash is a polynomial over a fixed random table of bytes, taken from prefix sums and mixed; two different
words (or shingles) share a hash with a chance of about 2^-64. Work goes block by block, so memory follows ``BLOCK`` and
the number of words of the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64 bits; ``h`` is an array, since numpy warns of overflow in scalars."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), o.astype(np.int64)


def _block(data: np.ndarray, cuts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``data``; no word reaches over ``cuts``."""
    sep = SEPARATOR[data]
    begin, end = ~sep, ~sep
    begin[1:] &= sep[:-1]
    end[:-1] &= sep[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    begin[inner] |= ~sep[inner]
    end[inner - 1] |= ~sep[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, hashes, bounds): the word hashes of texts[from:to]; text i has hashes[bounds[i - from]:bounds[i - from + 1]]."""
    data, offsets = buffers(texts)
    table = _LOWER if lower else _TABLE
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, side="right")) - 1)
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= 2 * BLOCK:
            starts, _, hashes = _block(data[lo:hi], offsets[a : b + 1] - lo, table)
            bounds = np.searchsorted(starts, offsets[a : b + 1] - lo)
        else:  # one long text, cut at separators
            parts, at = [], lo
            while at < hi:
                to = min(hi, at + BLOCK)
                while to < hi and not SEPARATOR[data[to - 1]]:
                    gap = np.flatnonzero(SEPARATOR[data[to : min(hi, to + BLOCK)]])
                    to = to + int(gap[0]) + 1 if len(gap) else min(hi, to + BLOCK)
                parts.append(_block(data[at:to], np.zeros(0, np.int64), table)[2])
                at = to
            hashes = np.concatenate(parts)
            bounds = np.array([0, len(hashes)])
        yield a, b, hashes, bounds
        a = b


_ODD = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; with fewer words, of the whole sequence; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(n, size)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out += mix(hashes[j : n - k + 1 + j] * _ODD[j % 5] + np.uint64(j))
    return mix(out)
