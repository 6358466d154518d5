"""64-bit hashes of a text's words and shingles, computed on whole byte arrays."""

from __future__ import annotations

import numpy as np

#: Bytes that separate words: space and 0x09-0x0D. UTF-8 keeps them apart from all other characters.
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time.
_BLOCK = 1 << 22


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_hashes(raw: np.ndarray) -> np.ndarray:
    gap = _GAP[raw]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    longest = int(sizes.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    values = (raw[~gap].astype(np.uint64) + np.uint64(1)) * powers[inside]
    return mix(np.add.reduceat(values, before) + sizes.astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words (runs of other than white space, A-Z lower-cased) in their order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    if len(raw) <= _BLOCK:
        return _block_hashes(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(at + _BLOCK, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(_GAP[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(_GAP[raw[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(raw)
        out.append(_block_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words count as one run."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    value = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        value = (value ^ words[i : n - k + 1 + i]) * _BASE
        value ^= value >> np.uint64(32)
    return np.unique(mix(value))
