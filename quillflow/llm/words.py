"""Words and word shingles of texts as 64-bit hashes, computed for many documents in one numpy pass.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. A word's hash is a polynomial over its bytes
modulo 2**64 (taken from prefix sums, so all words of a chunk are hashed at once), mixed with its
length. Two of n different words share a hash with a probability of about n**2 / 2**65.
"""

from __future__ import annotations

import numpy as np

from quillflow.llm.common import CHUNK_BYTES, LOWER_BYTES, per_worker

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit (a bijection of 64-bit integers)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = per_worker("powers", (), dict)
    if len(held.get("n", ())) < n:
        for name, base in (("n", _BASE), ("inv", _INVERSE)):
            steps = np.full(max(n, CHUNK_BYTES + (1 << 16)), base, np.uint64)
            steps[0] = 1
            held[name] = np.cumprod(steps, dtype=np.uint64)
    return held["n"][:n], held["inv"][:n]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word (one more entry at the end)."""
    data = b"\n".join(texts)
    if lower:
        data = data.translate(LOWER_BYTES)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    codes = np.frombuffer(data, np.uint8)
    if not len(codes):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = np.concatenate(([False], ~_SPACE[codes], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * power, out=sums[1:])
    if len(starts):
        hashes = (sums[ends] - sums[starts]) * inverse[starts]
        hashes = mix(hashes ^ ((ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
    else:
        hashes = np.empty(0, np.uint64)
    return hashes, np.searchsorted(starts, first)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of ``size``-word shingles, sorted; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return words
    take = min(n, size)
    out = np.zeros(n - take + 1, np.uint64)
    for k in range(take):
        out = mix(out + words[k:n - take + 1 + k] + _U(take))
    return np.unique(out)
