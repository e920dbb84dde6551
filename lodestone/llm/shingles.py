"""Hashes of word shingles, by array operations over the bytes of a text."""

from __future__ import annotations

import numpy as np

from .common import worker_state

BASE = 0x9E3779B97F4A7C15 | 1
STEP = np.uint64(0xD6E8FEB86659FD93)
#: The white space between words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and its inverse for k below n, at 64 bits."""
    state = worker_state()
    have = getattr(state, "powers", None)
    if have is None or len(have[0]) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        for out, by in ((up, BASE), (down, pow(BASE, -1, 1 << 64))):
            out[0], k = 1, 1
            while k < size:
                out[k : 2 * k] = out[:k] * np.uint64(pow(by, k, 1 << 64))
                k *= 2
        have = state.powers = (up, down)
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * STEP
    h = (h ^ (h >> np.uint64(29))) * STEP
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word, A-Z taken as a-z."""
    a = np.frombuffer(text.encode().lower(), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], WHITE[a], [True]))))
    if not len(edges):
        return np.empty(0, np.uint64)
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of fewer words, one hash of all."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    m = len(w) - k + 1
    out = np.full(m, k, np.uint64)
    for j in range(k):
        out = mixed(out * STEP + w[j : j + m])
    return np.unique(out)
