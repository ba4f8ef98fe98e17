"""SetSketch registers (Ertl, "SetSketch: Filling the Gap between MinHash and HyperLogLog", VLDB 2021) in numpy.

Register i of a set holds floor(1 - log_b(x_i)), cut to 0..q+1, where x_i is the smallest of the exponential variates (rate a) that hash function i
gives the set's elements. A union's registers are the elementwise maxima, so sketches merge; equal registers are as likely as shared elements, so
they can be banded; and greater / equal / smaller registers of two sketches give the Jaccard similarity by maximum likelihood.
"""

from __future__ import annotations

import numpy as np

#: Base of the registers' spacing and their largest value less one. With a = 20 they reach sets of over 1e9 elements.
B, Q, A = 1.02, 1_200, 20.0
GOLDEN = 0x9E3779B97F4A7C15


def _constants(m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, m, dtype=np.uint32), rng.integers(0, 1 << 31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def sketches(elements: np.ndarray, begin: np.ndarray, m: int, seed: int = 5, block: int = 1 << 15) -> np.ndarray:
    """Registers (sets, m) as uint16 of the sets elements[begin[i]:begin[i+1]]; all are 0 for an empty set."""
    sizes = np.diff(begin)
    out = np.zeros((len(sizes), m), np.uint16)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    xor, odd = _constants(m, seed)
    short = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full((m, len(full)), 0xFFFFFFFF, np.uint32)
    starts, ends = begin[:-1][full], begin[1:][full]
    i = 0
    while i < len(full):  # runs of sets that fit the cache; a set larger than that goes in parts
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        for lo in range(int(starts[i]), int(ends[j - 1]), block) if j == i + 1 else [int(starts[i])]:
            hi = min(lo + block, int(ends[j - 1])) if j == i + 1 else int(ends[j - 1])
            part, cuts = short[lo:hi], (starts[i:j] - lo).clip(0)
            work = np.empty_like(part)
            for k in range(m):
                np.bitwise_xor(part, xor[k], out=work)
                np.multiply(work, odd[k], out=work)
                work ^= work >> np.uint32(16)
                low = np.minimum.reduceat(work, cuts)
                np.minimum(least[k, i:j], low, out=least[k, i:j])
        i = j
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 4294967296.0) / A
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint16)
    return out


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(one, other)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash (sets, bands) of each band of `rows` registers."""
    from .textbytes import mix

    out = np.zeros((len(registers), bands), np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(GOLDEN) + registers[:, r : bands * rows : rows].astype(np.uint64) + np.uint64(1))
    return out


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1 - 1e-12) * (B - 1) / B) / np.log(B)


def _log_likelihood(j, greater, smaller, equal, u, v):
    up, down = _p(u - v * j), _p(v - u * j)
    return greater * np.log(up) + smaller * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))


def joint_estimate(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray, least: float = 0.8, grid: int = 101) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of sketches with known set sizes: the similarity of maximum likelihood, and by how much a similarity of `least` or more is less likely (log, 0 if the estimate reaches it)."""
    greater, smaller = (one > other).sum(1), (one < other).sum(1)
    equal = one.shape[1] - greater - smaller
    u = n_one / np.maximum(n_one + n_other, 1)
    v = 1 - u
    most = np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12)
    best, best_j, over = np.full(len(u), -np.inf), np.zeros(len(u)), np.full(len(u), -np.inf)
    for share in np.linspace(0, 1, grid):
        for j in (share * most, np.minimum(least + (1 - least) * share, most)):
            value = _log_likelihood(j, greater, smaller, equal, u, v)
            better = value > best
            best, best_j = np.where(better, value, best), np.where(better, j, best_j)
            over = np.where((j >= least - 1e-9) & (value > over), value, over)
    return best_j, best - over
