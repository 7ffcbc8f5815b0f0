"""Hashed names of fixed-length stretches, built by recursion on triples.

A name of length L at position p stands for the L symbols from p. Names of a
longer length are made from three names of a shorter one, as in the recursion
of a difference-cover suffix sort, but a triple is named by a 64-bit hash
instead of by its rank, so that no level needs a global sort of its own. Equal
stretches always have equal names; different ones share a name with a
probability of about 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np

# Odd multipliers of the 64-bit mixing steps (golden ratio, and two of splitmix64).
_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xBF58476D1CE4E5B9)
_K3 = np.uint64(0x94D049BB133111EB)
_S29, _S32 = np.uint64(29), np.uint64(32)
_CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A fresh array of well-mixed 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= _K2
    x ^= x >> np.uint64(27)
    x *= _K3
    x ^= x >> np.uint64(31)
    return x


def triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The names of triples of names."""
    x = a * _K1
    x ^= x >> _S29
    x += b
    x *= _K2
    x ^= x >> _S32
    x += c
    x *= _K3
    x ^= x >> _S29
    return x


def lengths(base: int, target: int) -> list[int]:
    """Lengths that lead from base to target, each at most three times the one before."""
    out = [target]
    while out[-1] > base:
        out.append(max(base, -(-out[-1] // 3)))
    return out[::-1]


def _grown(names: np.ndarray, steps: list[int]) -> np.ndarray:
    for short, long in zip(steps, steps[1:], strict=False):
        middle, last = (long - short + 1) // 2, long - short
        n = len(names) - last
        names = triple(names[:n], names[middle : middle + n], names[last : last + n])
    return names


def byte_names(data: np.ndarray, length: int, where: np.ndarray | None = None) -> np.ndarray:
    """Names of length bytes from each position (of a uint8 array) that has as many left, or from those in where (ascending) alone.

    Memory beside the result is that of a chunk: very long inputs cost no more.
    """
    total = max(0, len(data) - length + 1)
    steps = lengths(5, length)
    out = []
    for lo in range(0, total, _CHUNK):
        hi = min(total, lo + _CHUNK)
        if where is not None:
            a, b = np.searchsorted(where, (lo, hi))
            if a == b:
                continue
        d = data[lo : hi + length - 1].astype(np.uint64)
        n = len(d) - 4
        x = d[:n].copy()
        for k in range(1, 5):
            x |= d[k : n + k] << np.uint64(8 * k)
        names = _grown(x, steps)
        out.append(names if where is None else names[where[a:b] - lo])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def symbol_names(symbols: np.ndarray, length: int) -> np.ndarray:
    """Names of length symbols from each position of an array of 64-bit symbol hashes."""
    if len(symbols) < length:
        return np.empty(0, np.uint64)
    return _grown(mix(symbols), lengths(1, length))


def difference_cover(period: int) -> np.ndarray:
    """Residues whose differences give every residue modulo period: for any two
    positions some shift below the period brings both to a cover position.

    Perfect difference sets where they are known (period q^2+q+1), else the
    plain cover of about two times the root.
    """
    # Perfect difference sets, from the tables of Singer sets.
    known = {
        7: (0, 1, 3),
        13: (0, 1, 3, 9),
        21: (0, 1, 4, 14, 16),
        31: (0, 1, 3, 8, 12, 18),
        57: (0, 1, 3, 13, 32, 36, 43, 52),
        73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
        91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
        133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
    }
    if period in known:
        return np.array(known[period])
    root = int(np.ceil(np.sqrt(period)))
    return np.unique(np.r_[np.arange(root), np.arange(0, period, root)] % period)
