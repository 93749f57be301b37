"""Hashes of any span of bytes from prefix sums: polynomials modulo 2^64, as array arithmetic.

Adversaries can make spans of over a thousand bytes collide, so equal hashes are followed by a comparison of bytes wherever it matters.
"""

from __future__ import annotations

import numpy as np

from echotrace.llm._common import process_cache

#: Two odd bases of the polynomial hash modulo 2^64, and an odd number to mix with.
BASE, OTHER_BASE, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse inside a block."""
    cache = process_cache("prefix-powers")
    if base not in cache:
        cache[base] = _powers(base, _BLOCK), _powers(pow(base, -1, 1 << 64), _BLOCK)
    return cache[base]


def prefix_at(raw: np.ndarray, places: np.ndarray, base: int = BASE) -> np.ndarray:
    """The sum of raw[i] * base^i over i < place, for ascending places."""
    up, out, carry, shift = _tables(base)[0], np.zeros(len(places), dtype=np.uint64), 0, 1
    cuts = np.searchsorted(places, np.arange(0, len(raw) + _BLOCK, _BLOCK), "left")
    for k, begin in enumerate(range(0, len(raw) + 1, _BLOCK)):
        part = raw[begin : begin + _BLOCK]
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(part * up[: len(part)])))
        lo, hi = cuts[k], cuts[k + 1] if k + 1 < len(cuts) else len(places)
        out[lo:hi] = np.uint64(carry) + np.uint64(shift) * sums[places[lo:hi] - begin]
        carry = (carry + shift * int(sums[-1])) % (1 << 64)
        shift = shift * pow(base, _BLOCK, 1 << 64) % (1 << 64)
    return out


def inverse_power(places: np.ndarray, base: int = BASE) -> np.ndarray:
    """base^-place."""
    top = int(places.max(initial=0)) // _BLOCK + 1
    return _powers(pow(base, -_BLOCK, 1 << 64), top)[places // _BLOCK] * _tables(base)[1][places % _BLOCK]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))
