"""Hashed byte-trigram vectors of whole texts."""

from __future__ import annotations

import numpy as np

WIDTH = 4096
_PIECE = 1 << 20


def trigram_counts(text: str | None) -> np.ndarray:
    """Counts of hashed byte trigrams of the lower-cased text between two spaces."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.zeros(WIDTH, dtype=np.int64)
    for i in range(0, max(0, len(raw) - 2), _PIECE):
        b = raw[i : i + _PIECE + 2].astype(np.uint32)
        h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        h *= np.uint32(2654435761)
        counts += np.bincount(h >> np.uint32(20), minlength=WIDTH)
    return counts


def unit_vector(text: str | None) -> np.ndarray:
    """Square roots of the relative frequencies: length 1, or 0 if there is no trigram."""
    counts = trigram_counts(text)
    return np.sqrt(counts / max(1, counts.sum()), dtype=np.float64).astype(np.float32)
