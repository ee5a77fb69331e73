"""Shingle sets of texts as sorted arrays of 64-bit hashes; used inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingles of ``words`` words, A-Z in lower case; fewer words make one shingle, none make none."""
    # of bytes, lower() knows A-Z only, and split() just the six ASCII white spaces
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(found, dtype=object), categorize=False)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mixed(out * _ODD + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def digest(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
