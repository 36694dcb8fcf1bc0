"""Vectorised lookup of 64-bit keys in a fixed set."""

from __future__ import annotations

import numpy as np

from .common import U64, mix


class Lookup:
    """``find`` gives each key's index in ``keys`` as passed, or -1.

    Keys are scrambled and sorted; the leading bits of a query name the short run of sorted
    keys that can hold it."""

    def __init__(self, keys: np.ndarray):
        scrambled = mix(keys.astype(U64))
        self.order = np.argsort(scrambled, kind="stable").astype(np.int32)
        self.keys = scrambled[self.order]
        bits = max(8, min(22, len(keys).bit_length() + 1))
        self.shift = U64(64 - bits)
        self.start = np.searchsorted(self.keys, np.arange(1 << bits, dtype=U64) << self.shift).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(keys)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        q = mix(keys.astype(U64))
        slot = (q >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        out = np.full(len(q), -1, np.int32)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == q[left]
            out[left[hit]] = self.order[here[hit]]
            at[left] += 1
            left = left[~hit]
            left = left[at[left] < end[left]]
        return out
