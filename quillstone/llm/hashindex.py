"""A read-only table from distinct 64-bit keys to row numbers, with all lookups of a batch as array operations."""

from __future__ import annotations

import numpy as np

from .textbytes import mix


class HashIndex:
    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(len(keys) * 2).bit_length())
        self.mask, self.keys = np.int64(size - 1), keys.astype(np.uint64)
        self.rows = np.full(size, -1, np.int32)
        slot, rest = self._slot(self.keys), np.arange(len(keys), dtype=np.int32)
        while len(rest):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = rest[free]
            lost = self.rows[slot] != rest
            rest, slot = rest[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if there is none."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        slot, which = self._slot(keys), None
        while True:
            row = self.rows[slot]
            own = keys if which is None else keys[which]
            hit = (row >= 0) & (self.keys[row] == own)
            if which is None:
                out[hit] = row[hit]
                which = np.arange(len(keys))
            else:
                out[which[hit]] = row[hit]
            go = (row >= 0) & ~hit
            if not go.any():
                return out
            which, slot = which[go], (slot[go] + 1) & self.mask
