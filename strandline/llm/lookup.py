"""A frozen hash table of 64-bit keys that numpy searches for whole arrays at once."""

from __future__ import annotations

import numpy as np

EMPTY = np.uint64(2**64 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Places of keys in the array it was built from, by open addressing with linear probing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.given = keys
        self.size = 1 << max(4, (len(keys) * 3).bit_length())
        self.shift = np.uint64(64 - (self.size.bit_length() - 1))
        self.keys, self.places = np.full(self.size, EMPTY, np.uint64), np.full(self.size, -1, np.int32)
        self.probes = 1
        rest = np.arange(len(keys))
        slot = ((keys * MIX) >> self.shift).astype(np.int64)
        while len(rest):
            free = np.flatnonzero(self.keys[slot] == EMPTY)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.places[slot[put]] = keys[rest[put]], rest[put]
            left = np.ones(len(rest), bool)
            left[put] = False
            rest, slot = rest[left], (slot[left] + 1) & (self.size - 1)
            self.probes += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is unknown."""
        slot = ((keys * MIX) >> self.shift).astype(np.int64)
        found = np.full(len(keys), -1, np.int32)
        there = self.keys[slot]
        hit = there == keys
        found[hit] = self.places[slot[hit]]
        rest = np.flatnonzero(~hit & (there != EMPTY))
        for _ in range(self.probes):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & (self.size - 1)
            at = slot[rest]
            there = self.keys[at]
            hit = there == keys[rest]
            found[rest[hit]] = self.places[at[hit]]
            rest = rest[~hit & (there != EMPTY)]
        return found
