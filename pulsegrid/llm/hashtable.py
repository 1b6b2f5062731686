"""An open-addressing table from 64-bit keys to positions, probed for whole arrays at once."""

from __future__ import annotations

import numpy as np

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class HashTable:
    """Positions 0, 1, 2 ... in order of insertion; at most half of the slots are used."""

    def __init__(self, room: int = 1 << 10):
        self.bits = max(4, int(2 * room - 1).bit_length())
        self.size = 0
        self.slots = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _usable(keys: np.ndarray) -> np.ndarray:
        return np.maximum(keys, np.uint64(1))  # 0 marks a free slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is absent."""
        keys = self._usable(keys)
        out = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), self._home(keys)
        while len(left):
            there = self.slots[slot]
            hit = there == keys
            out[left[hit]] = self.at[slot[hit]]
            go = ~hit & (there != 0)
            left, keys, slot = left[go], keys[go], (slot[go] + 1) & (len(self.slots) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Insert distinct keys that are absent."""
        keys = self._usable(keys)
        if 2 * (self.size + len(keys)) > len(self.slots):
            used = np.flatnonzero(self.slots)
            old = np.empty(self.size, np.uint64)
            old[self.at[used]] = self.slots[used]
            self.__init__(2 * (self.size + len(keys)))
            keys = np.concatenate([old, keys])
        value = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        slot = self._home(keys)
        while len(keys):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = keys[free]  # of several keys for one slot, one stays
            won = free & (self.slots[slot] == keys)
            self.at[slot[won]] = value[won]
            keys, value, slot = keys[~won], value[~won], (slot[~won] + 1) & (len(self.slots) - 1)
