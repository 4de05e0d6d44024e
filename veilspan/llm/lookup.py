"""A table from integers to integers that looks up and takes arrays of keys at once."""

from __future__ import annotations

import numpy as np


class Lookup:
    """Open addressing over arrays of a power of two; at most half of the places are taken."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None):
        self._room(1 << 10)
        if keys is not None:
            self.add(keys, values)

    def __len__(self) -> int:
        return self._n

    def _room(self, size: int) -> None:
        self._keys, self._values, self._n = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64), 0
        self._shift = np.uint64(64 - (size.bit_length() - 1))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Takes distinct keys of at least 0 that the table does not hold yet."""
        if 2 * (self._n + len(keys)) > len(self._keys):
            held = self._keys >= 0
            keys, values = np.concatenate([self._keys[held], keys]), np.concatenate([self._values[held], values])
            self._room(1 << int(4 * len(keys)).bit_length())
        keys, values = np.ascontiguousarray(keys, dtype=np.int64), np.asarray(values, dtype=np.int64)
        self._n += len(keys)
        at = self._home(keys)
        while len(keys):
            free = self._keys[at] < 0
            self._keys[at[free]] = keys[free]
            won = self._keys[at] == keys
            self._values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (len(self._keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys; -1 where a key is not held."""
        keys = np.ascontiguousarray(keys, dtype=np.int64)
        at = self._home(keys)
        found = self._keys[at]
        out = np.where(found == keys, self._values[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self._keys) - 1)
            found = self._keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self._values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out
