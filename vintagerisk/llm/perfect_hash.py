"""A minimal perfect hash of 64-bit integers in numpy, with the keys beside it for verification.

Level by level the keys still without a place are hashed into a bit array; a bit that exactly one key meets is set and
the key is done, the others go on. A key's number is the count of set bits before its own, so n keys get the numbers
0 to n - 1 in about three bits each. The few keys left after the last level are kept in a sorted list.
"""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS = 1.6, 24


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """`number(keys)`: the number of each key, -1 for one that was not hashed."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, late: np.ndarray, keys: np.ndarray | None = None) -> None:
        self.sizes, self.words, self.late, self.keys = sizes, words, late, keys
        self.shift = np.r_[0, np.cumsum(sizes)]
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct, int64."""
        sizes, parts, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-int(GAMMA * len(left) + 1) // 64) * 64
            place = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[place]]
        words = np.concatenate([np.empty(0, np.uint64), *parts])
        self = cls(np.array(sizes, np.int64), words, np.sort(left))
        order = np.empty(len(keys), np.int64)
        order[self._unverified(keys)] = keys
        self.keys = order
        return self

    def _unverified(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            bit = self.shift[level] + (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, offset = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> offset & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << offset) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[bit >> 6] + below)[hit]
            left = left[~hit]
        if len(self.late) and len(left):
            at = np.searchsorted(self.late, keys[left])
            there = self.late[np.minimum(at, len(self.late) - 1)] == keys[left]
            out[left[there]] = self.before[-1] + at[there]
        return out

    def number(self, keys: np.ndarray) -> np.ndarray:
        found = self._unverified(keys)
        known = found >= 0
        known[known] = self.keys[found[known]] == keys[known]
        return np.where(known, found, -1)

    def dump(self) -> dict[str, bytes]:
        return {"sizes": self.sizes.tobytes(), "words": self.words.tobytes(), "late": self.late.tobytes(), "keys": self.keys.tobytes()}

    @classmethod
    def load(cls, sizes: bytes, words: bytes, late: bytes, keys: bytes) -> PerfectHash:
        return cls(np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64), np.frombuffer(late, np.int64), np.frombuffer(keys, np.int64))
