"""A cuckoo filter in numpy: 16-bit fingerprints, four to a bucket, whole batches added, asked for and removed at once.

Keys come as two 64-bit halves of a 128-bit digest. A fingerprint has two buckets, each found from the other and the
fingerprint alone, so entries can be moved and removed. What finds no place stays in a small side list, so nothing
is ever forgotten; a key that was added is always found. Removing is right for keys that were added and not removed since.
"""

from __future__ import annotations

import numpy as np

SLOTS, LOAD = 4, 0.85
HEADER = 3


class CuckooFilter:
    def __init__(self, capacity: int) -> None:
        buckets = 1 << max(4, int(np.ceil(np.log2(capacity / SLOTS))))
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.side = np.zeros((0, 2), np.int64)  # bucket, fingerprint
        self.count = 0

    @property
    def room(self) -> int:
        return max(0, int(self.table.size * LOAD) - self.count)

    def _place(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bucket and fingerprint; shards go by `hi`, so both come from `lo`."""
        lo = lo.view(np.uint64)
        return (lo >> np.uint64(16)).astype(np.int64) & (len(self.table) - 1), 1 + (lo % np.uint64(65535)).astype(np.int64)

    def _other(self, bucket: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        return bucket ^ ((fingerprint * 0x5BD1E995 >> 7) & (len(self.table) - 1))

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        bucket, print_ = self._place(hi, lo)
        other = self._other(bucket, print_)
        found = (self.table[bucket] == print_[:, None]).any(1) | (self.table[other] == print_[:, None]).any(1)
        if len(self.side):
            code = lambda b, f: b << 16 | f
            held = code(self.side[:, 0], self.side[:, 1])
            found |= np.isin(code(bucket, print_), held) | np.isin(code(other, print_), held)
        return found

    def add(self, hi: np.ndarray, lo: np.ndarray, rounds: int = 200) -> None:
        bucket, print_ = self._place(hi, lo)
        self.count += len(bucket)
        draw = np.random.default_rng(self.count)
        for n in range(rounds):
            order = np.argsort(bucket, kind="stable")
            bucket, print_ = bucket[order], print_[order]
            first = np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]
            start = np.flatnonzero(first)
            rank = np.arange(len(bucket)) - np.repeat(start, np.diff(np.r_[start, len(bucket)]))
            free = np.cumsum(self.table[bucket] == 0, axis=1)
            fits = rank < free[:, -1]
            slot = np.argmax(free[fits] > rank[fits, None], axis=1)
            self.table[bucket[fits], slot] = print_[fits]
            bucket, print_, first = bucket[~fits], print_[~fits], None
            if not len(bucket):
                return
            if n:  # one entry of each full bucket takes the place of another, which goes on to its own other bucket
                _, one = np.unique(bucket, return_index=True)
                slot = draw.integers(0, SLOTS, len(one))
                moved = self.table[bucket[one], slot].astype(np.int64)
                self.table[bucket[one], slot] = print_[one]
                print_[one] = moved
            bucket = self._other(bucket, print_)
        self.side = np.concatenate([self.side, np.column_stack([bucket, print_])])

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Take one copy of each key out; whether it was there."""
        bucket, print_ = self._place(hi, lo)
        gone = np.zeros(len(bucket), bool)
        left = np.arange(len(bucket))
        for place in (bucket, self._other(bucket, print_)):
            while len(left):  # keys of one bucket and fingerprint go one after the other
                hit = self.table[place[left]] == print_[left, None]
                there = left[hit.any(1)]
                _, one = np.unique(place[there] << 16 | print_[there], return_index=True)
                now = there[one]
                if not len(now):
                    break
                self.table[place[now], np.argmax(self.table[place[now]] == print_[now, None], axis=1)] = 0
                gone[now] = True
                left = left[~np.isin(left, now)]
        for k in left.tolist():
            pairs = [bucket[k], self._other(bucket[k : k + 1], print_[k : k + 1])[0]]
            at = np.flatnonzero(np.isin(self.side[:, 0], pairs) & (self.side[:, 1] == print_[k]))[:1]
            self.side, gone[k] = np.delete(self.side, at, axis=0), len(at) > 0
        self.count -= int(gone.sum())
        return gone

    def dump(self) -> bytes:
        return np.array([self.count, len(self.table), len(self.side)], np.int64).tobytes() + self.table.tobytes() + self.side.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        self = cls.__new__(cls)
        head = 8 * HEADER
        self.count, buckets, side = np.frombuffer(data[:head], np.int64).tolist()
        end = head + 2 * SLOTS * buckets
        self.table = np.frombuffer(data[head:end], np.uint16).reshape(buckets, SLOTS).copy()
        self.side = np.frombuffer(data[end:], np.int64).reshape(side, 2).copy()
        return self


class FilterChain:
    """Filters of growing size: when the last one is full, one twice as large follows."""

    def __init__(self, capacity: int, filters: list[CuckooFilter] | None = None) -> None:
        self.capacity, self.filters = capacity, filters or []

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hi), bool)
        for f in self.filters:
            found |= f.contains(hi, lo)
        return found

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        while len(hi):
            if not self.filters or not self.filters[-1].room:
                self.filters.append(CuckooFilter(self.capacity << len(self.filters)))
            last = self.filters[-1]
            n = last.room
            last.add(hi[:n], lo[:n])
            hi, lo = hi[n:], lo[n:]

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        # largest first: entries that are alike in a larger filter are alike in all smaller ones, so taking either is right
        for f in reversed(self.filters):
            there = f.remove(hi, lo)
            hi, lo = hi[~there], lo[~there]
