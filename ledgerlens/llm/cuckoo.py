"""A cuckoo filter over 64-bit hashes, filled and probed in numpy batches.

Buckets hold four 16-bit fingerprints.  A fingerprint lives in one of two buckets;
either is found from the other and the fingerprint alone, so entries can move and
can be deleted.  A lookup errs only towards yes, about 8 times in 65536.  Entries
that find no place after many moves go to an exact overflow list, so the filter never
loses one.
"""

from __future__ import annotations

import numpy as np

from .words import mix

SLOTS, MOVES, LOAD = 4, 400, 0.85
_U64 = np.uint64


class CuckooFilter:
    """insert() and delete() take hashes with multiplicity; delete() only what was inserted."""

    def __init__(self, capacity: int):
        self.buckets = 1 << max(0, int(np.ceil(np.log2(max(1.0, capacity / (SLOTS * LOAD))))))
        self.slots = np.zeros((self.buckets, SLOTS), np.uint16)
        self.overflow = np.zeros(0, np.uint64)
        self.random = np.random.default_rng(1)

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (hashes >> _U64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (hashes & _U64(self.buckets - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)) & _U64(self.buckets - 1)).astype(np.int64)

    def _pair(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """An entry without its position in the table, for the overflow list: the fingerprint and the smaller bucket."""
        return (prints.astype(np.uint64) << _U64(48)) | np.minimum(bucket, self._other(prints, bucket)).astype(np.uint64)

    def insert(self, hashes: np.ndarray) -> None:
        prints, bucket = self._place(np.asarray(hashes, np.uint64))
        for move in range(MOVES):
            if not len(prints):
                return
            order = np.argsort(bucket, kind="stable")
            prints, bucket = prints[order], bucket[order]
            new = np.ones(len(bucket), dtype=bool)
            new[1:] = bucket[1:] != bucket[:-1]
            begin = np.flatnonzero(new)
            rank = np.arange(len(bucket)) - np.repeat(begin, np.diff([*begin, len(bucket)]))
            free = self.slots[bucket] == 0
            fits = rank < free.sum(axis=1)
            # the slot of the rank-th free one
            nth = np.cumsum(free, axis=1) == (rank + 1)[:, None]
            slot = (nth & free).argmax(axis=1)
            self.slots[bucket[fits], slot[fits]] = prints[fits]
            prints, bucket, rank = prints[~fits], bucket[~fits], rank[~fits]
            if move % 2 and len(prints):  # the first one left in each full bucket drives another out
                first = np.ones(len(bucket), dtype=bool)
                first[1:] = bucket[1:] != bucket[:-1]
                victim = self.random.integers(0, SLOTS, int(first.sum()))
                out = self.slots[bucket[first], victim]
                self.slots[bucket[first], victim] = prints[first]
                prints[first] = out
            bucket = self._other(prints, bucket)
        self.overflow = np.concatenate([self.overflow, self._pair(prints, bucket)])

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, bucket = self._place(np.asarray(hashes, np.uint64))
        found = (self.slots[bucket] == prints[:, None]).any(axis=1) | (self.slots[self._other(prints, bucket)] == prints[:, None]).any(axis=1)
        return found | np.isin(self._pair(prints, bucket), self.overflow) if len(self.overflow) else found

    def delete(self, hashes: np.ndarray) -> None:
        prints, bucket = self._place(np.asarray(hashes, np.uint64))
        for f, b, o, pair in zip(prints, bucket, self._other(prints, bucket), self._pair(prints, bucket), strict=True):
            for where in (b, o):
                at = np.flatnonzero(self.slots[where] == f)
                if len(at):
                    self.slots[where, at[0]] = 0
                    break
            else:
                at = np.flatnonzero(self.overflow == pair)
                if not len(at):
                    raise KeyError("delete() of a hash that the filter doesn't hold")
                self.overflow = np.delete(self.overflow, at[0])

    def to_bytes(self) -> bytes:
        return self.buckets.to_bytes(8, "little") + self.slots.tobytes() + self.overflow.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        out = cls(0)
        out.buckets = int.from_bytes(raw[:8], "little")
        end = 8 + 2 * SLOTS * out.buckets
        out.slots = np.frombuffer(raw[8:end], np.uint16).reshape(-1, SLOTS).copy()
        out.overflow = np.frombuffer(raw[end:], np.uint64).copy()
        return out
