"""A cuckoo filter in numpy: membership with deletion, filled and asked in batches."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Buckets of the first level; each further level has twice as many as the one before.
FIRST = 1 << 10
#: Share of a level's slots that may be taken before the next level opens, and rounds of moving before it opens early.
FULL, ROUNDS = 0.85, 200


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, bucket) of digests as rows of 16 bytes; the first four bytes are left to choose the shard. No fingerprint is 0."""
    bucket = keys[:, 4:8].copy().view(np.uint32).ravel()
    mark = keys[:, 8:10].copy().view(np.uint16).ravel()
    return np.where(mark == 0, np.uint16(1), mark), bucket


def _ranks(groups: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    out = np.empty(len(groups), np.int64)
    out[order] = np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))
    return out


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; each has two buckets, either of which tells the other.

    A level that fills up is left as it is and one of twice its size takes what follows, so no fingerprint needs its key
    again. contains never misses what is in; it errs for about 8 in 65,536 others per level. add takes a key once for each
    time remove may be asked to take it out.
    """

    def __init__(self, data: bytes = b""):
        self.levels, at, flat = [], 0, np.frombuffer(data, np.uint16)
        while at < len(flat):
            size = (FIRST << len(self.levels)) * SLOTS
            self.levels.append(flat[at : at + size].reshape(-1, SLOTS).copy())
            at += size

    def to_bytes(self) -> bytes:
        return b"".join(level.tobytes() for level in self.levels)

    def __len__(self) -> int:
        return sum(int(np.count_nonzero(level)) for level in self.levels)

    @staticmethod
    def _other(bucket: np.ndarray, mark: np.ndarray, mask: int) -> np.ndarray:
        return (bucket ^ (mark.astype(np.uint32) * np.uint32(0x5BD1E995) >> np.uint32(7))) & np.uint32(mask)

    def _both(self, level: np.ndarray, mark: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = len(level) - 1
        one = bucket & np.uint32(mask)
        return one, self._other(one, mark, mask)

    def contains(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mark), bool)
        for level in self.levels:
            for b in self._both(level, mark, bucket):
                out |= (level[b] == mark[:, None]).any(1)
        return out

    @staticmethod
    def _swap(level: np.ndarray, bucket: np.ndarray, wanted: np.ndarray, put: np.ndarray) -> np.ndarray:
        """In each bucket one slot that holds wanted gets put, another one for each of equal requests; false where there was none."""
        match = np.cumsum(level[bucket] == wanted[:, None], axis=1)
        # requests that look for the same value in the same bucket take its first, second, ... such slot
        rank = _ranks(bucket.astype(np.int64) << 16 | wanted) + 1
        done = match[:, -1] >= rank
        slot = (match == rank[:, None]).argmax(1)
        level[bucket[done], slot[done]] = put[done]
        return done

    def _fill(self, level: np.ndarray, mark: np.ndarray, bucket: np.ndarray) -> bool:
        free = np.zeros(len(mark), np.uint16)
        one, two = self._both(level, mark, bucket)
        left = ~self._swap(level, one, free, mark)
        mark, at = mark[left], two[left]
        for turn in range(ROUNDS):
            left = ~self._swap(level, at, np.zeros(len(mark), np.uint16), mark)
            mark, at = mark[left], at[left]
            if not len(mark):
                return True
            _, kick = np.unique(at, return_index=True)  # one of those that want a bucket takes the place of another there
            slot = (turn + at[kick]) % SLOTS
            out = level[at[kick], slot].copy()
            level[at[kick], slot] = mark[kick]
            mark[kick], at[kick] = out, self._other(at[kick], out, len(level) - 1)
        return False

    def add(self, mark: np.ndarray, bucket: np.ndarray) -> None:
        part = len(mark)
        while len(mark):
            level = self.levels[-1] if self.levels else None
            room = int(level.size * FULL) - int(np.count_nonzero(level)) if level is not None else 0
            if room > 0:
                part = min(part, room)
                trial = level.copy()
                if self._fill(trial, mark[:part], bucket[:part]):
                    self.levels[-1] = trial
                    mark, bucket = mark[part:], bucket[part:]
                    part = len(mark)
                    continue
                if part > 1:
                    part //= 2
                    continue
            self.levels.append(np.zeros((FIRST << len(self.levels), SLOTS), np.uint16))
            part = len(mark)

    def remove(self, mark: np.ndarray, bucket: np.ndarray) -> None:
        """Takes out one fingerprint for each; one that isn't there is an error."""
        for level in self.levels:
            for which in (0, 1):
                left = ~self._swap(level, self._both(level, mark, bucket)[which], mark, np.zeros(len(mark), np.uint16))
                mark, bucket = mark[left], bucket[left]
        if len(mark):
            raise ValueError("the filter doesn't hold what it was asked to remove")
