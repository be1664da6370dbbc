"""A minimal perfect hash over pairs of 64-bit integers, with stored fingerprints.

Levels of bit arrays: a key that is alone in its slot of a level is settled there, the others go on to the next level. The
place of a settled key is the number of set bits before it, so n keys get the numbers 0 to n - 1.
About 3.7 bits a key, besides the fingerprint.
"""

from __future__ import annotations

import numpy as np

_GAMMA = 2.0
_BLOCK = 8  # 64-bit words for each stored rank
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _hash(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        s = np.uint64((_STEP * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        return _mix(_mix(a.astype(np.uint64) + s) + b.astype(np.uint64))


class PerfectHash:
    """``levels``: (bits as 64-bit words, set bits before each block). ``marks``: fingerprints by place."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], marks: np.ndarray):
        self.levels, self.marks = levels, marks

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        """Keys (a[i], b[i]) must differ."""
        levels, done = [], 0
        ka, kb = a, b
        while len(ka):
            if len(levels) > 200:
                raise ValueError("keys repeat")
            size = -(-int(len(ka) * _GAMMA) // (64 * _BLOCK)) * 64 * _BLOCK
            at = (_hash(ka, kb, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            counts = alone.reshape(-1, 64 * _BLOCK).sum(1)
            levels.append((words, done + np.concatenate([[0], np.cumsum(counts)[:-1]])))
            done += int(counts.sum())
            going = ~alone[at]
            ka, kb = ka[going], kb[going]
        out = cls(levels, np.zeros(done, "<u4"))
        out.marks[out._place(a, b)] = cls._mark(a, b)
        return out

    @staticmethod
    def _mark(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (_hash(a, b, 1 << 20) >> np.uint64(32)).astype("<u4")

    def _place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key; -1 where no level has it."""
        place, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for k, (words, before) in enumerate(self.levels):
            if not len(left):
                break
            at = (_hash(a[left], b[left], k) % np.uint64(len(words) * 64)).astype(np.int64)
            w, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (words[w] >> bit) & np.uint64(1) == 1
            w, bit = w[here], bit[here]
            rank = before[w // _BLOCK] + np.bitwise_count(words[w] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            for j in range(1, _BLOCK):
                earlier = w % _BLOCK >= j
                rank[earlier] += np.bitwise_count(words[w[earlier] - j]).astype(np.int64)
            place[left[here]] = rank
            left = left[~here]
        return place

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for keys that were not built in, but for one in 2**32 of those."""
        place = self._place(a, b)
        known = place >= 0
        known[known] = self.marks[place[known]] == self._mark(a[known], b[known])
        return np.where(known, place, -1)

    def arrays(self) -> dict[str, np.ndarray]:
        out = {"marks": self.marks}
        for k, (words, before) in enumerate(self.levels):
            out |= {f"bits{k}": words, f"before{k}": before}
        return out

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> PerfectHash:
        n = sum(k.startswith("bits") for k in arrays)
        return cls([(arrays[f"bits{k}"], arrays[f"before{k}"]) for k in range(n)], arrays["marks"])
