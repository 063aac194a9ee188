"""Static 3-wise binary fuse filters over 64-bit digests, built and probed with numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .textnp import mix


@dataclass(frozen=True)
class FuseFilter:
    """8-bit fingerprints: no listed digest is refused, about 1 in 256 others is let through."""

    seed: int
    segment: int
    segments: int
    prints: bytes

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys ^ np.uint64(seed))
        first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third], 1).astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, digests: np.ndarray) -> FuseFilter:
        """``digests``: distinct uint64 values, any number (also none)."""
        n = len(digests)
        segment = 1 << min(18, max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        segments = max(1, math.ceil(n * factor / segment) - 2 + 1)
        for seed in range(1, 200):
            slots, prints = cls._slots(digests, seed * 0x9E3779B97F4A7C15 % (1 << 64), segment, segments)
            order = cls._peel(slots, (segments + 2) * segment)
            if order is not None:
                table = np.zeros((segments + 2) * segment, np.uint8)
                for keys, own in reversed(order):  # a key's own slot makes its three slots xor to its print
                    s = slots[keys]
                    table[own] = 0
                    table[own] = prints[keys] ^ table[s[:, 0]] ^ table[s[:, 1]] ^ table[s[:, 2]]
                return cls(seed * 0x9E3779B97F4A7C15 % (1 << 64), segment, segments, table.tobytes())
        raise ValueError("no filter found; are the digests distinct?")

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the slot only they use), or None if some keys never have one."""
        degree = np.bincount(slots.ravel(), minlength=size)
        users = np.zeros(size, np.int64)
        np.bitwise_xor.at(users, slots.ravel(), np.repeat(np.arange(len(slots)), 3))
        rounds, done, ready = [], 0, np.flatnonzero(degree == 1)
        while len(ready):
            keys, at = np.unique(users[ready], return_index=True)
            rounds.append((keys, ready[at]))
            done += len(keys)
            touched = slots[keys].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(users, touched, np.repeat(keys, 3))
            touched = np.unique(touched)
            ready = touched[degree[touched] == 1]
        return rounds if done == len(slots) else None

    def takes(self, digests: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(digests, self.seed, self.segment, self.segments)
        table = np.frombuffer(self.prints, np.uint8)
        return prints == table[slots[:, 0]] ^ table[slots[:, 1]] ^ table[slots[:, 2]]
