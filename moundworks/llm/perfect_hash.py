"""Minimal perfect hash of distinct 64-bit keys: n keys get the slots 0 to n - 1.

Levels of bit tables: at each level the keys that are alone at their place take it, the others go on to
the next, which mixes them anew. The slot is the number of places taken before it. A few bits a key;
a key that was not built in may get any slot or none (-1), so lookups compare the key kept there.
"""

from __future__ import annotations

import numpy as np

#: Places per key of a level, and the least number of them.
SPARSE, LEAST = 2, 64


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Bijective mixing by shifts and odd multipliers, another one at each level."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> list[bytes]:
    """The bit tables of distinct keys."""
    levels, left = [], keys.astype(np.uint64)
    while len(left):
        size = max(LEAST, SPARSE * len(left))
        size += -size % 8
        place = (_mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        levels.append(np.packbits(alone).tobytes())
        left = left[~alone[place]]
    return levels


class PerfectHash:
    def __init__(self, levels: list[bytes]):
        self.levels, taken = [], 0
        for raw in levels:
            bits = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
            self.levels.append((bits, taken + np.cumsum(bits) - 1))
            taken += int(bits.sum())
        self.size = taken

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        slot, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, number) in enumerate(self.levels):
            place = (_mixed(keys[rest], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            slot[rest[hit]] = number[place[hit]]
            rest = rest[~hit]
        return slot
