"""Minimal perfect hashing of distinct 64-bit keys.

Every level deals the keys left over to twice as many places; a key that is alone in its
place is settled there, the others go on. The number of settled places before a key's is
its slot, so n keys fill the slots 0 to n - 1. A table of the keys by slot verifies every
look-up: any key that was not among them is told apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Places of a level for each key left.
SPREAD = 2
WORD = 64


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of the keys for a level: two rounds of multiply and shift."""
    code = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    for factor in (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)):
        code ^= code >> np.uint64(33)
        code *= factor
    return code ^ code >> np.uint64(33)


@dataclass(frozen=True)
class Level:
    places: int
    bits: np.ndarray  # settled places, 64 to a word
    before: np.ndarray  # settled places of all levels and words before a word


@dataclass(frozen=True)
class PerfectHash:
    levels: tuple[Level, ...]
    keys: np.ndarray  # by slot

    @staticmethod
    def of(keys: np.ndarray) -> PerfectHash:
        """For distinct keys, as 64-bit unsigned numbers in any order."""
        keys = np.asarray(keys, np.uint64)
        left, levels, settled_keys, settled = keys, [], [], 0
        while len(left):
            places = SPREAD * len(left)
            place = (mixed(left, len(levels)) % np.uint64(places)).astype(np.int64)
            alone = np.bincount(place, minlength=places)[place] == 1
            taken = np.zeros(-(-places // WORD) * WORD, np.uint8)
            taken[place[alone]] = 1
            bits = np.packbits(taken, bitorder="little").view("<u8")
            counts = np.bitwise_count(bits).astype(np.int64)
            levels.append(Level(places, bits, settled + np.cumsum(counts) - counts))
            settled_keys.append(left[alone][np.argsort(place[alone])])
            settled += int(alone.sum())
            left = left[~alone]
        return PerfectHash(tuple(levels), np.concatenate(settled_keys) if levels else keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 for keys that are not in the table."""
        keys = np.asarray(keys, np.uint64)
        found = np.full(len(keys), -1, np.int64)
        open_at = np.arange(len(keys))
        for number, level in enumerate(self.levels):
            if not len(open_at):
                break
            place = (mixed(keys[open_at], number) % np.uint64(level.places)).astype(np.int64)
            word, bit = place // WORD, (place % WORD).astype(np.uint64)
            bits = level.bits[word]
            here = (bits >> bit & np.uint64(1)).astype(bool)
            lower = bits & ((np.uint64(1) << bit) - np.uint64(1))
            slot = level.before[word] + np.bitwise_count(lower)
            found[open_at[here]] = slot[here]
            open_at = open_at[~here]
        known = found >= 0
        known[known] = self.keys[found[known]] == keys[known]
        return np.where(known, found, -1)
