"""Look-up tables that numpy reads for many keys at once: pairs of numbers, and tokens that bytes start with."""

from __future__ import annotations

import numpy as np

NEVER = np.int64(1 << 40)


class PairTable:
    """Rank and result by pair, from ``{(a, b): (rank, made)}``: open addressing in numpy arrays."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], shift: int = 20):
        self.shift = np.uint64(shift)
        self.mask = (1 << (len(merges) * 4).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.rank = np.full(self.mask + 1, NEVER, np.int64)
        self.made = np.full(self.mask + 1, -1, np.int64)
        keys = np.array([(a << 32) | b for a, b in merges], np.int64)
        rank, made = (np.array([m[k] for m in merges.values()], np.int64) for k in (0, 1))
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # each free slot takes one of the keys that want it, the others move on
            free = self.keys[slot[left]] == -1
            first = np.unique(slot[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]], self.rank[slot[put]], self.made[slot[put]] = keys[put], rank[put], made[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> self.shift) & np.uint64(self.mask)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NEVER`` if there is none) and slot of each pair; the slot leads to the token made."""
        keys = (a << 32) | b
        slot = self._slot(keys)
        there = self.keys[slot]
        moving = np.nonzero((there != keys) & (there != -1))[0]
        while len(moving):
            slot[moving] = (slot[moving] + 1) & self.mask
            there = self.keys[slot[moving]]
            moving = moving[(there != keys[moving]) & (there != -1)]
        return np.where(self.keys[slot] == keys, self.rank[slot], NEVER), slot

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair makes, -1 if it is not in the table."""
        rank, slot = self.find(a, b)
        return np.where(rank < NEVER, self.made[slot], -1)


class ByteTrie:
    """The longest of many byte strings, all single bytes among them, that starts at each of many places."""

    def __init__(self, tokens: dict[bytes, int]):
        steps: dict[tuple[int, int], tuple[int, int]] = {}
        best, path, before = [-1], [0], b""
        for token in sorted(tokens):  # in this order the nodes of a token's beginnings are those of the one before
            known = 0
            while known < len(before) and token[known] == before[known]:
                known += 1
            del path[known + 1 :]
            for byte in token[known:]:
                steps[path[-1], byte] = (0, len(best))
                path.append(len(best))
                best.append(best[path[-2]])
            best[path[-1]] = tokens[token]
            before = token
        self.best = np.array(best, np.int64)
        one = [steps[0, b][1] for b in range(256)]
        self.one = np.array(one, np.int64)
        self.two = np.array([steps.get((node, b), (0, -1))[1] for node in one for b in range(256)], np.int64)
        self.steps = PairTable({k: v for k, v in steps.items() if k[0] != 0}, shift=40)

    def longest(self, text: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest string in ``text`` at each place that ends by its own end."""
        node = self.one[text[places]]
        going = np.nonzero(ends - places >= 2)[0]
        at = places[going]
        child = self.two[(text[at].astype(np.int64) << 8) | text[at + 1]]
        depth = 2
        while True:
            hit = np.nonzero(child >= 0)[0]
            going, child = going[hit], child[hit]
            node[going] = child
            more = np.nonzero(ends[going] - places[going] > depth)[0]
            going, child = going[more], child[more]
            if not len(going):
                return self.best[node]
            child = self.steps.get(child, text[places[going] + depth].astype(np.int64))
            depth += 1
