"""Signature trees over sets of 64-bit numbers, and their dual traversal.

A node holds the OR of its members' token bitmaps, the range of their sizes, and the
largest surplus (tokens beyond set bits, from tokens that share a bit). If S and T are
the bitmaps of two nodes, no member pair shares more than
popcount(S & T) + min(surplus of S, surplus of T) tokens: a token of A that lies in B
sets a bit of both, and at most surplus tokens of A share a bit with another one. Node
pairs whose bound lies below what the similarity asks for are never opened; nor are
pairs whose members are all connected already, since only connections are wanted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tallymark.functions import ship_by_value

ship_by_value(__name__)

BITS = 2048
LEAF = 16
FAN = 8
BLOCK = 64


@dataclass
class Sets:
    """Member i has the sorted distinct tokens flat[offsets[i]:offsets[i + 1]]."""

    flat: np.ndarray
    offsets: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def bitmaps(self) -> np.ndarray:
        maps = np.zeros((len(self.sizes), BITS // 64), np.uint64)
        bit = (self.flat & np.uint64(BITS - 1)).astype(np.int64)
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        np.bitwise_or.at(maps, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        return maps

    def take(self, order: np.ndarray) -> Sets:
        parts = [self.flat[self.offsets[i] : self.offsets[i + 1]] for i in order]
        sizes = self.sizes[order]
        return Sets(np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum(sizes)]))


class Tree:
    """Levels of nodes over members in order; level 0 are leaves. Node i of a level
    covers the members begin[i]:begin[i + 1]."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, first: int, last: int) -> None:
        surplus = sizes[first:last] - np.bitwise_count(maps[first:last]).sum(axis=1).astype(np.int64)
        begin = np.arange(first, last, LEAF)
        self.levels = []
        small, large, bits, over = sizes[first:last], sizes[first:last], maps[first:last], surplus
        step, width = LEAF, LEAF
        while True:
            at = np.arange(0, len(small), step)
            small, large = np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)
            bits, over = np.bitwise_or.reduceat(bits, at, axis=0), np.maximum.reduceat(over, at)
            begin = np.append(np.arange(first, last, width), last)
            self.levels.append((begin, small, large, bits, over))
            if len(small) == 1:
                return
            step, width = FAN, width * FAN


def connect(sets: Sets, labels: np.ndarray, percent: int, split: int = 0) -> list[tuple[int, int]]:
    """Member pairs with 100 |A & B| >= percent |A | B| that connect members of
    different labels until no such pair is left: a spanning set, not all pairs.
    With `split`, only pairs across that member number. Labels are updated in place.
    """
    count = len(sets.sizes)
    sizes = sets.sizes
    maps = sets.bitmaps()
    surplus = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
    found: list[tuple[int, int]] = []

    def fits(ones: np.ndarray, small_a, large_a, small_b, large_b, over_a, over_b) -> np.ndarray:
        """Whether some pair could still be similar enough."""
        most = np.minimum(np.minimum(large_a, large_b), ones + np.minimum(over_a, over_b))
        # Sharing s of a + b tokens: 100 s >= percent (a + b - s).
        return (most * (100 + percent) >= percent * (small_a + small_b)) & (
            100 * np.minimum(large_a, large_b) >= percent * np.maximum(small_a, small_b)
        )

    def members(a: int, low: int, high: int) -> None:
        """Member a against the members low:high."""
        other = np.arange(low, high)
        other = other[labels[low:high] != labels[a]]
        if not len(other):
            return
        ones = np.bitwise_count(maps[other] & maps[a]).sum(axis=1).astype(np.int64)
        other = other[fits(ones, sizes[a], sizes[a], sizes[other], sizes[other], surplus[a], surplus[other])]
        mine = sets.flat[sets.offsets[a] : sets.offsets[a + 1]]
        while len(other):
            block, other = other[:BLOCK], other[BLOCK:]
            theirs = [sets.flat[sets.offsets[i] : sets.offsets[i + 1]] for i in block]
            joined = np.concatenate(theirs)
            place = np.minimum(np.searchsorted(mine, joined), len(mine) - 1)
            same = np.concatenate([[0], np.cumsum(mine[place] == joined)])
            ends = np.cumsum(sizes[block])
            shared = same[ends] - same[ends - sizes[block]]
            linked = block[shared * 100 >= percent * (sizes[a] + sizes[block] - shared)]
            for b in linked:
                if labels[b] != labels[a]:
                    found.append((a, int(b)))
                    low_label, high_label = sorted((labels[a], labels[b]))
                    labels[labels == high_label] = low_label
            other = other[labels[other] != labels[a]]

    def alike(low: int, high: int, low2: int, high2: int) -> bool:
        one = labels[low]
        return bool((labels[low:high] == one).all() and (labels[low2:high2] == one).all())

    def visit(x: Tree, level: int, i: int, y: Tree, level2: int, j: int) -> None:
        begin, small, large, bits, over = x.levels[level]
        begin2, small2, large2, bits2, over2 = y.levels[level2]
        low, high, low2, high2 = begin[i], begin[i + 1], begin2[j], begin2[j + 1]
        if alike(low, high, low2, high2):
            return
        ones = int(np.bitwise_count(bits[i] & bits2[j]).sum())
        if not fits(ones, small[i], large[i], small2[j], large2[j], over[i], over2[j]):
            return
        same = x is y and level == level2 and i == j
        if level == 0 and level2 == 0:
            for a in range(low, high):
                members(a, a + 1 if same else low2, high2)
        elif level >= level2:
            children = range(i * FAN, min((i + 1) * FAN, len(x.levels[level - 1][1])))
            if same:
                for c in children:
                    visit(x, level - 1, c, x, level - 1, c)
                for c in children:
                    for d in range(c + 1, children.stop):
                        visit(x, level - 1, c, x, level - 1, d)
            else:
                for c in children:
                    visit(x, level - 1, c, y, level2, j)
        else:
            for d in range(j * FAN, min((j + 1) * FAN, len(y.levels[level2 - 1][1]))):
                visit(x, level, i, y, level2 - 1, d)

    if split:
        x, y = Tree(maps, sizes, 0, split), Tree(maps, sizes, split, count)
        visit(x, len(x.levels) - 1, 0, y, len(y.levels) - 1, 0)
    elif count > 1:
        x = Tree(maps, sizes, 0, count)
        visit(x, len(x.levels) - 1, 0, x, len(x.levels) - 1, 0)
    return found


def near_order(sets: Sets) -> np.ndarray:
    """Members by their smallest tokens, then size: similar sets become neighbours."""
    first = sets.flat[sets.offsets[:-1]]
    return np.lexsort((sets.sizes, first))
