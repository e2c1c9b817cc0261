"""Signature trees over token sets, and their dual traversal.

A set's signature is a bitmap of its tokens. A node holds the OR of its members' bitmaps, their
range of set sizes and how many tokens their bitmaps hide at most. Two nodes can be skipped if no
pair of members can reach the similarity: by their size ranges, or because the bits they share,
with the hidden tokens, are fewer than the overlap needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

FANOUT = 8
#: Node pairs examined at a time; bounds the memory of a traversal.
PAIRS = 8192


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of 64-bit words; bits is a power of two, at least 64."""
    out = np.zeros(bits, np.uint8)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def width(largest: int, most: int = 1 << 14) -> int:
    """Bits for sets of up to this many tokens: four a token, as a power of two."""
    return int(min(most, max(64, 1 << int(4 * max(1, largest) - 1).bit_length())))


def needed(a, b, num: int, den: int):
    """Least overlap of sets of sizes a and b whose Jaccard similarity is num / den or more."""
    return -(-(num * (a + b)) // (num + den))


@dataclass
class Level:
    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    hidden: np.ndarray
    group: np.ndarray


def build(bits: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> list[Level]:
    """Levels from the sets (0) to the root. Sets must come in size order. group: that of all members, or -1."""
    hidden = sizes - np.bitwise_count(bits).sum(1).astype(np.int64)
    levels = [Level(bits, sizes, sizes, hidden, groups)]
    while len(levels[-1].low) > 1:
        x = levels[-1]
        at = np.arange(0, len(x.low), FANOUT)
        first, last = np.minimum.reduceat(x.group, at), np.maximum.reduceat(x.group, at)
        levels.append(Level(np.bitwise_or.reduceat(x.bits, at, 0), np.minimum.reduceat(x.low, at), np.maximum.reduceat(x.high, at), np.maximum.reduceat(x.hidden, at), np.where(first == last, first, -1)))
    return levels


def _possible(x: Level, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    ok = (x.high[i] * den >= x.low[j] * num) & (x.high[j] * den >= x.low[i] * num) & ((x.group[i] < 0) | (x.group[i] != x.group[j]))
    i, j = i[ok], j[ok]
    shared = np.bitwise_count(x.bits[i] & x.bits[j]).sum(1) + np.minimum(x.hidden[i], x.hidden[j])
    ok[ok] = shared >= needed(x.low[i], x.low[j], num, den)
    return ok


def traverse(levels: list[Level], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of sets, of different groups, that the bounds cannot rule out, block by block (dual traversal)."""
    stack = [(len(levels) - 1, np.array([0]), np.array([0]))]
    while stack:
        k, i, j = stack.pop()
        ok = (i == j) if k else np.zeros(len(i), bool)
        ok[i != j] = _possible(levels[k], i[i != j], j[i != j], num, den)
        if k:  # a node meets itself unless all its members are of one group
            ok &= (i != j) | (levels[k].group[i] < 0)
        i, j = i[ok], j[ok]
        if not k:
            if len(i):
                yield i, j
            continue
        n, step = len(levels[k - 1].low), np.arange(FANOUT)
        ci = np.repeat((i[:, None] * FANOUT + step), FANOUT, 1).ravel()
        cj = np.tile((j[:, None] * FANOUT + step), (1, FANOUT)).ravel()
        keep = (ci < n) & (cj < n) & ((ci < cj) if k == 1 else (ci <= cj))
        ci, cj = ci[keep], cj[keep]
        for at in range(0, len(ci), PAIRS):
            stack.append((k - 1, ci[at : at + PAIRS], cj[at : at + PAIRS]))


def linked(sets: list[np.ndarray], groups: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """(group, smallest group it is linked with) of the graph of sets (sorted distinct tokens) with similarity num / den or more.

    Every pair of sets of different groups is either verified exactly, ruled out by a bound, or already in one
    component. Groups that are linked with no smaller one are left out.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort(([int(s[0]) if len(s) else 0 for s in sets], sizes))
    sizes = sizes[order]
    names, own = np.unique(np.array(groups, np.int64)[order], return_inverse=True)
    root = np.arange(len(names))
    bits = width(int(sizes.max(initial=1)))
    marks = np.array([bitmap(sets[k], bits) for k in order])
    for i, j in traverse(build(marks, sizes, own), num, den):
        while True:
            i, j = (x[root[own[i]] != root[own[j]]] for x in (i, j))
            if not len(i):
                break
            x, y = sets[order[i[0]]], sets[order[j[0]]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both * den >= num * (len(x) + len(y) - both):
                a, b = sorted((root[own[i[0]]], root[own[j[0]]]))
                root[root == b] = a
            i, j = i[1:], j[1:]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return list(zip(names[moved].tolist(), names[root[moved]].tolist(), strict=True))
