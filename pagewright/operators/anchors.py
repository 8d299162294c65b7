"""Aligning two long texts by the words that occur once in both."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Hashable, Sequence

import numpy as np

#: Words of a gap between anchors on either side up to which it is anchored no further.
SMALL = 8


def unique_in_both(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Places (in a, in b) of the elements that occur once in each, by their place in a."""
    count: dict[Hashable, int] = {}
    place: dict[Hashable, int] = {}
    for j, y in enumerate(b):
        count[y] = count.get(y, 0) + 1
        place[y] = j
    mine: dict[Hashable, int] = {}
    for x in a:
        mine[x] = mine.get(x, 0) + 1
    return [(i, place[x]) for i, x in enumerate(a) if mine[x] == 1 and count.get(x) == 1]


def rising(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rises on both sides; of pairs sorted by the first (a pile for each length, the smallest end on top)."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tops, j)
        before[k] = at[n - 1] if n else -1
        tops[n : n + 1], at[n : n + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def anchors(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Pairs of places that stand for each other, rising on both sides.

    Words that occur once in both are anchors, as far as they rise on both
    sides; they grow over equal words on either side. In each gap that is left,
    words that occur once there are anchors in turn, so the cost follows the texts' length.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if min(a1 - a0, b1 - b0) == 0 or max(a1 - a0, b1 - b0) <= SMALL:
            continue
        found = rising(unique_in_both(a[a0:a1], b[b0:b1]))
        if not found:
            continue
        i, j = a0, b0
        for x, y in found:
            todo.append((i, a0 + x, j, b0 + y))
            i, j = a0 + x, b0 + y
        todo.append((i, a1, j, b1))
    return sorted(out)


def spans(cuts: Sequence[int], size: int, found: Sequence[tuple[int, int]], other: int) -> list[tuple[int, int]]:
    """For each part of the first text, of `size` words in all and parts beginning at `cuts`, the span of the second, of `other` words, that it stands for.

    Cuts between anchors divide what lies between these in proportion; what
    stands before the first part's first word belongs to it, and what follows the last to the last.
    """
    at = np.array([-1, *[i for i, _ in found], size])
    to = np.array([-1, *[j for _, j in found], other])
    where = []
    for c in cuts:
        k = int(np.searchsorted(at, c))  # the first anchor at the cut or behind it
        if at[k] == c and k < len(at) - 1:
            where.append(int(to[k]))
            continue
        wide, past = int(at[k] - at[k - 1]), int(c - at[k - 1])
        where.append(int(to[k - 1]) + round((int(to[k]) - int(to[k - 1])) * past / wide) if past < wide else int(to[k]))
    where = [0, *[max(w, 0) for w in where[1:]], other] if where else []
    return list(zip(where[:-1], where[1:]))
