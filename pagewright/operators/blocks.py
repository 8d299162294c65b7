"""Longest matching blocks of two sequences: difflib's choice, at a cost that follows the runs of equal elements."""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Sequence

import numpy as np

Block = tuple[int, int, int]
Part = tuple[int, int, int, int]

#: Pairs of equal elements that are laid out at once; in a part with more of them its longest block is found first, which parts it.
PAIRS = 1 << 18
#: Runs of a part up to which they are looked through one by one.
FEW = 48


def runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (start in a, diagonal, length) of all maximal runs of equal elements of two arrays of codes; on a diagonal the place in b less that in a is the same."""
    order = np.argsort(b, kind="stable")
    first, past = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    n = past - first
    at = np.repeat(np.arange(len(a)), n)
    places = order[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    # Diagonals lie a place apart, so that only neighbours on one differ by one.
    wide = len(a) + 1
    keys = np.sort((places - at + len(a)) * wide + at)
    begins = np.flatnonzero(np.diff(keys, prepend=-2) != 1)
    diagonal, start = np.divmod(keys[begins], wide)
    return np.column_stack([start, diagonal - len(a), np.diff(begins, append=len(keys))])


def longest(a: Sequence[Hashable], b: Sequence[Hashable]) -> Block:
    """The longest block of two sequences, of several the first in a, then in b, by an automaton of all parts of b: time and memory follow the length."""
    step: list[dict[Hashable, int]] = [{}]
    link, size, ends = [-1], [0], [-1]  # `ends`: where a state's parts end first in b
    last = 0
    for j, y in enumerate(b):
        new, p = len(step), last
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        ends.append(j)
        while p >= 0 and y not in step[p]:
            step[p][y] = new
            p = link[p]
        if p >= 0:
            q = step[p][y]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                ends.append(ends[q])
                while p >= 0 and step[p].get(y) == q:
                    step[p][y] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    state = n = 0
    best = (0, 0, 0)
    for i, x in enumerate(a):
        while state and x not in step[state]:
            state = link[state]
            n = size[state]
        if x in step[state]:
            state, n = step[state][x], n + 1
        if n > best[2]:
            best = (i - n + 1, ends[state] - n + 1, n)
    return best


def chosen_among(few: list[Block], part: Part) -> list[Block]:
    """Blocks of a part whose runs are few."""
    out, todo = [], [(few, part)]
    while todo:
        rows, (a0, a1, b0, b1) = todo.pop()
        inside, best = [], (0, 0, 0)
        for i, d, n in rows:
            start, end = max(i, a0, b0 - d), min(i + n, a1, b1 - d)
            if start < end:
                inside.append((start, d, end - start))
                best = min(best, (start - end, start, d))
        if inside:
            n, i, d = -best[0], best[1], best[2]
            out.append((i, i + d, n))
            todo += [(inside, (a0, i, b0, i + d)), (inside, (i + n, a1, i + d + n, b1))]
    return out


def chosen(every: np.ndarray, part: Part) -> list[Block]:
    """Blocks of a part by its runs: the longest that lies within, then those of what is left on either side of it."""
    out, todo = [], [(every, part)]
    while todo:
        rows, (a0, a1, b0, b1) = todo.pop()
        start = np.maximum(rows[:, 0], np.maximum(a0, b0 - rows[:, 1]))
        n = np.minimum(rows[:, 0] + rows[:, 2], np.minimum(a1, b1 - rows[:, 1])) - start
        inside = n > 0
        rows = np.column_stack([start, rows[:, 1], n])[inside]
        if len(rows) <= FEW:
            out += chosen_among(rows.tolist(), (a0, a1, b0, b1))
            continue
        best = rows[rows[:, 2] == rows[:, 2].max()]
        i, d, n = best[np.lexsort((best[:, 1], best[:, 0]))[0]].tolist()
        out.append((i, i + d, n))
        todo += [(rows, (a0, i, b0, i + d)), (rows, (i + n, a1, i + d + n, b1))]
    return out


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable], pairs: int = PAIRS) -> list[Block]:
    """(start in a, start in b, length) of the blocks that difflib chooses without junk, rising, none next to another: the longest, then the longest before and behind it."""
    known: dict[Hashable, int] = {}
    x, y = ([known.setdefault(e, len(known)) for e in side] for side in (a, b))
    out: list[Block] = []
    todo: list[Part] = [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = part = todo.pop()
        count = Counter(y[b0:b1])
        met = sum(n * count[e] for e, n in Counter(x[a0:a1]).items())
        if met > pairs:
            i, j, n = longest(x[a0:a1], y[b0:b1])
            i, j = a0 + i, b0 + j
            out.append((i, j, n))
            todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
        elif met:
            found = runs(np.array(x[a0:a1]), np.array(y[b0:b1])) + np.array([a0, b0 - a0, 0])
            out += chosen(found, part)
    joined: list[Block] = []
    for i, j, n in sorted(out):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            i, j, n = joined[-1][0], joined[-1][1], joined.pop()[2] + n
        joined.append((i, j, n))
    return joined
