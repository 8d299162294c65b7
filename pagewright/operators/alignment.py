"""Smallest alignments of two sequences: where one becomes the other by the fewest edits.

Only a band of the table of distances is made. Cells off the best alignments may
get too large a value there, which no comparison in tracing back takes for a
smaller one; so once the alignment found has so few edits that no better one can
leave the band, it is the one that the whole table gives.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

import numpy as np

#: Cells of a table from which on it is halved, so that what is kept to trace an alignment back stays bounded.
TABLE_BITS = 1 << 28
#: Diagonals in the band of a single pair at first; twice as many each time that they are not enough.
BAND = 256
#: Pairs are aligned together within so many edits at first, and within twice as many as long as they are no more than these.
LEAST_EDITS, MOST_EDITS = 8, 512
#: Long pairs are first aligned within an edit for so many elements, up to this number.
EDIT_EVERY, LONG_EDITS = 24, 64
#: How far an unreached diagonal is reached; and numbers kept for pairs that are aligned together, of 4 bytes.
UNREACHED, LOAD = -(1 << 30), 1 << 22

Edit = tuple[int | None, int | None]


def columns(a: Sequence[Hashable], b: Sequence[Hashable]) -> Iterator[tuple[int, int]]:
    """For each element of b, where the edit distance to the prefixes of a rises and where it falls from one prefix to the next, as bits.

    All prefixes of a are handled at once in one long number, so a table of
    distances costs a few operations on such numbers a column.
    """
    full = (1 << len(a)) - 1
    at: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    up, down = full, 0
    for y in b:
        here = at.get(y, 0)
        level = (((here & up) + up) ^ up) | here | down
        right_up = ((down | ~(level | up)) << 1) | 1
        right_down = (level & up) << 1
        up = (right_down | ~(level | right_up)) & full
        down = right_up & level & full
        yield up, down


def last_column(a: Sequence[Hashable], b: Sequence[Hashable]) -> np.ndarray:
    """Edit distances of every prefix of a, the empty one first, to all of b."""
    up, down = (1 << len(a)) - 1, 0
    for up, down in columns(a, b):  # noqa: B007
        pass
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(-(-len(a) // 8), "little"), np.uint8), count=len(a), bitorder="little").astype(np.int64)
    return np.concatenate([[len(b)], len(b) + np.cumsum(bits(up) - bits(down))])


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Edit distance of two sequences, neither empty."""
    up = down = 0
    for up, down in columns(a, b):  # noqa: B007
        pass
    return len(b) + up.bit_count() - down.bit_count()


def edits(a: Sequence[Hashable], b: Sequence[Hashable], table_bits: int = TABLE_BITS, band: int = BAND) -> list[Edit]:
    """The fewest edits that make b of a, in order: places (in a, in b) of unequal elements that stand against each other, None on the side that lacks one.

    There are as many as the edit distance. Of alignments with as few, the one
    that, seen from the end, leaves out an element of a first, then one of b. A
    table larger than table_bits is cut at the middle of b, where the best
    alignment crosses it, so memory stays bounded at twice the time.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    n, m = len(a), len(b)
    while min(n, m) > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    todo, out = [(start, n, start, m)], []
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if b1 - b0 > 1 and (a1 - a0) * (b1 - b0) > table_bits:
            half = (b0 + b1) // 2
            first, second = last_column(a[a0:a1], b[b0:half]), last_column(a[a0:a1][::-1], b[half:b1][::-1])[::-1]
            cut = a0 + int((first + second).argmin())
            todo += [(cut, a1, half, b1), (a0, cut, b0, half)]
        else:
            out += traced(a[a0:a1], b[b0:b1], a0, b0, band)
    return out


def most_kept(n: int | np.ndarray, m: int | np.ndarray, low: int | np.ndarray, width: int) -> int | np.ndarray:
    """With how many edits at most no alignment of n with m elements touches the edges of a band of `width` diagonals, of which `low` are on one side."""
    return np.minimum(2 * (low - 1) + (n - m), 2 * (width - 2 - low) - (n - m))


def traced(a: Sequence[Hashable], b: Sequence[Hashable], a0: int, b0: int, band: int = BAND) -> list[Edit]:
    """edits of two parts that begin at a0 and b0, by keeping all columns of a band, which is made wider until it is wide enough or the whole table is no wider."""
    n, m = len(a), len(b)
    while n and m and band + abs(n - m) < n:
        width, low = band + abs(n - m), band // 2 + max(0, m - n)
        found = traced_in_band(a, b, low, width)
        if len(found) <= most_kept(n, m, low, width):
            return [(None if i is None else a0 + i, None if j is None else b0 + j) for i, j in found]
        band = min(2 * band, min(len(found), max(n, m)) + 8)
    return traced_whole(a, b, a0, b0)


def traced_whole(a: Sequence[Hashable], b: Sequence[Hashable], a0: int, b0: int) -> list[Edit]:
    """traced by keeping all columns of the whole table."""
    kept = [((1 << len(a)) - 1, 0), *columns(a, b)]
    i, j, found = len(a), len(b), []
    while i and j:
        bit = 1 << (i - 1)
        if kept[j][0] & bit:
            i -= 1
            found.append((a0 + i, None))
            continue
        j -= 1
        if kept[j][1] & bit:
            found.append((None, b0 + j))
        else:
            i -= 1
            if a[i] != b[j]:
                found.append((a0 + i, b0 + j))
    found += [(a0 + k, None) for k in range(i - 1, -1, -1)] + [(None, b0 + k) for k in range(j - 1, -1, -1)]
    return found[::-1]


def traced_in_band(a: Sequence[Hashable], b: Sequence[Hashable], low: int, width: int) -> list[Edit]:
    """An alignment within a band, a column of which is the rows from `low` above its own number on; a smallest one, if those are within the band."""
    full = (1 << width) - 1
    at: dict[Hashable, int] = {}
    for i, x in enumerate(a, low):
        at[x] = at.get(x, 0) | (1 << i)
    up, down = full & ~((1 << low) - 1), 0
    kept = [(up, down)]
    for j, y in enumerate(b):
        here = (at.get(y, 0) >> j) & full
        level = ((((here & up) + up) ^ up) | here | down) & full
        right_up, right_down = down | (full ^ (level | up)), level & up
        level >>= 1
        up, down = right_down | (full ^ (level | right_up)), level & right_up
        kept.append((up, down))
    i, j, q, found = len(a), len(b), len(a) - len(b) + low - 1, []
    while i and j:
        if q >= 0 and kept[j][0] >> q & 1:
            i, q = i - 1, q - 1
            found.append((i, None))
            continue
        j -= 1
        if kept[j][1] >> (q + 1) & 1:
            found.append((None, j))
            q += 1
        else:
            i -= 1
            if a[i] != b[j]:
                found.append((i, j))
    found += [(k, None) for k in range(i - 1, -1, -1)] + [(None, k) for k in range(j - 1, -1, -1)]
    return found[::-1]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers from each start on, as many as its size, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def equal_run(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many elements at the beginning of each range of that size are equal on both sides."""
    ends = np.cumsum(sizes)
    starts, unequal = ends - sizes, np.append(np.flatnonzero(x != y), len(x))
    return np.minimum(unequal[np.searchsorted(unequal, starts)], ends) - starts


def edits_of_pairs(x: np.ndarray, x_sizes: np.ndarray, y: np.ndarray, y_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """edits of many pairs of sequences of whole numbers from 0 on: pair, place in the first, place in the second (-1 where it lacks one), pair by pair and in order.

    x and y hold the sequences of all pairs, one after the other. Pairs are
    aligned together within MOST_EDITS edits, fewer at first, and the others one by one.
    """
    x_sizes, y_sizes = np.asarray(x_sizes, np.int64), np.asarray(y_sizes, np.int64)
    x_at, y_at = np.cumsum(x_sizes) - x_sizes, np.cumsum(y_sizes) - y_sizes
    least = np.minimum(x_sizes, y_sizes)
    start = equal_run(x[ranges(x_at, least)], y[ranges(y_at, least)], least)
    rest = least - start
    end = lambda at, sizes: np.repeat(at + sizes, rest) - 1 - ranges(np.zeros_like(rest), rest)
    same = equal_run(x[end(x_at, x_sizes)], y[end(y_at, y_sizes)], rest)
    n, m = x_sizes - start - same, y_sizes - start - same
    xs, ys = x_at + start, y_at + start

    found = []
    alone = np.flatnonzero((n == 0) | (m == 0))
    for sizes, side in ((n, 1), (m, 2)):
        owner = np.repeat(alone, sizes[alone])
        part = [owner, np.full(len(owner), -1), np.full(len(owner), -1)]
        part[side] = ranges(np.zeros(len(alone), np.int64), sizes[alone])
        found.append(part)
    todo, most = np.flatnonzero((n > 0) & (m > 0)), LEAST_EDITS
    single = todo[n[todo] * m[todo] > TABLE_BITS]
    todo = todo[n[todo] * m[todo] <= TABLE_BITS]
    while len(todo) and most <= MOST_EDITS:
        fits = (np.abs(n[todo] - m[todo]) <= most) & ((np.minimum(n[todo], m[todo]) <= EDIT_EVERY * most) | (most >= LONG_EDITS))
        order, later = todo[fits], [todo[~fits]]
        load = np.cumsum((most + 1) ** 2 + (n[order] + most) * (most + 1) // 32)
        at = 0
        while at < len(order):
            stop = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + LOAD, side="right")))
            part, at = order[at:stop], stop
            lane, i, j, done = traced_together(x, xs[part], n[part], y, ys[part], m[part], most)
            found.append([part[lane], i, j])
            later.append(part[~done])
        todo, most = np.concatenate(later), 2 * most
    for p in np.concatenate([single, todo]):
        pairs = edits(x[xs[p] : xs[p] + n[p]].tolist(), y[ys[p] : ys[p] + m[p]].tolist(), band=MOST_EDITS)
        i, j = (np.array([-1 if e[s] is None else e[s] for e in pairs], np.int64) for s in (0, 1))
        found.append([np.full(len(pairs), p), i, j])
    pair, i, j = (np.concatenate([part[k] for part in found]).astype(np.int64) for k in range(3))
    order = np.argsort(pair, kind="stable")
    pair, i, j = pair[order], i[order], j[order]
    return pair, np.where(i < 0, -1, i + start[pair]), np.where(j < 0, -1, j + start[pair])


def traced_together(x: np.ndarray, xs: np.ndarray, n: np.ndarray, y: np.ndarray, ys: np.ndarray, m: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """traced of pairs of parts of x and y whose edit distance is `most` at most: pair, place in the first, place in the second (-1: none), in order within a pair; and which pairs those are.

    How far each diagonal is reached with no edit, with one, with two, and so on,
    is found for all pairs at once. The bits of a diagonal tell where its elements
    are unequal, so a run of equal ones is skipped by looking for the next bit.
    """
    count, width = len(n), most + 1
    # An alignment with `most` edits stays within `width` diagonals, the first of which is this one.
    base = -((most - (n - m)) // 2)
    regions = n + 1 + width
    at = np.cumsum(regions) - regions
    words = -(-int(regions.sum()) // 64)
    kind = np.uint16 if max(x.max(), y.max()) < 0xFFFE else np.uint32
    a, b = np.full(words * 64, np.iinfo(kind).max, kind), np.full(words * 64 + width, np.iinfo(kind).max - 1, kind)
    a[ranges(at, n)] = x[ranges(xs, n)]
    b[ranges(at + base + width - 1, m)] = y[ranges(ys, m)]
    unequal = np.empty((width, words), np.uint64)
    for k in range(width):
        unequal[k] = np.packbits(a != b[width - 1 - k : width - 1 - k + words * 64], bitorder="little").view(np.uint64)
    # The first word with a bit, from each word on; the last one of a diagonal has one, as a region ends with unequal elements.
    follows = np.where(unequal != 0, np.arange(words, dtype=np.int32), np.int32(words - 1))
    follows = np.minimum.accumulate(follows[:, ::-1], axis=1)[:, ::-1].copy().ravel()
    unequal = unequal.ravel()

    diagonals = base[:, None] + np.arange(width)
    ends = np.minimum(n[:, None], m[:, None] + diagonals)
    usable = ends >= np.maximum(diagonals, 0)
    here, last = at[:, None] * usable, (n - m - base)[:, None]
    rows = np.arange(width, dtype=np.int64)[None, :] * words
    # One unreachable diagonal on either side; places are rows of the first sequence.
    reach = np.full((most + 1, count, width + 2), UNREACHED, np.int32)
    edits_needed = np.full(count, -1)
    active = np.arange(count)
    one = np.uint64(1)
    for e in range(most + 1):
        low, high = max(0, int((-base[active]).min()) - e), min(width, int((-base[active]).max()) + e + 1)
        if e:
            before = reach[e - 1, active, low : high + 2]
            to = np.maximum(np.maximum(before[:, 1:-1], before[:, :-2]) + 1, before[:, 2:])
        else:
            to = np.where(diagonals[active, low:high] == 0, 0, UNREACHED)
        reached = (to >= 0) & usable[active, low:high]
        place = np.where(reached, np.minimum(to, ends[active, low:high]), 0) + here[active, low:high]
        word = (place >> 6) + rows[:, low:high]
        bits = unequal[word] >> (place & 63).astype(np.uint64)
        beyond = np.flatnonzero(bits == 0)
        first = np.bitwise_count((bits & (~bits + one)) - one).astype(np.int64) + place
        if len(beyond):
            row = rows[0, low:high][beyond % (high - low)]
            following = follows[word.ravel()[beyond] + 1].astype(np.int64)
            bits = unequal[row + following]
            first.ravel()[beyond] = following * 64 + np.bitwise_count((bits & (~bits + one)) - one)
        to = np.where(reached, first - here[active, low:high], UNREACHED)
        reach[e, active, low + 1 : high + 1] = to
        done = reach[e, active, last[active, 0] + 1] >= n[active]
        edits_needed[active[done]] = e
        active = active[~done]
        if not len(active):
            break
    lane = np.flatnonzero(edits_needed > 0)
    left, i, k, found = edits_needed[lane], n[lane], (n - m - base)[lane] + 1, []
    while len(lane):
        there = lambda step: reach[left - 1, lane, k + step].astype(np.int64)  # noqa: B023, E731
        other, fewer, new = there(0) + 1, np.minimum(there(-1) + 1, i), np.minimum(there(1), i)
        stop = np.maximum(np.maximum(other, fewer), new)
        is_fewer = fewer == stop
        is_new = ~is_fewer & (new == stop) & (new > other)
        column = stop - (k - 1 + base[lane]) - 1
        found.append((lane, np.where(is_new, -1, stop - 1), np.where(is_fewer, -1, column)))
        i, k, left = np.where(is_new, stop, stop - 1), k + is_new - is_fewer, left - 1
        go = left > 0
        lane, left, i, k = lane[go], left[go], i[go], k[go]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), edits_needed >= 0
    lane, i, j = (np.concatenate([part[c] for part in found])[::-1] for c in range(3))
    order = np.argsort(lane, kind="stable")
    return lane[order], i[order], j[order], edits_needed >= 0
