"""Edit distances of many pairs of strings at once."""

from __future__ import annotations

import numpy as np

#: Cells of the distance matrices computed together.
CELLS = 1 << 20


def padded(texts: list[str], width: int, filler: int) -> np.ndarray:
    """Texts as rows of code points, filled up at the end."""
    out = np.full((len(texts), width), filler, np.int32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def osa_like(a: list[str], b: list[str], swaps: bool = True) -> np.ndarray:
    """osa for pairs of like length: the matrices of all pairs at once, row by row."""
    n, m = max(map(len, a)), max(map(len, b))
    x, y, ends = padded(a, n, -1), padded(b, m, -2), np.array([*map(len, b)])
    columns, sizes = np.arange(m + 1, dtype=np.int32), np.array([*map(len, a)])
    last = np.tile(columns, (len(a), 1))
    before, out = last, last[np.arange(len(a)), ends]
    for i in range(1, n + 1):
        row = np.empty_like(last)
        row[:, 0] = i
        same = x[:, i - 1 : i] == y
        np.minimum(last[:, 1:] + 1, last[:, :-1] + ~same, out=row[:, 1:])
        if swaps and i > 1 and m > 1:
            swapped = same[:, :-1] & (x[:, i - 2 : i - 1] == y[:, 1:])
            row[:, 2:] = np.where(swapped, np.minimum(row[:, 2:], before[:, :-2] + 1), row[:, 2:])
        row = np.minimum.accumulate(row - columns, axis=1) + columns  # characters of b added one after the other
        before, last = last, row
        out = np.where(sizes == i, row[np.arange(len(a)), ends], out)
    return out


#: Characters whose places fit one word.
WORD_BITS = 64


def osa_in_words(a: list[str], b: list[str], swaps: bool = True) -> np.ndarray:
    """osa for pairs whose first string has at most WORD_BITS characters, not none."""
    n, m = max(map(len, a)), max(map(len, b))
    return osa_of_codes(padded(a, -(-n // 8) * 8, -1), padded(b, m, -2), np.array([*map(len, a)]), np.array([*map(len, b)]), swaps)


def osa_of_codes(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, ends: np.ndarray, swaps: bool = True) -> np.ndarray:
    """The same for code points: a row a string, those of the first filled up to a multiple of eight.

    A column of a pair's distance matrix is two words: where distances rise and
    where they fall from one row to the next, a bit each. So a step handles a
    character of every second string, for all pairs and all rows at once.
    """
    m, one = y.shape[1], np.uint64(1)
    out, bottom = sizes.astype(np.int32), one << (sizes - 1).astype(np.uint64)
    up, down, level, before = np.full(len(x), ~np.uint64(0)), np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)
    wide = np.zeros((len(x), 8), np.uint8)
    with np.errstate(over="ignore"):
        for j in range(m):
            wide[:, : x.shape[1] // 8] = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little")
            here = wide.view(np.uint64)[:, 0].copy()
            # An exchange ends where this character stands one row up and the last one here, unless the diagonal was free before.
            swapped = ((~level & here) << one) & before if swaps else np.uint64(0)
            level = swapped | (((here & up) + up) ^ up) | here | down
            right_up, right_down = down | ~(level | up), level & up
            change = ((right_up & bottom) != 0).astype(np.int32) - ((right_down & bottom) != 0)
            out += np.where(j < ends, change, 0)
            right_up, right_down = (right_up << one) | one, right_down << one
            up, down, before = right_down | ~(level | right_up), right_up & level, here
    return out


def osa(a: list[str], b: list[str], swaps: bool = True) -> np.ndarray:
    """Edits between the strings of each pair, where exchanging two neighbours counts once (twice without `swaps`) and nothing is edited twice."""
    out = np.zeros(len(a), np.int32)
    sizes = np.column_stack([np.fromiter(map(len, side), np.int64, len(a)) for side in (a, b)])
    small, large = sizes.min(axis=1), sizes.max(axis=1)
    out[small == 0] = large[small == 0]
    fits = (sizes > 0) & (sizes <= WORD_BITS)
    first, second, neither = fits[:, 0], ~fits[:, 0] & fits[:, 1] & (small > 0), small > WORD_BITS
    for chosen, solve, x, y, area in ((first & (small > 0), osa_in_words, a, b, large + WORD_BITS), (second, osa_in_words, b, a, large + WORD_BITS), (neither, osa_like, a, b, (large + 1) ** 2)):
        at = np.flatnonzero(chosen)
        order = at[np.argsort(large[at], kind="stable")]
        while len(order):
            few = max(1, CELLS // int(area[order[-1]]))
            part, order = order[-few:], order[:-few]
            out[part] = solve([x[i] for i in part], [y[i] for i in part], swaps)
    return out
