"""Operators written out plainly, to hold the library's against."""


def osa(a, b):
    """Edits between two strings, where exchanging two neighbours counts once and nothing is edited twice."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def greedy_sets(matches, n, least=1):
    """(set, ocrpos, manpos) chosen set by set: the best match left, then all that lie on its diagonal and start less than n words after some member."""
    rest, out, number = sorted(matches, key=lambda m: (m[0], abs(m[1] - m[2]), m[1], m[2])), [], 0
    while rest:
        chosen = [rest[0]]
        for m in rest[1:]:
            if m[1] - m[2] == chosen[0][1] - chosen[0][2] and m[1] < max(c[1] for c in chosen) + n:
                chosen.append(m)
        if len(chosen) < least:
            rest = rest[1:]
            continue
        out += [(number, o, t) for _, o, t in chosen]
        number += 1
        touches = lambda m: any(abs(m[1] - c[1]) < n or abs(m[2] - c[2]) < n for c in chosen)  # noqa: B023, E731
        rest = [m for m in rest if not touches(m)]
    return out


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
