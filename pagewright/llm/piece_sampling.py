"""SentencePiece encoding by sampling segmentations without replacement, and decoding.

All segmentations of a text form a lattice of pieces. Each has a probability in
proportion to the product of its pieces' weights. The k with the largest
Gumbel-perturbed log-probabilities are a sample without replacement. They are
found best first: a partial segmentation stands for everything below it, its
perturbed value is the largest among them (drawn top-down, so it is exact and
serves as the bound of an A* search), and the queue's head is expanded.
Following the child that carries its parent's value is a draw from the
forward-filtered lattice; all other children of a node together stay in the
queue as one entry, whose value is a Gumbel truncated at the parent's.

Words are independent of one another, as no piece reaches across the space
before a word, so the lattice of a batch is built once for each distinct word
and all words of all texts are sampled together in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, offsets, small_batches, strings

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Added to the rank of a piece of a BPE model, which has no probabilities: weights fall as 1 / (rank + SHIFT).
SHIFT = 100.0
#: Characters sampled together.
CHUNK = 1_600_000
#: Columns that sampling adds.
ADDED = {
    "sp_rank": T.IntegerType(), "sp_ids": T.ArrayType(T.IntegerType()), "sp_logp": T.DoubleType(), "sp_gumbel": T.DoubleType(),
    "sp_inclusion": T.DoubleType(), "sp_exact": T.BooleanType(),
}


class Pieces:
    """Pieces and log-weights of a model file. A unigram model's scores are used as they are."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        scores = np.array([p.get_score(i) for i in usable])
        ranks = bool(len(scores)) and bool((scores == np.round(scores)).all())
        self.weight = np.full(p.get_piece_size(), -np.log(p.get_piece_size() + SHIFT))
        self.weight[usable] = -np.log(-scores + SHIFT) if ranks else scores
        self.factor = np.exp(self.weight)
        self.number = {p.id_to_piece(i): i for i in usable}
        self.bytes = {p.id_to_piece(i): i for i in range(p.get_piece_size()) if p.is_byte(i)}
        self.unknown = p.unk_id()
        #: What each piece stands for in a text, as bytes, and whether a text gets a space before it that its pieces show.
        self.meant = pa.array([self._meant(i) for i in range(p.get_piece_size())], pa.binary())
        self.prefixed = p.normalize("a").replace(" ", SPACE).startswith(SPACE)
        self.table = Table(self.number)
        self.by_word = all(SPACE not in s.lstrip(SPACE) for s in self.number)

    def _meant(self, i: int) -> bytes:
        p = self.processor
        name = p.id_to_piece(i)
        if p.is_byte(i):
            return bytes([int(name[1:-1], 16)])
        return b"" if p.is_control(i) else " \u2047 ".encode() if p.is_unknown(i) else name.replace(SPACE, " ").encode()

    def exact(self, ids: np.ndarray, starts: np.ndarray, given: pa.Array) -> pa.Array:
        """Whether runs of ids stand for the given texts (binary); starts tells where each run begins, and the end of the last."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), self.meant.take(pa.array(ids))), b"")
        same = pc.equal(joined, given)
        if not self.prefixed:
            return same
        after = pc.equal(joined, pc.binary_join_element_wise(pa.scalar(b" "), given, pa.scalar(b"")))
        return pc.or_(after, pc.and_not(same, pc.starts_with(joined, " ")))

    def segments(self, text: str) -> list[str]:
        """The normalised text, cut where no piece can reach across."""
        made = self.processor.normalize(text).replace(" ", SPACE) if text else ""
        return SEGMENT.findall(made) if self.by_word else [made] if made else []

    def spelled(self, char: str) -> tuple[int, ...]:
        """Ids for a character that is no piece: its bytes, or the unknown piece."""
        names = [f"<0x{b:02X}>" for b in char.encode("utf-8", "surrogatepass")]
        return tuple(self.bytes[n] for n in names) if all(n in self.bytes for n in names) else (self.unknown,)


@cache
def load(path: str) -> Pieces:
    """The pieces of a model file, read once by each worker."""
    return Pieces(path)


class Table:
    """Piece ids by a rolling hash of their characters, in an open-addressed array; also knows what begins a piece."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, number: dict[str, int]):
        wanted: dict[int, int] = {}
        names: dict[int, str] = {}
        for s, i in [*((s[:n], -1) for s in number for n in range(1, len(s))), *number.items()]:
            h = 0
            for c in s:
                h = ((h * int(self.FACTOR)) + ord(c) + 1) & ((1 << 64) - 1)
            if names.setdefault(h, s) != s:
                raise ValueError("two pieces have the same hash")
            wanted[h] = i
        self.longest = max(map(len, number), default=0)
        self.bits = max(4, (4 * len(wanted)).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -2, np.int64)
        h, ids = np.fromiter(wanted, np.uint64, len(wanted)), np.fromiter(wanted.values(), np.int64, len(wanted))
        slot, left = self._slot(h), np.arange(len(h))
        while len(left):
            free = left[self.ids[slot[left]] == -2]
            _, firsts = np.unique(slot[free], return_index=True)
            put = free[firsts]
            self.keys[slot[put]], self.ids[slot[put]] = h[put], ids[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (mix64(h) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids; -1 for what only begins a piece, -2 for the rest."""
        slot = self._slot(h)
        found = self.ids[slot]
        miss = np.flatnonzero((found != -2) & (self.keys[slot] != h))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            found[miss] = self.ids[slot[miss]]
            miss = miss[(found[miss] != -2) & (self.keys[slot[miss]] != h[miss])]
        return found


class Lattice:
    """Edges of the lattices of distinct segments, sorted by their start, the longest piece first.

    A state is a place in a segment. States are laid out by their distance from
    the segment's end, the segments in one order at every distance, so that an
    edge leads to a state further to the front and sums run from front to back.
    """

    #: Characters before a segment's end up to which sums are kept as plain numbers; beyond it, as logarithms.
    PLAIN = 50

    def __init__(self, pieces: Pieces, distinct: list[str]):
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        # At each distance the longest segments come first, so those that reach that far are a prefix of all.
        by_size = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[by_size] = np.arange(len(sizes))
        reaching = np.cumsum(np.bincount(sizes)[::-1])[::-1] if len(sizes) else np.zeros(1, np.int64)
        column = offsets(reaching)
        #: First state of each segment; states before `ends` lie after a segment's last character and have no edges.
        self.base, self.ends = column[sizes] + rank, len(sizes)
        n, most = int(column[-1]), len(reaching) - 1
        left = np.repeat(np.arange(most + 1, dtype=np.int32), reaching)
        text_at = offsets(sizes)[1:][by_size]  # each segment's end among all characters
        codes = np.frombuffer("".join(distinct).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.arange(self.ends, n)
        char = text_at[at - column[left[at]]] - left[at]
        h = np.zeros(len(at), np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.spelled: list[tuple[int, ...]] = []
        for size in range(1, pieces.table.longest + 1):
            if not len(at):
                break
            h = h * Table.FACTOR + codes[char + (size - 1)] + np.uint64(1)
            ids = pieces.table.find(h)
            hit = ids >= 0
            found.append((at[hit], ids[hit], size))
            if size == 1 and not hit.all():  # always a way through
                lost, chars = np.unique(codes[char[~hit]], return_inverse=True)
                self.spelled = [pieces.spelled(chr(int(c))) for c in lost]
                found.append((at[~hit], -1 - chars, 1))
            on = np.flatnonzero((ids >= -1) & (left[at] > size))
            at, h, char = at[on], h[on], char[on]
        degree = np.zeros(n, np.int64)
        for where, _, _ in found:
            degree[where] += 1
        self.first = offsets(degree)
        free = self.first[:-1].copy()
        # Four bytes a number: these arrays are most of a worker's memory.
        self.ids, self.dst = np.zeros(int(self.first[-1]), np.int32), np.zeros(int(self.first[-1]), np.int32)
        for where, ids, size in reversed(found):
            put, near = free[where], left[where]
            self.ids[put], self.dst[put] = ids, where - column[near] + column[near - size]
            free[where] += 1
        self.src = np.repeat(np.arange(n, dtype=np.int32), degree)
        del found, free, left
        factor = pieces.factor[np.maximum(self.ids, 0)]
        low = np.flatnonzero(self.ids < 0) if self.spelled else np.zeros(0, np.int64)
        spelled = np.array([pieces.weight[list(x)].sum() for x in self.spelled])
        factor[low] = np.exp(spelled[-1 - self.ids[low]])
        # Sums over all ways on to the end, distance by distance.
        cuts = self.first[column].tolist()
        plain = np.zeros(n)
        plain[: self.ends] = 1.0
        for d in range(1, min(most, self.PLAIN) + 1):
            x, y, a, b = column[d], column[d + 1], cuts[d], cuts[d + 1]
            plain[x:y] = np.add.reduceat(factor[a:b] * plain[self.dst[a:b]], self.first[x:y] - a)
        #: Probability of each edge at its start, and running sums that locate a draw.
        with np.errstate(divide="ignore", invalid="ignore"):
            self.prob = factor * plain[self.dst] / plain[self.src]
        if most > self.PLAIN:
            with np.errstate(divide="ignore"):
                total = np.log(plain)
            far = cuts[self.PLAIN + 1]
            weight = pieces.weight[np.maximum(self.ids[far:], 0)]
            low = low[low >= far]
            weight[low - far] = spelled[-1 - self.ids[low]]
            for d in range(self.PLAIN + 1, most + 1):
                x, y, a, b = column[d], column[d + 1], cuts[d], cuts[d + 1]
                total[x:y] = np.logaddexp.reduceat(weight[a - far : b - far] + total[self.dst[a:b]], self.first[x:y] - a)
            self.prob[far:] = np.exp(weight + total[self.dst[far:]] - total[self.src[far:]])
        del factor, plain
        # Summed edge by edge within a state, so that a draw is the same whatever else is in the batch.
        self.reach = self.prob.copy()
        more, step = np.flatnonzero(degree > 1), 1
        while len(more):
            here = self.first[more] + step
            self.reach[here] += self.reach[here - 1]
            step += 1
            more = more[degree[more] > step]
        self.reach[self.first[1:][self.ends :] - 1] = 2.0

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each state, by its probability."""
        edge = self.first[state]
        more = np.flatnonzero(u >= self.reach[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] >= self.reach[edge[more]]]
        return edge

    def walk(self, state: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw on from each state to its segment's end. Returns how many edges each takes, and all of them in the states' order."""
        taken, got, count = [], [], np.zeros(len(state), np.int64)
        at, seed = np.arange(len(state)), mix_place(place)
        while True:
            live = np.flatnonzero(state >= self.ends)
            if len(live) < len(at):
                state, key, seed, at = state[live], key[live], seed[live], at[live]
            if not len(at):
                break
            edge = self.draw(state, uniform(key, seed, len(got)))
            taken.append(at)
            got.append(edge)
            count[at] += 1
            state = self.dst[edge]
        starts = offsets(count)
        out = np.zeros(int(starts[-1]), np.int64)
        for step, (at, edge) in enumerate(zip(taken, got)):
            out[starts[at] + step] = edge
        return count, out

    def pieces_of(self, edges: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of paths laid out one after the other, and each path's number of them; a spelled character may take several."""
        ids = self.ids[edges]
        low = np.flatnonzero(ids < 0)
        if not len(low):
            return ids, sizes
        spelled = [self.spelled[-1 - i] for i in ids[low].tolist()]
        more = np.ones(len(ids), np.int64)
        more[low] = [len(x) for x in spelled]
        at = offsets(more)
        out = np.repeat(ids, more)
        out[ranges(at[:-1][low], more[low])] = np.array([i for x in spelled for i in x], np.int32)
        return out, np.diff(at[offsets(sizes)])


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, one run after the other."""
    starts = offsets(sizes)
    return np.arange(int(starts[-1])) + np.repeat(first - starts[:-1], sizes)


def mix_place(place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def uniform(key: np.ndarray, seed: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) fixed by a row's key, a place in its text (from mix_place) and a step."""
    with np.errstate(over="ignore"):
        x = mix64(key + mix64(seed + (np.uint64(step) if isinstance(step, int) else step.astype(np.uint64))))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def truncated(phi: np.ndarray, top: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with locations phi, given that they lie below top."""
    with np.errstate(divide="ignore", invalid="ignore"):
        value = phi - np.log(np.exp(phi - top) - np.log(u))
    return np.where(np.isneginf(phi), -np.inf, np.minimum(value, top))


class Queues:
    """The queues of all texts of a batch: sampled paths, and for each of their nodes the rest of its children.

    Nodes of all paths lie one after the other in flat arrays.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.edges, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each node: its edge, its segment's place in the text
        self.phi, self.rest = np.zeros(0), np.zeros(0)  # log-probability of the path up to it, perturbed value of its other children
        self.starts = np.zeros(1, np.int64)
        self.owner, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each path: its text, which of the text's paths it is
        self.value, self.logp = np.zeros(0), np.zeros(0)
        self.gone: dict[int, list[int]] = {}  # by node: children that later paths have taken

    def add(self, lattice: Lattice, owner, number: int, edges, place, sizes, value, since) -> None:
        """Take in one path for each of the texts in owner; its nodes before `since` belong to an earlier path."""
        starts = offsets(sizes)
        logp = np.log(np.minimum(lattice.prob[edges], 1.0))
        upto = np.empty(len(logp))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            np.cumsum(logp[a:b], out=upto[a:b])
        phi = np.concatenate([[0.0], upto[:-1]]) if len(upto) else upto
        phi[starts[:-1][sizes > 0]] = 0.0
        with np.errstate(divide="ignore"):
            other = phi + np.log(-np.expm1(logp))
        node = ranges(np.zeros(len(sizes), np.int64), sizes)
        with np.errstate(over="ignore"):
            key = self.keys[owner] + np.uint64(7919 * (number + 1))
        rest = truncated(other, np.repeat(value, sizes), uniform(np.repeat(key, sizes), mix_place(node), 1 << 40))
        rest[node < np.repeat(since, sizes)] = -np.inf
        full = np.zeros(len(sizes))
        full[sizes > 0] = upto[starts[1:][sizes > 0] - 1]
        join = lambda *x: np.concatenate(x)
        self.edges, self.place = join(self.edges, edges), join(self.place, place)
        self.phi, self.rest = join(self.phi, phi), join(self.rest, rest)
        self.starts = join(self.starts, self.starts[-1] + starts[1:])
        self.owner, self.number = join(self.owner, owner), join(self.number, np.full(len(owner), number))
        self.value, self.logp = join(self.value, value), join(self.logp, full)

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text the path of the best entry left (-1: none) and its value."""
        most = np.full(len(self.owner), -np.inf)
        filled = np.flatnonzero(np.diff(self.starts))
        if len(filled):
            most[filled] = np.maximum.reduceat(self.rest, self.starts[:-1][filled])
        best = np.full(len(self.keys), -np.inf)
        np.maximum.at(best, self.owner, most)
        first = np.flatnonzero((most == best[self.owner]) & (most > -np.inf))[::-1]
        path = np.full(len(self.keys), -1)
        path[self.owner[first]] = first
        return path, best

    def branch(self, lattice: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expand each text's best entry: paths, their nodes (flat), values, and the other child drawn by probability.

        What is still left of a node goes back into the queue; a node without anything left goes, and the next is tried.
        """
        done: list[tuple] = []
        todo = np.arange(len(self.keys))
        while len(todo):
            path, value = (x[todo] for x in self.heads())
            path, value = path[path >= 0], value[path >= 0]
            if not len(path):
                break
            node = np.array([a + int(self.rest[a:b].argmax()) for a, b in zip(self.starts[path].tolist(), self.starts[path + 1].tolist())])
            state = lattice.src[self.edges[node]]
            out = lattice.first[state][:, None] + np.arange(int((lattice.first[state + 1] - lattice.first[state]).max()))
            there = (out < lattice.first[state + 1][:, None]) & (out != self.edges[node][:, None])
            taken = np.ones(len(node), np.int64)
            for i, x in enumerate(node.tolist()):
                if x in self.gone:
                    there[i] &= ~np.isin(out[i], self.gone[x])
                    taken[i] += len(self.gone[x])
            out = np.minimum(out, len(lattice.prob) - 1)
            prob = np.where(there, lattice.prob[out], 0.0)
            run = np.cumsum(prob, axis=1)
            total = run[:, -1]
            with np.errstate(over="ignore"):
                key = self.keys[self.owner[path]] + (104729 * (self.number[path] + 1)).astype(np.uint64)
            seed = mix_place(node - self.starts[path])
            u = uniform(key, seed, (1 << 41) + taken)
            pick = np.argmax(run > (u * total)[:, None], axis=1)
            edge, left = out[np.arange(len(node)), pick], total - prob[np.arange(len(node)), pick]
            left[there.sum(axis=1) < 2] = 0.0
            with np.errstate(divide="ignore"):
                phi = self.phi[node] + np.where(left > 1e-15, np.log(left), -np.inf)
            some = total > 0
            self.rest[node] = np.where(some, truncated(phi, value, uniform(key, seed, (1 << 42) + taken + 1)), -np.inf)
            for x, e in zip(node[some].tolist(), edge[some].tolist()):
                self.gone.setdefault(x, []).append(e)
            done.append((path[some], node[some], value[some], edge[some]))
            todo = self.owner[path[~some]]
        found = [np.concatenate(x) for x in zip(*done)] if done else [np.zeros(0, np.int64)] * 4
        order = np.argsort(self.owner[found[0]], kind="stable")
        return tuple(x[order] for x in found)


@dataclass(frozen=True)
class Samples:
    """Sampled segmentations of a batch, by text, then best first; the ids of all of them lie one after the other."""

    owner: np.ndarray
    rank: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    logp: np.ndarray
    value: np.ndarray
    inclusion: np.ndarray


def sample_batch(pieces: Pieces, texts: list[str], keys: np.ndarray, k: int) -> Samples:
    """Up to k distinct segmentations of each text."""
    words = [pieces.segments(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes, distinct = pd.factorize(np.array([w for ws in words for w in ws], object))
    del words
    lattice = Lattice(pieces, list(distinct))
    starts = offsets(sizes)
    state = lattice.base[codes] if len(codes) else np.zeros(0, np.int64)
    place = ranges(np.zeros(len(sizes), np.int64), sizes)
    queues = Queues(keys)
    count, edges = lattice.walk(state, np.repeat(keys, sizes), place)
    nodes = np.diff(offsets(count)[starts])
    u = uniform(keys, np.zeros(len(keys), np.uint64), 1 << 43)
    none = np.zeros(len(keys), np.int64)
    queues.add(lattice, np.arange(len(keys)), 0, edges, np.repeat(place, count), nodes, -np.log(-np.log(u)), none)
    for round_ in range(1, k):
        path, node, value, edge = queues.branch(lattice)
        if not len(path):
            break
        # The rest of the branch's own segment, then all later segments of the text.
        owner, here = queues.owner[path], queues.place[node]
        words_left = sizes[owner] - here
        onward = ranges(starts[owner] + here, words_left)
        states = state[onward]
        states[offsets(words_left)[:-1]] = lattice.dst[edge]
        with np.errstate(over="ignore"):
            key = keys[owner] + np.uint64(15485863 * round_)
        count, got = lattice.walk(states, np.repeat(key, words_left), place[onward])
        ends = offsets(count)[offsets(words_left)]
        before, after = node - queues.starts[path], np.diff(ends)
        nodes = before + 1 + after
        at = offsets(nodes)[:-1]
        new, where = np.empty(int(nodes.sum()), np.int64), np.empty(int(nodes.sum()), np.int64)
        old, kept = ranges(queues.starts[path], before), ranges(at, before)
        new[kept], where[kept] = queues.edges[old], queues.place[old]
        new[at + before], where[at + before] = edge, here
        onto = ranges(at + before + 1, after)
        new[onto], where[onto] = got, np.repeat(place[onward], count)
        queues.add(lattice, owner, round_, new, where, nodes, value, before + 1)
    limit = queues.heads()[1][queues.owner]
    with np.errstate(invalid="ignore"):
        chance = np.where(np.isneginf(limit), 1.0, -np.expm1(-np.exp(np.minimum(queues.logp - limit, 50.0))))
    order = np.lexsort((queues.number, queues.owner))
    nodes = np.diff(queues.starts)[order]
    ids, made = lattice.pieces_of(queues.edges[ranges(queues.starts[:-1][order], nodes)], nodes)
    return Samples(queues.owner[order], queues.number[order] + 1, ids, offsets(made), queues.logp[order], queues.value[order], chance[order])


def row_keys(column: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit number for each key, the same wherever the row is."""
    with np.errstate(over="ignore"):
        return mix64(pd.util.hash_array(np.array([str(x) for x in column.to_pylist()], object)) + np.uint64(seed))


def sample_pieces(
    docs: DataFrame, path: str, k: int = 2, seed: int = 8, key: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Each row with up to k distinct sampled segmentations of its whole text, one row each.

    Adds `sp_rank` (from 1, by perturbed value), `sp_ids` (piece ids),
    `sp_logp` (log-probability among all segmentations), `sp_gumbel` (perturbed
    value), `sp_inclusion` (probability of being among the k, given the best
    value left out; 1 where nothing is left out) and `sp_exact` (the ids decode
    to the text). A null or empty text has one segmentation, without pieces.
    Sampling is fixed by (seed, key) alone; rows that repeat a key and a text
    get the same samples. Columns of these names are replaced, those in `keep`
    (None: all others) are carried on, each with a row's every sample. No rows
    give no rows. path: a SentencePiece model file that every executor has.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ADDED and (keep is None or f.name in keep)]
    names = [f.name for f in kept]
    chosen = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), *[F.col(f"`{n}`").alias(f"kept{i}") for i, n in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for b in batches:
            keys, texts, carried = row_keys(b.column(0), seed), strings(b.column(1)), b.columns[2:]
            at, total = 0, sum(map(len, texts))
            most = total / -(-total // CHUNK) + 1 if total else 1  # parts of like size
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= most):
                    size += len(texts[end])
                    end += 1
                found = sample_batch(pieces, texts[at:end], keys[at:end], k)
                rows = at + found.owner
                given = b.column(1).take(pa.array(rows)).cast(pa.binary()).fill_null(b"")
                made = [
                    pa.array(found.rank, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(found.starts, pa.int32()), pa.array(found.ids, pa.int32())),
                    *(pa.array(x, pa.float64()) for x in (found.logp, found.value, found.inclusion)),
                    pieces.exact(found.ids, found.starts, given),
                ]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows)) for c in carried], *made], names=[*names, *ADDED])
                at = end

    return chosen.mapInArrow(run, T.StructType([*kept, *(T.StructField(*x) for x in ADDED.items())]))


def decode_pieces(rows: DataFrame, path: str, ids: str = "sp_ids", to: str = "sp_text") -> DataFrame:
    """Add the text that a list of piece ids stands for; null lists give null."""
    small_batches(rows.sparkSession)
    rows = rows.drop(to)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(path).processor
        for b in batches:
            texts = [None if x is None else processor.decode(x) if x else "" for x in b.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, to])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())]))
