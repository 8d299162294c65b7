"""Licence scans: matching statistics against a suffix automaton of licence texts.

All template texts and base phrases go into one generalised suffix automaton
over words. A document is streamed through it once: at each word the automaton
holds the longest run of words, ending there, that occurs in some template.
Base phrases are read off the states passed (through their suffix links), and
long maximal matches are chained, in order on both sides, into the span of each
template that the document covers, as often as it does. A match that goes on
beyond what a template has is clipped to it: the states above a state, by their
suffix links, are its endings, and they tell which templates have them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .license_texts import TEMPLATES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases whose every place counts, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words of a match worth chaining, and the share of a template that must be covered for its label.
LEAST_MATCH, LEAST_COVER = 3, 0.7
#: Words of a part of a match that counts for templates that lack the rest of it.
LEAST_CLIP = 8
#: Words that may stand between two matches of a span, and the share of a span's words that must be matched.
MOST_GAP, DENSITY = 30, 0.5


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased (bytes beyond ASCII are word bytes, so UTF-8 words split as their characters do)."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Generalised suffix automaton over word numbers, for several sequences."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, Sequence[str]]):
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.templates = [(label, words_of(t)) for label, texts in templates.items() for t in texts]
        self.number: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        #: For each state, the templates its words end in: (template, end) pairs of the prefixes it holds.
        self.ends: list[list[tuple[int, int]]] = [[]]
        for t, (_, words) in enumerate(self.templates):
            self._add(words, t)
        for words, _ in self.phrases:
            self._add(words, None)
        order = sorted(range(1, len(self.size)), key=lambda s: -self.size[s])
        for s in order:  # a shorter suffix ends wherever a longer one does
            if self.link[s] > 0:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})
        self.text_ids = [[self.number[w] for w in words] for _, words in self.templates]
        self.kept: dict[int, list[tuple[int, int, int]]] = {}
        own: dict[int, list[int]] = {}
        for p, (words, _) in enumerate(self.phrases):
            s = 0
            for w in words:
                s = self.go[s][self.number[w]]
            own.setdefault(s, []).append(p)
        #: For each state, phrases that end its match: (phrase, words).
        self.said: list[list[tuple[int, int]]] = [[] for _ in self.size]
        for s in reversed(order):
            self.said[s] = [(p, len(self.phrases[p][0])) for p in own.get(s, [])] + (self.said[self.link[s]] if self.link[s] > 0 else [])

    def _new(self, size: int, go: dict[int, int] | None = None, link: int = -1) -> int:
        self.size.append(size)
        self.go.append(dict(go or {}))
        self.link.append(link)
        self.ends.append([])
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.size[p] + 1, self.go[q], self.link[q])
        self.link[q] = clone
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, words: Sequence[bytes], template: int | None) -> None:
        last = 0
        for at, w in enumerate(words):
            c = self.number.setdefault(w, len(self.number))
            if c in self.go[last]:
                q = self.go[last][c]
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, q, c)
            else:
                s, p = self._new(self.size[last] + 1), last
                while p >= 0 and c not in self.go[p]:
                    self.go[p][c] = s
                    p = self.link[p]
                if p < 0:
                    self.link[s] = 0
                else:
                    q = self.go[p][c]
                    self.link[s] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
                last = s
            if template is not None:
                self.ends[last].append((template, at + 1))

    def reach(self, s: int) -> list[tuple[int, int, int]]:
        """(template, end, words) of every place where a template has an ending of LEAST_CLIP words or more of the state's longest run, and how much of it."""
        found = self.kept.get(s)
        if found is None:
            by: dict[tuple[int, int], int] = {}
            at = s
            while at > 0 and self.size[at] >= LEAST_CLIP:
                for place in self.ends[at]:
                    by.setdefault(place, self.size[at])
                at = self.link[at]
            found = self.kept[s] = [(t, end, n) for (t, end), n in by.items()]
        return found

    def stream(self, ids: Sequence[int], first: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
        """Over word numbers of a run starting at word `first`: phrase places (start, phrase), maximal matches (start, words, state),
        and for each template the maximal matches of LEAST_CLIP words or more (template, start, start in the template, words)."""
        places, matches, clipped, s, n = [], [], [], 0, 0
        for i, c in enumerate(ids):
            before = (s, n)
            while s and c not in self.go[s]:
                s = self.link[s]
                n = self.size[s]
            if c in self.go[s]:
                s, n = self.go[s][c], n + 1
            if n <= before[1] and before[1] >= LEAST_MATCH:
                matches.append((first + i - before[1], before[1], before[0]))
            for p, m in self.said[s]:
                if m <= n:
                    places.append((first + i + 1 - m, p))
            if n >= LEAST_CLIP:
                after = ids[i + 1] if i + 1 < len(ids) else None
                for t, end, most in self.reach(s):
                    text = self.text_ids[t]
                    if end == len(text) or text[end] != after:
                        m = min(most, n)
                        clipped.append((t, first + i + 1 - m, end - m, m))
        if n >= LEAST_MATCH:
            matches.append((first + len(ids) - n, n, s))
        return places, matches, clipped


@lru_cache(maxsize=4)
def automaton_of(phrases: tuple[tuple[str, str], ...], templates: tuple[tuple[str, tuple[str, ...]], ...]) -> Automaton:
    """Built once by each worker."""
    return Automaton(dict(phrases), dict(templates))


def chain(pieces: Sequence[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Of matches (start in text, start in template, words): the most template words covered by a chain in order
    on both sides, without overlap, and the chain's first and last + 1 word in the text."""
    pieces = sorted(pieces, key=lambda x: (x[0] + x[2], x[1] + x[2]))
    # best[k] rises with the end in the template: the best chain ending at or before it
    ends: list[int] = []
    best: list[tuple[int, int, int]] = []
    waiting: list[tuple[int, int, tuple[int, int, int]]] = []
    top = (0, 0, 0)
    starts = sorted(range(len(pieces)), key=lambda k: pieces[k][0])
    done: list[tuple[int, int, tuple[int, int, int]]] = []

    def close(upto: int) -> None:
        keep = []
        for text_end, end, value in sorted(waiting, key=lambda x: x[0]):
            if text_end > upto:
                keep.append((text_end, end, value))
                continue
            k = bisect_left(ends, end)
            if (k < len(ends) and ends[k] == end and best[k][0] >= value[0]) or (k and best[k - 1][0] >= value[0]):
                continue
            if k < len(ends) and ends[k] == end:
                best[k] = value
            else:
                ends.insert(k, end)
                best.insert(k, value)
            while k + 1 < len(ends) and best[k + 1][0] <= value[0]:
                del ends[k + 1], best[k + 1]
        waiting[:] = keep

    for k in starts:
        a, b, n = pieces[k]
        close(a)
        j = bisect_left(ends, b + 1) - 1
        base = best[j] if j >= 0 else (0, a, a)
        value = (base[0] + n, base[1] if j >= 0 else a, a + n)
        waiting.append((a + n, b + n, value))
        done.append((a + n, b + n, value))
        top = max(top, value, key=lambda v: (v[0], -v[1]))
    return top


Piece = tuple[int, int, int]


def dense_chain(pieces: Sequence[Piece]) -> Piece:
    """The best chain that has DENSITY: of matches whose chain has not, those on the better side of their widest gap."""
    while True:
        covered, first, after = chain(pieces)
        if covered >= DENSITY * (after - first) or len(pieces) == 1:
            return covered, first, after
        gaps = [b[0] - a[0] - a[2] for a, b in zip(pieces, pieces[1:])]
        at = gaps.index(max(gaps)) + 1
        pieces = max(pieces[:at], pieces[at:], key=lambda p: sum(x[2] for x in p))


def spans_of(pieces: Sequence[Piece], size: int) -> list[Piece]:
    """All spans of a text (covered words, first word, word after the last) in which matches (start in text, start in template,
    words) cover a template of `size` words, without overlap.

    A span has no gap over MOST_GAP and is dense. It is sought among the matches
    of a stretch of twice the template; what lies before it there makes spans of
    its own, and the next one is sought behind it. So a text's cost grows with
    its matches, not with their square.
    """
    pieces = sorted(pieces)
    starts = [p[0] for p in pieces]
    out, i = [], 0
    while i < len(pieces):
        j, end = i + 1, pieces[i][0] + pieces[i][2]
        while j < len(pieces) and starts[j] < starts[i] + 2 * size and starts[j] - end <= MOST_GAP:
            end = max(end, pieces[j][0] + pieces[j][2])
            j += 1
        found = dense_chain(pieces[i:j])
        before = [p for p in pieces[i:j] if p[0] + p[2] <= found[1]]
        if before:
            out += spans_of(before, size)
        out.append(found)
        i = max(i + 1, bisect_left(starts, found[2]))
    return out


def labels_of(spans: Sequence[tuple[str, int, int, float]], sizes: Sequence[int], least_cover: float) -> set[str]:
    """Labels of the spans that cover `least_cover` of their template, but for those within a span of another label with more matched words,
    or with as many that are a larger share of its template.

    sizes: words of each span's template. So a text of a licence is not also
    taken for a shorter one that it is built on, or for a longer one built on it.
    """
    good = sorted((first, -after, -round(share * size), -share, label) for (label, first, after, share), size in zip(spans, sizes) if share >= least_cover)
    around: list[tuple[int, tuple[int, float], str]] = []  # spans that reach beyond the current one's start: at most one of each template
    out = set()
    for first, minus_after, minus_covered, minus_share, label in good:
        mine = (-minus_covered, -minus_share)
        around = [x for x in around if x[0] > first]
        if not any(after >= -minus_after and theirs > mine and other != label for after, theirs, other in around):
            out.add(label)
        around.append((-minus_after, mine, label))
    return out


def scan_text(automaton: Automaton, text: str) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]], list[int]]:
    """Words of a text, its base places (start, phrase), covered spans (label, first word, last word + 1, share of the template) and their templates' words."""
    words = words_of(text)
    get = automaton.number.get
    ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    known = np.concatenate([[0], (ids >= 0).view(np.int8), [0]])
    edges = np.flatnonzero(np.diff(known)).reshape(-1, 2)
    places: list[tuple[int, int]] = []
    found: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in edges[edges[:, 1] - edges[:, 0] > 1].tolist():
        said, matches, clipped = automaton.stream(ids[a:b].tolist(), a)
        places += said
        for t, start, there, n in clipped:
            found.setdefault(t, []).append((start, there, n))
        for start, n, state in matches:
            for t, end in automaton.ends[state] if n < LEAST_CLIP else ():
                found.setdefault(t, []).append((start, end - n, n))
    spans, sizes = [], []
    for t, pieces in sorted(found.items()):
        label, template = automaton.templates[t]
        spans += [(label, first, after, covered / len(template)) for covered, first, after in spans_of(pieces, len(template))]
        sizes += [len(template)] * (len(spans) - len(sizes))
    return len(words), places, spans, sizes


def scan_licenses(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    least_cover: float = LEAST_COVER,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of all phrases; first_word and last_word are the
    smallest and largest start of one (null without any). labels adds to
    base_labels those of templates covered by `least_cover` or more (see
    labels_of); both are distinct, sorted and joined by commas, empty if none. A
    match counts for the templates that hold all of it, and what of it has
    LEAST_CLIP words or more for those that hold that. score is the largest
    covered share of a template, 1 where a phrase stands. spans lists where a
    template is touched by matches of LEAST_MATCH words, a further copy too:
    (label, first word, word after the last, share). Matches further apart than
    MOST_GAP words, or too thin for DENSITY, are spans of their own. Equal
    matches of several templates count for each. A null text counts as empty; repeated rows each get
    a row; no rows give no rows. A phrase of one word or fewer is an error, as
    only runs of two known words are streamed.
    """
    if any(len(words_of(p)) < 2 for p in phrases):
        raise ValueError("a phrase needs two words")
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = tuple(phrases.items()), tuple((label, tuple(texts)) for label, texts in templates.items())
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(*named)
        for b in batches:
            n_words, n_base, first, last, base, labels, score, all_spans = ([] for _ in range(8))
            for text in b.column(1).to_pylist():
                n, places, spans, sizes = scan_text(automaton, text or "")
                base_of = {automaton.phrases[p][1] for _, p in places}
                n_words.append(n)
                n_base.append(len(places))
                first.append(min((s for s, _ in places), default=None))
                last.append(max((s for s, _ in places), default=None))
                base.append(",".join(sorted(base_of)))
                labels.append(",".join(sorted(base_of | labels_of(spans, sizes, least_cover))))
                score.append(1.0 if places else max((x[3] for x in spans), default=0.0))
                all_spans.append([dict(zip(("label", "first", "after", "share"), x)) for x in spans])
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), long(n_words), long(n_base), long(first), long(last), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(all_spans, pa.list_(span))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label: string, first: long, after: long, share: double>>",
    )
