"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digits that stand for letters) and
an Aho-Corasick automaton finds lexicon entries at word starts. Exception
phrases cancel the hits they cover. The sum of the hits' weights, raw and
divided by the text's length, gives a probability. The lexicon, its weights and
the two coefficients are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, held_out, settle, small_batches, strings

#: Characters that look like a Latin letter, and digits or signs used for one.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe",
    "ɑ": "a", "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ԁ": "d", "đ": "d", "ð": "d", "ᴅ": "d", "ᴇ": "e", "ƒ": "f", "ɡ": "g", "ɢ": "g", "һ": "h", "ħ": "h", "ʜ": "h",
    "ɪ": "i", "ᴊ": "j", "ᴋ": "k", "ӏ": "l", "ʟ": "l", "ᴍ": "m", "ո": "n", "ɴ": "n", "օ": "o", "σ": "o", "ᴏ": "o", "ᴘ": "p", "ԛ": "q", "ʀ": "r", "ꜱ": "s",
    "ŧ": "t", "ᴛ": "t", "ս": "u", "ᴜ": "u", "ѵ": "v", "ᴠ": "v", "ԝ": "w", "ѡ": "w", "ω": "w", "ᴡ": "w", "γ": "y", "ʏ": "y", "ᴢ": "z",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Labelled documents of each class that the model is fitted on, about.
SAMPLE = 4000
#: Prefixes tried, and what an entry needs: toxic documents and their share of all toxic ones, log-odds.
PREFIXES = range(4, 9)
LEAST_DOCS, LEAST_SHARE, LEAST_WEIGHT = 5, 0.01, 3.0
#: Single letters one after the other, as in a word that is spelled out.
SPELLED = re.compile(r"(?<= )(?:[^ ] ){3,}[^ ](?= )")


@cache
def folding() -> dict[int, str]:
    """What every code point folds to: nothing if it is not seen (joiners, soft hyphens, marks), a space if it is no letter."""

    def fold(c: int) -> str | None:
        ch = chr(c)
        if ch in DIGITS:
            return DIGITS[ch]
        if unicodedata.category(ch) == "Cf":
            return ""
        out = "".join(x for x in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(x))
        out = "".join(LOOKALIKES.get(x, x) for x in out)
        return (out if out.isalpha() else " ") if out else ""

    class Table(dict):
        def __missing__(self, c: int) -> str:
            self[c] = fold(c)
            return self[c]

    return Table()


def fold(text: str) -> str:
    """The text in folded words with one space before, between and after each; spelled-out words are joined."""
    words = " " + " ".join(text.translate(folding()).split()) + " "
    return SPELLED.sub(lambda m: m[0].replace(" ", ""), words)


def features(folded: str) -> set[str]:
    """Prefixes (' word') and whole words (' word ') of a folded text."""
    found = set()
    for w in set(folded.split()):
        found.add(f" {w} ")
        found.update(f" {w[:n]}" for n in PREFIXES if len(w) >= n)
    return found


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights (' pre' matches word starts, ' word ' whole words), exceptions, and bias, raw and density coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (-3.0, 1.0, 1.0)
    built: list = field(default_factory=list, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"built": []}

    def automaton(self):
        if not self.built:
            import ahocorasick

            a = ahocorasick.Automaton()
            for k, w in self.weights.items():
                a.add_word(k, (len(k), w))
            for x in {" " + " ".join(fold(p).split()) + " " for p in self.exceptions}:
                a.add_word(x, (len(x), None))
            a.make_automaton()
            self.built.append(a if len(a) else None)
        return self.built[0]

    def hits(self, folded: str) -> dict[int, float]:
        """Places of a folded text at which an entry starts, with the weight of the heaviest one; those in an exception phrase are left out."""
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton().iter(folded):
            start = end + 1 - size
            if w is None:
                free.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        if not free or not best:
            return best
        # Phrases and hits by place, once: what has passed the end of all phrases begun so far is free of them.
        kept, covered, i = {}, -1, 0
        free.sort()
        for at in sorted(best):
            while i < len(free) and free[i][0] <= at:
                covered = max(covered, free[i][1])
                i += 1
            if at >= covered:
                kept[at] = best[at]
        return kept

    def raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: sum of weights (the heaviest entry at each word), number of hit words, number of words."""
        raw, hits, words = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        automaton = self.automaton()
        for i, t in enumerate(texts):
            folded = fold(t)
            words[i] = folded.count(" ") - 1 if len(folded) > 2 else 0
            best = self.hits(folded) if automaton is not None and words[i] else {}
            raw[i], hits[i] = sum(best.values()), len(best)
        return raw, hits, words

    def score(self, raw: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(raw, words) @ np.array(self.coefficients), -500, 500)))


def design(raw: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(raw)), np.log1p(raw), np.log1p(100 * raw / (words + 20))])


def phrases(folded: str, at: int) -> Iterator[str]:
    """The word that starts after `at` with the word before it, and with the one after it."""
    end = folded.index(" ", at + 1)
    if at:
        yield folded[folded.rindex(" ", 0, at) + 1 : end]
    if end + 1 < len(folded):
        yield folded[at + 1 : folded.index(" ", end + 1)]


def choose_exceptions(rows: Iterable[tuple[str, int, int]], n_toxic: int, n_clean: int) -> tuple[str, ...]:
    """Phrases around entries that speak for a clean document, from (phrase, toxic documents, clean documents)."""
    odds = lambda toxic, clean: np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return tuple(sorted(p for p, toxic, clean in rows if clean >= LEAST_DOCS and odds(toxic, clean) < 0))


def choose_entries(rows: Iterable[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of entries from (entry, toxic documents, clean documents); an entry that a shorter one covers as well is left out."""
    kept: dict[str, float] = {}
    for term, toxic, clean in sorted(rows, key=lambda r: (len(r[0].rstrip()), len(r[0]), r[0])):
        weight = float(np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1)))
        covered = max((kept.get(term[:n], 0.0) for n in range(2, len(term))), default=0.0)
        if toxic >= LEAST_SHARE * n_toxic and weight >= LEAST_WEIGHT and weight > covered + 1.0:
            kept[term] = weight
    return kept


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, with a ridge on all but the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[penalty] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 1) -> Lexicon:
    """Learn from about `sample` labelled documents of each class that are not held out.

    A doc_id labelled more than once is toxic if any of its labels is, and of its
    texts the first in order counts. Labels
    that are null are left out; with only one class present, or none, the
    lexicon is empty. What a text is exempt for is learned as well: phrases of
    an entry and a neighbouring word that speak for clean documents. What goes to
    the driver comes from the sample alone, so the sample bounds it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marked = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen, sizes = bounded_sample(marked, "doc_id", "toxic", sample, seed)
    if len(sizes) < 2:
        return Lexicon({}, coefficients=(-30.0 if 1 not in sizes else 30.0, 0.0, 0.0))
    # The sample's ids are bounded by its size, whatever the input's; its texts are read three times.
    sampled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = settle(sampled.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))  # however often an id stands

    def count(find: Callable[[str], set[str]], keep: Column) -> dict[str, tuple[int, int]]:
        """For each thing to keep that is found in folded texts, toxic and clean documents with it; for the empty text all of them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = (Counter(), Counter())
            for b in batches:
                for t, y in zip(strings(b.column(0)), b.column(1).to_pylist()):
                    seen[y].update(find(fold(t)) | {""})
            terms = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([s[t] for t in terms], pa.int64()) for s in seen[::-1])], names=["term", "toxic", "clean"]
            )

        summed = texts.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        return {r["term"]: (r["toxic"], r["clean"]) for r in summed.filter((F.col("term") == "") | keep).collect()}

    found = count(features, (F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") > 10 * F.col("clean") * min(1.0, sizes[1] / sizes[0])))
    if "" not in found:
        return Lexicon({}, coefficients=(-30.0, 0.0, 0.0))
    n_toxic, n_clean = found.pop("")
    entries = choose_entries([(t, a, c) for t, (a, c) in found.items()], n_toxic, n_clean)
    bare = Lexicon(entries)
    around = count(lambda folded: {p for at in bare.hits(folded) for p in phrases(folded, at)}, F.col("clean") >= LEAST_DOCS) if entries else {}
    around.pop("", None)
    lexicon = Lexicon(entries, choose_exceptions([(t, a, c) for t, (a, c) in around.items()], n_toxic, n_clean))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, _, words = lexicon.raw(strings(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(words, pa.int64()), b.column(1)], names=["raw", "words", "toxic"])

    seen = texts.mapInArrow(measure, "raw double, words long, toxic int").toPandas()
    y = seen["toxic"].to_numpy(float)
    w = logistic(design(seen["raw"].to_numpy(), seen["words"].to_numpy()), y)
    share = lambda p: np.log(p / (1 - p))
    w[0] += share((sizes[1] + 1) / (sizes[0] + sizes[1] + 2)) - share((y.sum() + 1) / (len(y) + 2))  # the classes' true shares
    return Lexicon(lexicon.weights, lexicon.exceptions, tuple(map(float, w)))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Add `tox_raw`, `tox_hits`, `tox_words` and `tox_score` (0 to 1) to each row, from its whole text.

    A null or empty text has no hit and gets the score of a text without words.
    Where several entries start at one word the heaviest counts, once; of equally
    heavy ones it does not matter which. A text's cost grows with its length. Rows,
    repeated ones too, and other columns are kept; columns of the four names are
    replaced; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("tox_raw", "tox_hits", "tox_words", "tox_score")
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, hits, words = sent.value.raw(strings(b.column(names.index("text"))))
            made = [pa.array(raw), pa.array(hits, pa.int64()), pa.array(words, pa.int64()), pa.array(sent.value.score(raw, words))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*names, "tox_raw", "tox_hits", "tox_words", "tox_score"])

    added = [("tox_raw", T.DoubleType()), ("tox_hits", T.LongType()), ("tox_words", T.LongType()), ("tox_score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(*x) for x in added)]))
