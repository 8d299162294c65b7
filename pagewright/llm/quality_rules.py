"""Quality by weak supervision: rules vote or abstain, expectation-maximisation
estimates how far to trust each, and a document's posterior replaces the demand
that it pass every rule.

Spark measures every document and counts the vote patterns. There are at most
3^R patterns for R rules whatever the input's size, so their counts go to the
driver, the model is fitted on them there, and each pattern's posterior is
joined back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import offsets, settle, small_batches, strings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_letters", "n_plain", "n_shouts")

#: What is believed of rules and of the share of good documents before any vote is seen, and how many documents that
#: belief is worth, whatever the input's size: it keeps the two classes from settling on any other trait.
BELIEF = {"against": {"good": 0.01, "bad": 0.25}, "for": {"good": 0.9, "bad": 0.55}, "share": 0.85}
BELIEF_DOCS = 1000.0
#: Columns that judging adds.
RESULTS = (*MEASURES, "pattern", "base_failed", "quality", "kept")


def span(name: str, part: Column, whole: Column, wide: tuple[float, float], narrow: tuple[float, float]) -> tuple[str, Column]:
    """A rule on part / whole: against outside `wide`, for inside `narrow`, else (or with nothing there) no vote."""
    share = part / F.greatest(whole, F.lit(1))
    return name, F.when(whole == 0, 0).when(~share.between(*wide), 2).when(share.between(*narrow), 1).otherwise(0)


def rules() -> list[tuple[str, Column]]:
    """Name and vote of each rule: 0 none, 1 for the document, 2 against it."""
    c = {m: F.col(m) for m in MEASURES}
    cased = c["n_upper"] + c["n_lower"]
    return [
        ("long_enough", F.when(c["n_words"] < 20, 2).when(c["n_words"] >= 50, 1).otherwise(0)),
        span("word_length", c["word_chars"], c["n_words"], (2, 14), (3, 10)),
        span("letters", c["n_letters"], c["word_chars"], (0.7, 1), (0.85, 1)),
        span("plain_words", c["n_plain"], c["n_words"], (0.6, 1), (0.85, 1)),
        span("symbols", c["n_symbols"], c["n_words"], (0, 0.1), (0, 0.02)),
        span("repeats", c["n_repeat_words"], c["n_words"], (0, 0.3), (0, 0.05)),
        span("equal_lines", c["n_dup_lines"], c["n_lines"], (0, 0.3), (0, 0)),
        span("capitals", c["n_upper"], cased, (0, 0.5), (0, 0.2)),
        span("shouts", c["n_shouts"], c["n_words"], (0, 0.3), (0, 0.05)),
    ]


def is_plain(word: str) -> bool:
    """Letters with at most some punctuation around, and not all in capitals."""
    inner = word.strip(".,;:!?\"'()")
    return inner.isalpha() and (len(inner) == 1 or not inner.isupper())


def measure_texts(texts: list[str]) -> dict[str, np.ndarray]:
    """The measures of each text; windows are compared as exact numbers, not as hashes."""
    words: list[str] = []
    n, lines_with, dup = [], [], []
    for t in texts:
        found = WORD.findall(t)
        words += found
        n.append(len(found))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        lines_with.append(len(lines))
        dup.append(len(lines) - len(set(lines)))
    starts = offsets(n)
    total = len(words)
    ids, distinct = pd.factorize(np.array(words, object)) if total else (np.zeros(0, np.int64), [])
    of_word = lambda f, kind: np.fromiter(map(f, distinct), kind, len(distinct))[ids]
    sizes, shouts, plain = of_word(len, np.int64), of_word(lambda w: w[-1] == "!", bool), of_word(is_plain, bool)
    owner = np.repeat(np.arange(len(texts)), n)
    out = {"n_words": np.diff(starts), "n_lines": np.array(lines_with, np.int64), "n_dup_lines": np.array(dup, np.int64)}
    per = lambda flags: np.bincount(owner, flags, len(texts)).astype(np.int64)
    out |= {"word_chars": per(sizes), "n_shouts": per(shouts), "n_plain": per(plain)}
    out["n_symbols"] = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    raw = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    out["n_upper"] = np.array([np.count_nonzero((b - np.uint8(65)) < 26) for b in raw], np.int64)
    out["n_lower"] = np.array([np.count_nonzero((b - np.uint8(97)) < 26) for b in raw], np.int64)
    # A byte beyond 127 that starts a character counts as a letter.
    out["n_letters"] = out["n_upper"] + out["n_lower"] + np.array([np.count_nonzero(b >= np.uint8(192)) for b in raw], np.int64)
    covered = np.zeros(total + 1, np.int64)
    if total >= WINDOW:
        ids = ids.astype(np.int64)
        step = 1
        while step < WINDOW:  # numbers of runs of 2, 4, then 8 words
            m = len(ids) - step
            ids = pd.factorize(ids[:m] * (ids.max() + 1) + ids[step:])[0].astype(np.int64)
            step *= 2
        inside = np.flatnonzero(owner[: len(ids)] == owner[WINDOW - 1 :])
        number = pd.factorize(ids[inside] * len(texts) + owner[inside])[0]
        again = inside[np.bincount(number)[number] > 1] if len(inside) else inside
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
    out["n_repeat_words"] = per(np.cumsum(covered[:total]) > 0)
    return out


def measure(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to keep, MEASURES and `pattern` (the votes as digits) of each document's whole text; null counts as empty."""
    small_batches(docs.sparkSession)
    keep = [c for c in keep if c not in RESULTS]
    chosen = docs.select("doc_id", *keep, F.col("text").alias("pattern"))
    n = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = measure_texts(strings(b.column(n)))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array(got[m], pa.int64()) for m in MEASURES]], names=[*b.schema.names[:n], *MEASURES])

    raw = chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:n], *(T.StructField(m, T.LongType()) for m in MEASURES)]))
    return raw.withColumn("pattern", F.concat(*[v.cast("string") for _, v in rules()]))


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents and, by rule, the log of how much likelier a vote against or for is among good than among bad ones."""

    good: float
    against: np.ndarray
    favour: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of being good for rows of votes; a rule that abstains says nothing."""
        log = np.log(self.good / (1 - self.good)) + (votes == 2) @ self.against + (votes == 1) @ self.favour
        return 1 / (1 + np.exp(-np.clip(log, -500, 500)))


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 300) -> VoteModel:
    """Expectation-maximisation (to the posterior mode) over vote patterns and their counts.

    A rule is held to be no worse than chance: its vote never speaks for the opposite.
    """
    strength = BELIEF_DOCS
    model, weight = None, {"good": np.zeros(len(counts)), "bad": np.zeros(len(counts))}
    for _ in range(rounds):

        def ratio(vote: int, belief: dict[str, float]) -> np.ndarray:
            rate = {k: (w @ (votes == vote) + belief[k] * strength) / (w @ (votes > 0) + strength) for k, w in weight.items()}
            return np.log(rate["good"] / rate["bad"])

        good = (weight["good"].sum() + BELIEF["share"] * strength) / (sum(w.sum() for w in weight.values()) + strength)
        new = VoteModel(float(good), np.minimum(ratio(2, BELIEF["against"]), 0), np.maximum(ratio(1, BELIEF["for"]), 0))
        if model and abs(new.good - model.good) + np.abs(new.against - model.against).sum() + np.abs(new.favour - model.favour).sum() < 1e-9:
            break
        model = new
        p = model.posterior(votes)
        weight = {"good": p * counts, "bad": (1 - p) * counts}
    return model


def judge(docs: DataFrame, threshold: float = 0.5, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, the columns to keep, MEASURES, base_failed, quality (posterior), kept.

    base_failed: n_words < 20, or over 30 in 100 words in repeated windows of
    eight. kept: not base_failed and quality >= threshold. A null text counts
    as empty and fails; documents with equal votes have equal quality; repeated
    rows each get a row; a column to keep that has the name of a result gives
    way to it; no rows give no rows. What is measured, with the columns to keep,
    is written to the shared checkpoint folder: texts are measured once.
    """
    measured = settle(measure(docs, keep))
    seen = measured.groupBy("pattern").agg(F.count("*").alias("n")).toPandas()
    names = [name for name, _ in rules()]
    votes = np.array([[int(x) for x in p] for p in seen["pattern"]], int).reshape(-1, len(names))
    quality = fit_votes(votes, seen["n"].to_numpy(float)).posterior(votes)
    found = measured.sparkSession.createDataFrame(
        [(p, float(q)) for p, q in zip(seen["pattern"], quality)], "pattern string, quality double"
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        measured.join(F.broadcast(found), "pattern")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality") >= threshold))
        .drop("pattern")
    )
