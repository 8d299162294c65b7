"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample in Spark; the log-probability
matrix (languages x buckets, a few megabytes at most) is broadcast, and a batch
of texts is scored in numpy: the n-grams of each text are counted by bucket, and
the sparse counts are multiplied with the matrix, some languages at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, held_out, mix64, offsets, small_batches, strings

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Documents of each language that the model is fitted on, about.
SAMPLE = 4000
#: Added to each count.
SMOOTHING = 0.1
UNKNOWN = "und"
#: Characters whose n-grams are counted at once, and numbers of the products held at once.
CHUNK, CELLS = 1 << 20, 1 << 22
#: Languages whose counts a task holds between batches.
HELD = 64


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, in the texts' order, and each text's number of them.

    Texts are lower-cased and every run of other characters than letters counts
    as one space. A text has a space at both ends; without a letter it has no n-grams.
    """
    lowered = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    alpha = letters()[codes]
    codes = np.where(alpha, codes, 32).astype(np.uint64)
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    keep[offsets([len(t) for t in lowered])[:-1]] = True
    codes, owner = codes[keep], owner[keep]
    found, whose = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + m]
        whole = owner[:m] == owner[n - 1 :]
        if n == 1:
            whole &= codes[:m] != 32
        found.append((mix64(h[whole]) & np.uint64(BUCKETS - 1)).astype(np.int32))
        whose.append(owner[:m][whole])
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    buckets, whose_all = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose_all, kind="stable")
    return buckets[order], np.bincount(whose_all, minlength=len(texts))


def slices(text: str) -> list[str]:
    """A long text in parts of at most CHUNK characters, cut after a space where there is one; n-grams across a cut are lost between words only."""
    out = []
    while len(text) > CHUNK:
        cut = text.rfind(" ", 1, CHUNK) + 1 or CHUNK
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts of the n-grams of each text: rows, buckets and how often, by row."""
    found, parts, owner, size = [], [], [], 0

    def count() -> None:
        buckets, n = grams(parts)
        cells, times = np.unique(np.repeat(np.array(owner, np.int64), n) * BUCKETS + buckets, return_counts=True)
        found.append((cells, times))

    for i, t in enumerate(texts):
        for part in slices(t):
            if parts and size + len(part) > CHUNK:
                count()
                parts, owner, size = [], [], 0
            parts.append(part)
            owner.append(i)
            size += len(part)
    if parts:
        count()
    cells = np.concatenate([c for c, _ in found]) if found else np.zeros(0, np.int64)
    times = np.concatenate([t for _, t in found]) if found else np.zeros(0, np.int64)
    return cells // BUCKETS, cells % BUCKETS, times


@dataclass(frozen=True)
class Model:
    """Languages in ascending order, the log-probability matrix (bucket x language) and log priors."""

    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text: the likeliest language (`und` without a letter), its posterior, and log-likelihood per n-gram."""
        names, post, fit = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        rows, buckets, times = counted(texts)
        if not len(rows) or not self.languages:
            return names, post, fit
        n = np.bincount(rows, times, len(texts))
        has = np.flatnonzero(n)
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        whose = rows[starts]  # a long text's parts may be counted apart
        sums = np.zeros((len(texts), len(self.languages)))
        step = max(1, CELLS // len(rows))
        for a in range(0, len(self.languages), step):
            products = self.matrix[buckets, a : a + step] * times[:, None]
            np.add.at(sums, (whose, slice(a, a + step)), np.add.reduceat(products, starts, axis=0))
        total = sums[has] + self.prior
        best = total.argmax(axis=1)
        top = total[np.arange(len(has)), best]
        post[has] = 1 / np.exp(total - top[:, None]).sum(axis=1)
        fit[has] = sums[has, best] / n[has]
        for i, k in zip(has.tolist(), best.tolist()):
            names[i] = self.languages[k]
        return names, post, fit


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 9) -> Model:
    """Fit on about `sample` documents of each language among the rows that are not held out and have a lang.

    Of more than MOST_CLASSES languages the most frequent are learned, of equally
    frequent ones the first in order: this bounds the matrix. Rows with the same
    doc_id are all in the sample or none is.
    """
    small_batches(docs.sparkSession)
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    chosen, sizes = bounded_sample(usable.select("doc_id", "lang", "text"), "doc_id", "lang", sample, seed)
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, c in total.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bucket", "n"]
                )
            total.clear()

        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            rows, buckets, times = counted(strings(b.column(1)))
            for lang in set(langs):
                mine = langs[rows] == lang
                total[lang] = total.get(lang, 0) + np.bincount(buckets[mine], times[mine], BUCKETS).astype(np.int64)
            if len(total) > HELD:
                yield from told()
        yield from told()

    rows = (
        chosen.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(sizes)
    place = {x: i for i, x in enumerate(languages)}
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    counts[rows["bucket"].to_numpy(), rows["lang"].map(place).to_numpy(int)] += rows["n"].to_numpy()
    prior = np.log(np.array([sizes[x] for x in languages], float))
    return Model(languages, np.log(counts / counts.sum(axis=0)), prior - np.logaddexp.reduce(prior))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add `lang_pred`, `lang_score` (posterior, 0 to 1) and `lang_fit` (log-likelihood per n-gram) to each row.

    `lang_pred` is a learned language, or `und` with score 0 where the text is
    null or has no letter, or nothing was learned. Ties go to the language
    first in the alphabet. Rows, repeated ones too, and all other columns are
    kept; columns of the three names are replaced. Whole texts are scored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("lang_pred", "lang_score", "lang_fit")
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, post, fit = sent.value.score(strings(b.column(b.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(names, pa.string()), pa.array(post), pa.array(fit)],
                names=[*b.schema.names, "lang_pred", "lang_score", "lang_fit"],
            )

    added = [T.StructField("lang_pred", T.StringType()), *(T.StructField(x, T.DoubleType()) for x in ("lang_score", "lang_fit"))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
