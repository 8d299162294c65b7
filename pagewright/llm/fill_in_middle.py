"""Fill-in-middle transformation, with content-defined chunks and a memo of their summaries.

A text's UTF-8 bytes are cut into chunks where a rolling hash of the last bytes
says so, so that passages shared by documents give the same chunks wherever
they stand. What a chunk adds to its text is a small summary: how many code
points start in it, and whether a marker stands in it. Summaries are kept in a
memo that is keyed by the chunk's content, so a shared chunk is compared byte by
byte before its summary is taken, and only counted where it is new. Summaries
combine: sums of the counts give a text's code points and the chunk that each
cut falls into, and only that chunk is looked into; a marker across a boundary
is seen from the two bytes on either side.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The markers before prefix, suffix and middle, and the form names.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Bytes the rolling hash looks back, and of a chunk at least, on average beyond that, and at most.
WINDOW, LEAST, MEAN, MOST = 32, 256, 1024, 1 << 16
#: Bytes hashed at once.
STRETCH = 1 << 20
#: Bytes of chunks that a task's memo holds at most; the chunk not used for longest goes first.
MEMO_BYTES = 16 << 20

#: A random number for each byte.
GEAR = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the WINDOW bytes up to it: the sum of their numbers, each doubled once for every byte that follows."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text. Where they lie depends on the bytes since the last one only, never on what comes before."""
    marks = []
    for at in range(0, len(data), STRETCH):
        before = min(at, WINDOW - 1)
        h = rolling(data[at - before : at + STRETCH])[before:]
        marks += (np.flatnonzero(h >> np.uint64(32) < np.uint64((1 << 32) // MEAN)) + at + 1).tolist()
    ends, last = [], 0
    for m in [*marks, len(data)]:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST or (m == len(data) and m > last):
            ends.append(m)
            last = m
    return ends


class Summary(NamedTuple):
    """Code points that start in a chunk, and whether a marker stands in it."""

    points: int
    marked: bool


def starts(chunk: bytes) -> np.ndarray:
    """Places in a chunk where a code point starts: every byte that continues none."""
    return np.flatnonzero(np.frombuffer(chunk, np.int8) >= -64)


def marked(data: bytes) -> bool:
    return PREFIX in data or SUFFIX in data or MIDDLE in data


class Memo:
    """Summaries by content, of the chunks used last."""

    def __init__(self, most: int = MEMO_BYTES):
        self.kept: OrderedDict[bytes, Summary] = OrderedDict()
        self.size, self.most, self.hits, self.misses = 0, most, 0, 0

    def summary(self, chunk: bytes) -> Summary:
        found = self.kept.get(chunk)
        if found is not None:
            self.hits += 1
            self.kept.move_to_end(chunk)
            return found
        self.misses += 1
        found = self.kept[chunk] = Summary(int(np.count_nonzero(np.frombuffer(chunk, np.int8) >= -64)), marked(chunk))
        self.size += len(chunk)
        while self.size > self.most:
            self.size -= len(self.kept.popitem(last=False)[0])
        return found


class Layout:
    """A text as chunks: where they start, the code points before each, and whether the text has a marker."""

    def __init__(self, text: bytes, memo: Memo):
        self.text, self.begins, self.before, self.marked = text, [0], [0], False
        seam = b""
        for end in chunk_ends(np.frombuffer(text, np.uint8)):
            chunk = text[self.begins[-1] : end]
            points, has = memo.summary(chunk)
            self.marked = self.marked or has or marked(seam + chunk[:2])
            seam = (seam + chunk[-2:])[-2:]
            self.begins.append(end)
            self.before.append(self.before[-1] + points)
        self.points = self.before[-1]

    def place(self, k: int) -> int:
        """The byte behind the first k code points."""
        if k >= self.points:
            return len(self.text)
        i = int(np.searchsorted(self.before, k, "right")) - 1
        return self.begins[i] + int(starts(self.text[self.begins[i] : self.begins[i + 1]])[k - self.before[i]])


def transform(text: bytes, draws: str, memo: Memo, plain_from: int, spm_below: int) -> tuple[bytes, str, int, int | None, int | None]:
    """Output, form, code points of the text, of its prefix and of its middle. draws: four 8-digit hexadecimal numbers."""
    h1, h2, h3, h4 = (int(draws[i : i + 8], 16) for i in (0, 8, 16, 24))
    layout = Layout(text, memo)
    n = layout.points
    if not n or layout.marked or h3 % 100 >= plain_from:
        return text, PLAIN, n, None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = layout.place(low), layout.place(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), SPM, n, low, high - low
    return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), PSM, n, low, high - low


def fill_in_middle(docs: DataFrame, plain_from: int = 90, spm_below: int = 20, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, fim_n (code points), fim_form, fim_prefix and fim_middle (their code points), fim_text.

    Numbers h1 to h4 are the first four groups of eight digits of the sha256 of
    `seed:key`. A text is cut after h1 and h2 code points, each modulo one more
    than it has. It stays as it is (`plain`, fim_prefix and fim_middle null) if it is
    empty, holds a marker or h3 % 100 >= plain_from; else it becomes suffix,
    prefix, middle (`spm`) where h4 % 100 < spm_below, or prefix, suffix, middle
    (`psm`), each behind its marker. Equal cuts give an empty middle. A null text
    counts as empty, a null key as the empty one; rows that repeat a key are cut
    alike if their texts are as long. Other columns are ignored, whatever their
    names; no rows give no rows. Bytes that are no UTF-8 count as code points
    unless they continue one. A task holds one batch of texts and MEMO_BYTES of chunks.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for b in batches:
            made = [
                transform(t or b"", d, memo, plain_from, spm_below) for t, d in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist())
            ]
            out, forms, n, prefix, middle = (list(x) for x in zip(*made)) if made else ([], [], [], [], [])
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), long(n), pa.array(forms, pa.string()), long(prefix), long(middle), pa.array(out, pa.binary())],
                names=[key, "fim_n", "fim_form", "fim_prefix", "fim_middle", "fim_bytes"],
            )

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    narrow = docs.select(F.col(key).alias(key), F.col(text).alias("fim_text"), F.substring(drawn, 1, 32).alias("fim_draws"))
    done = narrow.mapInArrow(run, f"`{key}` {kind}, fim_n long, fim_form string, fim_prefix long, fim_middle long, fim_bytes binary")
    return done.select(key, "fim_n", "fim_form", "fim_prefix", "fim_middle", F.col("fim_bytes").cast("string").alias("fim_text"))


def restored(output: str = "fim_text", form: str = "fim_form") -> Column:
    """The text that an output of that form was made of, told from the two alone: no part of a text that is not plain holds a marker."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = F.col(output)
    rest, middle = F.substring_index(out, m, 1), F.substring_index(out, m, -1)
    first = lambda mark, other: F.substring(F.substring_index(rest, other, 1), 1 + len(PREFIX), 2**31 - 1)
    second = lambda other: F.substring_index(rest, other, -1)
    return (
        F.when(F.col(form) == PSM, F.concat(first(p, s), middle, second(s)))
        .when(F.col(form) == SPM, F.concat(second(p), middle, first(s, p)))
        .otherwise(out)
    )
