"""Words, their positions, n-grams and dictionaries."""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import once
from ..functions.batches import small_batches
from ..functions.text import words
from ..functions.unions import union


def line_words(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_idx, word_idx, pos, word: every word with its place in the line and in the document (from 0).

    A document's words are numbered by a running sum over its lines, so only
    line sizes meet in one place, not words.
    """
    split = lines.select(*keys, "line_idx", words(F.col(text)).alias("found")).withColumn("n", F.size("found"))
    before = Window.partitionBy(*keys).orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = split.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    exploded = placed.select(*keys, "line_idx", "before", F.posexplode("found").alias("word_idx", "word"))
    return exploded.select(*keys, "line_idx", "word_idx", (F.col("before") + F.col("word_idx")).cast("int").alias("pos"), "word")


def document_words(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, pos, word of whole texts, without a shuffle."""
    return docs.select(*keys, F.posexplode(words(F.col(text))).alias("pos", "word"))


def ngrams(placed: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """keys, ngram, pos: each run of n words, joined by spaces, and where it starts. placed: keys, pos, word."""
    frame = Window.partitionBy(*keys).orderBy("pos").rowsBetween(0, n - 1)
    runs = placed.select(*keys, "pos", F.collect_list("word").over(frame).alias("run")).filter(F.size("run") == n)
    return runs.select(*keys, F.array_join("run", " ").alias("ngram"), "pos")


def document_ngrams(docs: DataFrame, keys: list[str], n: int = 3, text: str = "text") -> DataFrame:
    """The same from whole texts, without a shuffle."""
    split = docs.select(*keys, words(F.col(text)).alias("w")).filter(F.size("w") >= n)
    runs = split.select(*keys, "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("pos"))
    return runs.select(*keys, F.array_join(F.slice("w", F.col("pos") + 1, F.lit(n)), " ").alias("ngram"), "pos")


def ngram_index(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ngram, positions (ascending)."""
    return found.groupBy(*keys, "ngram").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def places(runs: list[str]) -> dict[str, list[int]]:
    """Where each string of a list stands, rising."""
    at: dict[str, list[int]] = {}
    for i, x in enumerate(runs):
        at.setdefault(x, []).append(i)
    return at


def indexed(split: Column, n: int) -> Column:
    """Each different run of n of a list's words and its places."""

    @F.arrow_udf("array<struct<ngram: string, positions: array<int>>>")
    def index(lists: pa.Array) -> pa.Array:
        found = [places([" ".join(r) for r in zip(*(w[i:] for i in range(n)))]) for w in lists.to_pylist()]
        sizes = lambda lists: pa.array([0, *map(len, lists)], pa.int64()).to_numpy().cumsum().astype("int32")
        at = [p for one in found for p in one.values()]
        positions = pa.ListArray.from_arrays(sizes(at), pa.array(list(chain.from_iterable(at)), pa.int32()))
        grams = pa.array(list(chain.from_iterable(found)), pa.string())
        return pa.ListArray.from_arrays(sizes(found), pa.StructArray.from_arrays([grams, positions], ["ngram", "positions"]))

    return once(index)(split)


def document_ngram_index(docs: DataFrame, keys: list[str], n: int = 3, text: str = "text") -> DataFrame:
    """ngram_index of document_ngrams, made text by text: only texts whose keys other rows have too are shuffled as n-grams."""
    small_batches(docs.sparkSession)
    several = docs.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = lambda: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    alone = docs.join(several, same(), "left_anti").select(*keys, words(F.col(text)).alias("w")).filter(F.size("w") >= n)
    found = alone.select(*keys, F.explode(indexed(F.col("w"), n)).alias("x")).select(*keys, "x.ngram", "x.positions")
    return union(found, ngram_index(document_ngrams(docs.join(several, same(), "left_semi"), keys, n, text), keys))


def shared_ngrams(docs: DataFrame, keys: list[str], ours: str, theirs: str, n: int = 3) -> DataFrame:
    """keys, pos: where two lists of a row have the same run of n words at the same place, without a shuffle."""
    words_of = lambda i: F.get(ours, F.col("pos") + i) == F.get(theirs, F.col("pos") + i)
    short = F.least(F.size(ours), F.size(theirs))
    at = docs.filter(short >= n).select(*keys, ours, theirs, F.explode(F.sequence(F.lit(0), short - n)).alias("pos"))
    same = words_of(0)
    for i in range(1, n):
        same &= words_of(i)
    return at.filter(same).select(*keys, "pos")


def dictionary(placed: DataFrame, keys: list[str], term: str = "word") -> DataFrame:
    """keys, term, freq."""
    return placed.groupBy(*keys, F.col(term).alias("term")).agg(F.count("*").alias("freq"))


def first_tokens(tokens: F.Column, k: int = 5) -> F.Column:
    """The first k of a list, for display."""
    return F.slice(tokens, 1, k)


def line_offsets(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Add `ends`, where each line ends when a document's lines are joined by one character, and `before`, where the one before it ends."""
    order = Window.partitionBy(*keys).orderBy("line_idx")
    ends = F.sum(F.length(text) + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return lines.withColumn("ends", ends).withColumn("before", F.lag("ends", 1).over(order))
