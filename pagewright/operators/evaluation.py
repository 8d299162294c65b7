"""Scoring recognised text against ground truth: error rates and differences.

Characters are grapheme clusters of the composed text (NFC): a letter and its
accents, or an emoji of several code points, is one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.align import once
from ..functions.batches import small_batches
from ..functions.text import basename, evaluation_text, let
from .alignment import distance, edits_of_pairs
from .distances import WORD_BITS, osa

#: First code point that stands for a word. The surrogates are left out; the last code point bounds the distinct words of one pair.
FIRST, SURROGATES, MOST_WORDS = 0x4E00, range(0xD800, 0xE000), 0x110000 - 0x4E00 - 0x800
#: Edit distances are sought within a narrow band first, and within a wider one where it is not enough.
#: Characters of lines from which on their distance is not sought in bands.
LONG = 200
BANDS = (16, 64, 256, 1024, 4096)
#: Without these no code point is joined with another one: combining marks and all scripts that need them stand beyond.
JOINING = "\r\n|[^\\x{0}-\\x{2FF}]"
#: Letters and digits of a text without such code points, where all tables of characters agree.
PLAIN_WORD = re.compile(r"[^\W_]+")
MAY_JOIN = re.compile("\r\n|[^\0-\u02ff]")
#: Numbers of characters of several code points begin beyond all code points.
BEYOND = 0x110000
#: Lines a Python worker gets at once to align them, and characters of both sides that are aligned together.
ALIGNED_ROWS, PART_CHARS = 4096, 1 << 21
CLUSTER, WORD = regex.compile(r"\X"), regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")


def pair_by_name(ocr: DataFrame, gt: DataFrame) -> DataFrame:
    """pair, gt, ocr, gt_name, ocr_name of files with the same base name; a ground truth named as its partner is marked (orig).

    ocr and gt: path, text.
    """
    ours = ocr.select(basename(F.col("path")).alias("ocr_name"), F.col("text").alias("ocr"))
    theirs = gt.select(basename(F.col("path")).alias("name"), F.col("text").alias("gt"))
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    joined = ours.join(theirs, stem("ocr_name") == stem("name"))
    orig = F.concat(stem("name"), F.lit(" (orig)"), F.regexp_extract("name", r"(\.[^.]*)$", 1))
    name = F.when(F.col("name") == F.col("ocr_name"), orig).otherwise(F.col("name"))
    return joined.select(stem("name").alias("pair"), "gt", "ocr", name.alias("gt_name"), "ocr_name")


def code_point(number: int) -> str:
    """The character that stands for a pair's word of that number."""
    at = FIRST + number
    return chr(at if at < SURROGATES.start else at + len(SURROGATES))


def may_join(text: Column) -> Column:
    """Whether a text may have characters of several code points; the others need no look at them."""
    return F.coalesce(text.rlike(JOINING), F.lit(False))


def characters(text: str) -> list[str]:
    """Grapheme clusters of the composed text."""
    return list(text) if text.isascii() and "\r\n" not in text else CLUSTER.findall(unicodedata.normalize("NFC", text))


def words_of(text: str) -> list[str]:
    """Runs of letters and digits of the composed text, with the marks that none composes with."""
    return WORD.findall(unicodedata.normalize("NFC", text))


def in_codes(ours: list[str], theirs: list[str]) -> tuple[str, str]:
    """Two lists as texts of one character per element, the same for the same element."""
    known: dict[str, int] = {}
    for x in (*ours, *theirs):
        known.setdefault(x, len(known))
    if len(known) > MOST_WORDS:
        raise ValueError("too many distinct words in one pair")
    return "".join(code_point(known[x]) for x in ours), "".join(code_point(known[x]) for x in theirs)


CODED = pa.struct([("ours", pa.string()), ("theirs", pa.string())])


def word_codes(ours: Column, theirs: Column) -> Column:
    """Two lists of words as texts of one character per word, the same character for the same word; null where a list is.

    A dictionary of the pair's words makes this linear, where looking words up
    in an array column is not. More than MOST_WORDS (a million) distinct words
    in one pair are an error.
    """

    @F.arrow_udf("struct<ours: string, theirs: string>")
    def code(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist())
        return pa.array([None if x is None or y is None else dict(zip(("ours", "theirs"), in_codes(x, y))) for x, y in pairs], CODED)

    return code(ours, theirs)


def pair_codes(ours: Column, theirs: Column) -> Column:
    """Characters (`c`) and words (`w`) of two texts as word_codes has words; null where a text is."""

    @F.arrow_udf("struct<c: struct<ours: string, theirs: string>, w: struct<ours: string, theirs: string>>")
    def code(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            known = x is not None and y is not None
            out.append({k: dict(zip(("ours", "theirs"), in_codes(cut(x), cut(y)))) for k, cut in (("c", characters), ("w", words_of))} if known else None)
        return pa.array(out, pa.struct([("c", CODED), ("w", CODED)]))

    return code(ours, theirs)


def sequence_distances(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """Edit distances of pairs of lists; those of short lists all at once."""
    out = np.zeros(len(pairs), np.int32)
    short: list[tuple[int, str, str]] = []
    for k, (x, y) in enumerate(pairs):
        start, n, m = 0, len(x), len(y)
        while start < min(n, m) and x[start] == y[start]:
            start += 1
        while min(n, m) > start and x[n - 1] == y[m - 1]:
            n, m = n - 1, m - 1
        if min(n, m) == start:
            out[k] = max(n, m) - start
        elif min(n, m) - start <= WORD_BITS and len(pairs) > 1:
            short.append((k, *in_codes(x[start:n], y[start:m])))
        else:
            out[k] = distance(x[start:n], y[start:m])
    if short:
        at, a, b = zip(*short)
        out[list(at)] = osa(list(a), list(b), False)
    return out


def word_scores(gt: Column, ocr: Column) -> Column:
    """n_words of a text and its word_errors against another, both without code points that may join; a null second text is equal to the first."""

    @F.arrow_udf("struct<n_words: int, word_errors: int>")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        ours = [None if x is None else PLAIN_WORD.findall(x) for x in a.to_pylist()]
        unequal = [(k, PLAIN_WORD.findall(y)) for k, y in enumerate(b.to_pylist()) if y is not None and ours[k] is not None]
        errors = np.zeros(len(ours), np.int32)
        errors[[k for k, _ in unequal]] = sequence_distances([(ours[k], y) for k, y in unequal])
        sizes = pa.array([0 if x is None else len(x) for x in ours], pa.int32())
        return pa.StructArray.from_arrays([sizes, pa.array(errors)], ["n_words", "word_errors"])

    return once(score)(gt, ocr)


def long_distance(a: Column, b: Column) -> Column:
    """Edit distance of two long texts in words of bits, a character of one against all of the other at once; null where either is."""

    @F.arrow_udf("int")
    def count(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if s is None or t is None else int(sequence_distances([(s, t)])[0]) for s, t in zip(x.to_pylist(), y.to_pylist())], pa.int32())

    return once(count)(a, b)


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance whose cost grows with the distance, not with the square of the length."""

    def within(bands: tuple[int, ...]) -> Column:
        if not bands:
            return F.levenshtein(a, b)
        # Bound by let: in a plain case expression every band would be computed for every row.
        return let(F.levenshtein(a, b, bands[0]), lambda d: F.when(d >= 0, d).otherwise(within(bands[1:])))

    return within(BANDS)


def line_errors(pairs: DataFrame) -> DataFrame:
    """Add char_errors, n_chars, word_errors and n_words of each pair of lines (gt, ocr), after normalising; null counts as empty.

    Only lines that may have characters of several code points leave the JVM for
    them; words are counted and compared in one Arrow function, a batch of lines at once.
    """
    small_batches(pairs.sparkSession)
    text = lambda c: evaluation_text(F.coalesce(F.col(c), F.lit("")))
    prepared = pairs.withColumns({"_g": text("gt"), "_o": text("ocr")})
    prepared = prepared.withColumns({"_same": F.col("_g") == F.col("_o"), "_join": may_join(F.col("_g")) | may_join(F.col("_o"))})
    # Equal lines have no errors, so their words are only counted.
    plain = lambda c, more: F.when(~F.col("_join") & more, F.col(c))
    whole = lambda c: F.when(F.col("_join"), F.col(c))
    prepared = prepared.withColumns({"_c": word_scores(plain("_g", F.lit(True)), plain("_o", ~F.col("_same"))), "_p": pair_codes(whole("_g"), whole("_o"))})
    errors = lambda a, b: F.when(F.col("_same"), F.lit(0)).otherwise(let(F.array(a, b), lambda t: edit_distance(t[0], t[1])))
    either = lambda joined, plain: F.when(F.col("_join"), F.col(joined)).otherwise(plain)
    long = ~F.col("_same") & ~F.col("_join") & (F.least(F.length("_g"), F.length("_o")) > LONG)
    prepared = prepared.withColumn("_l", long_distance(F.when(long, F.col("_g")), F.when(long, F.col("_o"))))
    return prepared.withColumns(
        {
            "char_errors": F.when(long, F.col("_l")).otherwise(errors(either("_p.c.ours", F.col("_g")), either("_p.c.theirs", F.col("_o")))),
            "n_chars": F.length(either("_p.c.ours", F.col("_g"))),
            "word_errors": F.when(F.col("_join"), errors(F.col("_p.w.ours"), F.col("_p.w.theirs"))).otherwise(F.col("_c.word_errors")),
            "n_words": F.when(F.col("_join"), F.length("_p.w.ours")).otherwise(F.col("_c.n_words")),
        }
    ).drop("_g", "_o", "_c", "_p", "_l", "_same", "_join")


def error_rates(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, n_lines, n_characters, n_words, cer, wer: errors over ground-truth characters or words, of all lines together.

    lines: by, gt, ocr. With nothing in the ground truth the rate is 0 if
    nothing was recognised, else 1.
    """
    scored = line_errors(lines)
    sums = scored.groupBy(*by).agg(
        F.count("*").alias("n_lines"),
        F.sum("n_chars").alias("n_characters"),
        F.sum("n_words").alias("n_words"),
        F.sum("char_errors").alias("char_errors"),
        F.sum("word_errors").alias("word_errors"),
    )
    rate = lambda e, n: F.when(F.col(n) > 0, F.col(e) / F.nullif(F.col(n), F.lit(0))).otherwise((F.col(e) > 0).cast("double"))
    return sums.select(*by, "n_lines", "n_characters", "n_words", rate("char_errors", "n_characters").alias("cer"), rate("word_errors", "n_words").alias("wer"))


def text_error_rates(pairs: DataFrame, by: list[str]) -> DataFrame:
    """error_rates of whole texts whose lines stand side by side; line ends count as characters of the ground truth.

    pairs: by, gt, ocr, both of any number of lines.
    """
    lines = pairs.select(*by, F.posexplode(F.arrays_zip(F.split("gt", "\n").alias("g"), F.split("ocr", "\n").alias("o"))).alias("line_idx", "l"))
    rates = error_rates(lines.select(*by, "line_idx", F.col("l.g").alias("gt"), F.col("l.o").alias("ocr")), by)
    ends = pairs.groupBy(*by).agg(F.sum(F.size(F.split("gt", "\n")) - 1).alias("ends"))
    joined = rates.join(ends, by)
    size = F.col("n_characters") + F.col("ends")
    cer = F.when(F.col("n_characters") == 0, F.col("cer")).otherwise(F.col("cer") * F.col("n_characters") / F.nullif(size, F.lit(0)))
    return joined.select(*by, "n_lines", size.alias("n_characters"), "n_words", cer.alias("cer"), "wer")


class Elements:
    """Characters or words of many texts as whole numbers, the same number for the same one."""

    def __init__(self, words: bool) -> None:
        self.words, self.known = words, defaultdict(count().__next__)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts, one text after the other, and how many each has."""
        whole, known = "".join(texts), self.known
        plain = not MAY_JOIN.search(whole)
        if plain and not self.words:
            return np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))
        if self.words:
            parts = [PLAIN_WORD.findall(x) if plain or not MAY_JOIN.search(x) else words_of(x) for x in texts]
        else:
            parts = [characters(x) if MAY_JOIN.search(x) else x for x in texts]
        number = known.__getitem__ if self.words else lambda x: ord(x) if len(x) == 1 else BEYOND + known[x]
        return np.fromiter(map(number, chain.from_iterable(parts)), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts))

    def named(self, codes: np.ndarray) -> pa.Array:
        """The characters or words of the numbers; the empty text for -1."""
        different, places = np.unique(codes, return_inverse=True)
        names, first = list(self.known), 0 if self.words else BEYOND
        return pa.array(["" if c < 0 else chr(c) if c < first else names[c - first] for c in different.tolist()], pa.string()).take(pa.array(places))


def aligned(gt: list[str | None], ocr: list[str | None], words: bool) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
    """By parts of the texts: how many differences each pair has, and what stands against what in them; null counts as empty."""
    ours, theirs = ([(x or "").replace("\u2019", "'") for x in side] for side in (gt, ocr))
    ends = np.cumsum([len(x) + len(y) for x, y in zip(ours, theirs)])
    at = 0
    while at < len(ours):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_CHARS, side="right")))
        elements = Elements(words)
        (x, nx), (y, ny) = elements.codes(ours[at:end]), elements.codes(theirs[at:end])
        pair, i, j = edits_of_pairs(x, nx, y, ny)
        chosen = lambda codes, sizes, k: np.where(k < 0, -1, np.append(codes, 0)[np.where(k < 0, -1, (np.cumsum(sizes) - sizes)[pair] + k)].astype(np.int64))  # noqa: B023, E731
        yield np.bincount(pair, minlength=end - at), elements.named(chosen(x, nx, i)), elements.named(chosen(y, ny, j))
        at = end


def differences(pairs: DataFrame, by: list[str], words: bool = False) -> DataFrame:
    """by, gt, ocr, n: what stands for what, character by character or word by word, and how often; empty where one side lacks it.

    pairs: by, gt, ocr (lines); null counts as empty. Each pair of lines is
    aligned by the fewest edits, however long it is, so that as many differences
    are counted as line_errors counts errors.
    """
    small_batches(pairs.sparkSession, ALIGNED_ROWS)

    @F.arrow_udf("array<struct<gt: string, ocr: string>>")
    def found_in(a: pa.Array, b: pa.Array) -> pa.Array:
        counts, ours, theirs = zip(*aligned(a.to_pylist(), b.to_pylist(), words)) if len(a) else ([], [], [])
        ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate([*counts, []]))]).astype(np.int32))
        sides = [pa.concat_arrays([pa.array([], pa.string()), *side]) for side in (ours, theirs)]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(sides, ["gt", "ocr"]))

    # Equal lines are not filtered out before, as the filter would have both texts made a second time; they have no differences.
    found = pairs.select(*by, F.explode(found_in("gt", "ocr")).alias("d"))
    return found.groupBy(*by, F.col("d.gt").alias("gt"), F.col("d.ocr").alias("ocr")).agg(F.count("*").alias("n"))


def difference_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, characters, words: how many differences `differences` finds of each kind; null where none of a kind, and no row where none at all.

    Both kinds are counted in one pass over the lines.
    """
    small_batches(pairs.sparkSession, ALIGNED_ROWS)

    @F.arrow_udf("struct<characters: int, words: int>")
    def found_in(a: pa.Array, b: pa.Array) -> pa.Array:
        sides = a.to_pylist(), b.to_pylist()
        counts = [np.concatenate([c for c, _, _ in aligned(*sides, words)] or [np.zeros(0)]) for words in (False, True)]
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in counts], ["characters", "words"])

    sums = pairs.select(*by, once(found_in)("gt", "ocr").alias("c")).groupBy(*by).agg(F.sum("c.characters").alias("characters"), F.sum("c.words").alias("words"))
    some = lambda c: F.nullif(F.col(c), F.lit(0)).alias(c)
    return sums.filter("characters > 0 OR words > 0").select(*by, some("characters"), some("words"))


def difference_map(found: DataFrame, by: list[str]) -> DataFrame:
    """by, differences: `gt :: ocr` to its count."""
    entry = F.struct(F.concat_ws(" :: ", "gt", "ocr"), "n")
    return found.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("differences"))
