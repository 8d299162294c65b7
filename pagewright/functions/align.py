"""Mapping restructured text back onto the lines it came from.

Where a line ends in the new text is its old end, scaled and moved to the next
space. All ends of a text are found in one pass over it, in an Arrow function:
built-in functions look for each line's place from the text's start again, so
that a document's cost would grow with the square of its lines.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def split_index(text: Column, at: Column) -> Column:
    """0-based place of the first space at or after `at`, else the text's length."""
    found = F.call_function("locate", F.lit(" "), text, at + 1)
    return F.when(found > 0, found - 1).otherwise(F.length(text))


def running_ends(sizes: Sequence[int]) -> np.ndarray:
    """Where each part ends when the parts are joined by one character."""
    return np.cumsum(np.asarray(sizes, np.int64)) + np.arange(len(sizes))


def cut_at_spaces(text: str, sizes: Sequence[int], share: float, to_end: bool) -> list[str]:
    """Lines of a text that end at the first space at or after where lines of these sizes did, scaled by share; the last one at the text's end if so asked."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.append(np.flatnonzero(codes == 32), len(text))
    places = np.rint(share * running_ends(sizes)).astype(np.int64)
    ends = stops[np.searchsorted(stops[:-1], places)]
    starts = np.concatenate([[0], ends[:-1] + 1])
    if to_end and len(ends):
        ends[-1] = len(text)
    return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def realign_paragraph(sentences: Sequence[str], n_in: Sequence[int], n_out: Sequence[int]) -> list[str]:
    """Original lines of a paragraph from its (changed) sentences; with no length to scale by, the first line is the first word."""
    text, before = " ".join(sentences), sum(n_out) + len(n_out) - 1
    return cut_at_spaces(text, n_in, len(text) / before if before else 0.0, True)


def once(function):
    """An Arrow function that the planner leaves where it is: else a filter drawn from what follows would have it computed again."""
    return function.asNondeterministic()


def realign_document(text: Column, n_in: Column, n_out: Column) -> Column:
    """Original lines of every paragraph from its (changed) sentences; the shortest of the three ends the document.

    n_in: lengths of the original lines; n_out: lengths of the sentences before
    they were changed.
    """

    @F.arrow_udf("array<array<string>>")
    def back(t: pa.Array, i: pa.Array, o: pa.Array) -> pa.Array:
        rows = zip(t.to_pylist(), i.to_pylist(), o.to_pylist())
        made = [None if None in r else [realign_paragraph(*p) for p in zip(*r)] for r in rows]
        return pa.array(made, pa.list_(pa.list_(pa.string())))

    return once(back)(text, n_in, n_out)


def realign(sentences: Column, n_in: Column, n_out: Column) -> Column:
    """realign_document for one paragraph."""
    return realign_document(F.array(sentences), F.array(n_in), F.array(n_out))[0]


def grouped(flat: Sequence[str], sizes: Sequence[int]) -> list[list[str]]:
    """A list cut into runs of the given sizes."""
    ends = np.cumsum(np.asarray(sizes, np.int64)).tolist()
    return [list(flat[end - n : end]) for end, n in zip(ends, sizes)]


def split_page(text: Column, n_in: Column, n_out: Column) -> Column:
    """Paragraphs of original lines from a document joined to one line.

    A document that was empty before gives empty lines; more than one paragraph
    or sentence is an error.
    """
    single = (F.size(text) == 1) & (F.size(text[0]) == 1)
    page = F.when(single, text[0][0]).otherwise(F.raise_error(F.lit("a joined page has one paragraph of one sentence")).cast("string"))

    @F.arrow_udf("array<array<string>>")
    def cut(t: pa.Array, i: pa.Array, b: pa.Array) -> pa.Array:
        made = []
        for x, sizes, before in zip(t.to_pylist(), i.to_pylist(), b.to_pylist()):
            flat = [n for par in sizes or () for n in par]
            lines = cut_at_spaces(x, flat, len(x) / before, False) if x is not None and before else [""] * len(flat)
            made.append(None if x is None or sizes is None else grouped(lines, [len(par) for par in sizes]))
        return pa.array(made, pa.list_(pa.list_(pa.string())))

    return once(cut)(page, n_in, n_out[0][0])


def regroup(flat: Column, like: Column) -> Column:
    """A flat list as lists of the same sizes as those of `like`; null where either is."""

    @F.arrow_udf("array<array<string>>")
    def cut(x: pa.Array, sizes: pa.Array) -> pa.Array:
        made = [None if a is None or n is None else grouped(a, n) for a, n in zip(x.to_pylist(), sizes.to_pylist())]
        return pa.array(made, pa.list_(pa.list_(pa.string())))

    return once(cut)(flat, F.transform(like, F.size))
