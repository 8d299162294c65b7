"""Column functions on document text: lines, paragraphs, words, sentences and their lengths.

A document's text is ARRAY<ARRAY<STRING>>: paragraphs of lines. White space is
Unicode white space throughout, and lengths count code points.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: A word with apostrophe, at sign or ampersand inside, or one other sign.
TOKEN = r"(?U)\w+(?:['@&]\w+)*|[^\w\s]"
SENTENCE_END = r"""(?U)(?<=[.!?]["')]?)\s+(?=["'(]?\p{Lu})"""
HYPHEN = r"(?U)(\p{L})-\n(\p{Ll})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def split_lines(text: Column) -> Column:
    """Lines of a text; a line end at the very end starts no further line, and an empty text has none."""
    parts = F.split(text, LINE_END)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def text_lines(text: Column, strip_spaces: bool = True, drop_empty: bool = True) -> Column:
    """Lines of a plain text, stripped and without the empty ones if so asked."""
    lines = split_lines(text)
    if strip_spaces:
        lines = F.transform(lines, strip)
    return F.filter(lines, lambda x: x != "") if drop_empty else lines


def paragraphs(text: Column) -> Column:
    """Paragraphs of stripped lines. A blank line closes a paragraph, an empty one too; the last counts if it has lines."""

    def cut(lines: Column) -> Column:
        blank = F.filter(F.transform(lines, lambda x, i: F.when(x == "", i + 1)), lambda i: i.isNotNull())
        ends = F.concat(F.array(F.lit(0)), blank, F.array(F.size(lines) + 1))
        found = let(
            ends,
            lambda e: F.transform(
                F.sequence(F.lit(0), F.size(e) - 2), lambda k: F.slice(lines, e[k] + 1, e[k + 1] - e[k] - 1)
            ),
        )
        return let(found, lambda p: F.when(F.size(F.element_at(p, -1)) == 0, F.slice(p, 1, F.size(p) - 1)).otherwise(p))

    return let(F.transform(split_lines(text), strip), cut)


def render(text: Column) -> Column:
    """Lines joined by a line end, paragraphs by an empty line, and a line end after the last."""
    return F.concat(F.array_join(F.transform(text, lambda p: F.array_join(p, "\n")), "\n\n"), F.lit("\n"))


def flat_text(text: Column) -> Column:
    """As render, without the line end after the last line."""
    return F.array_join(F.transform(text, lambda p: F.array_join(p, "\n")), "\n\n")


def lengths(lines: Column) -> Column:
    return F.transform(lines, F.length)


def line_lengths(text: Column) -> Column:
    """Length of each line of each paragraph."""
    return F.transform(text, lengths)


def joined_length(sizes: Column) -> Column:
    """Length of parts of the given sizes when joined by one character: one less than nothing for no parts."""
    return F.aggregate(sizes, F.lit(0), lambda a, x: a + x) + F.size(sizes) - 1


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Words with inner apostrophes, at signs and ampersands, and single other signs."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def dehyphenate(lines: Column) -> Column:
    """Lines of a paragraph; one that ends in a letter and a hyphen is joined with a next one that starts in lower case."""
    return F.split(F.regexp_replace(F.array_join(lines, "\n"), HYPHEN, "$1$2"), "\n")


def join_lines(lines: Column) -> Column:
    """A paragraph's lines as one."""
    return F.array(F.array_join(lines, " "))


def split_sentences(lines: Column) -> Column:
    """Sentences of a paragraph's lines: an end mark, white space and a capital part them."""
    return F.flatten(F.transform(lines, lambda x: F.filter(F.split(x, SENTENCE_END), lambda s: s != "")))


def segment(lines: Column) -> Column:
    """A paragraph dehyphenated, joined and split into sentences."""
    return split_sentences(join_lines(dehyphenate(lines)))


def join_page(text: Column) -> Column:
    """A whole document as one paragraph of one line."""
    return F.array(F.array(F.array_join(F.flatten(text), " ")))


def trim_page(text: Column) -> Column:
    """Element text without outer white space; null where there is none."""
    return F.nullif(strip(text), F.lit(""))


def rebuild_line(tokens_: Column) -> Column:
    """Tokens joined by spaces, none before a punctuation mark unless a bracketed token stands before it."""
    marks = F.array(*map(F.lit, string.punctuation))

    def built(found: Column) -> Column:
        glued = lambda t, i: (i == 0) | (F.array_contains(marks, t) & ~F.get(found, i - 1).endswith("]"))
        return F.array_join(F.transform(found, lambda t, i: F.when(glued(t, i), t).otherwise(F.concat(F.lit(" "), t))), "")

    # Bound by let: each token looks at the one before it, for which the whole text would be split again.
    return let(tokens_, built)


def restore_marks(text: Column) -> Column:
    """Placeholders of joined words and line ends as what they stand for."""
    return F.replace(F.replace(text, F.lit("__SEP__"), F.lit(" ")), F.lit("__CR__"), F.lit("&#13;"))


def evaluation_text(text: Column) -> Column:
    """Text as it is scored: the typographic apostrophe is the plain one."""
    return F.translate(text, "’", "'")


def evaluation_words(text: Column) -> Column:
    """Words as they are scored: runs of letters and digits."""
    return F.regexp_extract_all(evaluation_text(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def parse_options(value: Column) -> Column:
    """Options of a comma-separated text: trimmed, in upper case, empty ones left out."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.upper(strip(x))), lambda x: x != "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or an empty text."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_kind(path: Column) -> Column:
    """txt, pdf, xml or other, by the extension."""
    ext = extension(path)
    return F.when(ext.isin(".txt", ".pdf", ".xml"), F.substring(ext, 2, 3)).otherwise("other")


def corrected_name(path: Column) -> Column:
    """Name of a corrected file: _corrected before the extension."""
    name = basename(path)
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_corrected"), F.regexp_extract(name, r"(\.[^.]*)$", 1))


def safe_name(name: Column, ext: str | Column) -> Column:
    """A member name without folders or odd characters and with the given extension."""
    base = F.regexp_replace(basename(name), r"[^A-Za-z0-9._ -]", "_")
    bare = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.concat(F.when(bare == "", "file").otherwise(bare), F.lit(ext) if isinstance(ext, str) else ext)


def content_type(path: Column) -> Column:
    """Media type of a result by its extension; null where unknown."""
    kinds = {".txt": "text/plain", ".xml": "application/xml", ".pdf": "application/pdf", ".zip": "application/zip"}
    return F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[extension(path)]
