"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts go to the encoder in packs of like bytes, split at safe boundaries. A
byte-level tokenizer splits before white space, so a text is cut before every
single space there, and a pack's different pieces are encoded once: running text
repeats most of its words. Lengths of pieces are kept for later packs of a task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, strings

#: Characters above which a text is split, and bytes encoded at once.
PIECE_CHARS, PACK_BYTES = 20_000, 1 << 20
#: Pieces whose lengths a task keeps, and characters of a piece worth keeping.
KEPT, KEPT_CHARS = 1 << 19, 64

#: A place where no pre-token of a byte-level tokenizer can reach across: white space after something else. The tokenizer's white
#: space is Unicode's, which lacks four control characters that Python's has.
BOUNDARY = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f])")
#: A space after white space, or a sign that words() uses itself.
UNEVEN = re.compile(r"\s |\A |\0")


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cut a text at safe boundaries, each piece at least `size` characters long but for the last.

    A stretch without any boundary stays whole.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        found = BOUNDARY.search(text, start + size)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


def words(text: str) -> list[str]:
    """Cut a text at all its safe boundaries, but in even texts, where each space is one, at spaces alone."""
    if not text:
        return []
    return BOUNDARY.split(text) if UNEVEN.search(text) else text.replace(" ", "\0 ").split("\0")


class Counter:
    """Counts tokens with a `tokenizers` file (.json) or a `sentencepiece` file (.model)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[str, int] = {}
        if path.endswith(".json"):
            import json

            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            with open(path, encoding="utf-8") as f:
                made = json.load(f)
            pre = made.get("pre_tokenizer") or {}
            self.splits = (
                made.get("normalizer") is None
                and pre.get("type") == "ByteLevel"
                and pre.get("use_regex", True)
                and not pre.get("add_prefix_space", True)
                and not any(
                    re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word")
                    for t in made.get("added_tokens", [])
                )
            )
            self.lengths = self._json
        else:
            import sentencepiece

            self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.splits = False
            self.lengths = self._model

    def _json(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.processor.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; packs of texts of like bytes go to the encoder together."""
        return self._by_word(texts) if self.splits else self._whole(texts)

    def _by_word(self, texts: list[str]) -> np.ndarray:
        out, pack, size = [], [], 0
        for t in texts:
            cut = words(t)
            pack.append(cut)
            size += len(t)
            if size >= PACK_BYTES:
                out += self._sums(pack)
                pack, size = [], 0
        return np.array(out + self._sums(pack), np.int64)

    def _sums(self, pack: list[list[str]]) -> list[int]:
        """Tokens of texts that are cut into pieces, each different piece encoded once."""
        if len(self.known) > KEPT:
            self.known.clear()
        new = list(set().union(*pack).difference(self.known))
        at = 0
        while at < len(new):  # pieces of a pack may be longer than the pack's share
            end, size = at, 0
            while end < len(new) and size < PACK_BYTES:
                size += len(new[end])
                end += 1
            self.known.update(zip(new[at:end], self._lengths_of(new[at:end])))
            at = end
        get = self.known.__getitem__
        sums = [sum(map(get, cut)) for cut in pack]
        for x in new:
            if len(x) > KEPT_CHARS:
                del self.known[x]
        return sums

    def _lengths_of(self, found: list[str]) -> list[int]:
        """Tokens of pieces; those too long for one call are cut again."""
        if max(map(len, found)) <= PIECE_CHARS:
            return self.lengths(found)
        return [sum(self.lengths(pieces(x))) for x in found]

    def _whole(self, texts: list[str]) -> np.ndarray:
        got, pack, size = [], [], 0
        for t in texts:
            pack.append(t)
            size += len(t.encode("utf-8", "surrogatepass"))
            if size >= PACK_BYTES:
                got += self.lengths(pack)
                pack, size = [], 0
        return np.array(got + (self.lengths(pack) if pack else []), np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: a tokenizer file that every executor has. No token is added at the
    ends; special strings in a text follow the library's default. A null text
    counts as empty: no bytes, no tokens. Repeated rows each get a row; other
    columns are ignored; no rows give no rows. A text too long for one call is
    encoded piece by piece, cut only where the count cannot change.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            n = counter.counts(strings(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(key, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return narrow.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
