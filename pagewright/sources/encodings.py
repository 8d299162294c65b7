"""Telling the encoding of text without a mark.

The bytes are decoded in every encoding that may be meant, and the text that
comes out is judged: by how its kinds of character follow one another and by
how often its letters occur. Both are learned from a bounded sample of texts
that are known to be right, such as the table's own. Kinds are shared by
scripts, so that lower-case Cyrillic letters follow one another as Latin ones
do, and a text read in the wrong code page has signs or capitals within words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The encodings tried, the likelier first where two give the same text.
CANDIDATES = ("windows-1252", "iso-8859-2", "windows-1251", "koi8-r", "shift_jis", "utf-16-le", "utf-16-be")
#: Texts that a model is learned from, about, and characters of each at most.
SAMPLE, SAMPLE_CHARS = 4000, 20_000
#: Kinds of character, how many characters each has about, and the kind whose neighbours it has.
KINDS = ("space", "digit", "mark", "lower", "upper", "accented", "ACCENTED", "sign", "control", "letter", "script", "SCRIPT", "kana")
SIZES = np.array([3, 10, 40, 26, 26, 120, 120, 2000, 65, 21_000, 60, 60, 170], float)
LIKE = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 3, 3, 4, 3])
SPACE, DIGIT, MARK, LOWER, UPPER, ACCENTED, ACCENTED_UPPER, SIGN, CONTROL, LETTER, SCRIPT, SCRIPT_UPPER, KANA = range(len(KINDS))
#: Log-likelihood of two letters of different scripts side by side, and of a control character.
MIXED, UNSEEN = -7.0, -14.0
#: Share of a kind's likelihood that all its characters have alike, seen or not, and how much likelier the first candidate is beforehand.
ALIKE, FIRST = 0.1, 3.0
#: How far below those learned from the steps of a right text may lie on average.
SLACK = 1.5


def kind_of(c: str) -> int:
    """The kind of a character."""
    category, code = unicodedata.category(c), ord(c)
    if c in " \n\r\t" or category in ("Zs", "Zl", "Zp"):
        return SPACE if code < 0x3001 else MARK
    if category[0] == "C":
        return CONTROL
    if code < 0x80:
        return DIGIT if c.isdigit() else LOWER if c.islower() else UPPER if c.isupper() else SIGN if category == "Sc" or c in "^`|~\\{}<>=_" else MARK
    if 0x3041 <= code <= 0x30FF:
        return KANA
    if 0xFF61 <= code <= 0xFF9F:  # half-width letters, which any high bytes would make
        return SIGN
    if category[0] == "L" and category not in ("Lm",) and c not in "ªº":
        if 0x250 > code:
            return ACCENTED_UPPER if c.isupper() else ACCENTED
        return SCRIPT_UPPER if c.isupper() else SCRIPT if c.islower() else LETTER
    return MARK if category[0] == "P" else SIGN


@cache
def kinds() -> np.ndarray:
    """The kind of each character of the basic plane."""
    return np.array([kind_of(chr(c)) if not 0xD800 <= c < 0xE000 else CONTROL for c in range(1 << 16)], np.int8)


def codes_of(text: str) -> np.ndarray:
    """Code points; those beyond the basic plane count as U+FFFF."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Log-likelihoods of a kind after another and of each character of its kind, and the mean of the former in a right text."""

    follow: np.ndarray
    occur: np.ndarray
    usual: float

    def judge(self, text: str) -> tuple[float, float]:
        """Log-likelihood of a text, and the mean of the part of it that the order of kinds has."""
        codes = codes_of(text)
        kind = kinds()[codes]
        plain = LIKE[kind]
        steps = self.follow[plain[:-1], plain[1:]]
        # Letters of different scripts do not stand side by side.
        script = np.select([kind == KANA, kind == LETTER, (kind == SCRIPT) | (kind == SCRIPT_UPPER), (kind >= LOWER) & (kind <= ACCENTED_UPPER)], [1, 1, 2, 3], 0)
        steps = np.where((script[:-1] != script[1:]) & (script[:-1] > 0) & (script[1:] > 0), MIXED, steps)
        return float(steps.sum() + self.occur[codes].sum()), float(steps.mean()) if len(steps) else self.usual

    def tell(self, data: bytes) -> tuple[str | None, float, str | None]:
        """Encoding, confidence and text of bytes.

        Encodings that give the same text are one. The confidence is the
        likeliest one's share of the likelihood of all, less for a text whose kinds
        of character follow one another much more oddly than in those learned from. An empty text is windows-1252.
        """
        if not data:
            return CANDIDATES[0], 1.0, ""
        texts: dict[str, str] = {}
        for name in CANDIDATES:
            try:
                texts.setdefault(data.decode(name), name)
            except (UnicodeDecodeError, ValueError):
                continue
        if not texts:
            return None, 0.0, None
        scored = []
        for t, name in texts.items():
            likely, steps = self.judge(t)
            scored.append((likely + FIRST * (name == CANDIDATES[0]), steps, name, t))
        best, steps, name, text = max(scored)
        share = 1 / sum(np.exp(max(x[0] - best, -700.0)) for x in scored)
        fit = min(1.0, float(np.exp(steps - self.usual + SLACK)))
        return name, float(share) * fit, text


def learn(texts: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of about `sample` texts, chosen by a hash of `key`, each up to SAMPLE_CHARS characters; the counts are summed by Spark.

    Null and empty texts teach nothing; without any text all kinds and characters are as likely.
    """
    usable = texts.select(F.substring(text, 1, SAMPLE_CHARS).alias("t"), F.xxhash64(key).alias("h")).filter(F.length("t") > 0)
    n = usable.count()
    chosen = usable.filter(F.pmod("h", F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30)))).select("t")
    width = len(KINDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chars = np.zeros(width * width, np.int64), np.zeros(1 << 16, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                codes = codes_of(t)
                kind = LIKE[kinds()[codes]]
                pairs += np.bincount(kind[:-1] * width + kind[1:], minlength=width * width)
                chars += np.bincount(codes, minlength=1 << 16)
        both = np.concatenate([pairs, chars])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[at])], names=["at", "n"])

    rows = chosen.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(width * width + (1 << 16))
    for r in rows:
        counts[r["at"]] = r["n"]
    pairs, chars = counts[: width * width].reshape(width, width) + 0.5, counts[width * width :]
    by_kind, kind = np.bincount(kinds(), chars, width), kinds()
    seen = np.where(by_kind[kind] > 0, chars / np.maximum(by_kind, 1)[kind], 1 / SIZES[kind])
    occur = np.log((1 - ALIKE) * seen + ALIKE / SIZES[kind])
    occur[kind == CONTROL] = UNSEEN
    follow = np.log(pairs / pairs.sum(axis=1, keepdims=True))
    steps = pairs - 0.5
    return Model(follow, occur, float((follow * steps).sum() / max(steps.sum(), 1)))


def tell_encoding(files: DataFrame, model: Model, content: str = "content", least: float = 0.5) -> DataFrame:
    """Add `encoding`, `confidence` and `text` (null below the least confidence) of bytes without a mark.

    Valid UTF-8 without zero bytes is UTF-8; of the rest the model tells. Null bytes columns give nulls.
    """
    sent = files.sparkSession.sparkContext.broadcast(model)
    told = pa.struct([("encoding", pa.string()), ("confidence", pa.float64()), ("text", pa.string())])

    def decided(data: bytes | None) -> dict:
        if data is None:
            return {"encoding": None, "confidence": 0.0, "text": None}
        try:
            if b"\0" not in data:
                return {"encoding": "utf-8", "confidence": 1.0, "text": data.decode("utf-8")}
        except UnicodeDecodeError:
            pass
        name, sure, text = sent.value.tell(data)
        return {"encoding": name if sure >= least else None, "confidence": sure, "text": text if sure >= least else None}

    @F.arrow_udf("struct<encoding: string, confidence: double, text: string>")
    def tell(column: pa.Array) -> pa.Array:
        return pa.array([decided(x) for x in column.to_pylist()], told)

    found = files.withColumn("_told", tell(F.col(content)))
    return found.select(*files.columns, "_told.encoding", "_told.confidence", "_told.text")


#: Letters that stand for Latin ones where a text is written anew in another script, to try the encodings of that script.
CYRILLIC = dict(zip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "абцдефгхийклмнопкрстувшхузАБЦДЕФГХИЙКЛМНОПКРСТУВШХУЗ"))
KANA_LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", "あばくでえふぐひいじけらむんおぽかりすたうぶわやよざ"))
CENTRAL = dict(zip("kvwyzKVWYZ", "łśžążŁŚŽĄŻ"))


def written_for(text: str, encoding: str) -> str:
    """A text with other letters such that the encoding has them: Cyrillic, kana or central European ones."""
    if encoding in ("windows-1251", "koi8-r"):
        return "".join(CYRILLIC.get(c, c) for c in text)
    if encoding == "shift_jis":
        return "".join(KANA_LETTERS.get(c, c) for c in text.lower())
    return "".join(CENTRAL.get(c, c) for c in text) if encoding == "iso-8859-2" else text


def encoded(texts: DataFrame, names: Sequence[str] = CANDIDATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, was, meant, content: each text written for and encoded in one of the encodings, chosen by a hash of its key; characters that it lacks are left out."""
    number = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(len(names))).cast("int")

    @F.arrow_udf("struct<meant: string, content: binary>")
    def write(t: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for x, i in zip(t.to_pylist(), n.to_pylist()):
            data = written_for(x or "", names[i]).encode(names[i], "ignore")
            out.append({"meant": data.decode(names[i]), "content": data})
        return pa.array(out, pa.struct([("meant", pa.string()), ("content", pa.binary())]))

    found = texts.select(key, number.alias("n"), F.col(text).alias("t")).withColumn("w", write(F.col("t"), F.col("n")))
    return found.select(key, F.element_at(F.array(*map(F.lit, names)), F.col("n") + 1).alias("was"), "w.meant", "w.content")
