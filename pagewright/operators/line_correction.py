"""Correcting recognised lines one by one by aligning their tokens with a transcription."""

from __future__ import annotations

from difflib import Match, SequenceMatcher
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.align import once
from ..functions.batches import small_batches
from ..functions.text import rebuild_line, tokens
from ..sources.checkpoints import settle
from .anchors import anchors, spans
from .blocks import matching_blocks
from .fuzzy import closest_in_groups, top

#: Tokens of a line, times those it is compared with, up to which difflib finds the blocks itself; its time for long lines grows with the square, again for each block.
SHORT = 64 * 64
OPCODES = "ratio double, ops array<struct<tag: string, o: array<string>, m: array<string>>>"


def align_tokens(ours: Column, theirs: Column, junk: bool = True) -> Column:
    """Struct of the two token lists' similarity (twice the matched share) and their edits, by the longest matching blocks.

    junk: from 200 tokens on, tokens that make up over a hundredth of `theirs`
    anchor no block. This is how the matching is defined for a line against a whole text, so it is kept there.
    """

    @F.pandas_udf(OPCODES)
    def align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        ratios, ops = [], []
        for x, y in zip(a, b):
            x, y = list(x) if x is not None else [], list(y) if y is not None else []
            found = SequenceMatcher(None, x, y, autojunk=junk)
            if not junk and len(x) * len(y) > SHORT:
                found.matching_blocks = [Match(*block) for block in (*matching_blocks(x, y), (len(x), len(y), 0))]
            ratios.append(found.ratio())
            ops.append([{"tag": t, "o": x[i:j], "m": y[k:n]} for t, i, j, k, n in found.get_opcodes()])
        return pd.DataFrame({"ratio": ratios, "ops": ops})

    return once(align)(ours, theirs)


def beside(lines: DataFrame, transcriptions: DataFrame, keys: list[str], window: int) -> DataFrame:
    """keys, line_idx, text, ours, theirs: each line's tokens and those of the transcription that stand beside it, `window` more on either side.

    A text and its transcription are aligned as a whole, by anchors, so a
    document's cost follows its length; no line meets more of the transcription than its part.
    """

    @F.arrow_udf("array<array<string>>")
    def parts(texts: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for x, theirs in zip(texts.to_pylist(), others.to_pylist()):
            cuts = list(accumulate([0, *map(len, x)]))
            found = spans(cuts[:-1], cuts[-1], anchors([w for line in x for w in line], theirs), len(theirs))
            out.append([theirs[max(i - window, 0) : j + window] for i, j in found])
        return pa.array(out, pa.list_(pa.list_(pa.string())))

    line = F.struct("line_idx", "text", tokens(F.coalesce("text", F.lit(""))).alias("ours"))
    docs = lines.select(*keys, line.alias("l")).groupBy(*keys).agg(F.sort_array(F.collect_list("l")).alias("l"))
    both = docs.join(transcriptions.select(*keys, tokens(F.coalesce("transcription", F.lit(""))).alias("theirs")), keys)
    cut = both.withColumn("p", once(parts)(F.col("l.ours"), F.col("theirs"))).select(*keys, F.explode(F.arrays_zip("l", "p")).alias("x"))
    return cut.select(*keys, "x.l.line_idx", "x.l.text", "x.l.ours", F.col("x.p").alias("theirs"))


def correct_lines(lines: DataFrame, transcriptions: DataFrame, keys: list[str], threshold: float = 0.5, window: int | None = None) -> DataFrame:
    """keys, line_idx, text, ratio, corrected.

    lines: keys, line_idx, text; transcriptions: keys, transcription. A line
    less similar to the transcription than `threshold` is left alone. Else equal
    tokens stay; of token runs of equal length each becomes `~new` where the
    transcription's dictionary gives that word for it, or `[old] ~new`; what is
    only on one side is marked `[old]` or `[[new words]]`. window: compare a line
    not with the whole transcription, to which a line of a long text is never
    similar, but with what stands beside it, and so many tokens more on either
    side; then no token is too frequent to be matched. Without it a line meets the whole text, as align_tokens tells.
    """
    small_batches(lines.sparkSession)
    if window is None:
        split = lines.withColumn("ours", tokens(F.col("text"))).join(transcriptions.withColumn("theirs", tokens(F.col("transcription"))), keys)
    else:
        split = beside(lines, transcriptions, keys, window)
    aligned = split.withColumn("a", align_tokens(F.col("ours"), F.col("theirs"), junk=window is None))
    # Written once, as both the words that are looked up and the lines are drawn from it.
    kept = settle(aligned.select(*keys, "line_idx", "text", F.col("a.ratio").alias("ratio"), "a.ops"))
    swaps = lambda op: (op["tag"] == "replace") & (F.size(op["o"]) == F.size(op["m"]))
    asked = kept.filter(F.col("ratio") >= threshold).select(*keys, F.explode(F.flatten(F.transform(F.filter("ops", swaps), lambda op: op["o"]))).alias("query")).distinct()
    terms = transcriptions.select(*keys, F.explode(tokens(F.col("transcription"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("freq"))
    # A document's own words are so few that keys of what is left after deletes would part little and outnumber them by far.
    best = top(closest_in_groups(asked, terms, keys, fixed=2), keys)
    known = best.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("query", "term"))).alias("known"))
    joined = kept.join(known, keys, "left")

    def marked(op: Column) -> Column:
        bracket = F.transform(op["o"], lambda w: F.concat(F.lit("["), w, F.lit("]")))
        run = F.array(F.concat(F.lit("[["), F.array_join(op["m"], " "), F.lit("]]")))
        pair = F.transform(
            F.arrays_zip(op["o"].alias("o"), op["m"].alias("m")),
            lambda p: F.when(F.try_element_at(F.col("known"), p["o"]) == p["m"], F.concat(F.lit("~"), p["m"])).otherwise(
                F.concat(F.lit("["), p["o"], F.lit("] ~"), p["m"])
            ),
        )
        return (
            F.when(op["tag"] == "equal", op["o"]).when(swaps(op), pair).when(op["tag"] == "delete", bracket)
            .when(op["tag"] == "insert", run).otherwise(F.concat(bracket, run))
        )

    pieces = joined.withColumn("pieces", F.flatten(F.transform("ops", marked)))
    return pieces.select(
        *keys, "line_idx", "text", "ratio", F.when(F.col("ratio") < threshold, F.col("text")).otherwise(rebuild_line(F.col("pieces"))).alias("corrected")
    )
