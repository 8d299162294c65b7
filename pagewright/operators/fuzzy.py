"""Fuzzy dictionary join by shared keys.

Two strings within k edits share what is left of their prefixes after at most k
deletes on either side. They also share one of any k + 1 pieces of the one, if a
character is left out between neighbouring pieces, since then no edit, an
exchange neither, touches two of them; and the shared piece has moved by at most
k places. Deletes pick out few terms where k is small, pieces where it is larger
and the string long. Where k is about half the string, nothing but the length
parts it from other terms, and lengths are the keys. So both sides are exploded
into keys and joined on them: an equi-join, distributed by key, with no pair
compared that shares none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..functions.unions import union
from ..sources.checkpoints import settle
from .distances import osa
from .nearest import closest, nearest_terms

#: Characters from which deletes are taken. With few of them a large dictionary has many terms a key, so that the pairs grow with its square.
PREFIX = 12
#: Up to this many edits deletes are used, beyond it pieces of at least and at most so many characters.
FEW_EDITS, NARROWEST, WIDEST = 2, 2, 6


def with_delete_keys(rows: DataFrame, term: str, k: str, most: int) -> DataFrame:
    """Rows once for each `key`: what is left of the term's prefix after deleting at most k (up to `most`) of its characters.

    Which characters go is a bit mask, exploded first, so that making a key is
    compiled code; a term has at most 79 keys. Equal keys of a term may repeat.
    """
    masks = [[m for m in range(1 << PREFIX) if m.bit_count() <= e] for e in range(min(most, PREFIX) + 1)]
    chosen = F.element_at(F.array(*[F.array(*[F.lit(m) for m in one]) for one in masks]), F.least(F.col(k), F.lit(len(masks) - 1)) + 1)
    headed = rows.withColumn("_head", F.substring(term, 1, PREFIX)).withColumn("_mask", F.explode(chosen))
    headed = headed.filter(F.col("_mask") < F.call_function("shiftleft", F.lit(1), F.length("_head")))
    kept = [F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) == 0, F.substring("_head", i + 1, 1)).otherwise("") for i in range(PREFIX)]
    return headed.withColumn("key", F.concat(*kept)).drop("_head", "_mask")


def osa_column(a: Column, b: Column) -> Column:
    """osa as an Arrow function; for pairs that cheaper filters have left."""

    @F.arrow_udf("int")
    def distance(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(osa(x.to_pylist(), y.to_pylist()), pa.int32())

    return distance(a, b)


def edits_allowed(length: int, share: float, most: int, fixed: int | None) -> int:
    """Edits allowed for a string: a share of its length, rounded down, and no more than `most`; or a fixed number."""
    return min(most, math.floor(length * share)) if fixed is None else fixed


def piece_width(length: int, k: int) -> int:
    """Characters in each of a string's k + 1 pieces; 0 where deletes, or lengths, serve better."""
    width = min(WIDEST, (length - k) // (k + 1))
    return width if k > FEW_EDITS and width >= NARROWEST else 0


def by_length(values: list, length: Column) -> Column:
    """values[length], and the last one for longer strings."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.least(length, F.lit(len(values) - 1)) + 1)


def keyed_sides(queries: DataFrame, terms: DataFrame, by: list[str], share: float, most: int, fixed: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides once for each `key`, with the place `at` where it stands (0 for keys that have none); queries also with `k`."""
    most = most if fixed is None else fixed
    # From this length on, edits and widths stay as they are.
    steady = (WIDEST + 1) * (most + 1) + (math.ceil(most / share) if fixed is None and share > 0 else 0)
    edits = [edits_allowed(n, share, most, fixed) for n in range(steady + 1)]
    widths = [piece_width(n, k) for n, k in enumerate(edits)]
    # For each length of a term: the queries' lengths it may be near to, their most edits by deletes, and their widths.
    meets = [[q for q, k in enumerate(edits) if abs(q - n) <= k or (q == steady and n + k >= q)] for n in range(steady + most + 1)]
    loose = [k > FEW_EDITS and not w for k, w in zip(edits, widths)]
    deletes = [max([edits[q] for q in near if not widths[q] and not loose[q]], default=-1) for near in meets]
    cut = [[w for w in sorted({widths[q] for q in near}) if w] for near in meets]

    # A hash is narrow and sorts fast; the distances tell what shares it by chance.
    tag = lambda rows, sign: rows.withColumn("key", F.xxhash64(*by, F.lit(sign), F.col("key")))
    q = queries.withColumn("k", by_length(edits, F.length("query"))).withColumn("_width", by_length(widths, F.length("query")))
    few = q.filter((F.col("_width") == 0) & (F.col("k") <= FEW_EDITS)).drop("_width")
    left = [tag(with_delete_keys(few, "query", "k", FEW_EDITS).withColumn("at", F.lit(0)), "-")]
    step = F.floor((F.length("query") - F.col("k")) / (F.col("k") + 1)).cast("int") + 1
    pieces = q.filter("_width > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("at", F.col("at") * step)
    pieces = pieces.withColumn("key", F.substring("query", F.col("at") + 1, F.col("_width"))).drop("_width")

    t = terms.withColumn("_k", by_length(deletes, F.length("term")))
    right = [tag(with_delete_keys(t.filter("_k >= 0"), "term", "_k", FEW_EDITS).drop("_k").withColumn("at", F.lit(0)), "-")]
    if any(widths):
        cuts = by_length([F.array(*[F.lit(w) for w in c]).cast("array<int>") for c in cut], F.length("term"))
        grams = terms.withColumn("_width", F.explode(cuts)).filter(F.length("term") >= F.col("_width"))
        grams = grams.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("term") - F.col("_width"))))
        left.append(tag(pieces, "+"))
        right.append(tag(grams.withColumn("key", F.substring("term", F.col("at") + 1, F.col("_width"))).drop("_width"), "+"))
    if any(loose):
        wide = q.filter((F.col("_width") == 0) & (F.col("k") > FEW_EDITS)).drop("_width").withColumn("at", F.lit(0))
        left.append(tag(wide.withColumn("key", F.explode(F.sequence(F.length("query") - F.col("k"), F.length("query") + F.col("k")))), "="))
        right.append(tag(terms.withColumn("at", F.lit(0)).withColumn("key", F.length("term")), "="))
    return union(*left), union(*right)


def fuzzy_join(
    queries: DataFrame,
    terms: DataFrame,
    by: list[str],
    share: float = 0.2,
    most: int = 6,
    fixed: int | None = None,
    swaps: bool = True,
) -> DataFrame:
    """by, query, term, freq, distance: all terms within the edits a query is allowed.

    queries: by, query; terms: by, term, freq; both are made distinct first.
    fixed: the same number of edits for every query, in place of a share of its
    length. swaps: exchanging two neighbours is one edit. A string that its
    deletes may use up (no longer than its edits allow) also has the empty key,
    so it is not lost. An empty string is a term like others; null ones are
    near to nothing.
    """
    q = queries.select(*by, "query").distinct()
    t = terms.select(*by, "term", "freq").dropDuplicates([*by, "term"])
    left, right = keyed_sides(q, t, by, share, most, fixed)
    moved = F.abs(F.col("at") - F.col("term_at")) <= F.col("k")
    # Distances come before pairs met by several keys are made one, so that far pairs are not shuffled. An exchange is two plain edits.
    each = 2 if swaps else 1
    pairs = (
        left.join(right.withColumnRenamed("at", "term_at"), ["key", *by])
        .filter(moved & (F.abs(F.length("query") - F.length("term")) <= F.col("k")))
        .withColumn("plain", F.levenshtein("query", "term", each * (most if fixed is None else fixed)))
        .filter((F.col("plain") >= 0) & (F.col("plain") <= each * F.col("k")))
        .select(*by, "query", "term", "freq", "k", "plain").distinct()
    )
    distance = F.when(F.col("plain") <= 1, F.col("plain")).otherwise(osa_column(F.col("query"), F.col("term"))) if swaps else F.col("plain")
    return pairs.withColumn("distance", distance).filter(F.col("distance") <= F.col("k")).select(*by, "query", "term", "freq", "distance")


def nearest_but_equal(queries: DataFrame, terms: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What terms themselves find, and the other queries and all terms, distinct: both are read several times, and are far smaller than the words they come from."""
    t = settle(terms.select(*by, "term", "freq").dropDuplicates([*by, "term"]))
    q = settle(queries.select(*by, "query").distinct())
    same = t.select(*by, F.col("term").alias("query"), "term", "freq", F.lit(0).alias("distance"))
    exact = q.join(same, [*by, "query"]).select(*by, "query", "term", "freq", "distance")
    return exact, settle(q.join(same.select(*by, "query"), [*by, "query"], "left_anti")), t


def closest_terms(queries: DataFrame, terms: DataFrame, by: list[str], share: float = 0.2, most: int = 6, swaps: bool = True) -> DataFrame:
    """closest(fuzzy_join(...)): a query that is itself a term has no nearer one, so only the others are looked for.

    Queries whose edits are about half their length meet all terms of like length, by the join on lengths.
    """
    exact, lost, t = nearest_but_equal(queries, terms, by)
    edits = [edits_allowed(n, share, most, None) for n in range((WIDEST + 1) * (most + 1) + (math.ceil(most / share) if share > 0 else 0) + 1)]
    widths = [piece_width(n, k) for n, k in enumerate(edits)]
    loose = [k > FEW_EDITS and not w for k, w in zip(edits, widths)]
    found = union(exact, nearest_terms(lost, t, by, [-1 if x else k for x, k in zip(loose, edits)], widths, swaps))
    if not any(loose):
        return found
    return union(found, closest(fuzzy_join(lost.filter(by_length(loose, F.length("query"))), t, by, share, most, swaps=swaps), by))


def closest_within(queries: DataFrame, terms: DataFrame, by: list[str], edits: int, swaps: bool = True) -> DataFrame:
    """closest(fuzzy_join(...)) for a fixed number of edits: more edits are tried only for queries that fewer leave without a term, none for terms."""
    exact, lost, t = nearest_but_equal(queries, terms, by)
    if edits <= FEW_EDITS:
        return union(exact, nearest_terms(lost, t, by, [edits], [0], swaps))
    found = [exact]
    for k in range(1, edits + 1):
        found.append(settle(closest(fuzzy_join(lost, t, by, fixed=k, swaps=swaps), by)))
        lost = lost.join(found[-1].select(*by, "query").distinct(), [*by, "query"], "left_anti")
    return union(*found)


def closest_by_share(queries: DataFrame, terms: DataFrame, by: list[str], share: float, most: int, swaps: bool = True) -> DataFrame:
    """closest(fuzzy_join(...)) where many edits are allowed: what few edits find is looked up by deletes first, and only the rest by what parts little.

    The nearest term of a query that has one within FEW_EDITS is among those, so
    the result is the same; but most queries take no part in the join by pieces and lengths.
    """
    t = terms.select(*by, "term", "freq").dropDuplicates([*by, "term"])
    q = queries.select(*by, "query").distinct()
    if most <= FEW_EDITS:
        return closest(fuzzy_join(q, t, by, share, most, swaps=swaps), by)
    near = settle(closest(fuzzy_join(q, t, by, share, FEW_EDITS, swaps=swaps), by))
    lost = q.join(near.select(*by, "query").distinct(), [*by, "query"], "left_anti").filter(F.floor(F.length("query") * share) > FEW_EDITS)
    return union(near, closest(fuzzy_join(lost, t, by, share, most, swaps=swaps), by))


#: Strings of a group on either side that are compared at once, and pairs whose distances are taken together.
BLOCK, TOGETHER = 512, 1 << 17
#: Classes of characters in a tally, and bits for how often one occurs.
CLASSES, LEVELS = 32, 4


def tallies(texts: list[str]) -> np.ndarray:
    """Two words a string: how often characters of each class occur in it, up to LEVELS times, as so many bits set.

    An edit sets one bit at most and clears one at most.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % CLASSES
    at = np.repeat(np.arange(len(texts)), sizes) * CLASSES + points
    counts = np.minimum(np.bincount(at, minlength=len(texts) * CLASSES), LEVELS).reshape(len(texts), 2, CLASSES // 2).astype(np.uint64)
    places = np.arange(CLASSES // 2, dtype=np.uint64) * np.uint64(LEVELS)
    return (((np.uint64(1) << counts) - np.uint64(1)) << places).sum(axis=2, dtype=np.uint64)


def near_pairs(groups: list[tuple[list[str], list[str]]], edits: list[int], swaps: bool) -> list[list[tuple[int, int, int]]]:
    """For each group of queries and terms (query, term, distance) by number: the nearest terms of each query within its edits.

    edits: by a query's length, the last for longer ones. Pairs whose lengths or
    tallies differ too much are left out before any distance is taken.
    """
    every = [x for q, t in groups for x in (*q, *t)]
    tally, sizes, allowed = tallies(every), np.fromiter(map(len, every), np.int64, len(every)), np.array(edits)
    found: list[list[tuple[int, int, int]]] = [[] for _ in groups]
    ours, theirs, whose = [], [], []

    def settle_pairs() -> None:
        if not whose:
            return
        a, b, g = np.concatenate(ours), np.concatenate(theirs), np.concatenate(whose)
        for kept in (ours, theirs, whose):
            kept.clear()
        d = osa([every[i] for i in a], [every[j] for j in b], swaps)
        good = d <= allowed[np.minimum(sizes[a], len(edits) - 1)]
        a, b, g, d = a[good], b[good], g[good], d[good]
        least = np.full(len(every), 1 << 30)
        np.minimum.at(least, a, d)
        best = d == least[a]
        for i, j, n, k in zip(a[best].tolist(), b[best].tolist(), g[best].tolist(), d[best].tolist()):
            start, middle = bounds[n]
            found[n].append((i - start, j - middle, k))

    bounds, start, waiting = [], 0, 0
    for n, (q, t) in enumerate(groups):
        middle = start + len(q)
        bounds.append((start, middle))
        same: dict[str, list[int]] = {}
        for j, x in enumerate(t):
            same.setdefault(x, []).append(j)
        found[n] += [(i, j, 0) for i, x in enumerate(q) for j in same.get(x, ())]
        lost = np.array([start + i for i, x in enumerate(q) if x not in same], np.int64)
        end = middle + len(t)
        k = allowed[np.minimum(sizes[lost], len(edits) - 1)][:, None]
        ok = np.abs(sizes[lost][:, None] - sizes[middle:end]) <= k
        a, b = tally[lost][:, None], tally[middle:end]
        for x, y in ((a, b), (b, a)):
            ok &= np.bitwise_count(x & ~y).sum(axis=2) <= k
        i, j = np.nonzero(ok)
        if len(i):
            ours.append(lost[i])
            theirs.append(middle + j)
            whose.append(np.full(len(i), n))
            waiting += len(i)
        if waiting >= TOGETHER:
            settle_pairs()
            waiting = 0
        start = end
    settle_pairs()
    return found


def closest_in_groups(
    queries: DataFrame, terms: DataFrame, by: list[str], share: float = 0.2, most: int = 6, swaps: bool = True, fixed: int | None = None
) -> DataFrame:
    """by, query, term, distance and all other columns of either side: the nearest terms of each query, for many groups that are small or large.

    The same pairs as closest_terms, for groups (a document's n-grams, say) whose
    own strings are so few that keys would part little and cost much. queries:
    by, query and others; terms: by, term and others, of other names. fixed: as for fuzzy_join. A group is
    cut into blocks of BLOCK strings on either side; a row holds two blocks, and
    a group's blocks are dealt out, so that no task needs a whole group.
    """
    small_batches(queries.sparkSession)
    edits = [edits_allowed(n, share, most, fixed) for n in range((math.ceil(most / share) if share > 0 else 0) + 2)]

    def blocks(rows: DataFrame, string: str, number: str, name: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(string)
        placed = rows.filter(F.col(string).isNotNull()).withColumn(number, F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
        return placed.groupBy(*by, number).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in by])).alias(name))

    @F.arrow_udf("array<struct<i: int, j: int, d: int>>")
    def compare(q: pa.Array, t: pa.Array) -> pa.Array:
        found = near_pairs(list(zip(q.to_pylist(), t.to_pylist())), edits, swaps)
        return pa.array([[dict(zip("ijd", p)) for p in one] for one in found], pa.list_(pa.struct([(c, pa.int32()) for c in "ijd"])))

    left, right = blocks(queries, "query", "_block", "_q"), blocks(terms, "term", "_part", "_t")
    asked = left.groupBy(*by).agg(F.max("_block").alias("_last"))
    dealt = right.join(asked, by).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")
    met = left.join(dealt, [*by, "_block"]).withColumn("_p", compare(F.col("_q.query"), F.col("_t.term")))
    pairs = met.select(*by, "_block", F.explode(F.transform("_p", lambda p: F.struct(F.col("_q")[p["i"]].alias("q"), F.col("_t")[p["j"]].alias("t"), p["d"].alias("d")))).alias("_x"))
    flat = pairs.select(*by, "_block", "_x.q.*", "_x.t.*", F.col("_x.d").alias("distance"))
    order = Window.partitionBy(*by, "_block", "query").orderBy("distance")
    return flat.withColumn("r", F.rank().over(order)).filter("r = 1").drop("r", "_block")


def top(found: DataFrame, by: list[str]) -> DataFrame:
    """A query's best term: nearest, then most frequent, then first in order."""
    order = Window.partitionBy(*by, "query").orderBy("distance", F.desc("freq"), "term")
    return found.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")
