"""Similarity join of word shingles by Jaccard, with chosen-path recursion.

A document is the set of its five-word shingles. Equal sets are collapsed into
one class first. A set is embedded as 64 minwise samples; node by node, sets
that share a sampled token (a coordinate and its value) fall into the same
bucket. A bucket of bounded size is brute-forced on the samples; a larger one is
split again on further sampled coordinates, unless that no longer parts its
sets: such a dense bucket is compared block by block. Runs from different roots repeat until a pair at
the threshold is found with the target recall, averaged over how far its samples stray from its Jaccard. The buckets give only spanning
edges of candidate groups, never all their pairs; within each candidate group,
in blocks, the true Jaccard of the whole sets decides, links are counted, and
spanning edges of true links give the classes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, mix64, offsets, settle, small_batches, spread_join, strings
from .components import connected

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
SAMPLES = 64
#: Coordinates a node splits on, and sets compared at once.
BRANCHES, BUCKET = 2, 256
#: A bucket that keeps this share of its parent's sets is dense: splitting does not part them, and it is compared in blocks.
DENSE = 0.6
#: How far, in standard deviations, an estimate may lie below the threshold and still count.
SLACK = 4.5
#: Sets and distinct shingles in a block of a candidate group, about.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
#: Levels of splitting at most, and runs from the root.
LEVELS, MOST_RUNS = 64, 1024
SEED = 3

ODD = np.random.default_rng(SEED).integers(1, 1 << 63, SAMPLES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit numbers of each text's shingles.

    Words are lower-cased runs of letters and digits. A text of one to four
    words has one shingle, all of them; one without words has none.
    """
    words: list[str] = []
    n = []
    for t in texts:
        found = WORD.findall(t.lower())
        words += found
        n.append(len(found))
    starts = offsets(n)
    if not words:
        return [np.zeros(0, np.uint64) for _ in texts]
    codes, distinct = pd.factorize(np.array(words, object))
    h = mix64(pd.util.hash_array(distinct, categorize=False))[codes]
    m = max(len(h) - SHINGLE + 1, 0)
    rolled = np.zeros(m, np.uint64)
    for j in range(SHINGLE):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = x * np.uint64(0xD6E8FEB86659FD93) + w
            out.append(mix64(np.array([x])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return np.array([s.sum(dtype=np.uint64), mix64(s + np.uint64(len(s))).sum(dtype=np.uint64)], np.uint64).tobytes()


def samples(shingles: np.ndarray) -> np.ndarray:
    """Minwise samples: of each of SAMPLES orders, the high 32 bits of the smallest."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(low, (shingles[at : at + 4096, None] * ODD).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def row_id(key: str, text: str) -> F.Column:
    """16 bytes that stand for a key and a text, either of which may be null: rows that share them are the same document twice."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(F.sha1(part(key)), part(text))))


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, row (its row_id), fp (16 bytes that stand for the set), n_shingles and sig (the samples) of each document."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                fps, sizes, sigs = [], [], []
                for s in shingle_sets(strings(b.column(1))):
                    fps.append(fingerprint(s))
                    sizes.append(len(s))
                    sigs.append(samples(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())],
                    names=[key, "row", "fp", "n_shingles", "sig"],
                )

    return docs.select(key, text, row_id(key, text).alias("row")).mapInArrow(run, f"`{key}` {kind}, row binary, fp binary, n_shingles long, sig binary")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with the same `bucket` from batches sorted by it; many whole runs at a time, none torn."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        keys = rest["bucket"].to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield rest.slice(0, cut).combine_chunks()
            rest = rest.slice(cut)
    if rest is not None:
        yield rest.combine_chunks()


def clusters(sigs: np.ndarray, need: int) -> np.ndarray:
    """For each row the first row it is connected to, where rows that agree in `need` samples or more are linked."""
    first, left = np.arange(len(sigs)), np.arange(len(sigs))
    while len(left):
        start, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            like = np.count_nonzero(sigs[left] == sigs[todo.pop()], axis=1) >= need
            found, left = left[like], left[~like]
            first[found] = start
            todo += found.tolist()
    return first


def edges_in_buckets(rows: DataFrame, need: int) -> DataFrame:
    """Spanning edges (a, b) of the sets of each bucket that agree in `need` samples or more.

    rows: bucket, fp, sig, side. In a bucket of two blocks (sides 0 and 1) only
    the edges that the blocks by themselves (side 2) lack are given.
    """
    sorted_rows = rows.select("bucket", "fp", "sig", "side").repartition("bucket").sortWithinPartitions("bucket", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            keys, side = t["bucket"].to_numpy(), t["side"].to_numpy()
            fps = t["fp"].to_pylist()
            sigs = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, SAMPLES)
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            a, b = [], []
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                first = clusters(sigs[x:y], need)
                if side[x] == 2:
                    found = np.flatnonzero(first != np.arange(y - x))
                else:
                    own = np.zeros(y - x, np.int64)
                    for k in (0, 1):
                        at = np.flatnonzero(side[x:y] == k)
                        own[at] = at[clusters(sigs[x + at], need)] if len(at) else at
                    found = np.flatnonzero((own == np.arange(y - x)) & (first != own))
                a += [fps[x + j] for j in found.tolist()]
                b += [fps[x + i] for i in first[found].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return sorted_rows.mapInArrow(run, "a binary, b binary")


def least_equal(threshold: float) -> int:
    """Equal samples from which on a pair of a bucket is a candidate."""
    return math.ceil((threshold - SLACK * math.sqrt(threshold * (1 - threshold) / SAMPLES)) * SAMPLES)


def miss_rate(jaccard: float, runs: int, need: int, levels: int = LEVELS) -> float:
    """Share of pairs of that Jaccard that share no last bucket in any run, or do not agree in `need` samples.

    All runs use the same samples, so the rate is averaged over how many of them
    are equal (binomial). The runs' roots are different samples, drawn without
    putting back. Below a root a pair survives `levels` splits by the equal
    share; 0 levels is the rate where buckets end at the root.
    """
    missed = 0.0
    for equal in range(SAMPLES + 1):
        weight = math.comb(SAMPLES, equal) * jaccard**equal * (1 - jaccard) ** (SAMPLES - equal)
        lives = 1.0
        for _ in range(levels):
            lives = 1 - (1 - equal / SAMPLES * lives) ** BRANCHES
        rounds, rest = divmod(runs, SAMPLES)
        hits = lambda j: math.comb(equal, j) * math.comb(SAMPLES - equal, rest - j) / math.comb(SAMPLES, rest)  # noqa: B023, E731
        missed += weight * (sum(hits(j) * (1 - lives) ** (rounds * equal + j) for j in range(rest + 1)) if equal >= need else 1.0)
    return missed


def runs_needed(threshold: float, recall: float) -> int:
    """Runs until the miss rate of pairs at the threshold is at most 1 - recall, however many levels it takes."""
    for runs in range(1, MOST_RUNS + 1):
        if miss_rate(threshold, runs, least_equal(threshold)) <= 1 - recall:
            return runs
    raise ValueError(f"{MOST_RUNS} runs do not reach a recall of {recall} at threshold {threshold}")


def roots_of(runs: int) -> list[int]:
    """The coordinate that each run's root splits on: all different, as far as there are enough."""
    order = np.random.default_rng(SEED).permutation(SAMPLES)
    return [int(order[r % SAMPLES]) for r in range(runs)]


def coordinate(*seeds) -> F.Column:
    return F.pmod(F.xxhash64(*seeds), F.lit(SAMPLES)).cast("int")


def candidate_edges(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Spanning edges between classes that may be similar, by chosen-path recursion over their samples."""
    value = lambda c: F.substring(F.col("sig"), c * 4 + 1, F.lit(4))
    node = lambda *seeds: F.xxhash64(*seeds, coordinate(*seeds), value(coordinate(*seeds)))
    roots = F.array(*[F.lit(c) for c in roots_of(runs_needed(threshold, recall))])
    level = classes.select("fp", "sig", F.posexplode(roots).alias("run", "root"))
    level = level.select("fp", "sig", F.xxhash64(F.lit(SEED), "run", "root", value(F.col("root"))).alias("bucket"), F.lit(None).cast("long").alias("parent_n"))
    found = []
    for depth in range(LEVELS):
        sizes = settle(level.groupBy("bucket").agg(F.count("*").alias("n"), F.max("parent_n").alias("parent_n")).filter("n > 1"))
        hot = hot_keys(sizes, "bucket", "n", rows_of(sizes))
        if depth == 0:  # the samples stay behind until the sets alone in their buckets are gone
            met = settle(spread_join(level.select("bucket", "fp"), sizes, "bucket", hot))
            met = settle(met.join(classes.select("fp", "sig"), "fp"))
        else:
            met = settle(spread_join(level.drop("parent_n"), sizes, "bucket", hot))
        large = met.filter(F.col("n") > BUCKET)
        dense = F.coalesce(F.col("n") >= DENSE * F.col("parent_n"), F.lit(False))
        found += [met.filter(F.col("n") <= BUCKET).withColumn("side", F.lit(2)), in_blocks(large.filter(dense))]
        if not large.filter(~dense).limit(1).count():
            break
        branch = large.filter(~dense).withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))))
        level = branch.select("fp", "sig", node(F.col("bucket"), F.col("branch")).alias("bucket"), F.col("n").alias("parent_n"))
    else:
        raise RuntimeError(f"buckets did not become small or dense within {LEVELS} levels")
    rows = [x.select("bucket", "fp", "sig", "side") for x in found]
    return edges_in_buckets(reduce(DataFrame.union, rows), least_equal(threshold)).distinct()


def rows_of(sizes: DataFrame) -> int:
    """All rows of groups whose sizes are given as `n`."""
    return sizes.agg(F.sum("n")).first()[0] or 0


def in_blocks(large: DataFrame) -> DataFrame:
    """Rows of large buckets dealt to all pairs of blocks: each set once with its own block, and with every other one."""
    n_blocks = F.ceil(F.col("n") / BUCKET).cast("int")
    mine = F.pmod(F.xxhash64("fp", "bucket"), n_blocks).cast("int")
    paired = large.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    bucket = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket")
    return paired.select("fp", "sig", bucket, side_of("mine", "other"))


def side_of(mine: str, other: str) -> F.Column:
    return F.when(F.col(mine) == F.col(other), 2).when(F.col(mine) > F.col(other), 1).otherwise(0).cast("int").alias("side")


def overlaps(one: np.ndarray, flat: np.ndarray, starts: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Numbers of elements of `one` in each of the sets laid out in flat; mark is all false and is left so."""
    mark[one] = True
    hit = np.add.reduceat(mark[flat], starts[:-1], dtype=np.int64)
    mark[one] = False
    return hit


def compare_blocks(tags: np.ndarray, weight: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """True links among sets of two blocks (tags 0 and 1; only across) or of one block (all tags 2).

    Returns each set's number of linked documents (a class counts by its weight) and spanning edges of the links.
    """
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = offsets(sizes)
    mark = np.zeros(int(codes.max()) + 1, bool)
    links = np.zeros(len(sets), np.int64)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    two = tags[0] != 2
    theirs = np.flatnonzero(tags == 1) if two else np.arange(len(sets))
    flat = codes[np.concatenate([np.arange(starts[j], starts[j + 1]) for j in theirs])] if len(theirs) else codes[:0]
    there = offsets(sizes[theirs])
    for i in np.flatnonzero(tags != 1).tolist():
        if not len(theirs):
            break
        both = overlaps(codes[starts[i] : starts[i + 1]], flat, there, mark)
        like = both >= threshold * (sizes[theirs] + sizes[i] - both) - 1e-9
        near = theirs[like]
        near = near[near != i]
        links[i] += int(weight[near].sum())
        if two:
            links[near] += weight[i]
        for j in near.tolist():
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return links, [(root(i), i) for i in range(len(sets)) if root(i) != i]


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, links): spanning edges of true links with links 0, and (fp, fp, linked documents) counts.

    members: fp, root (of its candidate group), n_docs (documents of the class), n_shingles and text.
    """
    sizes = settle(members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all_shingles")).filter("n > 1"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all_shingles") / BLOCK_SHINGLES)).cast("int")
    spread = spread_join(members, sizes.select("root", blocks.alias("blocks")), "root", hot_keys(sizes, "root", "n", rows_of(sizes)))
    dealt = spread.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = dealt.select(
        F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "fp", side_of("mine", "other"), "n_docs", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for t in groups(batches):
                keys = t["bucket"].to_numpy()
                fps, tags, weight, texts = t["fp"].to_pylist(), t["side"].to_numpy(), t["n_docs"].to_numpy(), strings(t["text"])
                a, b, links = [], [], []
                edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if y - x < 2:
                        continue
                    mine = fps[x:y]
                    linked, found = compare_blocks(tags[x:y], weight[x:y], shingle_sets(texts[x:y]), threshold)
                    counted = np.flatnonzero(linked).tolist()
                    a += [mine[j] for _, j in found] + [mine[i] for i in counted]
                    b += [mine[i] for i, _ in found] + [mine[i] for i in counted]
                    links += [0] * len(found) + linked[counted].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    return keyed.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(run, "a binary, b binary, links long")


def placed(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The sketch of docs (doc_key, doc_text), and every set once: fp, n_docs (documents with it), set_id, first, n_links and root (of its class).

    first: doc_key and row of the document that stands for the set, the one with the smallest key, null last.
    """
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold must be in (0, 1], recall in (0, 1)")
    sketched = settle(sketch(docs, "doc_key", "doc_text"))
    first = F.struct(F.col("doc_key").isNull().alias("no_key"), "doc_key", "row")
    classes = settle(
        sketched.filter("n_shingles > 0").groupBy("fp")
        .agg(F.count("*").alias("n_docs"), F.min(first).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        .withColumn("set_id", F.col("first.doc_key"))
    )
    groups_of = connected(candidate_edges(classes.select("fp", "sig"), threshold, recall))
    members = classes.drop("sig").join(groups_of, classes["fp"] == groups_of["node"]).select("fp", "root", "n_docs", "n_shingles", F.col("first.row").alias("row"))
    texts = docs.select(row_id("doc_key", "doc_text").alias("row"), F.col("doc_text").alias("text"))
    # A key that stands twice on one text brings it twice.
    seen = settle(verify(members.join(texts, "row").dropDuplicates(["row"]), threshold))
    links = seen.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected(seen.filter("links = 0").select("a", "b"))
    sets = (
        classes.select("fp", "n_docs", "set_id", "first").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    )
    return sketched, sets.select("fp", "n_docs", "set_id", "first", "root", (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, set_id, class_id, n_links, n_shingles.

    set_id: smallest key with an equal shingle set. class_id: smallest key of
    all documents connected by links (Jaccard >= threshold). n_links: number of
    other documents with such a link, copies included. A text without words
    (null, too) has no link and is its own class. Rows that repeat a key count
    as copies; a null key stays null but its text has links as others do, and
    set_id or class_id is null only where no key at all is there.
    Other columns are ignored; no rows give no rows. Whole texts count.
    """
    sketched, sets = placed(docs.select(F.col(key).alias("doc_key"), F.col(text).alias("doc_text")), threshold, recall)
    sets = settle(sets.drop("first"))
    named = settle(sets.groupBy("root").agg(F.min("set_id").alias("class_id"), F.count("*").alias("n")))
    classed = spread_join(sets, named.drop("n"), "root", hot_keys(named, "root", "n", rows_of(named))).select("fp", "set_id", "class_id", "n_links")
    own = [F.col("doc_key").alias("set_id"), F.col("doc_key").alias("class_id"), F.lit(0).cast("long").alias("n_links")]
    empty = sketched.filter("n_shingles = 0").select("doc_key", *own, "n_shingles")
    full = spread_join(sketched.filter("n_shingles > 0").select("fp", "doc_key", "n_shingles"), settle(classed), "fp", hot_keys(sets, "fp", "n_docs", sketched.count()))
    return full.select("doc_key", "set_id", "class_id", "n_links", "n_shingles").union(empty).withColumnRenamed("doc_key", key)


def one_per_class(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are left when one row of each class of near-duplicates is kept.

    It is the row with the smallest key (null last), then the smallest
    fingerprint of its set, then the smallest row_id. Classes are those of the
    rows, not of the keys: a key on two texts counts twice. Rows with that key
    and text differ in their other columns at most; the smallest is kept. A text
    without words is a class by itself, row by row, so all such rows stay.
    """
    sketched, sets = placed(docs.select(F.col(key).alias("doc_key"), F.col(text).alias("doc_text")), threshold, recall)
    best = F.min(F.struct("first.no_key", "first.doc_key", "fp", "first.row")).alias("best")
    firsts = sets.groupBy("root").agg(best).select(F.col("best.row").alias("row"), F.lit(False).alias("wordless"))
    wordless = sketched.filter("n_shingles = 0").select("row", F.lit(True).alias("wordless")).distinct()
    times = sketched.groupBy("row").agg((F.count("*") > 1).alias("again"))
    chosen = firsts.union(wordless).join(times, "row").select("row", (F.col("again") & ~F.col("wordless")).alias("again"))
    # The input's own columns may have these names.
    row, twice = (unused(docs, name) for name in ("row", "again"))
    found = docs.withColumn(row, row_id(key, text)).join(chosen.select(F.col("row").alias(row), F.col("again").alias(twice)), row)
    # Of rows that are there more than once one is taken; the others need no aggregate.
    once = found.filter(F.col(twice)).groupBy(row).agg(F.min(F.struct(*docs.columns)).alias("kept")).select("kept.*")
    return once.union(found.filter(~F.col(twice)).select(*docs.columns))


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
