"""SimHash near-duplicates, found by deletion-variant signatures.

A fingerprint has 64 bits. Two that differ in at most four bits, cut into three
segments, differ in at most one bit of some segment. So each segment is indexed
under variants with one bit wiped out, its place kept: two segments that differ
in one bit share the variant without that bit, and equal ones share all. An
equality join on variants brings every such pair together; whole fingerprints
are compared there. Three segments of 21 and 22 bits make 64 variants and leave
2**20 values or more to each, where five segments without wildcards, the fewest
of which one must be equal, have 2**12.

Equal fingerprints are one class before the join. A variant that many classes
share is compared in pairs of blocks of bounded size, each in a task of its own,
and only spanning edges of its links leave a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, settle, small_batches, spread_join
from .components import connected

BITS, SHINGLE, SEED = 64, 4, 42
#: Links, and the segments (first bit, bits) of which one differs in at most one bit then.
MOST_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints compared at once, and up to which a bucket is compared together with others.
BLOCK, FEW = 1024, 32
#: Bytes of a text, and shingles, held as objects at once.
STRETCH, SHINGLES = 4 << 20, 1 << 16
SPACE = re.compile(rb"[ \t-\r]")


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time. Words end at ASCII white space."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + STRETCH)
        end = space.start() if space else len(text)
        yield text[at:end].split()
        at = end


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text with A-Z lower-cased, repeats included, some at a time; of all its words where they are too few for one."""
    hash_of = xxhash.xxh64_intdigest
    last: list[bytes] = []
    whole = True
    for words in stretches(text.lower()):
        words = last + words
        if len(words) >= SHINGLE:
            whole = False
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begins = np.concatenate([[0], ends[:-1] + 1])
            joined = b" ".join(words)
            for i in range(0, len(words) - SHINGLE + 1, SHINGLES):
                spans = zip(begins[i : i + SHINGLES].tolist(), ends[i + SHINGLE - 1 : i + SHINGLE - 1 + SHINGLES].tolist())
                yield np.array([hash_of(joined[a:b], SEED) for a, b in spans], np.uint64)
            last = words[-SHINGLE + 1 :]
        else:
            last = words
    if whole and last:
        yield np.array([hash_of(b" ".join(last), SEED)], np.uint64)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A bit is one if it is in over half of a text's shingle hashes; without words all are zero."""
    count, ones = np.zeros(len(texts), np.int64), np.zeros((len(texts), BITS), np.int64)
    waiting: list[np.ndarray] = []
    whose: list[int] = []

    def add() -> None:
        if waiting:
            # the highest bit first, so that packing the bits gives the number back
            bits = np.unpackbits(np.concatenate(waiting).astype(">u8").view(np.uint8)).reshape(-1, BITS)
            sizes = np.array([len(h) for h in waiting])
            np.add.at(ones, whose, np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64))
            np.add.at(count, whose, sizes)
            waiting.clear()
            whose.clear()

    size = 0
    for i, t in enumerate(texts):
        for h in shingle_hashes(t):
            waiting.append(h)
            whose.append(i)
            size += len(h)
            if size >= SHINGLES:
                add()
                size = 0
    add()
    return np.packbits(2 * ones > count[:, None], axis=1).view(">u8").astype(np.uint64).reshape(-1)


def fingerprint(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and fp, a text's fingerprint as a long, of every document."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(texts).view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def variants(fp: str) -> F.Column:
    """The signatures of a fingerprint: for each bit of each segment the segment without it, marked with the bit's number."""
    made = []
    for first, bits in SEGMENTS:
        segment = F.shiftrightunsigned(F.col(fp), first).bitwiseAND(F.lit((1 << bits) - 1))
        for j in range(bits):
            made.append(segment.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << j))).bitwiseOR(F.lit((first + j) << 32)))
    return F.array(*made)


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= MOST_BITS


def first_linked(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint the first of those it is connected to by links."""
    first, left = np.arange(len(fps)), np.arange(len(fps))
    while len(left):
        start, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            like = near(fps[left], fps[todo.pop()])
            found, left = left[like], left[~like]
            first[found] = start
            todo += found.tolist()
    return first


def block_edges(fps: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places joined by spanning edges: within one block (all sides 2), or what joins two blocks (sides 0 and 1) beyond what either joins itself."""
    first, own = first_linked(fps), np.arange(len(fps))
    if side[0] != 2:
        for k in (0, 1):
            at = np.flatnonzero(side == k)
            own[at] = at[first_linked(fps[at])]
    found = np.flatnonzero((own == np.arange(len(fps))) & (first != own))
    return first[found], found


def edges_of(bucket: np.ndarray, fps: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of what links connect in each bucket of rows that are sorted by bucket. Small buckets are compared together, by their distance in the rows."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    starts, sizes = edges[:-1], np.diff(edges)
    small = np.repeat(sizes <= FEW, sizes)
    linked = []
    for lag in range(1, min(FEW, len(fps))):
        at = np.flatnonzero((bucket[lag:] == bucket[:-lag]) & small[lag:])
        if not len(at):
            break
        linked.append(at[near(fps[at], fps[at + lag])])
    todo = np.zeros(len(fps), bool)
    for at in linked:
        todo[at] = True
    some = np.logical_or.reduceat(todo, starts) | (sizes > FEW)
    a, b = [], []
    for x, n in zip(starts[some].tolist(), sizes[some].tolist()):
        i, j = block_edges(fps[x : x + n], side[x : x + n])
        a.append(fps[x + i])
        b.append(fps[x + j])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by bucket from batches, as tables that tear no bucket."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        keys = rest["bucket"].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None:
        yield rest


def linking_edges(classes: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) between different fingerprints that links connect, enough to connect all of those. classes: fp, each once, `total` rows."""
    # A number of tasks that does not follow from the bytes of the fingerprints, which are few: each becomes 64 rows.
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.repartition(tasks, "fp").select("fp", F.explode(variants("fp")).alias("bucket"))
    # Only what is too large for one task has to be known before the rows meet.
    large = settle(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK))
    met = spread_join(rows, large, "bucket", hot_keys(large, "bucket", "n", BITS * total), "left")
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    dealt = met.select("fp", "bucket", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("mine"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") > F.col("other"), 1).otherwise(0).cast("int")
    pair = F.struct("bucket", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    # A pair of blocks has a number of its own: that of the bucket where it is alone, a hash of all three parts otherwise.
    number = F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64(pair).bitwiseOR(F.lit(-(1 << 63))))
    keyed = dealt.select(number.alias("bucket"), "fp", side.alias("side")).repartition("bucket").sortWithinPartitions("bucket", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches):
            a, b = edges_of(t["bucket"].to_numpy(), t["fp"].to_numpy().view(np.uint64), t["side"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return keyed.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, fp (its fingerprint as a long) and component_id, the smallest key among all documents reached by links.

    Documents link where their fingerprints differ in at most four bits. A text
    without words, null or empty, has fingerprint zero and links as any other.
    A null key stays null; its text links, and component_id is null only where
    no key is in reach. Rows that repeat a key each get a row. Other columns are
    ignored; no rows give no rows. Whole texts count.
    """
    found = settle(fingerprint(docs.select(F.col(key).alias("doc_key"), F.col(text).alias("doc_text")), "doc_key", "doc_text"))
    classes = settle(found.groupBy("fp").agg(F.count("*").alias("n_docs"), F.min("doc_key").alias("first")))
    total = classes.count()
    roots = connected(linking_edges(classes.select("fp"), total)).withColumnRenamed("node", "fp")
    rooted = settle(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    components = settle(rooted.groupBy("root").agg(F.count("*").alias("n"), F.min("first").alias("component_id")))
    of_class = spread_join(rooted.select("fp", "root"), components.select("root", "component_id"), "root", hot_keys(components, "root", "n", total))
    named = of_class.select("fp", "component_id")
    all_docs = found.count()
    return spread_join(found, named, "fp", hot_keys(classes, "fp", "n_docs", all_docs)).select(F.col("doc_key").alias(key), "fp", "component_id")


def as_hex(fp: str = "fp") -> F.Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
