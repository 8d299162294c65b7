"""Approximate nearest neighbours with randomly rotated one-bit codes.

The index keeps, for every vector, the signs of its randomly rotated direction
(packed bits) and two correction scalars. A query's rotated direction is
rounded to four bits a component, so that an inner product is estimated by
counting bits that two packed words share, with a bound on the estimate's error.

Codes of queries and rows meet in blocks of bounded size, each pair of blocks in
a task of its own; vectors stay behind. A first pass takes each query's best
estimates; their exact cosines tell how near its last neighbour is at least. A
second pass keeps the rows whose upper bound reaches that, and vectors are
joined for these survivors only, to be compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, small_batches

#: Numbers in a block of rows and in a block of queries: what a task holds of vectors is bounded whatever their length.
ROW_NUMBERS, QUERY_NUMBERS = 1 << 21, 1 << 19
#: Bits of a code at least: short vectors are rotated several times, as an estimate's error falls with the root of its bits.
BITS = 512
#: Width of the error bound, in standard deviations of an estimate about.
EPSILON = 3.5
#: Bits to which a query's components are rounded.
PLANES = 4
#: Best estimates of the first pass that are compared exactly, for each neighbour asked for.
PROBES = 4
SEED = 10


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random rotation into a space of BITS dimensions or more, the same for the same dimension and seed.

    It stacks as many random orthogonal matrices as it takes, and keeps lengths.
    """
    rng, parts = np.random.default_rng([seed, dim]), []
    for _ in range(-(-BITS // dim)):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts) / np.sqrt(len(parts))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column whose rows all have `dim` numbers, as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    scaled = halved(vectors)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    rows, dim = bits.shape
    wide = np.zeros((rows, -(-dim // 64) * 8), np.uint8)
    wide[:, : -(-dim // 8)] = np.packbits(bits, axis=1)
    return wide.view(np.uint64)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated directions, and each code's inner product with its direction (the correction scalar)."""
    turned = directions(vectors) @ turn.T
    return packed(turned > 0), np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[0])


def encode_query(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the rotated directions, rounded to PLANES bits, and of each query (low, step, sum, rounding error)."""
    turned = directions(vectors) @ turn.T
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-300)
    levels = np.round((turned - low) / step).astype(np.uint8)
    rough = low + step * levels
    planes = np.concatenate([packed((levels >> j) & 1) for j in range(PLANES)], axis=1)
    return planes, np.column_stack([low[:, 0], step[:, 0], rough.sum(axis=1), np.linalg.norm(turned - rough, axis=1)])


class Codes:
    """The codes of a block of rows, ready to be scanned."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, bits: int):
        self.words, self.bits, self.scale = np.ascontiguousarray(codes.T), bits, scale
        self.ones = np.bitwise_count(self.words).sum(axis=0, dtype=np.float64)
        self.both, self.count = np.empty(len(scale), np.uint64), np.empty(len(scale), np.uint8)

    def estimate(self, planes: np.ndarray, scalars: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of one query with all rows, and how far each may be off."""
        low, step, total, error = scalars.tolist()
        shared = np.zeros(len(self.scale))
        for j, plane in enumerate(planes.reshape(PLANES, -1)):
            counted = np.zeros(len(self.scale), np.uint32)
            for word, mine in zip(self.words, plane):
                np.bitwise_and(word, mine, out=self.both)
                counted += np.bitwise_count(self.both, out=self.count)
            shared += counted * float(1 << j)
        guess = (2 * (low * self.ones + step * shared) - total) / np.sqrt(self.bits) / self.scale
        spread = np.sqrt(np.maximum(1 - self.scale**2, 0) + error**2) / self.scale / np.sqrt(self.bits - 1)
        return guess, epsilon * spread


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part.

    Left out: null ids, and vectors that are null, zero or hold a null or
    non-finite number. Of rows that repeat a vec_id the vector that comes first
    in order, component by component, counts.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kind = vectors.schema["embedding"].dataType
    known = vectors if kind.simpleString() in ("array<float>", "array<double>") else vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    clean = known.select("vec_id", "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    )
    return clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def build_index(rows: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """id, ids, dim, embedding, code and scale of every different vector of `rows` (from usable); written to the shared checkpoint folder.

    ids: the k + 1 smallest vec_ids that have the vector, enough for any search
    for k neighbours, as equal scores go to smaller ids; id: the first of them.
    Only so many rows of a vector leave a task, however often it is repeated.
    """
    small_batches(rows.sparkSession)
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    classes = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column(1).value_lengths())
            for dim in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == dim))
                codes, scale = encode(matrix(part.column(1), dim), rotation(dim, seed))
                made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([dim] * part.num_rows, pa.int32()), *made], names=["ids", "embedding", "dim", "code", "scale"])

    coded = classes.mapInArrow(run, f"ids {kinds['ids']}, embedding {kinds['embedding']}, dim int, code binary, scale double")
    return settle(coded.withColumn("id", F.col("ids")[0]))


def halved(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled by powers of two so that their largest components lie between a half and one: their squares neither overflow nor vanish, and no digit changes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))[1])


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of a query with each row, every sum taken in the order of the components."""
    query, rows = halved(query), halved(rows)
    dot, norm, own = np.zeros(len(rows)), np.zeros(len(rows)), 0.0
    for j, q in enumerate(query.tolist()):
        dot += q * rows[:, j]
        norm += rows[:, j] * rows[:, j]
        own += q * q
    return dot / (np.sqrt(own) * np.sqrt(norm))


def blocks_of(rows: DataFrame, numbers: int, key: str, to: str) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by a hash of `key` to blocks of about `numbers` numbers, within each length; and the number of blocks of each length."""
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") * F.col("dim") / numbers).cast("int").alias(f"n_{to}"))
    dealt = rows.join(sizes, "dim").withColumn(to, F.pmod(F.xxhash64(key), F.col(f"n_{to}")).cast("int")).drop(f"n_{to}")
    return dealt, sizes


def each_of(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def by_block(rows: DataFrame):
    """Rows grouped by pair of blocks, under columns of their own, as both sides may stem from one table."""
    return rows.select(*[F.col(c).alias(c) for c in rows.columns]).groupBy("dim", "qb", "rb")


def words(column: pa.ChunkedArray) -> np.ndarray:
    """A column of packed words as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def estimates(mine: pa.Table, theirs: pa.Table, epsilon: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each query of a block the estimates for all rows of a block and how far they may be off."""
    block = Codes(words(theirs["code"]), theirs["scale"].to_numpy(), bits_of(mine["dim"][0].as_py()))
    for planes, scalars in zip(words(mine["planes"]), matrix(mine["scalars"], 4)):
        yield block.estimate(planes, scalars, epsilon)


def bits_of(dim: int) -> int:
    return dim * -(-BITS // dim)


def probes(queries: DataFrame, codes: DataFrame, few: int) -> DataFrame:
    """dim, qb, rb, query_id, found and guess: of each block of rows the ids of the `few` best estimates of each query, and these.

    queries: dim, qb, rb, query_id, planes, scalars; codes: dim, qb, rb, id, code, scale.
    """
    query_kind, id_kind = (f.schema[c].dataType.simpleString() for f, c in ((queries, "query_id"), (codes, "id")))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        n = mine.num_rows if theirs.num_rows else 0
        ids, found, guesses = theirs["id"].to_numpy(), [], []
        for guess, _ in estimates(mine, theirs, 0) if n else ():
            at = np.argpartition(-guess, few - 1)[:few] if len(guess) > few else np.arange(len(guess))
            found.append(ids[at])
            guesses.append(guess[at])
        lists = [pa.array(found, pa.list_(theirs.schema.field("id").type)), pa.array(guesses, pa.list_(pa.float64()))]
        return pa.table([*[mine[c][:n] for c in ("dim", "qb", "rb", "query_id")], *lists], names=["dim", "qb", "rb", "query_id", "found", "guess"])

    return by_block(queries).cogroup(by_block(codes)).applyInArrow(
        run, f"dim int, qb int, rb int, query_id {query_kind}, found array<{id_kind}>, guess array<double>"
    )


def survivors(queries: DataFrame, codes: DataFrame, most: int, epsilon: float) -> DataFrame:
    """dim, qb, rb, query_id, found: of each block of rows the places of those whose upper bound reaches a query's floor.

    Places count rows by rising id, and are told as packed_places does, so that
    a task gives at most a bit for each pair, however little the bounds prune. The floor
    is raised to what `most` rows of the block reach at least. A row without
    query_id has the ids, and in `places` the places, of all rows found for any query of its pair of blocks.
    queries: also `floor`.
    """
    query_kind, id_kind = (f.schema[c].dataType.simpleString() for f, c in ((queries, "query_id"), (codes, "id")))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        kinds = mine.schema.field("query_id").type, theirs.schema.field("id").type
        out = pa.schema([
            ("dim", pa.int32()), ("qb", pa.int32()), ("rb", pa.int32()), ("query_id", kinds[0]), ("found", pa.binary()),
            ("ids", pa.list_(kinds[1])), ("places", pa.list_(pa.int32())),
        ])
        if not mine.num_rows or not theirs.num_rows:
            return out.empty_table()
        theirs = theirs.sort_by("id")
        used, found = np.zeros(theirs.num_rows, bool), []
        for (guess, bound), floor in zip(estimates(mine, theirs, epsilon), mine["floor"].to_numpy()):
            if len(guess) > most:
                floor = max(floor, np.partition(guess - bound, -most)[-most])
            near = guess + bound >= floor - 1e-9
            used |= near
            found.append(packed_places(near))
        n = mine.num_rows
        where = [pa.array([mine[c][0].as_py()] * (n + 1), pa.int32()) for c in ("dim", "qb", "rb")]
        ids = [pa.array([*[None] * n, x], out.field(5 + i).type) for i, x in enumerate((theirs["id"].to_numpy()[used], np.flatnonzero(used).astype(np.int32)))]
        return pa.table([*where, pa.array([*mine["query_id"].to_pylist(), None], kinds[0]), pa.array([*found, None], pa.binary()), *ids], schema=out)

    return by_block(queries).cogroup(by_block(codes)).applyInArrow(
        run, f"dim int, qb int, rb int, query_id {query_kind}, found binary, ids array<{id_kind}>, places array<int>"
    )


def packed_places(chosen: np.ndarray) -> bytes:
    """Which of some places are chosen: their numbers where these take less room than a bit for each place."""
    at = np.flatnonzero(chosen)
    return b"n" + at.astype(np.uint32).tobytes() if 32 * len(at) < len(chosen) else b"b" + np.packbits(chosen, bitorder="little").tobytes()


def unpacked_places(packed: bytes) -> np.ndarray:
    if packed[:1] == b"n":
        return np.frombuffer(packed, np.uint32, offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little"))


def compare(wanted: DataFrame, used: DataFrame, queries: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """query_id, id, score: of the rows wanted for each query the `most` best of each block by their exact cosine.

    wanted: dim, qb, rb, query_id, found (packed places); used: dim, qb, rb, id,
    place, every row in them once. So a row's vector is joined once for each block of queries that wants it.
    """
    rows = used.join(index.select("id", "embedding"), "id")
    asked = wanted.join(queries.select("query_id", F.col("embedding").alias("vector")), "query_id")
    query_kind, id_kind = (f.schema[c].dataType.simpleString() for f, c in ((queries, "query_id"), (index, "id")))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", mine.schema.field("query_id").type), ("id", theirs.schema.field("id").type), ("score", pa.float64())])
        if not mine.num_rows or not theirs.num_rows:
            return out.empty_table()
        dim = mine["dim"][0].as_py()
        theirs = theirs.sort_by("place")
        places, ids, vectors, asking = theirs["place"].to_numpy(), theirs["id"].to_numpy(), matrix(theirs["embedding"], dim), matrix(mine["vector"], dim)
        unit, toward = directions(vectors), directions(asking)
        q, v, s = [], [], []
        for i, (me, found) in enumerate(zip(mine["query_id"].to_pylist(), mine["found"].to_pylist())):
            near = np.searchsorted(places, unpacked_places(found))
            if len(near) > most:
                rough = unit[near] @ toward[i]
                near = near[rough >= np.partition(rough, -most)[-most] - 1e-9]
            exact = cosines(asking[i], vectors[near])
            best = np.lexsort((ids[near], -exact))[:most]
            q += [me] * len(best)
            v += ids[near][best].tolist()
            s += exact[best].tolist()
        return pa.table([pa.array(q, out.field(0).type), pa.array(v, out.field(1).type), pa.array(s)], schema=out)

    return by_block(asked).cogroup(by_block(rows)).applyInArrow(run, f"query_id {query_kind}, id {id_kind}, score double")


def floors_of(probed: DataFrame, queries: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """query_id and floor: the exact cosine of the `most`-th best of the rows found for a query so far; none for a query with fewer. probed: query_id, found (one id)."""
    pairs = probed.join(index.select(F.col("id").alias("found"), F.col("embedding").alias("row")), "found").join(queries.select("query_id", "embedding"), "query_id")
    query_kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column(1).value_lengths())
            for dim in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == dim))
                row, query = (directions(matrix(part.column(i), dim)) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((row * query).sum(axis=1))], names=["query_id", "score"])

    scores = pairs.select("query_id", "row", "embedding").mapInArrow(run, f"query_id {query_kind}, score double")
    ranked = scores.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    return ranked.filter(F.col("place") == most).select("query_id", F.col("score").alias("floor"))


def nearest(index: DataFrame, queries: DataFrame, k: int = 5, epsilon: float = EPSILON, seed: int = SEED) -> DataFrame:
    """The k nearest rows of `index` to each of `queries` by cosine, but for the query's own id.

    index: from build_index with the same or a larger k and the same seed;
    queries: from usable. Returns query_id, rank (from 1), vec_id, score (cosine
    on the original vectors); equal scores go to the smaller vec_id. Only
    vectors of equal length are compared, at every length. A query with fewer
    candidates gets all of them, one without any gets no row.
    """
    small_batches(queries.sparkSession)
    query_kind, vector_kind = (queries.schema[c].dataType.simpleString() for c in ("vec_id", "embedding"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column(1).value_lengths())
            for dim in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == dim))
                planes, scalars = encode_query(matrix(part.column(1), dim), rotation(dim, seed))
                made = [pa.array([dim] * part.num_rows, pa.int32()), pa.array([p.tobytes() for p in planes], pa.binary()), pa.array(list(scalars), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=["query_id", "embedding", "dim", "planes", "scalars"])

    coded = queries.select("vec_id", "embedding").mapInArrow(code, f"query_id {query_kind}, embedding {vector_kind}, dim int, planes binary, scalars array<double>")
    asked, query_blocks = blocks_of(settle(coded), QUERY_NUMBERS, "query_id", "qb")
    dealt, row_blocks = blocks_of(index.select("id", "dim", "code", "scale"), ROW_NUMBERS, "id", "rb")
    codes = dealt.join(query_blocks, "dim").withColumn("qb", each_of("n_qb")).drop("n_qb")
    every = asked.drop("embedding").join(row_blocks, "dim").withColumn("rb", each_of("n_rb")).drop("n_rb")
    most = k + 1  # one of them may be the query itself

    few = PROBES * most
    first = probes(every, codes, few)
    pairs = first.select("dim", "qb", "rb", "query_id", F.explode(F.arrays_zip("found", "guess")).alias("p")).select("dim", "qb", "rb", "query_id", "p.found", "p.guess")
    top = Window.partitionBy("query_id").orderBy(F.desc("guess"), "found")
    probed = settle(pairs.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= few).drop("guess", "place"))
    # As near as the (k + 1)th of the vectors compared so far, the query's own among them, the last neighbour is at least.
    floors = settle(floors_of(probed, asked, index, most))
    again = every.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    left = settle(survivors(again, codes, most, epsilon))
    used = left.filter("query_id IS NULL").select("dim", "qb", "rb", F.explode(F.arrays_zip("ids", "places")).alias("u")).select("dim", "qb", "rb", F.col("u.ids").alias("id"), F.col("u.places").alias("place"))
    wanted = left.filter("query_id IS NOT NULL").select("dim", "qb", "rb", "query_id", "found")
    found = compare(wanted, used, asked, index, most).join(index.select("id", "ids"), "id")
    each = found.select("query_id", F.explode("ids").alias("vec_id"), "score").filter(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
