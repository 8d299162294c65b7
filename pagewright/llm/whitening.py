"""Whitening of embeddings by shifted Cholesky QR.

The centred vectors are the rows of a tall matrix that is never held: passes
over the table add up Gram matrices, task by task and then row by row of the
matrix. The Cholesky factor of the first Gram matrix, shifted so that it exists
whatever the rounding, makes the rows nearly orthonormal when each is solved
against it in its task; further passes over rows solved so finish that, and the
factors' product is the R of the matrix. R's singular values and vectors are
those of the matrix, without its Gram matrix having been decomposed, which would
lose half of the digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets, small_batches

#: How a component becomes a whole number, and the components returned.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Whole numbers of this size and beyond are no components: their sums over a table would not fit.
LIMIT = 1 << 52
#: Passes over the vectors at most, and how far from orthonormal the last one may find them.
PASSES, NEAR = 12, 1e-9
#: A direction whose variance is this part of the largest, or less, has none.
FLAT = 1e-20
UNIT = np.finfo(np.float64).eps / 2


class Fit(NamedTuple):
    """What the vectors of one length are whitened by."""

    n: int
    sums: np.ndarray
    axes: np.ndarray  # a component in each column
    values: np.ndarray  # their variances; 0 where the vectors do not vary
    explained: np.ndarray
    error: float | None


def by_length(keys: pa.Array, vectors: pa.ListArray) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Length, keys and whole numbers of the vectors of a batch that take part, one length after the other."""
    there = np.flatnonzero(~np.asarray(vectors.is_null()))
    sizes = np.asarray(vectors.take(pa.array(there)).value_lengths())
    for dim in np.unique(sizes).tolist():
        at = pa.array(there[sizes == dim])
        flat = vectors.take(at).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is not a number
        c = flat.reshape(len(at), dim)
        good = (np.abs(c) < LIMIT // SCALE).all(axis=1)
        if good.any():
            yield dim, keys.take(at.filter(pa.array(good))), np.floor(c[good] * SCALE).astype(np.int64) + SHIFT


def in_longs(x: np.ndarray, n: int, sums: np.ndarray) -> bool:
    """Whether n * x - sums can be taken in longs."""
    return max(n * int(np.abs(x).max(initial=0)), max(map(abs, sums.tolist()), default=0)) < 1 << 62


def apart(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact."""
    return n * x - sums.astype(np.int64) if in_longs(x, n, sums) else n * x.astype(object) - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows less their mean; the difference is taken between whole numbers."""
    return (apart(x, n, sums) / n).astype(np.float64)


Parts = Callable[[int, np.ndarray], list[np.ndarray]]


def added_up(vectors: DataFrame, part: Parts, kind: str) -> dict[int, list[np.ndarray]]:
    """By length, the sums over batches of the lists of rows that `part` makes of a length and its whole numbers.

    Each task adds up its batches; the tasks' sums meet row by row, so what one
    task adds and what the driver gets is bounded by the rows of a sum. vectors: key, vector; kind: long or double.
    """
    lists = pa.list_(pa.int64() if kind == "long" else pa.float64())
    out = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("v", lists)])

    def table(total: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        dims, places = zip(*total)
        return pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(places, pa.int32()), pa.array(list(total.values()), lists)], schema=out)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for dim, _, x in by_length(b.column(0), b.column(1)):
                for i, v in enumerate(part(dim, x)):
                    total[dim, i] = total[dim, i] + v if (dim, i) in total else v
        if total:
            yield table(total)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            flat, cuts = np.asarray(b.column(2).flatten()), offsets(np.asarray(b.column(2).value_lengths()))
            for k, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                v = flat[cuts[k] : cuts[k + 1]]
                total[key] = total[key] + v if key in total else v.copy()
        if total:
            yield table(total)

    schema = f"dim int, i int, v array<{kind}>"
    found: dict[int, list[np.ndarray]] = {}
    for r in sorted(vectors.mapInArrow(local, schema).repartition("dim", "i").mapInArrow(meet, schema).collect()):
        found.setdefault(r["dim"], []).append(np.array(r["v"], np.int64 if kind == "long" else np.float64))
    return found


def sums_by_length(vectors: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """By length, the number of vectors and the sum of each component, exact: high and low halves are added up apart."""

    def part(dim: int, x: np.ndarray) -> list[np.ndarray]:
        return [(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), np.array([len(x)])]

    found = added_up(vectors, part, "long")
    return {dim: (int(n[0]), high.astype(object) * (1 << 32) + low.astype(object)) for dim, (high, low, n) in found.items()}


def solved(y: np.ndarray, factors: tuple[np.ndarray, ...]) -> np.ndarray:
    """Rows solved against upper triangular factors one after the other, column by column."""
    for r in factors:
        q = np.empty_like(y)
        for j in range(len(r)):
            q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        y = q
    return y


def square_root(gram: np.ndarray) -> np.ndarray:
    """A factor of a Gram matrix that may be singular."""
    w, v = np.linalg.eigh(gram)
    return np.sqrt(np.maximum(w, 0))[:, None] * v.T


def gram(vectors: DataFrame, dim: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The Gram matrix and the sums of the rows made of the vectors of one length."""

    def part(length: int, x: np.ndarray) -> list[np.ndarray]:
        if length != dim:
            return []
        y = rows_of(x)
        return [*(y.T @ y), y.sum(axis=0)]

    found = np.array(added_up(vectors, part, "double")[dim])
    return found[:-1], found[-1]


def orthogonalised(vectors: DataFrame, dim: int, n: int, sums: np.ndarray) -> np.ndarray:
    """A square matrix with the singular values and right singular vectors of the centred rows."""
    factors: list[np.ndarray] = []
    product = np.eye(dim)
    while True:
        g, _ = gram(vectors, dim, lambda x, use=tuple(factors): solved(centred(x, n, sums), use))
        w = np.linalg.eigvalsh(g)
        # Directions in which nothing varies stay at nothing; all others must have come to length one.
        if len(factors) == PASSES or not w[-1] > 0 or (len(factors) > 1 and all(abs(x - 1) <= NEAR or x <= NEAR for x in w)):
            return square_root(g) @ product
        shift = 11 * (n * dim + dim * (dim + 1)) * UNIT * w[-1] * np.eye(dim)
        try:
            r = np.linalg.cholesky(g if factors else g + shift).T
        except np.linalg.LinAlgError:
            r = np.linalg.cholesky(g + shift).T
        factors.append(r)
        product = r @ product


def fit(vectors: DataFrame, dim: int, n: int, sums: np.ndarray, most: int) -> Fit:
    """Components of the vectors of one length: variances and axes by R, then how far from the identity the whitened rows' covariance is."""
    if not dim:
        return Fit(n, sums, np.zeros((0, 0)), np.zeros(0), np.zeros(0), None)
    _, s, vt = np.linalg.svd(orthogonalised(vectors, dim, n, sums))
    values = s * s / n
    values[values <= FLAT * values[0]] = 0
    vt *= np.where(vt[np.arange(dim), np.abs(vt).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]  # the largest entry of an axis is positive
    explained = values / values.sum() if values[0] > 0 else np.zeros(dim)
    made = Fit(n, sums, vt[:most].T, values[:most], explained[:most], None)
    alive = int(np.count_nonzero(made.values))
    if not alive:
        return made
    g, total = gram(vectors, dim, lambda x: whitened(x, made)[:, :alive])
    return made._replace(error=float(np.abs(g / n - np.outer(total, total) / n**2 - np.eye(alive)).max()))


def whitened(x: np.ndarray, by: Fit) -> np.ndarray:
    """Rows on the components, each of variance one; not a number where the vectors do not vary."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(by.values > 0, centred(x, by.n, by.sums) @ by.axes / np.sqrt(by.values), np.nan)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum over components of (n * x - sum) squared, exact; None beyond what a long holds."""
    far = apart(x, n, sums)
    if far.dtype == np.int64 and int(np.abs(far).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
        return (far * far).sum(axis=1).tolist()
    exact = (sum(v * v for v in row) for row in far.astype(object).tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, most: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: key, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry are left out,
    and those with an entry of 2**46 or more, whose whole number
    floor(64 * entry) + 1,000,000 would not add up in a long. The others make up
    the fit list; vectors of different lengths have nothing in common, so each
    length is fitted by its own, in passes of its own. n: vectors of the length;
    deviation: sum over components of (n * x - sum of x) squared, null beyond a
    long; whitened: the first `most` components by falling variance, each of
    variance one; explained: their share of all variance; identity_error: the
    largest entry of the whitened rows' covariance less the identity. Where
    vectors do not vary (a single vector, repeated ones, fewer than components)
    a component's whitened value is null and its share 0; identity_error covers the others
    and is null if there is none. Components of equal variance come in any
    order. An axis' largest entry is positive. A null key stays null, and
    repeated rows each count and each get a row; a vector of length 0 has no
    components. Other columns are ignored; no rows give no rows.

    The driver and every task hold matrices of length times length, whatever the number of rows.
    """
    small_batches(vectors.sparkSession)
    narrow = vectors.select(F.col(key).alias("vec_key"), F.col(vector).alias("vec"))
    kind = narrow.schema["vec_key"].dataType.simpleString()
    fits = {dim: fit(narrow, dim, n, sums, most) for dim, (n, sums) in sums_by_length(narrow).items()}
    lists = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, keys, x in by_length(b.column(0), b.column(1)):
                by = fits[dim]
                w = whitened(x, by)
                flat = pa.array(w.reshape(-1), pa.float64(), from_pandas=True)  # not a number is null
                cuts = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
                same = lambda v, t: pa.array([v] * len(x), t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [keys, same(by.n, pa.int64()), pa.array(deviations(x, by.n, by.sums), pa.int64()), pa.ListArray.from_arrays(cuts, flat),
                     same(by.explained.tolist(), lists), same(by.error, pa.float64())],
                    names=["vec_key", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    made = narrow.mapInArrow(run, f"vec_key {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    return made.withColumnRenamed("vec_key", key)
