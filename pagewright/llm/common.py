"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches
from ..sources.checkpoints import settle  # noqa: F401

MASK = (1 << 64) - 1

#: Classes of a classifier at most.
MOST_CLASSES = 1000

#: A key with this part of all rows or more is hot, so that at most so many are; and the parts a hot key's rows are dealt to.
HOT, SALTS = 1000, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Python worker gets at once, whatever the length of the texts; also, unions keep no partitioning (see functions.unions)."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    batches.small_batches(spark)


def held_out(doc_id: Column) -> Column:
    """True for the rows no label may be learned from: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) fixed by the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def bounded_sample(df: DataFrame, key: str, by: str, bound: int, seed: int) -> tuple[DataFrame, dict]:
    """About `bound` rows of each class of `by`, chosen by a hash of `key`; also the classes' row counts.

    Of more than MOST_CLASSES classes the largest are taken, of equally large
    ones the first in order; rows of the others are in no sample.
    """
    sizes = df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(MOST_CLASSES)
    counts = {r[by]: r["n"] for r in sizes.collect()}
    if not counts:
        return df.limit(0), counts
    rates = df.sparkSession.createDataFrame([(k, min(1.0, bound / n)) for k, n in counts.items()], f"{by} {df.schema[by].dataType.simpleString()}, sample_rate double")
    sampled = df.join(F.broadcast(rates), by).filter(unit_hash(F.col(key), F.lit(seed)) < F.col("sample_rate"))
    return sampled.select(*df.columns), counts


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The keys that hold a HOT-th of `total` rows or more: HOT of them at most. counts: a row per key with its number of rows `n`."""
    return counts.filter(F.col(n) * HOT >= total).select(key)


def spread_join(rows: DataFrame, unique: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with the one row that `unique` has for each key, the rows of hot keys dealt to SALTS tasks each.

    hot: keys from hot_keys, few enough by their definition to be sent to every
    task. Only their rows of `unique` are repeated. A null key has no partner.
    """
    flag = F.broadcast(hot.select(F.col(key).alias("hot_key"), F.lit(True).alias("is_hot")))
    flagged = lambda df: df.join(flag, F.col(key) == F.col("hot_key"), "left").drop("hot_key")
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0)
    salts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = flagged(rows).withColumn("salt", salt.cast("int")).drop("is_hot")
    right = flagged(unique).withColumn("salt", F.explode(salts)).drop("is_hot")
    return left.join(right, [key, "salt"], how).drop("salt")


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def offsets(sizes: Iterable[int]) -> np.ndarray:
    """Starts of consecutive runs of the given sizes, and the end of the last."""
    sizes = sizes if isinstance(sizes, np.ndarray) else np.fromiter(sizes, np.int64)
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def strings(column) -> list[str]:
    """An Arrow string column as Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]
