"""Mixing sources to target weights by Poisson replication (built-in expressions only).

Each document is repeated by an independent Poisson count whose mean is its
source's repetition rate. The count comes from inverting the distribution at a
uniform number hashed from (seed, doc_id), so a lost executor recomputes the
same counts. The copies are then dealt into one global random order, again by
a hash.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest mean inverted in one piece; a larger mean is a sum of equal independent parts.
PIECE = 32.0
#: Terms kept beyond the mean: the rest of a Poisson(32) beyond 32 + 96 is under 1e-28.
TERMS = 128
#: Sources up to which their rates are sent to every task; more are joined by a shuffle, salted.
FEW_SOURCES = 10_000
SALTS = 64
#: Hex digits of an md5 that make one uniform number (52 bits).
HEX = 13


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from the md5 of the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, HEX), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**HEX))


def poisson_steps(mean: Column) -> Column:
    """P(Poisson(mean) <= k) for k from 0 on, for a mean up to PIECE, as far as a uniform number may lie above it."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("below"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["below"], F.array(F.element_at(state["below"], -1) + p)).alias("below"))

    every = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["below"])
    return F.filter(every, lambda x: x < F.lit(1 - 1e-16))


def poisson_quantile(u: Column, steps: Column) -> Column:
    """Smallest k with P(Poisson <= k) >= u."""
    return F.size(F.filter(steps, lambda x: x < u))


def source_rates(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, exponent: float = 0.5, total: float | None = None
) -> DataFrame:
    """One row per source: `mix_source`, its size in rows and the mean repetition rate that gives its weight.

    weights: target shares of the output rows by source, scaled to sum 1; a
    source left out gets none. Without weights a source's share is its row
    count to the power `exponent`. total: expected rows out, the input's rows
    where None.
    """
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(F.count("*").alias("n_rows"))
    if weights is not None:
        bad = [w for w in weights.values() if not (w >= 0 and math.isfinite(w))]
        if bad or not weights or sum(weights.values()) <= 0:
            raise ValueError("weights must be finite, not negative and not all zero")
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    else:
        share = F.pow(F.col("n_rows").cast("double"), F.lit(float(exponent)))
    shared = sizes.withColumn("share", share)
    sums = shared.agg(F.sum("share").alias("all_shares"), F.sum("n_rows").alias("all_rows"))
    aim = F.lit(float(total)) if total is not None else F.col("all_rows").cast("double")
    rate = aim * F.col("share") / F.col("all_shares") / F.col("n_rows")
    return shared.crossJoin(F.broadcast(sums)).select(
        "mix_source", "n_rows", F.coalesce(F.round(rate, 9), F.lit(0.0)).alias("rate")
    )


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    exponent: float = 0.5,
    total: float | None = None,
    seed: int = 17,
) -> DataFrame:
    """Repeat each document by a Poisson count and deal all copies into one random order.

    Needs the columns doc_id and source; every other column is kept. Adds
    `mix_rate`, `mix_copies` (the document's count), `mix_copy` (from 1) and
    `mix_order` (place in the global order, ascending), replacing input columns
    of these names; input columns `mix_source`, `mix_salt`, `mix_part`,
    `mix_parts` and `mix_steps` are dropped. A null source is a source of its own; rows that repeat a
    doc_id share its count; a null doc_id counts as the empty text. Copies with
    the same `mix_order` are in the order of `mix_copy`, then of their other
    columns. No rows give no rows. One source holding most rows is no hot key: rates are sent to
    every task or, beyond FEW_SOURCES sources, joined on (source, salt).
    """
    docs = docs.drop("mix_rate", "mix_copies", "mix_copy", "mix_order", "mix_source", "mix_salt", "mix_part", "mix_parts", "mix_steps")
    kept = docs.columns
    # All that depends on the source alone is worked out once for each.
    parts = F.greatest(F.ceil(F.col("mix_rate") / PIECE), F.lit(1)).cast("int")
    rates = source_rates(docs, weights, exponent, total).select("mix_source", F.col("rate").alias("mix_rate")).withColumn("mix_parts", parts)
    rates = rates.withColumn("mix_steps", poisson_steps(F.col("mix_rate") / F.col("mix_parts")))
    if rates.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        rated = docs.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("mix_source")))
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        spread = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = docs.withColumn("mix_part", salt).join(
            spread, F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("mix_part") == F.col("mix_salt"))
        )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("mix_parts")), F.lit(0), lambda sum_, i: sum_ + poisson_quantile(uniform(F.lit(seed), key, i), F.col("mix_steps"))
    )
    copies = rated.withColumn("mix_copies", F.when(F.col("mix_rate") > 0, count).otherwise(0)).filter("mix_copies > 0")
    dealt = copies.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    order = F.conv(
        F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), key, F.col("mix_copy").cast("string"))), 1, HEX), 16, 10
    ).cast("long")
    placed = dealt.select(*kept, "mix_rate", "mix_copies", "mix_copy", order.alias("mix_order"))
    # Places are uniform, so equal ranges of them hold like numbers of copies: no pass over the input has to find the ranges.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionById(n, F.floor(F.col("mix_order") / F.lit(16**HEX) * n).cast("int"))
    ties = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return ranged.sortWithinPartitions("mix_order", "mix_copy", *[F.col(f"`{c}`") for c in ties])
