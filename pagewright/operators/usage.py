"""Questions to the usage ledger, its keys, organisations and engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: What a usage row's status may be.
STATUSES = ("PENDING", "IN_PROGRESS", "SUCCESS", "FAILED")


def is_ready(status: Column) -> Column:
    """Whether a task has come to an end, well or not."""
    return F.coalesce(status.isin("SUCCESS", "FAILED"), F.lit(False))


def usable_keys(keys: DataFrame, organisations: DataFrame, now: Column | None = None) -> DataFrame:
    """Keys of active organisations that are not revoked and, at `now`, not expired.

    keys: id, organisation_id, name, revoked, expiry_date.
    """
    active = organisations.filter("active").select(F.col("id").alias("organisation_id"), F.col("name").alias("organisation"))
    found = keys.filter(~F.coalesce("revoked", F.lit(False))).join(active, "organisation_id")
    return found if now is None else found.filter(F.col("expiry_date").isNull() | (F.col("expiry_date") > now))


def usage_by_key(usage: DataFrame, keys: DataFrame, organisations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests, sizes and failures by organisation, key and service (or the columns given).

    Usage is summed by key before it meets the dimensions, so only a row per key
    and service is joined.
    """
    by = by or ["organisation", "key_name", "service"]
    extra = [c for c in by if c not in ("organisation", "key_name")]
    sums = usage.groupBy("api_key_id", *extra).agg(
        F.count("*").alias("n_requests"),
        F.sum("source_size").alias("source_size"),
        F.sum("target_size").alias("target_size"),
        F.count_if(F.col("status") == "FAILED").alias("n_failed"),
    )
    named = keys.select(F.col("id").alias("api_key_id"), F.col("name").alias("key_name"), "organisation_id")
    owners = organisations.select(F.col("id").alias("organisation_id"), F.col("name").alias("organisation"))
    joined = sums.join(named, "api_key_id").join(owners, "organisation_id")
    measures = ["n_requests", "source_size", "target_size", "n_failed"]
    return joined.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])


def latest(usage: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return usage.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def latest_status(usage: DataFrame, keys: list[str], ts: str = "ts", tie: str = "usage_id") -> DataFrame:
    """keys, status, ts, ready of the last row of each key, by a partial aggregate rather than a sort."""
    found = usage.groupBy(*keys).agg(F.max_by(F.struct("status", ts), F.struct(ts, tie)).alias("last"))
    return found.select(*keys, "last.status", F.col(f"last.{ts}").alias(ts), is_ready(F.col("last.status")).alias("ready"))


def resolve_engine(requests: DataFrame, engines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their engine's name, and those whose engine is not known."""
    known = engines.select(F.col("id").alias("engine_id"), F.col("name").alias("engine"))
    return requests.join(known, "engine_id"), requests.join(known, "engine_id", "left_anti")


def default_engine(engines: DataFrame) -> DataFrame:
    """The engine with the smallest id."""
    return engines.orderBy("id").limit(1)


def drifted_options(local: DataFrame, online: DataFrame, name: str = "name") -> DataFrame:
    """Options known here that the service no longer offers."""
    return local.join(online.select(name).distinct(), name, "left_anti")


def find_by_name(rows: DataFrame, catalogue: DataFrame, name: str = "name") -> DataFrame:
    """Rows joined to a catalogue by name, whatever the case."""
    found = catalogue.withColumn("_l", F.lower(name)).withColumnRenamed(name, "catalogue_name")
    return rows.withColumn("_l", F.lower(name)).join(found, "_l").drop("_l")


def search(usage: DataFrame, text: str, column: str) -> DataFrame:
    """Rows whose column holds a text, whatever the case; % and _ stand for themselves."""
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return usage.filter(F.col(column).ilike(f"%{safe}%"))


def text_size(lines: Column) -> Column:
    """Characters of a list of lines, as they are metered."""
    return F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))


def file_size(content: Column) -> Column:
    """Characters of a text file, as they are metered: without white space at its ends."""
    return F.length(strip(content))


def byte_size(content: Column) -> Column:
    """Bytes of a binary file or an image, as they are metered."""
    return F.octet_length(content)


def extra_field(extra: Column, name: str) -> Column:
    """A field of the ledger's free JSON column."""
    return F.get_json_object(extra, f"$.{name}")


def extra_json(**fields: Column) -> Column:
    """The ledger's free JSON column from fields; null or empty ones are left out, and without any it is null."""
    given = [F.when(c != "", c).alias(name) for name, c in fields.items()]
    return F.when(F.coalesce(*given).isNotNull(), F.to_json(F.struct(*given)))
