"""The usage ledger: rows are appended, and what holds now is derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "usage_id BIGINT, service STRING, api_key_id BIGINT, status STRING, ts TIMESTAMP, source_language STRING, target_language STRING, source_size BIGINT, target_size BIGINT, method STRING, engine_id BIGINT, extra STRING"


def open_usage(requests: DataFrame) -> DataFrame:
    """Ledger rows that say requests are in progress; columns a request lacks are null."""
    kinds = dict(x.strip().split(" ") for x in COLUMNS.split(","))
    have = set(requests.columns)
    made = requests.withColumn("status", F.lit("IN_PROGRESS"))
    return made.select(*[(F.col(n) if n in have | {"status"} else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def close_usage(opened: DataFrame, results: DataFrame) -> DataFrame:
    """Ledger rows with the final status and target size of finished requests.

    results: usage_id, ok BOOLEAN, ts, target_size.
    """
    done = results.select("usage_id", "ok", F.col("ts").alias("done_ts"), F.col("target_size").alias("done_size"))
    status = F.when(F.col("ok"), "SUCCESS").otherwise("FAILED")
    joined = opened.join(done, "usage_id")
    return joined.withColumn("status", status).withColumn("ts", F.col("done_ts")).withColumn("target_size", F.col("done_size")).select(*opened.columns)


def append_usage(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_once(path: str, stream: str = "usage") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends each micro-batch of a stream to the ledger once, however often it is written.

    A batch has a folder of its own by the stream's name and its number, which is
    written anew when a batch comes again after a failure. A stream that starts over with a new checkpoint needs another name.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/stream={stream}/batch={number}")

    return write


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a ledger that streams append to."""
    return spark.read.parquet(path).drop("stream", "batch")
