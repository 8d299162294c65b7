"""Batches that Python workers get."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows an Arrow batch holds at most, and its bytes where Spark knows the setting; long texts make batches heavy.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Python worker gets at once, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
