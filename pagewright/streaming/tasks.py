"""Documents and task events as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.unions import union
from ..plans.steps import Parser, Sniffed, Step, run_pipeline
from ..sources.files import decode_text


def read_documents(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """Rows of files as they arrive."""
    return spark.readStream.schema(schema).format(form).load(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as they arrive, page layouts and plain text alike: path, encoding, confidence, content (null where it cannot be decoded)."""
    kinds = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.schema(kinds).format("binaryFile").load(path).select("path", F.col("content").alias("raw"))
    return decode_text(found, "raw").drop("raw").withColumnRenamed("text", "content")


def process(docs: DataFrame, steps: Sequence[Step], reconstruct: bool = True, parser: Parser | None = None) -> DataFrame:
    """A stream's documents through a pipeline; each row by itself, so the result appends. By default each row's format is sniffed."""
    return run_pipeline(docs, parser or Sniffed(), steps, reconstruct)


def task_status(events: DataFrame) -> DataFrame:
    """task_id, status, ts, error: the latest event of each task. events: task_id, status, ts, error."""
    last = F.max_by(F.struct("status", "ts", "error"), F.struct("ts", "status")).alias("last")
    return events.groupBy("task_id").agg(last).select("task_id", "last.status", "last.ts", "last.error")


def upsert_into(path: str, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on a stream of task events: keeps a table of each task's latest event, in `parts` parts by a hash of the task.

    Only the parts that a batch touches are read and replaced, so the table is
    there once, and the stream itself keeps no state. A batch that comes again
    changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("part", F.pmod(F.xxhash64("task_id"), F.lit(parts)).cast("int")).persist()
        touched = [r["part"] for r in new.select("part").distinct().collect()]
        try:
            before = spark.read.parquet(path).filter(F.col("part").isin(touched)).select(*new.columns)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            before = new.limit(0)
        last = task_status(union(before, new)).withColumn("part", F.pmod(F.xxhash64("task_id"), F.lit(parts)).cast("int"))
        if touched:
            last.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        new.unpersist()

    return write


def live_results(results: DataFrame, key: str = "task_id", ts: str = "ts", keep: str = "24 hours") -> DataFrame:
    """The first result of each task, forgotten when the stream's time has passed it by `keep`."""
    return results.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


def expired_results(results: DataFrame, key: str = "task_id", ts: str = "ts", keep: str = "24 hours") -> DataFrame:
    """key, ts of results once the stream's time has passed them by `keep`."""
    seconds = int(pd.Timedelta(keep).total_seconds() * 1000)
    kind = results.schema[key].dataType.simpleString()

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (at,) = state.get
            state.remove()
            yield pd.DataFrame([(keys[0], pd.Timestamp(at, unit="ms"))], columns=[key, ts])
            return
        at = state.get[0] if state.exists else 0
        for frame in frames:
            at = max(at, int(frame[ts].max().timestamp() * 1000))
        state.update((at,))
        state.setTimeoutTimestamp(max(at + seconds, state.getCurrentWatermarkMs() + 1))

    return (
        results.select(key, ts).withWatermark(ts, "0 seconds").groupBy(key)
        .applyInPandasWithState(step, f"`{key}` {kind}, `{ts}` timestamp", "at long", "append", GroupStateTimeout.EventTimeTimeout)
    )


#: Fixed value: the state store that state by member needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Members(StatefulProcessor):
    """The members of a batch that are done, each an entry of its own, and how many there are.

    A micro-batch reads and writes only the entries of the members it brings. Once
    the batch is complete they go, and only that it was told stays. All of it is forgotten `keep` milliseconds after it was last written.
    """

    def __init__(self, key: str, keep: int):
        self.key, self.keep = key, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "member string", "ok boolean", self.keep)
        self.counts = handle.getValueState("counts", "done int, failed int, expected int, told boolean", self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, failed, expected, told = self.counts.get() if self.counts.exists() else (0, 0, 0, False)
        for frame in rows:
            sizes = frame["expected"].dropna()
            expected = max(expected, int(sizes.max()) if len(sizes) else 0)
            if told:
                continue
            for m, ok in zip(frame["member"], frame["ok"]):
                if m is None or self.seen.containsKey((m,)):
                    continue
                ok = bool(ok) if ok is not None and ok == ok else False
                self.seen.updateValue((m,), (ok,))
                done, failed = done + 1, failed + (not ok)
        if not told and expected and done >= expected:
            told = True
            self.seen.clear()
            yield pd.DataFrame([(key[0], done, failed)], columns=[self.key, "n_done", "n_failed"])
        self.counts.update((done, failed, expected, told))

    def close(self) -> None:
        pass


def completed_batches(members: DataFrame, keep_hours: int = 24) -> DataFrame:
    """batch_id, n_done, n_failed of each batch once all its members are done, once only.

    members: batch_id, member, expected, ok. The same member told twice counts
    once; a null member is none, a null `expected` says nothing, a null `ok` is a failure. What is not written for `keep_hours` is
    forgotten: members of a batch that stays incomplete, and that a batch was
    complete. State is kept by member in the session's RocksDB store, which this sets.
    Processing time always asks for another batch, so a stream that is to end by
    itself (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off.
    """
    members.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = members.schema["batch_id"].dataType.simpleString()
    told = members.select("batch_id", F.col("member").cast("string").alias("member"), "expected", "ok")
    return told.groupBy("batch_id").transformWithStateInPandas(
        Members("batch_id", keep_hours * 3_600_000), f"batch_id {kind}, n_done int, n_failed int", "append", "processingTime"
    )
