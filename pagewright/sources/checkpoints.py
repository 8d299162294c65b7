"""Writing an intermediate table to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Tables written in this process, by the application they belong to.
WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A temporary one is made only on a local master where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and give it back from there, so that later reads start at the files, with the columns they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what settle wrote for this application; for when the results that rest on it have been read."""
    sc = spark.sparkContext
    for path in WRITTEN.pop(sc.applicationId, []):
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
