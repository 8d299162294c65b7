"""Plain text, batches of files and their results."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_name

#: A text that is decoded with less confidence is refused.
LEAST_CONFIDENCE = 0.5
#: Bytes that stand for other characters in windows-1252 than in ISO 8859-1.
WINDOWS = [c for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


def decode_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Add `encoding`, `confidence` and `text` (null where refused).

    A byte-order mark settles the encoding; else valid UTF-8 is UTF-8 (plain
    ASCII too); else the bytes are taken as windows-1252 if none of them is
    undefined there, with confidence falling with the share of control bytes.
    """
    c = F.col(content)
    head = F.hex(F.substring(c, 1, 4))
    mark = (
        F.when(head.startswith("EFBBBF"), "UTF-8")
        .when(head.startswith("FFFE0000") | head.startswith("0000FEFF"), F.lit("UTF-32"))
        .when(head.startswith("FFFE"), "UTF-16LE")
        .when(head.startswith("FEFF"), "UTF-16BE")
    )
    clean = F.is_valid_utf8(c.cast("string"))
    controls = F.length(c) - F.length(F.regexp_replace(F.decode(c, "ISO-8859-1"), "[\\x00-\\x08\\x0E-\\x1F\\x7F\\x81\\x8D\\x8F\\x90\\x9D]", ""))
    share = controls / F.greatest(F.length(c), F.lit(1))
    found = files.withColumn("encoding", F.coalesce(mark, F.when(clean, "UTF-8"), F.lit("windows-1252")))
    sure = F.when(mark.isNotNull() | clean, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(0.73) - 5 * share))
    body = lambda name: F.decode(c, name)
    text = (
        F.when(F.col("encoding") == "UTF-8", F.when(clean, body("UTF-8")))
        .when(F.col("encoding") == "UTF-16LE", body("UTF-16LE"))
        .when(F.col("encoding") == "UTF-16BE", body("UTF-16BE"))
        .when(F.col("encoding") == "UTF-32", body("UTF-32"))
        .otherwise(F.translate(body("ISO-8859-1"), "".join(map(chr, WINDOWS)), "".join(bytes([c]).decode("cp1252") for c in WINDOWS)))
    )
    return found.withColumn("confidence", sure).withColumn(
        "text", F.when(F.col("confidence") >= LEAST_CONFIDENCE, F.regexp_replace(text, "^\\uFEFF", ""))
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table kept as Parquet."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of plain text files: path, text."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_text_lines(lines: DataFrame, path: str, text: str = "text") -> None:
    lines.select(F.col(text).alias("value")).write.text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size and content of binary files, such as page images."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), "content")


def read_json_dimension(spark: SparkSession, path: str) -> DataFrame:
    """A small dimension table kept as a JSON list: pk and the fields beside it."""
    return spark.read.option("multiLine", True).json(path).select("pk", "fields.*")


def unzip(batches: DataFrame, key: str = "batch_id", content: str = "content") -> DataFrame:
    """Members of ZIP batches: key, member, content, error.

    Only files at the top level count. A batch that is no ZIP, is empty or holds
    a member whose path leads out of it gives one row with an error and no member.
    """
    kind = batches.schema[key].dataType.simpleString()

    def members(data: bytes | None) -> list[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                names = [i for i in z.infolist() if not i.is_dir()]
                if any(n.filename.startswith(("/", "\\")) or ".." in n.filename.replace("\\", "/").split("/") or ":" in n.filename for n in names):
                    return [(None, None, "unsafe path")]
                found = [(i.filename, z.read(i), None) for i in names if "/" not in i.filename]
                return found or [(None, None, "empty")]
        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):
            return [(None, None, "not a ZIP file")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, data in zip(frame[key], frame[content]):
                yield pd.DataFrame([(k, *m) for m in members(data)], columns=[key, "member", "content", "error"])

    return batches.select(key, content).mapInPandas(run, f"`{key}` {kind}, member string, content binary, error string")


def bundle(results: DataFrame, key: str = "batch_id", ext: str | Column = ".txt") -> DataFrame:
    """One ZIP per batch from rows (key, filename, parts ARRAY<STRING>): key, content, n_members.

    Names are made safe and get the extension, one for all or each its own; a name that comes again in a
    batch gets a number. A member's parts are joined by an empty line.
    """
    kind = results.schema[key].dataType.simpleString()
    rows = results.select(key, safe_name(F.col("filename"), ext).alias("name"), F.array_join("parts", "\n\n").alias("body"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out, used = io.BytesIO(), {}
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in sorted(zip(frame["name"], frame["body"])):
                used[name] = used.get(name, 0) + 1
                stem, dot, end = name.rpartition(".")
                unique = name if used[name] == 1 else f"{stem} ({used[name]}){dot}{end}"
                z.writestr(zipfile.ZipInfo(unique, (1980, 1, 1, 0, 0, 0)), body)
        return pd.DataFrame([(frame[key].iloc[0], out.getvalue(), len(frame))], columns=[key, "content", "n_members"])

    return rows.groupBy(key).applyInPandas(run, f"`{key}` {kind}, content binary, n_members long")


def assemble(pages: DataFrame, keys: list[str], order: str, text: str, by: str = "\n") -> DataFrame:
    """keys, text: results of single pages joined in page order; a null page counts as empty."""
    part = F.struct(F.col(order).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("part"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["part"]), by)
    return pages.groupBy(*keys).agg(joined.alias("text"), F.count("*").alias("n_pages"))


def collect_batch(results: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key, results: the rows of each batch as structs, in order."""
    row = F.struct(order, *[c for c in columns if c != order])
    return results.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("results"), F.count("*").alias("n_results"))


def is_image(content_type: Column) -> Column:
    """Whether something fetched is an image, by its content type."""
    return F.coalesce(F.lower(content_type).startswith("image/"), F.lit(False))


def split_rejects(rows: DataFrame, good: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others with a `reason`."""
    return rows.filter(good), rows.filter(~F.coalesce(good, F.lit(False))).withColumn("reason", F.lit(reason))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores where there are fewer files than cores; else as they are, without a shuffle.

    For work that costs more than moving its input, such as edit distances.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows
