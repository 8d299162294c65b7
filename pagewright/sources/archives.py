"""ZIP archives as a data source: members read in parallel, archives written whole or not at all.

    register(spark)
    spark.read.format("zip").load(folder)              # or readStream
    rows.write.format("zip").mode("append").save(folder)

Reading plans from the archives' directories alone: each says where its members
are and how large, and these are dealt to partitions of like bytes. Writing
takes archive, member and content; each task writes its archives beside their
places, and only when all tasks are done are they moved there.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "archive string, member string, size long, content binary, error string"
#: Bytes of members, unpacked, that a partition reads, about.
BYTES = 64 << 20
#: Bytes of an archive that is read whole.
SMALL = 1 << 16
#: Where archives are that are still written; names with this start are never read.
UNFINISHED = "_unfinished"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def archives_in(path: str) -> list[tuple[int, str]]:
    """Time of change (nanoseconds) and path of the archives of a folder, or of the one archive, the oldest first."""
    system, at = opened(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    return sorted((x.mtime_ns or 0, x.path) for x in found if x.type == fs.FileType.File and x.path.endswith(".zip") and not x.base_name.startswith("_"))


def readable(system: fs.FileSystem, archive: str) -> BinaryIO:
    """An archive to read from; a small one is in memory, as a directory is sought beyond its beginning."""
    if system.get_file_info(archive).size > SMALL:
        return system.open_input_file(archive)
    with system.open_input_file(archive) as f:
        return io.BytesIO(f.read())


def is_unsafe(name: str) -> bool:
    return name.startswith(("/", "\\")) or ":" in name or ".." in name.replace("\\", "/").split("/")


@dataclass
class Members(InputPartition):
    """Members to read: (archive, names); no names where the archive cannot be read, and why."""

    parts: list[tuple[str, list[str], str | None]]


def planned(path: str, archives: Sequence[str], most: int) -> list[Members]:
    """Partitions of members of about `most` bytes, told from the archives' directories."""
    system, _ = opened(path)
    out, here, size = [], [], 0
    for archive in archives:
        try:
            with readable(system, archive) as f, zipfile.ZipFile(f) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
        except (zipfile.BadZipFile, OSError, EOFError, ValueError):
            here.append((archive, [], "not a ZIP file"))
            continue
        if any(is_unsafe(i.filename) for i in infos) or not infos:
            here.append((archive, [], "unsafe path" if infos else "empty"))
            continue
        names: list[str] = []
        for i in infos:
            if size and size + i.file_size > most:
                if names:
                    here.append((archive, names, None))
                out.append(Members(here))
                here, names, size = [], [], 0
            names.append(i.filename)
            size += i.file_size
        here.append((archive, names, None))
    return [*out, Members(here)] if here else out


def members_of(path: str, partition: Members) -> Iterator[tuple]:
    """Rows of SCHEMA; a member that is damaged has an error and no content."""
    system, _ = opened(path)
    for archive, names, error in partition.parts:
        if error:
            yield archive, None, None, None, error
            continue
        with readable(system, archive) as f, zipfile.ZipFile(f) as z:
            for name in names:
                try:
                    data = z.read(name)
                    yield archive, name, len(data), data, None
                except Exception as e:  # noqa: BLE001  whatever a damaged or encrypted member raises is its error
                    yield archive, name, None, None, f"{type(e).__name__}: {e}"


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("bytes", BYTES))

    def partitions(self) -> list[Members]:
        return planned(self.path, [a for _, a in archives_in(self.path)], self.most) or [Members([])]

    def read(self, partition: Members) -> Iterator[tuple]:
        yield from members_of(self.path, partition)


class StreamReader(DataSourceStreamReader):
    """Archives as they come, by time of change and path."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("bytes", BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = archives_in(self.path)
        return dict(zip(("time", "path"), found[-1])) if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Members]:
        place = lambda o: (o["time"], o["path"])
        return planned(self.path, [a for t, a in archives_in(self.path) if place(start) < (t, a) <= place(end)], self.most)

    def read(self, partition: Members) -> Iterator[tuple]:
        yield from members_of(self.path, partition)


@dataclass
class Written(WriterCommitMessage):
    """Names of the archives that a task has written to its own folder."""

    folder: str
    names: list[str]


class Writer(DataSourceWriter):
    """Archives of rows that come sorted by archive; what is not committed is deleted."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite, self.job = options["path"], columns, overwrite, uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, at = opened(self.path)
        folder = f"{at}/{UNFINISHED}-{self.job}/{uuid4().hex}"
        system.create_dir(folder)
        names, stream, z, used = [], None, None, set()
        try:
            for row in rows:
                archive, member, content = (row[self.columns.index(c)] for c in ("archive", "member", "content"))
                if is_unsafe(member) or is_unsafe(archive) or "/" in archive:
                    raise ValueError(f"unsafe path {archive}, {member}")
                if not names or archive != names[-1]:
                    if archive in names:
                        raise ValueError(f"rows of {archive} do not stand together")
                    if z:
                        z.close()
                        stream.close()
                    stream = system.open_output_stream(f"{folder}/{archive}.zip")
                    z, used = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), set()
                    names.append(archive)
                if member in used:
                    raise ValueError(f"{member} stands twice in {archive}")
                used.add(member)
                z.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), bytes(content or b""), zipfile.ZIP_DEFLATED)
        finally:
            if z:
                z.close()
                stream.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        done = [m for m in messages if m]
        every = [n for m in done for n in m.names]
        if len(set(every)) < len(every):
            self.abort(messages)
            raise ValueError("rows of one archive came from several tasks")
        if self.overwrite:
            for _, old in archives_in(self.path):
                system.delete_file(old)
        for m in done:
            for name in m.names:
                system.move(f"{m.folder}/{name}.zip", f"{at}/{name}.zip")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        if system.get_file_info(f"{at}/{UNFINISHED}-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{UNFINISHED}-{self.job}")


class ZipSource(DataSource):
    """The data source `zip`; options: path, and bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema: object) -> StreamReader:  # noqa: N802
        return StreamReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> Writer:
        return Writer(dict(self.options), [f.name for f in schema.fields], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipSource)


def write_archives(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows (archive, member, content) as one ZIP each archive; members in order of their names."""
    register(rows.sparkSession)
    kept = rows.select("archive", "member", F.lit(None).cast("long").alias("size"), F.col("content").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
    kept.repartition("archive").sortWithinPartitions("archive", "member").write.format("zip").mode(mode).save(path)
