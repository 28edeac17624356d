"""A transactional sink of binary files, as a Spark data source: all files of a job appear, or none.

Tasks write into a staging folder beside the files. When all have ended the driver writes down which attempts count; then tasks move their files into place, one attempt each, and the
staging folder goes. When one fails for good, the driver removes the staging folder and nothing has appeared. A driver that dies meanwhile
leaves that note, and ``recover`` goes on from it. A file of the same name is replaced.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from leafpress.sources.storage import Storage

STAGING, NOTE = "_staging", "_counts"
#: Files that a task moves at a time.
MOVES = 16


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a qualified path, and the path in it. Hadoop writes file:/x, pyarrow reads file:///x."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", root))


def qualified(spark: SparkSession, root: str) -> str:
    """The path with its scheme; one without a scheme belongs to Hadoop's default file system."""
    return Storage(spark, root).root


def put(system: fs.FileSystem, path: str, value: bytes) -> None:
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(value)


def move(system: fs.FileSystem, source: str, target: str) -> None:
    """Renames; not every file system replaces what stands there."""
    system.create_dir(target.rpartition("/")[0], recursive=True)
    try:
        system.move(source, target)
    except OSError:
        if system.get_file_info(target).type == fs.FileType.NotFound:
            raise
        system.delete_file(target)
        system.move(source, target)


def put_whole(system: fs.FileSystem, path: str, value: bytes) -> None:
    """The whole file or none: written under another name, then renamed."""
    folder, _, name = path.rpartition("/")
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        put(system, hidden, value)
        move(system, hidden, path)
    except BaseException:
        if system.get_file_info(hidden).type == fs.FileType.File:
            system.delete_file(hidden)
        raise


def move_attempt(system: fs.FileSystem, base: str, job: str, attempt: str) -> None:
    """Moves what is staged in an attempt; what an earlier run has moved is no longer there."""
    top = f"{base}/{STAGING}/{job}/{attempt}"
    found = system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    pairs = [(i.path, f"{base}{i.path[len(top) :]}") for i in found if i.type == fs.FileType.File]
    with ThreadPoolExecutor(MOVES) as pool:
        list(pool.map(lambda p: move(system, *p), pairs))


def finish(system: fs.FileSystem, base: str, job: str, attempts: list[str]) -> None:
    """Moves the files of these attempts and removes the staging folder."""
    for attempt in attempts:
        move_attempt(system, base, job, attempt)
    system.delete_dir(f"{base}/{STAGING}/{job}")


def finish_on_workers(spark: SparkSession, root: str, job: str) -> None:
    """``finish`` of a job whose note stands, each attempt in a task of its own; ``recover`` goes on from one that dies."""
    system, base = opened(root)
    with system.open_input_stream(f"{base}/{STAGING}/{job}/{NOTE}") as f:
        attempts = json.loads(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, folder = opened(root)
        for batch in batches:
            for attempt in batch["attempt"].to_pylist():
                move_attempt(own, folder, job, attempt)
            yield batch

    if attempts:
        spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(len(attempts), "attempt").mapInArrow(run, "attempt string").collect()
    system.delete_dir(f"{base}/{STAGING}/{job}")


def recover(spark: SparkSession, root: str) -> None:
    """Finishes jobs whose driver died while it moved files, and removes what other dead jobs have staged. Not while a job runs."""
    system, base = opened(qualified(spark, root))
    for info in system.get_file_info(fs.FileSelector(f"{base}/{STAGING}", allow_not_found=True)):
        note = f"{info.path}/{NOTE}"
        if system.get_file_info(note).type == fs.FileType.File:
            with system.open_input_stream(note) as f:
                finish(system, base, info.base_name, json.loads(f.read()))
        else:
            system.delete_dir(info.path)


@dataclass
class Attempt(WriterCommitMessage):
    folder: str


class FileWriter(DataSourceArrowWriter):
    def __init__(self, root: str, job: str | None = None):
        # With a job's name the caller moves the files, once the note stands.
        self.root, self.job, self.moves = root, job or uuid.uuid4().hex, job is None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        system, base = opened(self.root)
        task = TaskContext.get()
        folder = f"{task.partitionId()}-{task.taskAttemptId()}" if task else "0-0"
        for batch in iterator:
            for path, value in zip(batch["path"], batch["value"]):
                name = path.as_py()
                if not name or name.startswith("/") or ".." in name.split("/") or "\0" in name or name.split("/")[0] == STAGING:
                    raise ValueError(f"no file can be written as {name!r}")
                if value.is_valid:
                    put(system, f"{base}/{STAGING}/{self.job}/{folder}/{name}", value.as_py())
        return Attempt(folder)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, base = opened(self.root)
        attempts = sorted(m.folder for m in messages if m is not None)
        # The note appears whole: it is renamed into place.
        staged = f"{base}/{STAGING}/{self.job}"
        put(system, f"{staged}/.{NOTE}", json.dumps(attempts).encode())
        system.move(f"{staged}/.{NOTE}", f"{staged}/{NOTE}")
        if self.moves:
            finish(system, base, self.job, attempts)

    def abort(self, messages: list[Attempt | None]) -> None:
        system, base = opened(self.root)
        staged = f"{base}/{STAGING}/{self.job}"
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class FileSink(DataSource):
    """Format ``leafpress_files``: rows (path string, value binary) below the option ``root``. Null values are passed by."""

    @classmethod
    def name(cls) -> str:
        return "leafpress_files"

    def schema(self) -> str:
        return "path string, value binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["root"], self.options.get("job"))


def write_all(files: DataFrame, root: str) -> None:
    """Writes (path, value) below root, all or nothing."""
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    target, job = qualified(spark, root), uuid.uuid4().hex
    files.select("path", "value").write.format("leafpress_files").mode("append").option("root", target).option("job", job).save()
    finish_on_workers(spark, target, job)
