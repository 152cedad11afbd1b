"""A log of rows in a shared folder, as a Spark data source: written and read exactly once, in batches and streams.

Tasks write JSON lines under names that nobody reads. A commit names the files of the attempts that succeeded, in one small
file of its own whose number is the log's next; readers see only what commits name. A commit's number is taken once, so a
writer that began from an older state of the log fails instead of repeating rows, and a stream's batch is committed once
however often it is tried. Folders are paths or URIs that Arrow's file systems reach.
"""

from __future__ import annotations

import io
import itertools
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.evidence import first_of
from ..operators.plan import cut

_COMMITS, _FILES = "_commits", "files"
#: Bytes of a file that are read or written at once.
_PIECE = 1 << 20


class LogMoved(RuntimeError):
    """Somebody else has written to the log since its state was read."""


class _Folder:
    """The log's files, by any of Arrow's file systems."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _at(self, *names: str) -> tuple[pafs.FileSystem, str]:
        local = re.sub(r"^file:/+", "/", self.path)
        system, base = pafs.FileSystem.from_uri(local) if "://" in local else (pafs.LocalFileSystem(), local)
        return system, "/".join([base.rstrip("/"), *names])

    def writing(self, *names: str) -> io.BufferedWriter:
        system, path = self._at(*names)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return io.BufferedWriter(system.open_output_stream(path, compression=None), _PIECE)

    def reading(self, *names: str) -> io.BufferedReader:
        system, path = self._at(*names)
        return io.BufferedReader(system.open_input_stream(path, compression=None), _PIECE)

    def write(self, data: bytes, *names: str) -> None:
        with self.writing(*names) as out:
            out.write(data)

    def read(self, *names: str) -> bytes:
        system, path = self._at(*names)
        with system.open_input_stream(path, compression=None) as src:
            return src.read()

    def drop(self, *names: str) -> None:
        system, path = self._at(*names)
        if system.get_file_info(path).type == pafs.FileType.File:
            system.delete_file(path)

    def commits(self) -> list[int]:
        system, path = self._at(_COMMITS)
        found = system.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def commit(self, number: int, files: list[str], batch: str | None) -> None:
        """Take the number: the commit's file is written beside and moved in place, if no other is there. File systems that
        Arrow knows have no move that fails on a taken name, so two drivers within the same instant need a lock of their own."""
        system, final = self._at(_COMMITS, f"{number:012}.json")
        draft = f"{uuid.uuid4().hex}.draft"
        self.write(json.dumps({"files": files, "batch": batch}).encode(), _COMMITS, draft)
        if system.get_file_info(final).type != pafs.FileType.NotFound:
            self.drop(_COMMITS, draft)
            raise LogMoved(f"commit {number} of {self.path} is taken")
        system.move(self._at(_COMMITS, draft)[1], final)

    def files(self, first: int, last: int) -> list[str]:
        """The files of commits first..last - 1."""
        return [f for n in self.commits() if first <= n < last for f in json.loads(self.read(_COMMITS, f"{n:012}.json"))["files"]]

    def has(self, batch: str) -> bool:
        return any(json.loads(self.read(_COMMITS, f"{n:012}.json"))["batch"] == batch for n in self.commits())

    @property
    def next(self) -> int:
        return max(self.commits(), default=-1) + 1


@dataclass
class _Written(WriterCommitMessage):
    file: str | None


@dataclass
class _File(InputPartition):
    file: str | None


def _write(folder: _Folder, rows: Iterator, columns: list[str]) -> _Written:
    """Lines go to the file as they come, so a task holds one row, however many it writes."""
    first = next(rows, None)
    if first is None:
        return _Written(None)
    name = f"{uuid.uuid4().hex}.jsonl"
    with folder.writing(_FILES, name) as out:
        for row in itertools.chain([first], rows):
            out.write((json.dumps({c: row[c] for c in columns}, default=str, ensure_ascii=False) + "\n").encode())
    return _Written(name)


def _read(folder: _Folder, file: str | None, columns: list[str]) -> Iterator[tuple]:
    """A file's rows, read a piece at a time."""
    if not file:
        return
    with folder.reading(_FILES, file) as src:
        for line in src:
            row = json.loads(line)
            yield tuple(row.get(c) for c in columns)


class _Writer(DataSourceWriter, DataSourceStreamWriter):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.folder, self.columns = _Folder(options["path"]), columns
        self.base = int(options["base"]) if "base" in options else None
        self.name = options.get("name", "")

    def write(self, iterator: Iterator) -> _Written:
        return _write(self.folder, iterator, self.columns)

    def commit(self, messages: list, batchId: int | None = None) -> None:
        batch = None if batchId is None else f"{self.name}:{batchId}"
        files = [m.file for m in messages if m is not None and m.file]
        if batch is not None and self.folder.has(batch):  # the batch was committed before the stream was stopped
            self.abort(messages)
            return
        if files or batch is not None:
            self.folder.commit(self.folder.next if self.base is None else self.base, files, batch)

    def abort(self, messages: list, batchId: int | None = None) -> None:
        for m in messages:
            if m is not None and m.file:
                self.folder.drop(_FILES, m.file)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.folder, self.columns = _Folder(options["path"]), columns
        self.last = int(options["upto"]) if "upto" in options else self.folder.next

    def partitions(self) -> list[_File]:
        return [_File(f) for f in self.folder.files(0, self.last)] or [_File(None)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _read(self.folder, partition.file, self.columns)


class _StreamReader(DataSourceStreamReader):
    """Offsets are numbers of commits, so a batch is whole commits and is the same after a restart."""

    def __init__(self, options: dict, columns: list[str]) -> None:
        self.folder, self.columns = _Folder(options["path"]), columns

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": self.folder.next}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(f) for f in self.folder.files(start["commit"], end["commit"])] or [_File(None)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _read(self.folder, partition.file, self.columns)

    def commit(self, end: dict) -> None:
        pass


class RowLog(DataSource):
    """Options: path; for writers base (the commit's number, by default the next) and name (the stream's); for readers upto."""

    @classmethod
    def name(cls) -> str:
        return "row_log"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a row log is only added to")
        return _Writer(dict(self.options), schema.names)

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema.names)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options), schema.names)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(dict(self.options), schema.names)


def stored(spark: SparkSession, path: str, schema: StructType | str, upto: int | None = None) -> DataFrame:
    """The log's rows, of its first `upto` commits if given. Fields that a line lacks are null."""
    spark.dataSource.register(RowLog)
    reader = spark.read.format("row_log").schema(schema).option("path", path)
    return (reader if upto is None else reader.option("upto", upto)).load()


def stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The log as a stream: each commit's rows once, in the order of commits, also after a restart."""
    spark.dataSource.register(RowLog)
    return spark.readStream.format("row_log").schema(schema).option("path", path).load()


def append(rows: DataFrame, path: str, keys: list[str], order: str) -> int:
    """Add the first row of each key that the log does not have, as one commit, and return the number of such rows.

    Columns are of JSON's own kinds (text, whole numbers, floats, booleans). The log's keys are read up to its present state
    and the commit takes the next number, so two appends at a time cannot both add a key: the later one gets LogMoved and
    may be tried again. Nothing is committed where nothing is new, or where a task failed for good; a task's earlier attempts
    leave files that no commit names. Rows with a null key are added like any: nulls are equal.
    """
    spark = rows.sparkSession
    base = _Folder(path).next
    fresh = first_of(rows, keys, order)
    if base:
        known = stored(spark, path, rows.schema, base).select(*[F.col(k).alias(f"known_{i}") for i, k in enumerate(keys)]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"known_{i}")) for i, k in enumerate(keys)]
        for extra in same[1:]:
            same[0] = same[0] & extra
        fresh = fresh.join(known, same[0], "left_anti")
    fresh = cut(fresh)
    spark.dataSource.register(RowLog)
    added = fresh.count()
    if added:
        fresh.write.format("row_log").mode("append").option("path", path).option("base", base).save()
    return added
