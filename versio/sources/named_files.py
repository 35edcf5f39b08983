"""Named text files as a Spark data source (K1): one file per name, in any store that pyarrow reaches
(local or mounted folders, HDFS, S3, GCS, Azure).

Writing takes rows (name, piece) in the order of the partitions: consecutive rows of one name are the pieces
of one file, and a long file may go on in the next partitions. Pieces are streamed to the store, so a file
may be larger than memory. It is a two-phase commit:

1. each task writes segments (what it has of a file) to a folder of its own below ``_attempts/<run>`` and a
   list of them. A task that fails removes its folder; when the job is done the driver removes the folders of
   attempts that do not count and writes ``_committed/<run>``, the list of those that do (one line a task). A
   job that fails leaves nothing.
2. ``publish`` gives the files of committed runs their names, replacing files of the same name and no others: a
   file of one segment is moved, the segments of a longer one are copied one after the other first. Doing this
   again does nothing, so a lost executor or a driver that dies here costs nothing: the next ``publish``
   finishes the run.

Reading gives (name, content) for each file of the folder.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "versio_files"
ATTEMPTS, COMMITTED = "_attempts", "_committed"
#: Files read by one task.
FILES_A_TASK = 1_000
#: Bytes copied at a time.
COPY_BYTES = 8 << 20


def file_system(path: str) -> tuple:
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:/"):].lstrip("/")
    found, inner = fs.FileSystem.from_uri(path.rstrip("/"))
    return found, inner.rstrip("/")


def _entries(store, folder: str) -> list:
    from pyarrow import fs

    return store.get_file_info(fs.FileSelector(folder, allow_not_found=True))


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str) -> None:
        self.path, self.run = path, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = file_system(self.path)
        attempt = uuid.uuid4().hex
        folder = f"{root}/{ATTEMPTS}/{self.run}/{attempt}"
        store.create_dir(folder, recursive=True)
        now, out, count, place = None, None, 0, TaskContext.get().partitionId()
        try:
            with store.open_output_stream(f"{folder}/names") as names:
                for batch in iterator:
                    for name, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                        if out is None or name != now:
                            if out is not None:
                                out.close()
                            now, out = name, store.open_output_stream(f"{folder}/{count}")
                            names.write(json.dumps([name, place, f"{folder}/{count}"]).encode() + b"\n")
                            count += 1
                        out.write((piece.as_py() or "").encode())
                if out is not None:
                    out.close()
        except BaseException:
            store.delete_dir(folder)
            raise
        return Written(attempt, count)

    def commit(self, messages: list) -> None:
        store, root = file_system(self.path)
        folder, good = f"{root}/{ATTEMPTS}/{self.run}", {m.attempt for m in messages if m is not None}
        for entry in _entries(store, folder):
            if entry.base_name not in good:
                store.delete_dir(entry.path)
        store.create_dir(f"{root}/{COMMITTED}", recursive=True)
        with store.open_output_stream(f"{root}/{COMMITTED}/{self.run}") as out:
            out.write("".join(f"{a}\n" for a in sorted(good)).encode())

    def abort(self, messages: list) -> None:
        store, root = file_system(self.path)
        folder = f"{root}/{ATTEMPTS}/{self.run}"
        if _entries(store, folder):
            store.delete_dir(folder)


@dataclass
class Names(InputPartition):
    paths: list


class FilesReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list:
        store, root = file_system(self.path)
        files = sorted(e.path for e in _entries(store, root) if e.is_file)
        return [Names(files[at:at + FILES_A_TASK]) for at in range(0, len(files), FILES_A_TASK)] or [Names([])]

    def read(self, partition: Names) -> Iterator[tuple]:
        store, _ = file_system(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                yield path.rsplit("/", 1)[-1], f.read().decode()


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content string"

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], self.options["run"])


def publish(spark: SparkSession, path: str) -> int:
    """Give the files of every committed run below ``path`` their names, older runs first, and return the number
    of runs. What a run that died has left is finished here."""
    store, root = file_system(path)
    runs = sorted(e.base_name for e in _entries(store, f"{root}/{COMMITTED}"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = file_system(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                with own.open_input_stream(f"{folder}/names") as f:
                    lines = [json.loads(x) for x in f.read().splitlines()]
                for at in range(0, len(lines), 10_000):
                    cols = zip(*lines[at:at + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string()), strict=True)], ["name", "place", "path"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, top = file_system(path)
        for batch in batches:
            for name, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = paths[0]
                if len(paths) > 1:
                    whole = f"{paths[0]}.whole"
                    with own.open_output_stream(whole) as out:
                        for p in paths:
                            with own.open_input_stream(p) as f:
                                while data := f.read(COPY_BYTES):
                                    out.write(data)
                try:
                    own.move(whole, f"{top}/{name}")
                except FileNotFoundError:  # moved by an attempt before this one
                    pass
            yield batch.slice(0, 0).select(["name"])

    for run in runs:
        with store.open_input_stream(f"{root}/{COMMITTED}/{run}") as f:
            attempts = [f"{root}/{ATTEMPTS}/{run}/{a}" for a in f.read().decode().split()]
        if attempts:
            lists = spark.createDataFrame([(a,) for a in attempts], "folder string").repartition(min(len(attempts), 1_000))
            found = lists.mapInArrow(segments, "name string, place int, path string")
            files = found.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))
            files.mapInArrow(settle, "name string").write.format("noop").mode("overwrite").save()
            store.delete_dir(f"{root}/{ATTEMPTS}/{run}")
        store.delete_file(f"{root}/{COMMITTED}/{run}")
    return len(runs)


def write_files(pieces: DataFrame, path: str) -> None:
    """Files of ``pieces`` (name, piece), in order as ``repartitionByRange`` and ``sortWithinPartitions`` leave them.
    Files of the same names are replaced, others are left alone."""
    spark = pieces.sparkSession
    spark.dataSource.register(NamedFiles)
    publish(spark, path)  # what an earlier run has committed comes first
    run = f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}.{time.time_ns() % 10**9:09d}-{uuid.uuid4().hex[:8]}"
    pieces.toDF("name", "piece").write.format(FORMAT).option("run", run).mode("append").save(path)
    publish(spark, path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of every file in the folder ``path``."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format(FORMAT).load(path)
