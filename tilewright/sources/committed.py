"""Sinks that many tasks write and one commit makes visible: ordered text documents and folders of files.

Tasks write under a folder of their job; the commit writes one small index that names the parts in order, and readers follow the index. A job that
fails, or a task that is repeated, leaves nothing that a reader sees. The index is put in place by one move.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

INDEX = "_index.json"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI (file, hdfs, s3, gs), and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int
    bytes: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, files: bool, overwrite: bool):
        self.path, self.files, self.overwrite, self.job = path, files, overwrite, f"job-{uuid.uuid4().hex}"

    def write(self, rows) -> Part:
        where, folder = file_system(self.path)
        number, n, size = TaskContext.get().partitionId(), 0, 0
        own = f"{self.job}/{number:06d}-{uuid.uuid4().hex}"
        where.create_dir(f"{folder}/{own}" if self.files else f"{folder}/{self.job}", recursive=True)
        if self.files:
            for r in rows:
                with where.open_output_stream(f"{folder}/{own}/{r[0]}") as f:
                    f.write(r[1] or b"")
                n, size = n + 1, size + len(r[1] or b"")
        else:
            with where.open_output_stream(f"{folder}/{own}") as f:
                for r in rows:
                    line = ((r[0] if r[0] is not None else "") + "\n").encode()
                    f.write(line)
                    n, size = n + 1, size + len(line)
        return Part(number, own, n, size)

    def commit(self, messages) -> None:
        where, folder = file_system(self.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
        index = {"job": self.job, "kind": "files" if self.files else "lines", "parts": [{"name": m.name, "rows": m.rows, "bytes": m.bytes} for m in parts]}
        where.create_dir(folder, recursive=True)
        old = _index_of(where, folder)
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} is written already")
        new = f"{folder}/.{self.job}.json"
        with where.open_output_stream(new) as f:
            f.write(json.dumps(index).encode())
        where.move(new, f"{folder}/{INDEX}")
        if old and where.get_file_info(f"{folder}/{old['job']}").type == fs.FileType.Directory:
            where.delete_dir(f"{folder}/{old['job']}")

    def abort(self, messages) -> None:
        where, folder = file_system(self.path)
        if where.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{folder}/{self.job}")


def _index_of(where: fs.FileSystem, folder: str) -> dict | None:
    if where.get_file_info(f"{folder}/{INDEX}").type != fs.FileType.File:
        return None
    with where.open_input_stream(f"{folder}/{INDEX}") as f:
        return json.loads(f.read())


class CommittedLines(DataSource):
    """Sink of one text column: a document in lines, in the order of the partitions."""

    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], False, overwrite)


class CommittedFiles(DataSource):
    """Sink of rows (name, body): a file each."""

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def schema(self) -> str:
        return "name string, body binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], True, overwrite)


def _save(df: DataFrame, source: type[DataSource], path: str, overwrite: bool) -> None:
    df.sparkSession.dataSource.register(source)
    df.write.format(source.name()).mode("overwrite" if overwrite else "append").save(path)


def write_ordered_lines(df: DataFrame, path: str, order: list[str], value: str = "value", overwrite: bool = False) -> None:
    """One text document of the column ``value`` in the given order, written by as many tasks as the range sort has partitions, and committed as a whole."""
    lines = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(value).cast("string").alias("value"))
    _save(lines, CommittedLines, path, overwrite)


def write_committed_files(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """A file for each row (name, body), committed as a whole. Names are unique within the job or at least within a task."""
    _save(files.select("name", F.col("body").cast("binary").alias("body")), CommittedFiles, path, overwrite)


def committed_parts(path: str) -> list[str]:
    """The parts of what was committed to a path, in order: files of lines, or folders of files. Raises where nothing is."""
    where, folder = file_system(path)
    index = _index_of(where, folder)
    if index is None:
        raise FileNotFoundError(f"nothing was committed to {path}")
    return [f"{path.rstrip('/')}/{p['name']}" for p in index["parts"]]


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(document, part, block, place, value): the lines of text documents, read in blocks by many tasks; sorted by part, block and place those of a document are in its order.

    A committed document is one, of several parts; otherwise each file of the path is one.
    """
    where, folder = file_system(path)
    whole = _index_of(where, folder) is not None if "*" not in path else False
    if whole and not committed_parts(path):
        return spark.createDataFrame([], "document string, part string, block long, place long, value string")
    raw = spark.read.text(committed_parts(path) if whole else path)
    file = F.col("_metadata.file_path")
    return raw.select(F.lit(path).alias("document") if whole else file.alias("document"), file.alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
