"""Files at given paths: a sink and a source, as a Spark data source with a two-phase commit.

A task writes below a staging folder of its own attempt; only the driver, once all tasks are done, moves the files of the
attempts that count to their paths and drops the rest. So a task that fails or runs twice leaves nothing, and a job that
fails leaves no file at all. ``write`` refuses clashing or unsafe paths before anything is written. What goes through the driver
is one name for each task; it moves files one listing of a task after another.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import walk

STAGING = "_staging"
ROWS = "path string, content binary"
SCHEMA = pa.schema([("path", pa.string()), ("content", pa.binary())])
#: Bytes of files that one reading task takes, and rows' bytes of a batch.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20


class Staged(WriterCommitMessage):
    def __init__(self, attempt: str, files: int):
        self.attempt, self.files = attempt, files


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        store, root = fs.FileSystem.from_uri(self.root)
        attempt, files, made = uuid.uuid4().hex, 0, set()
        top = posixpath.join(root, STAGING, self.job, attempt)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                at = posixpath.join(top, path)
                folder = posixpath.dirname(at)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(at, compression=None) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                files += 1
        return Staged(attempt, files)

    def commit(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.root)
        store.create_dir(root, recursive=True)
        made = set()
        for m in messages:
            if m is None or not m.files:
                continue
            top = posixpath.join(root, STAGING, self.job, m.attempt)
            for f in store.get_file_info(fs.FileSelector(top, recursive=True)):
                if f.type == fs.FileType.File:
                    to = posixpath.join(root, posixpath.relpath(f.path, top))
                    if posixpath.dirname(to) not in made:
                        store.create_dir(posixpath.dirname(to), recursive=True)
                        made.add(posixpath.dirname(to))
                    store.move(f.path, to)
        self.clear(store, root)

    def abort(self, messages: list) -> None:
        self.clear(*fs.FileSystem.from_uri(self.root))

    def clear(self, store: fs.FileSystem, root: str) -> None:
        """The job's staged files go, and the staging folder with the last job."""
        own, every = posixpath.join(root, STAGING, self.job), posixpath.join(root, STAGING)
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)
        if store.get_file_info(every).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(every)):
            store.delete_dir(every)


class Some(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    """Paths are listed on the driver as any file source does, and dealt into tasks by size."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Some]:
        store, root = fs.FileSystem.from_uri(self.root)
        parts, held, size = [], [], 0
        for f in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            path = posixpath.relpath(f.path, root)
            if f.type == fs.FileType.File and path.split("/")[0] != STAGING:
                held.append(path)
                size += f.size
                if size >= TASK_BYTES:
                    parts.append(Some(held))
                    held, size = [], 0
        return [*parts, Some(held)]

    def read(self, partition: Some) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.root)
        held, size = [], 0
        for path in partition.paths:
            with store.open_input_file(posixpath.join(root, path)) as f:
                content = f.read()
            held.append({"path": path, "content": content})
            size += len(content)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, SCHEMA)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)


class TreeSource(DataSource):
    """Format ``doctree``; ``path`` is a URI."""

    @classmethod
    def name(cls) -> str:
        return "doctree"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"])


def unsafe(path: Column) -> Column:
    """Paths that are null, empty, absolute, end in a slash, name the staging folder or have empty, ``.`` or ``..`` parts."""
    return path.isNull() | (path == "") | path.rlike(r"(^|/)(\.{0,2})(/|$)") | path.rlike(f"^{STAGING}(/|$)") | F.contains(path, F.lit("\0"))


def refused(files: DataFrame) -> DataFrame:
    """(path, why) of what cannot be written side by side: unsafe paths, paths given twice, files whose path is another's folder."""
    paths = files.select("path")
    bad = paths.filter(unsafe(F.col("path"))).select("path", F.lit("unsafe").alias("why"))
    good = paths.filter(~unsafe(F.col("path")))
    twice = good.groupBy("path").count().filter("count > 1").select("path", F.lit("given twice").alias("why"))
    parts = F.split("path", "/")
    folders = good.filter(F.contains("path", F.lit("/"))).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).distinct()
    held = good.distinct().join(folders, "path", "left_semi").select("path", F.lit("is another's folder").alias("why"))
    return bad.unionByName(twice).unionByName(held)


def write(files: DataFrame, root: str) -> None:
    """``files`` (path, content as text or binary) to their paths below ``root``; null content is an empty file. Clashes raise ValueError and nothing is written."""
    clash = refused(files).limit(5).collect()
    if clash:
        raise ValueError("refused: " + "; ".join(f"{r['path']} ({r['why']})" for r in clash))
    files.sparkSession.dataSource.register(TreeSource)
    files.select("path", F.col("content").cast("binary").alias("content")).write.format("doctree").mode("append").save(root)


def read(spark: SparkSession, root: str) -> DataFrame:
    """(path, content): all files below ``root`` as bytes."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("doctree").load(root)


def copied(spark: SparkSession, root: str, converted: DataFrame, to: str, extensions: tuple[str, ...] = (".md", ".mdx")) -> None:
    """Write ``converted`` (path, content) and all files below ``root`` that aren't documents, byte for byte, in one commit."""
    every = read(spark, root)
    docs = walk(every.select("path"), "site", extensions)
    rest = walk(every, "site", ("",)).join(docs, "path", "left_anti")
    write(rest.unionByName(converted.select("path", F.col("content").cast("binary").alias("content"))), to)
