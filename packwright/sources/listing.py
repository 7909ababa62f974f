"""A listing source: every file and folder below a root, hidden names and empty folders among them."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "rel_path string, is_dir boolean, length long, modified timestamp"
_ARROW = pa.schema([("rel_path", pa.string()), ("is_dir", pa.bool_()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])
#: Rows of a listing, and bytes of contents, sent at a time.
ROWS, BYTES = 10_000, 64 << 20


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder and its path there; plain paths are local ones."""
    if "://" in root or root.startswith("file:"):
        found, path = pafs.FileSystem.from_uri(root)
        return found, path.rstrip("/")
    return pafs.LocalFileSystem(), os.path.abspath(root)


def _children(store: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return sorted(store.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.path)


@dataclass
class Folders(InputPartition):
    """Folders one task lists: (path, whether all below it is its as well)."""

    folders: list[tuple[str, bool]]


class TreeReader(DataSourceReader):
    """Splits a tree into folders: the top levels are listed one by one until there are enough folders to deal out."""

    def __init__(self, options: dict):
        self.root, self.wanted = options["path"], int(options.get("tasks", "64"))

    def partitions(self) -> list[Folders]:
        store, base = opened(self.root)
        above, front = [], [base]
        while front and len(front) < self.wanted:
            above += [(f, False) for f in front]
            front = [i.path for f in front for i in _children(store, f) if i.type == pafs.FileType.Directory]
        folders = above + [(f, True) for f in front]
        n = min(len(folders), self.wanted)
        return [Folders(folders[k::n]) for k in range(n)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, base = opened(self.root)
        todo, rows = list(partition.folders), []
        while todo:
            folder, deep = todo.pop()
            for i in _children(store, folder):
                is_dir = i.type == pafs.FileType.Directory
                rows.append({"rel_path": i.path[len(base) + 1 :], "is_dir": is_dir, "length": 0 if is_dir else i.size, "modified": i.mtime})
                if is_dir and deep:
                    todo.append((i.path, True))
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class TreeSource(DataSource):
    """``spark.read.format("packwright_tree").load(root)``: one row a file or folder, without contents."""

    @classmethod
    def name(cls) -> str:
        return "packwright_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def listing(spark: SparkSession, root: str, tasks: int = 64) -> DataFrame:
    """rel_path, is_dir, length, modified of everything below a folder of a store that all executors see.

    The driver lists the top levels only, until they have ``tasks`` folders; tasks list what is below. A missing root
    ends in an error; an empty one has no rows.
    """
    spark.dataSource.register(TreeSource)
    return spark.read.format(TreeSource.name()).option("tasks", str(tasks)).load(root)


def is_hidden(path: Column) -> Column:
    """Whether Spark's own readers pass a path over: a part starts with a dot, or with an underscore and has no equals sign."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") | (p.startswith("_") & ~F.contains(p, F.lit("="))))


def matches(path: Column, pattern: str) -> Column:
    """Whether a file's name fits a shell pattern."""
    return F.substring_index(path, "/", -1).rlike(f"^{fnmatch.translate(pattern)}")


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Listed files with their bytes, read where the rows are, in batches of bounded bytes (one file at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            first, size, contents = 0, 0, []
            paths = batch.column(batch.schema.get_field_index("rel_path")).to_pylist()
            for k, path in enumerate(paths):
                with store.open_input_stream(f"{base}/{path}") as f:
                    contents.append(f.read())
                size += len(contents[-1])
                if size >= BYTES or k + 1 == len(paths):
                    part = batch.slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], [*part.schema.names, "content"])
                    first, size, contents = k + 1, 0, []

    kept = files.where("not is_dir").select("rel_path", "length", "modified")
    return kept.mapInArrow(run, "rel_path string, length long, modified timestamp, content binary")


def hidden_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files that Spark's own readers pass over, with their bytes."""
    rows = listing(spark, root)
    return with_content(rows.where(~F.col("is_dir") & is_hidden(F.col("rel_path")) & matches(F.col("rel_path"), pattern)), root)


def heads(files: DataFrame, root: str, size: int = 65536) -> DataFrame:
    """Listed files with their first bytes only, as ``head``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            found = []
            for path in batch.column(batch.schema.get_field_index("rel_path")).to_pylist():
                with store.open_input_stream(f"{base}/{path}") as f:
                    found.append(f.read(size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "head"])

    return files.where("not is_dir").mapInArrow(run, f"{SCHEMA}, head binary")
