"""A data source over a directory tree: every regular file, hidden ones too, no symbolic links.

``spark.read.format("binaryFile")`` leaves out names that begin with a dot or an underscore and follows links; this source
does neither. It lists (path, rel, size); contents are read later, by the tasks, for the rows that are left.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "path string, rel string, size bigint"


class _Subtree(InputPartition):
    def __init__(self, top: str, deep: bool):
        super().__init__(top)
        self.top, self.deep = top, deep


class CorpusFiles(DataSource):
    """Option ``path``: the root, seen alike by driver and executors."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _Reader(os.path.abspath(self.options["path"]))


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        """The root's own files, and a task for every directory right below it."""
        with os.scandir(self.root) as found:
            below = sorted(e.path for e in found if e.is_dir(follow_symlinks=False))
        return [_Subtree(self.root, False), *(_Subtree(p, True) for p in below)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        todo = [partition.top]
        while todo:
            with os.scandir(todo.pop()) as found:
                for e in found:
                    if e.is_symlink():
                        continue
                    if e.is_dir():
                        if partition.deep:
                            todo.append(e.path)
                    elif e.is_file():
                        yield e.path, os.path.relpath(e.path, self.root).replace(os.sep, "/"), e.stat().st_size


def list_files(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(CorpusFiles)
    return spark.read.format("corpus_files").option("path", root).load()


def with_content(listing: DataFrame) -> DataFrame:
    """The listing with each file's bytes, read where the row is; null if it can't be opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                try:
                    with open(row.column("path")[0].as_py(), "rb") as f:
                        data = f.read()
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], [*row.schema.names, "content"])

    return listing.mapInArrow(run, T.StructType([*listing.schema.fields, T.StructField("content", T.BinaryType())]))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, rel, size, content) by Spark's own reader, for stores that only Spark can read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace(F.col("path"), "^.*?" + path.rstrip("/").rpartition("/")[2] + "/", "")
    return found.select("path", rel.alias("rel"), F.col("length").alias("size"), "content")
