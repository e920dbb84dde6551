"""A data source of byte ranges: partitions are ranges of files, and a task seeks to its range and reads no more.

Files are listed once, by Spark's own file systems; tasks open them with Arrow's (local, HDFS, S3, ...).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A longer range comes in several rows of so many bytes.
BLOCK_BYTES = 4 << 20


@dataclass
class Range(InputPartition):
    path: str
    length: int
    start: int
    n: int


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files: list[tuple[str, int]] = json.loads(options["files"])
        self.start, self.n, self.block = int(options["start"]), int(options["bytes"]), int(options.get("block", BLOCK_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path, length in self.files:
            first = min(self.start, length) if self.start >= 0 else max(length + self.start, 0)
            end = min(first + self.n, length)
            out += [Range(path, length, a, min(self.block, end - a)) for a in range(first, end, self.block)] or [Range(path, length, first, 0)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        data = b""
        if part.n:
            from pyarrow import fs

            local = part.path.startswith("file://")
            files, path = (fs.LocalFileSystem(), part.path.removeprefix("file://")) if local else fs.FileSystem.from_uri(part.path)
            with files.open_input_file(path) as f:
                data = f.read_at(part.n, part.start)
        yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([part.length], pa.int64()), pa.array([part.start], pa.int64()), pa.array([data], pa.binary())], ["path", "length", "start", "bytes"])


class ByteRanges(DataSource):
    """Options: files (JSON list of path and length), start (from the end if negative), bytes, block."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, length long, start long, bytes binary"

    def reader(self, schema: object) -> RangeReader:
        return RangeReader(self.options)


def file_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Paths with scheme and lengths of the files that a path or pattern stands for, those of a folder included."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(files.globStatus(at) or [])
    found = [f for s in found for f in (files.listStatus(s.getPath()) if s.isDirectory() else [s]) if f.isFile()]
    return sorted((f.getPath().toString() if f.getPath().toUri().getScheme() != "file" else "file://" + f.getPath().toUri().getPath(), f.getLen()) for f in found)


def read_range(spark: SparkSession, path: str, start: int, length: int, block: int = BLOCK_BYTES) -> DataFrame:
    """path, length (of the file), start and bytes of a range of each file; a negative start counts from the end.

    A range that reaches past the end ends there; one of more than `block` bytes comes in blocks.
    """
    files = file_sizes(spark, path)
    if not files:
        raise FileNotFoundError(path)
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").option("files", json.dumps(files)).option("start", start).option("bytes", max(length, 0)).option("block", block).load()


def footer(spark: SparkSession, path: str, n: int = 8) -> DataFrame:
    """The last n bytes of each file, all of a shorter one."""
    return read_range(spark, path, -n, n)
