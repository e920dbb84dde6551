"""What the training-data operators share: row keys, lineage cuts, worker state."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import fresh_folder, own_folder

ROW_ID, ROW_KEY = "_row_id", "_row_key"
#: Bytes in a batch to Python, and bytes and rows of text that Python holds as objects at once.
BATCH_BYTES, PART_BYTES, PART_ROWS = 4 << 20, 1 << 20, 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keyed(docs: DataFrame, text: str = "text", *, keep: bool = True) -> DataFrame:
    """(_row_id, _row_key, text): the identity of a document inside an operator.

    _row_id is doc_id and _row_key a 64-bit hash of the text, so equal rows are one
    document and rows that share only a doc_id stay apart. A null doc_id becomes the
    smallest long. keep=False drops the text.
    """
    t = text_or_empty(text)
    cols = [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias(ROW_ID),
        F.xxhash64(t).alias(ROW_KEY),
    ]
    return docs.select(*cols, *([t.alias("text")] if keep else []))


def named_rows(docs: DataFrame) -> DataFrame:
    """docs with the identity of keyed() added; a null text becomes an empty one."""
    return docs.withColumn("text", text_or_empty()).withColumns({ROW_ID: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), ROW_KEY: F.xxhash64("text")})


def stored(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    folder = fresh_folder(spark, "table")
    df.write.option("compression", "none").parquet(folder)  # hashes hardly shrink, and ids are packed without it
    return spark.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that all executors share: for small tables between rounds."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{own_folder(df.sparkSession)}/checkpoints")
    return df.checkpoint(eager=True)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often and in whatever lambdas it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(values: Column, blocks: tuple[int, ...] = (16, 128)) -> Column:
    """The sum before each element of an array of int. Sums of short blocks come first, those before each block after them, by blocks of blocks."""
    block, *rest = blocks

    def summed(v: Column) -> Column:
        return F.aggregate(v, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def pieces(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / block).cast("int")), lambda k: summed(F.slice(v, k * block + 1, block)))

    def placed(s: Column) -> Column:
        totals = F.transform(s, lambda p: F.element_at(p, -1))
        before = running_sums(totals, tuple(rest)) if rest else summed(totals)
        return F.flatten(F.zip_with(s, F.slice(before, 1, F.size(s)), lambda p, o: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + o)))

    return once(values, lambda v: once(pieces(v), placed))


def byte_batches(spark: SparkSession) -> None:
    """Bounds batches to Python by bytes: the same for all operators, so whatever plan is run last."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with PART_BYTES bytes or less in column at, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART_BYTES, side="right")))
        stop = min(stop, start + PART_ROWS)
        yield batch.slice(start, stop - start)
        start = stop


def worker_state() -> types.ModuleType:
    """A namespace that lives as long as the Python worker, across tasks."""
    name = "_lodestone_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name]
