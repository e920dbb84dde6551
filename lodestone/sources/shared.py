"""Tables of this application in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode alone one of our own will do."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lodestone-"))
    return _local[0]


def _path(spark: SparkSession, folder: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def own_folder(spark: SparkSession) -> str:
    """A folder in the shared one for this application, removed when its JVM ends."""
    folder = f"{shared_folder(spark)}/lodestone-{spark.sparkContext.applicationId}"
    path, files = _path(spark, folder)
    files.deleteOnExit(path)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)


def made_folder(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.mkdirs(path)


def folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder."""
    path, files = _path(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(path) if f.isDirectory())


def state_of(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Bytes in a folder or file and its last change: tells whether it is still what was read."""
    path, files = _path(spark, folder)
    return files.getContentSummary(path).getLength(), files.getFileStatus(path).getModificationTime()


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written as a table and read again: lineage ends here."""
    spark = df.sparkSession
    folder = folder or fresh_folder(spark, "table")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def byte_batches(spark: SparkSession) -> None:
    """Bounds batches to Python by 4 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in whatever file system the path is in."""
    at, files = _path(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    at, files = _path(spark, path)
    source = files.open(at)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()
