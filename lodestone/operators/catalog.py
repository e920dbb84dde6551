"""Catalog tables (snapshots, files, batches, schemas), transactions, time travel, compaction."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import placed
from lodestone.sources.commit_log import Taken, claimed, next_number
from lodestone.sources.shared import made_folder, read_text

# The columns of the catalog's tables.
SNAPSHOTS = "snapshot_id long, version long, parent_id long, created_at double, description string, files_added long, files_removed long"
FILES = "snapshot_id long, file_path string, doc_count long, centroid array<double>, radius double, created_at double, batch_id string, is_active boolean"
BATCHES = "batch_id string, status string, doc_count long, created_at double"
SCHEMAS = "version long, schema_json string, created_at double"
BYTES_PER_DOC, MIN_FILES, TARGET_BYTES = 4096, 4, 512 << 20


def active_files(files: DataFrame, snapshot_id: int | None = None) -> DataFrame:
    """Files of one snapshot, the latest by default, that were not taken out."""
    at = F.lit(snapshot_id) if snapshot_id is not None else files.agg(F.max("snapshot_id").alias("s")).scalar()
    return files.where((F.col("snapshot_id") == at) & F.col("is_active"))


def deactivate(files: DataFrame, snapshot_id: int, path: str) -> DataFrame:
    hit = (F.col("snapshot_id") == snapshot_id) & (F.col("file_path") == path)
    return files.withColumn("is_active", F.col("is_active") & ~hit)


def latest(rows: DataFrame, by: str, key: str | None = None) -> DataFrame:
    """The row of the largest by, of each key if there is one."""
    rest = F.struct(*rows.columns)
    out = (rows.groupBy(key) if key else rows.groupBy()).agg(F.max_by(rest, by).alias("r"))
    return out.where("r is not null").select("r.*")


def history(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("snapshot_id"))


def new_batches(batches: DataFrame, log: DataFrame) -> DataFrame:
    """Batches to write: those without an id, and those not committed before."""
    done = log.where("status = 'committed'").select("batch_id").distinct()
    return batches.join(done, "batch_id", "left_anti")


def catalog_stats(snapshots: DataFrame, files: DataFrame, batches: DataFrame) -> DataFrame:
    live = active_files(files)
    counts = {
        "snapshots": snapshots.agg(F.count(F.lit(1)).alias("n")),
        "active_files": live.agg(F.count(F.lit(1)).alias("n")),
        "total_docs": live.agg(F.coalesce(F.sum("doc_count"), F.lit(0)).alias("n")),
        "batches": batches.agg(F.count(F.lit(1)).alias("n")),
    }
    out = None
    for name, c in counts.items():
        row = c.select(F.lit(name).alias("metric"), F.col("n").cast("bigint").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def version_diff(a: DataFrame, b: DataFrame, key: str = "file_path") -> DataFrame:
    """key and status (added, removed, unchanged) from a to b; for doc-level diffs key is doc_id."""
    old = a.select(key).distinct().withColumn("_a", F.lit(1))
    new = b.select(key).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("unchanged")
    return old.join(new, key, "full").select(key, status.alias("status"))


def compaction_plan(files: DataFrame, min_files: int = MIN_FILES, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Oldest files that together stay within the target; the first always, none if fewer than two."""
    sized = files.withColumns({"bytes": F.col("doc_count") * BYTES_PER_DOC, "qid": F.lit(0)})
    run = placed(sized, "created_at", "file_path", total="bytes").withColumnsRenamed({"place": "seq", "total": "_sum"})
    taken = run.where((F.col("seq") == 1) | (F.col("_sum") <= target_bytes))
    all_n = files.agg(F.count(F.lit(1)).alias("n")).scalar()
    n = taken.agg(F.count(F.lit(1)).alias("n")).scalar()
    return taken.where((all_n >= min_files) & (n >= 2)).select("seq", "file_path", "doc_count", "bytes")


def compact(spark: SparkSession, paths: list[str], out: str, target_bytes: int = TARGET_BYTES) -> None:
    """The files as one table of few parts; readers change over when the manifest names it."""
    spark.read.parquet(*paths).repartition(max(1, len(paths) // MIN_FILES)).write.mode("overwrite").parquet(out)


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast(kind)) if name not in df.columns else df


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


class Catalog:
    """The catalog's tables under one folder; every change is a file of its own that is added.

    Nothing is rewritten. Snapshot ids are claimed, so no two writers get the same one, and a
    transaction ends once: who commits and who rolls it back claim the same file, and the later
    one fails. A writer that was taken for dead can therefore not commit any more.
    """

    KINDS = {"snapshots": SNAPSHOTS, "files": FILES, "batches": BATCHES, "schemas": SCHEMAS, "journal": "tx_id string, state string, batch_id string, file_count long, created_at double"}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        for kind in self.KINDS:
            made_folder(spark, f"{self.root}/{kind}")

    def table(self, kind: str) -> DataFrame:
        names = [c.split()[0] for c in self.KINDS[kind].split(", ")]
        return self.spark.read.schema(self.KINDS[kind]).parquet(f"{self.root}/{kind}").select(*names)

    def _add(self, kind: str, *rows: tuple) -> None:
        # a folder for each change: writers to one folder would remove each other's temporary files
        self.spark.createDataFrame(list(rows), self.KINDS[kind]).coalesce(1).write.parquet(f"{self.root}/{kind}/change={uuid.uuid4().hex}")

    def create_snapshot(self, now: float, description: str = "", added: int = 0, removed: int = 0) -> int:
        top = self.table("snapshots").agg(F.max("snapshot_id"), F.max("version")).first()
        snapshot = next_number(self.spark, f"{self.root}/_snapshot_ids", (top[0] or 0) + 1)
        self._add("snapshots", (snapshot, (top[1] or 0) + 1, top[0], now, description, added, removed))
        return snapshot

    def add_files(self, snapshot_id: int, files: list[tuple[str, int]], now: float, batch_id: str = "") -> None:
        if files:
            self._add("files", *((snapshot_id, p, n, None, None, now, batch_id, True) for p, n in files))

    def log_batch(self, batch_id: str, status: str, doc_count: int, now: float) -> None:
        self._add("batches", (batch_id, status, doc_count, now))

    def batches(self) -> DataFrame:
        return latest(self.table("batches"), "created_at", "batch_id")

    def batch_exists(self, batch_id: str) -> bool:
        return not self.batches().where((F.col("batch_id") == batch_id) & (F.col("status") == "committed")).isEmpty()

    def should_write(self, batch_id: str) -> bool:
        return not batch_id or not self.batch_exists(batch_id)

    def save_schema(self, version: int, columns: dict[str, str], now: float) -> None:
        self._add("schemas", (version, json.dumps({"version": version, "columns": columns}, sort_keys=True), now))

    def schema(self, version: int | None = None) -> dict | None:
        rows = latest(self.table("schemas"), "created_at", "version")
        row = (rows.where(F.col("version") == version) if version is not None else latest(rows, "version")).first()
        return json.loads(row.schema_json) if row else None

    def evolve(self, now: float, *, add: dict[str, str] | None = None, rename: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> dict:
        current = self.schema()
        if current is None:
            raise ValueError("there is no schema yet")
        columns = {(rename or {}).get(k, k): v for k, v in current["columns"].items() if k not in drop} | (add or {})
        self.save_schema(current["version"] + 1, columns, now)
        return self.schema()

    def begin(self, batch_id: str, now: float) -> str:
        tx = uuid.uuid4().hex
        self._add("journal", (tx, "pending", batch_id, 0, now))
        return tx

    def _end(self, tx: str, state: str) -> bool:
        """Ends a transaction in one way or the other; whoever comes later gets False if it is the other way."""
        path = f"{self.root}/_ended/{tx}"
        return claimed(self.spark, path, state) or read_text(self.spark, path) == state

    def commit(self, tx: str, batch_id: str, snapshot_id: int, files: list[tuple[str, int]], now: float) -> None:
        if not self._end(tx, "committed"):
            raise Taken(f"transaction {tx} was rolled back")
        self.add_files(snapshot_id, files, now, batch_id)
        self.log_batch(batch_id, "committed", len(files), now)
        self._add("journal", (tx, "committed", batch_id, len(files), now))

    def rollback(self, tx: str, batch_id: str, now: float) -> None:
        if not self._end(tx, "rolled back"):
            raise Taken(f"transaction {tx} was committed")
        self._add("journal", (tx, "rolled back", batch_id, 0, now))

    def pending(self) -> DataFrame:
        ended = self.table("journal").where("state <> 'pending'").select("tx_id")
        return self.table("journal").where("state = 'pending'").join(ended, "tx_id", "left_anti")

    def recover(self, now: float, *, idle: float = 0.0) -> list[str]:
        """Ends transactions that are pending and began `idle` seconds ago or earlier; the ids of batches among them that were committed."""
        open_ = self.pending().where(F.col("created_at") <= now - idle).collect()  # one row for each writer that died
        for r in open_:
            try:
                self.rollback(r.tx_id, r.batch_id, now)
            except Taken:  # its writer died, or still is, between the end of the transaction and its journal
                continue
        return [r.batch_id for r in open_ if self.batch_exists(r.batch_id)]


class Versions:
    """Versions of tables as folders, and a pointer that says which one is current.

    Version numbers and places in the manifest are claimed, so that no two writers share one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("seq long, version long, action string").parquet(f"{self.root}/_manifest").select("seq", "version", "action")
        except Exception as e:  # the first version is yet to come
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _log(self, version: int, action: str) -> None:
        m = self._manifest()
        seq = next_number(self.spark, f"{self.root}/_seqs", 1 + ((m.agg(F.max("seq")).first()[0] or 0) if m is not None else 0))
        self.spark.createDataFrame([(seq, version, action)], "seq long, version long, action string").coalesce(1).write.parquet(f"{self.root}/_manifest/change={seq}")

    def list(self) -> list[int]:
        m = self._manifest()
        return [] if m is None else sorted(r.version for r in m.where("action = 'create'").select("version").distinct().collect())

    def current(self) -> int | None:
        m = self._manifest()
        return None if m is None else m.agg(F.max_by("version", "seq")).first()[0]

    def create(self, **tables: DataFrame) -> int:
        version = next_number(self.spark, f"{self.root}/_versions", max(self.list(), default=0) + 1)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/version={version}/{name}")
        self._log(version, "create")
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/version={version or self.current()}/{name}")

    def restore(self, version: int) -> bool:
        if version not in self.list():
            return False
        self._log(version, "restore")
        return True

    def diff(self, name: str, a: int, b: int, key: str = "doc_id") -> DataFrame:
        return version_diff(self.read(name, a), self.read(name, b), key)
