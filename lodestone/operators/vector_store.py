"""A stored IVF-PQ index, and a vector store of appended rows that can keep codes alone.

An index is a folder: `model.json` (cells and code books, of bounded size), and `codes`, a table of
doc_id, codes, and the vectors unless only codes are kept, partitioned by cell. Codes are of
residuals: what a vector differs from the centre of its cell. A search sends blocks of queries
to the tasks as tables of distances, reads the cells that some query of the block probes
(a join on the partition column, so others are pruned), adds up looked-up distances, and scores
a fixed multiple of k rows of each query exactly.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import dot
from lodestone.sources.commit_log import next_number
from lodestone.sources.shared import fresh_folder, made_folder, read_text, stored, write_text

#: Bytes of look-up tables that are sent at once, and of rows in a batch to Python; scores that are held at once.
TABLE_BYTES, BATCH_BYTES, SCORES = 8 << 20, 4 << 20, 1 << 21
MIN_CELLS, MAX_CELLS, PROBED = 16, 4096, 0.25
#: A row is written to so many cells, its nearest ones; the first, its home, has the vector.
HOMES = 2


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Centres of a bounded sample; a cell without rows keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        order = np.argsort(near, kind="stable")
        used, starts = np.unique(near[order], return_index=True)
        centres[used] = np.add.reduceat(x[order], starts, axis=0) / np.diff(np.append(starts, len(x)))[:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    lengths = (centres**2).sum(axis=1)
    return np.concatenate([(lengths - 2 * x[a : a + 4096] @ centres.T).argmin(axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


class Model:
    """Centres of cells, and code books (part, code, place) of residuals; the last part may be filled up with zeros."""

    def __init__(self, cells: np.ndarray, books: np.ndarray):
        self.cells, self.books = cells, books
        self.m, self.codes, self.width = books.shape
        self.dim = cells.shape[1]

    @classmethod
    def fit(cls, docs: DataFrame, *, cells: int | None = None, m: int = 16, codes: int = 256, train_rows: int = 50_000, seed: int = 7) -> Model:
        """From train_rows rows at most, by hash. Of n rows there are 8 * sqrt(n) cells, MIN_CELLS to MAX_CELLS."""
        sample = docs.where("embedding is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("embedding").toArrow()
        if not sample.num_rows:
            raise ValueError("there are no vectors to learn cells and codes from")
        x = matrix(sample.column(0).combine_chunks())
        n = len(x) if len(x) < train_rows else docs.count()
        cells = cells or min(MAX_CELLS, max(MIN_CELLS, 8 * math.isqrt(n)))
        centres = kmeans(x, cells if len(x) >= cells else max(2, len(x) // 2), seed)
        left = x - centres[nearest(x, centres)]
        width = -(-x.shape[1] // m)
        left = np.pad(left, ((0, 0), (0, m * width - x.shape[1])))
        codes = min(codes, max(2, len(x) // 8))
        books = [kmeans(left[:, p * width : (p + 1) * width], codes, seed) for p in range(m)]
        return cls(centres, np.stack([np.pad(b, ((0, codes - len(b)), (0, 0)), mode="edge") for b in books]))

    def coded(self, x: np.ndarray, homes: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cells of each row, and the codes of what it differs from each of them by."""
        away = (self.cells**2).sum(axis=1) - 2 * x @ self.cells.T
        cell = np.argsort(away, axis=1, kind="stable")[:, :homes]
        left = np.pad(x[:, None] - self.cells[cell], ((0, 0), (0, 0), (0, self.m * self.width - self.dim))).reshape(-1, self.m * self.width)
        codes = np.stack([nearest(left[:, p * self.width : (p + 1) * self.width], b) for p, b in enumerate(self.books)], axis=1)
        return cell, codes.reshape(*cell.shape, self.m)

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        left = np.concatenate([self.books[p][codes[:, p]] for p in range(self.m)], axis=1)
        return self.cells[cell] + left[:, : self.dim]

    def to_json(self) -> str:
        return json.dumps({"cells": self.cells.tolist(), "books": self.books.tolist()})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        return cls(np.array(d["cells"]), np.array(d["books"]))


class StoredIvfPq:
    def __init__(self, spark: SparkSession, root: str, model: Model):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    @classmethod
    def build(cls, docs: DataFrame, root: str, *, model: Model | None = None, pq_only: bool = False, **fit: int) -> StoredIvfPq:
        """Writes an index of docs (doc_id, embedding). pq_only leaves the vectors out."""
        rows = docs.where(F.col("embedding").isNotNull()).select("doc_id", "embedding")
        index = cls(docs.sparkSession, root, model or Model.fit(rows, **fit))
        index._coded(rows, pq_only).write.partitionBy("cell").mode("overwrite").parquet(f"{index.root}/codes")
        write_text(index.spark, f"{index.root}/model.json", index.model.to_json())
        return index

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> StoredIvfPq:
        return cls(spark, root, Model.from_json(read_text(spark, f"{root.rstrip('/')}/model.json")))

    def _coded(self, rows: DataFrame, pq_only: bool, homes: int = HOMES) -> DataFrame:
        """(doc_id, home, cell, codes, embedding in the row of its home): a row for each of the nearest cells."""
        model, kind = self.model, rows.schema["doc_id"].dataType.simpleString()
        names = ["doc_id", "home", "cell", "codes", *([] if pq_only else ["embedding"])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in (whole.slice(a, 1024) for a in range(0, whole.num_rows, 1024)):
                    cell, codes = model.coded(matrix(b.column("embedding")), homes)
                    for n in range(cell.shape[1]):
                        packed = pa.array([r.tobytes() for r in codes[:, n].astype(np.uint8)], pa.binary())
                        vector = [] if pq_only else [b.column("embedding") if n == 0 else pa.nulls(b.num_rows, b.column("embedding").type)]
                        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cell[:, 0], pa.int32()), pa.array(cell[:, n], pa.int32()), packed, *vector], names)

        vector = "" if pq_only else f", embedding {rows.schema['embedding'].dataType.simpleString()}"
        # rows of a cell are written together; a crowded cell is split
        return rows.mapInArrow(run, f"doc_id {kind}, home int, cell int, codes binary{vector}").hint("rebalance", "cell")

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/codes")

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(qid, cell, place): the cells of largest inner product of each query (qid, embedding)."""
        cells, kind = self.model.cells, queries.schema["qid"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = np.argsort(-(matrix(b.column("embedding")) @ cells.T), axis=1, kind="stable")[:, :nprobe]
                of = np.repeat(np.arange(b.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(of)), pa.array(near.ravel(), pa.int32()), pa.array(np.tile(np.arange(1, near.shape[1] + 1), b.num_rows), pa.int32())], ["qid", "cell", "place"])

        return queries.mapInArrow(run, f"qid {kind}, cell int, place int").where(F.col("place") <= nprobe)

    def candidates(self, queries: DataFrame, most: int, nprobe: int) -> DataFrame:
        """(qid, doc_id, score, home): for each query up to `most` rows of the cells it probes, by looked-up distances; of a block of queries."""
        model = self.model
        asked = queries.select("qid", "embedding").toArrow().combine_chunks()  # a block of bounded bytes
        q = matrix(asked.column("embedding").combine_chunks())
        kind, id_kind = queries.schema["qid"].dataType.simpleString(), self.table().schema["doc_id"].dataType.simpleString()
        qids = asked.column("qid").combine_chunks()
        bases = q @ model.cells.T
        parts = np.pad(q, ((0, 0), (0, model.m * model.width - model.dim))).reshape(len(q), model.m, model.width)
        tables = np.einsum("qmw,mcw->mcq", parts, model.books).astype(np.float32)
        probing = np.argsort(-bases, axis=1, kind="stable")[:, :nprobe]
        askers: dict[int, np.ndarray] = {}
        for c in np.unique(probing):
            askers[int(c)] = np.flatnonzero((probing == c).any(axis=1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = b.column("cell").to_numpy()
                codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, model.m)
                for c in np.unique(cell):
                    who, of_cell = askers.get(int(c)), np.flatnonzero(cell == c)
                    if who is None:
                        continue
                    mine, room = tables[:, :, who], max(most, SCORES // len(who))
                    for rows in (of_cell[a : a + room] for a in range(0, len(of_cell), room)):
                        score = bases[who, c] + reduce(np.add, (mine[p][codes[rows, p]] for p in range(model.m))).astype(np.float64)
                        best = np.argpartition(-score, most - 1, axis=0)[:most] if len(rows) > most else np.broadcast_to(np.arange(len(rows))[:, None], score.shape)
                        of, at = np.broadcast_to(who, best.shape).ravel(), rows[best.ravel()]
                        yield pa.RecordBatch.from_arrays([qids.take(pa.array(of)), b.column("doc_id").take(pa.array(at)), b.column("home").take(pa.array(at)), pa.array(np.take_along_axis(score, best, axis=0).ravel())], ["qid", "doc_id", "home", "score"])

        probed = F.broadcast(self.probes(queries, nprobe).select("cell").distinct())  # MAX_CELLS rows of an int at most
        read = self.table().select("doc_id", "home", "codes", "cell").join(probed, "cell", "left_semi")
        found = read.mapInArrow(run, f"qid {kind}, doc_id {id_kind}, home int, score double")
        found = found.groupBy("qid", "doc_id").agg(F.max("score").alias("score"), F.max("home").alias("home"))  # it may have two cells among the probed
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= most).drop("_nth")

    def search(self, queries: DataFrame, k: int, *, nprobe: int | None = None, widen: int = 8) -> DataFrame:
        """(qid, doc_id, score, rank) of queries (qid, embedding): widen * k candidates scored exactly, or by codes where only they are kept.

        A quarter of the cells is probed unless nprobe says otherwise. Blocks of queries come one after the other.
        """
        nprobe = min(nprobe or max(1, int(PROBED * len(self.model.cells))), len(self.model.cells))
        queries = stored(queries.where(F.col("embedding").isNotNull()).select("qid", "embedding"))
        n_blocks = max(1, -(-queries.count() * self.model.m * self.model.codes * 4 // TABLE_BYTES))
        folder = fresh_folder(self.spark, "candidates")
        out = None
        for n in range(n_blocks):
            block = queries.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == n) if n_blocks > 1 else queries
            if n_blocks == 1:
                out = self.candidates(block, widen * k, nprobe)
            elif not block.isEmpty():
                self.candidates(block, widen * k, nprobe).write.mode("append").parquet(folder)
        found = out if out is not None else self.spark.read.parquet(folder)
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
        if "embedding" in self.table().columns:
            exact = found.drop("score").join(self.table().where("cell = home").select("doc_id", F.col("cell").alias("home"), "embedding"), ["home", "doc_id"]).join(queries.withColumnRenamed("embedding", "_q"), "qid")
            found = exact.select("qid", "doc_id", dot(F.col("embedding"), F.col("_q")).alias("score"))
        return found.select("qid", "doc_id", "score").withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)

    def decoded(self, rows: DataFrame) -> DataFrame:
        """doc_id and the vector that the codes of rows (doc_id, cell, codes) stand for."""
        model, kind = self.model, rows.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, model.m)
                x = model.decoded(b.column("cell").to_numpy(), codes).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * model.dim, pa.int32()), pa.array(x.ravel()))], ["doc_id", "embedding"])

        return rows.select("doc_id", "cell", "codes").mapInArrow(run, f"doc_id {kind}, embedding array<float>")


class VectorStore:
    """Vectors by id under a folder: every call appends rows with a number of its own, the last one of an id holds.

    precision is f32 (vectors as they are) or pq (codes of a model alone: get gives what they
    stand for). Appending before a pq store has a model is an error, as its rows could not be kept.
    """

    SCHEMA = {"f32": "seq long, doc_id long, embedding array<float>", "pq": "seq long, doc_id long, cell int, codes binary"}

    def __init__(self, spark: SparkSession, root: str, *, precision: str = "f32", model: Model | None = None):
        self.spark, self.root, self.precision, self.model = spark, root.rstrip("/"), precision, model
        made_folder(spark, f"{self.root}/rows")
        write_text(spark, f"{self.root}/precision", precision)
        if model is not None:
            write_text(spark, f"{self.root}/model.json", model.to_json())

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> VectorStore:
        kind = read_text(spark, f"{root.rstrip('/')}/precision")
        return cls(spark, root, precision=kind, model=Model.from_json(read_text(spark, f"{root.rstrip('/')}/model.json")) if kind == "pq" else None)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA[self.precision]).parquet(f"{self.root}/rows").select(*self._names())

    def _names(self) -> list[str]:
        return [c.split()[0] for c in self.SCHEMA[self.precision].split(", ")]

    def add(self, doc_id: int, embedding: list[float]) -> None:
        self.add_batch(self.spark.createDataFrame([(doc_id, embedding)], "doc_id long, embedding array<float>"))

    def add_batch(self, docs: DataFrame) -> None:
        """Adds docs (doc_id, embedding); a known id gets a new vector. Calls have numbers of their own, so writers don't disturb each other."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("embedding is not null")
        if self.precision == "pq":
            if self.model is None:
                raise ValueError("a store of codes needs a model before rows are added")
            rows = StoredIvfPq(self.spark, self.root, self.model)._coded(rows, True, homes=1)
        seq = next_number(self.spark, f"{self.root}/_seqs")
        rows.withColumn("seq", F.lit(seq).cast("long")).select(*self._names()).write.parquet(f"{self.root}/rows/call={seq}")

    def live(self) -> DataFrame:
        """The last row of each id."""
        rows = self._rows()
        rest = [c for c in rows.columns if c != "doc_id"]
        return rows.groupBy("doc_id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("doc_id", "r.*").drop("seq")

    def vectors(self) -> DataFrame:
        return self.live() if self.precision == "f32" else StoredIvfPq(self.spark, self.root, self.model).decoded(self.live())

    def get(self, doc_ids: list[int] | DataFrame) -> DataFrame:
        """doc_id and vector of those ids; null where there is none. A list is for a few ids, more come as a table."""
        wanted = doc_ids.select("doc_id") if isinstance(doc_ids, DataFrame) else self.spark.createDataFrame([(i,) for i in doc_ids], "doc_id long")
        return wanted.join(self.vectors(), "doc_id", "left")

    def total_vectors(self) -> int:
        return self._rows().select("doc_id").distinct().count()

    def info(self) -> DataFrame:
        """One row: rows appended, vectors, dimension, kind of store and the kind of index that suits it."""
        from .vectors import index_kind

        rows = self._rows()
        dim = F.max(F.size("embedding")) if self.precision == "f32" else F.lit(self.model.dim if self.model else None)
        n = F.countDistinct("doc_id")
        return rows.agg(F.count(F.lit(1)).alias("appended"), n.alias("total_vectors"), dim.cast("bigint").alias("dimension")).withColumns({"precision": F.lit(self.precision), "kind": index_kind(F.col("total_vectors"))})
