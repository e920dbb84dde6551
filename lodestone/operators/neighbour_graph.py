"""A navigable neighbour graph over vectors: built by NN-descent, stored as an adjacency table, searched in beam rounds.

Building: vectors are sorted by the sides of random planes they lie on, several times, and linked to the best of
their part of each order; these links are improved in rounds. In a round every node shows its neighbours (those
it links to and some that link to it) to each other; a node keeps the best it has been shown. Lists in which
nothing is new are left out, as all their members have met. Finally each list is thinned: a
neighbour that lies nearer to a kept one than to the node itself goes last. All work is joins,
windows and Arrow tables: parts of less than 2 `PART` vectors, blocks of lists, and single lists, which never have more than
twice `width` members.

While links are improved, vectors go to lists as one byte for each component, and once to a block of lists; a block and
all vectors it may need have `BLOCK_BYTES` or less. Links are compared by whole inner products of these bytes, which do
not depend on where they are computed. Thinning and searching have the vectors themselves.

Searching: all queries start from the same entries, spread by hash. In a round each query opens its best
unopened nodes, scores the neighbours it has not met and keeps its best `ef`; it ends when those
are all open. Neighbours are near by cosine, results are scored by inner product.

Null vectors are left out; doc_id must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import dot
from lodestone.sources.shared import byte_batches, fresh_folder, removed, stored

LISTS = "doc_id long, other long, score float, fresh boolean"
#: Vectors that are compared with each other in one part of an order, and planes that make an order.
PART, PLANES = 512, 40
BLOCK_BYTES = 128 << 20


def _unit(column: str) -> Column:
    size = F.sqrt(dot(F.col(column), F.col(column)))
    return F.transform(column, lambda x: (x / F.when(size > 0, size).otherwise(1.0)).cast("float"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _bytes(codes: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(codes), -1)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A unit vector v as bytes of its components; step is what one stands for."""
    for b in batches:
        if not b.num_rows:
            continue
        v = _matrix(b.column("v"))
        step = np.maximum(np.abs(v).max(axis=1), 1e-30) / 127
        codes = np.rint(np.nan_to_num(v / step[:, None])).astype(np.int8)
        columns = [b.column("doc_id"), b.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step.astype(np.float32))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "v", "code", "step"])


def _scores(codes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Of all pairs; the same for a pair wherever it meets, as sums of whole numbers are exact."""
    codes = codes.astype(np.float64)
    s = ((codes @ codes.T) * (step[:, None] * step)).astype(np.float32)
    s[np.isnan(s)] = -3.0
    np.fill_diagonal(s, -3.0)
    return s


def _best(s: np.ndarray, most: int) -> np.ndarray:
    """The least score among the `most` best of each row."""
    return np.partition(s, -most, axis=1)[:, -most, None] if s.shape[1] > most else np.full((len(s), 1), -3.0, np.float32)


def _highest(node: np.ndarray, other: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` best others of each node, repeated ones once."""
    order = np.lexsort((other, -score, node))
    node, other, score = node[order], other[order], score[order]
    once = np.append(True, (node[1:] != node[:-1]) | (other[1:] != other[:-1]))[: len(node)]
    node, other, score = node[once], other[once], score[once]
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
    good = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node)))) < most
    return node[good], other[good], score[good]


class NeighbourGraph:
    """vectors (doc_id, embedding) and edges (doc_id, neighbours: ids, best first)."""

    def __init__(self, vectors: DataFrame, edges: DataFrame):
        self.vectors, self.edges = vectors, edges
        self.spark = vectors.sparkSession
        self.scored = 0

    # ---- building

    @classmethod
    def build(cls, docs: DataFrame, *, degree: int = 12, width: int = 24, rounds: int = 8, orders: int = 8, seed: int = 7) -> NeighbourGraph:
        """width is the length of the lists while they are improved, degree that of those that stay."""
        byte_batches(docs.sparkSession)
        vectors = stored(docs.where(F.col("embedding").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "embedding"))
        units = stored(vectors.select("doc_id", _unit("embedding").alias("v")).mapInArrow(_coded, "doc_id long, v array<float>, code binary, step float"))
        n, dim = units.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        blocks = n * 2 * width * ((dim or 0) + 24) // BLOCK_BYTES + 1
        links, folder = cls._kept(cls._first(units, n, dim, width, orders, seed), width)
        for _ in range(rounds):
            shown = cls._shown(links, units, width, blocks).unionByName(links.withColumn("fresh", F.lit(False)))
            before = folder
            links, folder = cls._kept(shown, width)
            removed(docs.sparkSession, before)
            count = links.agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("fresh")).first()
            if count.fresh <= count.n // 1000:
                break
        return cls(vectors, stored(cls._thinned(links, units, degree)))

    @staticmethod
    def _kept(shown: DataFrame, degree: int) -> tuple[DataFrame, str]:
        """The best `degree` of each node, stored. A pair has one score, so repeated ones share a rank."""
        best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "other")
        near = shown.where("doc_id <> other").withColumn("_nth", F.dense_rank().over(best)).where(F.col("_nth") <= degree)
        once = near.groupBy("doc_id", "other").agg(F.max("score").alias("score"), F.bool_and("fresh").alias("fresh"))
        folder = fresh_folder(shown.sparkSession, "links")
        return stored(once, folder), folder

    @staticmethod
    def _first(units: DataFrame, n: int, dim: int | None, degree: int, orders: int, seed: int) -> DataFrame:
        """The best of each vector in its part of a few orders; vectors near each other in an order are on the same side of the first planes."""
        if not dim:
            return units.sparkSession.createDataFrame([], LISTS)
        centre = units.select(F.posexplode("v")).groupBy("pos").agg(F.round(F.avg(F.nanvl("col", F.lit(None))), 6).alias("x")).orderBy("pos").collect()
        centre = np.array([r.x or 0.0 for r in centre])
        rng = np.random.default_rng(seed)
        out = None
        for _ in range(orders):
            planes = rng.normal(size=(dim, PLANES))
            at = NeighbourGraph._placing(planes, centre @ planes)
            dealt = units.select("doc_id", "code", "step").mapInArrow(at, "_at long, doc_id long, code binary, step float")
            dealt = dealt.repartitionByRange(n // (8 * PART) + 1, "_at", "doc_id").sortWithinPartitions("_at", "doc_id")
            pairs = dealt.mapInArrow(NeighbourGraph._parts(degree), LISTS)
            out = pairs if out is None else out.unionByName(pairs)
        return out

    @staticmethod
    def _placing(planes: np.ndarray, middle: np.ndarray):  # noqa: ANN205
        bits = 1 << np.arange(planes.shape[1], dtype=np.int64)[::-1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    step = b.column("step").to_numpy().astype(np.float64)
                    side = (_bytes(b.column("code")) @ planes) * step[:, None] > middle
                    yield pa.RecordBatch.from_arrays([pa.array(side @ bits), *(b.column(c) for c in ("doc_id", "code", "step"))], ["_at", "doc_id", "code", "step"])

        return run

    @staticmethod
    def _parts(degree: int):  # noqa: ANN205
        """Rows of an order in parts of PART, the last of a task with up to as many more; the best pairs of each."""

        def linked(rows: pa.Table) -> pa.RecordBatch:
            ids = rows.column("doc_id").to_numpy()
            s = _scores(_bytes(rows.column("code")), rows.column("step").to_numpy().astype(np.float64))
            i, j = np.nonzero((s >= _best(s, degree)) & (s > -3.0))
            return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(s[i, j]), pa.array(np.ones(len(i), bool))], ["doc_id", "other", "score", "fresh"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: pa.Table | None = None
            for b in batches:
                new = pa.Table.from_batches([b])
                held = new if held is None else pa.concat_tables([held, new])
                while held.num_rows >= 2 * PART:
                    yield linked(held[:PART])
                    held = held[PART:]
            if held is not None and held.num_rows > 1:
                yield linked(held)

        return run

    @staticmethod
    def _around(links: DataFrame, degree: int, blocks: int | None = None) -> DataFrame:
        """(block, doc_id, other, fresh): the links of a node and up to `degree` of those that link to it, fresh ones first, then by hash.

        Rows are dealt by block, which is a hash of the node, or by node if no number of blocks is given.
        """
        back = links.select(F.col("other").alias("doc_id"), F.col("doc_id").alias("other"), "fresh", F.lit(True).alias("_back"))
        both = links.select("doc_id", "other", "fresh", F.lit(False).alias("_back")).unionByName(back)
        some = Window.partitionBy("block", "doc_id", "_back").orderBy(F.desc("fresh"), F.xxhash64("other", "doc_id"), "other")
        dealt = both.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks or 1))).repartition("block" if blocks else "doc_id")
        near = dealt.withColumn("_nth", F.row_number().over(some)).where(~F.col("_back") | (F.col("_nth") <= degree))
        return near.groupBy("block", "doc_id", "other").agg(F.bool_or("fresh").alias("fresh"))

    @classmethod
    def _shown(cls, links: DataFrame, units: DataFrame, degree: int, blocks: int) -> DataFrame:
        """What the neighbours of each node show each other, where it beats the worst link they have; two that met before don't."""
        worst = links.groupBy("doc_id").agg(F.when(F.count(F.lit(1)) >= degree, F.min("score")).otherwise(-2.0).cast("float").alias("worst"))
        nodes = units.join(worst, "doc_id", "left").select(F.col("doc_id").alias("member"), "code", "step", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
        some = F.bool_or("fresh").over(Window.partitionBy("block", "doc_id"))
        lists = cls._around(links, degree, blocks).withColumn("_any", some).where("_any").select("block", "doc_id", "other", "fresh")
        needed = lists.select(F.col("block").alias("at"), F.col("other").alias("member")).distinct().join(nodes, "member")
        return lists.groupBy("block").cogroup(needed.groupBy("at")).applyInArrow(cls._met(degree), LISTS)

    @staticmethod
    def _met(degree: int):  # noqa: ANN205
        def run(lists: pa.Table, nodes: pa.Table) -> pa.Table:
            ids = nodes.column("member").to_numpy()
            order = np.argsort(ids)
            ids, worst, step = ids[order], nodes.column("worst").to_numpy()[order], nodes.column("step").to_numpy().astype(np.float64)[order]
            codes = _bytes(nodes.column("code"))[order]
            by = np.argsort(lists.column("doc_id").to_numpy(), kind="stable")
            node = lists.column("doc_id").to_numpy()[by]
            member, fresh = np.searchsorted(ids, lists.column("other").to_numpy()[by]), lists.column("fresh").to_numpy()[by]
            ends = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node))
            held, made, rows = [], [], 0
            for a, e in zip(ends[:-1], ends[1:], strict=True):
                m, new = member[a:e], fresh[a:e]
                s = _scores(codes[m], step[m])
                s[~(new[:, None] | new)] = -3.0
                i, j = np.nonzero((s > worst[m][:, None]) & (s >= _best(s, degree)))
                made.append((m[i], m[j], s[i, j]))
                rows += len(i)
                if rows > 1 << 22:
                    held, made, rows = [_highest(*(np.concatenate(c) for c in zip(*held, *made, strict=True)), degree)], [], 0
            i, j, s = _highest(*(np.concatenate(c) for c in zip(*held, *made, strict=True)), degree)
            return pa.table({"doc_id": ids[i], "other": ids[j], "score": s, "fresh": np.ones(len(i), bool)})

        return run

    @classmethod
    def _thinned(cls, links: DataFrame, units: DataFrame, degree: int) -> DataFrame:
        short = links.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "other"))).where(F.col("_nth") <= degree)
        lists = cls._around(short, degree).join(units.select(F.col("doc_id").alias("other"), "v"), "other").groupBy("doc_id").agg(F.collect_list(F.struct("other", "v")).alias("l"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for own, cells in zip(_matrix(b.column("v")), b.column("l"), strict=True):
                    ids = cells.values.field("other").to_numpy()
                    v = _matrix(cells.values.field("v"))
                    near = v @ own
                    order = np.lexsort((ids, -near))
                    kept: list[int] = []
                    later: list[int] = []
                    for c in order.tolist():
                        covered = bool(kept) and (v[kept] @ v[c]).max() > near[c]
                        (later if covered else kept).append(c)
                    out.append(ids[(kept + later)[:degree]].tolist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "neighbours"])

        return units.join(lists, "doc_id").select("doc_id", "v", "l").mapInArrow(run, "doc_id long, neighbours array<long>")

    # ---- storing

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighbourGraph:
        return cls(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/edges"))

    # ---- searching

    def entries(self, most: int = 256) -> DataFrame:
        """Nodes to start from: a square root of all, `most` at the utmost, by hash."""
        n = self.vectors.count()
        return self.vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(most, math.isqrt(n) + 1)).select("doc_id")

    def search(self, queries: DataFrame, k: int, *, ef: int = 16, beam: int = 4, max_rounds: int = 64) -> DataFrame:
        """(qid, doc_id, score, rank) of queries (qid, embedding); self.scored says how many rows were scored for it.

        Lists of met nodes are tables of (qid, doc_id), dealt by query; ef bounds what a query keeps. What a round
        scores is stored first, so Spark knows its size and need not shuffle all vectors for it.
        """
        asked = stored(queries.where(F.col("embedding").isNotNull()).select("qid", F.col("embedding").alias("_q")))
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
        open_first = Window.partitionBy("qid", "opened").orderBy(F.desc("score"), "doc_id")

        def scores(pairs: DataFrame) -> DataFrame:
            return stored(pairs).join(self.vectors, "doc_id").join(asked, "qid").select("qid", "doc_id", dot(F.col("embedding"), F.col("_q")).alias("score"))

        entries = [r.doc_id for r in self.entries().collect()]
        starts = asked.select("qid", F.explode(F.lit(entries).cast("array<long>")).alias("doc_id"))
        met = [stored(scores(starts))]
        held = stored(met[0].withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= ef).select("qid", "doc_id", "score", F.lit(False).alias("opened")))
        for _ in range(max_rounds):
            turn = held.withColumn("_turn", F.row_number().over(open_first)).withColumn("_now", ~F.col("opened") & (F.col("_turn") <= beam))
            front = turn.where("_now").select("qid", "doc_id")
            seen = met[0]
            for m in met[1:]:
                seen = seen.unionByName(m)
            reached = front.join(self.edges, "doc_id").select("qid", F.explode("neighbours").alias("doc_id")).distinct()
            new = stored(scores(reached.join(seen.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")))
            met.append(new)
            rows = turn.select("qid", "doc_id", "score", (F.col("opened") | F.col("_now")).alias("opened")).unionByName(new.withColumn("opened", F.lit(False)))
            held = stored(rows.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= ef).drop("_nth"))
            if held.where("not opened").isEmpty():
                break
        self.scored = sum(m.count() for m in met)
        return held.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank")
