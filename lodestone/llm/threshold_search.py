"""Exact top-k by inner product: Fagin's threshold algorithm over sorted lists of each dimension.

Rows are stored in blocks. A block keeps the sorted list of every dimension only as far as the
algorithm needs it: reading all lists from both ends in step, a row is met at the least of its
places in them, so rows lie in the order in which they are met, in steps, and each step has
the values that the lists have reached before it. No row beyond can score more than the sum
of weights times those values: the list is read from its top for a positive weight, from its
bottom for a negative one. A batch of queries reads the lists together; a query stops in a
block as soon as its k-th best score is above that bound. Scores equal to the bound go on, as
ties go to the smaller vec_id.

Queries are sent to the tasks in blocks of bounded bytes, one after the other; their first
k-th scores come from one block of rows, so that most tasks hand on few rows.

Edge cases: vectors that are null or hold null or non-finite components take no part; shorter
vectors end in zeros; of rows that share a vec_id divisible by `every` the one with the least
vector is the query, and none of them is a candidate of it; otherwise repeated rows are
candidates of their own; a null vec_id is no query and comes last in ties; with fewer
candidates than k there are fewer rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import fresh_folder

from .common import byte_batches, stored
from .whole_vectors import EXACT, blob, extent, usable, whole

FACTOR, EVERY, TOP = 256, 50, 5
#: Bytes of the vectors of a block of rows, and of the queries that are sent at once; scores held at once.
BLOCK_BYTES, QUERY_BYTES, SCORES = 1 << 20, 4 << 20, 1 << 22
#: Steps in which the rows of a block are met.
STEPS = 8
LEAST, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
BLOCK = "ids binary, x binary, ends array<int>, lows binary, highs binary"
RESULT = "query_id long, vec_id long, score long"


def block_of(ids: np.ndarray, x: np.ndarray) -> tuple[bytes, bytes, list[int], bytes, bytes]:
    """A block: ids and vectors in steps (by id in each), the end of each step, and what the lists have reached before it."""
    n = len(x)
    lists = np.argsort(x, axis=0, kind="stable")
    place = np.empty_like(lists)
    np.put_along_axis(place, lists, np.broadcast_to(np.arange(n)[:, None], lists.shape), axis=0)
    met = np.minimum(place, n - 1 - place).min(axis=1)
    depths = np.unique(np.append(0, np.sort(met)[np.arange(1, STEPS) * n // STEPS]))
    step = np.searchsorted(depths, met, side="right") - 1
    order = np.lexsort((ids, step))
    values = np.sort(x, axis=0)
    ends = np.cumsum(np.bincount(step, minlength=len(depths)))
    return blob(ids[order], np.int64), blob(x[order], np.int32), ends.tolist(), blob(values[depths], np.int32), blob(values[n - 1 - depths], np.int32)


def blocks(rows: DataFrame, factor: int, dim: int) -> DataFrame:
    """All rows in blocks of BLOCK_BYTES or less; a task makes blocks of its own rows."""
    most = max(1, BLOCK_BYTES // (4 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, held = [], [], 0

        def out() -> pa.RecordBatch:
            parts = zip(*[block_of(np.concatenate(ids), np.concatenate(xs))], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(parts, (pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary()), strict=True)], ["ids", "x", "ends", "lows", "highs"])

        for whole_batch in batches:
            start = 0
            while start < whole_batch.num_rows:
                b = whole_batch.slice(start, most - held)
                start += b.num_rows
                held += b.num_rows
                ids.append(b.column("vec_id").fill_null(NO_ID).to_numpy())
                xs.append(whole(b.column("embedding"), factor, dim))
                if held == most:
                    yield out()
                    ids, xs, held = [], [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, BLOCK)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores of each row and their ids; columns are in order of ids, of equal scores the first are taken."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
        more = scores > kth
        equal = scores == kth
        taken = more | (equal & (np.cumsum(equal, axis=1) <= k - more.sum(axis=1, keepdims=True)))
        at = np.nonzero(taken)[1].reshape(len(scores), k)
        return np.take_along_axis(scores, at, axis=1), ids[at]
    short = ((0, 0), (0, k - scores.shape[1]))
    return np.pad(scores, short, constant_values=LEAST), np.pad(np.broadcast_to(ids, scores.shape), short, constant_values=NO_ID)


def merged(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists of each row, by falling score, then id."""
    s, i = np.concatenate([scores, more], axis=1), np.concatenate([ids, more_ids], axis=1)
    by_id = np.argsort(i, axis=1, kind="stable")
    s, i = np.take_along_axis(s, by_id, axis=1), np.take_along_axis(i, by_id, axis=1)
    at = np.argsort(-1 - s, axis=1, kind="stable")[:, :k]  # -1 - s: the least long has no negative
    return np.take_along_axis(s, at, axis=1), np.take_along_axis(i, at, axis=1)


def search(index: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int, bound: int, floor: np.ndarray | None = None) -> DataFrame:
    """(query_id, vec_id, score): for each task its k best of each query, if they reach the floor."""
    dim = queries.shape[1]
    kind = np.float64 if dim * bound * bound < EXACT else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        best, best_ids = np.full((len(q), k), LEAST), np.full((len(q), k), NO_ID)
        least = np.full(len(q), LEAST) if floor is None else floor
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"], np.int32).reshape(-1, dim).astype(kind)
                lows, highs = (np.frombuffer(r[c], np.int32).reshape(-1, dim).astype(kind) for c in ("lows", "highs"))
                limits = (up @ highs.T + down @ lows.T).astype(np.int64)
                start = 0
                for n, end in enumerate(r["ends"]):
                    going = np.flatnonzero(limits[:, n] >= np.maximum(best[:, -1], least))
                    if not len(going):
                        break  # bounds of later steps are no larger
                    room = max(1, SCORES // (end - start))
                    for some in (going[a : a + room] for a in range(0, len(going), room)):
                        s = (q[some] @ x[start:end].T).astype(np.int64)
                        a, b = (np.searchsorted(ids[start:end], query_ids[some], side=side) for side in ("left", "right"))
                        for row in np.flatnonzero(b > a):
                            s[row, a[row] : b[row]] = LEAST
                        hit = s.max(axis=1) >= np.maximum(np.maximum(best[some, -1], least[some]), LEAST + 1)
                        if hit.any():
                            best[some[hit]], best_ids[some[hit]] = merged(best[some[hit]], best_ids[some[hit]], *best_of(s[hit], ids[start:end], k), k)
                    start = end
        rows, cols = np.nonzero((best > LEAST) & (best >= least[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (query_ids[rows], best_ids[rows, cols], best[rows, cols])], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, RESULT)


def top_k(rows: DataFrame, *, every: int = EVERY, k: int = TOP, factor: int = FACTOR, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every` its k best other rows."""
    spark = rows.sparkSession
    byte_batches(spark)
    fine = usable(rows).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    dim, bound = extent(fine, factor)
    dim = max(dim, 1)
    index = stored(blocks(fine, factor, dim))
    asked = fine.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stored(asked)
    n_blocks = -(-asked.count() * dim * 8 // query_bytes)
    found = fresh_folder(spark, "found")
    spark.createDataFrame([], RESULT).write.parquet(found)
    first = index.limit(1)
    for n in range(n_blocks):
        # an even share of the queries, by hash: query_bytes or little more
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == n).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        ids, vectors = part.column("vec_id").to_numpy(), whole(part.column("embedding").combine_chunks(), factor, dim)
        floor = dict(search(first, ids, vectors, k, bound).groupBy("query_id").agg(F.min("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("query_id", "min(score)").collect())
        least = np.array([floor.get(i, LEAST) for i in ids.tolist()], np.int64)
        search(index, ids, vectors, k, bound, least).write.mode("append").parquet(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = spark.read.schema(RESULT).parquet(found).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
