"""Codes of vectors by product quantisation, in whole numbers, with Yinyang bounds between rounds.

Vectors are cut into equal consecutive parts, each with a codebook of its own. The entries of
a codebook are clustered into groups once. A row carries, for each part, its entry and one
lower bound of the distance to every group; a bound shrinks by the largest drift of its group
in a round, and only groups whose bound no longer exceeds the distance to the row's own
entry are scanned. Bounds are floating point and err on the safe side; distances that decide
are whole numbers, with ties to the lower index, so the codes are those of a full scan.

A round is one pass over a stored table that holds vectors, entries and bounds; each task adds
up the parts of its rows by entry, and the sums are added in Spark. The driver sees no more
than the codebooks.

Edge cases: a null vector, or one with null or non-finite components, takes no part; vectors
shorter than the longest one end in zeros, and a dimension that the parts don't divide is
filled up with zeros; rows that share a vec_id are rows of their own, and null ids come last;
with fewer rows than entries the codebooks are that much smaller; an empty table gives no
rows; columns other than vec_id, embedding and those named by keep are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import fresh_folder, removed

from .common import byte_batches, stored
from .whole_vectors import blob, extent, products, unblob, usable, whole

FACTOR, PARTS, ENTRIES, ROUNDS, GROUPS = 1024, 4, 256, 4, 16
#: In place of a slot: how many distances a task has computed.
WORK = -1
NEVER = np.iinfo(np.int64).max
#: What floating point may be off by, relative to a distance.
SLACK = 1e-6


@dataclass
class Quantiser:
    """Codebooks (part, entry, place), groups of entries by part, drift of each group in the last round."""

    books: np.ndarray
    groups: list[list[np.ndarray]]
    drift: np.ndarray
    bound: int

    @property
    def parts(self) -> int:
        return len(self.books)

    @property
    def n_groups(self) -> int:
        return self.drift.shape[1]

    def moved_to(self, books: np.ndarray) -> Quantiser:
        far = np.sqrt(((books - self.books).astype(np.float64) ** 2).sum(axis=2)) * (1 + SLACK)
        drift = np.array([[far[p][g].max() if len(g) else 0.0 for g in groups] for p, groups in enumerate(self.groups)])
        return Quantiser(books, self.groups, drift, self.bound)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def grouped(entries: np.ndarray, n: int) -> list[np.ndarray]:
    """Indexes of the entries in n clusters (some may be empty), ascending in each. Any grouping gives the same codes."""
    x = entries.astype(np.float64)
    centres = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(5):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(near):
            centres[g] = x[near == g].mean(axis=0)
    return [np.flatnonzero(near == g) for g in range(n)]


def nearest(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray], drift: np.ndarray, bound: int, at: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each row, its squared distance, new bounds, and how many distances were computed.

    at and low are entries and bounds of the round before; low is changed in place.
    """
    own = ((x - book[at]) ** 2).sum(axis=1)
    low -= drift
    open_ = low <= (np.sqrt(own.astype(np.float64)) * (1 + SLACK) + SLACK)[:, None]
    best, least = at.copy(), own.copy()
    scans = []
    lengths = (x**2).sum(axis=1)
    for g, members in enumerate(groups):
        rows = np.flatnonzero(open_[:, g]) if len(members) else np.zeros(0, np.int64)
        if not len(rows):
            continue
        c = book[members]
        d = lengths[rows][:, None] - 2 * products(x[rows], c, bound) + (c**2).sum(axis=1)
        place = d.argmin(axis=1)
        index = members[place]
        first = d[np.arange(len(rows)), place]
        d[np.arange(len(rows)), place] = NEVER
        second = d.min(axis=1)
        scans.append((g, rows, index, first, second))
        better = (first < least[rows]) | ((first == least[rows]) & (index < best[rows]))
        least[rows[better]], best[rows[better]] = first[better], index[better]
    # the entry that a row has left counts for its group from now on
    home = np.zeros(len(book), np.int64)
    for g, members in enumerate(groups):
        home[members] = g
    left = np.flatnonzero(best != at)
    low[left, home[at[left]]] = np.minimum(low[left, home[at[left]]], np.sqrt(own[left].astype(np.float64)))
    for g, rows, index, first, second in scans:
        low[rows, g] = np.sqrt(np.where(index == best[rows], second, first).astype(np.float64))
    return best, least, low, sum(len(rows) * len(groups[g]) for g, rows, *_ in scans)


def _pass(state: DataFrame, q: Quantiser, kept: list[str], *, last: bool) -> DataFrame:
    """One assignment of all rows: the rows with new entries and bounds, and sums of parts by slot; or codes and errors."""
    width, n_groups = q.books.shape[2], q.n_groups
    fields = [f for f in state.schema.fields if f.name in kept]
    names = [f.name for f in fields]
    out = "code string, error long" if last else "x binary, at binary, low binary, slot int, sums array<long>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((q.parts * len(q.books[0]), width + 1), np.int64)
        scanned, passed = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            passed = [b.column(n) for n in names]
            x = unblob(b.column("x"), np.int32, q.parts * width).astype(np.int64).reshape(-1, q.parts, width)
            at = unblob(b.column("at"), np.int16, q.parts).astype(np.int64)
            low = unblob(b.column("low"), np.float32, q.parts * n_groups).astype(np.float64).reshape(-1, q.parts, n_groups)
            error = np.zeros(b.num_rows, np.int64)
            for p in range(q.parts):
                at[:, p], least, low[:, p], n = nearest(x[:, p], q.books[p], q.groups[p], q.drift[p], q.bound, at[:, p].copy(), low[:, p].copy())
                error += least
                scanned += n
                order = np.argsort(at[:, p], kind="stable")
                used, starts = np.unique(at[order, p], return_index=True)
                totals[used + p * len(q.books[0]), 0] += np.diff(np.append(starts, b.num_rows))
                totals[used + p * len(q.books[0]), 1:] += np.add.reduceat(x[order, p], starts, axis=0)
            if last:
                codes = [r.tobytes().hex() for r in at.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*passed, pa.array(codes, pa.string()), pa.array(error)], [*names, "code", "error"])
                continue
            below = np.nextafter(low.astype(np.float32), np.float32(-np.inf)).reshape(b.num_rows, -1)
            new = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (at.astype(np.int16), below)]
            none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*passed, b.column("x"), *new, *none], [*names, "x", "at", "low", "slot", "sums"])
        if passed is not None and not last:
            used = np.flatnonzero(totals[:, 0])
            slots, sums = pa.array([*used.tolist(), WORK], pa.int32()), pa.array([*totals[used].tolist(), [scanned]], pa.list_(pa.int64()))
            empty = [pa.nulls(len(slots), t) for t in (*(c.type for c in passed), *[pa.binary()] * 3)]
            yield pa.RecordBatch.from_arrays([*empty, slots, sums], [*names, "x", "at", "low", "slot", "sums"])

    return state.mapInArrow(run, schema)


def _updated(q: Quantiser, sums: DataFrame) -> tuple[Quantiser, int]:
    """The means of the parts of each entry, rounded down; unused entries stay. Also the distances computed."""
    rows = sums.select("slot", F.posexplode("sums").alias("place", "value")).groupBy("slot", "place").agg(F.sum("value").alias("value"))
    found = {(r.slot, r.place): r.value for r in rows.collect()}  # entries x (width + 1) rows of each part at most
    scanned = found.pop((WORK, 0))
    totals = np.zeros((q.parts * q.books.shape[1], q.books.shape[2] + 1), np.int64)
    for at, value in found.items():
        totals[at] = value
    counts = totals[:, 0].reshape(*q.books.shape[:2], 1)
    means = totals[:, 1:].reshape(q.books.shape) // np.maximum(counts, 1)
    return q.moved_to(np.where(counts > 0, means, q.books)), scanned


def yinyang_codes(rows: DataFrame, *, keep: tuple[str, ...] = (), factor: int = FACTOR, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, Quantiser | None, list[int]]:
    """(vec_id, columns named by keep, code, error) of every usable row, the quantiser, and distances computed in each round.

    A codebook starts as that part of the first rows in order of vec_id. entries is 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    spark = rows.sparkSession
    byte_batches(spark)
    names = ["vec_id", *keep]
    fine = usable(rows).select(F.col("vec_id").cast("long").alias("vec_id"), *keep, "embedding")
    dim, bound = extent(fine, factor)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in fine.schema.fields if f.name in names]
    first = [r.embedding for r in fine.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()]
    if not first:
        return spark.createDataFrame([], ", ".join([*fields, "code string, error long"])), None, []
    width = max(1, -(-dim // parts))
    start = whole(pa.array(first, pa.list_(pa.float64())), factor, parts * width)
    books = np.stack([start[:, p * width : (p + 1) * width] for p in range(parts)])
    n_groups = min(groups, len(first))
    q = Quantiser(books, [grouped(b, n_groups) for b in books], np.zeros((parts, n_groups)), bound)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, low = blob(np.zeros(parts), np.int16), blob(np.full(parts * n_groups, -np.inf), np.float32)
        for b in batches:
            x = [r.tobytes() for r in whole(b.column("embedding"), factor, parts * width).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(v, pa.binary()) for v in (x, [at] * len(x), [low] * len(x)))], [*names, "x", "at", "low"])

    state = fine.mapInArrow(begin, ", ".join([*fields, "x binary, at binary, low binary"]))
    scanned, before = [], None
    for _ in range(rounds):
        folder = fresh_folder(spark, "codes")
        made = _pass(state, q, names, last=False)
        made.write.option("compression", "none").parquet(folder)
        table = spark.read.schema(made.schema).parquet(folder)
        q, n = _updated(q, table.where("slot is not null"))
        scanned.append(n)
        state = table.where("slot is null").select(*names, "x", "at", "low")
        if before:
            removed(spark, before)
        before = folder
    coded = stored(_pass(state, q, names, last=True))
    if before:
        removed(spark, before)
    return coded, q, scanned


def code_digest(rows: DataFrame) -> DataFrame:
    """The codes of rows with label, the error summed over equal labels, and the digest of the codebooks."""
    coded, q, _ = yinyang_codes(rows, keep=("label",))
    sums = stored(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(q.digest() if q else "").alias("codebooks_sha256"))
