"""Benchmark decontamination: a broadcast set of test n-grams against training windows.

Words are maximal runs of digits, letters a-z and characters beyond ASCII, after A-Z
became a-z. Every item gives its windows of window_words consecutive words; an item of
fewer words, but not none, is one window. A training text's words become numbers by the
items' vocabulary, a rolling hash of numbers is looked up in the set of window hashes, and
each hit is verified number by number.

The window set is measured first. A set of up to block_windows windows is broadcast
whole; a larger one in blocks of that many, one after the other: each is matched against
all documents, what it hits is stored, and its broadcast is dropped before the next one is
made. The words hit and items found are united by document. So what driver and executors
hold of the benchmark has a fixed bound, and the plan does not grow with it.

Edge cases: a null or empty text has no words and no hits; a null item_id is the empty
string and items that share an id count as one; rows equal in doc_id and text have equal
results, each its own row; an empty benchmark hits nothing; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, once, parts, stored, text_or_empty

WINDOW_WORDS = 10
BLOCK_WINDOWS = 200_000
#: The characters that words are made of.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SQL_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: str) -> str:
    return text.encode().lower().decode()  # of bytes, lower() changes A-Z only


def words_of(text: str) -> list[str]:
    return WORDS.findall(ascii_lower(text))


def benchmark_windows(benchmark: DataFrame, window_words: int) -> DataFrame:
    """item, words (array), once for each window that differs."""
    low = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(low, F.lit(SQL_WORDS), F.lit(0))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window_words + 1, F.lit(1))
    return items.select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda k: F.slice("w", k, window_words))).alias("words")).distinct()


class WindowSet:
    """Windows by their length: sorted hashes, the numbers of their words, and their items."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, windows: list[tuple[list[str], list[str]]]):
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for ws, _ in windows for w in ws), 1)}
        self.by_length = []
        for n in sorted({len(ws) for ws, _ in windows}):
            of_n = [(np.array([self.number[w] for w in ws], np.int32), items) for ws, items in windows if len(ws) == n]
            rows = np.stack([r for r, _ in of_n])
            hashes = self.hashes(rows.reshape(-1), n)[::n]
            order = np.argsort(hashes, kind="stable")
            self.by_length.append((n, hashes[order], rows[order], [of_n[k][1] for k in order]))

    def hashes(self, numbers: np.ndarray, n: int) -> np.ndarray:
        """Hash of each run of n numbers, wrapping at 64 bits."""
        x = numbers.astype(np.uint64)
        m = len(x) - n + 1
        out = np.zeros(m, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = out * self.MULTIPLIER + x[k : k + m]
        return out

    def hits(self, words: list[str]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items found."""
        numbers = np.fromiter(map(self.number.get, words, [0] * len(words)), np.int32, len(words))
        edge, items = np.zeros(len(words) + 1, np.int32), set()
        for n, hashes, rows, owners in self.by_length:
            if len(words) < n:
                continue
            known = np.concatenate(([0], np.cumsum(numbers > 0)))
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            got = self.hashes(numbers, n)[at]
            k = np.searchsorted(hashes, got)
            near = (k < len(hashes)) & (hashes[np.minimum(k, len(hashes) - 1)] == got)
            for p, row, h in zip(at[near].tolist(), k[near].tolist(), got[near].tolist(), strict=True):
                while row < len(hashes) and hashes[row] == h:
                    if np.array_equal(numbers[p : p + n], rows[row]):
                        edge[p] += 1
                        edge[p + n] -= 1
                        items.update(owners[row])
                    row += 1
        return np.cumsum(edge[:-1]) > 0, items


def cut_out(text: str, runs: list[dict]) -> str:
    """The text without the words of these runs and what stands between them."""
    if runs:
        places = [m.span() for m in WORDS.finditer(ascii_lower(text))]
        for r in sorted(runs, key=lambda r: r["start"], reverse=True):
            text = text[: places[r["start"]][0]] + text[places[r["end"] - 1][1] :]
    return text


def scan(docs: DataFrame, windows: list[tuple[list[str], list[str]]], *, cut_spans: bool = False) -> DataFrame:
    """docs with n_words, runs (start, end of hit words) and items added; with cut_spans the runs leave the text."""
    return scanned(docs, docs.sparkSession.sparkContext.broadcast(WindowSet(windows)), cut_spans=cut_spans)


def scanned(docs: DataFrame, shared: Broadcast, *, cut_spans: bool = False) -> DataFrame:
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for whole in batches:
            for batch in parts(whole, at_text):
                sizes, runs, items, texts = [], [], [], batch.column(at_text).to_pylist()
                for text in texts:
                    words = words_of(text or "")
                    hit, found = shared.value.hits(words)
                    ends = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                    sizes.append(len(words))
                    runs.append([{"start": s, "end": e} for s, e in zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True)])
                    items.append(sorted(found))
                if cut_spans and any(runs):
                    left = pa.array([cut_out(t, r) if r else t for t, r in zip(texts, runs, strict=True)], batch.schema.field(at_text).type)
                    batch = batch.set_column(at_text, batch.schema.field(at_text), left)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pair)), pa.array(items, pa.list_(pa.string()))],
                    names=[*batch.schema.names, "n_words", "runs", "items"],
                )

    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{have}, n_words long, runs array<struct<start:int,end:int>>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window_words: int = WINDOW_WORDS, block_windows: int = BLOCK_WINDOWS, cut_spans: bool = False) -> DataFrame:
    """docs with n_words, runs and items: what the benchmark has of each document; with cut_spans it leaves the texts.

    The columns n_words, runs, items and _contamination_* of docs itself, if there are any, are replaced.
    """
    docs = docs.drop("n_words", "runs", "items")
    byte_batches(docs.sparkSession)
    windows = benchmark_windows(benchmark, window_words).groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("owners"))
    n = windows.count()
    if n <= block_windows:
        return scan(docs, [(r.words, r.owners) for r in windows.toLocalIterator()], cut_spans=cut_spans)
    # blocks by hash, of three quarters of the bound on average: each is matched against all documents and what it hits is stored
    blocks = -(-4 * n // (3 * block_windows))
    numbered = stored(windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks))))
    names = [f"_contamination_{k}" for k in ("id", "text", "runs", "items")]
    one, other, runs, items = names
    named = docs.drop(*names).withColumns({one: F.xxhash64(F.col("doc_id").cast("string")), other: F.xxhash64(text_or_empty())})
    hits = None
    for b in range(blocks):
        shared = named.sparkSession.sparkContext.broadcast(WindowSet([(r.words, r.owners) for r in numbered.where(F.col("block") == b).toLocalIterator()]))
        found = stored(scanned(named.select(one, other, "text"), shared).where(F.size("runs") > 0).select(one, other, F.col("runs").alias(runs), F.col("items").alias(items)))
        shared.destroy()
        hits = found if hits is None else hits.unionByName(found)
    by_doc = hits.groupBy(one, other).agg(merged(F.flatten(F.collect_list(runs))).alias(runs), F.array_distinct(F.flatten(F.collect_list(items))).alias(items))
    counted = scan(named, [])
    out = counted.join(stored(by_doc), [one, other], "left").withColumns({"runs": F.coalesce(runs, "runs"), "items": F.coalesce(items, "items")})
    out = out.select(*[c for c in docs.columns if c not in names], "n_words", "runs", "items")
    return without_spans(out) if cut_spans else out


def merged(runs: Column) -> Column:
    """Runs (start, end) of words as those that do not touch, by start; the work grows with the words that they cover."""
    covered = F.sort_array(F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["end"] - 1)))))

    def edges(c: Column) -> Column:
        starts = F.filter(c, lambda x, i: F.coalesce(F.get(c, i - 1), F.lit(-2)) != x - 1)
        ends = F.filter(c, lambda x, i: F.coalesce(F.get(c, i + 1), F.lit(-2)) != x + 1)
        return F.zip_with(starts, ends, lambda x, y: F.struct(x.alias("start"), (y + 1).alias("end")))

    return once(covered, edges)


def contamination_digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("runs", F.lit(0), lambda n, r: n + r["end"] - r["start"]).cast("long")
    return found.withColumn("n_hit", n_hit).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_spans(found: DataFrame) -> DataFrame:
    """The documents with the hit words, and what stands between words of a run, cut out of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_out(t, r) for t, r in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True)]
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, "text", pa.array(texts, pa.string()))

    return found.mapInArrow(run, found.schema)
