"""Inverted index tables: postings, title postings, lengths, statistics and their upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from lodestone.functions.text import first_line, parse_query, tokenize
from lodestone.sources.shared import byte_batches

#: Words, or postings, that a worker sorts at once, and rows in a batch that it gives back.
RUN, GIVEN = 2_000_000, 1 << 16


def with_tokens(docs: DataFrame, text: str = "text", *, clean: bool = True) -> DataFrame:
    """doc_id and tokens. clean=False indexes raw words, as older indexes do."""
    return docs.select("doc_id", (parse_query(text) if clean else tokenize(text)).alias("tokens"))


def title_tokens(docs: DataFrame, *, clean: bool = True) -> DataFrame:
    return with_tokens(docs.select("doc_id", first_line("text").alias("title")), "title", clean=clean)


def postings(tokens: DataFrame, column: str = "tokens", *, unique: bool = False) -> DataFrame:
    """term, doc_id, tf. If no two rows share a doc_id (unique), words are counted inside their row and nothing is shuffled."""
    if not unique:
        return tokens.select("doc_id", F.explode(column).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    rows = tokens.select("doc_id", F.inline(counted(F.col(column))).alias("term", "tf"))
    return rows.select("term", "doc_id", "tf")


def counted(words: Column) -> Column:
    """The distinct words of an array with their numbers: it is sorted, and each word goes on up to the next one's start."""

    def starts(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.when(F.size(s) > 0, at).otherwise(F.array().cast("array<int>"))

    def runs(c: Column) -> Column:
        s, at = c["s"], c["at"]
        return F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("bigint").alias("tf")))

    of = F.transform(F.array(F.sort_array(words)), lambda s: F.struct(s.alias("s"), starts(s).alias("at")))
    return F.flatten(F.transform(of, runs))


def runs_of(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """postings of rows of which no two share a doc_id, in runs in order of term: words are counted and sorted in Arrow batches, and nothing is shuffled.

    A run holds the words of RUN words' worth of documents, so a worker's memory doesn't grow
    with the corpus, and a scan for few words finds their few pages in each run.
    """

    def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, lists = (pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in ("doc_id", "words"))
        words, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        if words.null_count:
            row, words = row[pc.is_valid(words).to_numpy(zero_copy_only=False)], words.drop_null()
        terms, rank = ranks(words)
        docs, place = ranks(ids)
        keys, tf = np.unique(rank * max(len(docs), 1) + place[row], return_counts=True)
        return pa.RecordBatch.from_arrays([terms.take(pa.array(keys // max(len(docs), 1))), docs.take(pa.array(keys % max(len(docs), 1))), pa.array(tf.astype(np.int64))], ["term", "doc_id", "tf"])

    byte_batches(tokens.sparkSession)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", F.col(column).alias("words")).mapInArrow(in_turns(run, lambda b: pc.sum(pc.list_value_length(b.column("words"))).as_py() or 0), f"term string, doc_id {kind}, tf long")


def in_runs(posted: DataFrame) -> DataFrame:
    """Postings in runs in order of term and document, sorted in Arrow batches without a shuffle; no task sorts more than RUN at once."""

    def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        order = np.lexsort([ranks(rows.column(c).combine_chunks())[1] for c in ("doc_id", "term")])
        return rows.take(pa.array(order)).combine_chunks().to_batches()[0]

    byte_batches(posted.sparkSession)
    return posted.mapInArrow(in_turns(run, lambda b: b.num_rows), posted.schema)


def ranks(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in order, nulls last, and the place of each value among them."""
    coded = values.dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def in_turns(run: Callable[[list[pa.RecordBatch]], pa.RecordBatch], size: Callable[[pa.RecordBatch], int]) -> Callable:
    """A function for mapInArrow: batches are held until they have RUN of something, then run together."""
    most, given = RUN, GIVEN

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += size(b)
            if n >= most:
                yield from pieces(run(held))
                held, n = [], 0
        if held:
            yield from pieces(run(held))

    def pieces(made: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, made.num_rows, given):
            yield made.slice(at, given)

    return turns


def unique_ids(rows: DataFrame) -> bool:
    """Whether no two rows share a doc_id, nulls included."""
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def doc_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.size("tokens").cast("bigint").alias("dl")).where("dl > 0")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: documents with tokens, and their mean length (0 for none)."""
    return lengths.agg(F.count(F.lit(1)).alias("total_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_doc_length"))


def doc_freq(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def get_postings(posted: DataFrame, *terms: str) -> DataFrame:
    return posted.where(F.col("term").isin(*terms))


def merge_sum(*parts: DataFrame) -> DataFrame:
    """One index of several; the frequencies of a term and document are added."""
    return _paired(parts).agg(F.sum("tf").cast("bigint").alias("tf"))


def merge_max(*parts: DataFrame) -> DataFrame:
    """One full-text index of several; the larger frequency holds."""
    return _paired(parts).agg(F.max("tf").cast("bigint").alias("tf"))


def merge_lengths(own: DataFrame, other: DataFrame) -> DataFrame:
    """Document lengths of two indexes; those of the other hold."""
    both = own.withColumn("_turn", F.lit(0)).unionByName(other.withColumn("_turn", F.lit(1)))
    return both.groupBy("doc_id").agg(F.max_by("dl", "_turn").alias("dl"))


def _paired(parts: tuple[DataFrame, ...]) -> GroupedData:
    """Rows of all parts by term and document. Few repeat in a task, so they are dealt before they are combined, and no map of them fills up."""
    return _union(parts).repartition("term", "doc_id").groupBy("term", "doc_id")


def _union(parts: tuple[DataFrame, ...]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def delete_documents(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings, lengths or documents without those of these ids; unknown ids change nothing."""
    return table.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def upsert_index(posted: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings in which the documents of fresh are replaced as a whole."""
    return delete_documents(posted, fresh.select("doc_id")).unionByName(fresh)


def upsert_documents(docs: DataFrame, fresh: DataFrame) -> DataFrame:
    """Documents with fresh ones added; for a doc_id in both, the fresh one holds; columns are united."""
    old = docs.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def batch_get(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows for the wanted (pos, doc_id) in their order; nulls where there is no such document."""
    return wanted.join(docs, "doc_id", "left").orderBy("pos")


def index_counts(posted: DataFrame, lengths: DataFrame) -> DataFrame:
    terms = posted.select("term").distinct().agg(F.count(F.lit(1)).alias("term_count"))
    docs = lengths.agg(F.count(F.lit(1)).alias("doc_count"))
    return terms.withColumn("_k", F.lit(1)).join(docs.withColumn("_k", F.lit(1)), "_k").drop("_k")
