"""Top-k search that leaves out what cannot reach the k-th score: postings in blocks with their greatest weights.

Documents are put in buckets of neighbours in order of length, as long documents have low
weights for any word and short ones high ones. A block holds the postings of one term in
one bucket: documents, frequencies in text and title, lengths. A document's BM25 part for a
term is idf times weight, of the text and of the title; the block's greatest weights and the
idf at search bound it. The sum of these bounds over a query's terms in a bucket bounds every
score there. A search scores the buckets of the highest bounds first; then, with the k-th
score it has so far, only those others whose bound reaches it. Rows are those of the full
search, ties included.

Blocks of documents are made in runs, each of which deals its own documents to buckets, so no
posting is shuffled. In a search postings are joined with small tables only: the words of the
queries, and one bit for each query and bucket.

Weights hold the statistics of the corpus at the time of building: the index is made anew with
the tables it comes from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import B, FRACTION_BITS, K1, TITLE_BOOST, bm25_weight, fixed_point, idf, title_weight
from lodestone.operators.index import in_turns, ranks
from lodestone.operators.retrieval import bm25_ranked, placed, query_terms, with_stats
from lodestone.sources.shared import byte_batches, fresh_folder, stored

BUCKET, FIRST = 128, 4
#: Buckets that a task may number.
TASK_BUCKETS = 1 << 32
#: Words that a scan is filtered by; those of more queries are joined only.
PUSHED = 256


def body_weight(tf: Column, dl: Column, mean: Column) -> Column:
    return F.when(tf > 0, bm25_weight(tf, dl, mean)).otherwise(0.0)


class BlockIndex:
    """blocks (term, bucket, top, title_top: the greatest weights, df, title_df: documents, docs: doc_id, tf, title_tf, dl) and heads, the same without docs; one row of stats."""

    def __init__(self, blocks: DataFrame, heads: DataFrame, stats: DataFrame):
        self.blocks, self.heads, self.stats = blocks, heads, stats
        self.read = self.all = 0

    @classmethod
    def build(cls, postings: DataFrame, titles: DataFrame, lengths: DataFrame, stats: DataFrame, root: str, *, bucket: int = BUCKET, boost: float = TITLE_BOOST) -> BlockIndex:
        """Writes an index of postings and title postings (term, doc_id, tf) to root; they are dealt by document for their bucket, then by bucket."""
        rows = postings.select("term", "doc_id", "tf", F.lit(0).alias("title_tf")).unionByName(titles.select("term", "doc_id", F.lit(0).alias("tf"), F.col("tf").alias("title_tf")))
        ids = rows.select("doc_id").distinct().join(lengths, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"), F.lit(0).alias("qid"))
        buckets = placed(ids, "dl", "doc_id").select("doc_id", "dl", F.floor((F.col("place") - 1) / bucket).alias("bucket"))
        counts = [F.sum(c).cast("int").alias(c) for c in ("tf", "title_tf")]
        known = rows.join(buckets, "doc_id").repartition("bucket").groupBy("bucket", "term", "doc_id").agg(*counts, F.max("dl").cast("int").alias("dl"))
        weighed = with_stats(known, stats).withColumns({"top": body_weight(F.col("tf"), F.col("dl"), F.col("avg_doc_length")), "title_top": title_weight(F.col("title_tf"))})
        # a block has `bucket` documents at most
        made = weighed.groupBy("bucket", "term").agg(
            F.max("top").alias("top"), F.max("title_top").alias("title_top"), F.count_if(F.col("tf") > 0).alias("df"), F.count_if(F.col("title_tf") > 0).alias("title_df"),
            F.array_sort(F.collect_list(F.struct("doc_id", "tf", "title_tf", "dl"))).alias("docs"),
        )
        return cls._written(made.select("term", "bucket", "top", "title_top", "df", "title_df", "docs").sortWithinPartitions("term", "bucket"), stats, root, boost)

    @classmethod
    def of_tokens(cls, tokens: DataFrame, stats: DataFrame, root: str, *, bucket: int = BUCKET, boost: float = TITLE_BOOST) -> BlockIndex:
        """Writes an index of documents (doc_id, tokens, title_tokens), of which no two share a doc_id, to root: nothing is shuffled.

        A run, of a bounded number of words, deals its documents to buckets by length and makes their blocks, in order of term.
        """
        kind = tokens.schema["doc_id"].dataType.simpleString()
        made = 0  # buckets so far

        def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal made
            ids, texts, heads = (pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in ("doc_id", "tokens", "title_tokens"))
            words = [pc.list_flatten(w).cast(pa.string()) for w in (texts, heads)]
            dl = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            order, n = np.argsort(dl, kind="stable"), len(dl)
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            terms, rank = ranks(pa.chunked_array(words).combine_chunks())
            row = np.concatenate([pc.list_parent_indices(w).to_numpy() for w in (texts, heads)])
            keys, of = np.unique(rank * n + place[row], return_inverse=True)
            tf, title_tf = (np.bincount(o, minlength=len(keys)) for o in np.split(of, [len(words[0])]))
            term, at = np.divmod(keys, max(n, 1))
            doc, number = order[at], at // bucket
            first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (number[1:] != number[:-1])))[: len(keys)])
            mean = held[0].column("avg_doc_length")[0].as_py()
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = np.where(tf > 0, tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / np.float64(mean))), 0.0)
            tops = [np.maximum.reduceat(w, first) if len(first) else np.empty(0) for w in (weight, title_tf * (K1 + 1) / (title_tf + K1))]
            dfs = [np.add.reduceat(c > 0, first, dtype=np.int64) if len(first) else np.empty(0, np.int64) for c in (tf, title_tf)]
            fields = [ids.take(pa.array(doc)), *(pa.array(c.astype(np.int32)) for c in (tf, title_tf, dl[doc]))]
            docs = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)).astype(np.int32)), pa.StructArray.from_arrays(fields, ["doc_id", "tf", "title_tf", "dl"]))
            columns = [terms.take(pa.array(term[first])), *(pa.array(c) for c in (TaskContext.get().partitionId() * TASK_BUCKETS + made + number[first], *tops, *dfs)), docs]
            made += -(-n // bucket)
            return pa.RecordBatch.from_arrays(columns, ["term", "bucket", "top", "title_top", "df", "title_df", "docs"])

        size = lambda b: sum(pc.sum(pc.list_value_length(b.column(c))).as_py() or 0 for c in ("tokens", "title_tokens"))
        byte_batches(tokens.sparkSession)
        rows = with_stats(tokens.select("doc_id", "tokens", "title_tokens"), stats.select("avg_doc_length"))
        schema = f"term string, bucket long, top double, title_top double, df long, title_df long, docs array<struct<doc_id:{kind},tf:int,title_tf:int,dl:int>>"
        return cls._written(rows.mapInArrow(in_turns(run, size), schema), stats, root, boost)

    @classmethod
    def _written(cls, blocks: DataFrame, stats: DataFrame, root: str, boost: float) -> BlockIndex:
        stored(stats.select("total_docs", "avg_doc_length", F.lit(float(boost)).alias("boost")), f"{root}/block_stats")
        stored(blocks, f"{root}/blocks")
        return cls.load(blocks.sparkSession, root)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> BlockIndex:
        blocks = spark.read.parquet(f"{root}/blocks")
        return cls(blocks, blocks.drop("docs"), spark.read.parquet(f"{root}/block_stats"))  # a scan of heads reads no documents

    def _scores(self, known: DataFrame, blocks: DataFrame, chosen: DataFrame) -> DataFrame:
        """Scores of the documents in the chosen buckets (qid, bucket), of which each query has one bit."""
        word, bit = F.floor(F.col("bucket") / 64).alias("word"), F.expr("cast(pmod(bucket, 64) as int)")
        bits = stored(chosen.select("qid", word, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bit")).groupBy("qid", "word").agg(F.bit_or("bit").alias("bits")))
        found = known.join(blocks.select("term", "bucket", word, "docs"), "term").join(bits, ["qid", "word"]).where(F.getbit("bits", bit) == 1)
        hits = with_stats(found.select("qid", "qtf", "qpos", "idf", "title_idf", F.explode("docs").alias("d")).select("*", "d.*"), self.stats)
        part = F.col("idf") * body_weight(F.col("tf"), F.col("dl"), F.col("avg_doc_length")) + F.col("boost") * (F.col("title_idf") * title_weight(F.col("title_tf")))
        return hits.groupBy("qid", "doc_id").agg(
            F.sum(F.col("qtf") * part).alias("score"), F.min(F.when(F.col("tf") > 0, 0).otherwise(1)).alias("title_only"), F.min("qpos").alias("qpos")
        )

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, doc_id, score, score_fp and rank of the k best documents of each query (qid, query).

        self.read and self.all tell how many blocks of the queries' terms were read, and there are.
        """
        terms = stored(query_terms(queries))
        words = [r.term for r in terms.select("term").distinct().limit(PUSHED + 1).collect()]
        heads, blocks = (t.where(F.col("term").isin(words)) if len(words) <= PUSHED else t for t in (self.heads, self.blocks))
        df = heads.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"), F.sum("title_df").alias("title_df"))
        idfs = [idf(F.col("total_docs"), F.col(c)).alias(name) for c, name in (("df", "idf"), ("title_df", "title_idf"))]
        known = stored(with_stats(terms.join(df, "term"), self.stats).select("qid", "term", "qtf", "qpos", *idfs, "boost"))
        most = F.col("qtf") * (F.col("idf") * F.col("top") + F.col("boost") * F.col("title_idf") * F.col("title_top"))
        bound: Column = F.floor(F.sum(most) * float(1 << FRACTION_BITS)) + 2
        by_bucket = known.join(heads.select("term", "bucket", "top", "title_top"), "term").groupBy("qid", "bucket").agg(bound.alias("bound"), F.count(F.lit(1)).alias("n"))
        best = Window.partitionBy("qid").orderBy(F.desc("bound"), "bucket")
        bounds = stored(by_bucket)
        top = stored(bounds.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= FIRST).drop("_nth"))
        known = known.drop("boost")
        first = stored(self._scores(known, blocks, top))
        nth = Window.partitionBy("qid").orderBy(F.desc("fp"))
        kth = first.select("qid", fixed_point(F.col("score")).alias("fp")).withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") == k).select("qid", "fp")
        others = bounds.join(top.select("qid", "bucket"), ["qid", "bucket"], "left_anti")
        rest = stored(others.join(kth, "qid", "left").where(F.col("fp").isNull() | (F.col("bound") >= F.col("fp"))).select("qid", "bucket", "n"))
        total = lambda t: t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.all, self.read = total(bounds), total(top) + total(rest)
        scores = first.unionByName(self._scores(known, blocks, rest))
        return bm25_ranked(scores, k)


def block_index(spark: SparkSession, postings: DataFrame, titles: DataFrame, lengths: DataFrame, stats: DataFrame, **more: int) -> BlockIndex:
    """A block index in the application's own folder."""
    return BlockIndex.build(postings, titles, lengths, stats, fresh_folder(spark, "blocks"), **more)
