"""Retrieval quality of ranked results (qid, doc_id, rank) against qrels (qid, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    return results.join(qrels.select("qid", "doc_id", "rel"), ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def precision_at_k(results: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Relevant among the first k, over k even if there are fewer results."""
    hit = F.sum(((F.col("rank") <= k) & (F.col("rel") > 0)).cast("int")) / F.lit(float(k))
    return judged(results, qrels).groupBy("qid").agg(hit.alias("precision"))


def average_precision(results: DataFrame, qrels: DataFrame) -> DataFrame:
    rows = judged(results, qrels).withColumn("_hits", F.sum((F.col("rel") > 0).cast("int")).over(Window.partitionBy("qid").orderBy("rank")))
    total = rows.groupBy("qid").agg(F.sum(F.when(F.col("rel") > 0, F.col("_hits") / F.col("rank").cast("double")).otherwise(0.0)).alias("_sum"))
    relevant = qrels.where("rel > 0").groupBy("qid").agg(F.count(F.lit(1)).alias("_n"))
    return total.join(relevant, "qid", "left").select("qid", (F.col("_sum") / F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1))).alias("ap"))


def ndcg_at_k(results: DataFrame, qrels: DataFrame, k: int, *, linear: bool = False) -> DataFrame:
    """Gain 2^rel - 1 (or rel) over log2(rank + 1), over the ideal, or over 1 if that is less."""
    gain = (lambda r: r.cast("double")) if linear else (lambda r: F.pow(F.lit(2.0), r) - 1)
    got = judged(results, qrels).where(F.col("rank") <= k).groupBy("qid").agg(F.sum(gain(F.col("rel")) / F.log2(F.col("rank") + 1)).alias("_dcg"))
    w = Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    best = qrels.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= k).groupBy("qid").agg(F.sum(gain(F.col("rel")) / F.log2(F.col("_at") + 1)).alias("_ideal"))
    return got.join(best, "qid", "left").select("qid", (F.col("_dcg") / F.greatest(F.coalesce("_ideal", F.lit(0.0)), F.lit(1.0))).alias("ndcg"))


def reciprocal_rank(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """1 over the rank of the first relevant result, and 1 over log2 of that rank + 1; 0 if there is none."""
    first = judged(results, qrels).groupBy("qid").agg(F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("_at"))
    return first.select("qid", F.coalesce(1.0 / F.col("_at"), F.lit(0.0)).alias("rr"), F.coalesce(1.0 / F.log2(F.col("_at") + 1), F.lit(0.0)).alias("single_ndcg"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*(F.avg(c).alias(f"mean_{c}") for c in per_query.columns if c != "qid"))


def judgement_ratios(judgements: DataFrame) -> DataFrame:
    """Share of passed items of each sample and kind of judgement, to four places; none is 0."""
    return judgements.groupBy("sample_id", "kind").agg(F.coalesce(F.round(F.avg(F.col("passed").cast("double")), 4), F.lit(0.0)).alias("ratio"))
