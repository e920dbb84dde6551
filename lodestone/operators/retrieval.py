"""Lexical retrieval over index tables, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import B, K1, TITLE_BOOST, bm25_weight, fixed_point, idf, tfidf_weight, title_weight
from lodestone.functions.text import parse_query
from lodestone.sources.shared import stored


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, qtf (a repeated word counts again), qpos (its first place) of (qid, query)."""
    words = queries.select("qid", F.posexplode(parse_query("query")).alias("qpos", "term"))
    return words.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"), F.min("qpos").cast("bigint").alias("qpos"))


def matched(terms: DataFrame, posted: DataFrame) -> DataFrame:
    """Postings of the query terms with df; df counts all documents, whoever asks. Terms or stored postings may have it with them."""
    if "df" in posted.columns or "df" in terms.columns:
        return terms.join(posted, "term")
    hit = posted.join(terms.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.join(df, "term").join(hit, "term")


def with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """rows with the one row of stats as columns; it enters the plan as scalar subqueries."""
    return rows.withColumns({c: stats.select(c).scalar() for c in stats.columns})


def scored(rows: DataFrame, part: Column) -> DataFrame:
    return rows.groupBy("qid", "doc_id").agg(F.sum(F.col("qtf") * part).alias("score"), F.min("qpos").alias("qpos"))


def bm25_body(terms: DataFrame, posted: DataFrame, lengths: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    rows = with_stats(matched(terms, posted).join(lengths, "doc_id", "left"), stats)
    part = idf(F.col("total_docs"), F.col("df")) * bm25_weight(F.col("tf"), F.coalesce("dl", F.lit(0)), F.col("avg_doc_length"), k1, b)
    return scored(rows, part)


def bm25_title(terms: DataFrame, titles: DataFrame, stats: DataFrame, k1: float = K1) -> DataFrame:
    """Title scores: no length norm, df of the titles, number of documents of the body."""
    rows = with_stats(matched(terms, titles), stats)
    return scored(rows, idf(F.col("total_docs"), F.col("df")) * title_weight(F.col("tf"), k1))


def bm25(terms: DataFrame, posted: DataFrame, titles: DataFrame, lengths: DataFrame, stats: DataFrame, boost: float = TITLE_BOOST, *, title_terms: DataFrame | None = None) -> DataFrame:
    """Body plus boosted title scores; weighted parts are united and added, without a full outer join. title_terms are the terms with the df of titles, if terms have one."""
    body = bm25_body(terms, posted, lengths, stats).withColumn("title_only", F.lit(0))
    title = bm25_title(title_terms if title_terms is not None else terms, titles, stats).withColumn("score", F.col("score") * boost).withColumn("title_only", F.lit(1))
    return body.unionByName(title).groupBy("qid", "doc_id").agg(F.sum("score").alias("score"), F.min("title_only").alias("title_only"), F.min("qpos").alias("qpos"))


def tfidf(terms: DataFrame, posted: DataFrame, stats: DataFrame) -> DataFrame:
    rows = with_stats(matched(terms, posted), stats)
    return scored(rows, tfidf_weight(F.col("tf"), F.col("total_docs"), F.col("df")))


def fts(terms: DataFrame, posted: DataFrame, lengths: DataFrame, stats: DataFrame) -> DataFrame:
    """Full-text scores: as the body's, with a mean length of 1 at least."""
    return bm25_body(terms, posted, lengths, stats.withColumn("avg_doc_length", F.greatest("avg_doc_length", F.lit(1.0))))


def fts_boosted(lexical: DataFrame, full_text: DataFrame, weight: float = 0.5) -> DataFrame:
    """Lexical scores plus weighted full-text ones; a document of one list only has that part."""
    return fuse_sum((lexical, 1.0), (full_text, weight))


def fuse_sum(*weighted: tuple[DataFrame, float]) -> DataFrame:
    parts = [d.select("qid", "doc_id", (F.col("score") * w).alias("score")) for d, w in weighted]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("qid", "doc_id").agg(F.sum("score").alias("score"))


def ranked(scores: DataFrame, k: int | None = None, *ties: Column | str, by: Column | None = None) -> DataFrame:
    """scores with score_fp and rank (from 1), of each query the first k.

    Order: fixed-point score, then ties, then doc_id; the window is cut to k before the
    shuffle's rows are all sorted. Without k all rows get their rank, by ranges.
    """
    out = scores.withColumn("score_fp", fixed_point(F.col("score")))
    if k is None:
        return placed(out, F.desc(by if by is not None else F.col("score_fp")), *ties, "doc_id").withColumnRenamed("place", "rank")
    w = Window.partitionBy("qid").orderBy(F.desc(by if by is not None else F.col("score_fp")), *ties, "doc_id")
    out = out.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return out.where(F.col("rank") <= k)


def placed(rows: DataFrame, *order: Column | str, total: str | None = None) -> DataFrame:
    """rows with their place (from 1) of each qid, and the running sum of a column as total if one is named. No task holds all rows: they are dealt by range, and the sizes of the ranges before are added."""
    dealt = stored(rows.repartitionByRange("qid", *order).withColumn("_range", F.spark_partition_id()))
    amount = F.coalesce(F.col(total), F.lit(0)) if total else F.lit(0)
    sizes = dealt.groupBy("qid", "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_sum"))
    upto = Window.partitionBy("qid").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("qid").alias("_qid"), F.col("_range").alias("_of"), *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(n) for c, n in (("_n", "_before"), ("_sum", "_base"))))
    inside = Window.partitionBy("qid", "_range").orderBy(*order)
    joined = dealt.join(before, F.col("qid").eqNullSafe(F.col("_qid")) & (F.col("_range") == F.col("_of")))
    out = joined.withColumn("place", (F.col("_before") + F.row_number().over(inside)).cast("bigint"))
    if total:
        out = out.withColumn("total", F.col("_base") + F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_qid", "_of", "_range", "_before", "_base")


def bm25_ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Ties in the order in which documents turn up: by first query word, titles alone last."""
    return ranked(scores, k, "title_only", "qpos")


COMPARE = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}


def column_filter(hits: DataFrame, docs: DataFrame, column: str | None, value: object, op: str = "eq", *, strict: bool = True) -> DataFrame:
    """Hits whose document passes the test on one column.

    eq and ne compare as text, gt, gte, lt, lte as numbers, contains looks for a part
    without regard to case. Documents that are missing or have null there fail every test;
    no column or no value leaves hits as they are; an unknown op passes nothing. A text
    that is no number raises in a comparison of numbers, or fails it if not strict.
    """
    if not column or value is None:
        return hits
    c = F.col("_value")
    if op in ("eq", "ne"):
        same = c.cast("string") == F.lit(str(value))
        test = same if op == "eq" else ~same
    elif op == "contains":
        test = F.contains(F.lower(c.cast("string")), F.lit(str(value).lower()))
    elif op in COMPARE:
        test = COMPARE[op](c.cast("double") if strict else c.try_cast("double"), F.lit(float(value)))
    else:
        test = F.lit(False)
    passing = docs.select("doc_id", F.col(column).alias("_value")).where(F.col("_value").isNotNull() & test).select("doc_id")
    return hits.join(passing, "doc_id", "left_semi")


def merge_results(*lists: DataFrame) -> DataFrame:
    """Of each document in several result lists the row with the highest score; of equal ones the first list's."""
    out = None
    for k, d in enumerate(lists):
        part = d.withColumn("_list", F.lit(-k))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in out.columns if c not in ("qid", "doc_id", "_list")]
    best = out.groupBy("qid", "doc_id").agg(F.max_by(F.struct(*rest), F.struct("score", "_list")).alias("r"))
    return best.select("qid", "doc_id", "r.*")


def scatter_gather(shards: list[DataFrame], k: int) -> DataFrame:
    """Results of all shards as one list of k; every shard is a part of the plan."""
    return ranked(merge_results(*shards), k)


def attach_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with their documents; hits without one are dropped, the order stays in rank."""
    return hits.join(docs, "doc_id")
