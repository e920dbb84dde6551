"""Query expansion by titles of semantically near candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import stored


def expand_queries(queries: DataFrame, candidates: DataFrame, semantic: DataFrame, titles: DataFrame, pool: int = 20, take: int = 3) -> DataFrame:
    """(qid, query) with the lower-case titles of the nearest candidates added, repeats included.

    Of the first pool candidates by rank, those with a semantic score count; without any
    the query stays as it is. The few candidates are stored, so that vectors and titles need no shuffle.
    """
    some = stored(candidates.where(F.col("rank") <= pool).select("qid", "doc_id"))
    near = some.join(semantic.select("qid", "doc_id", "score"), ["qid", "doc_id"])
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    nearest = stored(near.withColumn("nth", nth).where(F.col("nth") <= take).select("qid", "doc_id", "nth"))
    best = nearest.join(titles.select("doc_id", "title"), "doc_id")
    words = F.filter(F.split(F.lower("title"), r"\s+"), lambda w: w != "")
    added = best.groupBy("qid").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", words.alias("w")))), lambda s: s["w"])), " ").alias("added"))
    return queries.join(added, "qid", "left").select("qid", F.concat_ws(" ", "query", "added").alias("query"))
