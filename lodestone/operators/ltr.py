"""Learning to rank: features of query and document, labels, models and re-ranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import idf

from .retrieval import ranked

# The order of the features; a model's vector is filled up to WIDTH with zeros.
FEATURES = (
    "q_len", "doc_len", "coverage_count", "coverage_ratio", "sum_tf", "min_tf", "max_tf", "mean_tf", "var_tf", "sum_idf", "min_idf", "max_idf", "mean_idf",
    "query_specificity", "sum_tfidf", "min_tfidf", "max_tfidf", "mean_tfidf", "var_tfidf", "norm_bm25", "semantic", "exact_phrase", "window_match", "bigram_match",
    "density", "bool_match", "first_pos", "last_pos", "graph_score",
)
WIDTH = 50
TINY = 1e-6


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(0.0)


def variance(a: Column) -> Column:
    """Of the population."""
    return F.when(F.size(a) > 0, total(F.transform(a, lambda x: (x - mean(a)) * (x - mean(a)))) / F.size(a)).otherwise(0.0)


def extract_features(candidates: DataFrame, docs: DataFrame, queries: DataFrame, term_df: DataFrame, stats: DataFrame) -> DataFrame:
    """qid, doc_id and FEATURES of candidates (qid, doc_id, bm25, semantic, graph_score).

    queries has qid, query and tokens; term_df has term and df. Words of a document are
    those of its lower-case text between white space; a query word that repeats counts
    each time. A document that is missing has an empty text.
    """
    n = stats.select("total_docs").scalar()
    words = queries.select("qid", F.posexplode("tokens").alias("pos", "term")).join(term_df, "term", "left").withColumn("idf", idf(n, F.coalesce("df", F.lit(0))))
    weights = words.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idf"))), lambda s: s["idf"]).alias("idfs"))
    most_of = candidates.groupBy("qid").agg(F.max("bm25").alias("max_bm25"))
    rows = candidates.join(queries, "qid").join(most_of, "qid").join(weights, "qid", "left").join(docs.select("doc_id", F.lower("text").alias("text")), "doc_id", "left")
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("idfs", F.coalesce("idfs", F.array().cast("array<double>")))
    rows = rows.withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rows = rows.withColumn("tfs", F.transform("tokens", lambda t: F.size(F.filter("words", lambda w: w == t)).cast("double")))
    rows = rows.withColumn("tfidfs", F.zip_with("tfs", "idfs", lambda a, b: a * b))
    rows = rows.withColumn("places", F.transform(F.filter("tokens", lambda t: F.array_contains("words", t)), lambda t: F.array_position("words", t) - 1))
    q, d = F.size("tokens").cast("double"), F.size("words").cast("double")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(1))), lambda k: F.concat_ws(" ", F.slice("tokens", k, 2)))
    first_two = F.slice("tokens", 1, 2)
    at = F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1)))
    covered = F.size(F.array_distinct(F.filter("tokens", lambda t: F.array_contains("words", t)))).cast("double")
    some = F.size("places") > 0
    low, high = F.array_min("places"), F.array_max("places")
    least = lambda c: F.coalesce(F.array_min(c), F.lit(0.0))
    most = lambda c: F.coalesce(F.array_max(c), F.lit(0.0))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = {
        "q_len": q,
        "doc_len": d,
        "coverage_count": covered,
        "coverage_ratio": covered / (q + TINY),
        **{f"{f}_tf": g(F.col("tfs")) for f, g in (("sum", total), ("min", least), ("max", most), ("mean", mean), ("var", variance))},
        **{f"{f}_idf": g(F.col("idfs")) for f, g in (("sum", total), ("min", least), ("max", most), ("mean", mean))},
        "query_specificity": total(F.col("idfs")) / (q + TINY),
        **{f"{f}_tfidf": g(F.col("tfidfs")) for f, g in (("sum", total), ("min", least), ("max", most), ("mean", mean), ("var", variance))},
        "norm_bm25": F.when(F.col("max_bm25") > 0, F.col("bm25") / F.col("max_bm25")).otherwise(0.0),
        "semantic": F.coalesce("semantic", F.lit(0.0)),
        "exact_phrase": flag(F.contains("text", F.lower("query"))),
        "window_match": flag((F.size("tokens") >= 2) & F.exists(at, lambda k: F.slice("words", k, 2) == first_two)),
        "bigram_match": F.when(F.size("tokens") >= 2, F.size(F.filter(pairs, lambda p: F.contains("text", p)))).otherwise(0).cast("double"),
        "density": F.when(F.size("places") > 1, 1.0 / (high - low + 1)).otherwise(0.0),
        "bool_match": flag(covered > 0),
        "first_pos": F.when(some, low / (d + TINY)).otherwise(1.0),
        "last_pos": F.when(some, high / (d + TINY)).otherwise(1.0),
        "graph_score": F.coalesce("graph_score", F.lit(0.0)),
    }
    return rows.select("qid", "doc_id", *(values[f].cast("double").alias(f) for f in FEATURES))


def fallback_score() -> Column:
    """Without a model: normed lexical plus semantic score."""
    return F.col("norm_bm25") + F.col("semantic")


def rerank(features: DataFrame, k: int | None = None, model: object = None) -> DataFrame:
    """Candidates by the model's prediction, or by fallback_score."""
    if model is None:
        scores = features.withColumn("score", fallback_score())
    else:
        scores = model.transform(assembled(features)).withColumnRenamed("prediction", "score")
    return ranked(scores.select("qid", "doc_id", "score"), k, by=F.col("score"))


def assembled(features: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return features.withColumn("features", array_to_vector(F.array(*FEATURES, *([F.lit(0.0)] * (WIDTH - len(FEATURES))))))


def training_candidates(lexical: DataFrame, semantic: DataFrame, per_query: int = 20) -> DataFrame:
    """qid, doc_id, pos, label: first lexical, then semantic candidates, each document once.

    The first is labelled 2, the next four 1, the others 0.
    """
    a = lexical.where(F.col("rank") <= per_query).select("qid", "doc_id", F.col("rank").alias("_at"))
    b = semantic.where(F.col("rank") <= per_query).select("qid", "doc_id", (F.col("rank") + per_query).alias("_at"))
    once = a.unionByName(b).groupBy("qid", "doc_id").agg(F.min("_at").alias("_at"))
    pos = F.row_number().over(Window.partitionBy("qid").orderBy("_at")).cast("bigint")
    label = F.when(F.col("pos") == 1, 2).when(F.col("pos") <= 5, 1).otherwise(0).cast("bigint")
    return once.withColumn("pos", pos).select("qid", "doc_id", "pos", label.alias("label"))


def train(features: DataFrame, *, label: str = "label", held_out: float = 0.2, seed: int = 7) -> tuple[object, float]:
    """A boosted regression on graded labels, chosen from a grid by its error on held-out queries.

    Pointwise; lambdamart has the listwise learner. Queries are dealt by a hash of qid.
    """
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor

    rows = assembled(features).withColumn(label, F.col(label).cast("double"))
    held = F.pmod(F.xxhash64("qid"), F.lit(100)) < int(held_out * 100)
    fit, test = rows.where(~held).cache(), rows.where(held).cache()
    if test.isEmpty() or fit.isEmpty():
        fit = test = rows
    found = []
    for depth, rounds in ((3, 10), (5, 10), (3, 20)):
        model = GBTRegressor(featuresCol="features", labelCol=label, maxDepth=depth, maxIter=rounds, seed=seed).fit(fit)
        found.append((RegressionEvaluator(labelCol=label, metricName="rmse").evaluate(model.transform(test)), len(found), model))
    error, _, best = min(found)
    return best, error


def cross_encoder_rerank(hits: DataFrame, docs: DataFrame, queries: DataFrame, scorer: object = None, max_chars: int = 1000) -> DataFrame:
    """Hits by a score of (query, first characters of text); documents without text go.

    scorer is a batch function of two series; the default counts shared words.
    """
    from .agent import shared_words

    model = scorer or shared_words

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return model(q, t)

    rows = hits.join(docs.where(F.coalesce("text", F.lit("")) != "").select("doc_id", F.substring("text", 1, max_chars).alias("_text")), "doc_id").join(queries.select("qid", "query"), "qid")
    return ranked(rows.select("qid", "doc_id", run("query", "_text").alias("score")), by=F.col("score"))
