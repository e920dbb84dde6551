"""The index build: words counted inside documents, one shuffle for postings, ties of whole searches."""

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import grams
from lodestone.operators import index as ix
from lodestone.operators.memory import boosted_by_memory
from lodestone.plans import search


def rows(df):
    return sorted(map(tuple, df.select("term", "doc_id", "tf").collect()), key=repr)


def test_words_are_counted_inside_unique_documents(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (None, ["a"]), (3, ["c"])], "doc_id long, tokens array<string>")
    assert ix.unique_ids(docs)
    assert rows(ix.postings(docs, unique=True)) == rows(ix.postings(docs))
    assert "Exchange" not in ix.postings(docs, unique=True)._jdf.queryExecution().executedPlan().toString()


def test_index_of_documents_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "red fish"), (1, "red red"), (None, "blue"), (None, "blue"), (2, "")], "doc_id long, text string")
    index = search.Index.of_documents(docs)
    assert rows(index.postings) == [("blue", None, 2), ("fish", 1, 1), ("red", 1, 3)]
    assert {(r.term, r.df) for r in index.terms.collect()} == {("blue", 1), ("fish", 1), ("red", 1)}
    assert {(r.term, r.df) for r in index.title_terms.collect()} == {("blue", 1), ("fish", 1), ("red", 1)}


def test_many_query_words_find_what_few_do(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k} w{k % 3} common\nbody w{k % 5}") for k in range(20)], "doc_id long, text string")
    index = search.Index.of_documents(docs)
    queries = spark.createDataFrame([(1, "w1 common w2"), (2, "body w4 nothing")], "qid long, query string")
    few = sorted((r.qid, r.doc_id, round(r.score, 9), r.title_only, r.qpos) for r in search.lexical(index, queries).collect())
    monkeypatch.setattr(search, "PUSHED", 1)
    assert few == sorted((r.qid, r.doc_id, round(r.score, 9), r.title_only, r.qpos) for r in search.lexical(index, queries).collect())


def test_equal_documents_of_a_search_rank_by_id(spark, monkeypatch):
    """Parts of a score are added in any order, so equal documents may differ in the last bit."""
    docs = spark.createDataFrame([(k, "red fish") for k in range(6)], "doc_id long, text string")
    index = search.Index.of_documents(docs)
    exact = search.lexical

    def noisy(i, q):
        return exact(i, q).withColumn("score", F.col("score") + F.col("doc_id") * 2.0**-50)

    monkeypatch.setattr(search, "lexical", noisy)
    assert [r.doc_id for r in search.search(index, "red fish", 6).orderBy("rank").collect()] == list(range(6))


def test_cleaning_matches_the_patterns_one_after_the_other(spark):
    texts = ["{{x}} a<b>c</b> http://u v", "<ref n>q</ref> [[l|t]] [[u]] == h == ~ é ü x😀y", "plain, words_1", "", None, "a\x0b\x1fb c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    steps = [*text.MARKUP[:-2], (r"[^a-zA-Z0-9\s]", " "), (r"\s+", " ")]
    got = df.select(text.clean_text("t").alias("a"), F.trim(text.replaced(F.col("t"), steps)).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_few_words_are_looked_up_without_an_index_of_grams(spark):
    texts = spark.createDataFrame([(1, "the red fish"), (2, "a fish"), (3, None), (4, "(red")], "doc_id long, text string")
    words = spark.createDataFrame([("red",), ("fish",), ("fish",), ("",), (None,), ("zz",), ("(r",)], "w string")
    few = grams.substring_pairs(texts, "text", words, "w", few=4)
    assert "regexp_extract_all" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, grams.substring_pairs(texts, "text", words, "w", few=3).collect()))
    assert grams.substring_pairs(texts, "text", words.where("w = ''"), "w", few=3).isEmpty()
    hits = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0)], "qid long, doc_id long, score double")
    boosted = boosted_by_memory(hits, texts, spark.createDataFrame([("the red",)], "text string"), 2.0)
    assert "regexp_extract_all" not in boosted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.score) for r in boosted.collect()) == [(1, 2.0), (2, 1.0)]


def test_blocks_of_postings_without_df(spark):
    from lodestone.operators.block_index import block_index
    from lodestone.operators.retrieval import bm25_ranked

    docs = spark.createDataFrame([(k, f"w{k % 4} common\nw{k % 3} body") for k in range(30)], "doc_id long, text string")
    index = search.Index.of_documents(docs)
    assert "df" not in index.postings.columns
    asked = spark.createDataFrame([(1, "w1 common"), (2, "body w0")], "qid long, query string")
    made = block_index(spark, index.postings, index.titles, index.lengths, index.stats, bucket=4).search(asked, 5)
    want = bm25_ranked(search.lexical(index, asked), 5)
    assert sorted((r.qid, r["rank"], r.doc_id) for r in made.collect()) == sorted((r.qid, r["rank"], r.doc_id) for r in want.collect())


def test_runs_are_sorted_postings_without_a_shuffle(spark, monkeypatch, tmp_path):
    """the build dealt all postings by range, and counted them twice for it."""
    monkeypatch.setattr(ix, "RUN", 5)
    rows_ = [(k, [f"w{j % 4}" for j in range(k)] + ["é", "\U0001f600"]) for k in range(6)] + [(None, ["w1", "w1"]), (9, []), (10, None)]
    docs = spark.createDataFrame(rows_, "doc_id long, tokens array<string>").coalesce(1)
    runs = ix.runs_of(docs)
    assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()
    whole = [r.term for r in runs.collect()]
    assert whole == sorted(whole)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert rows(ix.runs_of(docs)) == rows(ix.postings(docs))
        got = [r.term for r in ix.runs_of(docs).collect()]
        assert 1 <= sum(a > b for a, b in zip(got, got[1:], strict=False)) < 5  # some runs, each in order
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    named = docs.where("doc_id > 2").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert rows(ix.runs_of(named)) == rows(ix.postings(named))
    assert ix.runs_of(docs.limit(0)).isEmpty()
    folder = search.Index.store(spark.createDataFrame([(k, f"w{k} common") for k in range(40)], "doc_id long, text string"), str(tmp_path / "index"))
    for file in spark.read.parquet(f"{folder}/postings").inputFiles():
        got = [tuple(r) for r in spark.read.parquet(file).select("term", "doc_id").collect()]
        assert got == sorted(got)


def test_postings_are_sorted_in_runs_without_a_shuffle(spark, monkeypatch):
    """a term's rows were all in one range, so one task sorted those of a common word."""
    posted = spark.createDataFrame([("b", 2, 1), ("a", 3, 2), ("b", 1, 1), ("a", None, 1), ("c", 1, 4)], "term string, doc_id long, tf long").coalesce(1)
    made = ix.in_runs(posted)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString() and made.schema == posted.schema
    assert [tuple(r) for r in made.collect()] == [("a", 3, 2), ("a", None, 1), ("b", 1, 1), ("b", 2, 1), ("c", 1, 4)]
    monkeypatch.setattr(ix, "RUN", 2)
    assert rows(ix.in_runs(posted)) == rows(posted)
