"""Segments: searches after batches, updates and deletes equal a fresh index; merges change nothing; writers and streams."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as rt
from lodestone.operators.segments import SegmentedIndex, ingest_segments
from lodestone.plans import search as plans

WORDS = "red blue fish whale bird green tree sea sky cloud".split()
TEXTS = {k: f"{WORDS[k % 10]} {WORDS[k % 7]}\n" + " ".join(WORDS[(k * j) % 10] for j in range(1, 4 + k % 5)) for k in range(30)}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def found(index, spark):
    queries = spark.createDataFrame([(0, "red fish"), (1, "whale sea sky"), (2, "cloud tree tree")], "qid long, query string")
    return rows(rt.bm25_ranked(plans.lexical(index, queries), 10).select("qid", "doc_id", "score_fp", "rank"))


def same_as_fresh(segmented, spark, texts):
    fresh = plans.Index.of_documents(frame(spark, texts))
    got = segmented.index()
    assert rows(got.documents) == sorted(texts.items())
    assert rows(got.lengths) == rows(fresh.lengths) and rows(got.postings) == rows(fresh.postings.drop("df"))
    assert tuple(got.stats.first()) == pytest.approx(tuple(fresh.stats.first()))
    assert rows(got.terms) == rows(fresh.terms)
    assert found(got, spark) == found(fresh, spark)


@pytest.fixture
def after_changes(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path))
    first = {k: TEXTS[k] for k in range(12)}
    assert index.add(frame(spark, first), batch_id="a") and not index.add(frame(spark, first), batch_id="a")
    update = {k: TEXTS[k + 10] for k in range(6, 16)}
    assert index.add(frame(spark, update))
    assert index.delete(spark.createDataFrame([(1,), (7,), (99,)], "doc_id long"))
    back = {7: "whale again", 20: "", 21: TEXTS[21]}
    assert index.add(frame(spark, back))
    texts = {**first, **update}
    for k in (1, 7):
        del texts[k]
    return index, {**texts, **back}


def test_batches_updates_and_deletes_equal_a_fresh_index(spark, after_changes):
    index, texts = after_changes
    assert [s["seq"] for s in index.state["segments"]] == [1, 2, 3, 4]
    same_as_fresh(index, spark, texts)
    older = SegmentedIndex(spark, index.root, version=1)
    assert rows(older.documents()) == sorted((k, TEXTS[k]) for k in range(12)) and older.stats().first().total_docs == 12


def test_merging_changes_no_result(spark, after_changes):
    index, texts = after_changes
    before = SegmentedIndex(spark, index.root)
    assert index.compact(fanout=2) >= 2 and index.compact(fanout=2) == 0
    index = SegmentedIndex(spark, index.root)
    assert len(index.state["segments"]) < 4
    same_as_fresh(index, spark, texts)
    assert rows(before.documents()) == sorted(texts.items())  # a reader of the state before is not disturbed
    index.add(frame(spark, {2: "new sea", 40: "sky"}))
    same_as_fresh(index, spark, {**texts, 2: "new sea", 40: "sky"})
    index.compact(fanout=2)
    gone = index.vacuum(keep=1, older_than=-10.0, now=4e9)
    assert gone
    same_as_fresh(SegmentedIndex(spark, index.root), spark, {**texts, 2: "new sea", 40: "sky"})


def test_two_writers_at_once(spark, tmp_path):
    root = str(tmp_path)
    threads = [threading.Thread(target=lambda k=k: SegmentedIndex(spark, root).add(frame(spark, {5: f"fish of {k}", 10 + k: "sea"}))) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    index = SegmentedIndex(spark, root)
    assert len(index.state["segments"]) == 2 and index.stats().first().total_docs == 3
    assert sorted(r.doc_id for r in index.documents().collect()) == [5, 10, 11]


def test_a_stream_adds_each_batch_once_and_searches_see_it(spark, tmp_path):
    root, source, check = str(tmp_path / "index"), str(tmp_path / "in"), str(tmp_path / "check")
    frame(spark, {k: TEXTS[k] for k in range(5)}).write.parquet(source)
    for _ in range(2):
        ingest_segments(spark, source, root, check).awaitTermination()
    frame(spark, {3: "other sea", 8: TEXTS[8]}).write.mode("append").parquet(source)
    ingest_segments(spark, source, root, check).awaitTermination()
    texts = {**{k: TEXTS[k] for k in range(5)}, 3: "other sea", 8: TEXTS[8]}
    index = SegmentedIndex(spark, root)
    assert not index.add(frame(spark, {1: "again"}), batch_id=f"{check}#0")
    same_as_fresh(index, spark, texts)


def test_an_empty_index(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path))
    assert index.stats().first().total_docs == 0 and index.documents().isEmpty() and index.compact() == 0
    assert index.add(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    assert index.documents().isEmpty() and index.postings().where(F.col("tf") > 0).isEmpty()


def test_few_tombstones_shuffle_no_postings(spark, after_changes):
    """a join of all postings by document for each merge and each read of a state with tombstones."""
    index, _ = after_changes
    plan = index.postings()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
