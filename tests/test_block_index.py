"""Blocks: the rows of the full search, and how few blocks are read for them."""

import random

import pytest

from lodestone.operators import retrieval as rt
from lodestone.operators.block_index import BlockIndex
from lodestone.plans import search as plans


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(3)
    rare = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(3_000):
        n = int(5 * 1.003**k)  # lengths from 5 words to some thousands, shortened below
        words = ["common"] * rng.randrange(1, 3) + [rng.choice(rare) for _ in range(min(n, 300))]
        rng.shuffle(words)
        rows.append((k, (f"title {rng.choice(rare)}\n" if k % 7 == 0 else "") + " ".join(words)))
    rows += [(3_000 + k, "common twin") for k in range(40)]  # ties
    return plans.Index.of_documents(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.fixture(scope="module")
def blocks(spark, index, tmp_path_factory):
    return BlockIndex.build(index.postings, index.titles, index.lengths, index.stats, str(tmp_path_factory.mktemp("blocks")), bucket=32)


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "doc_id", "score_fp", "rank").collect())


@pytest.mark.parametrize("k", [1, 10, 100])
def test_rows_are_those_of_the_full_search(k, spark, index, blocks):
    queries = spark.createDataFrame([(0, "common"), (1, "common twin"), (2, "w1 w2 common w1"), (3, "title w5"), (4, "nowhere"), (5, "")], "qid long, query string")
    assert rows(blocks.search(queries, k)) == rows(rt.bm25_ranked(plans.lexical(index, queries), k))


def test_a_common_word_reads_few_blocks(spark, blocks):
    for query, share in (("common", 0.4), ("common w7", 0.5)):
        assert blocks.search(spark.createDataFrame([(0, query)], "qid long, query string"), 10).count() == 10
        print(f"{query}: {blocks.read} of {blocks.all} blocks")
        assert blocks.all > 80 and blocks.read < share * blocks.all


def test_blocks_of_tokens_are_made_without_a_shuffle(spark, index, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from lodestone.functions.text import parse_query
    from lodestone.operators import block_index
    from lodestone.operators import index as ix

    plans_made = []
    plain = block_index.stored

    def kept(df, folder=None):
        plans_made.append((folder or "", df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, folder)

    monkeypatch.setattr(block_index, "stored", kept)
    monkeypatch.setattr(ix, "RUN", 20_000)  # several runs a task
    tokens = plain(index.documents.select("doc_id", parse_query("text").alias("tokens"), parse_query("title").alias("title_tokens")), str(tmp_path / "tokens"))
    made = BlockIndex.of_tokens(tokens, index.stats, str(tmp_path / "index"), bucket=32)
    of_blocks = next(p[2] for p in plans_made if p[0].endswith("/blocks"))
    assert "MapInArrow" in of_blocks and "Exchange" not in of_blocks
    assert made.blocks.where(F.size("docs") > 32).isEmpty() and made.blocks.count() == made.blocks.select("term", "bucket").distinct().count()
    queries = spark.createDataFrame([(0, "common"), (1, "common twin"), (2, "w1 w2 common w1"), (3, "title w5"), (4, "nowhere"), (5, "")], "qid long, query string")
    for k in (1, 10):
        plans_made.clear()
        assert rows(made.search(queries, k)) == rows(rt.bm25_ranked(plans.lexical(index, queries), k))
    # postings meet small tables only: none is dealt by term and bucket
    assert not any("hashpartitioning(term" in p[2] and "docs" in p[2].split("hashpartitioning(term")[1] for p in plans_made)


def test_a_row_without_an_id_is_found(spark, tmp_path):
    index = plans.Index.of_documents(spark.createDataFrame([(None, "red fish"), (1, "red red stone"), (2, "grey stone")], "doc_id long, text string"))
    tokens = spark.createDataFrame([(None, ["red", "fish"], ["red", "fish"]), (1, ["red", "red", "stone"], ["red", "red", "stone"]), (2, ["grey", "stone"], ["grey", "stone"])], "doc_id long, tokens array<string>, title_tokens array<string>")
    made = BlockIndex.of_tokens(tokens, index.stats, str(tmp_path / "index"))
    assert sorted(r.doc_id or 0 for r in made.search(spark.createDataFrame([(0, "red")], "qid long, query string"), 10).collect()) == [0, 1]
