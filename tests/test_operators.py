"""Operators on small frames with hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring, text
from lodestone.operators import agent, catalog, context, graph, memory, metrics, vectors
from lodestone.operators import index as ix
from lodestone.operators import retrieval as rt
from lodestone.plans import search as plans
from lodestone.sources import readers, writers


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "Red fish\nred fish blue fish"), (2, "Blue whale\nthe whale is blue"), (3, None), (4, "")], "doc_id long, text string")


def test_clean_and_tokenize(spark):
    df = spark.createDataFrame([("{{box\n1}}A [[b|c d]] <ref x>y</ref>==H== it's http://x.y z",), (None,), ("",)], "t string")
    assert values(df, text.clean_text("t")) == ["A c d it s z", "", ""]
    assert values(df, text.parse_query("t")) == [["c", "d", "s", "z"], [], []]


def test_normalize(spark):
    df = spark.createDataFrame([(" a\t b  c \n\n\n\nd \n",)], "t string")
    assert values(df, text.normalize_text("t")) == ["a b c\n\nd"]


def test_chunks_carry_overlap(spark):
    paragraphs = [c * 40 for c in "abcdef"]  # ten tokens each
    df = spark.createDataFrame([("\n\n".join(paragraphs),), ("",), (None,), ("x" * 400,)], "t string")
    got = values(df, text.chunk_text("t", 30, 10))
    assert got[0] == ["\n\n".join(paragraphs[:3]), "\n\n".join(paragraphs[2:5]), "\n\n".join(paragraphs[4:])]
    assert got[1] == [] and got[2] == [] and got[3] == ["x" * 400]


def test_snippet_takes_the_first_query_word(spark):
    df = spark.createDataFrame([("x" * 300 + " needle " + "y" * 300,), ("none",)], "t string")
    a, b = values(df, text.snippet("t", "missing needle"))
    assert a.startswith("...") and a.endswith("...") and "needle" in a and b == "none..."


def test_json_repair(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("oops",)], "t string")
    assert values(df, text.repair_json("t", "a int")["a"]) == [1, None]


def test_bm25_by_hand(spark, docs):
    t = ix.with_tokens(docs)
    posted, lengths = ix.postings(t), ix.doc_lengths(t)
    stats = ix.corpus_stats(lengths)
    assert stats.first().asDict() == {"total_docs": 2, "avg_doc_length": 5.0}
    q = spark.createDataFrame([(0, "fish fish")], "qid long, query string")
    got = rt.bm25_body(rt.query_terms(q), posted, lengths, stats).collect()
    want = 2 * math.log((2 - 1 + 0.5) / 1.5 + 1) * 3 * 2.5 / (3 + 1.5 * (0.25 + 0.75 * 6 / 5))
    assert [r.doc_id for r in got] == [1] and abs(got[0].score - want) < 1e-12
    nothing = spark.createDataFrame([(0, "the of")], "qid long, query string")
    assert rt.bm25_body(rt.query_terms(nothing), posted, lengths, stats).count() == 0


def test_ties_follow_doc_id_and_k_may_exceed_n(spark):
    s = spark.createDataFrame([(0, 2, 1.0), (0, 1, 1.0), (0, 3, 2.0)], "qid long, doc_id long, score double")
    assert [(r.doc_id, r.rank) for r in rt.ranked(s, 10).orderBy("rank").collect()] == [(3, 1), (1, 2), (2, 3)]


def test_fixed_point_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.5 / 65536,), (1.5 / 65536,), (-2.5 / 65536,)], "x double")
    assert values(df, scoring.fixed_point(F.col("x"))) == [0, 2, -2]


def test_column_filter_edges(spark):
    hits = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (0, 9, 1.0)], "qid long, doc_id long, score double")
    table = spark.createDataFrame([(1, "5"), (2, None)], "doc_id long, v string")
    ids = lambda *a, **k: sorted(values(rt.column_filter(hits, table, *a, **k), "doc_id"))
    assert ids("v", "6", "ne") == [1] and ids("v", 4, "gt") == [1] and ids("", 1) == [1, 2, 9] and ids("v", None) == [1, 2, 9]
    assert ids("v", 1, "like") == []
    words = spark.createDataFrame([(1, "x")], "doc_id long, v string")
    assert values(rt.column_filter(hits, words, "v", 1, "gt", strict=False), "doc_id") == []
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        rt.column_filter(hits, words, "v", 1, "gt").collect()


def test_merge_keeps_the_best_row_first_list_wins(spark):
    a = spark.createDataFrame([(0, 1, 2.0, "a"), (0, 2, 1.0, "a")], "qid long, doc_id long, score double, src string")
    b = spark.createDataFrame([(0, 1, 2.0, "b"), (0, 2, 3.0, "b")], "qid long, doc_id long, score double, src string")
    assert sorted((r.doc_id, r.src) for r in rt.merge_results(a, b).collect()) == [(1, "a"), (2, "b")]


def test_index_upkeep(spark, docs):
    posted = ix.postings(ix.with_tokens(docs))
    fresh = spark.createDataFrame([("new", 1, 1)], "term string, doc_id long, tf long")
    terms = lambda df, d: sorted(r.term for r in df.where(f"doc_id = {d}").collect())
    assert terms(ix.upsert_index(posted, fresh), 1) == ["new"] and terms(ix.upsert_index(posted, fresh), 2) == ["blue", "whale"]
    gone = spark.createDataFrame([(2,), (77,)], "doc_id long")
    assert terms(ix.delete_documents(posted, gone), 2) == []


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [-1.0, 0.0], "b"), (4, None, "b")], "doc_id long, embedding array<float>, f string")
    assert [r.doc_id for r in vectors.knn(v, [1.0, 0.0], 2).orderBy("rank").collect()] == [1, 2]
    geometry = {r.file_path: r for r in vectors.file_geometry(v.where("embedding is not null"), "f").collect()}
    assert geometry["b"].radius < 1e-6 and geometry["a"].doc_count == 2
    q = vectors.quantize_i8(v.where("embedding is not null"))
    back = {r.doc_id: r.embedding for r in vectors.dequantize_i8(q).collect()}
    assert abs(back[1][0] - 1) < 0.01 and abs(back[3][0] + 1) < 0.01
    flat = vectors.quantize_i8(spark.createDataFrame([(1, [2.0, 2.0])], "doc_id long, embedding array<float>"))
    assert flat.first().codes == [0, 0]
    assert [vectors.select_index(n) for n in (1, 20_000, 600_000)] == ["flat", "hnsw", "ivf_pq"]
    assert vectors.select_index(200_000, has_gpu=True) == "gpu_ivf_pq"


def test_graph_scores_count_words_and_edges(spark):
    triples = spark.createDataFrame([(1, "Red Fox", "eats", "Hen"), (2, "Hen", "eats", "Corn"), (2, "Hen", "eats", "Corn")], "doc_id long, source string, relation string, target string")
    nodes, edges = graph.merge_triples(triples)
    terms = spark.createDataFrame([(0, "fox", 2, 0)], "qid long, term string, qtf long, qpos long")
    assert {r.doc_id: r.score for r in graph.graph_score(terms, nodes, edges).collect()} == {1: 2.5}
    hen = spark.createDataFrame([(0, "hen", 1, 0)], "qid long, term string, qtf long, qpos long")
    assert {r.doc_id: r.score for r in graph.graph_score(hen, nodes, edges).collect()} == {1: 1.5, 2: 2.0}


def test_context_budget_cuts_the_first_overflow(spark):
    rows = spark.createDataFrame([(0, 1, "w " * 150), (0, 2, "v " * 400), (0, 3, "u")], "qid long, seq long, formatted string")
    got = context.fit_to_budget(rows, 400).first().context
    assert got.count("v") == 150 and got.endswith("...") and "u" not in got


def test_memory_eviction_and_touch(spark):
    m = spark.createDataFrame([("a", 1, 0.9, 0.0, 0.0, 0), ("a", 2, 0.1, 0.0, 0.0, 0), ("b", 3, 0.1, 0.0, 0.0, 0)], "agent_id string, memory_id long, importance double, created_at double, last_accessed double, access_count long").withColumn("embedding", F.array(F.lit(1.0)))
    assert sorted(values(memory.evict(m, 1, 10.0), "memory_id")) == [1, 3]
    touched = memory.touch(m, memory.recall(m, [1.0], 1, 10.0), 10.0)
    assert {r.memory_id: r.access_count for r in touched.collect()} == {1: 1, 2: 0, 3: 1}


def test_metrics_without_hits_are_zero(spark):
    results = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "qid string, doc_id long, rank long")
    none = spark.createDataFrame([], "qid string, doc_id long, rel long")
    assert metrics.precision_at_k(results, none, 5).first().precision == 0 and metrics.ndcg_at_k(results, none, 5).first().ndcg == 0
    assert metrics.average_precision(results, none).first().ap == 0 and metrics.reciprocal_rank(results, none).first().rr == 0


def test_catalog_and_versions(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "catalog"))
    assert c.should_write("b1") and c.schema() is None
    tx = c.begin("b1", 1.0)
    s = c.create_snapshot(1.0)
    c.commit(tx, "b1", s, [("f1", 3), ("f2", 4)], 2.0)
    assert not c.should_write("b1") and c.should_write("") and c.pending().isEmpty()
    assert sorted(values(catalog.active_files(c.table("files")), "file_path")) == ["f1", "f2"]
    c.begin("b1", 3.0)
    assert c.recover(4.0) == ["b1"] and c.pending().isEmpty()
    c.save_schema(1, {"a": "string"}, 1.0)
    assert c.evolve(2.0, add={"rating": "float"}, rename={"a": "b"}) == {"version": 2, "columns": {"b": "string", "rating": "float"}}
    v = catalog.Versions(spark, str(tmp_path / "versions"))
    v.create(docs=spark.range(3).withColumnRenamed("id", "doc_id"))
    v.create(docs=spark.range(1, 5).withColumnRenamed("id", "doc_id"))
    assert v.current() == 2 and v.restore(1) and v.current() == 1 and not v.restore(9) and v.read("docs").count() == 3
    assert {r.doc_id: r.status for r in v.diff("docs", 1, 2).collect()}[0] == "removed"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,text,url\n"T, 1","x ""y""\nz",\n,,\n,w,u\n')
    assert [(r.doc_id, r.title, r.text, r.url) for r in readers.read_documents(spark, str(tmp_path / "a.csv")).collect()] == [(1, "T, 1", 'x "y"\nz', "doc://1"), (2, "Document 2", "w", "u")]
    (tmp_path / "a.tsv").write_text('7\t"quoted" text\nbad line\n')
    assert values(readers.read_documents(spark, str(tmp_path / "a.tsv")), "text") == ['"quoted" text']
    (tmp_path / "a.xml").write_text("<mediawiki><page><title>T1</title><id>5</id><revision><text>[[a|b]] c</text></revision></page><page><title>T2</title><id>x</id></page></mediawiki>")
    assert [tuple(r) for r in readers.read_documents(spark, str(tmp_path / "a.xml")).collect()] == [(5, "T1", "b c", "https://en.wikipedia.org/wiki/T1")]
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "x.txt").write_text("hello")
    (folder / "y.bin").write_text("no")
    assert values(readers.read_documents(spark, str(folder)), "text") == ["hello"]
    assert readers.html_to_text("<head>h</head><p>a &amp; b</p><script>s</script>c").split() == ["a", "&", "b", "c"]
    assert readers.read_range(spark, str(folder / "x.txt"), -2, 2).first().bytes == b"lo"
    with pytest.raises(ValueError, match="no reader"):
        readers.detect("x.docx")


def test_build_search_and_stream(spark, docs, tmp_path):
    from lodestone.streaming.ingest import ingest

    root = str(tmp_path / "index")
    assert writers.build_index(spark, docs, root, now=1.0, batch_id="b", use_dual=True, use_fts=True, precision="i8", dim=16)
    assert not writers.build_index(spark, docs, root, now=2.0, batch_id="b")
    index = plans.Index.load(spark, root)
    assert index.embeddings is not None and index.dual is not None and index.fts_postings is not None
    vector = [1.0] + [0.0] * 15
    # titles of near candidates widen the query, so the other document may follow
    assert values(plans.search(index, "whale", 5, vector=vector, use_fts=True, use_dual=True).orderBy("rank"), "doc_id")[0] == "2_0"
    assert plans.profile(index, "fish", 3)[0][0].doc_id == "1_0" and "fish" in plans.context(index, "fish").first().context
    assert values(plans.distributed([index, index], "fish", 3).orderBy("rank"), "doc_id")[0] == "1_0"
    with pytest.raises(ValueError, match="empty"):
        plans.search(index, "  ")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("term = 'fish'").agg(F.sum("tf")).first()[0] == 3


def test_agent_defaults(spark, docs):
    assert agent.route("difference between a and b") == "compare" and agent.route("hello") == "chat"
    assert agent.LanguageModel().generate("x").startswith("Error") and agent.LanguageModel(lambda p: "hi").generate("x") == "hi"
    assert agent.generate_answer("q", "c", agent.LanguageModel(lambda p: '```json\n{"answer": "a", "citations": [1]}\n```')) == agent.Answer("a", [1])
    assert agent.extract_relations(docs).count() == 0
    found = agent.extract_relations(docs, lambda t: [{"source": "s", "relation": "r", "target": t[:3]}, {"bad": 1}])
    assert sorted(values(found, "target")) == ["", "", "Blu", "Red"]


def test_plans_prune_and_cut(spark, sf_dir):
    from lodestone.plans.queries import QUERIES

    plan = QUERIES["filter_by"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in plan and "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan
    assert "WindowGroupLimit" in QUERIES["bm25_topk"](spark, sf_dir)._jdf.queryExecution().toString()


def test_functions_in_sql(spark):
    from lodestone.functions.register import register_functions

    register_functions(spark)
    row = spark.sql("SELECT clean_text('a [[b|c]] {{x}}') AS c, tokenize_text('The Cat') AS t, fixed_point(0.5D) AS f, cosine_similarity(array(1D, 0D), array(1D, 0D)) AS s").first()
    assert tuple(row) == ("a c", ["cat"], 32768, 1.0)
