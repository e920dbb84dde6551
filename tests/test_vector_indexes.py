"""The neighbour graph, the stored IVF-PQ index and the vector store: recall, work, plans, upkeep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators.neighbour_graph import NeighbourGraph
from lodestone.operators.vector_store import Model, StoredIvfPq, VectorStore

LARGEST = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def largest(spark):
    from lodestone.plans.queries import VectorIndexes

    own = VectorIndexes(spark, LARGEST)
    rows = own.vectors.toPandas()
    ids, x = rows["doc_id"].to_numpy(), np.array(rows["embedding"].tolist(), float)
    exact = {int(i): set(ids[np.lexsort((ids, -(x @ v)))[:10]].tolist()) for i, v in zip(ids, x, strict=True) if i % 100 == 0}
    return own, exact


def recall(hits, exact):
    found = {}
    for r in hits.collect():
        found.setdefault(r.qid, set()).add(r.doc_id)
    assert set(found) == set(exact)
    return float(np.mean([len(found[q] & exact[q]) / 10 for q in exact]))


def test_graph_finds_nine_of_ten_by_scoring_few(largest):
    own, exact = largest
    graph = own.graph()
    share = recall(graph.search(own.queries, 10), exact)
    scored = graph.scored / len(exact) / own.vectors.count()
    print(f"recall@10 {share:.3f}, rows scored {scored:.3f}")
    assert len(exact) == 20 and share >= 0.9 and scored <= 0.15


def test_ivf_pq_finds_nine_of_ten_in_a_quarter_of_the_cells(largest):
    own, exact = largest
    index = own.ivf_pq()
    hits = index.search(own.queries, 10)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    share = recall(hits, exact)
    assert share >= 0.9
    probed = index.probes(own.queries, int(0.25 * len(index.model.cells))).groupBy("qid").count().agg(F.max("count")).first()[0]
    assert probed <= len(index.model.cells) / 4


def small(spark, n=60, dim=6):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame([*rows, (n, None)], "doc_id long, embedding array<float>"), x


def test_small_graphs(spark, tmp_path):
    docs, x = small(spark)
    graph = NeighbourGraph.build(docs, degree=4, width=8)
    graph.save(str(tmp_path))
    graph = NeighbourGraph.load(spark, str(tmp_path))
    edges = {r.doc_id: r.neighbours for r in graph.edges.collect()}
    assert set(edges) == set(range(60)) and all(1 <= len(v) <= 4 and k not in v for k, v in edges.items())
    queries = docs.where("doc_id < 3").select(F.col("doc_id").alias("qid"), "embedding")
    out = graph.search(queries, 60, ef=60).collect()  # ef as large as the table: all that can be reached
    for q in range(3):
        hits = sorted((r.rank, r.doc_id, r.score) for r in out if r.qid == q)
        assert [h[2] for h in hits] == sorted((h[2] for h in hits), reverse=True) and hits[0][1] == int(np.argmax(x @ x[q]))
    nothing = NeighbourGraph.build(docs.limit(0))
    assert nothing.search(queries, 3).count() == 0
    single = NeighbourGraph.build(docs.limit(1))
    assert single.search(queries, 3).count() == 3  # one node has no links, but is an entry


def test_equal_vectors_make_no_large_lists(spark):
    same = spark.range(200).select(F.col("id").alias("doc_id"), F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>").alias("embedding"))
    graph = NeighbourGraph.build(same, degree=4, width=6, rounds=2)
    assert graph.edges.agg(F.max(F.size("neighbours"))).first()[0] <= 4
    assert graph.search(same.limit(1).withColumnRenamed("doc_id", "qid"), 3).count() == 3


def test_codes_alone(spark, tmp_path):
    docs, x = small(spark)
    whole = StoredIvfPq.build(docs, str(tmp_path / "a"), cells=4, m=3, codes=16)
    bare = StoredIvfPq.build(docs, str(tmp_path / "b"), model=whole.model, pq_only=True)
    bare = StoredIvfPq.load(spark, str(tmp_path / "b"))
    assert "embedding" not in bare.table().columns and bare.table().count() == 120
    queries = docs.where("doc_id in (1, 2)").select(F.col("doc_id").alias("qid"), "embedding")
    exact = {(r.qid, r.rank): r.score for r in whole.search(queries, 5, nprobe=4, widen=100).collect()}
    for q in (1, 2):
        assert [exact[q, n + 1] for n in range(5)] == pytest.approx(np.sort(x @ x[q])[::-1][:5].tolist(), rel=1e-5)
    codes = {r.doc_id: np.array(r.embedding) for r in bare.decoded(bare.table().where("cell = home")).collect()}
    off = np.array([np.linalg.norm(codes[k] - x[k]) for k in range(60)])
    assert len(codes) == 60 and off.mean() < np.linalg.norm(x, axis=1).mean() / 2
    coarse = bare.search(queries, 5, nprobe=4).collect()
    best = {(r.qid, r.doc_id): r.score for r in coarse}
    assert len(best) == 10 and all(s >= codes[d] @ x[q] - 1e-4 for (q, d), s in best.items())  # of two cells the higher counts
    with pytest.raises(ValueError, match="no vectors"):
        StoredIvfPq.build(docs.limit(0), str(tmp_path / "c"))


def test_blocks_of_queries_give_the_same_rows(spark, tmp_path, monkeypatch):
    from lodestone.operators import vector_store as vs

    docs, _ = small(spark)
    index = StoredIvfPq.build(docs, str(tmp_path), cells=4, m=3, codes=16)
    queries = docs.where("embedding is not null").select(F.col("doc_id").alias("qid"), "embedding")
    want = sorted(tuple(r) for r in index.search(queries, 3).collect())
    monkeypatch.setattr(vs, "TABLE_BYTES", 2000)
    monkeypatch.setattr(vs, "SCORES", 8)
    assert sorted(tuple(r) for r in index.search(queries, 3).collect()) == want


def test_store_adds_replaces_and_counts(spark, tmp_path):
    docs, x = small(spark)
    store = VectorStore(spark, str(tmp_path / "s"))
    assert store.total_vectors() == 0 and store.info().first().total_vectors == 0
    store.add(5, [1.0, 2.0])
    store.add_batch(docs)
    store.add(7, [0.5] * 6)
    store = VectorStore.open(spark, str(tmp_path / "s"))
    got = {r.doc_id: r.embedding for r in store.get([5, 7, 60, 99]).collect()}
    assert got == {5: [float(v) for v in x[5]], 7: [0.5] * 6, 60: None, 99: None}
    info = store.info().first()
    assert (info.appended, info.total_vectors, info.dimension, info.precision, info.kind) == (62, 60, 6, "f32", "flat")


def test_store_of_codes_gives_what_they_stand_for(spark, tmp_path):
    docs, x = small(spark)
    with pytest.raises(ValueError, match="model"):
        VectorStore(spark, str(tmp_path / "n"), precision="pq").add(1, [1.0] * 6)
    model = Model.fit(docs, cells=4, m=3, codes=16)
    VectorStore(spark, str(tmp_path / "q"), precision="pq", model=model).add_batch(docs)
    store = VectorStore.open(spark, str(tmp_path / "q"))
    cell, codes = model.coded(x.astype(float), 1)
    want = model.decoded(cell[:, 0], codes[:, 0])
    got = {r.doc_id: r.embedding for r in store.get(docs).where("embedding is not null").collect()}
    assert set(got) == set(range(60)) and all(np.allclose(got[k], want[k], atol=1e-6) for k in got)
    assert store.info().first().dimension == 6 and store.total_vectors() == 60
