"""The build of the neighbour graph: bytes shuffled, blocks, and rounds against a plain loop."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import neighbour_graph as ng
from lodestone.operators.neighbour_graph import NeighbourGraph


def random_vectors(spark, n, dim):
    x = np.random.default_rng(3).normal(size=(n, dim)).astype(np.float32)
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "doc_id long, embedding array<float>").repartition(4)


def shuffled(spark):
    jvm = spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def units_of(spark, n, dim):
    vectors = random_vectors(spark, n, dim).select("doc_id", ng._unit("embedding").alias("v"))
    return vectors.mapInArrow(ng._coded, "doc_id long, v array<float>, code binary, step float").cache()


def pairs(df):
    return sorted((r.doc_id, r.other, round(r.score, 6), r.fresh) for r in df.collect())


def test_a_round_does_not_shuffle_a_vector_for_each_link(spark, monkeypatch):
    monkeypatch.setattr(ng, "PART", 16, raising=False)  # poor links at first, so that rounds have work
    n, dim = 400, 512
    docs = random_vectors(spark, n, dim)
    before = shuffled(spark)
    NeighbourGraph.build(docs, rounds=1)
    one = shuffled(spark) - before
    NeighbourGraph.build(docs, rounds=4)
    print(f"{one} bytes with one round, {shuffled(spark) - before - one} with four")
    assert shuffled(spark) - before - 2 * one < 3 * n * dim * 4  # three rounds: less than all vectors each


def test_blocks_of_lists_make_the_same_links(spark):
    units = units_of(spark, 300, 16)
    links, _ = NeighbourGraph._kept(NeighbourGraph._first(units, 300, 16, 6, 2, 7), 6)
    one, many = (pairs(NeighbourGraph._kept(NeighbourGraph._shown(links, units, 6, b), 6)[0]) for b in (1, 23))
    assert one == many and len(one) > 300


def test_a_round_shows_what_a_plain_loop_does(spark):
    units = units_of(spark, 120, 8)
    links, _ = NeighbourGraph._kept(NeighbourGraph._first(units, 120, 8, 5, 2, 7), 5)
    links = links.withColumn("fresh", F.col("doc_id") % 3 == 0).cache()
    code = {r.doc_id: (np.frombuffer(r.code, np.int8).astype(float), float(r.step)) for r in units.collect()}

    def score(i, j):
        return float(np.float32((code[i][0] @ code[j][0]) * (code[i][1] * code[j][1])))

    have, lists = {}, {}
    for r in links.collect():
        assert r.score == score(r.doc_id, r.other)
        have.setdefault(r.doc_id, []).append(r.score)
    for r in NeighbourGraph._around(links, 5, 3).collect():
        lists.setdefault(r.doc_id, []).append((r.other, r.fresh))
    assert all(len(v) <= 10 for v in lists.values())
    want = {}
    for members in lists.values():
        for i, a in members:
            for j, b in members:
                if i != j and (a or b) and (len(have[i]) < 5 or score(i, j) > min(have[i])):
                    want.setdefault(i, {})[j] = score(i, j)
    want = sorted((i, j, round(s, 6), True) for i, found in want.items() for j, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:5])
    assert pairs(NeighbourGraph._kept(NeighbourGraph._shown(links, units, 5, 3), 5)[0]) == want


def test_vectors_that_are_no_numbers_take_no_links_from_others(spark):
    docs = random_vectors(spark, 40, 6).withColumn("embedding", F.when(F.col("doc_id") == 5, F.array(*[F.lit(float("nan"))] * 6).cast("array<float>")).otherwise(F.col("embedding")))
    edges = {r.doc_id: r.neighbours for r in NeighbourGraph.build(docs, degree=4, width=8).edges.collect()}
    assert set(edges) == set(range(40)) - {5} and all(v and 5 not in v for v in edges.values())
