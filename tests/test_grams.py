"""Substring joins: the pairs of a nested loop, by an equi join."""

import random

from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.grams import substring_pairs


def test_pairs_are_those_of_a_nested_loop(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé\U0001f600 ") for _ in range(rng.randrange(0, 14))) for _ in range(150)] + ["a\nb.c", None, "abc", "abc"]
    words = ["".join(rng.choice("abcé\U0001f600 ") for _ in range(rng.randrange(0, 6))) for _ in range(80)] + ["\n", "b.c", ".", None, "zzz", "abc", "abc"]
    left = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = substring_pairs(left, "text", spark.createDataFrame([(w,) for w in words], "w string"), "w")
    want = sorted((k, w) for k, t in enumerate(texts) for w in {w for w in words if w} if t is not None and w in t)
    assert sorted((r.id, r.w) for r in got.collect()) == want and want


def test_matching_nodes_by_an_equi_join(spark):
    nodes = spark.createDataFrame([("Red Fish Company", [1]), ("bluefish", [2]), ("whale", [3])], "name string, docs array<long>")
    terms = spark.createDataFrame([(0, "fish", 2), (0, "w", 1), (1, "none", 1)], "qid long, term string, qtf long")
    hit = graph.matching_nodes(terms, nodes)
    assert sorted((r.qid, r.name, r.times) for r in hit.collect()) == [(0, "Red Fish Company", 2), (0, "bluefish", 2), (0, "whale", 1)]
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "_gram" in plan
    assert hit.select(F.sum("times")).first()[0] == 5
