"""Codes and top-k searches over vectors against plain second implementations."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import threshold_search as ts
from lodestone.llm import yinyang_codes as yy
from lodestone.llm.common import table
from lodestone.llm.queries import QUERIES, SQL

VEC = "vec_id long, embedding array<float>, label int, code string, x string, rank string"
NAN, INF = float("nan"), float("inf")


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "code", "x", "rank") for r in rows], VEC)


def kept(rows, factor):
    fine = [(i, [math.floor(factor * float(np.float32(x))) for x in v], *more) for i, v, *more in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for _, v, *_ in fine), default=0)
    return [(i, v + [0] * (dim - len(v)), *more) for i, v, *more in fine]


def lloyd(rows, entries=256, rounds=4, parts=4):
    """Codes, errors and codebooks by full scans in Python numbers."""
    fine = kept(rows, 1024)
    fine = [(i, v + [0] * (-len(v) % parts), label) for i, v, label in fine]
    fine = [(i, v if v else [0] * parts, label) for i, v, label in fine]
    order = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(order[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in order[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def dealt():
        return [[min((away(cut(v, p), c), k) for k, c in enumerate(books[p])) for p in range(parts)] for _, v, _ in fine]

    for _ in range(rounds):
        at = dealt()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), a in zip(fine, at, strict=True) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), label) for (i, _, label), a in zip(fine, dealt(), strict=True)]
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], sha) for i, c, e, label in out), key=repr)


def best(rows, every=50, k=5):
    fine = kept(rows, 256)
    asked = {}
    for i, v, *_ in fine:
        if i is not None and i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for i, q in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for j, v, *_ in fine if j != i)
        out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(scored[:k])]
    return sorted(out)


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_rows(n, dim, seed, grid=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(grid)) if grid else (lambda: rng.gauss(0, 0.2))
    return [(k, [draw() for _ in range(dim)], rng.choice([0, 1, 2, None])) for k in range(n)]


ODD = [(0, [0.5, -0.25, 1.0, 0.0, 0.125], 1), (0, [0.5, -0.25, 1.0, 0.0, 0.125], 1), (50, [0.1, 0.2], None), (50, [0.1, 0.3], 2), (None, [0.5, 0.5, 0.5, 0.5, 0.5], None), (7, None, 1), (8, [None, 1.0], 1), (9, [NAN, 1.0], 1), (100, [INF, 1.0], 1), (11, [], 1), (150, [-0.0, 0.0, 0.0, 0.0, -1.0], 3), (-50, [1.0, 1.0, -1.0], 0)]
HOT = [(k, [0.25, -0.5, 0.125, 1.0], k % 2) for k in range(120)] + [(k, [0.25, -0.5, 0.125, (k % 9) / 8], None) for k in range(120, 260)]
TABLES = {
    "odd": ODD,
    "few dimensions": random_rows(700, 4, 1),
    "ties on a grid": random_rows(500, 8, 2, [-0.5, 0.0, 0.5]),
    "one very common vector": HOT,
    "wide": random_rows(300, 24, 3),
    "one row": [(50, [0.5, 0.5], 1)],
}


@pytest.mark.parametrize("name", TABLES)
def test_codes_equal_full_scans(name, spark):
    got = yy.code_digest(rows_of(spark, TABLES[name]).repartition(3))
    assert values(got) == lloyd(TABLES[name])


@pytest.mark.parametrize("name", TABLES)
def test_top_k_equals_brute_force(name, spark, monkeypatch):
    monkeypatch.setattr(ts, "BLOCK_BYTES", 1200)
    monkeypatch.setattr(ts, "SCORES", 64)
    got = ts.top_k(rows_of(spark, TABLES[name]).repartition(3), query_bytes=200)
    assert sorted(tuple(r) for r in got.collect()) == best(TABLES[name])


def test_empty_tables(spark):
    empty = rows_of(spark, [])
    assert yy.code_digest(empty).count() == 0 and ts.top_k(empty).count() == 0
    none = rows_of(spark, [(1, None, 1), (50, [NAN], 2)])
    assert yy.code_digest(none).count() == 0 and ts.top_k(none).count() == 0


def test_bounds_spare_distances(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    coded, q, scanned = yy.yinyang_codes(rows)
    full = rows.count() * q.parts * q.books.shape[1]
    assert scanned[0] == full and all(n < full for n in scanned[1:])
    assert coded.count() == rows.count()


def test_lists_stop_early_in_few_dimensions():
    """With one strong dimension a block is left after its first steps, and the bound of each step holds for all rows beyond."""
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(-1000, 1000, 4000), rng.integers(-2, 3, 4000)], axis=1)
    _, rows, ends, lows, highs = ts.block_of(np.arange(4000), x)
    x = np.frombuffer(rows, np.int32).reshape(-1, 2).astype(np.int64)
    lows, highs = (np.frombuffer(b, np.int32).reshape(-1, 2).astype(np.int64) for b in (lows, highs))
    for q in ([3, 1], [-5, 2], [0, -1], [0, 0]):
        q = np.array(q)
        limits = np.maximum(q, 0) @ highs.T + np.minimum(q, 0) @ lows.T
        assert list(limits) == sorted(limits, reverse=True)
        for n, start in enumerate([0, *ends[:-1]]):
            assert (x[start:] @ q).max(initial=limits[n]) <= limits[n]
    kth = np.sort(x @ np.array([3, 1]))[-5]
    limits = np.maximum([3, 1], 0) @ highs.T
    assert (limits < kth).any() and ends[int(np.argmax(limits < kth)) - 1] < 2000


def test_huge_components_are_exact_or_an_error(spark):
    rows = [(k, [float(2**12 + k), float(k), -float(2**11), 1.0], 0) for k in range(60)]
    assert values(yy.code_digest(rows_of(spark, rows))) == lloyd(rows)
    assert sorted(tuple(r) for r in ts.top_k(rows_of(spark, rows)).collect()) == best(rows)
    with pytest.raises(ValueError, match="too large"):
        ts.top_k(rows_of(spark, [(1, [1e30], 0)]))


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_top_k"])
def test_queries_equal_sql(name, agrees):
    agrees(QUERIES[name], SQL[name])


def test_top_k_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")).collect()]
    assert sorted(tuple(r) for r in QUERIES["op12_top_k"](spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()) == best(rows)
