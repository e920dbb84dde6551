"""Scoring formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of ranking.
K1, B, TITLE_BOOST, RRF_K, RRF_LEXICAL, RRF_SEMANTIC = 1.5, 0.75, 3.0, 60, 0.4, 0.6
FRACTION_BITS = 16


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def bm25_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def title_weight(tf: Column, k1: float = K1) -> Column:
    return tf * (k1 + 1) / (tf + k1)


def tfidf_weight(tf: Column, n_docs: Column, df: Column) -> Column:
    return tf * (F.log((n_docs + 1) / (df + 1)) + 1)


def fixed_point(score: Column, bits: int = FRACTION_BITS) -> Column:
    """Score as a whole number of 2**-bits, half to even: equal on every machine."""
    return F.rint(score * float(1 << bits)).cast("bigint")


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, guard: float = 0.0) -> Column:
    """Cosine; 0 where a norm is 0. guard is added to the denominator."""
    below = norm(a) * norm(b) + guard
    return F.when(below > 0, dot(a, b) / below).otherwise(0.0)


def vector_literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))
