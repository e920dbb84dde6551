"""The text and scoring functions under names for SQL, as expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text import MARKUP, STOPWORDS, chunk_text


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_functions(spark: SparkSession) -> None:
    """clean_text, tokenize_text, dot_product, cosine_similarity and fixed_point."""
    cleaned = "coalesce(s, '')"
    for pattern, to in MARKUP:
        cleaned = f"regexp_replace({cleaned}, {quoted(pattern)}, {quoted(to)})"
    stop = ", ".join(quoted(w) for w in STOPWORDS)
    dot = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    norms = "sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))"
    for name, args, kind, body in (
        ("clean_text", "s STRING", "STRING", f"trim({cleaned})"),
        ("tokenize_text", "s STRING", "ARRAY<STRING>", f"filter(split(lower(coalesce(s, '')), '\\\\s+'), t -> t <> '' AND t NOT IN ({stop}))"),
        ("dot_product", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", dot),
        ("cosine_similarity", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN {norms} > 0 THEN {dot} / ({norms}) ELSE 0D END"),
        ("fixed_point", "x DOUBLE", "BIGINT", "CAST(rint(x * 65536D) AS BIGINT)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")


def register_chunks(spark: SparkSession) -> None:
    """chunk_text(t, max_tokens, overlap) as a table function: chunk_index and chunk, for LATERAL; the expression of the same name, in SQL."""
    none = "CAST(array() AS ARRAY<STRING>)"
    size = lambda p: f"greatest(1, CAST(floor(length({p}) / 4) AS INT))"
    paragraphs = r"filter(transform(split(coalesce(t, ''), '\\n\\s*\\n'), p -> regexp_replace(p, '(?U)^\\s+|\\s+\\z', '')), p -> p <> '')"
    fits = f"c.open AND c.n + {size('q')} <= overlap"
    carried = f"aggregate(reverse(a.held), named_struct('kept', {none}, 'n', 0, 'open', true), (c, q) -> named_struct('kept', if({fits}, concat(array(q), c.kept), c.kept), 'n', if({fits}, c.n + {size('q')}, c.n), 'open', {fits}))"
    full = f"a.n + {size('p')} > max_tokens AND size(a.held) > 0"
    closed = r"concat(a.out, array(array_join(a.held, '\n\n')))"
    step = f"named_struct('out', if({full}, {closed}, a.out), 'held', if({full}, concat({carried}.kept, array(p)), concat(a.held, array(p))), 'n', if({full}, {carried}.n + {size('p')}, a.n + {size('p')}))"
    folded = f"aggregate({paragraphs}, named_struct('out', {none}, 'held', {none}, 'n', 0), (a, p) -> {step}, a -> if(size(a.held) > 0, {closed}, a.out))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION chunk_text(t STRING, max_tokens INT, overlap INT) RETURNS TABLE(chunk_index INT, chunk STRING) RETURN SELECT pos, col FROM (SELECT posexplode({folded}))")


def chunk_table(docs, max_tokens: int = 512, overlap: int = 64):  # noqa: ANN001, ANN201
    """doc_id, chunk_index, chunk: the table form of chunk_text."""
    return docs.select("doc_id", F.posexplode(chunk_text("text", max_tokens, overlap)).alias("chunk_index", "chunk"))
