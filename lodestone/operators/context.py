"""Context assembly: dedup, grouping by document, fitting to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import format_chunk, text_overlap

DEDUP_THRESHOLD, CHUNKS_PER_DOCUMENT, DEDUP_CHARS = 0.85, 5, 500
JOINT = "\n\n---\n\n"
LEAST_REST = 100

# The fields of a chunk's context with their defaults.
CONTEXT_DEFAULTS = {
    "chunk_index": 0, "total_chunks": 1, "document_id": "", "document_title": "", "section_path": "", "preceding_context": "", "following_context": "", "url": "",
}


def with_context(docs: DataFrame) -> DataFrame:
    """docs with every context field, missing ones and nulls filled by their defaults."""
    have = set(docs.columns)
    return docs.withColumns({f: F.coalesce(F.col(f), F.lit(v)) if f in have else F.lit(v) for f, v in CONTEXT_DEFAULTS.items()})


def dedup_chunks(chunks: DataFrame, threshold: float = DEDUP_THRESHOLD) -> DataFrame:
    """Chunks (qid, rank, text, ...) that are unlike all kept before them in their query.

    A fold over the ranked chunks of a query, of which retrieval leaves at most a hundred.
    """
    if threshold >= 1:
        return chunks
    rest = F.struct("rank", F.lower(F.substring("text", 1, DEDUP_CHARS)).alias("head"))
    folded = chunks.groupBy("qid").agg(F.array_sort(F.collect_list(rest)).alias("all"))
    kind = folded.schema["all"].dataType.simpleString()
    kept = F.aggregate("all", F.array().cast(kind), lambda acc, c: F.when(F.exists(acc, lambda k: text_overlap(k["head"], c["head"]) >= threshold), acc).otherwise(F.concat(acc, F.array(c))))
    ranks = folded.select("qid", F.explode(F.transform(kept, lambda c: c["rank"])).alias("rank"))
    return chunks.join(ranks, ["qid", "rank"])


def grouped(chunks: DataFrame, per_document: int = CHUNKS_PER_DOCUMENT) -> DataFrame:
    """Chunks with seq: documents by their first rank, inside by chunk_index, of each a few."""
    w = Window.partitionBy("qid", "document_id")
    first = chunks.withColumn("_first", F.min("rank").over(w)).withColumn("_nth", F.row_number().over(w.orderBy("chunk_index", "rank")))
    seq = F.row_number().over(Window.partitionBy("qid").orderBy("_first", "_nth")).cast("bigint")
    return first.where(F.col("_nth") <= per_document).withColumn("seq", seq).drop("_first", "_nth")


def word_tokens(text: Column) -> Column:
    """Estimated tokens: four thirds of the words."""
    return F.floor(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) * 4 / 3).cast("bigint")


def fit_to_budget(chunks: DataFrame, max_tokens: int) -> DataFrame:
    """qid and context: formatted chunks in order of seq while they fit.

    The first that does not fit is cut to the words that are left, if that is more than a
    hundred tokens, and ends the context.
    """
    rows = chunks.withColumn("_t", F.col("formatted")).withColumn("_n", word_tokens(F.col("_t")))
    w = Window.partitionBy("qid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("_rest", max_tokens - F.col("_before"))
    fits = F.col("_n") <= F.col("_rest")
    rows = rows.withColumn("_over", F.sum((~fits).cast("int")).over(Window.partitionBy("qid").orderBy("seq")))
    words = F.filter(F.split("_t", r"\s+"), lambda x: x != "")
    cut = F.concat(F.array_join(F.slice(words, F.lit(1), F.floor(F.col("_rest") * 3 / 4).cast("int")), " "), F.lit("..."))
    part = F.when(fits, F.col("_t")).when(F.col("_rest") > LEAST_REST, cut)
    kept = rows.where((F.col("_over") == 0) | ((F.col("_over") == 1) & ~fits)).withColumn("_part", part).where("_part is not null")
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_part"))), lambda s: s["_part"]), JOINT).alias("context"))


def assemble(chunks: DataFrame, max_tokens: int = 4000, threshold: float = DEDUP_THRESHOLD) -> DataFrame:
    """One context for each query of ranked chunks with context fields."""
    rows = grouped(dedup_chunks(chunks, threshold))
    written = format_chunk(F.col("text"), F.col("section_path"), F.col("preceding_context"), F.col("following_context"))
    return fit_to_budget(rows.withColumn("formatted", written), max_tokens)
