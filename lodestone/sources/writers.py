"""Sinks: index, document and vector tables as Parquet, and the build job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import chunk_id, chunk_text, first_line, in_domain
from lodestone.operators import index as ix
from lodestone.operators import vectors
from lodestone.operators.catalog import Catalog
from lodestone.operators.vector_store import StoredIvfPq
from lodestone.sources.commit_log import CommitLog, Taken
from lodestone.sources.shared import folders, removed, stored


def write_postings(posted: DataFrame, path: str) -> None:
    """In runs in order of term, so that the statistics of pages find a term's few pages."""
    ix.in_runs(posted).write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def chunks_of(docs: DataFrame, max_tokens: int = 512, overlap: int = 64) -> DataFrame:
    """One row for each chunk: doc_id of the chunk, document_id, chunk_index, total_chunks, title, url, text."""
    parts = docs.withColumn("_chunks", chunk_text("text", max_tokens, overlap))
    each = parts.select(F.col("doc_id").cast("string").alias("document_id"), "title", "url", F.size("_chunks").cast("bigint").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "text"))
    return each.select(chunk_id("document_id", "chunk_index").alias("doc_id"), "document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "total_chunks", "title", "url", "text")


def build_index(
    spark: SparkSession,
    docs: DataFrame,
    root: str,
    *,
    now: float,
    batch_id: str = "",
    domain: bool = False,
    precision: str = "f32",
    use_dual: bool = False,
    use_fts: bool = False,
    pq_only: bool = False,
    extractor: object = None,
    dim: int = 384,
) -> bool:
    """Writes all tables of an index below root; False if the batch was committed before.

    Tables are written to a folder of their own; one commit then makes them the index, so that
    readers of an older commit, or after a build that died, have the tables they had. Of two
    builds of one batch the later to commit gives way. pq_only keeps codes of the vectors in place
    of the vectors (table ivf_pq).
    """
    log, catalog = CommitLog(spark, root), Catalog(spark, f"{root}/catalog")
    if not catalog.should_write(batch_id) or batch_id and batch_id in (log.state() or {"batches": []})["batches"]:
        return False
    build = f"builds/{uuid.uuid4().hex}"
    top, root = root.rstrip("/"), f"{root.rstrip('/')}/{build}"
    tx = catalog.begin(batch_id, now)
    docs = docs.withColumn("title", F.coalesce(F.col("title"), F.lit(""))) if "title" in docs.columns else docs.withColumn("title", first_line("text"))
    if "url" not in docs.columns:
        docs = docs.withColumn("url", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")))
    if domain:
        docs = docs.where(in_domain("title", "text"))
    write_table(chunks_of(docs), f"{root}/documents")
    chunks = spark.read.parquet(f"{root}/documents")
    tokens = ix.with_tokens(chunks)
    posted, titles = ix.postings(tokens), ix.postings(ix.title_tokens(chunks))
    write_table(ix.doc_freq(posted), f"{root}/terms")
    write_postings(posted.join(spark.read.parquet(f"{root}/terms"), "term"), f"{root}/postings")
    write_postings(titles.join(ix.doc_freq(titles), "term"), f"{root}/title_postings")
    write_table(ix.doc_lengths(tokens), f"{root}/doc_lengths")
    write_table(ix.corpus_stats(spark.read.parquet(f"{root}/doc_lengths")), f"{root}/stats")
    if use_fts:
        write_postings(spark.read.parquet(f"{root}/postings"), f"{root}/fts_postings")
    embedded = chunks.select("doc_id", vectors.embed_text("text", dim).alias("embedding"))
    if precision == "f16":
        embedded = vectors.quantize_f16(embedded)
    if precision == "i8":
        write_table(vectors.quantize_i8(embedded), f"{root}/embeddings_i8")
    if pq_only:
        StoredIvfPq.build(stored(embedded), f"{root}/ivf_pq", pq_only=True)
    else:
        write_table(embedded, f"{root}/embeddings")
    if use_dual:
        texts = vectors.dual_texts(chunks.withColumn("summary", F.col("title")))
        write_table(texts.select("doc_id", vectors.embed_text("content", dim).alias("content"), vectors.embed_text("context", dim).alias("context")), f"{root}/dual_embeddings")
    if extractor is not None:
        from lodestone.operators.agent import extract_relations
        from lodestone.operators.graph import merge_triples

        first = chunks.where("chunk_index = 0").select("doc_id", F.substring("text", 1, 1000).alias("text"))
        nodes, edges = merge_triples(extract_relations(first, extractor))
        write_table(nodes, f"{root}/graph_nodes")
        write_table(edges, f"{root}/graph_edges")
    n = chunks.count()

    def change(state: dict) -> dict:
        if batch_id and batch_id in state["batches"]:
            raise Taken(batch_id)
        return {"tables": {name: f"{build}/{name}" for name in names}, "batches": [*state["batches"], *([batch_id] if batch_id else [])]}

    names = folders(spark, root)
    try:
        log.commit(change)
    except Taken:
        catalog.rollback(tx, batch_id, now)
        removed(spark, root)
        return False
    snapshot = catalog.create_snapshot(now, f"batch {batch_id}" if batch_id else "build", added=1)
    catalog.commit(tx, batch_id, snapshot, [(f"{top}/{build}/documents", n)], now)
    return True
