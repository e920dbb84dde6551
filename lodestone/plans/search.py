"""Whole searches as one plan: retrieval, expansion, fusion, re-ranking, boosts, responses."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scoring import fixed_point
from lodestone.functions.text import first_line, parse_query, snippet
from lodestone.operators import index as ix
from lodestone.operators import vectors
from lodestone.operators.context import assemble, with_context
from lodestone.operators.expansion import expand_queries
from lodestone.operators.graph import graph_score
from lodestone.operators.ltr import extract_features, rerank
from lodestone.operators.memory import boosted_by_memory
from lodestone.sources.commit_log import CommitLog
from lodestone.sources.shared import fresh_folder, stored
from lodestone.operators.retrieval import bm25, bm25_ranked, column_filter, fts, fts_boosted, query_terms, ranked, scatter_gather

POOL, FUSED, RERANKED = 20, 50, 20
#: Words that a scan is filtered by; those of more queries are joined only.
PUSHED = 256
#: Scores of a whole search differ if they do at this many bits.
FINE_BITS = 32


@dataclass
class Index:
    """The tables that a search reads. documents has doc_id, text, and title or a title in its first line."""

    documents: DataFrame
    postings: DataFrame
    titles: DataFrame
    lengths: DataFrame
    stats: DataFrame
    terms: DataFrame | None = None
    title_terms: DataFrame | None = None
    embeddings: DataFrame | None = None
    dual: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    fts_postings: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    timings: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of_documents(cls, docs: DataFrame, **more: object) -> Index:
        """An index of documents, stored in the application's own folder."""
        spark = docs.sparkSession
        return cls.load(spark, cls.store(docs, fresh_folder(spark, "index")), **more)

    @staticmethod
    def store(docs: DataFrame, root: str, *, copy: bool = True) -> str:
        """Writes the tables of an index to root; without copy the documents stay where they are. Every text is cleaned once.

        Words are counted inside their documents, so postings are not shuffled; their files are runs in order of term, of which a search reads few pages.
        """
        titled = docs if "title" in docs.columns else docs.withColumn("title", first_line("text"))
        if copy:
            stored(titled, f"{root}/documents")
        tokens = stored(titled.select("doc_id", parse_query("text").alias("tokens"), parse_query("title").alias("title_tokens")), f"{root}/tokens")
        unique = ix.unique_ids(tokens)
        for name, column, df in (("postings", "tokens", "terms"), ("title_postings", "title_tokens", "title_terms")):
            posted = stored(ix.runs_of(tokens, column) if unique else ix.in_runs(ix.postings(tokens, column)), f"{root}/{name}")
            stored(ix.doc_freq(posted), f"{root}/{df}")
        lengths = stored(ix.doc_lengths(tokens), f"{root}/doc_lengths")
        stored(ix.corpus_stats(lengths), f"{root}/stats")
        return root

    @classmethod
    def load(cls, spark, root: str, *, version: int | None = None, documents: DataFrame | None = None, **more: object) -> Index:  # noqa: ANN001
        """The tables in root, or those of one commit of a built index (the last by default), with its vectors and graph; documents stands for theirs."""
        state = CommitLog(spark, root).state(version)
        tables = state["tables"] if state else {}
        read = lambda name: spark.read.parquet(f"{root}/{tables.get(name, name)}")
        kept = {"embeddings": "embeddings", "dual": "dual_embeddings", "nodes": "graph_nodes", "edges": "graph_edges", "fts_postings": "fts_postings"}
        more = {**{field: read(name) for field, name in kept.items() if name in tables}, **more}
        if not tables or "title_terms" in tables:
            more["title_terms"] = read("title_terms")
        return cls(documents if documents is not None else read("documents"), read("postings"), read("title_postings"), read("doc_lengths"), read("stats"), read("terms"), **more)


def lexical(index: Index, queries: DataFrame) -> DataFrame:
    """Hits of queries. The words of few queries are filtered in the scans of the postings; those of many are stored with their df, so their size is known."""
    terms = query_terms(queries)
    words = [r.term for r in terms.select("term").distinct().limit(PUSHED + 1).collect()]
    if len(words) > PUSHED and index.terms is not None:
        title_df = index.title_terms if index.title_terms is not None else ix.doc_freq(index.titles)
        known = [stored(terms.join(df, "term")) for df in (index.terms, title_df)]
        return bm25(known[0], index.postings, index.titles, index.lengths, index.stats, title_terms=known[1])
    of = lambda posted: posted.where(F.col("term").isin(words)) if len(words) <= PUSHED else posted
    return bm25(terms, of(index.postings), of(index.titles), index.lengths, index.stats)


def search(
    index: Index,
    query: str,
    k: int = 10,
    *,
    vector: list[float] | None = None,
    where: tuple[str, object, str] | None = None,
    use_fts: bool = False,
    use_dual: bool = False,
    memories: DataFrame | None = None,
    working: DataFrame | None = None,
    model: object = None,
) -> DataFrame:
    """doc_id, score and rank of the best k documents; 400 is the caller's answer to an empty query.

    Filter and full-text boost apply to the expansion's candidates and to the final ones.
    """
    if not query.strip():
        raise ValueError("the query is empty")
    if not 1 <= k <= 100:
        raise ValueError("k must lie in 1..100")
    session = index.documents.sparkSession
    vector = vector if vector is not None else index.embed(query) if index.embed else None
    asked = session.range(1).select(F.lit(0).alias("qid"), F.lit(query).alias("query"))

    def candidates(of: DataFrame) -> DataFrame:
        hits = lexical(index, of)
        if use_fts:
            more = fts(query_terms(of), index.fts_postings or index.postings, index.lengths, index.stats)
            both = fts_boosted(hits, more)
            hits = both.join(hits.select("qid", "doc_id", "title_only", "qpos"), ["qid", "doc_id"], "left")
        return column_filter(hits, index.documents, *where) if where else hits

    semantic = vectors.cosines(index.embeddings, vector) if index.embeddings is not None and vector is not None else None
    hits = candidates(asked)
    if semantic is not None:
        asked_more = stored(expand_queries(asked, bm25_ranked(hits, POOL), semantic, index.documents, POOL))
        hits = stored(candidates(asked_more))  # ranked and then looked up
    if use_dual and index.dual is not None and vector is not None:
        hits = vectors.dual_boosted(hits, vectors.dual_hybrid(index.dual, vector, 2 * k))
    top = bm25_ranked(hits, FUSED)
    if semantic is not None:
        top = stored(ranked(vectors.rrf(stored(top), semantic), max(RERANKED, k), by=F.col("score")))  # few, so texts need no shuffle
        top = reranked(index, asked, top, hits, semantic, model)
    else:
        top = top.where(F.col("rank") <= max(RERANKED, k))
    for table, factor in ((memories, 1.2), (working, 1.1)):
        if table is not None:
            top = boosted_by_memory(top, index.documents, table, factor)
    # equal documents have equal scores but for the order in which their parts were added
    return ranked(top.select("qid", "doc_id", "score"), k, by=fixed_point(F.col("score"), FINE_BITS)).select("doc_id", "score", "rank")


def reranked(index: Index, asked: DataFrame, top: DataFrame, hits: DataFrame, semantic: DataFrame, model: object = None) -> DataFrame:
    tokens = asked.select("qid", "query", parse_query("query").alias("tokens"))
    rows = top.select("qid", "doc_id").join(hits.select("qid", "doc_id", F.col("score").alias("bm25")), ["qid", "doc_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    rows = rows.join(semantic.select("qid", "doc_id", F.col("score").alias("semantic")), ["qid", "doc_id"], "left")
    if index.nodes is not None and index.edges is not None:
        graph = graph_score(query_terms(asked), index.nodes, index.edges).withColumnRenamed("score", "graph_score")
        rows = rows.join(graph, ["qid", "doc_id"], "left")
    else:
        rows = rows.withColumn("graph_score", F.lit(0.0))
    words = query_terms(asked).select("term").distinct()
    df = index.terms if index.terms is not None else ix.doc_freq(index.postings.join(words, "term", "left_semi"))
    return rerank(extract_features(rows, index.documents, tokens, df, index.stats), model=model)


def respond(index: Index, hits: DataFrame, query: str) -> DataFrame:
    """Hits with title, url and snippet."""
    docs = index.documents
    url = F.col("url") if "url" in docs.columns else F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    return hits.join(docs.select("doc_id", "title", url.alias("url"), snippet("text", query).alias("snippet")), "doc_id")


def explain(index: Index, query: str, k: int = 10, *, vector: list[float] | None = None) -> DataFrame:
    """search() with the parts of the score on the query as it was asked: bm25, semantic, graph."""
    session = index.documents.sparkSession
    vector = vector if vector is not None else index.embed(query) if index.embed else None
    asked = session.range(1).select(F.lit(0).alias("qid"), F.lit(query).alias("query"))
    out = stored(search(index, query, k, vector=vector).withColumnRenamed("score", "final_score"))
    found = out.select("doc_id")
    parts = [("bm25", lexical(index, asked))]
    if index.embeddings is not None and vector is not None:
        parts.append(("semantic", vectors.cosines(index.embeddings, vector)))
    if index.nodes is not None and index.edges is not None:
        parts.append(("graph", graph_score(query_terms(asked), index.nodes, index.edges)))
    for name, scores in parts:
        out = out.join(scores.join(found, "doc_id", "left_semi").select("doc_id", F.col("score").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out


def profile(index: Index, query: str, k: int = 10, **options: object) -> tuple[list, dict[str, float]]:
    """The result's rows and milliseconds of planning and running."""
    began = time.perf_counter()
    plan = search(index, query, k, **options)
    planned = time.perf_counter()
    rows = plan.orderBy("rank").collect()  # k rows at most
    done = time.perf_counter()
    return rows, {"planning_ms": round((planned - began) * 1000, 2), "search_ms": round((done - planned) * 1000, 2), "total_search_ms": round((done - began) * 1000, 2)}


def context(index: Index, query: str, k: int = 10, max_tokens: int = 4000, **options: object) -> DataFrame:
    """One text for a language model, assembled from the hits."""
    hits = search(index, query, k, **options).withColumn("qid", F.lit(0))
    docs = with_context(index.documents).withColumn("document_id", F.when(F.col("document_id") == "", F.col("doc_id").cast("string")).otherwise(F.col("document_id")))
    return assemble(hits.join(docs, "doc_id"), max_tokens)


def distributed(shards: list[Index], query: str, k: int = 10, **options: object) -> DataFrame:
    """Searches of several indexes as one list."""
    found = [search(s, query, k, **options).select(F.lit(0).alias("qid"), "doc_id", "score") for s in shards]
    return scatter_gather(found, k)


def score_units(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score_fp", fixed_point(F.col("score")))
