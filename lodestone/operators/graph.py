"""Knowledge graph tables: nodes (name, docs) and edges (source, target, relation, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import substring_pairs


def merge_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of (doc_id, source, relation, target); a node's documents are distinct, edges stay as they are."""
    ends = triples.select(F.explode(F.array("source", "target")).alias("name"), "doc_id")
    nodes = ends.groupBy("name").agg(F.array_sort(F.collect_set(F.col("doc_id"))).alias("docs"))
    return nodes, triples.select("source", "target", "relation", "doc_id")


def merge_graphs(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    docs = a[0].unionByName(b[0]).select("name", F.explode_outer("docs").alias("doc_id"))
    return docs.groupBy("name").agg(F.array_sort(F.collect_set("doc_id")).alias("docs")), a[1].unionByName(b[1])


def view_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("name").alias("id"), "name", F.greatest(F.lit(1), F.size("docs")).cast("bigint").alias("val"))


def view_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", F.col("relation").alias("name"))


def matching_nodes(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """qid, name, times: nodes whose name holds a query word, with the number of words (repeats count)."""
    named = nodes.select("name", F.lower("name").alias("_lower"))
    pairs = substring_pairs(named, "_lower", terms.select(F.lower("term").alias("word")), "word").select("name", "word")
    return pairs.join(terms.withColumn("word", F.lower("term")), "word").groupBy("qid", "name").agg(F.sum("qtf").alias("times"))


def graph_score(terms: DataFrame, nodes: DataFrame, edges: DataFrame, hop: float = 0.5) -> DataFrame:
    """1 for each matching word and node of a document, hop for each edge at a matching node."""
    hit = matching_nodes(terms, nodes)
    direct = hit.join(nodes, "name").select("qid", F.explode("docs").alias("doc_id"), F.col("times").cast("double").alias("score"))
    # an edge counts once, whichever of its ends match
    numbered = edges.where("doc_id is not null").groupBy("source", "target", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    ends = numbered.select("*", F.explode(F.array_distinct(F.array("source", "target"))).alias("name"))
    touched = ends.join(hit.select("qid", "name"), "name").groupBy("qid", "source", "target", "doc_id").agg(F.first("n").alias("n"))
    near = touched.select("qid", "doc_id", (F.col("n") * hop).alias("score"))
    return direct.unionByName(near).groupBy("qid", "doc_id").agg(F.sum("score").alias("score"))
