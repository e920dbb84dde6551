"""Agent memory tables; the present moment is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import cosine, vector_literal

from .grams import substring_pairs

DECAY, EPISODIC_MAX, WORKING_MAX = 0.1, 10_000, 500
DAY = 86_400.0
#: Heads of memories that are looked for in each text; more are looked up by grams.
FEW_HEADS = 64


def recency(now: float, last: Column | str = "last_accessed", decay: Column | float = DECAY) -> Column:
    return F.exp(-(decay if isinstance(decay, Column) else F.lit(decay)) * (F.lit(now) - (F.col(last) if isinstance(last, str) else last)) / DAY)


def memory_score(query: list[float], now: float) -> Column:
    """Cosine by recency by importance; 0 without an embedding."""
    return F.when(F.col("embedding").isNotNull(), cosine(F.col("embedding"), vector_literal(query), 1e-10) * recency(now) * F.col("importance")).otherwise(0.0)


def recall(memories: DataFrame, query: list[float], k: int, now: float) -> DataFrame:
    w = Window.partitionBy("agent_id").orderBy(F.desc("score"), "memory_id")
    return memories.withColumn("score", memory_score(query, now)).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def touch(memories: DataFrame, recalled: DataFrame, now: float) -> DataFrame:
    """Memories in which those recalled were accessed now, once more."""
    ids = recalled.select("agent_id", "memory_id").distinct().withColumn("_hit", F.lit(True))
    rows = memories.join(ids, ["agent_id", "memory_id"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    return rows.withColumns({"access_count": F.col("access_count") + hit.cast("bigint"), "last_accessed": F.when(hit, F.lit(now)).otherwise(F.col("last_accessed"))}).drop("_hit")


def evict(memories: DataFrame, most: int, now: float) -> DataFrame:
    """Of each agent the memories of largest recency by importance; age breaks ties."""
    w = Window.partitionBy("agent_id").orderBy(F.desc("_weight"), F.desc("memory_id"))
    return memories.withColumn("_weight", recency(now) * F.col("importance")).withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most).drop("_weight", "_nth")


def decayed(memories: DataFrame, now: float) -> DataFrame:
    return memories.withColumn("weight", recency(now) * F.col("importance"))


def last_n(memories: DataFrame, n: int, key: str = "agent_id", order: str = "memory_id") -> DataFrame:
    """The last n of each key: recent memories, or what a bounded first-in first-out buffer holds."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return memories.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def drain(buffer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the buffer holds, and the empty buffer after it."""
    return buffer, buffer.limit(0)


def stats(memories: DataFrame, now: float) -> DataFrame:
    return memories.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.lit(now) - F.col("created_at")) / DAY).alias("avg_age_days"),
        F.avg("importance").alias("avg_importance"),
        F.avg(recency(now)).alias("avg_recency"),
    )


def working_search(buffer: DataFrame, query: list[float], k: int) -> DataFrame:
    score = F.when(F.col("embedding").isNotNull(), cosine(F.col("embedding"), vector_literal(query), 1e-10) * F.col("importance")).otherwise(0.0)
    return buffer.withColumn("score", score).orderBy(F.desc("score"), "memory_id").limit(k)


def boosted_by_memory(hits: DataFrame, docs: DataFrame, memories: DataFrame, factor: float, head_chars: int = 50) -> DataFrame:
    """Hits raised where a memory's first characters occur in the document's text, to be ranked anew."""
    heads = memories.select(F.substring("text", 1, head_chars).alias("_head")).where("_head <> ''").distinct()
    texts = hits.select("doc_id").distinct().join(docs.select("doc_id", "text"), "doc_id")
    known = substring_pairs(texts, "text", heads, "_head", few=FEW_HEADS).select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return hits.join(known, "doc_id", "left").withColumn("score", F.when(F.coalesce("_hit", F.lit(False)), F.col("score") * factor).otherwise(F.col("score"))).drop("_hit")


def list_agents(memories: DataFrame) -> DataFrame:
    return memories.select("agent_id").distinct()


def delete_agent(memories: DataFrame, agent_id: str) -> DataFrame:
    return memories.where(F.col("agent_id") != agent_id)


def write_partitions(memories: DataFrame, path: str) -> None:
    """One folder for each agent, so that a read for one agent opens no other."""
    memories.write.mode("overwrite").partitionBy("agent_id").parquet(path)
