"""The corpus pipeline: toxicity, line dedup, near copies, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as
Parquet and reads again as the next one's docs. All but the last return the columns of
documents; n_chars is the length of the text as it is then.

Edge cases are those of the operators: a null text is an empty one and passes all stages
to packing, where it is one end id; null ids and repeated rows pass, repeated rows as one
document after the third stage; an empty table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.llm.decontamination import contamination
from lodestone.llm.jaccard_join import one_of_each
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.packing import pack
from lodestone.llm.toxicity import learn, score
from lodestone.sources.shared import fresh_folder, removed

#: A document of which this share of words comes from the benchmark goes as a whole.
LEAK_SHARE = 0.5
#: Near copies share this percentage of their shingles of so many words; op8 has values of its own.
COPY_NGRAM, COPY_PERCENT = 5, 80


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("predicted") == 0).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages of 40 words or more are cut out of the texts, be they one line or many."""
    return measured(dedup_lines(docs), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each(docs, ngram=COPY_NGRAM, percent=COPY_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that mostly consist of them go."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), cut_spans=True)
    hit = F.aggregate("runs", F.lit(0), lambda n, r: n + r["end"] - r["start"])
    return measured(found.where((hit == 0) | (hit < LEAK_SHARE * F.col("n_words"))), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, packed into sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_copies", near_copies), ("decontamination", decontamination), ("packing", packing)]

#: Learning, hashing of whole texts and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, f"{folder}/{before}")
        before = name
    return docs
