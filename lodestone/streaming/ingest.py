"""Streaming ingest: new files become postings, each batch exactly once; a bounded buffer as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import index as ix

DOCUMENTS = "doc_id long, text string"


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, schema: str = DOCUMENTS) -> StreamingQuery:
    """Reads what is new in a folder of Parquet files and appends postings, one folder for each batch.

    A batch that is run again writes the same folder again, so nothing is counted twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ix.postings(ix.with_tokens(batch)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def working_memory(pushes: DataFrame, most: int) -> DataFrame:
    """The last `most` texts of each agent after every batch of pushes (agent_id, text)."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for p in parts:
            held = (held + p["text"].tolist())[-most:]
        state.update((held,))
        yield pd.DataFrame({"agent_id": [key[0]], "held": [held]})

    return pushes.groupBy("agent_id").applyInPandasWithState(update, "agent_id string, held array<string>", "held array<string>", "update", "NoTimeout")
