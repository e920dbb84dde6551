"""The bounded buffer as stream state: three batches, two agents, the oldest go first, state outlives the query."""

from lodestone.streaming.ingest import working_memory


def test_buffer_over_three_batches_and_a_restart(spark, tmp_path):
    source, check, seen = str(tmp_path / "in"), str(tmp_path / "check"), {}

    def keep(batch, batch_id):
        seen.update({r.agent_id: list(r.held) for r in batch.collect()})

    def run():
        pushes = spark.readStream.schema("agent_id string, text string").parquet(source)
        query = working_memory(pushes, 3).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()

    def push(*rows):
        spark.createDataFrame(list(rows), "agent_id string, text string").coalesce(1).write.mode("append").parquet(source)

    push(("a", "1"), ("a", "2"))
    run()
    assert seen == {"a": ["1", "2"]}
    push(("a", "3"), ("a", "4"), ("b", "x"))
    run()
    assert seen == {"a": ["2", "3", "4"], "b": ["x"]}
    push(("b", "y"))
    seen.clear()
    run()
    assert seen == {"b": ["x", "y"]}  # an agent without pushes gives no row
