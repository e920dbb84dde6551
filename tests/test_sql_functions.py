"""chunk_text as a table function gives the rows of the expression."""

from lodestone.functions.register import chunk_table, register_chunks


def test_chunks_by_lateral_equal_the_expression(spark, sf_dir):
    register_chunks(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, " \n\n "), (-4, "a\n\nb\n \n  c  \n\n" + "long " * 200 + "\n\nd"), (-5, "\n\n".join(f"paragraph {k} " * (k % 7) for k in range(60)))]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    docs.createOrReplaceTempView("chunked_documents")
    got = spark.sql("SELECT d.doc_id, c.chunk_index, c.chunk FROM chunked_documents d, LATERAL chunk_text(d.text, 60, 20) c")
    want = sorted(tuple(r) for r in chunk_table(docs, 60, 20).collect())
    assert sorted(tuple(r) for r in got.collect()) == want and any(r[1] > 3 for r in want)
