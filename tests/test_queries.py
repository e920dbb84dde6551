"""Registered queries against their SQL, on the smallest tables."""

import pytest

from lodestone.plans.oracles import ORACLES
from lodestone.plans.queries import QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_rows_match_sql(name, agrees):
    agrees(QUERIES[name], ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_approximate_searches_find_the_exact_hits(spark, sf_dir):
    exact = {r.doc_id for r in QUERIES["knn_ip"](spark, sf_dir).where("rank <= 10").collect()}
    for name in ("ivf_pq_search", "lsh_search"):
        found = {r.doc_id for r in QUERIES[name](spark, sf_dir).collect()}
        assert len(found & exact) >= 9, name


@pytest.mark.parametrize("name", ["search_context", "chunk_text", "context_dedup", "html_extract", "cross_encoder", "quantize_f16", "embed_documents"])
def test_queries_without_sql_give_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_works_without_the_llm_folder():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys; sys.path[:0] = [{str(root)!r}]
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("lodestone.llm", "corpus_pipeline")): raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "bm25_topk" in e.queries() and not any(k.startswith("op") for k in e.queries())
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0
    # nor does it need what the folder needs
    code = code.replace('("lodestone.llm", "corpus_pipeline")', '"public_tokenizers"')
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0


def test_chunks_are_whole_paragraphs(spark, sf_dir):
    """The chunker as a plain loop over paragraphs, on the documents' lines."""

    def tokens(p):
        return max(1, len(p) // 4)

    def chunks(text, most, overlap):
        out, held = [], []
        for p in [p.strip() for p in (text or "").split("\n") if p.strip()]:
            if held and sum(map(tokens, held)) + tokens(p) > most:
                out.append("\n\n".join(held))
                back = []
                while held and sum(map(tokens, back)) + tokens(held[-1]) <= overlap:
                    back.insert(0, held.pop())
                held = back
            held.append(p)
        return out + (["\n\n".join(held)] if held else [])

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {(i, k, c) for i, t in texts.items() for k, c in enumerate(chunks(t, 128, 40))}
    assert {tuple(r) for r in QUERIES["chunk_text"](spark, sf_dir).select("doc_id", "chunk_index", "chunk").collect()} == want


def test_html_text_keeps_what_shows(spark):
    from lodestone.sources.readers import html_to_text

    page = "<head><title>no</title></head><p>One<br>two &amp; three</p><ul><li>a</li><li>b</li></ul><table><td>x</td><td>y</td></table><script>no</script></style>end"
    assert html_to_text(page) == "\nOne\ntwo & three\n\na\n\nb\nxyend"
    assert html_to_text("<noscript><script>a</script>b</noscript>c") == "c" and html_to_text(None) == ""


def test_places_are_those_of_one_sort(spark):
    from pyspark.sql import functions as F

    from lodestone.operators.retrieval import placed

    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("qid"), "id", (F.col("id") * 7919 % 101).alias("x"))
    got = {(r.id): (r.place, r.total) for r in placed(rows, F.desc("x"), "id", total="x").collect()}
    for qid in (None, 0, 1):
        mine = sorted(((-(i * 7919 % 101), i) for i in range(5000) if (i % 2 if i % 3 else None) == qid))
        total = 0
        for place, (x, i) in enumerate(mine, 1):
            total -= x
            assert got[i] == (place, total)
