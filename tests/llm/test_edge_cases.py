"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm.chat_format import chat_digest, chat_examples
from lodestone.llm.decontamination import contamination, contamination_digest, without_spans
from lodestone.llm.jaccard_join import jaccard_components, jaccard_digest, one_of_each
from lodestone.llm.line_dedup import dedup_lines, line_digest
from lodestone.llm.media import media_digest, sniff_media, texts_to_media
from lodestone.llm.packing import pack
from lodestone.llm.secret_scan import secret_scan
from lodestone.llm.suffix_dedup import suffix_dedup, suffix_digest
from lodestone.llm.token_counts import token_counts
from lodestone.llm.toxicity import learn, score

BPE = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k} secret{k % 7}." for k in range(30_000))
ROWS = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (1, "other text of the same id", "en", "s", 25), (None, "no id here at all", None, None, None), (None, None, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, LONG, "en", "s", len(LONG)), (5, "\x00\x01 é\U0001f600 \ud7ff", "xx", "s", 5), (6, "   \n\n\t ", "en", "s", 6)]
#: Names that the operators use themselves.
CLASHING = ["n_words", "runs", "items", "score", "predicted", "_row_id", "_row_key", "spans", "n_lines", "starts", "_lines", "label", "part", "words", "media", "key", "class", "group", "size", "_node", "_nth", "h", "owner", "base", "document_id"]


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def toxic(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    return score(docs, learn(docs, labels))


OPERATORS = {
    "toxicity": toxic,
    "line_dedup": lambda d, s: line_digest(dedup_lines(d)),
    "token_counts": lambda d, s: token_counts(d, BPE),
    "suffix_dedup": lambda d, s: suffix_digest(suffix_dedup(d)),
    "decontamination": lambda d, s: contamination_digest(contamination(d, items_of(s, [(1, "a b"), (None, "zzz"), (2, None), (2, "")]))),
    "packing": lambda d, s: pack(d, BPE),
    "secret_scan": lambda d, s: secret_scan(d),
    "jaccard": lambda d, s: jaccard_digest(jaccard_components(d)),
    "media": lambda d, s: media_digest(sniff_media(texts_to_media(d))),
}


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, DOC)
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd, spark):
    out = OPERATORS[name](odd, spark)
    if name == "packing":
        assert out.agg(F.count_if(F.col("start") == 0)).first()[0] == len(ROWS)
    else:
        assert out.count() == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, spark):
    assert OPERATORS[name](spark.createDataFrame([], DOC), spark).count() == 0


def test_defined_results(odd, spark):
    by = lambda df, c: {(r.doc_id, r[c]) for r in df.collect()}
    assert by(OPERATORS["token_counts"](odd, spark).where("doc_id in (2, 3, 6)"), "n_tokens") == {(2, 0), (3, 0), (6, 0)}
    assert by(OPERATORS["jaccard"](odd, spark).where("doc_id in (1, 2, 3)"), "n_shingles") == {(1, 3), (2, 0), (3, 0)}
    hit = OPERATORS["decontamination"](odd, spark)
    assert by(hit.where("doc_id = 1"), "n_hit") == {(1, 2), (1, 0)} and by(hit.where("doc_id = 3"), "contaminated") == {(3, False)}
    lines = OPERATORS["line_dedup"](odd, spark)
    assert by(lines.where("doc_id = 1"), "n_removed") == {(1, 0)}


def test_no_labels_and_one_kind_of_labels(spark):
    docs = spark.createDataFrame(ROWS, DOC)
    for labels, want in (([], 0.0), ([(k, 1) for k in range(40)], 1.0)):
        out = score(docs, learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
        assert {r.score for r in out.collect()} == {want}


def test_chat_edges(spark):
    turns = spark.createDataFrame([(None, None, None, None), (1, 1, "user", "u"), (1, 1, "user", "u"), (1, 0, "assistant", "a"), (2, 0, "assistant", None)], "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1)).withColumn("parts", F.lit(1))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_digest(chat_examples(turns)).collect()}
    assert got == {None: (1, 0), 1: (3, 1), 2: (1, 0)}
    assert chat_digest(chat_examples(turns.limit(0))).count() == 0


def test_spans_leave_the_text(spark):
    docs = spark.createDataFrame([(1, "keep One, two three! end"), (2, "clean")], "doc_id long, text string")
    found = contamination(docs, items_of(spark, [(1, "one two THREE")]))
    assert {r.doc_id: r.text for r in without_spans(found).collect()} == {1: "keep ! end", 2: "clean"}


def test_one_of_each_keeps_clean_rows(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(7, text), (3, text + " more"), (9, text), (9, text), (4, "something else entirely here"), (None, None), (5, "")]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted([(False, 3), (False, 4), (True, None), (False, 5)], key=lambda x: (x[0], x[1] or 0))


def test_pipeline_stages_on_odd_rows(spark, sf_dir, tmp_path):
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, DOC)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            out.write.parquet(str(tmp_path / f"{len(rows)}-{name}"))
            if name != "packing":
                assert out.columns == docs.columns
            docs = spark.read.parquet(str(tmp_path / f"{len(rows)}-{name}"))
        assert (docs.count() > 0) == bool(rows)


def test_long_texts_of_matches_take_time_in_proportion(spark):
    """Twenty thousand values in one text: what grew with their square took minutes."""
    import hashlib
    import time

    text = " ".join(hashlib.sha1(str(k).encode()).hexdigest() for k in range(20_000))
    began = time.perf_counter()
    (row,) = secret_scan(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).collect()
    assert row.n_hex == 20_000 and time.perf_counter() - began < 60


def test_line_dedup_of_shared_and_missing_ids(spark):
    passage = " ".join(f"w{k}" for k in range(45))
    rows = [(None, passage), (None, passage), (None, "own. " + passage), (1, passage), (1, "other. " + passage), (2, None), (3, "")]
    got = sorted((repr(r.doc_id), r.text, r.n_lines) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # rows equal in id and text are one document: the first of all, whose rows both stay; which of two texts of an id is first, their hash tells
    kept = [t for _, t, _ in got if passage in t]
    assert len(got) == len(rows) and set(kept) in ({passage}, {"own. " + passage}) and len(kept) in (1, 2)
    assert ("2", "", 0) in got and ("3", "", 0) in got
