"""Inputs that once took a square of their size, or a wrong turn: magic bytes, equal rows, odd white space."""

import random
import re
import struct
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import media
from lodestone.llm.suffix_dedup import suffix_dedup, suffix_digest
from lodestone.llm.token_counts import count_tokens
from lodestone.llm.wordbpe import word_bpe

BPE = public_tokenizers.path("word_bpe_49k.json")
MARKS = {
    "zip": b"PK\x03\x04" * 32_000,
    "zip and end records": b"PK\x03\x04PK\x05\x06" * 20_000,
    "pdf": b"%PDF-1 startxref 0 %%EOF " * 8_000,
    "pdf with far tables": b"%PDF-1 1 0 obj startxref 90000 %%EOF " * 5_000,
    "pdf headers": b"%PDF-" * 40_000,
    "jpeg": b"\xff\xd8\xff\xda\x00\x02" * 30_000,
}


@pytest.mark.parametrize("name", MARKS)
def test_magic_bytes_take_time_in_proportion(name):
    began = time.process_time()
    media.carve(MARKS[name])
    assert time.process_time() - began < 1


def plain_zip(b, at):
    for m in re.finditer(rb"PK\x05\x06", b):
        if at <= m.start() <= len(b) - 22:
            size, offset, comment = struct.unpack_from("<IIH", b, m.start() + 12)
            if at + offset + size == m.start() and m.start() + 22 + comment <= len(b):
                return m.start() + 22 + comment - at
    return 0


def plain_pdf(b, at):
    end = 0
    for m in media.PDF_END.finditer(b, at):
        table = at + int(m[1])
        found = media.PDF_TABLE.match(b, table)
        if not end or b.find(b"%PDF-", end, m.start()) < 0 or (table >= end and found and found.end() <= m.start()):
            end = m.end()
    return end - at if end else 0


def test_end_marks_are_those_of_a_plain_scan():
    rng = random.Random(1)
    record = lambda size, offset, c=b"": b"PK\x05\x06" + b"\0" * 8 + struct.pack("<IIH", size, offset, len(c)) + c
    bits = [b"%PDF-1.4\n", b"startxref\n0\n%%EOF\n", b"startxref 5 %%EOF ", b"startxref 20\n%%EOF", b"startxref 40 %%EOF\n\n", b"xref\n", b"1 0 obj\n", b"x", b"yy ", b"PK\x03\x04", b"PK\x05\x06", record(0, 10), record(0, 4), record(5, 9, b"c"), b"12 3 obj "]
    hits = {"zip": 0, "pdf": 0}
    for _ in range(4_000):
        b = b"".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))
        ends = media.Ends(b)
        for m in re.finditer(rb"PK\x03\x04|%PDF-", b):
            kind = "zip" if m[0][:2] == b"PK" else "pdf"
            got = (media.zip_length if kind == "zip" else media.pdf_length)(b, m.start(), ends)
            assert got == (plain_zip if kind == "zip" else plain_pdf)(b, m.start()), (b, m.start())
            hits[kind] += got > 0
    assert min(hits.values()) > 50


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 4), (30, 8)])
def test_counts_at_all_kinds_of_white_space(chunk, overlap):
    rng, library, encoder = random.Random(7), Tokenizer.from_file(BPE), word_bpe(BPE)
    signs = "ab 1.\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　​᠎é"
    for _ in range(2_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 120)))
        assert count_tokens(encoder, text, chunk, overlap) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_equal_rows_cost_in_proportion(spark, monkeypatch):
    from lodestone.llm import suffix_dedup as sd

    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2_000))
    seen = {}
    plain = sd.surroundings

    def counted(*args):
        out = plain(*args)
        seen["rows"] = out.count()
        return out

    monkeypatch.setattr(sd, "surroundings", counted)
    rows = {}
    for m in (20, 80):
        docs = spark.createDataFrame([(1, text)] * m + [(2, "x" + text[300:1_400]), (3, "nothing of it")], "doc_id long, text string")
        got = {tuple(r) for r in suffix_digest(suffix_dedup(docs)).select("doc_id", "n_removed", "n_spans").collect()}
        assert got == {(1, 2_000, 1), (2, 1_100, 1), (3, 0, 0)}
        rows[m] = seen["rows"]
    assert rows[80] <= 4.2 * rows[20]
    assert suffix_digest(suffix_dedup(docs)).where(F.col("doc_id") == 1).count() == 80


def test_a_value_in_a_third_of_all_documents(spark):
    from lodestone.llm.secret_scan import secret_scan

    key = "Ab3dEf6hIj9lMn2pQr5t"
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("token = "), F.when(F.col("id") % 3 == 0, F.lit(key)).otherwise(F.concat(F.lit("Zz9"), F.sha2(F.col("id").cast("string"), 256)))).alias("text"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"))
    want = sorted(tuple(r) for r in secret_scan(docs).collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = secret_scan(docs)
        assert sorted(tuple(r) for r in out.collect()) == want
        join = out._jdf.queryExecution().optimizedPlan().toString().split("value_hash")[-1]
        assert "Aggregate" not in join  # what the values are joined with is a scan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    common = [r for r in want if r[-1] == 300]
    assert len(common) == 300 and all(r[-2] == 1 for r in common)  # n_example


def test_copies_of_a_class_count_once_for_a_token(spark):
    """Prefixes of a copy may come from many tasks; a single shared token of four does not open a group."""
    from lodestone.llm.jaccard_join import opened

    one = [(5, 1, 1, 100), (5, 2, 2, 100)]
    four = [(t, c, c, 100) for t in (6, 7, 8, 9) for c in (3, 4)]
    made = spark.createDataFrame((one + four) * 10, "token long, class long, group long, size long").repartition(5)
    assert sorted(map(tuple, opened(made, 85).collect())) == [(3, 4, 100), (4, 3, 100)]


def test_slots_grow_with_the_corpus(spark):
    """A token in 40 classes is frequent however large the corpus is: with slots of a fixed number it was rare from 2^27 tokens or so on."""
    import numpy as np

    from lodestone.llm import jaccard_join as jj

    assert [jj.slot_bits(n) for n in (0, 1 << 29, 1 << 30, 1 << 31, 1 << 40)] == [24, 25, 26, 27, 27]
    common = " ".join(f"c{k}" for k in range(8))
    docs = spark.createDataFrame([(k, f"{common} " + " ".join(f"r{k}x{j}" for j in range(30))) for k in range(40)], "doc_id long, text string").repartition(3)
    rows = jj.keyed(docs)
    shared = jj.shingle_set(common, 4)
    for bits in (24, 26):
        packed = jj.frequent_slots(jj.sets_of(rows, 4, bits), bits)
        slots = np.flatnonzero(np.unpackbits(packed))
        assert len(packed) == 1 << bits - 3 and sorted(slots) == sorted(np.unique(jj.slot_of(shared, bits)))
        prefixes = jj.prefix_rows(rows, packed, 4, 85)
        assert prefixes.count() and not {r.token for r in prefixes.select("token").distinct().collect()} & set(shared.view(np.int64).tolist())
