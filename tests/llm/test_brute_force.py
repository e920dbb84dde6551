"""The operators against plain versions of their definitions, on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from lodestone.llm.jaccard_join import links_of
from lodestone.llm.media import SIGNATURES, VALIDATORS, sniff, to_bmp, to_png, to_wav
from lodestone.llm.packing import first_fit_decreasing
from lodestone.llm.queries import QUERIES, SQL
from lodestone.llm.suffix_array import suffix_array
from lodestone.llm.suffix_dedup import continuations, padded, suffix_dedup, suffix_digest
from lodestone.llm.token_counts import count_tokens
from lodestone.llm.wordbpe import WordBpe

BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.mark.parametrize("name", SQL)
def test_rows_match_sql(name, agrees):
    agrees(QUERIES[name], SQL[name])


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    rows = QUERIES["op1_toxicity"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    rank, y = rows["score"].rank().to_numpy(), rows["toxic"].to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.95 and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()


def test_token_counts(spark, sf_dir, texts, library):
    for r in QUERIES["op3_token_counts"](spark, sf_dir).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


ODD_TEXTS = ["don't <|endoftext|> stop " * 40, "a" * 3000, "é e\u0301 İ ß ǅ " * 90, "x" * 70 + " " + "y" * 900, "1234567890" * 50, "\u2003wide\u3000spaces\xa0here " * 60, "!!'s ''ll _a_ " * 80]


@pytest.mark.parametrize("text", ODD_TEXTS)
@pytest.mark.parametrize("chunk,overlap", [(64, 8), (200, 30), (1000, 100)])
def test_splicing_gives_the_whole_encoding(text, chunk, overlap, library):
    assert count_tokens(WordBpe(BPE), text, chunk, overlap) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [*ODD_TEXTS, "".join(map(chr, range(0x21, 0x250))), " ".join(map(chr, range(0x21, 0x250)))])
def test_word_memory_equals_the_library(text, library):
    assert WordBpe(BPE).ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_suffix_array_is_the_sorted_order():
    rng = np.random.default_rng(1)
    for _ in range(500):
        s = [*rng.integers(1, 1 + rng.integers(1, 5), rng.integers(0, 40)).tolist(), 0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_dedup(texts, length):
    raws = [t.encode() for t in texts]
    count = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    for r in raws:
        hit = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - length + 1):
            if count[r[k : k + length]] > 1:
                hit[k : k + length] = True
        spans = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        kept = bytes(b for b, h in zip(r, hit, strict=False) if not h)
        yield len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def test_suffix_dedup(spark):
    rng = np.random.default_rng(5)
    passage = bytes(rng.integers(97, 123, 260).tolist()).decode()
    texts = [
        passage + "tail one", "x" * 3 + passage, passage[:199], passage[30:229], passage[30:230] + "q", "ab" * 400, "z" * 500, "é" * 150, "short", "",
        *("head %d " % k + passage[:180] + " %d" % (k * 7919) for k in range(40)), passage[:150] + passage, "w" * 90 + passage[100:] + "w" * 90,
    ]
    want = list(brute_dedup(texts, 200))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for many in (2000, 5):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_digest(suffix_dedup(docs, many_anchors=many)).collect()}
        assert [got[k] for k in range(len(texts))] == want


def test_continuations_stand_in_the_order_of_their_bytes():
    rng = np.random.default_rng(2)
    for _ in range(100):
        m, most = int(rng.integers(1, 40)), int(rng.choice([1, 7, 8, 9, 30, 99]))
        name, after = rng.integers(0, 3, m), [bytes(rng.integers(97, 99, rng.integers(0, most + 1)).tolist()) for _ in range(m)]
        order = continuations(name, padded(after, most), np.array([len(b) for b in after], np.int64))
        assert sorted(order.tolist()) == list(range(m))
        assert [(name[k], after[k]) for k in order] == sorted((name[k], after[k]) for k in range(m))


def test_periods_in_many_documents_are_settled_before_keys_are_dealt(spark):
    from lodestone.llm.common import byte_batches, keyed
    from lodestone.llm.suffix_dedup import anchor_keys

    texts = ["%d " % k + "ab " * (100 + k % 7) + "end %d" % k for k in range(60)] + ["xyz " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    byte_batches(spark)
    anchors = anchor_keys(keyed(docs), 200).collect()
    left = Counter(r.key for r in anchors if r.packed >= 0)
    assert len(anchors) > 2000 and max(left.values()) * 10 < len(anchors)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_digest(suffix_dedup(docs)).collect()}
    assert [got[k] for k in range(len(texts))] == list(brute_dedup(texts, 200))


def test_suffix_dedup_of_the_table(spark, sf_dir, texts):
    ids = sorted(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op4_suffix_dedup"](spark, sf_dir).collect()}
    assert [got[i] for i in ids] == list(brute_dedup([texts[i] for i in ids], 200))


def test_decontamination_in_blocks_is_the_same(spark, sf_dir):
    from lodestone.llm.decontamination import contamination, contamination_digest

    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = contamination_digest(contamination(docs.select("doc_id", "text"), items)).collect()
    parts = contamination_digest(contamination(docs.select("doc_id", "text"), items, block_windows=500)).collect()
    assert sorted(whole) == sorted(parts) and any(r.contaminated for r in whole)
    clashing = docs.withColumns({c: F.lit("x") for c in ("_n", "_runs", "_items", "runs", "items", "n_words", "_contamination_id")})
    cut = {b: sorted((r.doc_id, r.text) for r in contamination(clashing, items, block_windows=b, cut_spans=True).collect()) for b in (500, 10**9)}
    assert cut[500] == cut[10**9]


def test_packing(spark, sf_dir, texts, library):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in QUERIES["op6_packing"](spark, sf_dir).collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for rows in bins.values() for r in rows) > 0.9 * 2048 * (len(bins) - 1)


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(2)
    lengths = sorted(rng.integers(1, 101, 300).tolist(), reverse=True)
    room, want = [], []
    for n in lengths:
        k = next((k for k, r in enumerate(room) if r >= n), len(room))
        room += [100] * (k == len(room))
        want.append((k, 100 - room[k]))
        room[k] -= n
    assert first_fit_decreasing(lengths, 100) == want


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_secrets(spark, sf_dir, texts):
    from lodestone.llm.secret_scan import secret_scan

    odd = {-1: 'Api_Key": "abcdefghijkl" é token:secret:abcdefghijklmn PASSWORD=short token=x token=token=abcdefghijklmnop', -2: "AKIAAKIA" + "B2" * 10 + "\U0001f600 " + "0123456789abcdef" * 3, -3: "passwordpassword = 'aaaa.bbbb=cc+/'secret='zzzzzzzzzzzz"}
    got = QUERIES["op7_secret_scan"](spark, sf_dir).collect()
    got += secret_scan(spark.createDataFrame([(k, v, "s") for k, v in odd.items()], "doc_id long, text string, source string")).collect()
    for r in got:
        want = base_spans((texts | odd)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("live")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))


def test_ownership_tells_examples_from_live_values(spark):
    from lodestone.llm.secret_scan import secret_scan

    own, copied = "Zk3vQ9x81LmN0pRs7TuVwXyZ", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8"
    rows = [(k, f"see {copied} here", f"s{k}") for k in range(5)] + [(9, f"mine {own}", "s9"), (10, f"again {own}", "s9")]
    got = {r.doc_id: r for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].spans == "" and got[9].spans == "live:5:29" and got[10].n_live == 1


def shingles(text):
    w = text.encode().lower().split()
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def test_jaccard_components(spark, sf_dir, texts):
    from lodestone.llm.jaccard_join import jaccard_components, jaccard_digest

    base = [f"t{k}" for k in range(120)]
    texts = dict(texts) | {10_000 + k: " ".join([*base[:k], "edit%d" % k, *base[k:]]) for k in range(0, 120, 4)} | {20_000 + k: " ".join(base[: 60 + 2 * k]) for k in range(30)}
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for block in (512, 7):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_digest(jaccard_components(docs, block_classes=block)).collect()}
        assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_links_join_what_links():
    sets = [np.unique(np.array(x, np.uint64)) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [9], [1, 2, 3])]
    assert {tuple(sorted(p)) for p in links_of(sets, 75)} == {(0, 1), (0, 3)}


def test_chat(spark, sf_dir):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in QUERIES["op9_chat_formatting"](spark, sf_dir).collect()}
    assert set(got) == set(turns)
    for conv, rows in turns.items():
        rows.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in rows)
        loss = "".join(text for _, role, text in rows if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(rows), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("text", ["\\", "<|", "\\<|im_end|>\n", "a\\|b<\\|c", "<<||>>\\\\", "é<|\U0001f600"])
def test_chat_escapes_are_reversible(text, spark):
    from lodestone.llm.chat_format import chat_digest, chat_examples

    rows = [(1, 0, text + "\nx", text), (1, 1, "assistant", text)]
    r = chat_digest(chat_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert r.turns_sha256 == hashlib.sha256(f"{text}\nx\n{text}\nassistant\n{text}\n".encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_media(spark, sf_dir, texts):
    for r in QUERIES["op10_media_columns"](spark, sf_dir).collect():
        raw = texts[r.doc_id].encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert "corrected=1" in r.feature


def test_sniffing_confirms_and_carves():
    payload = bytes(range(192))
    for make in (to_wav, to_bmp, to_png):
        media = make(payload)
        ((start, length, kind),) = sniff(b"junk" + media + b"tail")
        assert (start, length) == (4, len(media)) and sniff(media)[0][2] == kind
        assert not [f for f in sniff(media[:-1]) if f[2] == kind]
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\0\x3b"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02xyz\xff\xd9"
    pdf = b"%PDF-1.4 startxref 0 %%EOF"
    for media, kind in ((z.getvalue(), "application/zip"), (gzip.compress(b"abc"), "application/gzip"), (gif, "image/gif"), (jpeg, "image/jpeg"), (pdf, "application/pdf")):
        assert sniff(b"??" + media) == [(2, len(media), kind)]
    assert sniff(b"RIFF BM GIF89a PK\x03\x04 %PDF- no media") == [] and set(SIGNATURES.values()) == set(VALIDATORS)


def test_pipeline(spark, sf_dir):
    from corpus_pipeline import run

    out = run(spark, sf_dir)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    all_ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert ids <= all_ids and len(ids) > 0.6 * len(all_ids)


def test_isotonic_pools_ties():
    from lodestone.llm.toxicity import isotonic

    x, p = isotonic(np.array([0.0, 0, 0, 0, 1, 2]), np.array([0.0, 1, 0, 0, 0, 1]))
    assert np.allclose(np.interp([0, 1, 2], x, p), [0.2, 0.2 + 0.8 * 0.8 / 1.8, 1], atol=0.2) and p.min() == 0.2
