"""Each stage of the pipeline against a plain version, on the documents as they are given."""

import hashlib
import re
from collections import defaultdict

import public_tokenizers
import pytest
from test_toxicity_plain import plain_features, plain_score
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lodestone.llm.common import table
from lodestone.llm.queries import SQL
from lodestone.llm.toxicity import learn

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_toxicity_drops_what_the_model_calls_toxic(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest table has too few labels for a lexicon
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    out = cp.toxicity(spark, docs, sf_dir)
    model = learn(docs, table(spark, sf_dir, "labels"))
    want = {k for k, t in texts.items() if plain_score(plain_features(t, model.lexicon), model) < 0.5}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want and 0 < len(want) < len(texts)


def test_line_dedup_leaves_what_the_sql_leaves(spark, sf_dir, docs, duck):
    out = cp.line_dedup(spark, docs, sf_dir)
    want = {r[0]: r[1:] for r in duck.execute(f"SELECT doc_id, kept_sha256, kept_chars, n_removed FROM ({SQL['op2_line_dedup']})").fetchall()}
    rows = out.collect()
    assert out.columns == docs.columns and len(rows) == len(want) and any(v[2] for v in want.values())
    assert all((hashlib.sha256((r.text or "").encode()).hexdigest(), r.n_chars) == want[r.doc_id][:2] for r in rows)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_decontamination_cuts_passages_and_drops_copies(spark, sf_dir, docs, texts):
    windows = defaultdict(set)
    for r in table(spark, sf_dir, "benchmark").collect():
        words = WORD.findall(lowered(r.text or ""))
        for k in range(max(1, len(words) - 9) if words else 0):
            windows[min(10, len(words))].add(tuple(words[k : k + 10]))
    want = {}
    for k, text in texts.items():
        spans = [m.span() for m in WORD.finditer(lowered(text))]
        words = [lowered(text)[a:b] for a, b in spans]
        hit = set()
        for n, known in windows.items():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in known:
                    hit |= set(range(i, i + n))
        if hit and len(hit) >= 0.5 * len(words):
            continue
        for a in sorted((i for i in hit if i - 1 not in hit), reverse=True):
            e = next(j for j in range(a, len(words)) if j + 1 not in hit)
            text = text[: spans[a][0]] + text[spans[e][1] :]
        want[k] = text
    out = cp.decontamination(spark, docs, sf_dir)
    got = {r.doc_id: r.text or "" for r in out.collect()}
    bare = lambda t: "".join(t.split())
    assert out.columns == docs.columns and {k: bare(v) for k, v in got.items()} == {k: bare(v) for k, v in want.items()}
    assert any(want[k] != texts[k] for k in want)


def test_packing_holds_every_token_once(spark, sf_dir, docs, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in cp.packing(spark, docs, sf_dir).collect():
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, text in texts.items():
        n = len(library.encode(text, add_special_tokens=False).ids) + 1
        assert [s for s, _ in sorted(pieces[k])] == [sum(m for _, m in sorted(pieces[k])[:i]) for i in range(len(pieces[k]))] and sum(m for _, m in pieces[k]) == n
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(m for _, m in own[:i]) for i in range(len(own))] and sum(m for _, m in own) <= 2048
