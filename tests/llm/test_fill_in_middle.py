"""Fill-in-middle: pieces of every grammar, cuts against a plain loop, texts restored."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm.fill_in_middle import GRAMMARS, SLICE, boundary, fill_in_middle, fim_digest, restored, units
from lodestone.llm.queries import QUERIES, SQL

#: The same boundaries, written as a test of the two characters around a place.
STARTS = {
    "char": lambda a, b: True,
    "word": lambda a, b: bool(re.match(r"[ \t\n\x0b\f\r]", a)) and not re.match(r"[ \t\n\x0b\f\r]", b),
    "line": lambda a, b: a == "\n",
    "sentence": lambda a, b: (a in ".!?" and b in " \t\n\x0b\f\r") or a == "\n",
    "symbol": lambda a, b: (re.match(r"[A-Za-z0-9_]", a) is None) != (re.match(r"[A-Za-z0-9_]", b) is None),
}
TEXTS = ["", "a", "\U0001f600", "a\U0001f600é\n b", " \n\n\t", "One. Two!  three?\nfour\r\nfive", "<P", "x<P>y", "<<S", "<M>", "\U0001f600" * (2 * SLICE + 3), "ab cd.\n" * SLICE, "w" * (SLICE - 1) + " " * 3 + "v" * SLICE, None]


def cut(text, grammar):
    starts = [0, *(k for k in range(1, len(text)) if STARTS[grammar](text[k - 1], text[k]))]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)] if text else []


def plainly(doc_id, text, grammar="char", seed=1, plain=10, spm=20):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    pieces = cut(text, grammar)
    n = len(pieces)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (pieces[:a], pieces[a:b], pieces[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 7 else None, t, "clash") for k in range(12) for t in TEXTS]
    return spark.createDataFrame([(None if i is None else 1000 * k + i, t, x) for k, (i, t, x) in enumerate(rows)], "doc_id long, text string, n string")


@pytest.mark.parametrize("grammar", GRAMMARS)
def test_pieces_of_every_grammar(grammar, spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "text string").select("text", units(F.col("text"), grammar).alias("u")).collect()
    assert all(list(r.u) == cut(r.text, grammar) for r in rows)
    assert all("".join(r.u) == r.text for r in rows)
    assert "(?<=" in boundary(grammar) and "(?=" in boundary(grammar)


@pytest.mark.parametrize("grammar", GRAMMARS)
def test_cuts_and_outputs_equal_a_plain_loop(grammar, docs):
    made = fill_in_middle(docs, grammar=grammar, plain_percent=5, spm_percent=50)
    assert made.columns == [*docs.columns, "fim"]
    forms = set()
    for r in made.withColumn("back", restored(F.col("fim.output"), F.col("fim.form"))).collect():
        assert tuple(r.fim) == plainly(r.doc_id, r.text, grammar, 1, 5, 50)
        assert r.back == (r.text or "")
        forms.add(r.fim.form)
    assert forms == {"plain", "psm", "spm"}


def test_repeated_rows_and_an_empty_table(spark):
    one = spark.createDataFrame([(5, "some text here")] * 3, "doc_id long, text string")
    assert fim_digest(fill_in_middle(one)).distinct().count() == 1 and fim_digest(fill_in_middle(one)).count() == 3
    assert fim_digest(fill_in_middle(one.limit(0))).count() == 0


def test_query_equals_sql(agrees):
    agrees(QUERIES["op13_fill_in_middle"], SQL["op13_fill_in_middle"])
