"""What the operators left out before: each test fails on the code of the first round."""

import random

import pytest


def brute_passages(texts, least):
    """Lines that some stretch of equal lines with enough words holds, of which an earlier place has an equal one."""
    import re

    lines = [[x for x in re.split(r"(?<=\n)|(?<=[.!?] )", t) if x] for t in texts]
    worded = [[k for k, x in enumerate(d) if x.strip()] for d in lines]
    seen, gone = set(), [set() for _ in texts]
    for d, at in enumerate(worded):
        for a in range(len(at)):
            for b in range(a, len(at)):
                part = tuple(lines[d][k].strip(" \n\r\t") for k in at[a : b + 1])
                if sum(len(x.split()) for x in part) >= least:
                    if part in seen:
                        gone[d] |= set(range(at[a], at[b] + 1))
                    seen.add(part)
    return ["".join(x for k, x in enumerate(d) if k not in g) for d, g in zip(lines, gone, strict=True)]


def test_passages_of_any_number_of_lines(spark):
    from lodestone.llm.line_dedup import dedup_lines

    rng = random.Random(3)
    pool = [" ".join(f"{w}{rng.randrange(99)}" for w in "abcdefghij"[: rng.randrange(1, 10)]) + rng.choice([". ", "\n", "! "]) for _ in range(12)]
    texts = ["".join(rng.choice([*pool, "\n"]) for _ in range(rng.randrange(25))) for _ in range(25)]
    one = " ".join(f"w{k}" for k in range(60)) + ". "
    texts += [one + "Own end one", "Another start. " + one + "other end", one + "Own end one", " ".join(f"v{k}" for k in range(45)), " ".join(f"v{k}" for k in range(45))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for least in (12, 40):
        got = {r.doc_id: r.text for r in dedup_lines(docs, least_words=least).collect()}
        assert [got[k] for k in range(len(texts))] == brute_passages(texts, least)
    assert (got[26], got[29]) == ("Another start. other end", "")


def test_near_copies_of_the_pipeline_share_four_fifths(spark, sf_dir):
    from corpus_pipeline import near_copies

    words = [f"w{k}" for k in range(50)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:25], "other", *words[26:]])), (3, " ".join([*words[:15], "one", *words[16:35], "two", *words[36:]]))]
    five = lambda t: {tuple(t.split()[k : k + 5]) for k in range(46)}
    assert len(five(rows[0][1]) & five(rows[1][1])) / len(five(rows[0][1]) | five(rows[1][1])) == pytest.approx(41 / 51)
    assert sorted(r.doc_id for r in near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()) == [1, 3]


def test_a_value_all_over_one_source_is_not_live(spark):
    from lodestone.llm.secret_scan import secret_scan

    copied, own = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8", "Zk3vQ9x81LmN0pRs7TuVwXyZ"
    rows = [(k, f"see {copied} here {k}", "hot") for k in range(40)] + [(50, f"token={copied}", "hot"), (60, f"mine {own}", "hot"), (61, "none", "hot")]
    got = {r.doc_id: r for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].spans == "" and (got[0].n_live, got[0].n_repositories) == (0, 41)
    assert got[50].spans.startswith("assign:") and (got[50].n_live, got[50].n_shared) == (0, 1)
    assert (got[60].spans, got[60].n_repositories, got[61].n_repositories) == ("live:5:29", 1, 0)


def test_media_inside_media(spark):
    import io
    import zipfile

    from lodestone.llm.media import carve, sniff, sniff_media, to_bmp, to_png, to_wav

    png = to_png(bytes(192))
    inner = to_bmp(png.ljust(384))
    outer = to_wav(b"ab" + inner + b"cd")
    want = [(0, len(outer), "audio/wav", None), (46, len(inner), "image/bmp", 0), (100, len(png), "image/png", 46)]
    assert carve(outer) == want and carve(b"?" + outer)[0] == (1, len(outer), "audio/wav", None)
    z, stored = io.BytesIO(), io.BytesIO()
    for into, name, data in ((z, "a", "b"), (stored, "in.zip", None)):
        with zipfile.ZipFile(into, "w") as f:
            f.writestr(name, z.getvalue() if data is None else data)
    whole = stored.getvalue()
    assert sniff(whole) == [(0, len(whole), "application/zip")] and carve(whole)[1][1:] == (len(z.getvalue()), "application/zip", 0)
    body = b"%PDF-1.4\n1 0 obj\nendobj\n"
    pdf = body + b"xref\ntrailer\nstartxref\n%d\n%%%%EOF\n" % len(body)
    updated = pdf + b"2 0 obj\nendobj\nxref\ntrailer\nstartxref\n%d\n%%%%EOF\r\n" % (len(pdf) + 15)
    for data in (pdf, updated, b"%PDF-1.4 startxref 0 %%EOF 1 0 obj endobj startxref 0 %%EOF\n"):
        assert sniff(data) == [(0, len(data), "application/pdf")]
    assert sniff(pdf + updated) == [(0, len(pdf), "application/pdf"), (len(pdf), len(updated), "application/pdf")]
    (row,) = sniff_media(spark.createDataFrame([(bytearray(outer), "image/png")], "media binary, declared_type string")).collect()
    assert (row.true_type, row.corrected) == ("audio/wav", True) and [(e.start, e.length, e.type, e.parent) for e in row.embedded] == want[1:]


def test_texts_that_share_an_id_are_all_compared(spark):
    from lodestone.llm.jaccard_join import jaccard_components, jaccard_digest

    def text(name, *places):
        return " ".join(f"{name}{k}" + f" edit{k}" * (k in places) for k in range(120))

    # two edits apart is similar, four is not: a chain of which the two in the middle share an id, or have none
    rows = []
    for n in range(16):
        chain = [text(f"n{n}x", 10, 30, 50, 70), text(f"n{n}x", 10, 30), text(f"n{n}x"), text(f"n{n}x", 90, 110)]
        middle = None if n % 2 else n
        rows += list(zip((1000 + n, middle, middle, 2000 + n), chain, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (512, 7):
        got = [(r.doc_id, r.component_id) for r in jaccard_digest(jaccard_components(docs, block_classes=block)).collect()]
        assert len(got) == len(rows)
        for n in range(16):
            assert {c for d, c in got if d in (1000 + n, 2000 + n)} == {None if n % 2 else n}
