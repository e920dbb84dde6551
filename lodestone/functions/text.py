"""Text functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never indexed.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with",
)

# The keywords of the default domain filter.
DOMAIN_KEYWORDS = (
    "india", "indian", "bharat", "hindustan", "modi", "gandhi", "nehru", "kalam", "vajpayee", "ashoka", "maurya", "gupta empire", "mughal", "chola", "maratha", "delhi",
    "mumbai", "bombay", "kolkata", "calcutta", "chennai", "madras", "bangalore", "bengaluru", "isro", "bollywood", "hinduism", "buddhism", "jainism", "sikhism", "vedic",
    "harappa", "mohenjo-daro", "indus valley", "east india company", "british raj", "mahabharata", "ramayana", "sanskrit", "hindi", "tamil", "telugu",
)

# Patterns of markup in the order in which they go, and what takes their place.
MARKUP = (
    (r"(?s)\{\{.*?\}\}", " "),
    (r"(?s)<ref.*?>.*?</ref>", " "),
    (r"(?d)<.*?>", " "),
    (r"http\S+", " "),
    (r"(?d)\[\[.*?\|(.*?)\]\]", "$1"),
    (r"(?d)\[\[(.*?)\]\]", "$1"),
    (r"(?d)={2,}.*?={2,}", " "),
    (r"[^\p{Alnum}\s]", " "),  # ASCII; written with ranges it takes twelve times as long
    (r"\s+", " "),
)

#: What the last two patterns of markup do, one after the other, in one: signs and white space become one blank.
SIGNS = r"\P{Alnum}+"

# Patterns of white space to be made plain.
WHITESPACE = (
    (r"\t", " "),
    (r"[\u00a0\u2000-\u200b\ufeff]", " "),
    (r" +", " "),
    (r"(?U)[\s&&[^\n]]+(?=\n|\z)", ""),
    (r"\n{3,}", "\n\n"),
    (r"(?U)^\s+|\s+\z", ""),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replaced(c: Column, steps: tuple) -> Column:
    return reduce(lambda x, step: F.regexp_replace(x, step[0], step[1]), steps, F.coalesce(c, F.lit("")))


def clean_text(c: Column | str) -> Column:
    """Plain words without wiki markup, tags, addresses and signs; null becomes empty. Texts without any mark of markup are spared its patterns."""
    plain = F.coalesce(col(c), F.lit(""))
    marked = reduce(lambda a, b: a | b, (F.contains(plain, F.lit(m)) for m in ("{{", "<", "http", "[[", "==")))
    bare = F.when(marked, replaced(plain, MARKUP[:-2])).otherwise(plain)
    return F.trim(F.regexp_replace(bare, SIGNS, " "))


def normalize_text(c: Column | str) -> Column:
    """White space made plain: no tabs or odd spaces, no trailing space, at most one empty line."""
    return replaced(col(c), WHITESPACE)


def tokenize(c: Column | str, gap: str = r"\s+") -> Column:
    """Lower-case words between white space without the stop words."""
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), gap), lambda t: ~t.isin("", *STOPWORDS))


def parse_query(c: Column | str) -> Column:
    return tokenize(clean_text(c), " ")  # clean words have one blank between them


def count_tokens(c: Column | str) -> Column:
    """Estimated model tokens: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(col(c)) / 4).cast("bigint"))


def chunk_text(c: Column | str, max_tokens: int = 512, overlap: int = 64, separator: str = r"\n\s*\n") -> Column:
    """Chunks of whole paragraphs of up to max_tokens tokens.

    A full chunk is closed and the next one begins with the last paragraphs of up to
    overlap tokens. A paragraph longer than a chunk stays in one piece.
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), separator), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+\z", "")), lambda p: p != "")
    tokens = lambda p: F.greatest(F.lit(1), F.floor(F.length(p) / 4).cast("int"))
    none = F.array().cast("array<string>")

    def carried(held: Column) -> Column:
        """The last paragraphs whose tokens together stay within the overlap."""
        back = F.aggregate(
            F.reverse(held),
            F.struct(none.alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open")),
            lambda a, p: F.struct(
                F.when(a["open"] & (a["n"] + tokens(p) <= overlap), F.concat(F.array(p), a["kept"])).otherwise(a["kept"]).alias("kept"),
                F.when(a["open"] & (a["n"] + tokens(p) <= overlap), a["n"] + tokens(p)).otherwise(a["n"]).alias("n"),
                (a["open"] & (a["n"] + tokens(p) <= overlap)).alias("open"),
            ),
        )
        return back

    def step(a: Column, p: Column) -> Column:
        full = (a["n"] + tokens(p) > max_tokens) & (F.size(a["held"]) > 0)
        rest = carried(a["held"])
        return F.struct(
            F.when(full, F.concat(a["out"], F.array(F.array_join(a["held"], "\n\n")))).otherwise(a["out"]).alias("out"),
            F.when(full, F.concat(rest["kept"], F.array(p))).otherwise(F.concat(a["held"], F.array(p))).alias("held"),
            F.when(full, rest["n"] + tokens(p)).otherwise(a["n"] + tokens(p)).alias("n"),
        )

    start = F.struct(none.alias("out"), none.alias("held"), F.lit(0).alias("n"))
    return F.aggregate(paragraphs, start, step, lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["out"], F.array(F.array_join(a["held"], "\n\n")))).otherwise(a["out"]))


def snippet(c: Column | str, query: str, length: int = 180) -> Column:
    """Text around the first query word that occurs, in the order of the query."""
    text, half = F.replace(F.coalesce(col(c), F.lit("")), F.lit("\n"), F.lit(" ")), length // 2
    n = F.length(text)
    out = F.concat(F.substring(text, 1, length), F.lit("..."))
    for word in reversed(query.lower().split()):
        at = F.instr(F.lower(text), word) - 1
        start, end = F.greatest(at - half, F.lit(0)), F.least(at + half, n)
        cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < n, "...").otherwise(""))
        out = F.when(at >= 0, cut).otherwise(out)
    return out


def in_domain(title: Column | str, text: Column | str, keywords: tuple[str, ...] = DOMAIN_KEYWORDS) -> Column:
    """Whether title or text holds any of the keywords, without regard to case."""
    lowered = F.concat_ws("\n", F.lower(col(title)), F.lower(col(text)))
    return F.rlike(lowered, F.lit("|".join(re.escape(k) for k in keywords)))


def words_of(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def text_overlap(a: Column | str, b: Column | str) -> Column:
    """Common words as a share of the larger word set; 0 if either is empty."""
    x, y = words_of(col(a)), words_of(col(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)).cast("double"))


def format_chunk(text: Column, section: Column, before: Column, after: Column) -> Column:
    """A chunk with its section and what stands around it, empty parts left out."""
    some = lambda x, y: F.when(F.coalesce(x, F.lit("")) != "", y)
    return F.concat_ws(
        "\n",
        some(section, F.concat(F.lit("[Section: "), section, F.lit("]"))),
        some(before, F.concat(F.lit("(Context before: "), F.substring(before, 1, 200), F.lit(")"))),
        some(text, text),
        some(after, F.concat(F.lit("(Context after: "), F.substring(after, 1, 200), F.lit(")"))),
    )


def repair_json(c: Column | str, schema: str) -> Column:
    """The object in a model's answer: code fences go, then it is parsed; null if it can't be."""
    bare = F.regexp_replace(F.trim(col(c)), r"(?s)^```(?:json)?\s*|\s*```$", "")
    return F.from_json(bare, schema, {"mode": "PERMISSIVE"})


def page_url(prefix: str, title: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.replace(col(title), F.lit(" "), F.lit("_")))


def chunk_id(document_id: Column | str, index: Column | str) -> Column:
    return F.concat_ws("_", col(document_id).cast("string"), col(index).cast("string"))


def first_line(c: Column | str) -> Column:
    return F.substring_index(F.coalesce(col(c), F.lit("")), "\n", 1)
