"""Fill-in-middle examples: texts cut at unit boundaries into prefix, middle and suffix.

A unit grammar is a set of pairs of character classes; a unit ends wherever a character of
the first class stands before one of the second. boundary() turns it into a regular
expression of look-behind and look-ahead alone, at which split() takes nothing away, so the
pieces of a text are its units. As a boundary is told by its two neighbours, a text is split
in slices of SLICE code points, each with the last one of the slice before it; the pieces of
a text are never held all at once.

Edge cases: a null or empty text has no units and stays plain, and so do texts that hold a
control string themselves; a null doc_id hashes as an empty one; equal rows give equal rows;
an empty table gives no rows; columns of other names are kept, one named as `into` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sums, text_or_empty

ANY = "."  # line ends too, by the flag that boundary() sets
#: Classes before and after a boundary. The one before tells ASCII apart from the rest only.
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    "char": ((ANY, ANY),),
    "word": ((r"\s", r"\S"),),
    "line": ((r"\n", ANY),),
    "sentence": (("[.!?]", r"\s"), (r"\n", ANY)),
    "symbol": ((r"\w", r"\W"), (r"\W", r"\w")),
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE = 256


def boundary(grammar: str) -> str:
    """The places between units as a zero-width expression; never inside a character of two code units."""
    return "(?s)(?:" + "|".join(f"(?<={a})(?={b})" for a, b in GRAMMARS[grammar]) + r")(?!\p{Cs})"


def units(text: Column, grammar: str) -> Column:
    """The units of a text; none of an empty one, which split() would give back as a piece."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, *, grammar: str = "char", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, into: str = "fim") -> DataFrame:
    """docs with a struct of n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output.

    The two cuts fall after any number of units from 0 to n, each as likely as the others.
    """
    places = boundary(grammar)
    name = lambda c: f"_fim_{c}"
    col = lambda c: F.col(name(c))

    def joined(k: Column) -> Column:
        """Slice k (from 0) after the last character of the one before it."""
        return F.concat(F.coalesce(F.right(F.get(col("slices"), k - 1), F.lit(1)), F.lit("")), F.get(col("slices"), k))

    def chars_of(u: Column) -> Column:
        """Code points in the first u units."""
        k = F.size(F.filter(col("before"), lambda x: x < u)) - 1
        inside = F.length(F.array_join(F.slice(F.split(joined(k), places, -1), 1, (u - F.get(col("before"), k)).cast("int")), ""))
        return F.when(u == 0, 0).when(u == col("n"), F.length(col("text"))).otherwise(k * SLICE + inside - F.when(k > 0, 1).otherwise(0)).cast("long")

    rows = docs.withColumns({name("text"): text_or_empty(), name("draws"): F.array(*draws(F.col("doc_id"), seed))})
    rows = rows.withColumn(name("slices"), F.regexp_extract_all(col("text"), F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0)))
    rows = rows.withColumn(name("counts"), F.transform(col("slices"), lambda s, k: F.size(F.split(joined(k), places, -1)) - 1))
    rows = rows.withColumn(name("before"), F.slice(running_sums(col("counts")), 1, F.greatest(F.size(col("counts")), F.lit(1))))
    rows = rows.withColumn(name("n"), F.when(col("text") == "", 0).otherwise(1 + F.aggregate(col("counts"), F.lit(0), lambda s, x: s + x)).cast("long"))
    h = lambda k: F.get(col("draws"), F.lit(k))
    at = [h(k) % (col("n") + 1) for k in (0, 1)]
    held = [F.contains(col("text"), F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (col("text") == "") | held[0] | held[1] | held[2] | (h(2) % 100 >= 100 - plain_percent)
    rows = rows.withColumn(name("form"), F.when(plain, "plain").when(h(3) % 100 < spm_percent, "spm").otherwise("psm"))
    some = lambda c: F.when(col("form") != "plain", c)
    rows = rows.withColumns({name("a"): some(chars_of(F.least(*at))), name("b"): some(chars_of(F.greatest(*at)))})
    piece = lambda start, n: F.substr(col("text"), (start + 1).cast("int"), n.cast("int"))
    prefix, middle, suffix = piece(F.lit(0), col("a")), piece(col("a"), col("b") - col("a")), piece(col("b"), F.length(col("text")) - col("b"))
    output = (
        F.when(col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(col("text"))
    )
    made = F.struct(col("n").alias("n"), col("form").alias("form"), col("a").alias("prefix_chars"), (col("b") - col("a")).alias("middle_chars"), output.alias("output"))
    return rows.withColumn(into, made).drop(*(c for c in rows.columns if c.startswith("_fim_")))


def restored(output: Column, form: Column) -> Column:
    """The text again. Texts with control strings are plain, so each of the others holds each of them once."""
    first, second = F.split_part(output, F.lit(MIDDLE), F.lit(1)), F.split_part(output, F.lit(MIDDLE), F.lit(2))
    half = lambda mark, n: F.split_part(F.substr(first, F.lit(len(PREFIX) + 1)), F.lit(mark), F.lit(n))
    return F.when(form == "psm", F.concat(half(SUFFIX, 1), second, half(SUFFIX, 2))).when(form == "spm", F.concat(half(PREFIX, 2), second, half(PREFIX, 1))).otherwise(output)


def fim_digest(made: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    one = F.col("fim")
    return made.select("doc_id", *(one[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")), sha(one["output"]).alias("output_sha256"), sha(restored(one["output"], one["form"])).alias("restored_sha256"))
