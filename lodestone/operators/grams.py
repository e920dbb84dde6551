"""Substring joins by grams: which texts hold which words anywhere, without comparing all of them.

A text is indexed by its distinct substrings of one, two and GRAM characters. A word is looked up
by one of its own grams, the one that the fewest texts have (itself, if it is shorter), and what
that finds is verified. For a few words (`few` of them or less) long texts need no index: each is
searched for each word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams_of(text: Column, n: int) -> Column:
    """The distinct substrings of n characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def substring_pairs(texts: DataFrame, text: str, words: DataFrame, word: str, *, few: int = 0) -> DataFrame:
    """Rows of texts with each distinct word of words that occurs in their text; nulls and empty words are in none."""
    own = words.where(F.coalesce(F.col(word), F.lit("")) != "").select(F.col(word).alias("_word")).distinct()
    words_here = [r[0] for r in own.limit(few + 1).collect()] if few else []
    if few and len(words_here) <= few:
        asked = F.array(*map(F.lit, words_here)).cast("array<string>")
        holds = lambda w: F.contains(F.col(text), w)
        # the test goes down to the scan, so texts without a word are not shuffled by what comes before
        return texts.where(F.exists(asked, holds)).select("*", F.explode(F.filter(asked, holds)).alias(word))
    short = F.length("_word") < GRAM
    asked = own.select("_word", F.explode(F.when(short, F.array("_word")).otherwise(grams_of(F.col("_word"), GRAM))).alias("_gram"))
    index = texts.select("*", F.explode(F.concat(*(grams_of(F.col(text), n) for n in range(1, GRAM + 1)))).alias("_gram"))
    counts = index.select("_gram").join(asked.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    keys = asked.join(counts, "_gram", "left").groupBy("_word").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    return index.join(keys, "_gram").where(F.contains(F.col(text), F.col("_word"))).drop("_gram").withColumnRenamed("_word", word)
