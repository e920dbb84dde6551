"""Line dedup by winnowing over line hashes, in SQL functions only.

A text is cut after every line feed, and long lines after every sentence end too; each
part is a line here and is compared without the white space around it. Lines without
words are left out before lines are compared, and go where they lie inside a run.

The window of a line is the shortest stretch from it on with least_words words or more,
and the least line hash in it (of equal ones the first) is the fingerprint that it
selects. Two places that share least_words words in equal lines share a whole window,
and so the fingerprint: that is the guarantee, be the passage one line or many.

Positions are joined by fingerprint. Of those that agree in all lines around it, those of
its windows and those after them up to the end of the next one, all but the first, in
order of document and position, match the first. The first ones of a fingerprint that
differ in such lines are compared window by window, and a window of which an equal one
stands earlier is a match; fingerprints with lines of one kind alone have no more. Equal lines are told by two
independent 64-bit hashes of their line hashes. Matches grow line by line: to the
left a window that starts one line earlier is a match itself, and so is the next one to
the right; what can lie beyond the last window of a match, the lines before the end of
the window that does not match any more, is extended by hashes of the window and the
lines after it. A line goes if and only if a stretch of equal lines with least_words words
or more that holds it has an equal one earlier; the first occurrence stays.

Edge cases: a null or empty text has no lines and stays empty; documents are ordered by
doc_id (null first) and text hash; rows equal in doc_id and text are one document, not
repeats of each other, and each has its row in the result; an empty table gives an empty
result; other columns are kept, but columns named like those that it adds (n_lines, runs)
are replaced. Work and memory for one text grow with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, ROW_KEY, named_rows, running_sums, stored

LEAST_WORDS = 40
#: Where a text is cut; the sign before the place stays with its line.
CUTS = r"(?<=\n)|(?<=[.!?] )"
ENDS = ("\n", ". ", "! ", "? ")
MARK = "\x01"
SPACE = " \n\r\t"
PLACE = [ROW_ID, ROW_KEY]


def marked(text: Column) -> Column:
    for end in ENDS:
        text = F.replace(text, F.lit(end), F.lit(end + MARK))
    return text


def lines_of(text: Column) -> Column:
    """Lines, by marks after their ends; a text that has the mark itself is cut by pattern."""
    parts = F.when(F.contains(text, F.lit(MARK)), F.split(text, CUTS, -1)).otherwise(F.split(marked(text), MARK, -1))
    return F.filter(parts, lambda x: x != "")


def n_lines(text: Column) -> Column:
    """The number of lines without making them, where the text has no mark of its own."""
    ended = F.lit(False)
    for end in ENDS:
        ended = ended | F.endswith(text, F.lit(end))
    counted = F.length(marked(text)) - F.length(text) + F.when(ended | (text == ""), 0).otherwise(1)
    return F.when(F.contains(text, F.lit(MARK)), F.size(lines_of(text))).otherwise(counted)


def by_blanks(line: Column) -> Column:
    """Words of a trimmed line in which single blanks alone stand between words."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def hashed_lines(text: Column) -> Column:
    """(h, w): hash and words of each line that has words."""
    odd = F.contains(text, F.lit("  ")) | F.contains(text, F.lit(MARK))
    for space in "\t\x0b\f\r":
        odd = odd | F.contains(text, F.lit(space))
    of = lambda lines, count: F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), count(x).alias("w")))
    trimmed = F.transform(lines_of(text), lambda x: F.btrim(x, F.lit(SPACE)))
    # where line feeds and blanks are all the white space, marks may stand in place of that which ends a line
    plain = text
    for end in ENDS:
        plain = F.replace(plain, F.lit(end), F.lit(end.rstrip() + MARK))
    bare = F.transform(F.split(plain, MARK, -1), lambda x: F.trim(x))
    return F.filter(F.when(odd, of(trimmed, lambda x: F.regexp_count(x, F.lit(r"\S+")))).otherwise(of(bare, by_blanks)), lambda s: s["w"] > 0)


def windows(docs: DataFrame, least_words: int) -> DataFrame:
    """Key of the document, h: hashes of its lines with words, ends: for each line with a window, the window's last line (from 1)."""
    each = docs.select(*PLACE, hashed_lines(F.col("text")).alias("s"))
    split = each.select(*PLACE, F.col("s.h").alias("h"), F.col("s.w").alias("w"))
    # of_word: the line of every word; before: the words before every line
    summed = split.select(*PLACE, "h", F.flatten(F.transform("w", lambda x, k: F.array_repeat(k + 1, x))).alias("of_word"), running_sums(F.col("w")).alias("before"))
    has = F.filter("before", lambda b: b + least_words <= F.size("of_word"))
    ends = F.transform(has, lambda b: F.get("of_word", b + least_words - 1))
    return summed.select(*PLACE, "h", ends.alias("ends"))


def fingerprints(found: DataFrame) -> DataFrame:
    """One row for each selected line: gram, at, the windows a to b that select it, the last line z before the end of the next window, two hashes of the lines a to z."""

    lines = F.transform("ends", lambda end, k: F.slice("h", k + 1, end - k))
    picks = F.transform(lines, lambda window, k: (k + F.array_position(window, F.array_min(window))).cast("int"))
    picked = found.select(*PLACE, "h", "ends", picks.alias("picks"))
    # a line is selected by consecutive windows
    begins = F.filter(F.transform("picks", lambda p, i: F.when(F.coalesce(F.get("picks", i - 1), F.lit(0)) != p, i + 1)), lambda i: i.isNotNull())
    split = picked.select(*PLACE, "h", "ends", "picks", begins.alias("begins"))

    def row(a: Column, j: Column) -> Column:
        at, b = F.get("picks", a - 1), F.coalesce(F.get("begins", j + 1) - 1, F.size("picks"))
        return F.struct(F.get("h", at - 1).alias("gram"), at.alias("at"), a.alias("a"), b.alias("b"), F.greatest(F.get("ends", b - 1), F.coalesce(F.get("ends", b), F.size("h") + 1) - 1).alias("z"))

    rows = split.select(*PLACE, "h", F.inline(F.transform("begins", row)))
    lines = F.slice("h", F.col("a"), F.col("z") - F.col("a") + 1)
    return rows.select(*PLACE, "gram", "at", "a", "b", "z", F.xxhash64(lines).alias("hash"), F.xxhash64(F.lit(1), lines).alias("check"))


def window_rows(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The windows a to b of wanted: pos, end, two hashes, and the hashes of the lines between its end and the end of the next one (tail)."""

    def window(k: Column) -> Column:
        end, beyond = F.get("ends", k - 1), F.coalesce(F.get("ends", k), F.size("h") + 1)
        lines = F.slice("h", k, end - k + 1)
        return F.struct(k.alias("pos"), end.alias("end"), F.xxhash64(lines).alias("hash"), F.xxhash64(F.lit(1), lines).alias("check"), F.slice("h", end + 1, F.greatest(beyond - end - 1, F.lit(0))).alias("tail"))

    by_doc = wanted.groupBy(*PLACE).agg(F.collect_set(F.struct("a", "b")).alias("wanted"))
    starts = F.flatten(F.transform("wanted", lambda s: F.sequence(s["a"], s["b"])))
    return found.join(stored(by_doc), PLACE).select(*PLACE, F.inline(F.transform(starts, window)))


def later_ones(stretches: DataFrame) -> DataFrame:
    """Of stretches (key of the document, pos, end, hash, check, ...) those of which an equal one stands earlier."""
    place = F.struct(*PLACE, "pos")
    equal = stretches.groupBy("hash", "check").agg(F.min(place).alias("source"), F.max(place).alias("last")).where("source <> last")
    return stretches.join(stored(equal.drop("last")), ["hash", "check"]).where(place != F.col("source"))


def repeats(docs: DataFrame, least_words: int) -> DataFrame:
    """Key of the document and the sorted lines (from 1, of those with words) that are repeats."""
    # filtered when stored only: a filter would carry the sums below into each step of its lambda
    found = stored(windows(docs, least_words)).where(F.size("ends") > 0)
    rows = stored(fingerprints(found))
    place = F.struct(*PLACE, "at")
    # places that agree in all lines around their fingerprint: all but the first match it
    around = rows.groupBy("hash", "check").agg(F.min(F.struct(*PLACE, "at", "a", "b")).alias("first"), F.max(place).alias("last"), F.min("gram").alias("gram"))
    around = stored(around.select("hash", "check", "gram", "first", (F.struct("first._row_id", "first._row_key", "first.at") < F.col("last")).alias("again")))
    sources = stored(around.where("again").select("hash", "check", F.struct("first._row_id", "first._row_key", "first.at").alias("source")))
    agreed = rows.join(sources, ["hash", "check"]).where(place != F.col("source")).select(*PLACE, F.col("a").alias("pos"), F.col("z").alias("end"))
    # where places differ in lines around the same fingerprint, the first of each kind is compared window by window
    mixed = stored(around.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    near = stored(window_rows(found, around.join(mixed, "gram", "left_semi").select("first.*")))
    matched = stored(later_ones(near).select(*PLACE, "pos", "end", (F.size("tail") > 0).alias("may_grow"), "hash", "check"))
    by_doc = matched.groupBy(*PLACE).agg(F.array_sort(F.collect_set(F.struct("pos", "may_grow", "hash", "check"))).alias("m"))
    # the last windows of runs of matches may go on by less than a window
    last = F.filter("m", lambda s, i: s["may_grow"] & (F.coalesce(F.get("m", i + 1)["pos"], F.lit(0)) != s["pos"] + 1))
    grow = stored(by_doc).select(F.inline(last)).select("hash", "check").distinct()
    further = near.where(F.size("tail") > 0).join(stored(grow), ["hash", "check"], "left_semi")

    def grown(_: Column, k: Column) -> Column:
        more = F.slice("tail", 1, k + 1)
        return F.struct((F.col("end") + k + 1).alias("end"), F.xxhash64("hash", more).alias("hash"), F.xxhash64("check", more).alias("check"))

    extended = stored(further.select(*PLACE, "pos", F.inline(F.transform("tail", grown))))
    more = later_ones(extended).select(*PLACE, "pos", "end")
    every = agreed.unionByName(matched.select(*PLACE, "pos", "end")).unionByName(more)
    covered = F.flatten(F.transform(F.collect_set(F.struct("pos", "end")), lambda s: F.sequence(s["pos"], s["end"])))
    return every.groupBy(*PLACE).agg(F.sort_array(F.array_distinct(covered)).alias("_line_dedup_at"))


def runs_of(at: str, place: str) -> Column:
    """(start, end) of the runs in sorted lines, as places among all lines: from 0, ends exclusive."""
    starts = F.filter(at, lambda x, i: F.coalesce(F.get(at, i - 1), F.lit(-1)) != x - 1)
    ends = F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1), F.lit(-1)) != x + 1)
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(place, a - 1).alias("start"), (F.get(place, b - 1) + 1).alias("end")))


def dedup_lines(docs: DataFrame, *, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with all repeats of least_words words or more cut out of text, and with n_lines and runs (start, end in lines) added."""
    docs = docs.drop("n_lines", "runs", *PLACE)
    whole = named_rows(docs)
    found = stored(repeats(whole.select(*PLACE, "text"), least_words))
    joined = whole.join(found.hint("shuffle_hash"), PLACE, "left").withColumn("_line_dedup_lines", F.when(F.col("_line_dedup_at").isNotNull(), lines_of(F.col("text"))))
    # places among the lines with words become places among all lines
    worded = F.filter(F.transform("_line_dedup_lines", lambda x, i: F.when(F.regexp_like(x, F.lit(r"\S")), i)), lambda i: i.isNotNull())
    placed = joined.withColumn("_line_dedup_worded", worded)
    placed = placed.withColumn("runs", F.coalesce(runs_of("_line_dedup_at", "_line_dedup_worded"), F.array().cast("array<struct<start:int,end:int>>")))
    # what stands before each run, and after the last one
    upto = lambda start, end: F.array_join(F.slice("_line_dedup_lines", start + 1, end - start), "")
    before = F.transform("runs", lambda r, i: upto(F.coalesce(F.get("runs", i - 1)["end"], F.lit(0)), r["start"]))
    after = upto(F.coalesce(F.get("runs", F.size("runs") - 1)["end"], F.lit(0)), F.size("_line_dedup_lines"))
    kept = F.concat(F.array_join(before, ""), after)
    out = placed.withColumn("n_lines", F.coalesce(F.size("_line_dedup_lines"), n_lines(F.col("text"))).cast("long"))
    return out.withColumn("text", F.when(F.size("runs") > 0, kept).otherwise(F.col("text"))).select(*docs.columns, "n_lines", "runs")


def line_digest(deduped: DataFrame) -> DataFrame:
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["end"] - r["start"]).cast("long")
    return deduped.select(
        "doc_id", "n_lines", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_runs"), F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
