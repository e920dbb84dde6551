"""Secret scan with corpus-wide ownership frequency, in SQL functions only.

Candidates are the values of assignments, access key ids, long hexadecimal runs and, as
bare candidates, long runs of mixed letters and digits that none of those covers. Their
hashes are counted over the whole corpus by distinct repositories and owners: a value of
one owner looks live unless example_repositories or more of its repositories have it, one
that example_owners or more owners have is a widely copied example, others are shared.
n_repositories is the number for the most copied value of a document. Bare candidates are
reported, with kind "live", only where their value is live: ownership is what tells a
credential from a common string.

Spans are (kind, start, end) in code points. A pattern's places follow from the text
between its matches: split() gives those parts, regexp_extract_all() the matches, and
running sums of lengths the starts.

Edge cases: a null or empty text has no spans; rows equal in doc_id and text are one
document in the counts and each has its row in the result; a null owner or repository is
one of its own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_ID, ROW_KEY, cut, keyed, once, running_sums

# The patterns and least lengths of the base kinds, in the order of listing.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # of AKIA[A-Z0-9]+ the matches of 18 characters and more
HEX = r"[0-9a-f]{16,}"  # of [0-9a-f]+ the matches of 16 characters and more
ASSIGN_LEAST = 12
KINDS = ["assign", "access", "hex", "live"]
BARE = r"[A-Za-z0-9+/_-]{24,}"
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 3


def matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """(start, end, value) of the leftmost matches that do not overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    # between matches and their ends stand the gaps: start = gaps and matches before, and the gap
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    kind = "array<struct<start:int,end:int,value:string>>"

    def placed(m: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda gap, x: gap + F.length(x))
        both = F.zip_with(once(sizes, lambda v: running_sums(v)), sizes, lambda before, size: before + size)
        ends = F.zip_with(both, m, lambda end, x: F.struct((end - F.length(x)).alias("start"), end.alias("end")))
        return F.zip_with(ends, values, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value"))).cast(kind)

    return F.when(F.rlike(text, F.lit(pattern)), once(found, placed)).otherwise(F.array().cast(kind))


def tagged(spans: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """One row for each document that has candidates: its key, owner, repository, base and bare."""
    t = F.col("text")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias(ROW_ID),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(ROW_KEY),
        F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    found = rows.select(
        ROW_ID,
        ROW_KEY,
        "owner",
        "repository",
        F.filter(matches(t, ASSIGN, 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST).alias("assign"),
        matches(t, ACCESS).alias("access"),
        matches(t, HEX).alias("hex"),
        F.filter(matches(t, BARE), lambda s: F.rlike(s["value"], F.lit("[0-9]")) & F.rlike(s["value"], F.lit("[A-Za-z]"))).alias("bare"),
    )
    base = F.array_sort(F.concat(tagged(F.col("assign"), "assign"), tagged(F.col("access"), "access"), tagged(F.col("hex"), "hex")))
    return (
        found.withColumn("base", base)
        .withColumn("bare", tagged(F.col("bare"), "live"))
        .where((F.size("base") > 0) | (F.size("bare") > 0))
        .select(ROW_ID, ROW_KEY, "owner", "repository", "base", "bare")
    )


def uncovered(each: DataFrame) -> DataFrame:
    """The spans s without bare ones that overlap a base one: along a document, the furthest end of the base spans that begin before a bare one ends."""
    is_bare = F.col("s.kind") == "live"
    at = F.when(is_bare, F.col("s.end") - 1).otherwise(F.col("s.start"))
    before = Window.partitionBy(ROW_ID, ROW_KEY, "owner", "repository").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(~is_bare, F.col("s.end"))).over(before)
    return each.withColumn("_at", at).withColumn("_reach", reach).where(~is_bare | F.col("_reach").isNull() | (F.col("_reach") <= F.col("s.start"))).drop("_at", "_reach")


def ownership(values: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repositories: distinct counts in two steps, each combined before its shuffle."""
    by_repository = values.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n_repositories"))
    return by_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repositories").alias("n_repositories"))


def secret_scan(docs: DataFrame, *, owner: str = "source", repository: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, n_example, n_repositories for every row of docs."""
    found = cut(candidates(docs, owner, repository))
    each = cut(uncovered(found.select(ROW_ID, ROW_KEY, "owner", "repository", F.explode(F.concat("base", "bare")).alias("s"))).withColumn("value_hash", F.xxhash64("s.value")))
    # stored before it is joined: Spark splits a common value's rows in a join of two scans only
    owned = cut(ownership(each.select("value_hash", "owner", "repository")))
    live = (F.col("n_owners") == 1) & (F.col("n_repositories") < example_repositories)
    status = F.when(F.col("n_owners") >= example_owners, "example").when(live, "live").otherwise("shared")
    judged = each.join(owned.select("value_hash", status.alias("status"), "n_repositories"), "value_hash")
    kept = F.when((F.col("s.kind") != "live") | (F.col("status") == "live"), F.struct("s.start", "s.order", "s.end", "s.kind", "status"))
    by_doc = judged.groupBy(ROW_ID, ROW_KEY).agg(F.array_sort(F.collect_set(kept)).alias("spans"), F.max("n_repositories").alias("n_repositories"))
    rows = keyed(docs, keep=False).withColumn("doc_id", F.when(F.col(ROW_ID) != -(2**63), F.col(ROW_ID)))
    base = F.filter("spans", lambda s: s["kind"] != "live")

    def count(field: str, what: str) -> Column:
        return F.coalesce(F.size(F.filter("spans", lambda s: s[field] == what)), F.lit(0)).cast("long")

    return rows.join(by_doc, [ROW_ID, ROW_KEY], "left").withColumn("spans", F.coalesce("spans", F.array().cast(by_doc.schema["spans"].dataType))).select(
        "doc_id",
        count("kind", "assign").alias("n_assign"),
        count("kind", "access").alias("n_access"),
        count("kind", "hex").alias("n_hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        *(count("status", k).alias(f"n_{k}") for k in ("live", "shared", "example")),
        F.coalesce("n_repositories", F.lit(0)).cast("long").alias("n_repositories"),
    )
