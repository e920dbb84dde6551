"""Chat formatting by prefix-target expansion, in SQL functions only.

Every assistant turn becomes an example of its own: all turns before it are context and
the reply alone is trainable. A conversation that does not end with a reply has one more
example without a trainable part, so that no turn is lost. An example holds the
formatted text and the trainable span (loss_start, loss_length in code points; length 0
for none). A turn is written as

    <|im_start|>role\\ntext<|im_end|>\\n

with a backslash before every backslash of a role or text, before every | that follows
a <, and before every line feed of a role; so no control string can arise inside a text
and dropping the backslashes gives the text again.

Edge cases: a null role or text is empty; a null turn comes first; equal turns are
ordered by role and text, and repeated rows are turns of their own; a null conv_id is a
conversation like any other; an empty table gives no examples; other columns are not
looked at. One conversation is one text and so must fit a row, as its hash does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"


def escaped(c: Column, *, header: bool = False) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if header else out


def unescaped(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r"(?s)\\(.)", "$1")).otherwise(c)


def chat_examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    written = ordered.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == TARGET_ROLE).alias("is_target"),
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(BEGIN), escaped(t["role"], header=True), F.lit("\n")).alias("head"),
                escaped(t["text"]).alias("body"),
            ),
        ).alias("parts"),
    )
    n = F.size("parts")
    last = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("k"), F.element_at("is_target", k).alias("target")))
    ends = F.filter(last, lambda e: e["target"] | (e["k"] == n))
    each = written.select("conv_id", "parts", F.posexplode(ends).alias("example", "end"))
    final = F.element_at("parts", F.col("end.k"))
    before = F.array_join(
        F.transform(F.slice("parts", F.lit(1), F.col("end.k") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""
    )
    return each.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.concat(before, final["head"]).alias("prefix"),
        final["body"].alias("reply"),
        F.col("end.target").alias("target"),
    ).select(
        "conv_id",
        "example",
        F.concat("prefix", "reply", F.lit(END)).alias("formatted"),
        F.length("prefix").cast("long").alias("loss_start"),
        F.when(F.col("target"), F.length("reply")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    bodies = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")
    head = r"(?s)^((?:[^\\\n]|\\.)*)\n(.*)<\|im_end\|>\n$"
    return F.transform(
        bodies,
        lambda x: F.struct(unescaped(F.regexp_extract(x, head, 1)).alias("role"), unescaped(F.regexp_extract(x, head, 2)).alias("text")),
    )


def chat_digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from them."""
    span = F.when(F.col("loss_length") > 0, unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))).otherwise("")
    by_conv = (
        examples.withColumn("loss", span)
        .groupBy("conv_id")
        .agg(
            F.max_by("formatted", "example").alias("whole"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "").alias("loss"),
            F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
            F.count(F.lit(1)).alias("n_examples"),
        )
    )
    return by_conv.withColumn("turns", read_turns(F.col("whole"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
