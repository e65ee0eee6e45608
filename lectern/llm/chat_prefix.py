"""Prefix-target expansion of conversations, in DataFrame functions only.

Each assistant turn becomes an example: all turns before it as context, and only its text under the loss mask. Turns
after the last reply follow in one more example without a target, so the examples of a conversation hold all of it.

A turn is written ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. Control strings inside a role or text are escaped:
``~`` becomes ``~0`` and each of CONTROLS its own ``~`` digit; ``unescape`` is the exact inverse.

Defined cases: a null role or text counts as empty; turns of a conversation come in order of turn (null first), then
role, then text, so repeated rows stay; a null conv_id is a conversation too; one without an assistant has no target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>"]
ESCAPES = [("~", "~0"), *((c, f"~{k}") for k, c in enumerate(CONTROLS, 1))]


def escape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, F.coalesce(c, F.lit("")))


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), c)


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, target (place of the reply, from 0; null: none), is_last, formatted, loss_start, loss_length (code points).

    ``turns`` needs conv_id, turn, role and text; other columns are ignored.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias("pieces"),
        F.transform("turns", lambda t: F.struct(F.length(head(t)).alias("head"), F.length(escape(t["text"])).alias("body"))).alias("sizes"),
        F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull()).alias("replies"),
    )
    n = F.size("pieces")
    tail = F.when(F.coalesce(F.try_element_at("replies", F.lit(-1)) != n - 1, F.lit(True)), F.array(F.struct(F.lit(None).cast("int").alias("target"), (n - 1).alias("last"))))
    targets = F.concat(F.transform("replies", lambda i: F.struct(i.alias("target"), i.alias("last"))), F.coalesce(tail, F.array().cast("array<struct<target:int,last:int>>")))
    rows = convs.withColumn("example", F.explode(targets))
    last = F.col("example.last")
    context = F.array_join(F.slice("pieces", 1, last), "")
    return rows.select(
        "conv_id",
        F.col("example.target").alias("target"),
        (last == F.size("pieces") - 1).alias("is_last"),
        F.concat(context, F.get("pieces", last)).alias("formatted"),
        F.when(F.col("example.target").isNotNull(), F.length(context) + F.get("sizes", last)["head"]).alias("loss_start"),
        F.when(F.col("example.target").isNotNull(), F.get("sizes", last)["body"]).alias("loss_length"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    parts = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.replace(F.substring_index(p, TEXT, -1), F.lit(END), F.lit(""))).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """Read back from the examples: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id",
        "target",
        F.length("formatted").alias("chars"),
        F.when(F.col("is_last"), F.size(turns)).alias("n_turns"),
        F.when(F.col("is_last"), F.sha2(said, 256)).alias("turns_sha256"),
        unescape(F.when(F.col("target").isNotNull(), F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))).alias("reply"),
    )
    replies = F.filter(F.sort_array(F.collect_list(F.struct("target", "reply"))), lambda x: x["target"].isNotNull())
    out = read.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(replies, lambda x: x["reply"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
