"""Prefix-target expansion of conversations into training examples, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed control strings of the template and of common chat formats. Each starts with `<` or `[` and holds no other such sign.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = "\\|im_(?:start|sep|end)\\|>|/?s>|/?INST\\]"
ESCAPE = rf"([<\[])(\\*)({CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)({CONTROL})"


def escape(text: Column) -> Column:
    """Puts one backslash after the first sign of each control string, or one more where some stand there already."""
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of escape: takes one backslash out of each escaped control string."""
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def expand_prefixes(conversations: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """One example per trainable turn: all turns before it as context, and only that reply under the loss mask.

    Returns conv_id, example (the target's place in the conversation, from 1), formatted, loss_start
    (code points before the masked span) and loss_len (its code points). A conversation that does not end
    on a trainable turn has one more example that holds it whole, with an empty mask, so no turn is lost.

    Turns are ordered by turn (nulls first), then role and text; repeated rows stay. A null role or text
    counts as empty, empty texts stay as empty turns, a null conv_id is a conversation of its own, an empty
    table gives no examples, and further columns are ignored. The context repeats earlier turns, so output
    grows with the square of a conversation's turns: that is the format.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    convs = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct((t["role"] == trainable_role).alias("hot"), escape(t["role"]).alias("r"), escape(t["text"]).alias("x")))
    convs = convs.select("conv_id", parts.alias("parts"))
    convs = convs.withColumn("rendered", F.transform("parts", lambda p: F.concat(F.lit(START), p["r"], F.lit(SEP), p["x"], F.lit(END))))
    at = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at("parts", i)["hot"] | (i == F.size("parts")))
    each = convs.select("conv_id", "parts", "rendered", F.explode(at).alias("example"))
    target = F.element_at("parts", F.col("example"))
    each = each.select(
        "conv_id", "example", F.array_join(F.slice("rendered", F.lit(1), F.col("example")), "").alias("formatted"),
        F.when(target["hot"], F.length(target["x"])).otherwise(F.lit(0)).alias("loss_len"),
    )
    return each.select("conv_id", "example", "formatted", (F.length("formatted") - F.col("loss_len") - len(END)).alias("loss_start"), "loss_len")


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted example, read back as array<struct<role, text>>."""
    pieces = F.split(formatted, "<\\|im_end\\|>")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEP, 1)).alias("role"),
            unescape(F.substr(p, F.locate(SEP, p) + len(SEP))).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns, the text under the loss mask and the size of the output."""
    loss = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_len")))
    got = examples.select("conv_id", "example", "formatted", loss.alias("loss")).groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.max_by("formatted", "example").alias("whole"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    got = got.withColumn("turns", parse_turns(F.col("whole")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
