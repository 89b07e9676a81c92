"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its
context and only that reply is under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
_LEAD, _END = "### ", "</turn>\n"


# A character that may begin a control string, and the letter that stands for it behind a backslash.
_CODES = (("<", "l"), ("#", "h"), (":", "c"))


def escape(text: Column, role: bool = False) -> Column:
    """Write backslashes twice and control characters as a backslash and a letter.

    No control string is left in the text: neither ``#`` nor ``<``, and in a
    role no colon either.
    """
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for character, letter in _CODES if role else _CODES[:2]:
        out = F.replace(out, F.lit(character), F.lit("\\" + letter))
    return out


def unescape(text: Column) -> Column:
    """The text before ``escape``: what stands between doubled backslashes has single ones only."""
    def plain(piece: Column) -> Column:
        for character, letter in _CODES:
            piece = F.replace(piece, F.lit("\\" + letter), F.lit(character))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def format_prefixes(conversations: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per reply: conv_id, example_idx, turn_count, formatted, mask_start, mask_length.

    A turn is written ``### role: text</turn>`` and a line feed; control
    strings inside roles and texts are escaped reversibly. ``mask_start`` counts
    code points from 0. A conversation that doesn't end with a reply gets one
    more row with all its turns and an empty mask, so that nothing is lost.

    Turns are ordered by ``turn`` (NULL first), then role and text; equal rows
    are all kept. A NULL role or text is empty. Rows without ``conv_id`` form
    one conversation. Other columns are ignored. A conversation must fit in one
    row, because its last example holds all of it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = (conversations.select("conv_id", F.struct(F.col("turn"), role.alias("role"),
                                                      text.alias("text")).alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    parts = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(
            (t["role"] == trained_role).alias("trained"),
            F.concat(F.lit(_LEAD), escape(t["role"], True), F.lit(": ")).alias("lead"),
            escape(t["text"]).alias("body"))).alias("parts"))
    examples = parts.select(
        "conv_id", "parts",
        F.explode(F.filter(F.sequence(F.lit(1), F.size("parts")),
                           lambda i: F.element_at("parts", i)["trained"]
                           | (i == F.size("parts")))).alias("turn_count"))
    whole = F.transform(F.slice("parts", 1, F.col("turn_count")),
                        lambda p: F.concat(p["lead"], p["body"], F.lit(_END)))
    last = F.element_at("parts", F.col("turn_count"))
    built = examples.select(
        "conv_id", "turn_count", F.array_join(whole, "").alias("formatted"),
        F.when(last["trained"], F.length(last["body"])).otherwise(0).alias("mask_length"))
    return built.select(
        "conv_id", F.col("turn_count").alias("example_idx"), "turn_count", "formatted",
        (F.length("formatted") - F.col("mask_length") - len(_END)).alias("mask_start"), "mask_length")


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of role and text."""
    pieces = F.filter(F.split(formatted, _END, -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.regexp_extract(p, r"^### ([^:]*): ", 1)).alias("role"),
        unescape(F.regexp_replace(p, r"(?s)^### [^:]*: ", "")).alias("text")))


def masked_text() -> Column:
    """The text under the loss mask as it was before formatting."""
    return unescape(F.substring(F.col("formatted"), F.col("mask_start") + 1, F.col("mask_length")))


def read_back(examples: DataFrame) -> DataFrame:
    """Digest columns per conversation, taken from the formatted examples alone."""
    rows = examples.select("conv_id", "turn_count", "formatted", masked_text().alias("loss"))
    per = rows.groupBy("conv_id").agg(
        F.max(F.struct("turn_count", "formatted"))["formatted"].alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_count", "loss"))),
                                 lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    turns = per.select("conv_id", "loss", "formatted_chars", parse_turns(F.col("whole")).alias("turns"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
