"""Chat formatting by relational means: Spark expressions only.

A conversation becomes ``<|begin|>`` and one block per run of turns of one role:
``<|im_start|>role``, a line break, the turns' texts with ``<|turn|>`` between
them, ``<|im_end|>`` and a line break. Control strings inside roles and texts are
escaped: their first character (and a line break in a role) is written as a
percent code, and a percent sign that could be read as such a code is written as
``%25``. So the format can be read back without loss.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import bind, cut, running

BEGIN, START, TURN, END = "<|begin|>", "<|im_start|>", "<|turn|>", "<|im_end|>"
#: Strings that no text may contain unescaped, this template's and other common ones.
CONTROLS = (BEGIN, START, TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
LEARN_ROLE = "assistant"


def escape(text: Column, line_breaks: bool = False) -> Column:
    angle = "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == "<")
    square = "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == "[")
    out = F.regexp_replace(text, "%(?=25|3C|5B|0A)", "%25")
    out = F.regexp_replace(out, rf"<(?={angle})", "%3C")
    out = F.regexp_replace(out, rf"\[(?={square})", "%5B")
    return F.replace(out, F.lit("\n"), F.lit("%0A")) if line_breaks else out


def unescape(text: Column) -> Column:
    for code, plain in (("%0A", "\n"), ("%5B", "["), ("%3C", "<"), ("%25", "%")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: (conv_id, formatted, loss_spans).

    Turns are sorted by number, then role and text, so ties and repeated rows have
    one order; all are kept. Null roles and texts count as empty, null
    conversation ids as one conversation. ``loss_spans`` holds the code-point
    ranges [start, end) of ``formatted`` that assistant texts fill; texts merged
    into one block keep a span each. Empty tables give no rows; other columns are
    ignored.
    """
    entry = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    n = F.size("turns")
    index = F.sequence(F.lit(0), n - 1)
    firsts = F.filter(index, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    chats = chats.withColumn("firsts", F.concat(firsts, F.array(n)))
    block = lambda b: F.struct(
        F.get("turns", F.get("firsts", b))["role"].alias("role"),
        F.transform(F.slice("turns", F.get("firsts", b) + 1, F.get("firsts", b + 1) - F.get("firsts", b)), lambda t: escape(t["text"])).alias("texts"),
    )
    chats = chats.select("conv_id", F.transform(F.sequence(F.lit(0), F.size("firsts") - 2), block).alias("blocks"))
    head = lambda b: F.concat(F.lit(START), escape(b["role"], line_breaks=True), F.lit("\n"))
    tail = F.lit(f"{END}\n")
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], TURN), tail)), ""))
    # Pieces of the format in order, and whether each is learned from; spans are their running lengths.
    piece = lambda size, learn: F.struct(size.cast("int").alias("size"), learn.alias("learn"))
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(piece(F.length(head(b)), F.lit(False))),
                F.slice(
                    F.flatten(F.transform(b["texts"], lambda t: F.array(piece(F.length(t), b["role"] == LEARN_ROLE), piece(F.lit(len(TURN)), F.lit(False))))),
                    1,
                    2 * F.size(b["texts"]) - 1,
                ),
                F.array(piece(F.length(tail), F.lit(False))),
            ),
        )
    )
    chats = chats.select("conv_id", formatted.alias("formatted"), pieces.alias("pieces"))

    def spans(parts: Column) -> Column:
        before = running(F.transform(parts, lambda p: p["size"]), lambda x, y: x + y, F.lit(0))
        placed = F.zip_with(parts, before, lambda p, at: F.struct(p["learn"].alias("learn"), (at + len(BEGIN)).alias("start"), (at + len(BEGIN) + p["size"]).alias("end")))
        return F.transform(F.filter(placed, lambda p: p["learn"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))

    return chats.select("conv_id", "formatted", bind(F.col("pieces"), spans).alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text) from the formatted text and spans alone."""
    blocks = F.slice(F.split("formatted", re.escape(START), -1), 2, F.length("formatted"))
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(_after_first_line(b), END, 1), re.escape(TURN), -1),
                lambda t: F.struct(unescape(F.substring_index(b, "\n", 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    learned = F.array_join(F.transform(cut(F.col("formatted"), F.col("loss_spans")), unescape), "")
    return chats.select("conv_id", "formatted", turns.alias("turns"), learned.alias("loss_text"))


def _after_first_line(block: Column) -> Column:
    return F.substring(block, F.locate("\n", block) + 1, F.length(block))
