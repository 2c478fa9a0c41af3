"""Operator 4: chat formatting in Spark expressions.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role
become one block by comparing each array element with the one before it, and blocks are
concatenated once.  The template is

    <|im_start|>ROLE\\n TEXT (<|turn|> TEXT)* <|im_end|>\\n

``&`` and ``<|`` inside roles and texts (and a line feed in a role) are escaped, so that no text
can forge a mark and reading back gives every turn as it was.  The loss mask has one entry for
each block: whether it counts, and how many characters of it are header and body.

Defined results: a null text or role is empty; a null turn sorts first; rows of equal turn sort
by role, then text, and all stay; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, AGAIN = "<|im_start|>", "<|im_end|>\n", "<|turn|>"
#: The role whose text counts in the loss.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&n;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&n;"), F.lit("\n")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of ``turns`` (conv_id, turn, role, text)."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    # Where a block begins: the role differs from that of the turn before.
    begins = F.expr("filter(sequence(0, size(rows) - 1), i -> i = 0 or rows[i].role <> rows[i - 1].role)")
    ends = F.expr("transform(begins, (b, k) -> if(k + 1 < size(begins), begins[k + 1], size(rows)))")
    blocks = F.zip_with("begins", "ends", lambda b, e: F.struct(F.element_at("rows", b + 1).getField("role").alias("role"), F.slice("rows", b + 1, e - b).alias("turns")))

    def written(block: Column) -> Column:
        body = F.array_join(F.transform(block.getField("turns"), lambda t: escape(t.getField("text"))), AGAIN)
        head = F.concat(F.lit(START), escape_role(block.getField("role")), F.lit("\n"))
        return F.struct((block.getField("role") == LEARNED).alias("loss"), head.alias("head"), body.alias("body"))

    written_blocks = grouped.withColumn("begins", begins).withColumn("ends", ends).select("conv_id", F.transform(blocks, written).alias("blocks"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(b.getField("head"), b.getField("body"), F.lit(END))), "")
    mask = F.transform("blocks", lambda b: F.struct(b.getField("loss").alias("loss"), F.length(b.getField("head")).alias("head"), F.length(b.getField("body")).alias("body")))
    return written_blocks.select("conv_id", formatted.alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts) from (conv_id, formatted, mask): the rows and the learned texts."""
    # Every block ends with END, which no escaped text contains.
    blocks = F.expr(f"filter(split(formatted, '{END.replace('|', '[|]')}', -1), (b, i) -> i < size(mask))".replace("\n", "\\n"))

    def turns_of(block: Column) -> Column:
        plain = F.substring(block, len(START) + 1, 2**31 - 1)
        head = F.substring_index(plain, "\n", 1)
        body = F.substring(plain, F.length(head) + 2, F.length(plain))
        return F.transform(F.split(body, "<[|]turn[|]>", -1), lambda t: F.struct(unescape_role(head).alias("role"), unescape(t).alias("text")))

    def learned(block: Column, mask: Column) -> Column:
        return F.when(mask.getField("loss"), F.substring(block, mask.getField("head") + 1, mask.getField("body"))).otherwise(F.lit(None))

    cut = formatted.withColumn("__blocks", blocks)
    loss = F.filter(F.zip_with("__blocks", "mask", learned), lambda x: x.isNotNull())
    texts = F.transform(F.flatten(F.transform(loss, lambda b: F.split(b, "<[|]turn[|]>", -1))), unescape)
    return cut.select("conv_id", F.flatten(F.transform("__blocks", turns_of)).alias("turns"), texts.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """The digests of what ``read_back`` finds, a row for each conversation."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_back(formatted).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
