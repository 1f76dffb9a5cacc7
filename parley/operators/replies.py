"""Replies to blocks, list items and bold terms, one narrow pass over the messages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from parley.functions.replies import block_starts, blocks_between, classified_lines
from parley.functions.text import bold_terms, inline_spans
from parley.plans.explode import explode_rows


class Structured(NamedTuple):
    blocks: DataFrame
    bold: DataFrame


def reply_blocks(messages: DataFrame, text: str = "content", key: str = "id") -> DataFrame:
    """(message_id, block_no, kind, items): paragraphs hold one item.

    Lines, block starts and blocks are separate steps because each is used several times
    by the next one; that keeps the optimizer from inlining and recomputing them.
    """
    lined = messages.select(F.col(key).alias("message_id"), classified_lines(text).alias("lines"))
    started = lined.select("message_id", "lines", block_starts("lines").alias("starts"))
    cut = started.select("message_id", blocks_between("lines", "starts").alias("blocks"))
    return explode_rows(cut, "blocks", "block_no", "block").select(
        "message_id", "block_no", F.col("block.kind").alias("kind"), F.col("block.items").alias("items")
    )


def block_items(blocks: DataFrame) -> DataFrame:
    """(message_id, block_no, kind, item_no, text, spans): spans mark what is bold."""
    items = explode_rows(blocks.select("message_id", "block_no", "kind", "items"), "items", "item_no", "text")
    return items.withColumn("spans", inline_spans("text"))


def bold_spans(blocks: DataFrame) -> DataFrame:
    """(message_id, block_no, item_no, pos, term) of the bold terms on display."""
    items = explode_rows(blocks.select("message_id", "block_no", "items"), "items", "item_no", "text")
    terms = items.select("message_id", "block_no", "item_no", bold_terms("text").alias("terms"))
    return explode_rows(terms, "terms", "pos", "term")


def structure_replies(messages: DataFrame, text: str = "content", key: str = "id") -> Structured:
    blocks = reply_blocks(messages, text, key)
    return Structured(blocks, bold_spans(blocks))
