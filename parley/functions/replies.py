"""Structure of a reply text, as Column expressions over one message.

A reply is one row, so its lines are handled with array functions inside that row: no
line ever leaves its task and nothing is shuffled to rebuild a message.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from parley.functions.text import WS, _col, js_trim

# The start of a numbered ("1. x") or bulleted ("- x", "* x") line.
LIST_MARKER = rf"\A(?:[0-9]+\.|[-*]){WS}++"
LINE_TERMINATORS = ("\r", "\u2028", "\u2029")
# A whole run of white space, found at its first character only and never given back, so
# that texts with very long blank runs stay linear.
RUN = rf"{WS}(?<!{WS}{{2}}){WS}*+"


def _mark_lists(text) -> Column:
    """Inline list markers on lines of their own; numbers first, then bullets."""
    unix = F.replace(_col(text), F.lit("\r\n"), F.lit("\n"))
    numbered = F.regexp_replace(unix, rf"{RUN}([0-9]+\.{WS}++\*\*)", "\n$1")
    bullets = F.regexp_replace(numbered, rf"{RUN}\*{WS}++", "\n- ")
    # Both need an asterisk, and finding none is far cheaper than matching.
    return F.when(F.contains(_col(text), F.lit("*")), bullets).otherwise(unix)


def break_lists(text) -> Column:
    """The reply text with one list item per line and no more than one blank line in a row.

    The steps depend on each other's output; their order is the meaning.
    """
    return js_trim(F.regexp_replace(_mark_lists(text), r"\n{3,}", "\n\n"))


def reply_lines(text) -> Column:
    """ARRAY<STRING>: trimmed, non-blank lines of ``break_lists``.

    Its last steps only remove blank lines and blanks at the ends, which is done here line
    by line anyway.
    """
    lines = F.transform(F.split(_mark_lists(text), "\n", -1), js_trim)
    return F.filter(lines, lambda line: line != "")


def classified_lines(text) -> Column:
    """ARRAY<STRUCT<is_list, text>>: list lines lose their marker, others stay whole.

    The marker is matched on its own and the rest cut off behind it; one pattern for the
    whole line would walk every character of it.
    """
    def split_marker(line):
        marker = F.regexp_extract(line, LIST_MARKER, 0)
        return F.struct(line.alias("line"), F.length(marker).alias("cut"))

    def classify(found):
        rest = F.substring(found["line"], found["cut"] + 1, F.lit(2147483647))
        # An item cannot hold a line terminator (a line feed has ended the line already).
        broken = reduce(or_, [F.contains(rest, F.lit(t)) for t in LINE_TERMINATORS])
        listed = (found["cut"] > 0) & ~broken
        return F.struct(listed.alias("is_list"), F.when(listed, rest).otherwise(found["line"]).alias("text"))

    return F.transform(F.transform(reply_lines(text), split_marker), classify)


def block_starts(lines) -> Column:
    """1-based positions of the lines that open a block.

    A line continues the block before it only when both are list lines.
    """
    lines = _col(lines)
    return F.filter(
        F.transform(
            lines,
            lambda line, i: F.when(
                (i == 0) | ~line["is_list"] | ~F.get(lines, i - 1)["is_list"], i + 1
            ),
        ),
        lambda pos: pos.isNotNull(),
    )


def blocks_between(lines, starts) -> Column:
    """ARRAY<STRUCT<kind, items>> cut from ``lines`` at ``starts``."""
    lines, starts = _col(lines), _col(starts)

    def block(start, i):
        end = F.coalesce(F.get(starts, i + 1), F.size(lines) + 1)
        kind = F.when(F.get(lines, start - 1)["is_list"], "list").otherwise("paragraph")
        return F.struct(kind.alias("kind"), F.slice(lines, start, end - start)["text"].alias("items"))

    return F.transform(starts, block)
