"""String rules of the chat client as Column expressions.

The client's rules come from ECMAScript strings, which differ from SQL strings in three
ways that matter here: what counts as white space, lengths in UTF-16 units, and an empty
string being "no value" (falsy).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ECMAScript white space and line terminators.
WHITESPACE = (
    "\t\n\x0b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as a regular-expression class: ASCII blanks, all Unicode separators, BOM.
# Spelled as ranges the class is several times slower to match.
WS = r"[\s\p{Z}\x{FEFF}]"

# Limits and defaults of the client.
TITLE_CHARS = 50
LONG_REPLY_CHARS = 680
MAX_IMAGE_SIDE = 1280
DEFAULT_TITLE = "New Chat"
FIRST_TITLE = "New chat"
UNTITLED = "Untitled chat"
DEFAULT_NAME = "Student"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    return F.trim(_col(c), F.lit(WHITESPACE))


def falsy(c) -> Column:
    """True for NULL and for the empty string; ids of any type may be passed."""
    c = _col(c)
    return c.isNull() | (c.cast("string") == "")


def empty_to_null(c) -> Column:
    return F.nullif(_col(c), F.lit(""))


def or_else(*options) -> Column:
    """``a || b || c`` over strings."""
    *head, last = [_col(o) for o in options]
    return F.coalesce(*[empty_to_null(h) for h in head], last)


def js_length(c) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(_col(c), "UTF-16BE")) / 2).cast("int")


def js_slice(c, units: int) -> Column:
    """The first ``units`` UTF-16 units.

    ``units`` code points always hold at least as many UTF-16 units, so only that short
    piece is re-encoded.  A cut through a surrogate pair drops the half character, which
    no UTF-8 string can hold.
    """
    wide = F.encode(F.substring(_col(c), 1, units), "UTF-16BE")
    lead = F.substring(wide, 2 * units - 1, 1)
    broken = (lead >= F.lit(bytes([0xD8]))) & (lead <= F.lit(bytes([0xDB])))
    kept = F.when(broken, F.substring(wide, 1, 2 * units - 2)).otherwise(F.substring(wide, 1, 2 * units))
    return F.decode(kept, "UTF-16BE")


def longer_than(c, units: int) -> Column:
    """``length > units`` without re-encoding a whole long text."""
    c = _col(c)
    return js_length(F.substring(c, 1, units + 1)) > units


def title_base(text, first_attachment_name) -> Column:
    """Trimmed text, else the first file's name, else a fixed title."""
    return F.coalesce(
        empty_to_null(js_trim(text)),
        F.concat(F.lit("File: "), empty_to_null(first_attachment_name)),
        F.lit(FIRST_TITLE),
    )


def shorten_title(base) -> Column:
    base = _col(base)
    tail = F.when(longer_than(base, TITLE_CHARS), F.lit("...")).otherwise(F.lit(""))
    return F.concat(js_slice(base, TITLE_CHARS), tail)


def stored_title(title) -> Column:
    return or_else(title, F.lit(DEFAULT_TITLE))


def shown_title(title) -> Column:
    return or_else(title, F.lit(UNTITLED))


def placeholder_email(email, user_id) -> Column:
    return or_else(email, F.concat(_col(user_id).cast("string"), F.lit("@local.invalid")))


def display_name(first_name, email) -> Column:
    return or_else(first_name, F.substring_index(_col(email), "@", 1), F.lit(DEFAULT_NAME))


def age_strict(text) -> Column:
    """All digits, else NULL; a number too large for INT is NULL."""
    text = _col(text)
    return F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("int"))


def age_lenient(text) -> Column:
    """Leading integer, as a browser's number parsing reads it."""
    digits = F.regexp_extract(_col(text), rf"\A{WS}*([+-]?[0-9]+)", 1)
    return empty_to_null(digits).try_cast("int")


def is_long_reply(text) -> Column:
    return longer_than(F.coalesce(_col(text), F.lit("")), LONG_REPLY_CHARS)


def bold_terms(text) -> Column:
    """ARRAY<STRING> of the terms between double asterisks."""
    return F.regexp_extract_all(_col(text), F.lit(r"\*\*([^*]+)\*\*"), F.lit(1))


def inline_spans(text) -> Column:
    """ARRAY<STRUCT<bold, text>>: plain and bold pieces in turn, plain ones possibly empty."""
    text = _col(text)
    plain = F.split(text, r"\*\*[^*]+\*\*", -1)
    terms = bold_terms(text)
    pairs = F.zip_with(
        plain, terms,
        lambda p, b: F.array(
            F.struct(F.lit(False).alias("bold"), p.alias("text")),
            F.struct(F.lit(True).alias("bold"), b.alias("text")),
        ),
    )
    # zip_with pads the shorter list, which is always the one of the bold terms.
    return F.filter(F.flatten(pairs), lambda s: s["text"].isNotNull())


def attachment_label(type_, name) -> Column:
    """Chip label of a pending attachment."""
    kind = F.when(_col(type_) == "image", F.lit("Image")).otherwise(F.lit("Text"))
    return F.concat(kind, F.lit(": "), _col(name))


def file_label(name) -> Column:
    """Label of a sent non-image attachment."""
    return F.concat(F.lit("File: "), _col(name))


def date_text(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd")


def datetime_text(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")


def scaled_size(width, height, max_side: int = MAX_IMAGE_SIDE) -> tuple[Column, Column]:
    """Width and height after shrinking the longer side to ``max_side``; never enlarged."""
    width, height = _col(width), _col(height)
    longest = F.greatest(width, height).cast("double")
    scale = F.when(longest > max_side, F.lit(float(max_side)) / longest).otherwise(F.lit(1.0))
    return F.round(width * scale).cast("int"), F.round(height * scale).cast("int")
