"""Bulk intake of attached files: slots, limits, routing, error reports.

Input: files(batch_id, pos, name, mime, size, text, pending), one row per file in the
order ``pos`` of its batch; ``text`` is the text already extracted from the file, and
``pending`` the number of attachments the message had before the batch.  Optional
columns: ``data_url`` (encoded image) and ``failed`` (reading the file threw).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.functions.text import WHITESPACE, js_slice, js_trim
from parley.plans.skew import spread_join
from parley.session import stored

# Limits, file classes and wording.
MAX_ATTACHMENTS = 6
MAX_BYTES = 8 * 1024 * 1024
MAX_CHARS = 8000
SHOWN_ERRORS = 4
STRETCH = 64  # page numbers whose lengths are summed up together
LAST = (1 << 63) - 1  # stands for the number of a page that has none
TEXT_NAME = r"(?i)\.(txt|md|csv|json|js|ts|py|java|html|css)\z"
IMAGE_NAME = r"(?i)\.(png|jpe?g|webp|gif|bmp)\z"
PDF_MIME = "application/pdf"
DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MESSAGES = {
    "too_large": "file is too large (max {megabytes}MB).",
    "empty_text": "text file appears empty or unreadable.",
    "empty_pdf": "could not extract readable text from PDF.",
    "empty_docx": "could not extract readable text from DOCX.",
    "unsupported": "unsupported file type.",
    "failed": "unreadable file or processing failed.",
}
CAP_ERROR = "Only {most} attachments are allowed."
ATTACHED = " file(s) attached. Add a prompt or send files directly."
NONE_ATTACHED = "No files were attached."
MORE_ERRORS = ("...and ", " more.")


class Attachments(NamedTuple):
    attached: DataFrame
    errors: DataFrame
    batch_status: DataFrame


def route(name, mime) -> Column:
    """File class by MIME type or extension; the order of the tests decides."""
    lower = F.lower(name)
    mime = F.coalesce(mime, F.lit(""))
    return (
        F.when(F.startswith(mime, F.lit("text/")) | lower.rlike(TEXT_NAME), "text")
        .when((mime == PDF_MIME) | F.endswith(lower, F.lit(".pdf")), "pdf")
        .when((mime == DOCX_MIME) | F.endswith(lower, F.lit(".docx")), "docx")
        .when(F.startswith(mime, F.lit("image/")) | lower.rlike(IMAGE_NAME), "image")
        .otherwise("unsupported")
    )


def slots(pending, max_per_batch: int = MAX_ATTACHMENTS) -> Column:
    return F.greatest(F.lit(0), F.lit(max_per_batch) - pending)


def examine_files(
    files: DataFrame,
    max_per_batch: int = MAX_ATTACHMENTS,
    max_bytes: int = MAX_BYTES,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """The files that get a slot, with ``kind``, ``content`` and ``code`` (NULL = attached).

    Slots go to the first files of a batch whether or not they turn out to be valid.  The
    constant bound on the row number lets Spark keep only the first rows of each batch on
    every task before the shuffle, so a batch of any size costs its task a handful of
    rows; texts are cut before they are sorted.
    """
    failed = F.coalesce("failed", F.lit(False)) if "failed" in files.columns else F.lit(False)
    data_url = F.col("data_url") if "data_url" in files.columns else F.lit(None).cast("string")
    kind = F.when(F.col("size") > max_bytes, "too_large").otherwise(route(F.col("name"), F.col("mime")))
    reads_text = F.col("kind").isin("text", "pdf", "docx")
    content = F.when(reads_text, js_slice(js_trim("text"), max_chars))
    code = (
        F.when(F.col("kind").isin("too_large", "unsupported"), F.col("kind"))
        .when(F.col("failed"), "failed")
        .when(reads_text & (F.coalesce("content", F.lit("")) == ""), F.concat(F.lit("empty_"), "kind"))
    )
    slim = (
        files.select("batch_id", "pos", "name", "size", "pending", "text", kind.alias("kind"),
                     failed.alias("failed"), data_url.alias("data_url"))
        .withColumn("content", content)
        .drop("text")
        .withColumn("code", code)
    )
    first = F.row_number().over(W.partitionBy("batch_id").orderBy("pos"))
    return (
        slim.withColumn("slot", first)
        .where((F.col("slot") <= max_per_batch) & (F.col("slot") <= slots(F.col("pending"), max_per_batch)))
        .select("batch_id", "pos", "name", "kind", "content", "data_url", "code")
    )


def batch_sizes(files: DataFrame, max_per_batch: int = MAX_ATTACHMENTS) -> DataFrame:
    """(batch_id, n_files, over_cap) from the two columns it needs."""
    counted = files.groupBy("batch_id").agg(F.count("*").alias("n_files"), F.max("pending").alias("pending"))
    return counted.select(
        "batch_id", "n_files", (F.col("n_files") > slots(F.col("pending"), max_per_batch)).alias("over_cap")
    )


def file_error(name, code, max_bytes: int = MAX_BYTES) -> Column:
    text = F.lit(None).cast("string")
    for known, message in MESSAGES.items():
        text = F.when(code == known, F.lit(message.format(megabytes=max_bytes >> 20))).otherwise(text)
    return F.concat(name, F.lit(": "), text)


def cap_error(max_per_batch: int = MAX_ATTACHMENTS) -> str:
    return CAP_ERROR.format(most=max_per_batch)


def ingest_attachments(
    files: DataFrame,
    max_per_batch: int = MAX_ATTACHMENTS,
    max_bytes: int = MAX_BYTES,
    max_chars: int = MAX_CHARS,
) -> Attachments:
    """Route and check a table of files.

    ``attached(batch_id, pos, type, name, content, dataUrl)``,
    ``errors(batch_id, pos, code, message)`` with the cap error at pos -1, and one status
    row per batch.  A batch yields at most one error per slot and one for the cap, which
    is what bounds the arrays built for the status.
    """
    examined = examine_files(files, max_per_batch, max_bytes, max_chars)
    sizes = batch_sizes(files, max_per_batch)
    is_image = F.col("kind") == "image"

    attached = examined.where(F.col("code").isNull()).select(
        "batch_id",
        "pos",
        F.when(is_image, "image").otherwise("text").alias("type"),
        "name",
        "content",
        F.when(is_image, F.col("data_url")).alias("dataUrl"),
    )
    file_errors = examined.where(F.col("code").isNotNull()).select(
        "batch_id", F.col("pos").cast("long").alias("pos"), "code", file_error(F.col("name"), F.col("code"), max_bytes).alias("message")
    )
    cap_errors = sizes.where("over_cap").select(
        "batch_id", F.lit(-1).cast("long").alias("pos"), F.lit("over_cap").alias("code"),
        F.lit(cap_error(max_per_batch)).alias("message"),
    )

    per_batch = examined.groupBy("batch_id").agg(
        F.count_if(F.col("code").isNull()).alias("attached"),
        F.array_sort(
            F.collect_list(
                F.when(F.col("code").isNotNull(),
                       F.struct("pos", file_error(F.col("name"), F.col("code"), max_bytes).alias("message")))
            )
        )["message"].alias("found"),
    )
    none = F.array().cast("array<string>")
    over = F.when(F.col("over_cap"), F.array(F.lit(cap_error(max_per_batch)))).otherwise(none)
    joined = (
        sizes.join(per_batch, "batch_id", "left")
        .select(
            "batch_id",
            "n_files",
            F.coalesce("attached", F.lit(0)).alias("attached"),
            F.concat(over, F.coalesce("found", none)).alias("all_errors"),
        )
    )
    n_errors = F.size("all_errors")
    status = (
        F.when(F.col("attached") > 0,
               F.concat(F.col("attached").cast("string"), F.lit(ATTACHED)))
        .when(n_errors > 0, F.lit(NONE_ATTACHED))
        .otherwise(F.lit(""))
    )
    more = F.when(n_errors > SHOWN_ERRORS,
                  F.array(F.concat(F.lit(MORE_ERRORS[0]), (n_errors - SHOWN_ERRORS).cast("string"), F.lit(MORE_ERRORS[1]))))
    batch_status = joined.select(
        "batch_id",
        "n_files",
        "attached",
        n_errors.cast("long").alias("errors"),
        status.alias("status"),
        F.array_join(F.concat(F.slice("all_errors", 1, SHOWN_ERRORS), F.coalesce(more, none)), "\n").alias("shown_errors"),
    )
    return Attachments(attached, file_errors.unionByName(cap_errors), batch_status)


def for_messages(attached: DataFrame) -> DataFrame:
    """(batch_id, attachments): what a message sends along, in order, as requests need it.

    A batch has no more attachments than slots, so the arrays are that short.
    """
    one = F.struct("pos", "type", "name", "content", "dataUrl")
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda a: a.dropFields("pos"))
    return attached.groupBy("batch_id").agg(ordered.alias("attachments"))


def remove_attachment(attachments, index: int) -> Column:
    """The list without the element at the 0-based ``index``."""
    return F.filter(attachments, lambda _, i: i != index)


def join_pages(pages: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Text of each document from its pages (file_id, page_no, text): joined by newlines
    in page order, trimmed, cut to ``max_chars``.  Returns (file_id, text).

    Page numbers may have gaps of any size; pages without a number come last, and pages of
    one number are ordered by their texts.  From the first page with text on, each page adds
    at least its newline, so a page is needed only if at most ``max_chars`` characters stand
    before it.  Which ones those are is found without the texts: lengths are summed up by
    stretches of ``STRETCH`` page numbers, and the stretches of a document in order, as far as
    ``max_chars`` goes.  Only pages up to that stretch meet.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = pages.select("file_id", F.coalesce(F.col("page_no").cast("long"), F.lit(LAST)).alias("no"), text.alias("text"))
    stretch = F.floor(F.col("no") / STRETCH)
    with_text = F.when(js_trim("text") != "", F.col("no"))
    told = stored(keyed.groupBy("file_id", stretch.alias("stretch")).agg(
        F.min(with_text).alias("first"), F.max(with_text).alias("last"), F.count("*").alias("n"),
        F.sum(F.char_length("text") + 1).alias("chars")), "page-stretches")
    bounds = told.groupBy("file_id").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    # Documents too long to be taken whole: stretches behind the first one with text count in full.
    long_ = told.join(bounds.where(F.col("chars") > max_chars).select("file_id", F.floor(F.col("first") / STRETCH).alias("opens")), "file_id")
    in_order = W.partitionBy("file_id").orderBy("stretch")
    counted = F.when(F.col("stretch") > F.col("opens"), F.col("chars")).otherwise(F.lit(0))
    summed = long_.where(F.col("stretch") >= F.col("opens")).select(
        "file_id", "stretch", "n", F.row_number().over(in_order).alias("rank"),
        (F.sum(counted).over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow)) - counted).alias("before"))
    cut = summed.where((F.col("rank") <= max_chars + 2) & (F.col("before") <= max_chars)).groupBy("file_id").agg(
        F.max("stretch").alias("upto"), F.sum("n").alias("held"))
    info = stored(bounds.join(cut, "file_id", "left"), "page-bounds")
    located = spread_join(keyed, info, "file_id", ["no"]).where(
        F.col("no").between(F.col("first"), F.col("last")) & (F.col("upto").isNull() | (stretch <= F.col("upto"))))
    # Trim where the whole text is trimmed, before cutting: the cut must not turn blanks
    # that were inside the text into its end.
    left = F.when(F.col("no") == F.col("first"), F.ltrim("text", F.lit(WHITESPACE))).otherwise(F.col("text"))
    both = F.when(F.col("no") == F.col("last"), F.rtrim(left, F.lit(WHITESPACE))).otherwise(left)
    short = located.select("file_id", "no", F.substring(both, 1, max_chars).alias("text"), "held")

    def joined(rows: DataFrame, *count: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("no", "text", *count)))
        pieces = F.flatten(F.transform(ordered, lambda p: F.array_repeat(
            p["text"], F.least(p["n"], F.lit(max_chars + 1)).cast("int")))) if count else ordered["text"]
        return rows.groupBy("file_id").agg(js_slice(F.array_join(pieces, "\n"), max_chars).alias("text"))

    # More pages than stretches have numbers: pages of one number, many of them equal perhaps.
    # Equal ones fold to one with a count.
    crowded = F.coalesce(F.col("held") > max_chars + 3 * STRETCH, F.lit(False))
    texts = joined(short.where(~crowded))
    if not info.where(crowded).isEmpty():
        texts = texts.unionByName(joined(short.where(crowded).groupBy("file_id", "no", "text").agg(F.count("*").alias("n")), "n"))
    blank = info.where(F.col("first").isNull()).select("file_id", F.lit("").alias("text"))
    return texts.unionByName(blank)
