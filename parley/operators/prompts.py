"""Model requests in bulk: assembly, routing, response resolution, fallback.

A request carries its attachments as an array, at most ``attachments.MAX_ATTACHMENTS`` of
them by the intake rule, so a request is built inside its row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions.text import _col, falsy, js_slice, js_trim, or_else
from parley.operators.attachments import MAX_CHARS

# Models, wording and sampling settings of a request.
TEXT_MODEL = "llama-3.1-8b-instant"
VISION_MODEL = "meta-llama/llama-4-scout-17b-16e-instruct"
SYSTEM_PROMPT = (
    "You are a friendly and helpful study buddy who helps students learn and understand "
    "complex topics. Provide clear, concise, and encouraging responses."
)
VISION_PROMPT = " If images are attached, describe what you can see and explain clearly."
TEMPERATURE = 0.7
MAX_TOKENS = 1024
NO_RESPONSE = "No response received"
API_ERROR = "API Error"
INTERNAL_ERROR = "Internal server error"
MESSAGE_REQUIRED = "Message is required"
ANALYZE = "Please analyze the attached file(s) and summarize the key points clearly."


def text_attachments(attachments) -> Column:
    return F.filter(_col(attachments), lambda a: (a["type"] == "text") & ~falsy(a["content"]))


def image_attachments(attachments) -> Column:
    return F.filter(_col(attachments), lambda a: (a["type"] == "image") & ~falsy(a["dataUrl"]))


def has_images(attachments) -> Column:
    found = F.exists(_col(attachments), lambda a: (a["type"] == "image") & ~falsy(a["dataUrl"]))
    return F.coalesce(found, F.lit(False))


def attachment_preview(attachments) -> Column:
    """What is kept with a shown message: an image keeps its data, a text only its name."""
    return F.transform(
        _col(attachments),
        lambda a: F.when(
            a["type"] == "image",
            F.struct(F.lit("image").alias("type"), a["name"].alias("name"), a["dataUrl"].alias("dataUrl")),
        ).otherwise(
            F.struct(F.lit("text").alias("type"), a["name"].alias("name"), F.lit(None).cast("string").alias("dataUrl"))
        ),
    )


def outgoing_messages(drafts: DataFrame) -> DataFrame:
    """Drafts (text, attachments) that can be sent, with ``message`` for the model and
    ``shown`` for the conversation.  A blank draft without attachments is skipped."""
    n = F.coalesce(F.size("attachments"), F.lit(0))
    return (
        drafts.withColumn("trimmed", F.coalesce(js_trim("text"), F.lit("")))
        .where((F.col("trimmed") != "") | (n > 0))
        .withColumn("message", or_else("trimmed", F.lit(ANALYZE)))
        .withColumn(
            "shown",
            or_else("trimmed", F.concat(F.lit("[Sent "), n.cast("string"),
                                        F.lit(" attachment(s)] Please analyze the attached files."))),
        )
        .drop("trimmed")
    )


def image_names(images) -> Column:
    return F.array_join(F.transform(images, lambda a: or_else(a["name"], F.lit("image"))), ", ")


def reference_list(texts) -> Column:
    """Numbered references; numbers count the references that are left after filtering."""
    return F.array_join(
        F.transform(
            texts,
            lambda a, i: F.concat(
                F.lit("("), (i + 1).cast("string"), F.lit(") "),
                or_else(a["name"], F.lit("Attachment")), F.lit(":\n"),
                js_slice(a["content"], MAX_CHARS),
            ),
        ),
        "\n\n",
    )


def _composed(requests: DataFrame) -> DataFrame:
    """Valid requests with their parts.  Each step is used more than once by the next, so
    the optimizer keeps the steps apart and computes each part once."""
    return (
        requests.where(~falsy("message"))
        .withColumn("texts", F.coalesce(text_attachments("attachments"), F.array().cast(_array_type(requests))))
        .withColumn("images", F.coalesce(image_attachments("attachments"), F.array().cast(_array_type(requests))))
        .withColumn("references", reference_list(F.col("texts")))
        .withColumn(
            "user_text",
            F.when(F.size("texts") > 0,
                   F.concat("message", F.lit("\n\nAttached references:\n"), "references"))
            .otherwise(F.col("message")),
        )
        .withColumn("is_vision", F.size("images") > 0)
    )


def _array_type(requests: DataFrame):
    return requests.schema["attachments"].dataType


def _body(model, messages) -> Column:
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            messages.alias("messages"),
            F.lit(TEMPERATURE).alias("temperature"),
            F.lit(MAX_TOKENS).alias("max_tokens"),
        )
    )


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def text_body(user_text: Column) -> Column:
    return _body(TEXT_MODEL, F.array(_turn("system", F.lit(SYSTEM_PROMPT)), _turn("user", user_text)))


def vision_body(user_text: Column, images: Column) -> Column:
    """The user turn is a list of parts here, so the two turns differ in type: the system
    turn is written as JSON of its own.  Fields that are NULL are left out of the JSON."""
    none = F.lit(None).cast("string")
    no_image = F.lit(None).cast("struct<url:string>")
    text_part = F.struct(F.lit("text").alias("type"), user_text.alias("text"), no_image.alias("image_url"))
    image_parts = F.transform(
        images,
        lambda a: F.struct(
            F.lit("image_url").alias("type"), none.alias("text"),
            F.struct(a["dataUrl"].alias("url")).alias("image_url"),
        ),
    )
    system = F.to_json(_turn("system", F.lit(SYSTEM_PROMPT + VISION_PROMPT)))
    user = F.to_json(_turn("user", F.concat(F.array(text_part), image_parts)))
    settings = F.to_json(F.struct(F.lit(TEMPERATURE).alias("temperature"), F.lit(MAX_TOKENS).alias("max_tokens")))
    return F.concat(
        F.lit(f'{{"model":"{VISION_MODEL}","messages":['), system, F.lit(","), user, F.lit("],"),
        F.substring(settings, 2, 1000),
    )


def assemble_requests(requests: DataFrame) -> DataFrame:
    """(request_id, model, is_vision, body): the first request of every valid call."""
    return _composed(requests).select(
        "request_id",
        F.when(F.col("is_vision"), VISION_MODEL).otherwise(TEXT_MODEL).alias("model"),
        "is_vision",
        F.when(F.col("is_vision"), vision_body(F.col("user_text"), F.col("images")))
        .otherwise(text_body(F.col("user_text"))).alias("body"),
    )


def invalid_requests(requests: DataFrame) -> DataFrame:
    return requests.where(falsy("message")).select(
        "request_id", F.lit(400).alias("status"), F.lit(MESSAGE_REQUIRED).alias("reason")
    )


def read_response(body) -> Column:
    """STRUCT<state, text> of one response body; ``state`` is ok, error or unreadable.

    The body is parsed once, into a VARIANT.
    """
    v = F.try_parse_json(_col(body))
    return read_parsed(v)


def read_parsed(v: Column) -> Column:
    error = F.try_variant_get(v, "$.error", "variant")
    kind = F.schema_of_variant(error)
    as_text = F.try_variant_get(v, "$.error", "string")
    failed = (
        F.when(error.isNull() | (kind == "VOID"), False)
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), True)
        .when(kind == "STRING", as_text != "")
        .otherwise(~F.coalesce(as_text, F.lit("0")).isin("false", "0"))
    )
    state = (
        F.when(v.isNull() | F.is_variant_null(v), "unreadable")
        .when(failed, "error")
        .otherwise("ok")
    )
    message = or_else(F.try_variant_get(v, "$.error.message", "string"), F.lit(API_ERROR))
    answer = or_else(F.try_variant_get(v, "$.choices[0].message.content", "string"), F.lit(NO_RESPONSE))
    text = (
        F.when(state == "ok", or_else(js_trim(answer), F.lit(NO_RESPONSE)))
        .when(state == "error", message)
        .otherwise(F.lit(INTERNAL_ERROR))
    )
    return F.struct(state.alias("state"), text.alias("text"))


def _attempt(responses: DataFrame, attempt: str) -> DataFrame:
    """The first response to each request's attempt: by ``received_at`` where there is one,
    then by a hash of the body.  A response that is delivered again does not give a second outcome."""
    at = [F.col("received_at")] if "received_at" in responses.columns else []
    read = (
        responses.where(F.col("attempt") == attempt)
        .select("request_id", F.struct(*at, F.xxhash64("body")).alias("arrival"), F.try_parse_json("body").alias("v"))
        .select("request_id", "arrival", read_parsed(F.col("v")).alias(attempt))
    )
    return read.groupBy("request_id").agg(F.min_by(attempt, "arrival").alias(attempt))


def needs_fallback(is_vision, state) -> Column:
    """Only a failed request with images is tried again, without the images."""
    return _col(is_vision) & (_col(state) == "error")


def resolve_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(request_id, outcome, text) of every valid request.

    ``outcome``: answer, error, fallback (a fallback request has to be sent) or pending
    (no response yet).  Only the id and the image flag of a request take part in the join,
    and responses are reduced to state and text before it; both joins use one
    partitioning of the requests.
    """
    asked = requests.where(~falsy("message")).select("request_id", has_images("attachments").alias("is_vision"))
    paired = (
        asked.join(_attempt(responses, "primary"), "request_id", "left")
        .join(_attempt(responses, "fallback"), "request_id", "left")
    )
    return outcomes(paired)


def outcomes(paired: DataFrame) -> DataFrame:
    """(request_id, outcome, text) of requests with ``is_vision`` and what came back to their
    ``primary`` and ``fallback`` attempts (STRUCT<state, text>, or NULL)."""
    again = F.coalesce(needs_fallback("is_vision", "primary.state"), F.lit(False))
    final = F.when(again, F.col("fallback")).otherwise(F.col("primary"))
    settled = paired.select("request_id", again.alias("again"), final.alias("final"))
    outcome = (
        F.when(F.col("final").isNull(), F.when(F.col("again"), "fallback").otherwise("pending"))
        .when(F.col("final.state") == "ok", "answer")
        .otherwise("error")
    )
    return settled.select("request_id", outcome.alias("outcome"), F.col("final.text").alias("text"))


def fallback_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(request_id, model, body) of the text-only second attempts.

    Requests without images are dropped before the join.
    """
    failed = (
        _attempt(responses, "primary").where(F.col("primary.state") == "error").select("request_id")
    )
    vision = requests.where(has_images("attachments")).join(failed, "request_id", "left_semi")
    return (
        _composed(vision)
        .withColumn("names", image_names(F.col("images")))
        .select(
            "request_id",
            F.lit(TEXT_MODEL).alias("model"),
            text_body(F.concat("user_text", F.lit("\n\nImage attachments: "), "names")).alias("body"),
        )
    )
