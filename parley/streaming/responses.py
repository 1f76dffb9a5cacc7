"""Pairing of requests with responses while both arrive.

A request waits for its responses until ``timeout`` after it was sent.  The pairing is a
stream-stream outer join on the request and that stretch of time, so its state holds no
more than the stretch and the watermarks' delay; when the watermark has passed a request's
time, its first responses (by ``received_at``, as in the batch form) decide the outcome, once.
A request that got none in time comes out as ``pending``, one whose fallback did not come in
time as ``fallback``.

State is kept by request, and a request has few responses: no key is hot.  Responses that
come after the time-out, before their request was sent, or behind the watermark do not
count.  The join lets go of a request one batch before the decision is written, so the last
requests come out with the second batch behind their time.  Requests without a message are not paired, and rows without a time or an id pair
with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.functions.text import falsy
from parley.operators.prompts import has_images, outcomes, read_response
from parley.sources.tables import read_or_empty
from parley.streaming.throttle import use_state_store

TIMEOUT = "30 minutes"
DELAY = "10 minutes"
OUTCOMES = "request_id long, outcome string, text string"


def resolved(requests: DataFrame, responses: DataFrame, timeout: str = TIMEOUT, delay: str = DELAY) -> DataFrame:
    """(request_id, outcome, text) of streamed requests (request_id, message, attachments,
    sent_at) and responses (request_id, attempt, body, received_at), in append mode."""
    use_state_store(requests.sparkSession)
    # Rows that are left out do not tell the time: filters go before the watermark in any plan.
    asked = requests.withWatermark("sent_at", delay).where(~falsy("message")).select(
        "request_id", "sent_at", has_images("attachments").alias("is_vision"))
    heard = responses.withWatermark("received_at", delay).where("request_id IS NOT NULL").select(
        F.col("request_id").alias("response_to"), "attempt", "received_at",
        F.xxhash64("body").alias("digest"), read_response("body").alias("read"))
    sent, received = F.col("sent_at"), F.col("received_at")
    in_time = (received >= sent) & (received <= sent + F.expr(f"INTERVAL {timeout}"))
    paired = asked.join(heard, (F.col("response_to") == F.col("request_id")) & in_time, "leftOuter")
    arrival = F.struct("received_at", "digest")
    first = [
        F.min_by("read", F.when(F.col("attempt") == attempt, arrival)).alias(attempt)
        for attempt in ("primary", "fallback")
    ]
    return outcomes(paired.groupBy("request_id", "is_vision", "sent_at").agg(*first))


def resolve_stream(
    requests: DataFrame, responses: DataFrame, out: str, checkpoint: str,
    timeout: str = TIMEOUT, delay: str = DELAY, **trigger
) -> StreamingQuery:
    """Start writing outcomes below ``out``, each request once."""
    return (
        resolved(requests, responses, timeout, delay).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def outcomes_so_far(spark: SparkSession, out: str) -> DataFrame:
    return read_or_empty(spark, OUTCOMES, out)
