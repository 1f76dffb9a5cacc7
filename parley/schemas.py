"""Table schemas of the conversation model.

Ids are BIGINT here; they may equally be STRING (UUIDs): no operator looks inside an id.
"""

from pyspark.sql import types as T

PROFILES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("email", T.StringType(), False),
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("grade_year", T.StringType()),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
])

CHAT_SESSIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
])

CHAT_MESSAGES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("session_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])

# A message as a client asks to save it, with the identity the login gave it.
INCOMING_MESSAGES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("email", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

SIGNUPS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("email", T.StringType()),
    T.StructField("user_metadata", T.StringType()),
])

ATTACHMENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("dataUrl", T.StringType()),
])

# Body of an "ask" call.
ASK_PAYLOAD = T.StructType([
    T.StructField("message", T.StringType()),
    T.StructField("attachments", T.ArrayType(ATTACHMENT)),
])

# Body of a "save message" call.
SAVE_PAYLOAD = T.StructType([
    T.StructField("sessionId", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

# Body of a "create or rename session" call.
SESSION_PAYLOAD = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("updateId", T.StringType()),
])

# Column names as they stand in the CSV header; sources.tables renames them.
USAGE_LOG = T.StructType([
    T.StructField("Timestamp", T.TimestampType()),
    T.StructField("Model", T.StringType()),
    T.StructField("InputTokens", T.LongType()),
    T.StructField("OutputTokens", T.LongType()),
    T.StructField("Cost($)", T.DecimalType(18, 6)),
    T.StructField("Duration(ms)", T.LongType()),
    T.StructField("Status", T.StringType()),
    T.StructField("CacheType", T.StringType()),
])

REFRESH_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("force", T.BooleanType()),
])

# Model requests as they are sent and responses as they are received, each with its time.
SENT_REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("attachments", T.ArrayType(ATTACHMENT)),
    T.StructField("sent_at", T.TimestampType()),
])

RECEIVED_RESPONSES = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("attempt", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
])

TABLES = {
    "profiles": PROFILES,
    "chat_sessions": CHAT_SESSIONS,
    "chat_messages": CHAT_MESSAGES,
    "incoming_messages": INCOMING_MESSAGES,
    "signups": SIGNUPS,
    "refresh_events": REFRESH_EVENTS,
    "sent_requests": SENT_REQUESTS,
    "received_responses": RECEIVED_RESPONSES,
}
