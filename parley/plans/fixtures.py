"""Model tables derived from the given test tables.

Whole tables go in; a rule on a column decides what kind of row comes out, and no row is
left out to make a check cheaper.  ``oracle.VIEWS`` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.plans.explode import explode_rows
from parley.schemas import ATTACHMENT
from parley.session import configure

T0 = 1704067200  # 2024-01-01 00:00:00 UTC
NOW = "2024-06-01 12:00:00"
SCHEMAS: dict = {}
EXTENSIONS = [
    ".txt", ".MD", ".csv", ".json", ".js", ".ts", ".py", ".java", ".html", ".css", ".pdf", ".docx",
    ".png", ".JPG", ".jpeg", ".webp", ".gif", ".bmp", ".zip",
]
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def now() -> Column:
    return F.timestamp_seconds(F.lit(T0)) + F.expr("INTERVAL '152 12:00:00' DAY TO SECOND")


def text(c) -> Column:
    return F.col(c).cast("string")


def pick(c: Column, n: int, cases: dict, default: Column) -> Column:
    """``default`` except where ``c`` modulo ``n`` has a case of its own."""
    out = default
    for rest, value in cases.items():
        out = F.when(c % n == rest, value).otherwise(out)
    return out


class Tables:
    """The model tables of one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def schema(self, name: str):
        """Read from the file once; a look at the footer is a Spark job of its own."""
        path = f"{self.folder}/{name}.parquet"
        if path not in SCHEMAS:
            SCHEMAS[path] = self.spark.read.parquet(path).schema
        return SCHEMAS[path]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).parquet(f"{self.folder}/{name}.parquet")

    # --- conversations -------------------------------------------------------------

    def messages(self) -> DataFrame:
        return self.raw("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
            F.col("conv_id").alias("session_id"),
            (F.col("conv_id") % 10).alias("user_id"),
            "role",
            F.col("text").alias("content"),
            F.timestamp_seconds(T0 + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_at"),
        )

    def sessions(self) -> DataFrame:
        conv = F.col("conv_id")
        title = pick(conv, 11, {0: F.lit(None).cast("string")}, pick(conv, 7, {0: F.lit("")}, F.lit("New Chat")))
        at = F.timestamp_seconds(T0 + conv * 3600)
        return self.raw("conversations").select("conv_id").distinct().select(
            conv.alias("id"), (conv % 10).alias("user_id"), title.alias("title"),
            at.alias("created_at"), at.alias("updated_at"),
        )

    def incoming(self) -> DataFrame:
        """Save requests: turn 3 by a stranger, 4 to no session, 5 empty, 6 not signed in."""
        turn = F.col("id") % 1000
        return self.messages().select(
            "id",
            F.when(turn == 4, F.col("session_id") + 1000000).otherwise(F.col("session_id")).alias("session_id"),
            F.when(turn == 3, F.col("user_id") + 1).when(turn != 6, F.col("user_id")).alias("user_id"),
            pick(F.col("session_id"), 3, {0: F.lit("")},
                 F.concat(F.lit("user"), text("user_id"), F.lit("@example.com"))).alias("email"),
            "role",
            F.when(turn == 5, F.lit("")).otherwise(F.col("content")).alias("content"),
            "created_at",
        )

    def title_changes(self) -> DataFrame:
        """A new title, the title on display, blanks, and a change by a stranger."""
        ident = F.col("id")
        shown = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled chat"))
        title = pick(ident, 4, {1: shown, 2: F.lit("   "), 3: F.concat(F.lit("Wrong "), text("id"))},
                     F.concat(F.lit(" Chat "), text("id")))
        return self.sessions().select(
            "id", F.when(ident % 4 == 3, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
            title.alias("title"),
        )

    def title_edits(self) -> DataFrame:
        """Title changes in order, every fifth session changed twice."""
        second = self.title_changes().where(F.col("id") % 5 == 0).select(
            "id", "user_id", F.concat(F.lit("Again "), text("id")).alias("title"), F.lit(2).alias("seq"))
        return self.title_changes().withColumn("seq", F.lit(1)).unionByName(second)

    def session_requests(self) -> DataFrame:
        """Requests to open or retitle sessions: by owners, strangers and nobody."""
        ident, owner = F.col("id"), F.col("id") % 10
        return self.title_changes().select(
            ident.alias("request_id"),
            pick(ident, 8, {7: F.lit(None).cast("long")}, F.col("user_id")).alias("user_id"),
            F.concat(F.lit("s"), owner.cast("string"), F.lit("@example.com")).alias("email"),
            "title",
            pick(ident, 3, {0: F.lit(None).cast("long")}, ident).alias("update_id"),
        )

    def session_delete_keys(self) -> DataFrame:
        """Own sessions, sessions of others and missing ones."""
        rest = F.col("id") % 5
        return self.sessions().select(
            F.when(rest.isin(2, 4), F.col("id") + 1000000).otherwise(F.col("id")).alias("id"),
            F.when(rest.isin(1, 3), F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        )

    def replies(self) -> DataFrame:
        """Messages whose line breaks are turned into list markers."""
        marker = F.when(F.col("session_id") % 2 == 0, "\n* ").otherwise("\n1. **x** ")
        return self.messages().withColumn("content", F.replace("content", F.lit("\n"), marker))

    # --- profiles ------------------------------------------------------------------

    def email(self) -> Column:
        return F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("")), F.lit("@example.com"))

    def profiles(self) -> DataFrame:
        key = F.col("c_custkey")
        at = F.timestamp_seconds(F.lit(T0))
        none = F.lit(None).cast("string")
        return self.raw("customer").select(
            key.alias("id"),
            self.email().alias("email"),
            pick(key, 4, {0: F.lit("")}, F.col("c_mktsegment")).alias("first_name"),
            none.alias("last_name"),
            (key % 60).cast("int").alias("age"),
            none.alias("gender"),
            none.alias("grade_year"),
            at.alias("created_at"),
            at.alias("updated_at"),
        )

    def signups(self) -> DataFrame:
        key = F.col("c_custkey")
        age = pick(key, 7, {
            0: F.concat(F.lit(',"age":"'), (key % 60).cast("string"), F.lit('"')),
            1: F.lit(',"age":""'),
            2: F.lit(""),
            3: F.lit(',"age":"12abc"'),
            4: F.lit(',"age":"-5"'),
            5: F.lit(',"age":"99999999999"'),
        }, F.concat(F.lit(',"age":'), (key % 60).cast("string")))
        metadata = F.concat(
            F.lit('{"first_name":"'), F.col("c_mktsegment"), F.lit('","last_name":"'),
            pick(key, 3, {0: F.lit("")}, F.concat(F.lit("Name "), key.cast("string"))), F.lit('"'),
            age,
            pick(key, 5, {0: F.lit(',"gender":null'), 1: F.lit("")}, F.lit(',"gender":"other"')),
            F.lit(',"grade_year":"'), (key % 12 + 1).cast("string"), F.lit('"}'),
        )
        return self.raw("customer").select(
            key.alias("id"), self.email().alias("email"), metadata.alias("user_metadata")
        )

    def profile_changes(self) -> DataFrame:
        """A change log with many changes per profile, from the orders of a customer."""
        order, customer = F.col("o_orderkey"), F.col("o_custkey")
        return self.raw("orders").select(
            F.when(order % 97 != 0, pick(customer, 7, {6: customer + 1000000}, customer)).alias("id"),
            pick(order, 5, {0: F.lit(None).cast("string"), 1: F.lit("")},
                 F.concat(F.lit("o"), order.cast("string"), F.lit("@example.com"))).alias("email"),
            order.alias("seq"),
            pick(order, 10, {0: F.lit("upsert"), 1: F.lit("upsert"), 2: F.lit("delete")}, F.lit("update")).alias("op"),
        )

    def profile_delete_keys(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            F.when((key % 10).isin(1, 2), key).otherwise(key + 1000000).alias("id")
        )

    # --- tables that break constraints ---------------------------------------------

    def dirty_profiles(self) -> DataFrame:
        ident = F.col("id")
        copies = pick(ident, 50, {30: F.array(F.lit(1), F.lit(2))}, F.array(F.lit(1)))
        return self.profiles().withColumn(
            "email", pick(ident, 50, {10: F.lit("customer000000000@example.com"), 20: F.lit(None).cast("string")},
                          F.col("email"))
        ).withColumn("copy", F.explode(copies)).drop("copy")

    def dirty_sessions(self) -> DataFrame:
        ident = F.col("id")
        return self.sessions().withColumn(
            "user_id", pick(ident, 9, {0: F.lit(None).cast("long"), 1: F.col("user_id") + 5000000}, F.col("user_id"))
        ).withColumn("created_at", pick(ident, 13, {0: F.lit(None).cast("timestamp")}, F.col("created_at")))

    def dirty_messages(self) -> DataFrame:
        turn = F.col("id") % 1000
        session = F.col("session_id")
        return self.messages().select(
            "id",
            F.when(turn == 7, session + 9000000).otherwise(session).alias("session_id"),
            F.when((turn == 2) & (session % 4 == 0), F.col("user_id") + 5000000)
            .otherwise(F.col("user_id")).alias("user_id"),
            "role",
            pick(F.col("id"), 17, {0: F.lit(None).cast("string")}, F.col("content")).alias("content"),
            "created_at",
        )

    # --- files, requests, responses --------------------------------------------------

    def files(self) -> DataFrame:
        doc = F.col("doc_id")
        batch = F.expr("doc_id div 8")
        extension = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (doc % 19 + 1).cast("int"))
        return self.raw("documents").select(
            batch.alias("batch_id"),
            (doc % 8).alias("pos"),
            F.concat(F.lit("doc"), text("doc_id"), extension).alias("name"),
            pick(doc, 13, {0: F.lit("text/plain"), 1: F.lit("application/pdf"), 2: F.lit(DOCX), 3: F.lit("image/tiff"),
                           4: F.lit(None).cast("string")}, F.lit("")).alias("mime"),
            (F.col("n_chars") * 4096).alias("size"),
            pick(doc, 17, {0: F.lit(" \t\n ")}, F.col("text")).alias("text"),
            (batch % 3).cast("int").alias("pending"),
            (doc % 23 == 5).alias("failed"),
            pick(doc, 4, {1: F.lit("")}, F.concat(F.lit("data:image/jpeg;base64,"), text("doc_id"))).alias("data_url"),
        )

    def pages(self) -> DataFrame:
        """Every line of a document as a page; every third document starts with blanks."""
        lines = F.split("text", "\n", -1)
        front = pick(F.col("doc_id"), 3, {0: F.array(F.lit("  "), F.lit(""))}, F.array().cast("array<string>"))
        paged = self.raw("documents").select(F.col("doc_id").alias("file_id"), F.concat(front, lines).alias("pages"))
        return explode_rows(paged, "pages", "page_no", "text")

    def attachments(self) -> DataFrame:
        """Six documents for each conversation, as (session_id, attachments)."""
        doc = F.col("doc_id")
        session = F.expr("doc_id div 6")
        none = F.lit(None).cast("string")
        image = (session % 2 == 0) & (doc % 7 == 5)
        flat = self.raw("documents").select(
            session.alias("session_id"),
            F.struct(
                doc.alias("pos"),
                F.when(image, "image").otherwise("text").alias("type"),
                pick(doc, 9, {0: none}, F.concat(F.lit("doc"), text("doc_id"))).alias("name"),
                F.when(~image, pick(doc, 17, {0: F.lit("")}, F.col("text"))).alias("content"),
                F.when(image, pick(doc, 4, {1: F.lit("")},
                                   F.concat(F.lit("data:image/jpeg;base64,"), text("doc_id")))).alias("dataUrl"),
            ).alias("a"),
        )
        # At most six per group, by the rule of the key.
        ordered = F.transform(F.array_sort(F.collect_list("a")), lambda a: a.dropFields("pos"))
        return flat.groupBy("session_id").agg(ordered.alias("attachments"))

    def drafts(self) -> DataFrame:
        """User turns as typed, some blank; the first of a conversation has the files."""
        turns = self.messages().where(F.col("role") == "user")
        first = turns.groupBy("session_id").agg(F.min("id").alias("id")).join(self.attachments(), "session_id")
        none = F.array().cast("array<" + ATTACHMENT.simpleString() + ">")
        typed = F.when((F.col("session_id") + F.col("id") % 1000) % 6 == 5, F.lit(" \t ")).otherwise(F.col("content"))
        return turns.join(first.select("id", "attachments"), "id", "left").select(
            "id", "session_id", "user_id", "created_at", typed.alias("text"),
            F.coalesce("attachments", none).alias("attachments"),
        )

    def responses(self) -> DataFrame:
        """Model responses from the assistant turns: answers, errors and broken bodies."""
        def body(content):
            message = F.struct(F.struct(content.alias("content")).alias("message"))
            return F.to_json(F.struct(F.array(message).alias("choices")))

        conv = F.col("session_id")
        error = pick(conv, 12, {0: F.lit('{"error":{}}')}, F.lit('{"error":{"message":"model overloaded"}}'))
        turns = self.messages().where(F.col("role") == "assistant")
        primary = (
            F.when((conv % 6).isin(0, 1), error)
            .when(conv % 10 == 2, body(F.lit("")))
            .when(conv % 15 == 14, F.lit("<html>bad gateway</html>"))
            .otherwise(body(F.col("content")))
        )
        fallback = F.when(conv % 18 == 0, F.lit('{"error":{"message":"still down"}}')).otherwise(
            body(F.concat(F.lit(" Fallback: "), "content"))
        )
        return turns.select(
            (F.col("id") - 1).alias("request_id"),
            F.explode(
                F.array_compact(F.array(
                    F.struct(F.lit("primary").alias("attempt"), primary.alias("body")),
                    F.when(conv % 6 == 0, F.struct(F.lit("fallback").alias("attempt"), fallback.alias("body"))),
                ))
            ).alias("r"),
        ).select("request_id", "r.attempt", "r.body")

    def received_responses(self) -> DataFrame:
        """The responses with their times: some primaries and fallbacks come long after the
        others, and a fifth of the requests is answered again, in other words."""
        ident = F.col("request_id")
        sent = T0 + F.floor(ident / 1000) * 3600 + ident % 1000 * 60
        seconds = F.when(F.col("attempt") == "primary", F.when(ident % 7 == 0, 2700).otherwise(20)).otherwise(
            F.when(ident % 13 == 0, 2400).otherwise(60))
        first = self.responses().withColumn("received_at", F.timestamp_seconds(sent + seconds))
        again = first.where(ident % 5 == 0).withColumns({
            "body": F.lit('{"choices":[{"message":{"content":"answered again"}}]}'),
            "received_at": F.col("received_at") + F.expr("INTERVAL 5 SECONDS"),
        })
        return first.unionByName(again)

    # --- events and images -------------------------------------------------------------

    def refresh_events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
            (F.col("event_type") == "signup").alias("force"),
        )

    def images(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            (F.col("p_size") * 100).cast("long").alias("width"),
            (F.col("p_partkey") % 3000 + 1).alias("height"),
        )
