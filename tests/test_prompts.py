import json

from parley.operators import prompts as P
from parley.schemas import ATTACHMENT

SCHEMA = "request_id long, message string, attachments array<" + ATTACHMENT.simpleString() + ">"


def text_file(name, content):
    return ("text", name, content, None)


def image(name, url):
    return ("image", name, None, url)


def requests(spark, *rows):
    return spark.createDataFrame([(i, m, a) for i, (m, a) in enumerate(rows)], SCHEMA)


def bodies(df):
    return {r.request_id: json.loads(r.body) for r in df.collect()}


def test_text_request(spark):
    files = [text_file(None, "one"), text_file("empty", ""), image("i", ""), text_file("b", "two")]
    df = P.assemble_requests(requests(spark, ("hi", files), ("plain \"quoted\"\n", []), ("", []), ("no list", None)))
    body = bodies(df)
    assert sorted(body) == [0, 1, 3]
    assert body[0] == {
        "model": "llama-3.1-8b-instant",
        "messages": [
            {"role": "system", "content": P.SYSTEM_PROMPT},
            {"role": "user", "content": "hi\n\nAttached references:\n(1) Attachment:\none\n\n(2) b:\ntwo"},
        ],
        "temperature": 0.7,
        "max_tokens": 1024,
    }
    assert list(body[0]) == ["model", "messages", "temperature", "max_tokens"]
    assert body[1]["messages"][1]["content"] == 'plain "quoted"\n'


def test_vision_request(spark):
    files = [image("a", "data:1"), text_file("t", "x" * 9000), image(None, "data:2")]
    df = P.assemble_requests(requests(spark, ("look", files)))
    row = df.first()
    assert row.is_vision and row.model == P.VISION_MODEL
    body = json.loads(row.body)
    assert body["model"] == P.VISION_MODEL
    assert body["messages"][0]["content"] == P.SYSTEM_PROMPT + P.VISION_PROMPT
    assert body["messages"][1] == {
        "role": "user",
        "content": [
            {"type": "text", "text": "look\n\nAttached references:\n(1) t:\n" + "x" * 8000},
            {"type": "image_url", "image_url": {"url": "data:1"}},
            {"type": "image_url", "image_url": {"url": "data:2"}},
        ],
    }
    assert (body["temperature"], body["max_tokens"]) == (0.7, 1024)


def test_invalid_requests(spark):
    got = P.invalid_requests(requests(spark, ("", []), (None, []), ("x", []))).collect()
    assert sorted(tuple(r) for r in got) == [(0, 400, "Message is required"), (1, 400, "Message is required")]


def test_outgoing(spark):
    drafts = spark.createDataFrame(
        [(0, " hi ", []), (1, " \n", [("text", "a", "x", None)]), (2, "", []), (3, None, None)],
        "id long, text string, attachments array<" + ATTACHMENT.simpleString() + ">",
    )
    got = {r.id: (r.message, r.shown) for r in P.outgoing_messages(drafts).collect()}
    assert got == {
        0: ("hi", "hi"),
        1: (P.ANALYZE, "[Sent 1 attachment(s)] Please analyze the attached files."),
    }


def answer(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


def test_resolution(spark):
    pic, none = [image("p.png", "data:1"), image("", "data:2")], []
    asked = requests(spark, *[("m", pic if i < 5 else none) for i in range(16)])
    error = json.dumps({"error": {"message": "down"}})
    primary = {
        0: error, 1: error, 2: error, 3: answer(" ok "), 4: "{broken",
        5: error, 6: json.dumps({"error": {}}), 7: answer(""), 8: answer(None), 9: "{}", 10: "null",
        11: json.dumps({"error": None, "choices": [{"message": {"content": "fine"}}]}),
        12: json.dumps({"error": "text"}), 13: json.dumps({"error": False}), 14: json.dumps({"choices": []}),
    }
    fallback = {1: answer("second"), 2: error, 3: answer("unused")}
    responses = spark.createDataFrame(
        [(k, "primary", v) for k, v in primary.items()] + [(k, "fallback", v) for k, v in fallback.items()],
        "request_id long, attempt string, body string",
    )
    got = {r.request_id: (r.outcome, r.text) for r in P.resolve_responses(asked, responses).collect()}
    assert got == {
        0: ("fallback", None), 1: ("answer", "second"), 2: ("error", "down"), 3: ("answer", "ok"),
        4: ("error", P.INTERNAL_ERROR), 5: ("error", "down"), 6: ("error", "API Error"),
        7: ("answer", P.NO_RESPONSE), 8: ("answer", P.NO_RESPONSE), 9: ("answer", P.NO_RESPONSE),
        10: ("error", P.INTERNAL_ERROR), 11: ("answer", "fine"), 12: ("error", "API Error"),
        13: ("answer", P.NO_RESPONSE), 14: ("answer", P.NO_RESPONSE), 15: ("pending", None),
    }
    again = bodies(P.fallback_requests(asked, responses))
    assert sorted(again) == [0, 1, 2]
    assert again[0]["model"] == P.TEXT_MODEL
    assert again[0]["messages"][0]["content"] == P.SYSTEM_PROMPT
    assert again[0]["messages"][1]["content"] == "m\n\nImage attachments: p.png, image"


def test_a_response_that_comes_again(spark):
    asked = requests(spark, ("m", []))
    twice = spark.createDataFrame(
        [(0, "primary", answer("late"), 2), (0, "primary", answer("first"), 1)],
        "request_id long, attempt string, body string, received_at int")
    assert [(r.outcome, r.text) for r in P.resolve_responses(asked, twice).collect()] == [("answer", "first")]
    assert P.resolve_responses(asked, twice.drop("received_at")).count() == 1


def test_preview(spark):
    df = requests(spark, ("m", [text_file("t", "secret"), image("i", "data:1")]))
    got = df.select(P.attachment_preview("attachments").alias("p"), P.has_images("attachments").alias("h")).first()
    assert [tuple(a) for a in got.p] == [("text", "t", None), ("image", "i", "data:1")] and got.h


def test_requests_are_built_without_a_shuffle(spark):
    plan = P.assemble_requests(requests(spark, ("m", [])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_responses_are_narrow_before_the_join(spark):
    asked = requests(spark, ("m", []))
    responses = spark.createDataFrame([], "request_id long, attempt string, body string")
    plan = P.resolve_responses(asked, responses)._jdf.queryExecution().optimizedPlan().toString()
    joins = plan[: plan.index("Join")]
    assert "attachments" not in joins and "message#" not in joins
