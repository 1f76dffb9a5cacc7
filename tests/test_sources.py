import json
import re

import pytest
from pyspark.sql import functions as F

from parley import schemas
from parley.operators import prompts, sessions
from parley.session import checkpoint_dir, size_shuffles
from parley.sources import sinks, tables, uploads


def test_usage_log(spark, tmp_path):
    path = tmp_path / "usage.csv"
    path.write_text(
        # Fixed value: the header of the log.
        "Timestamp,Model,InputTokens,OutputTokens,Cost($),Duration(ms),Status,CacheType\n"
        "2024-01-01T00:00:00Z,m,10,20,0.000125,350,ok,none\n"
    )
    df = tables.read_usage_log(spark, str(path))
    assert df.columns == ["Timestamp", "Model", "InputTokens", "OutputTokens", "Cost", "DurationMs", "Status", "CacheType"]
    row = df.first()
    assert (row.InputTokens, str(row.Cost), row.DurationMs) == (10, "0.000125", 350)
    path.write_text(path.read_text().splitlines()[0] + "\n")
    assert tables.read_usage_log(spark, str(path)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("﻿hé".encode())
    (tmp_path / "sub" / "b.txt").write_bytes(b"x\xffy")
    df = tables.read_files(spark, str(tmp_path))
    got = {r.name: (r.size, r.text) for r in df.withColumn("text", tables.decode_text("content")).collect()}
    assert got == {"a.txt": (6, "hé"), "b.txt": (3, "x�y")}


def test_file_bytes_are_not_read_for_size_tests(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    df = tables.read_files(spark, str(tmp_path)).where(F.col("size") > 8 * 1024 * 1024).select("name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert "GreaterThan(length" in plan


def test_payloads(spark):
    bodies = [json.dumps({"message": "hi"}), json.dumps({"message": "m", "attachments": [{"type": "image", "dataUrl": "d"}]}), "broken"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = df.select("i", tables.parse_ask("body").alias("p")).orderBy("i").collect()
    assert [(r.p.message, [tuple(a) for a in r.p.attachments]) for r in got] == [
        ("hi", []), ("m", [("image", None, None, "d")]), (None, []),
    ]
    save = spark.sql("""select '{"sessionId":"s","role":"user"}' as b""").select(
        tables.parse_payload("b", schemas.SAVE_PAYLOAD).alias("p")
    ).first()
    assert tuple(save.p) == ("s", "user", None)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "sessions")
    asked = spark.createDataFrame(
        [(10, 1, ""), (11, 1, None), (12, 2, "mine")], "request_id long, user_id long, title string"
    )
    fresh = sinks.new_sessions(asked, F.lit("2024-01-01").cast("timestamp"))
    sinks.append_sessions(fresh, path)
    got = spark.read.parquet(path).collect()
    assert sorted(r.title for r in got) == ["New Chat", "New Chat", "mine"]
    assert len({r.id for r in got}) == 3
    assert {r.id for r in got} == {r.id for r in fresh.collect()}
    assert all(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", r.id) for r in got)
    with pytest.raises(Exception):
        sinks.write_snapshot(fresh, path)

    message = [(1, 1, 1, "user", "x", None)]
    path = str(tmp_path / "messages")
    ddl = "id long, session_id long, user_id long, role string, content string, created_at timestamp"
    returned = sinks.append_messages(spark.createDataFrame(message, ddl), path)
    sinks.append_messages(spark.createDataFrame(message, ddl), path)
    assert returned.count() == 1
    assert tables.read_table(spark, path, "chat_messages").count() == 2


def test_requests_as_json_lines(spark, tmp_path):
    ddl = "request_id long, message string, attachments array<" + schemas.ATTACHMENT.simpleString() + ">"
    asked = spark.createDataFrame([(1, "line\nbreak", [])], ddl)
    path = str(tmp_path / "requests")
    sinks.write_requests(prompts.assemble_requests(asked), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert json.loads(lines[0])["messages"][1]["content"] == "line\nbreak"


def test_shuffles_grow_with_the_data(spark):
    try:
        assert size_shuffles(spark, 1) == 4
        assert size_shuffles(spark, 100 << 40) == 409_600
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_checkpoint_folder_is_the_session_setting(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def _uploaded(spark, folder, **sizes):
    for name, size in sizes.items():
        (folder / f"{name}.txt").write_bytes(b"x" * size)
    return uploads.read_uploads(spark, str(folder), 1000)


def test_uploads_are_dealt_by_size_and_filtered_before_they_are_opened(spark, tmp_path):
    read = _uploaded(spark, tmp_path, a=400, b=500, c=300, d=5000, e=10)
    assert sorted((r.name, r.size, len(r.content)) for r in read.collect()) == [
        ("a.txt", 400, 400), ("b.txt", 500, 500), ("c.txt", 300, 300), ("d.txt", 5000, 5000), ("e.txt", 10, 10)]
    assert read.rdd.getNumPartitions() == 4  # a and b, c, d, e
    # A file too large for any task: reading it would fail.
    with open(tmp_path / "huge.txt", "wb") as file:
        file.truncate(1 << 42)
    few = read.where("size <= 500 AND name <> 'b.txt' AND name LIKE '%.txt'")
    assert sorted(r.name for r in few.collect()) == ["a.txt", "c.txt", "e.txt"]
    assert read.where("size > 9999").where("name = 'none'").count() == 0
    assert read.where("size IN (10, 300) AND length(content) > 100").count() == 1


def test_written_files_come_back(spark, tmp_path):
    rows = [(f"f{i}.txt", f"text {i} ü") for i in range(40)]
    files = spark.createDataFrame(rows, "name string, content string").repartition(3)
    assert uploads.write_files(files, str(tmp_path / "up")) == 40
    read = uploads.read_uploads(spark, f"file:{tmp_path}/up").select("name", tables.decode_text("content").alias("content"))
    assert sorted(tuple(r) for r in read.collect()) == sorted(rows)


def test_a_look_up_reads_few_row_groups_of_clustered_messages(spark, tmp_path):
    path = str(tmp_path / "messages")
    rows = spark.range(60_000).selectExpr(
        "id", "id % 500 * 2 as session_id", "id % 50 as user_id", "'user' as role", "repeat(md5(cast(id as string)), 8) as content",
        "timestamp_seconds(1704067200 + id) as created_at")
    sinks.write_clustered(rows, path, 1 << 18)
    held = tables.read_table(spark, path, "chat_messages")
    found = sessions.list_messages(held, 7, 114)
    assert found.count() == 120 and sessions.list_messages(held, 8, 114).count() == 0

    def scanned(df):
        df.collect()
        plan, out = df._jdf.queryExecution().executedPlan(), []

        def walk(node):
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                node = node.executedPlan()
            if "FileSourceScan" in node.getClass().getSimpleName():
                out.append(node.metrics().apply("numOutputRows").value())
            inner = [node.plan()] if "QueryStage" in node.getClass().getSimpleName() else []
            for k in range(node.children().size()):
                inner.append(node.children().apply(k))
            for x in inner:
                walk(x)

        walk(plan)
        return sum(out)

    assert 120 <= scanned(found) < 6000
    # A session that is not there lies between the bounds of many row groups; the filter tells.
    assert scanned(held.where("session_id = 115")) == 0
