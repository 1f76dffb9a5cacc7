import pytest

from parley.functions.replies import break_lists
from parley.operators.replies import block_items, structure_replies


def blocks(spark, content):
    messages = spark.createDataFrame([(1, content)], "id long, content string")
    rows = structure_replies(messages).blocks.orderBy("block_no").collect()
    return [(r.kind, r["items"]) for r in rows]


@pytest.mark.parametrize(
    "content, expected",
    [
        ("", []),
        (None, []),
        (" \n\t\n", []),
        ("one\r\ntwo", [("paragraph", ["one"]), ("paragraph", ["two"])]),
        ("- a\n\n\n- b", [("list", ["a", "b"])]),
        ("1. a\n- b\n* c", [("list", ["a", "b", "c"])]),
        ("- a\ntext\n- b", [("list", ["a"]), ("paragraph", ["text"]), ("list", ["b"])]),
        ("a * b mid", [("paragraph", ["a"]), ("list", ["b mid"])]),
        ("intro 1. **A** x 2.  **B** y", [("paragraph", ["intro"]), ("list", ["**A** x", "**B** y"])]),
        ("1. plain 2. plain", [("list", ["plain 2. plain"])]),
        ("1.\n-\n*", [("paragraph", ["1."]), ("paragraph", ["-"]), ("paragraph", ["*"])]),
        ("-x\n1.x", [("paragraph", ["-x"]), ("paragraph", ["1.x"])]),
        ("-\u00a0x", [("list", ["x"])]),
        # A lone carriage return or a line separator inside an item: not a list line.
        ("- a\rb", [("paragraph", ["- a\rb"])]),
        ("- a\u2028b", [("paragraph", ["- a\u2028b"])]),
        ("12. x", [("list", ["x"])]),
        ("\u0662. x", [("paragraph", ["\u0662. x"])]),
    ],
)
def test_blocks(spark, content, expected):
    assert blocks(spark, content) == expected


def test_rewrite_steps(spark):
    rows = spark.createDataFrame(
        [(0, "a\r\nb"), (1, "x  3. **B**"), (2, "x \n * y"), (3, "a\n\n\n\nb"), (4, " a ")], "i int, c string"
    )
    got = [r.v for r in rows.select("i", break_lists("c").alias("v")).orderBy("i").collect()]
    assert got == ["a\nb", "x\n3. **B**", "x\n- y", "a\n\nb", "a"]


def test_bold_positions(spark):
    messages = spark.createDataFrame([(1, "a **b** and **c**\n- **d** **open")], "id long, content string")
    structured = structure_replies(messages)
    got = [tuple(r) for r in structured.bold.orderBy("block_no", "item_no", "pos").collect()]
    assert got == [(1, 0, 0, 0, "b"), (1, 0, 0, 1, "c"), (1, 1, 0, 0, "d")]
    items = block_items(structured.blocks).orderBy("block_no").collect()
    assert [[s.bold for s in r.spans] for r in items] == [[False, True, False, True, False], [False, True, False]]


def test_long_blank_runs_are_linear(spark):
    content = "a" + " " * 200_000 + "b *" + " " * 200_000 + "c"
    assert blocks(spark, content) == [("paragraph", ["a" + " " * 200_000 + "b"]), ("list", ["c"])]


def test_structuring_does_not_shuffle(spark):
    messages = spark.createDataFrame([(1, "a")], "id long, content string")
    plan = structure_replies(messages).bold._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
