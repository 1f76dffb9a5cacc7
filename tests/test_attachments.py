from pyspark.sql import functions as F

from parley.operators import attachments as A

SCHEMA = "batch_id long, pos int, name string, mime string, size long, text string, pending int"


def run(spark, rows, **columns):
    files = spark.createDataFrame(rows, SCHEMA).withColumns(columns)
    return A.ingest_attachments(files)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_routing(spark):
    cases = [
        ("a.txt", "", "text"), ("A.MD", "", "text"), ("a.bin", "text/x", "text"), ("a.html", "", "text"),
        ("A.PDF", "", "pdf"), ("a.bin", "application/pdf", "pdf"), ("a.DOCX", None, "docx"),
        ("a", A.DOCX_MIME, "docx"), ("a.jpeg", "", "image"), ("a.jpg", "", "image"), ("a", "image/x", "image"),
        ("a.zip", "", "unsupported"), ("a.txt\n", "", "unsupported"), ("txt", "", "unsupported"),
        ("a.pdf", "text/plain", "text"),
    ]
    df = spark.createDataFrame(cases, "name string, mime string, want string")
    wrong = df.where(A.route(F.col("name"), F.col("mime")) != F.col("want")).collect()
    assert wrong == []


def test_invalid_files_use_up_slots(spark):
    rows = [(1, i, f"f{i}.zip" if i == 0 else f"f{i}.txt", "", 1, " x ", 0) for i in range(7)]
    got = run(spark, rows)
    assert [r.pos for r in got.attached.orderBy("pos").collect()] == [1, 2, 3, 4, 5]
    assert rows_of(got.errors, "pos") == [
        (1, -1, "over_cap", "Only 6 attachments are allowed."),
        (1, 0, "unsupported", "f0.zip: unsupported file type."),
    ]
    assert rows_of(got.batch_status, "batch_id") == [(
        1, 7, 5, 2, "5 file(s) attached. Add a prompt or send files directly.",
        "Only 6 attachments are allowed.\nf0.zip: unsupported file type.",
    )]


def test_size_is_tested_first_and_the_limit_is_inclusive(spark):
    rows = [(1, 0, "a.txt", "", 8 * 1024 * 1024, "x", 0), (1, 1, "b.zip", "", 8 * 1024 * 1024 + 1, "x", 0)]
    got = run(spark, rows)
    assert rows_of(got.attached.select("name", "type", "content"), "name") == [("a.txt", "text", "x")]
    assert rows_of(got.errors.select("message"), "message") == [("b.zip: file is too large (max 8MB).",)]


def test_empty_and_failed_files(spark):
    rows = [
        (1, 0, "a.txt", "", 1, "  ", 0), (1, 1, "a.pdf", "", 1, None, 0), (1, 2, "a.docx", "", 1, "", 0),
        (1, 3, "a.png", "", 1, None, 0), (1, 4, "b.txt", "", 1, "x", 0),
    ]
    got = run(spark, rows, failed=F.col("name") == "b.txt", data_url=F.lit("data:x"))
    assert rows_of(got.errors.select("pos", "message"), "pos") == [
        (0, "a.txt: text file appears empty or unreadable."),
        (1, "a.pdf: could not extract readable text from PDF."),
        (2, "a.docx: could not extract readable text from DOCX."),
        (4, "b.txt: unreadable file or processing failed."),
    ]
    assert rows_of(got.attached, "pos") == [(1, 3, "image", "a.png", None, "data:x")]


def test_shown_errors_and_empty_status(spark):
    rows = [(1, i, f"{i}.zip", "", 1, "", 0) for i in range(8)] + [(2, 0, "a.txt", "", 1, "x", 6)]
    status = {r.batch_id: r for r in run(spark, rows).batch_status.collect()}
    assert status[1].status == "No files were attached." and status[1].errors == 7
    assert status[1].shown_errors.split("\n")[0] == "Only 6 attachments are allowed."
    assert status[1].shown_errors.split("\n")[4] == "...and 3 more."
    # No slot left: nothing is examined, the cap is the only error.
    assert (status[2].attached, status[2].shown_errors) == (0, "Only 6 attachments are allowed.")


def test_text_is_trimmed_then_cut(spark):
    got = run(spark, [(1, 0, "a.txt", "", 1, "\u00a0" + "x" * 7999 + "  y", 0)])
    assert got.attached.first().content == "x" * 7999 + " "


def test_remove_attachment(spark):
    df = spark.sql("select array('a','b','c') as x").select(A.remove_attachment(F.col("x"), 1).alias("x"))
    assert df.first().x == ["a", "c"]


def pages(spark, rows):
    return {r.file_id: r.text for r in A.join_pages(spark.createDataFrame(rows, "file_id long, page_no long, text string")).collect()}


def test_pages_in_order_trimmed_and_cut(spark):
    got = pages(spark, [
        (1, 2, "b "), (1, 1, " a"), (1, 3, None), (2, 1, " "), (2, 2, None),
        (3, 1, "\n"), (3, 2, "x" * 7998 + "  "), (3, 3, "y"),
        (4, 1, "x" + " " * 9000), (4, 2, " "), (5, 1, "x" + " " * 9000), (5, 2, "y"),
    ])
    assert got[1] == "a\nb"
    assert got[2] == ""
    assert got[3] == "x" * 7998 + "  "
    # Blanks at the end of the text go, blanks in front of a later page stay.
    assert got[4] == "x"
    assert got[5] == "x" + " " * 7999


def test_pages_without_a_number_come_last_and_equal_ones_all_count(spark):
    got = pages(spark, [
        (1, None, "z"), (1, 2, "b"), (1, 1, "a"), (1, None, "y"), (2, None, " only "), (3, 1, "p"), (3, 1, "p"), (3, 1, "o"),
        (4, 200, "x" * 9000), (4, None, "never"), (5, 1, "x" * 7000), (5, 100, "y" * 7000), (5, 300, "z"),
    ])
    assert got == {1: "a\nb\ny\nz", 2: "only", 3: "o\np\np", 4: "x" * 8000, 5: "x" * 7000 + "\n" + "y" * 999}


def test_very_many_equal_pages_of_one_number(spark):
    same = spark.range(40_000).selectExpr("1L as file_id", "if(id = 0, 1L, 2L) as page_no", "if(id = 0, 'first', '') as text")
    end = spark.range(2).selectExpr("1L as file_id", "3L as page_no", "'end' as text")
    (row,) = A.join_pages(same.union(end)).collect()
    assert row.text == ("first" + "\n" * 40_000)[:8000]


def test_a_document_with_most_of_the_pages(spark):
    many = spark.range(30_000).selectExpr("7L as file_id", "id as page_no", "if(id < 9000, ' ', 'p') as text")
    few = spark.range(300).selectExpr("id + 100 as file_id", "0L as page_no", "'q' as text")
    got = {r.file_id: r.text for r in A.join_pages(many.union(few)).collect()}
    assert len(got) == 301
    assert got[7] == ("p\n" * 4000)[:8000]


def test_page_numbers_with_gaps(spark):
    million = spark.range(1_000_000).selectExpr("1L as file_id", "id * 1000003 as page_no", "if(id < 50, '', cast(id % 10 as string)) as text")
    words = spark.range(1499).selectExpr("2L as file_id", "(id + 1) * 10 as page_no", "concat('w', id) as text")
    got = {r.file_id: r.text for r in A.join_pages(million.union(words)).collect()}
    assert got[1] == "\n".join(str(i % 10) for i in range(50, 5000))[:8000]
    assert got[2] == "\n".join(f"w{i}" for i in range(1499))[:8000]


def test_only_the_first_rows_of_a_batch_are_shuffled(spark):
    files = spark.createDataFrame([(1, 0, "a.txt", "", 1, "x", 0)], SCHEMA)
    plan = A.examine_files(files)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in below and "Partial" in below
