import os
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import compare, connect  # noqa: E402

from parley.llm import rules, urls  # noqa: E402
from parley.llm.registry import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, folder, name):
    ok, rows, message = compare(spark, connect(folder), folder, QUERIES[name], ORACLES[name])
    assert ok, message
    assert rows > 0


# ------------------------------------------------------------------ quality rules

def test_repeated_words():
    def plain(words):
        seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        return len({i + k for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for k in range(5)})

    for text in (b"", b"a b c d e", b"a a a a a a", b"a b c d e x a b c d e", b"a b c d a b c d a b c", b"x y " * 50 + b"z"):
        assert rules.repeated_words(text.split()) == plain(text.split()), text


def test_order_changes_the_work_only(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    def verdicts(listed):
        return {(r.doc_id, r.kept) for r in rules.judge(docs, rules=listed).collect()}

    assert verdicts(rules.RULES) == verdicts(rules.RULES[::-1]) == verdicts(rules.RULES[3:] + rules.RULES[:3])


def test_cheap_and_selective_rules_first(spark):
    df = spark.createDataFrame([(i, "fine text with words " * 5 + ("!" * 200 if i % 2 else "")) for i in range(40)], "doc_id long, text string")
    rejected, cost = rules.sampled(df, [], rules.RULES)
    share = dict(zip([r.name for r in rules.RULES], rejected.mean(0)))
    assert share["marks"] == 0.5 and share["shouting"] == 0
    assert rules.ordered(rules.RULES, rejected, cost)[0].name == "marks"
    judged = rules.judge(df, base=[]).collect()
    assert {(r.kept, r.rules_run) for r in judged} == {(False, 1), (True, len(rules.RULES))}


def test_a_rule_that_rejects_nothing_of_the_rest_comes_last(spark):
    """Half of all texts are rejected by two rules alike, a tenth by a third one alone; base rules'
    rejects are not part of the sample."""
    word = rules.Rule("word", lambda t: t.text.startswith("bad"))
    again = rules.Rule("again", lambda t: t.text.startswith("bad") and t.n_words > 0)
    rare = rules.Rule("rare", lambda t: t.text.endswith("rare"))
    base = [rules.Rule("empty", lambda t: not t.text)]
    texts = ["bad text"] * 50 + ["fine text"] * 40 + ["text rare"] * 10 + [""] * 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rejected, cost = rules.sampled(df, base, [again, word, rare])
    assert rejected.shape == (100, 3) and rejected.sum(0).tolist() == [50, 50, 10]
    assert [r.name for r in rules.ordered([again, word, rare], rejected, cost)] == ["again", "rare", "word"]


def test_the_sample_is_bounded_whatever_repeats(spark):
    df = spark.range(20_000).selectExpr("1L as doc_id", "'the same text in every row' as text").repartition(6)
    rejected, _ = rules.sampled(df, [], rules.RULES, 500)
    assert 300 < len(rejected) < 700


def test_costs_come_from_the_sample(spark):
    """Many words or few in the same number of characters; base features cost nothing more."""
    def costs(text):
        df = spark.createDataFrame([(i, text) for i in range(10)], "doc_id long, text string")
        return dict(zip([r.name for r in rules.RULES], rules.sampled(df, [], rules.RULES)[1].mean(0)))

    many, few = costs("a b " * 500), costs("abcdefghi " * 200)
    assert many["one_word"] > many["shouting"] > few["one_word"] and many["shouting"] == few["shouting"]
    assert many["symbols"] == many["word_length"] == few["symbols"] == 1


def test_rules_odd_rows(odd, none):
    found = rules.judge(odd).collect()
    assert len(found) == odd.count()
    by_id = {r.doc_id: r for r in found}
    for d in (3, 4, 5):
        assert (by_id[d].n_words, by_id[d].word_chars, by_id[d].base_failed, by_id[d].kept) == (0, 0, True, False)
    assert by_id[6].n_words == 30_000 and by_id[None].n_words == 11 and by_id[None].kept
    assert rules.judge(none).count() == 0


# ------------------------------------------------------------------ URL rules

def plain_verdict(host, path, listed, default="allow"):
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in listed
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (default, None)


def test_url_rules(spark, monkeypatch):
    listed = [("a.b", "", "block"), ("b", "/x", "allow"), ("a.b", "/x/", "allow"), ("b", "/x/yy", "block"), ("b", "/x", "allow"),
              ("c", "/", "block"), ("c", "/", "allow"), ("", "/", "block"), ("B", "/Q", "block"), ("8.d:80", "/", "block")]
    pages = [("http://a.b/x/yy?q", 1), ("http://z.a.b/x/", 2), ("https://A.B", 3), ("ftp://b/xx", 4), ("http://ab/x", 5), (None, 6),
             ("no scheme a.b/x", 7), ("http:///x", 8), ("http://c", 9), ("http://c/#x", 9), ("http://c/", None), ("x://y://c/", 10),
             ("http://b/Q/r", 11), ("http://b/q", 12), ("http://8.d:80/", 13), ("http://8.d/", 14), ("://b/x", 15),
             ("http://a..b/x", 16), ("http://.b/x", 17), ("http://b./x", 18), ("http://b\n/x", 19), ("http://b/x", 20), ("http://b/x", 20)]
    df = spark.createDataFrame(pages, "url string, page_id long").withColumn("rule", F.lit(1)).withColumn("prefix", F.lit(1))
    table = spark.createDataFrame(listed, "host string, path string, verdict string")
    plain = [(h.lower(), p, v) for h, p, v in listed if (h, p, v) != ("c", "/", "allow")]
    for digits in (urls.PREFIX, 1):  # a short prefix: many meet, and the digest decides
        monkeypatch.setattr(urls, "PREFIX", digits)
        found = urls.judge(df, table).collect()
        assert len(found) == len(pages)
        for r in found:
            assert (r.verdict, r.rule) == plain_verdict(r.host, r.path, plain), r
    hosts = {r.page_id: (r.host, r.path) for r in found}
    assert hosts[1] == ("a.b", "/x/yy") and hosts[3] == ("a.b", "") and hosts[6] == hosts[7] == ("", "")
    assert hosts[8] == ("", "/x") and hosts[10] == ("y:", "//c/") and hosts[19] == ("b\n", "/x")
    assert {r.verdict for r in urls.judge(df, table.limit(0), "block").collect()} == {"block"}
    assert urls.judge(df.limit(0), table).count() == 0
