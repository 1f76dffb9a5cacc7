"""URL rules by expansion: every URL is spelt out as the rules that could fit it.

A rule is a host and a path: it fits its host and all subdomains, where the URL's path
starts with the rule's.  So a rule fits exactly if it equals (a suffix of the URL's host at
a dot) + (a prefix of the URL's path).  Paths are cut at the lengths that rules' paths have;
other prefixes could equal no rule.  Expressions and rules meet on the first ``PREFIX`` hex
digits of their SHA-256, and those that meet are confirmed by the full digest.  The longest
rule wins (ties: the one with the longer host, then a block).

All of it is DataFrame operations.  Each distinct pair of host and path is judged once.

Defined cases: host and path of a null URL, or one without ``://``, are empty, and no rule
fits an empty host.  A host is what stands between ``://`` and the next ``/``, ``?``, ``#``
or the end, with A-Z lower-cased, a port and user name included; the path goes on to the
next ``?``, ``#`` or end.  A rule that is listed twice counts once; one that is both blocked
and allowed is blocked.  Without rules the verdict is the default.  Null and repeated page
ids are judged row by row.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.shared import ascii_lower, small

PREFIX = 8  # hex digits: 32 bits
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.", -1)
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.filter(every, lambda x: x != "")


def digested(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digest and its prefix, each rule once."""
    # The greatest of equals: block comes after allow.
    once = rules.groupBy(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")).agg(
        F.max("verdict").alias("rule_verdict"))
    rule = F.concat("rule_host", "rule_path")
    return once.where("rule_host <> ''").select(
        rule.alias("rule"), F.sha2(_spelt(F.col("rule_host"), F.col("rule_path")), 256).alias("rule_digest"), "rule_verdict",
        F.char_length(rule).alias("rule_length"), F.char_length("rule_host").alias("host_length"),
        F.char_length("rule_path").alias("path_length")).withColumn("prefix", F.substring("rule_digest", 1, PREFIX))


def _spelt(host: Column, path: Column) -> Column:
    # A line feed keeps ("a", "b/") and ("ab", "/") apart.
    return F.concat(host, F.lit("\n"), path)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Per row of ``pages`` (page_id, url): ``page_id``, ``host``, ``path``, ``rule`` that
    wins (null if none fits) and ``verdict``."""
    told = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = digested(rules)
    # The distinct lengths of the rules' paths, no more than the longest has characters.
    lengths = known.agg(F.array_sort(F.collect_set("path_length"))).scalar()
    found = told.where("host <> ''").select("host", "path").distinct().withColumn("lengths", lengths)
    suffixed = found.select("host", "path", "lengths", F.explode(host_suffixes(F.col("host"))).alias("suffix"))
    cut = suffixed.select("host", "path", "suffix", F.explode("lengths").alias("cut")).where(F.col("cut") <= F.char_length("path"))
    start = F.substring("path", F.lit(1), F.col("cut"))
    spelt = cut.select("host", "path", F.sha2(_spelt(F.col("suffix"), start), 256).alias("digest"))
    met = spelt.withColumn("prefix", F.substring("digest", 1, PREFIX)).join(small(known), "prefix").where("digest = rule_digest")
    best = met.groupBy("host", "path").agg(F.max_by(
        F.struct("rule", "rule_verdict"), F.struct("rule_length", "host_length", "rule_verdict")).alias("won"))
    judged = told.join(best, ["host", "path"], "left")
    return judged.select(
        "page_id", "host", "path", F.col("won.rule").alias("rule"),
        F.coalesce("won.rule_verdict", F.lit(default)).alias("verdict"))
