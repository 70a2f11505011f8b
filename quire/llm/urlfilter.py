"""URL filters: pattern rules found through their rarest literal token. DataFrame functions only.

A rule names a host and a path prefix; it fits that host and its subdomains. Its literal tokens are
the runs of ASCII letters and digits that are fully delimited, so a fitting URL has each of them as
a token of its own. Each rule is filed under the token that the fewest distinct URLs have; a URL's
tokens fetch the rules filed under them, and only those run their regular expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the task.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The method's own rules, asked only where none of the fixed ones fits; * stands for anything but a slash.
MORE_RULES = (("block", "ads-*", ""), ("block", "spam-*", ""))
#: The rule table is broadcast only up to this many index rows (one per rule); beyond it the join shuffles.
MAX_BROADCAST_RULES = 200_000


def host_of(url) -> "F.Column":
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url) -> "F.Column":
    """What follows the host up to ? # or the end; empty without a ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text) -> "F.Column":
    """Distinct runs of ASCII letters and digits, A-Z in lower case, and the empty token that every text has."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+")))


def rule_rows(spark: SparkSession, rules, more) -> DataFrame:
    """One row per rule: rule (null for the method's own), verdict, regex over host + path, length, its delimited literal tokens."""
    rows = []
    for own, (verdict, host, path) in [*((False, r) for r in rules), *((True, r) for r in more)]:
        text = host + path
        literal = re.sub(r"[A-Za-z0-9]*$", "", text)  # what ends the rule may go on in the URL
        literal = re.sub(r"[A-Za-z0-9]*\*[A-Za-z0-9]*", "*", literal)  # and what is next to a *
        tokens = sorted({t.lower() for t in re.findall(r"[A-Za-z0-9]+", literal)}) or [""]
        pattern = "".join("[^/]*" if c == "*" else c if c.isalnum() and c.isascii() else "\\x{%x}" % ord(c) for c in text)
        rows.append((None if own else text, verdict, r"(?s)^(?:[^/]*\.)?" + pattern, -1 if own else len(text), tokens))
    return spark.createDataFrame(rows, "rule string, verdict string, pattern string, len int, tokens array<string>")


def apply_rules(pages: DataFrame, rules=RULES, more=MORE_RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; the longest fitting rule wins. Where none of rules fits, rule is
    null and the verdict is that of a fitting rule of more, or the default.

    A null URL, or one without ://, has empty host and path and the default verdict. Rows keep their
    number: equal URLs are judged once and the verdict is joined back. Equal rules given twice count
    once per verdict; on a tie of length the verdict that sorts last (block) wins. Columns of pages
    named host, path, rule or verdict are replaced."""
    spark = pages.sparkSession
    key, tok = fresh(pages, "target", "token")
    pages = pages.drop("host", "path", "rule", "verdict")
    pages = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url))).withColumn(key, F.concat("host", "path"))
    if not rules and not more:
        return pages.drop(key).withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    rule = rule_rows(spark, rules, more)
    filed = rule.select("rule", "verdict", "pattern", "len", F.explode("tokens").alias(tok))
    small = len(rules) + len(more) <= MAX_BROADCAST_RULES
    sized = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    targets = pages.select(key).where(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    tokens = targets.select(key, F.explode(tokens_of(F.col(key))).alias(tok))
    seen = tokens.join(sized(filed.select(tok).distinct()), tok, "left_semi").groupBy(tok).agg(F.count(F.lit(1)).alias("seen"))
    rarest = (
        filed.join(seen, tok, "left")
        .groupBy("rule", "verdict", "pattern", "len")
        .agg(F.min_by(tok, F.struct(F.coalesce("seen", F.lit(0)), -F.length(tok), F.col(tok))).alias(tok))
    )
    fits = (
        tokens.join(sized(rarest), tok)
        .where(F.regexp_like(F.col(key), F.col("pattern")))
        .groupBy(key)
        .agg(F.max(F.struct("len", "verdict", "rule")).alias("best"))
        .select(key, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    out = pages.join(fits, key, "left").drop(key)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return apply_rules(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f AS (
  SELECT page_id, host, path, h || p AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN h IS NULL THEN 0 ELSE length(h || p) END DESC) AS k
  FROM u LEFT JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host, '(?s)^([^/]*\.)?(ads|spam)-') THEN 'block' ELSE 'allow' END) AS verdict FROM f WHERE k = 1
"""
