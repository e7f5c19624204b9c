"""URL filters: rules indexed by their rarest literal token.

Every rule names tokens (runs of ``a-z0-9``) that any url it fits must hold whole. The index keeps one of
them per rule, the one that fewest urls hold. A url's tokens fetch candidate rules by an equi-join, and only those
candidates run their regular expression. Rules without a whole token are filed under the empty token, which every
url asks for.

Two kinds of rule share the index: host rules (host with all its subdomains, path prefix; the longest
fitting one decides) and patterns (``*`` any characters, ``^`` one character other than a letter or digit, or an
end; a fitting one blocks). A fitting host rule outranks patterns; without either the url is allowed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower_ascii, text_of

#: Host rules of the registered query: verdict, host, path.
HOST_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Patterns of the registered query: gambling, pharmacy, adult, link farms and advertising hosts.
PATTERNS = [
    "://*^casino^*^example^", "://*^bets^", "://*^betting^", "://*^poker^", "://*^jackpot^", "://*^pills^", "://*^viagra^",
    "://*^adult^", "://*^porn^", "://*^xxx^", "://*^spam^farm^", "://*^ads^track^", "://*^adserver^", "^doubleclick^",
    "/banner/*^ad^", "^popunder^",
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(text_of(url), r"(?s)^.*?://(.*)$", 1)
    head = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(head, r"(?s)^[^/]*", 0)
    return lower_ascii(host), F.substring(head, F.length(host) + 1, F.length(head))


def host_regex(host: str, path: str) -> str:
    return "(?s)^(?:[^/]*\\.)?" + _quoted(host) + _quoted(path)


def pattern_regex(pattern: str) -> str:
    return "(?s)" + "".join({"*": ".*", "^": "(?:[^a-z0-9]|^|$)"}.get(c) or _quoted(c) for c in pattern)


def _quoted(literal: str) -> str:
    return "".join(c if c.isalnum() or not c.isascii() else "\\" + c for c in literal)


def host_tokens(host: str, path: str) -> list[str]:
    """The path is a prefix: a run at its end may go on in the url, so it is no whole token."""
    return re.findall("[a-z0-9]+", host) + re.findall("[a-z0-9]+(?=[^a-z0-9])", path.translate(_LOWER))


def pattern_tokens(pattern: str) -> list[str]:
    """Runs with a character on both sides that is neither a letter, a digit nor ``*``."""
    return re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", pattern)


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rule_table(spark: SparkSession, host_rules: list[tuple[str, str, str]], patterns: list[str]) -> DataFrame:
    """rule_id, rule, verdict, kind, rank, regex, tokens. Lower-case patterns and hosts are expected."""
    rows = []
    for verdict, host, path in host_rules:
        # Longest rule first, then the longer host.
        rows.append((host + path, verdict, "host", len(host + path) * 4096 + len(host), host_regex(host, path), host_tokens(host, path)))
    for p in patterns:
        rows.append((p, "block", "pattern", 0, pattern_regex(p), pattern_tokens(p)))
    names = ("rule", "verdict", "kind", "rank", "regex")
    made = [F.struct(F.lit(i).cast("long").alias("rule_id"), *[F.lit(v).alias(n) for n, v in zip(names, r)],
                     F.array(*map(F.lit, r[-1])).cast("array<string>").alias("tokens")) for i, r in enumerate(rows)]
    kinds = "rule_id bigint, rule string, verdict string, kind string, rank bigint, regex string, tokens array<string>"
    return spark.range(1).select(F.inline(F.array(*made).cast(f"array<struct<{kinds.replace(' ', ':').replace(',:', ',')}>>")))


def url_tokens(url: Column) -> Column:
    found = F.regexp_extract_all(lower_ascii(text_of(url)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.concat(F.array(F.lit("")), found))


def rarest_tokens(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, token): each rule's token that fewest of the distinct ``urls(url)`` hold; ties by the token."""
    asked = rules.select("rule_id", F.explode_outer("tokens").alias("token")).fillna("", ["token"]).distinct()
    held = (urls.select(F.explode(url_tokens(F.col("url"))).alias("token"))
            .join(asked.select("token").distinct(), "token", "left_semi")
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    ranked = asked.join(held, "token", "left").withColumn(
        "place", F.row_number().over(W.partitionBy("rule_id").orderBy(F.coalesce("n", F.lit(0)), "token")))
    return ranked.filter("place = 1").select("rule_id", "token")


def candidates(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule_id) pairs that share the rule's indexed token."""
    tokens = urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    return tokens.join(rarest_tokens(urls, rules), "token").select("url", "rule_id")


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: key, host, path, rule, verdict, patterns (ids of fitting patterns, sorted).

    Each distinct url is judged once. Null, empty and malformed urls have empty host and path, fit no rule and
    are allowed unless a pattern fits their text; repeated rows and null keys are kept as they are; other
    columns of ``pages`` are ignored; no pages give no rows; no rules allow everything.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    urls = rows.select("url").filter(F.col("url").isNotNull()).distinct()
    host, path = split_url(F.col("url"))
    facts = rules.select("rule_id", "rule", "verdict", "kind", "rank", "regex")
    fits = (candidates(urls, rules).join(facts, "rule_id")
            .filter(F.rlike(F.when(F.col("kind") == "host", F.concat(host, path)).otherwise(lower_ascii(F.col("url"))), F.col("regex"))))
    best = F.max(F.when(F.col("kind") == "host", F.struct("rank", "rule", "verdict")))
    marks = F.array_sort(F.collect_set(F.when(F.col("kind") == "pattern", F.col("rule_id"))))
    judged = fits.groupBy("url").agg(best.alias("best"), marks.alias("patterns"))
    fallback = F.when(F.size(F.coalesce("patterns", F.array())) > 0, "block").otherwise("allow")
    return (rows.join(judged, "url", "left")
            .select(F.col("key").alias(key), host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"),
                    F.coalesce(F.col("best.verdict"), fallback).alias("verdict"),
                    F.coalesce("patterns", F.array().cast("array<bigint>")).alias("patterns")))
