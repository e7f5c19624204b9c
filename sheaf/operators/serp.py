"""Query understanding and merging of result lists from several search sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.skew import top_k
from ..functions.text import any_of, clip, col, joined, strip, words
from .web import dedup_url_key

FILLERS = tuple(sorted(fixed.FILLER_WORDS, key=lambda w: (-len(w), w)))


# --- queries -------------------------------------------------------------------------------------

def detect_intent(text: Column | str) -> Column:
    low = F.lower(col(text))
    chart, analysis = any_of(low, fixed.CHART_WORDS), any_of(low, fixed.ANALYSIS_WORDS)
    return (F.when(chart & analysis, "analyze_and_chart").when(chart, "chart").when(analysis, "analyze").otherwise("search"))


def chart_type(text: Column | str) -> Column:
    low = F.lower(col(text))
    return (F.when(any_of(low, ("柱状图", "bar chart")), "bar").when(any_of(low, ("饼图", "pie chart")), "pie")
            .when(any_of(low, ("散点图", "scatter")), "scatter").otherwise("line"))


def wants_detail(text: Column | str) -> Column:
    return any_of(F.lower(col(text)), fixed.DETAIL_WORDS)


def intent_counts(log: DataFrame, text: str) -> DataFrame:
    return log.groupBy(detect_intent(text).alias("intent")).agg(F.count(F.lit(1)).alias("n_queries"))


def extract_keywords_zh(text: Column | str) -> Column:
    """Filler phrases out (longest first), stop words out; too little left gives the query back."""
    plain = strip(text)
    c = plain
    for filler in FILLERS:
        c = F.replace(c, F.lit(filler), F.lit(" "))
    kept = F.array_join(F.filter(words(c), lambda w: ~w.isin(*fixed.QUERY_STOP_WORDS)), " ")
    return F.when(F.length(kept) < 2, plain).otherwise(kept)


def preprocess_query(text: Column | str) -> Column:
    plain = strip(text)
    natural = (F.length(plain) > 10) & plain.rlike("[一-鿿]") & any_of(plain, fixed.FILLER_WORDS)
    return F.when(natural, extract_keywords_zh(text)).otherwise(plain)


def expand_query_variants(queries: DataFrame, supplied: str | None = None, limit: int = 4) -> DataFrame:
    """(query_id, variant, query): the query, its blank-free form, supplied variants of 4+ characters."""
    own = F.array("query", F.replace("query", F.lit(" "), F.lit("")))
    extra = F.filter(F.transform(supplied, strip), lambda v: F.length(v) >= 4) if supplied else F.array().cast("array<string>")
    forms = F.slice(F.array_distinct(F.concat(own, F.coalesce(extra, F.array().cast("array<string>")))), 1, limit)
    return queries.select("query_id", F.posexplode(forms).alias("variant", "query"))


# --- results -------------------------------------------------------------------------------------

def engine_order(engine: Column | str = "engine") -> Column:
    return (F.array_position(F.array(*[F.lit(e) for e in fixed.ENGINES]), col(engine)) - 1).cast("int")


def merge_engines(*lists: DataFrame) -> DataFrame:
    """Result lists put together; ``arrival`` orders them by variant, engine, position."""
    merged = lists[0]
    for other in lists[1:]:
        merged = merged.unionByName(other)
    return merged.withColumn("arrival", F.struct("variant", engine_order().alias("engine_no"), "pos"))


def engine_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("engine").agg(F.count(F.lit(1)).alias("n_results"))


def is_blocked(url: Column | str = "url", title: Column | str = "title") -> Column:
    return any_of(F.lower(col(url)), fixed.BLOCKED_URL_PATTERNS) | any_of(F.lower(col(title)), fixed.BLOCKED_TITLE_PATTERNS)


def filter_irrelevant(unique: DataFrame, max_results: int = 10) -> DataFrame:
    """Blocked rows out; a query left with nothing keeps its first ``max_results`` rows instead."""
    marked = unique.withColumn("_blocked", is_blocked())
    alive = marked.groupBy("query_id").agg(F.bool_and("_blocked").alias("_all"))
    lost = alive.filter("_all").select("query_id")
    kept = marked.filter(~F.col("_blocked"))
    spare = top_k(marked.join(lost, "query_id", "left_semi"), ["query_id"], [F.col("arrival")], max_results, "_rn")
    return kept.unionByName(spare.drop("_rn")).drop("_blocked")


def score_result(query: Column | str = "query", title: Column | str = "title", snippet: Column | str = "snippet",
                 url: Column | str = "url") -> Column:
    """3 per query word in the title, 1 in the snippet, 2 in the URL, 5 once for an authority word."""
    t, s, u = F.lower(col(title)), F.lower(col(snippet)), F.lower(col(url))
    hit = lambda text, w, weight: F.when(F.contains(text, w), F.lit(weight)).otherwise(0.0)
    total = F.aggregate(words(F.lower(col(query))), F.lit(0.0),
                        lambda acc, w: acc + hit(t, w, 3.0) + hit(s, w, 1.0) + hit(u, w, 2.0))
    return total + F.when(any_of(t, fixed.AUTHORITY_WORDS), 5.0).otherwise(0.0)


def federated_search(queries: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """Merged results (query_id, variant, engine, pos, title, url, snippet) deduplicated, filtered, scored, cut to k."""
    merged = merge_engines(results)
    unique = dedup_url_key(merged, ["query_id"], ["arrival"])
    scored = filter_irrelevant(unique, k).join(queries.select("query_id", "query"), "query_id").withColumn(
        "score", score_result())
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("arrival")], k, "position").select(
        "query_id", "position", "engine", "pos", "title", "url", "snippet", "score")


def context_from_pages(pages: DataFrame, limit: int = 30000) -> DataFrame:
    """One context per query from pages (query_id, position, title, url, markdown, content)."""
    body = clip(F.coalesce(F.nullif("markdown", F.lit("")), "content"), limit, "\n...(content truncated)")
    part = F.concat(F.lit("[Source "), "position", F.lit(": "), "title", F.lit("]("), "url", F.lit(")\n"), body, F.lit("\n"))
    return pages.groupBy("query_id").agg(F.concat(
        F.lit("\n\n" + "=" * 80), joined("\n\n", part, "position")).alias("context"))


def no_result_flag(answer: Column | str) -> Column:
    low = F.lower(F.coalesce(col(answer), F.lit("")))
    return (low == "") | any_of(low, ("couldn't find relevant information", "no relevant"))
