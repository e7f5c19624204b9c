"""Stored web pages: cleaning, validation, links, robots rules, crawl order, page cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import html as H
from ..functions import urls
from ..functions.skew import first_per_key
from ..functions.text import any_of, col, strip, words
from ..session import written


# --- pages ---------------------------------------------------------------------------------------

def clean_html(pages: DataFrame) -> DataFrame:
    cleaned = H.clean("html")
    return pages.select("page_id", cleaned.alias("cleaned"))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, content): text nodes of the cleaned page, one per line."""
    cleaned = pages.withColumn("_c", H.clean("html"))
    return cleaned.select("page_id", H.text_of(H.text_pieces("_c")).alias("content"))


def page_metadata(pages: DataFrame) -> DataFrame:
    cleaned = pages.select("page_id", "url", "html", H.clean("html").alias("_c")).withColumn(
        "_text", H.text_of(H.text_pieces("_c")))
    title = strip(H.unescape(H.first_group("_c", "(?is)<title[^>]*>(.*?)</title>")))
    h1 = F.array_join(H.text_pieces(H.first_group("_c", "(?is)<h1[^>]*>(.*?)</h1>")), "")
    return cleaned.select(
        "page_id", "url", F.coalesce(F.nullif(title, F.lit("")), h1).alias("title"),
        H.meta_content("_c", "description").alias("description"), H.meta_content("_c", "keywords").alias("keywords"),
        F.size(words("_text")).alias("word_count"))


def search_source_stats(pages: DataFrame) -> DataFrame:
    return page_metadata(pages).select("page_id", "title", "url", "description", "word_count")


def extract_links(pages: DataFrame) -> DataFrame:
    """Distinct same-host page links (page_id, link)."""
    hrefs = F.regexp_extract_all("html", F.lit("(?is)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']*)[\"']"), 1)
    plain = F.transform(F.array_distinct(hrefs), lambda h: strip(H.unescape(h)))
    kept = F.filter(plain, lambda h: (h != "") & ~h.startswith("#") & ~h.startswith("mailto:"))
    # Links are made in the explode, once each, and only looked at behind it.
    full = pages.select("page_id", urls.host("url").alias("_host"), F.explode(F.transform(kept, lambda h: urls.resolve("url", h))).alias("link"))
    return full.filter((urls.host("link") == F.col("_host"))
                       & ~any_of(F.lower(urls.path("link")), fixed.LINK_SKIP_EXTENSIONS)).select("page_id", "link").distinct()


def http_success(status: Column | str, error: Column | str) -> Column:
    status = col(status)
    return (status.between(200, 299) | (status == 304)) & col(error).isNull()


def validate_page(fetched: DataFrame) -> DataFrame:
    """(page_id, url, reject_reason) for fetched pages (page_id, url, html, status_code, error); null reason = valid."""
    measured = fetched.withColumn("_text", F.length(F.array_join(H.text_pieces(H.clean("html")), ""))).withColumn(
        "_scripts", F.size(F.regexp_extract_all("html", F.lit("(?i)(<script[\\s>])"), 1)))
    reason = (
        F.when(~http_success("status_code", "error"), "unsuccessful")
        .when(F.length(strip(F.coalesce("html", F.lit("")))) < 50, "short_html")
        .when(any_of(F.lower("html"), fixed.ANTI_BOT_PHRASES), "anti_bot")
        .when(F.col("_text") < 50, "short_text")
        .when((F.col("_scripts") > 20) & (F.col("_text") < 200), "script_only"))
    return measured.select("page_id", "url", reason.alias("reject_reason"))


def split_scraped(scraped: DataFrame, shortest: int = 100) -> DataFrame:
    """Scraped pages (error, content) counted as usable or not."""
    ok = F.col("error").isNull() & (F.length(F.coalesce("content", F.lit(""))) > shortest)
    return scraped.groupBy(ok.alias("usable")).agg(F.count(F.lit(1)).alias("n_pages"))


def usable_pages(scraped: DataFrame, shortest: int = 100) -> DataFrame:
    return scraped.filter(F.col("error").isNull() & (F.length("content") > shortest))


def url_content_relevance(pages: DataFrame) -> DataFrame:
    """Share of URL words found in the content (page_id, url, content)."""
    parts = F.filter(F.array_distinct(F.split(F.lower("url"), "/")),
                     lambda x: (F.length(x) > 3) & x.rlike("^[\\p{L}\\p{N}]+$"))
    sized = pages.select("page_id", parts.alias("_p"), F.lower("content").alias("_l"))
    found = F.size(F.filter("_p", lambda x: F.contains(F.col("_l"), x)))
    return sized.select("page_id", F.size("_p").alias("n_words"), found.alias("n_found"),
                        ((F.size("_p") > 0) & (found < F.size("_p") * 0.3)).alias("low_relevance"))


def domain_mismatch(requests: DataFrame, requested: str, scraped: str) -> DataFrame:
    return requests.withColumn("mismatch", urls.host(requested) != urls.host(scraped))


def page_quality_report(validated: DataFrame) -> DataFrame:
    return validated.groupBy(urls.host("url").alias("host"), F.coalesce("reject_reason", F.lit("ok")).alias(
        "outcome")).agg(F.count(F.lit(1)).alias("n_pages"))


# --- URLs ----------------------------------------------------------------------------------------

def is_valid_url(text: Column | str) -> Column:
    return col(text).rlike(H.url_pattern(fixed.URL_BODY, True)) | col(text).startswith("www.")


def first_url(text: Column | str) -> Column:
    """First URL in free text without trailing punctuation, null when there is none."""
    found = F.regexp_extract(col(text), H.url_pattern(fixed.URL_BODY, False), 0)
    return F.nullif(F.regexp_replace(found, "[.,;:!?'\"]+$", ""), F.lit(""))


def is_file_url(u: Column | str) -> Column:
    ends = "|".join(H.escape(e) for e in fixed.FILE_EXTENSIONS)
    return F.lower(urls.path(u)).rlike(f"(?:{ends})$")


def is_social(u: Column | str) -> Column:
    return any_of(urls.bare_host(u), fixed.SOCIAL_DOMAINS)


def same_domain(u: Column | str, base: Column | str) -> Column:
    return urls.bare_host(u) == urls.bare_host(base)


def classify_url(links: DataFrame, url: str, base: str) -> DataFrame:
    return (links.withColumn("is_file", is_file_url(url)).withColumn("is_social", is_social(url))
            .withColumn("depth", urls.depth(url)).withColumn("same_domain", same_domain(url, base)))


def link_allowed(url: Column | str, base: Column | str, max_depth: int = 10, allow_external: bool = False,
                 exclude: list[str] | None = None, include: list[str] | None = None) -> Column:
    ok = ((urls.scheme(url) != "") & (urls.host(url) != "") & ~is_file_url(url) & ~is_social(url)
          & ~col(url).startswith("mailto:") & ~col(url).startswith("tel:") & (urls.depth(url) <= max_depth))
    if not allow_external:
        ok = ok & same_domain(url, base)
    for pattern in exclude or ():
        ok = ok & ~col(url).rlike(pattern)
    if include:
        some = F.lit(False)
        for pattern in include:
            some = some | col(url).rlike(pattern)
        ok = ok & some
    return ok


def filter_links(links: DataFrame, url: str = "link", base: str = "base", **rules) -> DataFrame:
    return links.filter(link_allowed(url, base, **rules)).select(base, url).distinct()


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """Per host the allowed and disallowed prefixes that bind ``agent`` (host, allow, disallow)."""
    lines = robots.select("host", F.posexplode(F.split("robots_txt", "\n")).alias("pos", "line")).withColumn(
        "line", strip("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    value = strip(F.regexp_replace("line", "^[^:]*:", ""))
    kind = F.lower(F.regexp_extract("line", "(?i)^(user-agent|disallow|allow):", 1))
    named = lines.select("host", "pos", kind.alias("kind"), value.alias("value"))
    carried = named.withColumn("agent", F.last(F.when(F.col("kind") == "user-agent", F.col("value")), ignorenulls=True).over(
        W.partitionBy("host").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    binding = carried.filter(F.col("agent").isin(agent, "*") & F.col("kind").isin("allow", "disallow") & (F.col("value") != ""))
    of = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("value")))
    return binding.groupBy("host").agg(of("allow").alias("allow"), of("disallow").alias("disallow"))


def robots_allowed(pages: DataFrame, robots: DataFrame, url: str = "url", agent: str = "*") -> DataFrame:
    """Adds ``allowed``: any matching allow prefix wins, then any disallow prefix, else allowed."""
    rules = robots_rules(robots, agent).withColumnRenamed("host", "_host")
    at = urls.path(url)
    hit = lambda c: F.coalesce(F.exists(c, lambda p: F.startswith(at, p)), F.lit(False))
    joined_ = pages.join(rules, urls.host(url) == F.col("_host"), "left")
    return joined_.withColumn("allowed", hit("allow") | ~hit("disallow")).drop("_host", "allow", "disallow")


QUEUE_BLOCK = 4096


def _queued(found: DataFrame, before: DataFrame) -> DataFrame:
    """Places of newly found pages (start, url_id, parent, ord, ok) in their start's queue.

    Adds ``seq`` (pages before this one) and ``earlier`` (results before it), both counted on from ``before(start, n, n_ok)``.
    Queues are cut at blocks of parents, so a start of any size is numbered by many tasks; only block totals meet.
    """
    rows = found.withColumn("_blk", F.floor(F.col("parent") / QUEUE_BLOCK))
    n, n_ok = F.count(F.lit(1)), F.sum(F.col("ok").cast("long"))
    totals = rows.groupBy("start", "_blk").agg(n.alias("n"), n_ok.alias("n_ok")).unionByName(
        before.select("start", F.lit(-1).cast("long").alias("_blk"), "n", "n_ok"))
    so_far = W.partitionBy("start").orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("start", "_blk", F.sum("n").over(so_far).alias("_n"), F.sum("n_ok").over(so_far).alias("_n_ok"))
    inside = W.partitionBy("start", "_blk").orderBy("parent", "ord", "url_id").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.select("*", n.over(inside).alias("_i"), F.coalesce(n_ok.over(inside), F.lit(0)).alias("_i_ok"))
    return placed.join(offsets, ["start", "_blk"]).select(
        "start", "url_id", "ok", (F.col("_n") + F.col("_i")).alias("seq"), (F.col("_n_ok") + F.col("_i_ok")).alias("earlier"))


def crawl_frontier(links: DataFrame, starts: DataFrame, max_depth: int = 2, max_pages: int | None = None,
                   allowed: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """Breadth-first visit order over a stored link graph, for every start at once.

    ``links(src, dst, ord)``, ``starts(start)``; optional ``allowed(url_id)``, the pages that may be visited, and
    ``failed(url_id)``, those whose fetch fails: they are visited but are no results and queue nothing. Returns (start,
    url_id, depth, place); ``place`` counts a start's results from 0 in queue order.

    With ``max_pages`` a start ends at that many results, and a page queues only as many of its links (in order, repeats and
    pages visited before it left out) as results are missing when it is read; links that may not be visited count.
    Repeated links keep their first place, ties go to the smaller id, null ids are no pages. Every level is written, so
    neither the plan nor lost work grows with the depth; places are two numbers, however deep the page.
    """
    flag = lambda table, name: table.select(F.col("url_id").alias("dst"), F.lit(True).alias(name)).distinct()
    known = links.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    roots = starts.filter("start IS NOT NULL").select("start", F.col("start").alias("dst")).distinct()
    for table, name in ((allowed, "may"), (failed, "lost")):
        if table is None:
            known, roots = (d.withColumn(name, F.lit(name == "may")) for d in (known, roots))
        else:
            known, roots = (d.join(flag(table, name), "dst", "left").fillna(False, [name]) for d in (known, roots))
    known = written(known, "crawl_links")
    level = written(roots.filter("may").select(
        "start", F.col("dst").alias("url_id"), F.lit(0).alias("depth"), (~F.col("lost")).alias("ok"),
        F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("earlier")), "crawl_level")
    visited = level
    for depth in range(1, max_depth + 1):
        reading = level.filter("ok").select("start", F.col("url_id").alias("src"), F.col("seq").alias("parent"),
                                            (F.col("earlier") + 1).alias("_done"))
        seen = visited.select("start", F.col("url_id").alias("dst"), F.col("seq").alias("_seen"))
        found = reading.join(known, "src").join(seen, ["start", "dst"], "left").filter("_seen IS NULL OR _seen > parent")
        if max_pages is not None:
            by_page = W.partitionBy("start", "parent").orderBy("ord", "dst")
            found = found.withColumn("_slot", F.row_number().over(by_page)).filter(F.col("_slot") <= max_pages).filter(
                F.col("_slot") <= max_pages - F.col("_done"))
        fresh = found.filter("may AND _seen IS NULL").groupBy("start", F.col("dst").alias("url_id")).agg(
            F.min(F.struct("parent", "ord")).alias("_at"), F.bool_and(~F.col("lost")).alias("ok"))
        so_far = level.groupBy("start").agg(
            (F.max("seq") + 1).alias("n"), F.max(F.col("earlier") + F.col("ok").cast("long")).alias("n_ok"))
        queued = _queued(fresh.select("start", "url_id", "_at.parent", "_at.ord", "ok"), so_far)
        if max_pages is not None:
            queued = queued.filter(F.col("earlier") < max_pages)
        level = written(queued.select("start", "url_id", F.lit(depth).alias("depth"), "ok", "seq", "earlier"), "crawl_level")
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited.filter("ok").select("start", "url_id", "depth", F.col("earlier").alias("place"))


def crawl_site(pages: DataFrame, links: DataFrame, starts: DataFrame, robots: DataFrame | None = None, max_pages: int = 10,
               max_depth: int = 2, failed: DataFrame | None = None, allow_external: bool = False,
               exclude: list[str] | None = None, include: list[str] | None = None) -> DataFrame:
    """Capped crawls with filters over stored pages (url_id, url) and their links (src, dst, ord), one per start.

    A link is queued if ``link_allowed`` lets it pass (``max_depth`` bounds its path too, and hosts are compared with the
    page it stands on, which has the start's); a page is visited if it is no file, its address passes the patterns and its
    host's robots rules allow it. Order, cap and result as in ``crawl_frontier``.
    """
    ends = lambda k: pages.select(F.col("url_id").alias(k), F.col("url").alias(f"_{k}"))
    passing = link_allowed("_dst", "_src", max_depth, allow_external, exclude, include)
    queueable = links.join(ends("src"), "src").join(ends("dst"), "dst").filter(passing).select("src", "dst", "ord")
    fit = (urls.scheme("url") != "") & (urls.host("url") != "") & ~is_file_url("url")
    for pattern in exclude or ():
        fit = fit & ~F.col("url").rlike(pattern)
    if include:
        fit = fit & F.greatest(F.lit(False), *[F.col("url").rlike(pattern) for pattern in include])
    may = pages.filter(fit)
    if robots is not None:
        may = robots_allowed(may, robots).filter("allowed")
    return crawl_frontier(queueable, starts, max_depth, max_pages, may.select("url_id"), failed)


def dedup_url_key(rows: DataFrame, scope: list[str], arrival: list[str], url: str = "url") -> DataFrame:
    """First row per page key within ``scope``, with the key and the cache id of the normalised URL."""
    keyed = rows.withColumn("url", urls.normalize(url)).withColumn("url_key", urls.page_key("url")).withColumn(
        "cache_id", F.md5("url"))
    return first_per_key(keyed, [*scope, "url_key"], [F.col(a) for a in arrival])


def page_cache_latest(fetches: DataFrame, now: Column, ttl_seconds: int = 3600, max_entries: int = 500) -> DataFrame:
    """Live cache entries: latest fetch per URL, not expired, newest ``max_entries``."""
    latest = fetches.groupBy("url").agg(F.max(F.struct("ts", "fetch_id")).alias("m")).select("url", "m.ts", "m.fetch_id")
    live = latest.filter(F.col("ts") >= now - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))
    return live.orderBy(F.col("ts").desc(), F.col("fetch_id").desc()).limit(max_entries)
