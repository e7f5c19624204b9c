"""Web-page, URL, robots and crawl queries."""

from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import html as H
from ..functions import urls
from ..operators import web as w
from . import sqlgen as q
from .inputs import SQL_VIEWS
from .registry import query

# The SQL twin removes noise by patterns, one element name at a time: right where noise does not nest in its own kind, as on the
# given pages. The operator folds tokens; tests/test_rules.py holds the other cases.
BLOCKS = ("div", "section", "span", "ul", "ol", "li", "p", "a", "table", "article", "main", "button")
_NOISY = "|".join(fixed.NOISE_CLASSES)
NOISE_TAG = f"(?is)<({'|'.join(fixed.NOISE_TAGS)})(?:\\s[^>]*)?>.*?</\\1\\s*>"
NOISE_CLASS = (f"(?is)<({'|'.join(BLOCKS)})\\s(?:[^>]*\\s)?class\\s*=\\s*[\"'][^\"'>]*(?:{_NOISY})[^\"'>]*[\"'][^>]*>.*?</\\1\\s*>")
# the same, one element name at a time, for engines without back-references
NOISE_TAG_PATTERNS = tuple(NOISE_TAG.replace("|".join(fixed.NOISE_TAGS), t).replace("\\1", t) for t in fixed.NOISE_TAGS)
NOISE_CLASS_PATTERNS = tuple(NOISE_CLASS.replace("|".join(BLOCKS), t, 1).replace("\\1", t) for t in BLOCKS)
PATTERNS = NOISE_TAG_PATTERNS + NOISE_CLASS_PATTERNS
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&hellip;", "…"), ("&mdash;", "—"),
    ("&ndash;", "–"), ("&euro;", "€"), ("&amp;", "&"),
)


def _clean_sql(e):
    for p in PATTERNS:
        e = f"regexp_replace({e}, {q.lit(p)}, '', 'g')"
    return f"regexp_replace({e}, {q.lit(H.NOISE_ATTRIBUTE)}, '\\1', 'g')"


def _unescape_sql(e):
    for entity, ch in ENTITIES:
        e = f"replace({e}, {q.lit(entity)}, {q.lit(ch)})"
    return e


def _pieces_sql(e):
    marked = f"regexp_replace(regexp_replace({e}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {q.strip(_unescape_sql('x'))}), "
            "lambda x: x <> '')")


SQL_VIEWS["cleaned"] = ("", f"SELECT page_id, url, html, {_clean_sql('html')} AS cleaned FROM pages")
SQL_VIEWS["pieces"] = ("cleaned", f"SELECT page_id, url, html, cleaned, {_pieces_sql('cleaned')} AS pieces FROM cleaned")
SQL_VIEWS["texts"] = ("pieces", r"""
    SELECT page_id, url, html, cleaned, regexp_replace(array_to_string(pieces, chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS content
    FROM pieces""")
SQL_VIEWS["fetched"] = ("", """
    SELECT page_id, url, html, CAST(CASE page_id % 20 WHEN 0 THEN 404 WHEN 1 THEN 304 ELSE 200 END AS INTEGER) AS status_code,
           CASE WHEN page_id % 17 = 0 THEN 'timeout' END AS error FROM pages""")


def fetched(t):
    return t.pages.select("page_id", "url", "html",
                          F.when(F.col("page_id") % 20 == 0, 404).when(F.col("page_id") % 20 == 1, 304).otherwise(200).alias("status_code"),
                          F.when(F.col("page_id") % 17 == 0, "timeout").alias("error"))


@query("clean_html", "SELECT page_id, cleaned FROM cleaned", "cleaned")
def _(t):
    return w.clean_html(t.pages)


@query("clean_html_nested", "SELECT page_id, cleaned FROM cleaned", "cleaned")
def _(t):
    return w.clean_html(t.pages)


@query("extract_text", "SELECT page_id, content FROM texts", "texts")
def _(t):
    return w.extract_text(t.pages)


def _meta_sql(name):
    tag = f"regexp_extract(cleaned, '(?is)<meta\\s[^>]*name\\s*=\\s*[\"'']{name}[\"''][^>]*>')"
    return _unescape_sql(f"regexp_extract({tag}, '(?is)\\scontent\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)")


SQL_VIEWS["page_meta"] = ("texts", f"""
    SELECT page_id, url,
           coalesce(nullif({q.strip(_unescape_sql("regexp_extract(cleaned, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, ''),
                    array_to_string({_pieces_sql("regexp_extract(cleaned, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, '')) AS title,
           {_meta_sql('description')} AS description, {_meta_sql('keywords')} AS keywords,
           CAST(len({q.words('content')}) AS INTEGER) AS word_count
    FROM texts""")


@query("page_metadata", "SELECT * FROM page_meta", "page_meta")
def _(t):
    return w.page_metadata(t.pages)


@query("search_source_stats", "SELECT page_id, title, url, description, word_count FROM page_meta", "page_meta")
def _(t):
    return w.search_source_stats(t.pages)


@query("extract_links", f"""
    SELECT DISTINCT page_id, link FROM (
      SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href AS link
      FROM (SELECT page_id, url, {q.strip(_unescape_sql('h'))} AS href
            FROM (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html,
                    '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1))) AS h FROM pages))
      WHERE href LIKE '/%')
    WHERE {q.host('link')} = {q.host('url')}
      AND NOT regexp_matches(lower({q.path('link')}), '\\.jpg|\\.jpeg|\\.png|\\.gif|\\.pdf|\\.zip')""")
def _(t):
    return w.extract_links(t.pages)


SQL_VIEWS["validated"] = ("fetched pieces", f"""
    SELECT f.page_id, f.url, CASE
        WHEN NOT ((status_code BETWEEN 200 AND 299 OR status_code = 304) AND error IS NULL) THEN 'unsuccessful'
        WHEN length({q.strip('f.html')}) < 50 THEN 'short_html'
        WHEN {q.contains_any('lower(f.html)', fixed.ANTI_BOT_PHRASES)} THEN 'anti_bot'
        WHEN length(array_to_string(pieces, '')) < 50 THEN 'short_text'
        WHEN len(regexp_extract_all(f.html, '(?i)<script[\\s>]')) > 20 AND length(array_to_string(pieces, '')) < 200 THEN 'script_only'
        END AS reject_reason
    FROM fetched f JOIN pieces p USING (page_id)""")


@query("validate_page", "SELECT * FROM validated", "validated")
def _(t):
    return w.validate_page(fetched(t))


@query("http_success", """
    SELECT page_id, (status_code BETWEEN 200 AND 299 OR status_code = 304) AND error IS NULL AS success FROM fetched""", "fetched")
def _(t):
    return fetched(t).select("page_id", w.http_success("status_code", "error").alias("success"))


@query("split_scraped", """
    SELECT error IS NULL AND length(content) > 100 AS usable, count(*) AS n_pages
    FROM fetched JOIN texts USING (page_id) GROUP BY 1""", "fetched texts")
def _(t):
    return w.split_scraped(fetched(t).withColumn("content", H.text_of(H.text_pieces(H.clean("html")))))


@query("url_content_relevance", """
    SELECT page_id, CAST(len(p) AS INTEGER) AS n_words, CAST(f AS INTEGER) AS n_found, len(p) > 0 AND f < len(p) * 0.3 AS low_relevance
    FROM (SELECT page_id, p, len(list_filter(p, lambda x: contains(l, x))) AS f
          FROM (SELECT page_id, lower(content) AS l, list_filter(list_distinct(string_split(lower(url), '/')),
                  lambda x: length(x) > 3 AND regexp_full_match(x, '[\\p{L}\\p{N}]+')) AS p FROM texts))""".replace("\\\\", "\\"), "texts")
def _(t):
    return w.url_content_relevance(t.pages.select("page_id", "url", H.text_of(H.text_pieces(H.clean("html"))).alias("content")))


@query("domain_mismatch", f"SELECT src, dst, {q.host('src_url')} <> {q.host('dst_url')} AS mismatch FROM links", "links")
def _(t):
    return w.domain_mismatch(t.links, "src_url", "dst_url").select("src", "dst", "mismatch")


@query("page_quality_report", f"""
    SELECT {q.host('url')} AS host, coalesce(reject_reason, 'ok') AS outcome, count(*) AS n_pages
    FROM validated GROUP BY 1, 2""", "validated")
def _(t):
    return w.page_quality_report(w.validate_page(fetched(t)))


# --- URLs ----------------------------------------------------------------------------------------

SQL_VIEWS["url_forms"] = ("", f"""
    SELECT page_id, form, CASE form WHEN 0 THEN url WHEN 1 THEN replace(url, 'http', 'htp') WHEN 2 THEN 'www.' || {q.bare_host('url')}
           WHEN 3 THEN {q.host('url')} WHEN 4 THEN 'see ' || url || ', or ' || url ELSE 'http://localhost:8080/' || page_id END AS text
    FROM pages, range(6) r(form)""")


def url_forms(t):
    forms = [F.col("url"), F.replace("url", F.lit("http"), F.lit("htp")), F.concat(F.lit("www."), urls.bare_host("url")),
             urls.host("url"), F.concat(F.lit("see "), "url", F.lit(", or "), "url"),
             F.concat(F.lit("http://localhost:8080/"), "page_id")]
    return t.pages.select("page_id", F.posexplode(F.array(*forms)).alias("form", "text"))


@query("is_valid_url", f"""
    SELECT page_id, CAST(form AS INTEGER) AS form, regexp_matches(text, {q.lit(H.url_pattern(fixed.URL_BODY, True))}) OR text LIKE 'www.%' AS valid
    FROM url_forms""", "url_forms")
def _(t):
    return url_forms(t).select("page_id", "form", w.is_valid_url("text").alias("valid"))


@query("extract_first_url", f"""
    SELECT page_id, CAST(form AS INTEGER) AS form,
           nullif(regexp_replace(regexp_extract(text, {q.lit(H.url_pattern(fixed.URL_BODY, False))}), '[.,;:!?''"]+$', ''), '') AS found
    FROM url_forms""", "url_forms")
def _(t):
    return url_forms(t).select("page_id", "form", w.first_url("text").alias("found"))


SQL_VIEWS["link_forms"] = ("", f"""
    SELECT page_id, url AS base, form, CASE form WHEN 0 THEN url WHEN 1 THEN root || '/x.PDF' WHEN 2 THEN 'https://www.facebook.com/p' || page_id
           WHEN 3 THEN 'mailto:a@b.c' WHEN 4 THEN root || '/a/b/c/d' WHEN 5 THEN 'https://other.example/q'
           ELSE replace(root, '://', '://www.') || '/k?z=.pdf' END AS link
    FROM (SELECT page_id, url, regexp_extract(url, '^([a-z]*://[^/?#]*)', 1) AS root FROM pages), range(7) r(form)""")


def link_forms(t):
    root = F.regexp_extract("url", "^([a-z]*://[^/?#]*)", 1)
    forms = [F.col("url"), F.concat(root, F.lit("/x.PDF")), F.concat(F.lit("https://www.facebook.com/p"), "page_id"),
             F.lit("mailto:a@b.c"), F.concat(root, F.lit("/a/b/c/d")), F.lit("https://other.example/q"),
             F.concat(F.replace(root, F.lit("://"), F.lit("://www.")), F.lit("/k?z=.pdf"))]
    return t.pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.array(*forms)).alias("form", "link"))


_ENDS = "|".join(H.escape(e) for e in fixed.FILE_EXTENSIONS)
FILE_SQL = f"regexp_matches(lower({q.path('link')}), '(?:{_ENDS})$')"
SOCIAL_SQL = q.contains_any(q.bare_host("link"), fixed.SOCIAL_DOMAINS)


@query("classify_url", f"""
    SELECT page_id, CAST(form AS INTEGER) AS form, {FILE_SQL} AS is_file, {SOCIAL_SQL} AS is_social, {q.depth('link')} AS depth,
           {q.bare_host('link')} = {q.bare_host('base')} AS same_domain FROM link_forms""", "link_forms")
def _(t):
    return w.classify_url(link_forms(t), "link", "base").select("page_id", "form", "is_file", "is_social", "depth", "same_domain")


@query("filter_links", f"""
    SELECT DISTINCT base, link FROM link_forms
    WHERE {q.host('link')} <> '' AND NOT {FILE_SQL} AND NOT {SOCIAL_SQL} AND link NOT LIKE 'mailto:%'
      AND {q.bare_host('link')} = {q.bare_host('base')} AND {q.depth('link')} <= 3
      AND NOT regexp_matches(link, 'utm_source') AND regexp_matches(link, 'example|local')""", "link_forms")
def _(t):
    return w.filter_links(link_forms(t), max_depth=3, exclude=["utm_source"], include=["example", "local"])


SQL_VIEWS["rules"] = ("robots", f"""
    SELECT host, kind, value FROM (
      SELECT host, kind, value, last_value(CASE WHEN kind = 'user-agent' THEN value END IGNORE NULLS)
               OVER (PARTITION BY host ORDER BY pos ROWS UNBOUNDED PRECEDING) AS agent
      FROM (SELECT host, i AS pos, lower(regexp_extract(line, '(?i)^(user-agent|disallow|allow):', 1)) AS kind,
                   {q.strip("regexp_replace(line, '^[^:]*:', '')")} AS value
            FROM (SELECT host, i, {q.strip('lines[i]')} AS line FROM (SELECT host, string_split(robots_txt, chr(10)) AS lines FROM robots),
                  unnest(range(1, len(lines) + 1)) AS u(i)) WHERE line <> '' AND line NOT LIKE '#%'))
    WHERE agent = '*' AND kind IN ('allow', 'disallow') AND value <> ''""")
SQL_VIEWS["robots_ok"] = ("rules", f"""
    SELECT page_id, url, coalesce(bool_or(kind = 'allow' AND starts_with({q.path('url')}, value)), false)
           OR NOT coalesce(bool_or(kind = 'disallow' AND starts_with({q.path('url')}, value)), false) AS allowed
    FROM pages LEFT JOIN rules ON host = {q.host('url')} GROUP BY 1, 2""")


@query("robots_allowed", "SELECT page_id, url, allowed FROM robots_ok", "robots_ok")
def _(t):
    return w.robots_allowed(t.pages.select("page_id", "url"), t.robots)


# Every page of the walk has one parent on the given links, so its path of link positions is its place in the queue.
@query("crawl_frontier", """RECURSIVE
    WITH roots AS (SELECT page_id FROM pages WHERE page_id NOT IN (SELECT dst FROM links)),
    ok AS (SELECT page_id FROM robots_ok WHERE allowed OR page_id IN (SELECT page_id FROM roots)),
    walk(start, url_id, depth, trail) AS (
      SELECT page_id, page_id, 0, CAST([] AS BIGINT[]) FROM roots
      UNION ALL
      SELECT w.start, l.dst, w.depth + 1, list_append(w.trail, l.ord) FROM walk w JOIN links l ON l.src = w.url_id JOIN ok ON ok.page_id = l.dst)
    SELECT url_id, depth, row_number() OVER (PARTITION BY start ORDER BY depth, trail) - 1 AS place FROM walk""", "links robots_ok")
def _(t):
    roots = t.pages.select("page_id").join(t.links.select(F.col("dst").alias("page_id")), "page_id", "left_anti")
    ok = w.robots_allowed(t.pages.select("page_id", "url"), t.robots).filter("allowed").select("page_id").union(roots).distinct()
    return w.crawl_frontier(t.links.select("src", "dst", "ord"), roots.withColumnRenamed("page_id", "start"), max_depth=60,
                            allowed=ok.withColumnRenamed("page_id", "url_id")).select("url_id", "depth", "place")


SITE_LINKS = ("p + 1", "2 * p + 1", "p + 3", "p // 2", "2 * p + 2", "p + 1", "p - 2", "p // 3", "p + 7", "3 * p + 1", "p", "p + 2", "p + 4")
CRAWL_PAGES = 10
SQL_VIEWS["site_links"] = ("", f"""
    SELECT p AS src, dst[i] AS dst, i AS ord FROM (SELECT page_id AS p, [{', '.join(SITE_LINKS)}] AS dst FROM pages),
      unnest(range(1, {len(SITE_LINKS) + 1})) AS u(i)""")
SQL_VIEWS["site_pages"] = ("robots_ok", f"""
    SELECT page_id, url AS link, page_id % 13 <> 5 AS ok,
           {q.host('url')} <> '' AND NOT {FILE_SQL.replace('link', 'url')} AND NOT regexp_matches(url, 'utm_source|/es/')
           AND regexp_matches(url, 'example|local') AS fit, allowed FROM robots_ok""")
SQL_VIEWS["site_queueable"] = ("site_links site_pages", f"""
    SELECT src, dst, min(ord) AS ord, any_value(fit AND allowed) AS may, any_value(ok) AS ok FROM site_links JOIN site_pages ON page_id = dst
    WHERE fit AND NOT {SOCIAL_SQL} AND {q.depth('link')} <= 2 GROUP BY 1, 2""")
_NUMBERED = "start, url_id, depth, seq, ok, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY start ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + base AS earlier"


@query("crawl_site", f"""
    WITH l0 AS (SELECT page_id AS start, page_id AS url_id, 0 AS depth, 0 AS seq, ok, 0 AS earlier FROM site_pages WHERE fit AND allowed),
    q1 AS (
      SELECT start, dst AS url_id, 1 AS depth, row_number() OVER (PARTITION BY start ORDER BY slot) AS seq, ok, 1 AS base
      FROM (SELECT start, dst, s.ok, may, row_number() OVER (PARTITION BY start ORDER BY ord) AS slot
            FROM l0 JOIN site_queueable s ON src = url_id WHERE l0.ok AND dst <> start) WHERE slot <= {CRAWL_PAGES} - 1 AND may),
    l1 AS (SELECT * FROM (SELECT {_NUMBERED} FROM q1) WHERE earlier < {CRAWL_PAGES}),
    seen AS (SELECT start, url_id, seq FROM l0 UNION ALL SELECT start, url_id, seq FROM l1),
    q2 AS (
      SELECT start, dst AS url_id, 2 AS depth, any_value(ok) AS ok, min((parent, slot)) AS first_at
      FROM (SELECT p.start, dst, s.ok, may, p.seq AS parent, seen.seq AS seen_seq, earlier,
                   row_number() OVER (PARTITION BY p.start, p.seq ORDER BY ord) AS slot
            FROM l1 p JOIN site_queueable s ON src = p.url_id LEFT JOIN seen ON seen.start = p.start AND seen.url_id = dst
            WHERE p.ok AND (seen.seq IS NULL OR seen.seq > p.seq))
      WHERE slot <= {CRAWL_PAGES} - 1 - earlier AND may AND seen_seq IS NULL GROUP BY 1, 2),
    l2 AS (
      SELECT * FROM (SELECT {_NUMBERED} FROM (
        SELECT start, url_id, depth, ok, row_number() OVER (PARTITION BY start ORDER BY first_at) AS seq, base
        FROM q2 JOIN (SELECT start, max(earlier + CAST(ok AS INT)) AS base FROM l1 GROUP BY 1) USING (start))) WHERE earlier < {CRAWL_PAGES})
    SELECT start, url_id, depth, CAST(earlier AS BIGINT) AS place
    FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE ok""", "site_queueable")
def _(t):
    """A crawl of at most ten pages from every page; every thirteenth page fails."""
    pages = t.pages.select(F.col("page_id").alias("url_id"), "url")
    targets = F.expr(f"array({', '.join(SITE_LINKS)})".replace("//", "div").replace("p", "page_id"))
    links = t.pages.select(F.col("page_id").alias("src"), F.posexplode(targets).alias("ord", "dst"))
    return w.crawl_site(pages, links, pages.select(F.col("url_id").alias("start")), t.robots, CRAWL_PAGES, 2,
                        failed=pages.filter("url_id % 13 = 5"), allow_external=True, exclude=["utm_source|/es/"],
                        include=["example", "local"])


SQL_VIEWS["serp_unique"] = ("serp", """
    SELECT query_id, variant, engine, pos, title, url, snippet, url_key, md5(url) AS cache_id, arrival
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url_key ORDER BY arrival) AS rn
          FROM (SELECT *, split_part(rtrim(url, '/'), '?', 1) AS url_key,
                       CASE engine WHEN 'Bing' THEN 0 WHEN 'Baidu' THEN 1 ELSE 2 END * 1000000000 + pos AS arrival FROM serp))
    WHERE rn = 1""")


def arrival():
    return (F.array_position(F.array(*[F.lit(e) for e in fixed.ENGINES]), F.col("engine")) - 1) * 1000000000 + F.col("pos")


@query("dedup_url_key", "SELECT query_id, engine, pos, url, url_key, cache_id FROM serp_unique", "serp_unique")
def _(t):
    rows = t.serp.withColumn("arrival", arrival())
    return w.dedup_url_key(rows, ["query_id"], ["arrival"]).select("query_id", "engine", "pos", "url", "url_key", "cache_id")


@query("page_cache_latest", """
    SELECT url, ts, fetch_id FROM (
      SELECT event_type || '/' || user_id AS url, max(ts) AS ts, arg_max(event_id, ts) AS fetch_id FROM events GROUP BY 1)
    WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY ORDER BY ts DESC, fetch_id DESC LIMIT 500""")
def _(t):
    fetches = t.events.select(F.concat_ws("/", "event_type", "user_id").alias("url"), "ts", F.col("event_id").alias("fetch_id"))
    return w.page_cache_latest(fetches, F.to_timestamp(F.lit("2024-01-31 00:00:00")), ttl_seconds=10 * 86400)
