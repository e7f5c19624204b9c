"""Keyed-table and source queries."""

from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..operators import store as s
from ..session import shared_path
from ..sources import files
from . import sqlgen as q
from .inputs import SQL_VIEWS
from .registry import query
from .web import _unescape_sql as unescape_sql

EXT = "lower(regexp_extract(filename, '[^./](\\.[^./]+)$', 1))"


@query("validate_ingest", f"""
    SELECT upload_id, filename, CASE WHEN coalesce(filename, '') = '' THEN 'filename is required'
      WHEN {EXT} NOT IN ({', '.join(q.lit(e) for e in fixed.UPLOAD_EXTENSIONS)}) THEN 'unsupported file type ''' || {EXT} || ''''
      WHEN size > {fixed.MAX_UPLOAD_BYTES} THEN 'file too large' END AS reject_reason FROM uploads""", "uploads")
def _(t):
    return s.validate_ingest(t.uploads).select("upload_id", "filename", "reject_reason")


@query("sanitize_filename", r"""
    SELECT upload_id, CASE WHEN length(p) > 255 THEN left(left(p, CAST(length(p) - length(e) AS BIGINT)), 200) || e ELSE p END AS safe_name
    FROM (SELECT upload_id, p, regexp_extract(p, '[^.](\.[^.]+)$', 1) AS e
          FROM (SELECT upload_id, replace(replace(filename, '/', ''), '\', '') AS p FROM uploads))""", "uploads")
def _(t):
    return t.uploads.select("upload_id", s.sanitize_filename("filename").alias("safe_name"))


@query("write_page_store", """
    SELECT doc_id, page, doc_name, 'completed' AS status, count(*) OVER (PARTITION BY doc_id) AS page_count, content
    FROM documents_meta JOIN doc_pages USING (doc_id)""", "documents_meta doc_pages")
def _(t):
    """Both tables are written, read back and joined in their buckets."""
    pages, meta = s.write_page_store(t.doc_pages, t.documents_meta)
    return s.read_store_pages(pages, meta).select("doc_id", "page", "doc_name", "status", "page_count", "content")


@query("read_page_ranges", """
    SELECT doc_id, page, doc_name, content FROM documents_meta JOIN doc_pages USING (doc_id)
    WHERE page BETWEEN 1 + doc_id % 7 AND 4 + doc_id % 300""", "documents_meta doc_pages")
def _(t):
    """A range of pages of every document, looked up in the stored tables."""
    pages, meta = s.write_page_store(t.doc_pages, t.documents_meta)
    wanted = t.documents.select("doc_id", (F.col("doc_id") % 7 + 1).cast("int").alias("page_from"),
                                (F.col("doc_id") % 300 + 4).cast("int").alias("page_to"))
    return s.read_store_pages(pages, meta, wanted).select("doc_id", "page", "doc_name", "content")


@query("upsert_latest", """
    SELECT doc_id, min(seq) AS created_at, max(seq) AS seq, arg_max(p, seq) AS progress
    FROM (SELECT doc_id, seq, progress AS p FROM progress_log) GROUP BY 1""", "progress_log")
def _(t):
    rows = t.progress_log.select("doc_id", "seq", "progress", F.col("seq").alias("created_at"))
    return s.upsert_latest(rows, ["doc_id"], "seq")


@query("insert_ignore", """
    SELECT session_id, arg_min(id, (created_at, id)) AS id, arg_min(content, (created_at, id)) AS title FROM history_rows GROUP BY 1""", "history_rows")
def _(t):
    rows = t.history_rows.select("session_id", "id", F.col("content").alias("title"), "created_at")
    return s.insert_ignore(rows, ["session_id"], ["created_at", "id"]).select("session_id", "id", "title")


@query("delete_cascade", """
    SELECT 'session' AS kind, id FROM sessions WHERE id NOT LIKE 'search%'
    UNION ALL SELECT 'message', id FROM history_rows WHERE session_id NOT LIKE 'search%'""", "sessions history_rows")
def _(t):
    doomed = t.sessions.filter(F.col("id").startswith("search_")).select("id")
    parents, children = s.delete_cascade(t.sessions, t.history_rows, doomed, "id", "session_id")
    return parents.select(F.lit("session").alias("kind"), "id").unionByName(children.select(F.lit("message").alias("kind"), "id"))


@query("lookup_by_key", """
    SELECT k.doc_id, doc_name, type, status, CASE WHEN m.doc_id IS NULL THEN 'Document ' || k.doc_id || ' not found' END AS error
    FROM (SELECT doc_id * 2 AS doc_id FROM documents) k LEFT JOIN documents_meta m ON m.doc_id = k.doc_id""", "documents_meta")
def _(t):
    keys = t.documents.select((F.col("doc_id") * 2).alias("doc_id"))
    return s.lookup_by_key(keys, t.documents_meta.select("doc_id", "doc_name", "type", "status"), "doc_id")


@query("skip_processed", """
    SELECT doc_id, doc_name FROM documents_meta d
    WHERE NOT EXISTS (SELECT 1 FROM documents k WHERE contains('out/doc_' || (k.doc_id * 3) || '_content_list.json', d.doc_name))""", "documents_meta")
def _(t):
    done = t.documents.select(F.concat(F.lit("out/doc_"), F.col("doc_id") * 3, F.lit("_content_list.json")).alias("key"))
    return s.skip_processed(t.documents_meta.select("doc_id", "doc_name"), done, "doc_name", "key", contains=True)


@query("skip_processed_exact", """
    SELECT doc_id, doc_name FROM documents_meta WHERE doc_id NOT IN (SELECT doc_id * 3 FROM documents)""", "documents_meta")
def _(t):
    done = t.documents.select(F.concat(F.lit("doc_"), F.col("doc_id") * 3).alias("key"))
    return s.skip_processed(t.documents_meta.select("doc_id", "doc_name"), done, "doc_name", "key")


@query("read_json_kv", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def _(t):
    """Events become a keyed store of JSON files, which is read back and parsed."""
    path = shared_path(t.spark, "json_kv")
    files.write_json_kv(t.events.select(F.col("event_id").cast("string").alias("key"), F.from_json("props", "map<string,string>").alias("value")), path)
    back = files.read_json_kv(t.spark, path).select(F.col("key").cast("long").alias("event_id"), "value")
    return s.json_kv(back, "event_id", "value")


@query("jdbc_history", "SELECT id, session_id, role, content, sources, created_at FROM history_rows", "history_rows")
def _(t):
    """Rows in the stored message table's layout, as read from or written to it over JDBC."""
    return t.history_rows


@query("serp_rows_from_html", """
    SELECT query_id, url, CAST(pos AS INTEGER) AS pos, title FROM (
      SELECT query_id, url, title, row_number() OVER (PARTITION BY query_id ORDER BY pos, engine) - 1 AS pos FROM serp)
    QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY pos) = 1""", "serp")
def _(t):
    from ..functions.text import joined
    wrapped = F.concat(F.lit('<a rel="nofollow" class="result__a" href="//r.example/l/?uddg='), F.url_encode("url"),
                       F.lit('&rut=1"><b>'), "title", F.lit("</b></a>\n"))
    bare = F.concat(F.lit('<a class="result__a" href="'), "url", F.lit('">'), "title", F.lit("</a>\n"))
    anchor = F.when(F.col("engine") == "Bing", bare).otherwise(wrapped)
    stored = t.serp.groupBy("query_id").agg(joined("", anchor, "pos", "engine").alias("html"))
    return files.serp_rows_from_html(stored)


# Stored pages of up to a thousand positions each. Every fourth result has no snippet, some links lead nowhere or to the engine itself. Titles are cut
# at 60 characters, some inside a reference: HTML reads '&amp' without its semicolon as '&' too.
SHEET = 1024
STORED_LINK = ("CASE WHEN engine <> 'Baidu' THEN url WHEN pos % 5 = 1 THEN '/link?url=' || pos WHEN pos % 5 = 2 THEN 'javascript:void(0)' "
               "WHEN pos % 7 = 3 THEN 'https://www.BAIDU.com/cache/' || pos ELSE url END")


@query("serp_rows_by_layout", f"""
    SELECT query_id, engine, sheet, CAST(row_number() OVER (PARTITION BY query_id, engine, sheet ORDER BY spot) - 1 AS INTEGER) AS pos,
           title, url, snippet
    FROM (SELECT query_id, engine, pos // {SHEET} AS sheet, pos AS spot, {q.strip(unescape_sql("regexp_replace(title, '&amp$', '&')"))} AS title,
                 CASE WHEN starts_with(link, '/') THEN 'https://www.baidu.com' || link ELSE link END AS url,
                 {q.strip(unescape_sql('snippet'))} || 'more' AS snippet
          FROM (SELECT *, {STORED_LINK} AS link FROM serp) WHERE pos % 4 <> 3 AND query_id % 11 <> 4)
    WHERE title <> '' AND url NOT LIKE 'javascript:%' AND NOT contains(lower(url), 'baidu.com/cache/')
    QUALIFY pos < 10""", "serp")
def _(t):
    """Result lists become stored pages in the layout of their engine, whose elements are selected again."""
    from ..functions.text import joined
    link = F.concat(F.lit('<a class="x" href="'), F.expr(STORED_LINK), F.lit('"><em>'), "title", F.lit("</em></a>"))
    short = lambda tag, mark: F.when(F.col("pos") % 4 != 3, F.concat(F.lit(f'<{tag} class="{mark}">'), "snippet", F.lit(f"<b> more</b></{tag}>"))).otherwise("")
    shown = (F.when(F.col("engine") == "Bing", F.concat(
                 F.lit('<li class="b_algo wide"><a href="/logo">x</a><h2>'), link, F.lit('</h2><div class="b_caption"><span>ad</span>'), short("p", "s"), F.lit("</div></li>")))
             .when(F.col("engine") == "Baidu", F.concat(
                 F.lit('<div class="c-container result-op"><h3 class="t">'), link, F.lit("</h3><!-- <p> -->"), short("span", "c-span-last"), F.lit("<br></div>")))
             .otherwise(F.concat(F.lit('<div class="vrwrap"><div><h3>'), link, F.lit("</h3></div><script>'</div>'</script>"), short("div", "txt-info"), F.lit("</div>"))))
    head = (F.when(F.col("engine") == "Bing", F.lit('<div class="b_algo"><h2><a href="/ad">ad</a></h2></div><ol id="b_results">'))
            .when(F.col("engine") == "Baidu", F.lit('<div id=content_left>')).otherwise(F.lit("<div class='results main'>")))
    check = F.when(F.col("query_id") % 11 == 4, F.lit('<form id="Captcha">')).otherwise("")
    rows = t.serp.withColumn("sheet", F.floor(F.col("pos") / SHEET)).withColumn("shown", shown)
    pages = rows.groupBy("query_id", "engine", "sheet").agg(joined("", "shown", "pos").alias("html"))
    stored = pages.withColumn("html", F.concat(F.lit("<html><body>"), check, head, "html"))
    return files.serp_rows_by_layout(stored)
