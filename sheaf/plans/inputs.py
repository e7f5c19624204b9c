"""The given tables and the inputs derived from them, written once for Spark and once as SQL views.

Every derived input keeps all rows of its source table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.files import spread
from ..functions.skew import scalar_count
from ..functions.text import joined, words
from . import sqlgen as q

DAY0 = "2024-01-01 00:00:00"


class Tables:
    """Lazy access to the given tables and derived inputs of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.read("documents"))

    @cached_property
    def pages(self) -> DataFrame:
        return spread(self.read("pages"))

    @cached_property
    def conversations(self) -> DataFrame:
        return self.read("conversations")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def queries(self) -> DataFrame:
        return self.read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    # --- documents ---
    @cached_property
    def doc_pages(self) -> DataFrame:
        return self.documents.select(
            "doc_id", F.posexplode(F.split("text", "\n")).alias("page", "content")
        ).withColumn("page", F.col("page") + 1)

    @cached_property
    def documents_meta(self) -> DataFrame:
        return self.documents.select(
            "doc_id",
            F.concat(F.lit("doc_"), "doc_id").alias("doc_name"),
            F.col("source").alias("doc_description"),
            F.col("lang").alias("type"),
            F.element_at(F.array(*[F.lit(s) for s in ("completed", "processing", "failed", "uploaded")]),
                         (F.col("doc_id") % 4 + 1).cast("int")).alias("status"),
            F.size(F.split("text", "\n")).alias("page_count"),
            (F.col("n_chars") * 977).alias("file_size"),
            F.timestamp_add("SECOND", F.col("doc_id").cast("int"), F.to_timestamp(F.lit(DAY0))).alias("created_at"),
            F.timestamp_add("SECOND", (F.col("doc_id") + F.col("n_chars")).cast("int"),
                            F.to_timestamp(F.lit(DAY0))).alias("updated_at"),
        )

    @cached_property
    def outline(self) -> DataFrame:
        level = F.element_at(F.array(*[F.lit(x) for x in (2, 1, 2, 3, 3)]), (F.col("page") % 5 + 1).cast("int"))
        return self.doc_pages.select(
            "doc_id", F.col("page").alias("seq"), level.alias("level"),
            F.array_join(F.slice(words("content"), 1, 3), " ").alias("title"), "page")

    @cached_property
    def items(self) -> DataFrame:
        kinds = F.array(*[F.lit(x) for x in ("table", "text", "text", "image", "text", "equation", "text")])
        return self.doc_pages.select(
            "doc_id", (F.col("page") - 1).alias("idx"),
            F.floor((F.col("page") - 1) / 3).cast("int").alias("page_idx"),
            F.element_at(kinds, (F.col("page") % 7 + 1).cast("int")).alias("type"),
            F.col("content").alias("text"),
            F.when(F.col("page") == 1, 1).otherwise(0).alias("text_level"),
            F.when((F.col("page") % 7).isin(0, 3), F.slice(words("content"), 1, 2)).alias("captions"))

    @cached_property
    def uploads(self) -> DataFrame:
        ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".TXT", ".exe", ".md", "")]),
                           (F.col("doc_id") % 5 + 1).cast("int"))
        stem = F.when(F.col("doc_id") % 7 == 0, F.repeat(F.lit("long"), 70)).otherwise(F.lit("doc_"))
        return self.documents.select(
            F.col("doc_id").alias("upload_id"),
            F.when(F.col("doc_id") % 11 != 0,
                   F.concat(F.col("source"), F.lit("/..\\"), stem, F.col("doc_id"), ext)).alias("filename"),
            (F.col("n_chars") * 50000).alias("size"))

    # --- web ---
    @cached_property
    def links(self) -> DataFrame:
        src = self.pages.select(F.col("page_id").alias("src"), F.col("url").alias("src_url"))
        out = src.select("src", "src_url", F.posexplode(
            F.array(F.col("src") * 2 + 1, F.col("src") * 2 + 2)).alias("ord", "dst"))
        dst = self.pages.select(F.col("page_id").alias("dst"), F.col("url").alias("dst_url"))
        return out.join(dst, "dst").select("src", "src_url", "dst", "dst_url", "ord")

    @cached_property
    def robots(self) -> DataFrame:
        at = urls.path("url")
        return self.pages.groupBy(urls.host("url").alias("host")).agg(F.min(at).alias("p")).select(
            "host", F.concat(
                F.lit("# rules\nUser-agent: other\nDisallow: /\nUser-agent: *\nDisallow: "),
                F.regexp_extract("p", "^(/[^/]*/)", 1), F.lit("\nAllow: "), F.col("p"),
                F.lit("\nDisallow:\n")).alias("robots_txt"))

    @cached_property
    def serp(self) -> DataFrame:
        title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
        first = F.regexp_extract("html", "(?s)<p>(.*?)(?:</p>|<p>)", 1)
        tail = F.when(F.col("url").contains("?"), F.lit("&from=feed")).otherwise(F.lit("?from=feed"))
        shown = F.array(*[F.struct(F.lit(e).alias("engine"), u.alias("url")) for e, u in (
            ("Bing", F.col("url")), ("Baidu", F.concat("url", F.lit("/"))), ("Sogou", F.concat("url", tail)))])
        return self.pages.select(
            F.pmod(F.col("page_id"), scalar_count(self.read("benchmark"))).alias("query_id"), F.col("page_id").alias("pos"), title.alias("title"),
            F.regexp_replace(first, "<[^>]*>", "").alias("snippet"), F.explode(shown).alias("s")
        ).select("query_id", F.lit(0).alias("variant"), "s.engine", "pos", "title", "s.url", "snippet")

    # --- conversations ---
    @cached_property
    def memory(self) -> DataFrame:
        kinds = F.array(*[F.lit(x) for x in ("raw", "semantic", "episodic", "procedural")])
        return self.conversations.select(
            F.concat_ws("_", "conv_id", "turn").alias("id"),
            F.element_at(kinds, (F.col("turn") % 4 + 1).cast("int")).alias("type"),
            F.col("text").alias("content"),
            F.slice(F.filter(words("text"), lambda x: F.length(x) > 4), 1, 3).alias("keywords"),
            F.col("role").alias("owner"),
            ((F.col("turn") % 5) != 4).alias("enabled"),
            (F.col("conv_id") * 10 + F.col("turn")).alias("seq"))

    @cached_property
    def memory_json(self) -> DataFrame:
        """Stored extraction replies: a list, a list with blank content, a non-list."""
        first = F.substring_index("text", " ", 3)
        item = lambda c, k: F.struct(c.alias("content"), k.alias("keywords"))
        raw = F.to_json(F.struct(
            F.array(item(F.col("text"), F.lit(" alpha, beta ,, gamma")), item(F.lit("  "), F.lit("x"))).alias("semantic"),
            F.lit("nothing").alias("episodic"),
            F.array(item(first, F.lit("")), item(F.col("role"), F.col("role"))).alias("procedural")))
        return self.conversations.select(
            F.concat_ws("_", F.lit("s"), "conv_id", "turn").alias("session_id"), raw.alias("raw"))

    @cached_property
    def sessions(self) -> DataFrame:
        return self.conversations.filter("turn = 0").select(
            F.concat(F.when(F.col("conv_id") % 10 == 0, "search_").otherwise("conv_"), F.col("conv_id")).alias("id"),
            F.col("text").alias("title"), "conv_id",
            F.timestamp_add("SECOND", F.col("conv_id").cast("int"), F.to_timestamp(F.lit(DAY0))).alias("updated_at"))

    @cached_property
    def history_rows(self) -> DataFrame:
        """Conversation turns in the layout of the stored message table."""
        return self.conversations.select(
            F.concat_ws("_", F.lit("m"), "conv_id", "turn").alias("id"),
            F.concat(F.when(F.col("conv_id") % 10 == 0, "search_").otherwise("conv_"),
                     F.col("conv_id")).alias("session_id"),
            "role", F.col("text").alias("content"),
            F.when(F.col("role") == "assistant",
                   F.concat(F.lit('[{"doc_id":"d'), F.col("conv_id"), F.lit('","pages":"'), F.col("turn") + 1,
                            F.lit('"}]'))).alias("sources"),
            F.timestamp_add("SECOND", F.floor(F.col("turn") / 2).cast("int"),
                            F.to_timestamp(F.lit(DAY0))).alias("created_at"))

    @cached_property
    def message_vectors(self) -> DataFrame:
        v = self.embeddings.select(F.col("vec_id").alias("_v"), "embedding")
        return self.conversations.withColumn("_v", F.pmod(F.col("conv_id") * 8 + F.col("turn"), scalar_count(self.embeddings))) \
            .join(v, "_v").drop("_v")

    @cached_property
    def owned_memory(self) -> DataFrame:
        """What each conversation remembers: all turns but the last, some without a vector."""
        m = self.message_vectors
        last = m.groupBy("conv_id").agg(F.max("turn").alias("_last"))
        return m.join(last, "conv_id").filter("turn < _last").select(
            F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("conv_id").alias("owner"), (F.col("conv_id") * 10 + F.col("turn")).alias("seq"),
            F.when(F.col("turn") % 2 == 0, "semantic").otherwise("episodic").alias("type"), F.col("text").alias("content"),
            F.slice(F.filter(words("text"), lambda x: F.length(x) > 4), 1, 3).alias("keywords"),
            ((F.col("turn") % 5) != 4).alias("enabled"), F.when(F.col("turn") % 4 != 3, F.col("embedding")).alias("embedding"))

    @cached_property
    def owner_queries(self) -> DataFrame:
        """The last turn of each conversation; a third has no vector."""
        last = self.message_vectors.groupBy("conv_id").agg(F.max_by(F.struct("text", "embedding"), "turn").alias("m"))
        return last.select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("owner"), F.col("m.text").alias("query"),
                           F.when(F.col("conv_id") % 3 != 0, F.col("m.embedding")).alias("embedding"))

    @cached_property
    def label_centroids(self) -> DataFrame:
        """One query vector per label: the mean of its vectors."""
        flat = self.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
        means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("a"))
        return rows.select(F.col("label").cast("long").alias("query_id"),
                           F.transform("a", lambda r: r["m"]).alias("embedding"))

    @cached_property
    def spans(self) -> DataFrame:
        start = F.col("turn") * 10.0
        return self.conversations.select(
            F.col("conv_id").alias("trace_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("span_id"),
            F.when(F.col("turn") > 0,
                   F.col("conv_id") * 100 + F.floor((F.col("turn") - 1) / 2)).alias("parent_id"),
            start.alias("start_s"), (start + F.length("text") / F.lit(1000.0)).alias("end_s"),
            F.when(F.length("text") > 1500, "error").otherwise("ok").alias("status"),
            F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("tokens"))

    # --- events ---
    @cached_property
    def progress_log(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"),
            F.expr("""CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'click' THEN ''
                      WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' END""").alias("status"),
            (F.col("value").cast("int") - 20).alias("progress"),
            F.when(F.col("event_type") == "view", "").otherwise(
                F.concat(F.lit("step "), "event_type")).alias("step"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("error "), F.col("props"))).alias("error"))

    @cached_property
    def llm_outputs(self) -> DataFrame:
        """One stored model reply per event: fenced, bare, embedded, sloppy, incomplete."""
        point = F.concat(F.lit('[{"x": "'), "event_type", F.lit('", "y": '), F.col("value").cast("string"),
                         F.lit('}, {"x": "user", "y": "'), F.col("user_id").cast("string"), F.lit('"}]'))
        bad = F.concat(F.lit('[{"x": "'), "event_type", F.lit('"}]'))
        sloppy = F.regexp_replace(F.regexp_replace(point, '"', "'"), r"\}\]$", "},]")
        return self.events.select(F.col("event_id").alias("id"), (
            F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("```json\n"), point, F.lit("\n```")))
            .when(F.col("event_id") % 5 == 1, F.concat(F.lit("Result:\n```\n"), point, F.lit("\n```\nbye")))
            .when(F.col("event_id") % 5 == 2, F.concat(F.lit("Points: "), point, F.lit(" as asked")))
            .when(F.col("event_id") % 5 == 3, sloppy)
            .otherwise(bad)).alias("raw"))

    @cached_property
    def windows(self) -> DataFrame:
        """Ten-page windows of raw text."""
        win = F.floor((F.col("page") - 1) / 10).cast("int").alias("win")
        return self.doc_pages.groupBy("doc_id", win).agg(
            F.min("page").alias("page_from"), F.max("page").alias("page_to"),
            joined("\n", "content", "page").alias("content"))


SQL_VIEWS: dict[str, tuple[str, str]] = {
    "qs": ("", "SELECT item_id AS query_id, text AS query FROM benchmark"),
    "doc_pages": ("", """
        SELECT doc_id, CAST(i AS INTEGER) AS page, parts[i] AS content
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)"""),
    "documents_meta": ("", """
        SELECT doc_id, 'doc_' || doc_id AS doc_name, source AS doc_description, lang AS type,
               ['completed', 'processing', 'failed', 'uploaded'][doc_id % 4 + 1] AS status,
               CAST(len(string_split(text, chr(10))) AS INTEGER) AS page_count, n_chars * 977 AS file_size,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS created_at,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id + n_chars) AS updated_at
        FROM documents"""),
    "outline": ("doc_pages", f"""
        SELECT doc_id, page AS seq, CAST([2, 1, 2, 3, 3][page % 5 + 1] AS INTEGER) AS level,
               array_to_string({q.words('content')}[1:3], ' ') AS title, page
        FROM doc_pages"""),
    "items": ("doc_pages", """
        SELECT doc_id, page - 1 AS idx, CAST((page - 1) // 3 AS INTEGER) AS page_idx,
               ['table', 'text', 'text', 'image', 'text', 'equation', 'text'][page % 7 + 1] AS type,
               content AS text, CASE WHEN page = 1 THEN 1 ELSE 0 END AS text_level,
               CASE WHEN page % 7 IN (0, 3) THEN {W}[1:2] END AS captions
        FROM doc_pages""".replace("{W}", q.words("content"))),
    "uploads": ("", r"""
        SELECT doc_id AS upload_id,
               CASE WHEN doc_id % 11 <> 0 THEN source || '/..\'
                 || CASE WHEN doc_id % 7 = 0 THEN repeat('long', 70) ELSE 'doc_' END || doc_id
                 || ['.pdf', '.TXT', '.exe', '.md', ''][doc_id % 5 + 1] END AS filename,
               n_chars * 50000 AS size
        FROM documents"""),
    "links": ("", """
        SELECT a.page_id AS src, a.url AS src_url, b.page_id AS dst, b.url AS dst_url,
               CAST(b.page_id - 2 * a.page_id - 1 AS INTEGER) AS ord
        FROM pages a JOIN pages b ON b.page_id IN (2 * a.page_id + 1, 2 * a.page_id + 2)"""),
    "robots": ("", f"""
        SELECT host, '# rules' || chr(10) || 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10)
               || 'User-agent: *' || chr(10) || 'Disallow: ' || regexp_extract(p, '^(/[^/]*/)', 1) || chr(10)
               || 'Allow: ' || p || chr(10) || 'Disallow:' || chr(10) AS robots_txt
        FROM (SELECT {q.host('url')} AS host, min({q.path('url')}) AS p FROM pages GROUP BY 1)"""),
    "serp": ("", """
        SELECT page_id % (SELECT count(*) FROM benchmark) AS query_id, 0 AS variant, engine, page_id AS pos, title,
               CASE engine WHEN 'Bing' THEN url WHEN 'Baidu' THEN url || '/'
                    ELSE url || CASE WHEN contains(url, '?') THEN '&from=feed' ELSE '?from=feed' END END AS url, snippet
        FROM (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
                     regexp_replace(regexp_extract(html, '(?s)<p>(.*?)(?:</p>|<p>)', 1), '<[^>]*>', '', 'g') AS snippet
              FROM pages), (VALUES ('Bing'), ('Baidu'), ('Sogou')) e(engine)"""),
    "memory": ("", f"""
        SELECT conv_id || '_' || turn AS id, ['raw', 'semantic', 'episodic', 'procedural'][turn % 4 + 1] AS type,
               text AS content, list_filter({q.words('text')}, lambda x: length(x) > 4)[1:3] AS keywords,
               role AS owner, turn % 5 <> 4 AS enabled, conv_id * 10 + turn AS seq
        FROM conversations"""),
    "sessions": ("", """
        SELECT CASE WHEN conv_id % 10 = 0 THEN 'search_' ELSE 'conv_' END || conv_id AS id, text AS title, conv_id,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id) AS updated_at
        FROM conversations WHERE turn = 0"""),
    "history_rows": ("", """
        SELECT 'm_' || conv_id || '_' || turn AS id,
               CASE WHEN conv_id % 10 = 0 THEN 'search_' ELSE 'conv_' END || conv_id AS session_id, role, text AS content,
               CASE WHEN role = 'assistant' THEN '[{"doc_id":"d' || conv_id || '","pages":"' || (turn + 1) || '"}]' END AS sources,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(turn // 2) AS created_at
        FROM conversations"""),
    "message_vectors": ("", """
        SELECT c.*, e.embedding FROM conversations c JOIN embeddings e ON e.vec_id = (c.conv_id * 8 + c.turn) % (SELECT count(*) FROM embeddings)"""),
    "owned_memory": ("message_vectors", f"""
        SELECT conv_id || '_' || turn AS id, conv_id AS owner, conv_id * 10 + turn AS seq,
               CASE WHEN turn % 2 = 0 THEN 'semantic' ELSE 'episodic' END AS type, text AS content,
               list_filter({q.words('text')}, lambda x: length(x) > 4)[1:3] AS keywords, turn % 5 <> 4 AS enabled,
               CASE WHEN turn % 4 <> 3 THEN embedding END AS embedding
        FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM message_vectors) WHERE turn < last"""),
    "owner_queries": ("message_vectors", """
        SELECT conv_id AS query_id, conv_id AS owner, text AS query, CASE WHEN conv_id % 3 <> 0 THEN embedding END AS embedding
        FROM message_vectors QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"""),
    "label_centroids": ("", """
        SELECT label AS query_id, list(m ORDER BY i) AS embedding
        FROM (SELECT CAST(label AS BIGINT) AS label, i, avg(embedding[i]::DOUBLE) AS m
              FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i) GROUP BY 1, 2) GROUP BY 1"""),
    "spans": ("", """
        SELECT conv_id AS trace_id, conv_id * 100 + turn AS span_id,
               CASE WHEN turn > 0 THEN conv_id * 100 + (turn - 1) // 2 END AS parent_id,
               turn * 10.0::DOUBLE AS start_s, turn * 10.0::DOUBLE + length(text) / 1000.0::DOUBLE AS end_s,
               CASE WHEN length(text) > 1500 THEN 'error' ELSE 'ok' END AS status,
               greatest(1, length(text) // 4) AS tokens
        FROM conversations"""),
    "progress_log": ("", """
        SELECT user_id AS doc_id, event_id AS seq,
               CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'click' THEN ''
                    WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' END AS status,
               CAST(trunc(value) AS INTEGER) - 20 AS progress,
               CASE WHEN event_type = 'view' THEN '' ELSE 'step ' || event_type END AS step,
               CASE WHEN event_type = 'error' THEN 'error ' || props END AS error
        FROM events"""),
    "llm_outputs": ("", r"""
        SELECT id, CASE id % 5 WHEN 0 THEN '```json' || chr(10) || point || chr(10) || '```'
                    WHEN 1 THEN 'Result:' || chr(10) || '```' || chr(10) || point || chr(10) || '```' || chr(10) || 'bye'
                    WHEN 2 THEN 'Points: ' || point || ' as asked'
                    WHEN 3 THEN regexp_replace(replace(point, '"', ''''), '\}\]$', '},]')
                    ELSE bad END AS raw
        FROM (SELECT event_id AS id,
                     '[{"x": "' || event_type || '", "y": ' || value || '}, {"x": "user", "y": "' || user_id || '"}]' AS point,
                     '[{"x": "' || event_type || '"}]' AS bad FROM events)"""),
    "windows": ("doc_pages", """
        SELECT doc_id, CAST((page - 1) // 10 AS INTEGER) AS win, min(page) AS page_from, max(page) AS page_to,
               string_agg(content, chr(10) ORDER BY page) AS content
        FROM doc_pages GROUP BY 1, 2"""),
}
