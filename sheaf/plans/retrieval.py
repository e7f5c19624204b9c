"""Retrieval, reranking and vector queries."""

from pyspark.sql import functions as F

from ..operators import retrieval as r
from ..operators import vectors as v
from . import sqlgen as q
from .inputs import SQL_VIEWS
from .registry import query

SPEC = "CASE WHEN page_from = page_to THEN page_from::VARCHAR ELSE page_from || '-' || page_to END"

SQL_VIEWS["kw_scores"] = ("qs windows", """
    SELECT w.query_id, d.doc_id, d.win, count(*) AS score
    FROM (SELECT DISTINCT query_id, unnest({}) AS term FROM qs) w JOIN windows d ON contains(lower(d.content), w.term)
    GROUP BY 1, 2, 3""".format(q.terms("query")))
SQL_VIEWS["post_index"] = ("windows", f"SELECT doc_id, win, unnest({q.terms('content')}) AS term FROM windows")
SQL_VIEWS["post_hits"] = ("qs post_index", f"""
    SELECT query_id, doc_id, win, score, CAST(rn AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, win) AS rn
          FROM (SELECT t.query_id, p.doc_id, p.win, count(*) AS score
                FROM (SELECT query_id, unnest({q.terms('query')}) AS term FROM qs) t JOIN post_index p USING (term)
                GROUP BY 1, 2, 3))
    WHERE rn <= 20""")
SQL_VIEWS["cands"] = ("post_hits windows qs", f"""
    SELECT h.query_id, s.query, h.rank - 1 AS idx, h.doc_id, h.win, {SPEC} AS pages, left(w.content, 6000) AS text
    FROM post_hits h JOIN windows w USING (doc_id, win) JOIN qs s USING (query_id)""")
SQL_VIEWS["scored"] = ("cands", f"""
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) - 1 AS INTEGER) AS rank
    FROM (SELECT query_id, idx, doc_id, win, n, round(
            0.5::DOUBLE * (len(list_intersect(qt, ct))::DOUBLE / greatest(len(qt) + len(ct) - len(list_intersect(qt, ct)), 1))
            + 0.4::DOUBLE * (list_sum(list_transform(qt, lambda t: (length(lt) - length(replace(lt, t, ''))) // length(t)))::DOUBLE
               / greatest(len(ct), 1))
            + CASE WHEN n > 2 AND (idx = 0 OR idx = n - 1) THEN 0.1::DOUBLE ELSE 0 END, 9) AS score
          FROM (SELECT *, {q.terms('query')} AS qt, {q.terms('text')} AS ct, lower(text) AS lt,
                       count(*) OVER (PARTITION BY query_id) AS n FROM cands))""")
SANDWICH = """CAST(CASE WHEN n <= 2 OR rank < b THEN rank WHEN rank >= m THEN b + rank - m ELSE rank + n - m END AS INTEGER)"""
SQL_VIEWS["placed"] = ("scored", f"""
    SELECT *, {SANDWICH} AS pos FROM (
      SELECT *, third + CASE WHEN n - 3 * third >= 1 THEN 1 ELSE 0 END AS b,
             2 * third + CASE WHEN n - 3 * third >= 2 THEN 1 ELSE 0 END AS m
      FROM (SELECT *, greatest(1, n // 3) AS third FROM scored))""")


def candidates(t, k=20):
    """Best whole-word hits per query with their text."""
    hits = r.search_windows(t.doc_pages, t.queries, k=k)
    return hits.join(t.queries, "query_id").select(
        "query_id", "query", (F.col("rank") - 1).alias("idx"), "doc_id", "win", "pages", F.col("content").alias("text"))


@query("keyword_page_search", f"""
    SELECT query_id, CAST(rn AS INTEGER) AS rank, doc_id, win, {SPEC} AS pages, score, left(content, 6000) AS content
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, win) AS rn FROM kw_scores)
    JOIN windows USING (doc_id, win) WHERE rn <= 5""", "kw_scores")
def _(t):
    return r.keyword_page_search(t.doc_pages, t.queries)


@query("keyword_search_backoff", f"""
    WITH more AS (SELECT query_id, query FROM qs UNION ALL SELECT query_id + 1000000, md5(query) FROM qs),
    terms2 AS (SELECT DISTINCT query_id, unnest({q.terms('query')}) AS term FROM more),
    sc AS (SELECT w.query_id, d.doc_id, d.win, count(*) AS score
           FROM terms2 w JOIN windows d ON contains(lower(d.content), w.term) GROUP BY 1, 2, 3),
    hit AS (SELECT query_id, CAST(rn AS INTEGER) AS rank, doc_id, win, {SPEC} AS pages, score, left(content, 6000) AS content
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, win) AS rn FROM sc)
            JOIN windows USING (doc_id, win) WHERE rn <= 5),
    first5 AS (SELECT doc_id, max(page) AS n FROM doc_pages GROUP BY 1 ORDER BY 1 LIMIT 5),
    heads AS (SELECT doc_id, least(n, greatest(1, n // 2)) AS lst, string_agg(content, chr(10) ORDER BY page) AS content
              FROM doc_pages JOIN first5 USING (doc_id) WHERE page <= least(n, greatest(1, n // 2)) GROUP BY 1, 2)
    SELECT * FROM hit
    UNION ALL
    SELECT m.query_id, CAST(row_number() OVER (PARTITION BY m.query_id ORDER BY doc_id) AS INTEGER), doc_id,
           CAST(0 AS INTEGER), '1-' || lst, CAST(1 AS BIGINT), left(content, 3000)
    FROM more m, heads WHERE m.query_id NOT IN (SELECT query_id FROM hit)""", "qs windows")
def _(t):
    silent = t.queries.select((F.col("query_id") + 1000000).alias("query_id"), F.md5("query").alias("query"))
    return r.keyword_search_backoff(t.doc_pages, t.queries.unionByName(silent))


@query("posting_index", "SELECT query_id, rank, doc_id, win, score FROM post_hits WHERE rank <= 5", "post_hits")
def _(t):
    return r.search_postings(r.posting_index(t.doc_pages), t.queries, 5, r.scoring_tasks(t.doc_pages))


@query("stored_posting_index", "SELECT query_id, rank, doc_id, win, score FROM post_hits WHERE rank <= 5", "post_hits")
def _(t):
    """The index is written as a bucketed table; the search reads it back in place."""
    return r.search_stored_postings(r.write_posting_index(t.doc_pages), t.queries, 5)


@query("heuristic_rerank", "SELECT query_id, idx, doc_id, win, score, rank FROM scored", "scored")
def _(t):
    return r.heuristic_rerank(candidates(t)).select("query_id", "idx", "doc_id", "win", "score", "rank")


@query("rerank_external_scores", """
    SELECT query_id, idx, doc_id, win, score, CAST(rn - 1 AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rn
          FROM (SELECT query_id, idx, doc_id, win,
                       round(1 / (1 + exp(-((length(text) % 97)::DOUBLE / 10 - 5))), 9) AS score FROM cands))
    WHERE rn <= 10""", "cands")
def _(t):
    c = candidates(t)
    logits = c.select("query_id", F.floor(F.col("idx") / 64).cast("int").alias("batch_no"),
                      (F.col("idx") % 64).alias("batch_idx"), ((F.length("text") % 97) / 10.0 - 5).alias("logit"))
    logits = r.listwise_index(logits).select("query_id", "idx", "logit")
    return r.rerank_external_scores(c, logits, 10).select("query_id", "idx", "doc_id", "win", "score", "rank")


@query("sandwich_reorder", """
    SELECT query_id, doc_id, win, rank, CAST(CASE WHEN n <= 2 OR rank < b THEN rank WHEN rank >= m THEN b + rank - m
           ELSE rank + n - m END AS INTEGER) AS pos
    FROM (SELECT *, third + CASE WHEN n - 3 * third >= 1 THEN 1 ELSE 0 END AS b,
                 2 * third + CASE WHEN n - 3 * third >= 2 THEN 1 ELSE 0 END AS m
          FROM (SELECT query_id, doc_id, win, rank - 1 AS rank, n, greatest(1, n // 3) AS third
                FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM post_hits)))""", "post_hits")
def _(t):
    hits = r.search_postings(r.posting_index(t.doc_pages), t.queries, 20, r.scoring_tasks(t.doc_pages))
    return r.sandwich_reorder(hits.withColumn("rank", F.col("rank") - 1)).select("query_id", "doc_id", "win", "rank", "pos")


@query("rerank_sandwich", "SELECT query_id, idx, doc_id, win, score, rank, pos FROM placed", "placed")
def _(t):
    return r.rerank_sandwich(candidates(t)).select("query_id", "idx", "doc_id", "win", "score", "rank", "pos")


def context_blocks(t):
    meta = t.documents_meta.select("doc_id", "doc_name")
    c = candidates(t, 5)
    return c.join(meta, "doc_id").withColumnRenamed("text", "content")


def summaries(t):
    return t.queries.filter("length(query) > 200").select("query_id", F.substring_index("query", " ", 8).alias("summary"))


SUMMARY_SQL = "array_to_string(string_split(query, ' ')[1:8], ' ')"


@query("assemble_context", f"""
    WITH blocks AS (SELECT query_id, query, idx,
                           '## doc_' || doc_id || ':' || pages || chr(10) || chr(10) || left(text, 8000) AS text
                    FROM cands WHERE idx < 5),
    s1 AS (SELECT *, {q.terms('query')} AS qt, {q.terms('text')} AS ct, lower(text) AS lt,
                  count(*) OVER (PARTITION BY query_id) AS n FROM blocks),
    s2 AS (SELECT query_id, query, idx, text, n, round(
            0.5::DOUBLE * (len(list_intersect(qt, ct))::DOUBLE / greatest(len(qt) + len(ct) - len(list_intersect(qt, ct)), 1))
            + 0.4::DOUBLE * (list_sum(list_transform(qt, lambda t: (length(lt) - length(replace(lt, t, ''))) // length(t)))::DOUBLE
               / greatest(len(ct), 1))
            + CASE WHEN n > 2 AND (idx = 0 OR idx = n - 1) THEN 0.1::DOUBLE ELSE 0 END, 9) AS score FROM s1),
    s3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) - 1 AS rank,
                  greatest(1, n // 3) AS third FROM s2),
    s4 AS (SELECT *, third + CASE WHEN n - 3 * third >= 1 THEN 1 ELSE 0 END AS b,
                  2 * third + CASE WHEN n - 3 * third >= 2 THEN 1 ELSE 0 END AS m FROM s3),
    s5 AS (SELECT query_id, query, n, text, CASE WHEN n <= 2 THEN idx WHEN rank < b THEN rank WHEN rank >= m THEN b + rank - m
                  ELSE rank + n - m END AS pos FROM s4),
    s6 AS (SELECT query_id, any_value(n) AS n, any_value(length(query)) AS qlen, any_value({SUMMARY_SQL}) AS s,
                  string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS body
           FROM s5 GROUP BY 1),
    f AS (SELECT chr(10) || chr(10) || '---' || chr(10) || chr(10) AS r, '## Agent Summary' || chr(10) || chr(10) AS h)
    SELECT query_id, CASE WHEN qlen <= 200 THEN body
        WHEN n > 2 THEN h || s || r || body || r || '[Key findings recap — pay attention]:' || chr(10) || s
        ELSE body || r || h || s END AS context
    FROM s6, f""", "cands")
def flagship(t):
    return r.assemble_context(context_blocks(t), summaries(t))


@query("source_list", """
    WITH raw AS (SELECT query_id, rank AS seq, doc_id, pages FROM post_hits JOIN (
                    SELECT doc_id, win, CASE WHEN page_from = page_to THEN page_from::VARCHAR
                           ELSE page_from || '-' || page_to END AS pages FROM windows) USING (doc_id, win)),
    twice AS (SELECT * FROM raw UNION ALL SELECT query_id, seq + 100, doc_id, pages FROM raw)
    SELECT query_id, CAST(min(seq) AS INTEGER) AS seq, doc_id, pages,
           coalesce(any_value(doc_name), left(doc_id::VARCHAR, 8)) AS doc_name, '' AS section
    FROM twice LEFT JOIN (SELECT doc_id, doc_name FROM documents_meta WHERE status = 'completed') USING (doc_id)
    GROUP BY query_id, doc_id, pages""", "post_hits documents_meta")
def _(t):
    raw = candidates(t).select("query_id", (F.col("idx") + 1).alias("seq"), "doc_id", "pages")
    raw = raw.unionByName(raw.withColumn("seq", F.col("seq") + 100))
    return r.source_list(raw, t.documents_meta.filter("status = 'completed'").select("doc_id", "doc_name"))


@query("doc_catalog_lines", """
    SELECT query_id, string_agg('- ' || doc_id || ': ' || doc_name || ' (' || page_count || ' pages) - ' || doc_description,
                                chr(10) ORDER BY doc_id) AS catalog
    FROM (SELECT DISTINCT query_id, doc_id FROM post_hits) JOIN documents_meta USING (doc_id) GROUP BY 1""",
       "post_hits documents_meta")
def _(t):
    hits = r.search_postings(r.posting_index(t.doc_pages), t.queries, 20, r.scoring_tasks(t.doc_pages))
    return r.doc_catalog_lines(hits, t.documents_meta)


@query("tool_output_context", """
    SELECT query_id, string_agg(left(text, 6000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY idx) AS context
    FROM cands WHERE length(text) > 50 GROUP BY 1""", "cands")
def _(t):
    return r.tool_output_context(candidates(t).select("query_id", F.col("idx").alias("seq"), F.col("text").alias("content")))


# --- vectors -----------------------------------------------------------------------------------

UNIT = "list_transform({e}, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform({e}, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-8))"
SQL_VIEWS["unit_items"] = ("", f"SELECT vec_id AS item_id, {UNIT.format(e='embedding')} AS u FROM embeddings")
SQL_VIEWS["unit_queries"] = ("label_centroids", f"SELECT query_id, {UNIT.format(e='embedding')} AS u FROM label_centroids")
SQL_VIEWS["vec_hits"] = ("unit_items unit_queries", """
    SELECT query_id, item_id, score, CAST(rn AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rn
          FROM (SELECT a.query_id, b.item_id, round(list_dot_product(a.u, b.u), 6) AS score
                FROM unit_queries a, unit_items b) WHERE score >= 0.4) WHERE rn <= 60""")


def items(t):
    return t.embeddings.select(F.col("vec_id").alias("item_id"), "embedding")


@query("vector_topk", """
    SELECT query_id, item_id, score, CAST(rn AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rn
          FROM (SELECT a.query_id, b.item_id, round(list_dot_product(a.u, b.u), 6) AS score
                FROM unit_queries a, unit_items b)) WHERE rn <= 60""", "unit_items unit_queries")
def _(t):
    return v.vector_topk(items(t), t.label_centroids, 60)


@query("related_chunks", """
    SELECT query_id, item_id, score, CAST(rn AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rn
          FROM (SELECT a.item_id AS query_id, b.item_id, round(list_dot_product(a.u, b.u), 6) AS score
                FROM unit_items a, unit_items b WHERE a.item_id <> b.item_id)) WHERE rn <= 5""", "unit_items")
def _(t):
    """What lies near every chunk."""
    return v.related_chunks(items(t), items(t), 5)


SQL_VIEWS["signals"] = ("vec_hits label_centroids", """
    SELECT query_id, round(coalesce(mean, 0), 6) AS mean_score, round(coalesce(entropy, 2), 6) AS entropy,
           round(coalesce(mean * (1 - entropy / (ln(n::DOUBLE) + 1e-10) * 0.5::DOUBLE), 0), 6) AS familiarity,
           coalesce(mean >= 0.65 AND entropy <= 1.5, false) AS is_familiar
    FROM label_centroids LEFT JOIN (
      SELECT query_id, avg(score) AS mean, -sum(p * ln(p + 1e-10)) AS entropy, count(*) AS n
      FROM (SELECT query_id, score, CASE WHEN total = 0 THEN 1.0::DOUBLE / n ELSE d / total END AS p
            FROM (SELECT *, sum(d) OVER (PARTITION BY query_id) AS total, count(*) OVER (PARTITION BY query_id) AS n
                  FROM (SELECT query_id, score, score - min(score) OVER (PARTITION BY query_id) AS d
                        FROM vec_hits WHERE rank <= 5)))
      GROUP BY 1) USING (query_id)""")


def signals(t):
    hits = v.vector_topk(items(t), t.label_centroids, 5, threshold=0.4)
    return v.familiarity(t.label_centroids, hits)


@query("familiarity", "SELECT * FROM signals", "signals")
def _(t):
    return signals(t)


@query("adaptive_route", """
    SELECT query_id, is_familiar, coalesce(n, 0) AS history_rows,
           CASE WHEN is_familiar THEN 'direct' WHEN coalesce(n, 0) < 2 THEN 'history_fallback' ELSE 'recollection' END AS route
    FROM signals LEFT JOIN (SELECT conv_id AS query_id, count(*) AS n FROM conversations GROUP BY 1) USING (query_id)""",
       "signals")
def _(t):
    sizes = t.conversations.groupBy(F.col("conv_id").alias("query_id")).agg(F.count(F.lit(1)).alias("history_rows"))
    return v.adaptive_route(signals(t), sizes)


@query("check_embedding_dim", """
    SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n_rows, len(embedding) = 64 AS compatible
    FROM embeddings GROUP BY 1, 3""")
def _(t):
    return v.check_embedding_dim(t.embeddings, 64)


SQL_VIEWS["conv_query"] = ("message_vectors", """
    SELECT conv_id, text AS query, embedding FROM message_vectors
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
SQL_VIEWS["recalled"] = ("message_vectors conv_query", """
    SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY place) AS INTEGER) AS rank, text
    FROM (SELECT conv_id, text, min(cluster * 3 + rn) AS place
          FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, cluster ORDER BY score DESC, turn DESC) AS rn
                FROM (SELECT m.conv_id, p.cluster, m.turn, m.text,
                             round(list_dot_product(list_transform(m.embedding, lambda x: x::DOUBLE), p.mixed), 6) AS score
                      FROM message_vectors m JOIN (
                        SELECT c.conv_id, c.cluster, list_transform(list_zip(q.embedding, c.m),
                               lambda z: z[1]::DOUBLE * 0.6::DOUBLE + z[2] * (1 - 0.6::DOUBLE)) AS mixed
                        FROM (SELECT conv_id, cluster, list(x ORDER BY i) AS m
                              FROM (SELECT conv_id, turn % 3 AS cluster, i, avg(embedding[i]::DOUBLE) AS x
                                    FROM message_vectors, unnest(range(1, 65)) AS u(i) GROUP BY 1, 2, 3) GROUP BY 1, 2) c
                        JOIN conv_query q USING (conv_id)) p USING (conv_id)))
          WHERE rn <= 3 GROUP BY 1, 2)
    QUALIFY rank <= 10""")


def conv_query(t):
    last = t.message_vectors.groupBy("conv_id").agg(F.max_by(F.struct("text", "embedding"), "turn").alias("m"))
    return last.select("conv_id", F.col("m.text").alias("query"), F.col("m.embedding").alias("embedding"))


def recalled(t):
    m = t.message_vectors
    flat = m.select("conv_id", (F.col("turn") % 3).alias("cluster"), F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("conv_id", "cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy("conv_id", "cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda r_: r_["m"]).alias("embedding"))
    return v.alpha_mix_recall(m.withColumn("seq", F.col("turn")), conv_query(t), centroids)


@query("alpha_mix_recall", "SELECT conv_id, rank, text FROM recalled", "recalled")
def _(t):
    return recalled(t)


@query("enhanced_query", """
    SELECT conv_id, CASE WHEN b IS NULL THEN query ELSE 'Based on our conversation context:' || chr(10) || b || chr(10) || chr(10)
           || 'Please answer the following question considering the above context:' || chr(10) || query END AS enhanced
    FROM conv_query LEFT JOIN (SELECT conv_id, string_agg('- ' || text, chr(10) ORDER BY rank) AS b
                               FROM recalled WHERE rank <= 5 GROUP BY 1) USING (conv_id)""", "recalled conv_query")
def _(t):
    return v.enhanced_query(recalled(t), conv_query(t))


@query("cluster_history")
def _(t):
    return v.cluster_history(t.message_vectors.withColumn("seq", F.col("turn")), conv_query(t))
