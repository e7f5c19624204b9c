"""Bookkeeping, rate-limit and trace queries."""

from pyspark.sql import functions as F

from ..operators import bookkeeping as b
from .inputs import SQL_VIEWS
from .registry import query

SQL_VIEWS["progress_state"] = ("progress_log", """
    SELECT doc_id, arg_max(s, seq) FILTER (s IS NOT NULL) AS status, arg_max(p, seq) AS progress,
           arg_max(st, seq) FILTER (st IS NOT NULL) AS step, arg_max(error, seq) FILTER (error IS NOT NULL) AS error
    FROM (SELECT doc_id, seq, CASE WHEN error IS NOT NULL THEN 'failed' ELSE nullif(status, '') END AS s,
                 greatest(0, least(100, progress)) AS p, nullif(step, '') AS st, error FROM progress_log) GROUP BY 1""")


@query("status_stats", """
    SELECT count(*) AS total_documents, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'processing') AS processing,
           count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(page_count), 0) AS BIGINT) AS total_sections FROM documents_meta""", "documents_meta")
def _(t):
    return b.status_stats(t.documents_meta)


@query("documents_with_progress", """
    SELECT doc_id, doc_name, type, CASE WHEN file_size < 1024 THEN file_size || ' B' WHEN file_size < 1048576 THEN format('{:.1f} KB', file_size / 1024.0::DOUBLE)
             ELSE format('{:.1f} MB', file_size / 1048576.0::DOUBLE) END AS size, m.status,
           coalesce(p.progress, 0) AS progress, coalesce(p.step, '') AS current_step, created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated
    FROM documents_meta m LEFT JOIN progress_state p USING (doc_id)""", "documents_meta progress_state")
def _(t):
    return b.documents_with_progress(t.documents_meta, b.progress_apply(t.progress_log))


@query("progress_apply", "SELECT * FROM progress_state", "progress_state")
def _(t):
    return b.progress_apply(t.progress_log)


@query("step_progress", """
    SELECT event_id, CAST(trunc(user_id::DOUBLE / 150 * 100) AS INTEGER) AS percent, CAST(70 + trunc(user_id::DOUBLE / 150 * 28) AS INTEGER) AS chunk_ramp,
           CAST(10 + trunc(user_id::DOUBLE / 150 * 15) AS INTEGER) AS page_ramp, CAST(25 + trunc(user_id::DOUBLE / 150 * 40) AS INTEGER) AS ocr_ramp FROM events""")
def _(t):
    total = F.lit(150)
    return t.events.select("event_id", b.step_progress("user_id", total).alias("percent"), b.ramp(70, 28, "user_id", total).alias("chunk_ramp"),
                           b.ramp(10, 15, "user_id", total).alias("page_ramp"), b.ramp(25, 40, "user_id", total).alias("ocr_ramp"))


def batch_docs(t):
    return b.progress_apply(t.progress_log).select((F.col("doc_id") % 20).alias("batch_id"), "doc_id",
        F.when(F.col("progress") < 30, "queued").otherwise(F.col("status")).alias("status"))


SQL_VIEWS["batch_docs"] = ("progress_state", """
    SELECT doc_id % 20 AS batch_id, doc_id, CASE WHEN progress < 30 THEN 'queued' ELSE status END AS status FROM progress_state""")


@query("batch_rollup", """
    SELECT batch_id, total, completed, failed, skipped, CASE WHEN batch_id IN (SELECT user_id % 20 FROM events WHERE event_type = 'error' AND value > 90) THEN 'partial' WHEN completed = total THEN 'completed'
             WHEN completed > 0 THEN 'partial' ELSE 'failed' END AS status,
           CAST(trunc((completed + failed + skipped)::DOUBLE / total * 100) AS INTEGER) AS progress_percent
    FROM (SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
                 count(*) FILTER (status = 'skipped' OR (batch_id IN (SELECT user_id % 20 FROM events WHERE event_type = 'error' AND value > 90) AND status IN ('pending', 'queued'))) AS skipped FROM batch_docs GROUP BY 1)""", "batch_docs")
def _(t):
    cancelled = t.events.filter("event_type = 'error' AND value > 90").select((F.col("user_id") % 20).alias("batch_id")).distinct()
    return b.batch_rollup(batch_docs(t), cancelled)


def rate_events(t):
    return t.events.select(F.col("user_id").cast("string").alias("key"), "ts", "event_id")


@query("rate_window_counts", """
    SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
      RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n_in_window FROM events""")
def _(t):
    return b.rate_window_counts(rate_events(t), window_s=3600)


ADMIT = """RECURSIVE WITH ev AS (
      SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    step(key, n, held, ts, event_id, admitted) AS (
      SELECT key, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN) FROM ev GROUP BY key
      UNION ALL
      SELECT key, n, CASE WHEN ok THEN list_append(h, us) ELSE h END, ts, event_id, ok
      FROM (SELECT *, len(h) < 3 AND len(list_filter(h, lambda x: x > us - 1800000000)) < 2 AS ok
            FROM (SELECT e.key, e.n, e.us, e.ts, e.event_id, list_filter(s.held, lambda x: x > e.us - 3600000000) AS h
                  FROM step s JOIN ev e ON e.key = s.key AND e.n = s.n + 1)))
    SELECT key, ts, event_id, admitted FROM step WHERE n > 0"""


@query("rate_limit_admit", ADMIT)
def _(t):
    return b.rate_limit_admit(rate_events(t), limit=3, window_s=3600, burst=2, burst_s=1800)


_CLOSURE = """RECURSIVE WITH up(span_id, anc) AS (
      SELECT span_id, span_id FROM spans UNION ALL SELECT u.span_id, s.parent_id FROM up u JOIN spans s ON s.span_id = u.anc WHERE s.parent_id IS NOT NULL),
    closure AS (SELECT anc AS span_id, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM up JOIN spans USING (span_id) GROUP BY 1)
    SELECT s.trace_id, s.span_id, s.parent_id, s.status, round((s.end_s - s.start_s) * 1000, 3) AS duration_ms, c.total_tokens
    FROM spans s JOIN closure c USING (span_id)"""


@query("span_rollup", _CLOSURE, "spans")
def _(t):
    return b.span_rollup(t.spans)


@query("trace_summary", """
    SELECT trace_id, any_value(span_id) FILTER (parent_id IS NULL) AS span_id, any_value(round((end_s - start_s) * 1000, 3)) FILTER (parent_id IS NULL) AS duration_ms,
           CAST(sum(tokens) AS BIGINT) AS total_tokens, any_value(status) FILTER (parent_id IS NULL) AS status FROM spans GROUP BY 1""", "spans")
def _(t):
    return b.trace_summary(b.span_rollup(t.spans))


@query("slow_requests", """
    SELECT event_type AS path, count(*) AS n_slow, round(max(value / 20), 6) AS slowest_s FROM events WHERE value / 20 > 5 GROUP BY 1""")
def _(t):
    return b.slow_requests(t.events.select(F.col("event_type").alias("path"), (F.col("value") / 20).alias("duration_s")))


@query("allow_deny_filter", """
    SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)
      AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def _(t):
    deny = t.events.filter("event_type = 'error' AND value > 100").select("user_id").distinct()
    allow = t.events.filter("event_type = 'purchase'").select("user_id").distinct()
    return b.allow_deny_filter(t.events.select("event_id", "user_id"), deny, allow, "user_id")


@query("paginate", """
    SELECT doc_id, doc_name, (SELECT count(*) FROM documents) AS total, 60 < (SELECT count(*) FROM documents) AS has_more
    FROM documents_meta ORDER BY created_at DESC, doc_id LIMIT 20 OFFSET 40""", "documents_meta")
def _(t):
    rows = t.documents_meta.select("doc_id", "doc_name", "created_at")
    return b.paginate(rows, [F.col("created_at").desc(), F.col("doc_id")], page=3).drop("created_at")
