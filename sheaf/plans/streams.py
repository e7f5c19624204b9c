"""Streaming queries, run over all available input."""

from pyspark.sql import functions as F

from ..streaming import operators as s
from ..streaming.runtime import latest, run_available, table_stream
from .bookkeeping import ADMIT
from .inputs import Tables
from .registry import query
from .semistructured import ENTRIES


def events(t):
    return table_stream(t.spark, t.sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def streamed(t, name):
    """Tables whose ``name`` source is a stream, so derived inputs become streams too."""
    live = Tables(t.spark, t.sf_dir)
    source = table_stream(t.spark, t.sf_dir, name)
    live.__dict__[name] = source.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else source
    return live


def keyed(t):
    return events(t).select(F.col("user_id").cast("string").alias("key"), "ts", "event_id")


@query("stream_rate_limit", ADMIT)
def _(t):
    return run_available(s.stream_rate_limit(keyed(t), 3, 3600, 2, 1800), "rate").drop("batch")


# Windows come out once they lie behind the watermark, a second before the newest event.
@query("stream_rate_counts", """
    SELECT key, start, start + INTERVAL 3600 SECOND AS "end", count(*) AS n
    FROM (SELECT CAST(user_id AS VARCHAR) AS key, TIMESTAMP '1970-01-01 00:00:00' + to_seconds((CAST(floor(epoch(ts) / 1800) AS BIGINT) - k) * 1800) AS start
          FROM events, range(2) r(k))
    WHERE start + INTERVAL 3600 SECOND <= (SELECT max(ts) - INTERVAL 1 SECOND FROM events) GROUP BY 1, 2""")
def _(t):
    return run_available(s.stream_rate_counts(keyed(t), "3600 seconds", "1800 seconds"), "counts").drop("batch")


@query("stream_page_cache", "SELECT event_type || '/' || user_id AS url, max(ts) AS ts, arg_max(event_id, ts) AS fetch_id FROM events GROUP BY 1")
def _(t):
    fetches = events(t).select(F.concat_ws("/", "event_type", "user_id").alias("url"), "ts", F.col("event_id").alias("fetch_id"))
    return latest(run_available(s.stream_page_cache(fetches), "cache"), ["url"])


@query("stream_progress_latest", "SELECT * FROM progress_state", "progress_state")
def _(t):
    return latest(run_available(s.stream_progress_latest(streamed(t, "events").progress_log), "progress", "update"), ["doc_id"])


@query("stream_memory_fold", f"""
    SELECT id, type, content, keywords, source_session_id, CAST(regexp_extract(source_session_id, 's_([0-9]+)_', 1) AS BIGINT) * 10
             + CAST(regexp_extract(source_session_id, '_([0-9]+)$', 1) AS BIGINT) AS seq
    FROM ({ENTRIES}) ORDER BY seq DESC, id LIMIT 200""")
def _(t):
    live = streamed(t, "conversations")
    number = F.regexp_extract("session_id", "s_([0-9]+)_", 1).cast("long") * 10 + F.regexp_extract("session_id", "_([0-9]+)$", 1).cast("long")
    return s.stream_memory_fold(live.memory_json.withColumn("seq", number), 200).withColumn("keywords", F.array_join("keywords", "|"))


@query("stream_chunk_summaries", """
    SELECT conv_id, chunk, summary FROM chunks JOIN conv_sizes USING (conv_id) WHERE (chunk + 1) * 2 <= n""", "chunks conv_sizes")
def _(t):
    return run_available(s.stream_chunk_summaries(streamed(t, "conversations").conversations, 2), "chunks").drop("batch")
