"""Ingest bookkeeping, rate limits, traces and small operational reports."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.skew import running, scalar_count
from ..functions.text import col
from ..session import cut_lineage


def status_stats(documents: DataFrame, sections: str = "page_count") -> DataFrame:
    s = F.col("status")
    return documents.agg(
        F.count(F.lit(1)).alias("total_documents"), F.count_if(s == "completed").alias("completed"),
        F.count_if(s == "processing").alias("processing"), F.count_if(s == "failed").alias("failed"),
        F.coalesce(F.sum(sections), F.lit(0)).alias("total_sections"))


def format_size(size: Column | str) -> Column:
    size = col(size)
    one = lambda x: F.format_string("%.1f", F.bround(x, 1))
    return (F.when(size < 1024, F.concat(size, F.lit(" B")))
            .when(size < 1024 * 1024, F.concat(one(size / 1024), F.lit(" KB")))
            .otherwise(F.concat(one(size / (1024 * 1024)), F.lit(" MB"))))


def documents_with_progress(documents: DataFrame, progress: DataFrame) -> DataFrame:
    """Documents, newest first in ``created_at``, with their progress or defaults."""
    p = progress.select("doc_id", F.col("progress").alias("_p"), F.col("step").alias("_s"))
    return documents.join(p, "doc_id", "left").select(
        "doc_id", "doc_name", "type", format_size("file_size").alias("size"), "status",
        F.coalesce("_p", F.lit(0)).alias("progress"), F.coalesce("_s", F.lit("")).alias("current_step"),
        "created_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated")).orderBy(F.col("created_at").desc())


def progress_apply(log: DataFrame, order: str = "seq") -> DataFrame:
    """State per document after all updates (doc_id, seq, status, progress, step, error).

    Empty values never overwrite, progress stays in 0..100, an error means failed.
    """
    text = lambda c: F.nullif(c, F.lit(""))
    latest = lambda v: F.max_by(v, F.when(v.isNotNull(), F.col(order)))
    error = text(F.col("error"))
    return log.groupBy("doc_id").agg(
        latest(F.when(error.isNotNull(), "failed").otherwise(text(F.col("status")))).alias("status"),
        latest(F.greatest(F.lit(0), F.least(F.lit(100), "progress"))).alias("progress"),
        latest(text(F.col("step"))).alias("step"), latest(error).alias("error"))


def step_progress(step: Column | str, total: Column | str) -> Column:
    return F.when(col(total) > 0, (col(step).cast("double") / F.nullif(col(total), F.lit(0)) * 100).cast("int")).otherwise(0)


def ramp(start: int, span: int, done: Column | str, total: Column | str) -> Column:
    """``start`` to ``start + span`` as work proceeds."""
    return F.lit(start) + (col(done).cast("double") / F.greatest(col(total), F.lit(1)) * span).cast("int")


def batch_rollup(items: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """Batches from their documents (batch_id, doc_id, status); a cancelled batch skips what was waiting."""
    if cancelled is not None:
        mark = cancelled.select("batch_id", F.lit(True).alias("_stop"))
        items = items.join(mark, "batch_id", "left").withColumn("status", F.when(
            F.col("_stop") & F.col("status").isin("pending", "queued"), "skipped").otherwise(F.col("status")))
    else:
        items = items.withColumn("_stop", F.lit(None).cast("boolean"))
    s = F.col("status")
    counted = items.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "completed").alias("completed"),
        F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"), F.max("_stop").alias("_stop"))
    done = F.col("completed") + F.col("failed") + F.col("skipped")
    status = (F.when(F.col("_stop"), "partial").when(F.col("completed") == F.col("total"), "completed")
              .when(F.col("completed") > 0, "partial").otherwise("failed"))
    return counted.select("batch_id", "total", "completed", "failed", "skipped", status.alias("status"),
                          (done / F.col("total") * 100).cast("int").alias("progress_percent"))


# --- rate limits -----------------------------------------------------------------------------------

def trailing_counts(events: DataFrame, key: str, ts: str, seconds: dict[str, float]) -> DataFrame:
    """Rows of the key within the last s seconds (left end open), one output column per entry.

    A key is cut into time buckets as long as the longest window; each row is also shown to the next
    bucket, so a busy key spreads over many tasks.
    """
    span = int(max(seconds.values()) * 1_000_000)
    us = F.unix_micros(ts)
    placed = events.withColumn("_us", us).withColumn("_home", F.floor(F.col("_us") / span)).withColumn(
        "_bkt", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    w = W.partitionBy(key, "_bkt").orderBy("_us")
    for name, s in seconds.items():
        placed = placed.withColumn(name, F.count(F.lit(1)).over(w.rangeBetween(1 - int(s * 1_000_000), 0)))
    return placed.filter(F.col("_bkt") == F.col("_home")).drop("_us", "_home", "_bkt")


def rate_window_counts(events: DataFrame, key: str = "key", ts: str = "ts", window_s: float = 60) -> DataFrame:
    return trailing_counts(events, key, ts, {"n_in_window": window_s})


class Admission:
    """Sliding-window admission of one key: only admitted requests count against its limits."""

    def __init__(self, limit: int, window_us: int, burst: int, burst_us: int, held: list[int] = ()):
        self.limit, self.window_us, self.burst, self.burst_us = limit, window_us, burst, burst_us
        self.held = deque(held)

    def admit(self, us: int) -> bool:
        while self.held and self.held[0] <= us - self.window_us:
            self.held.popleft()
        if len(self.held) >= self.limit:
            return False
        recent = 0
        for seen in reversed(self.held):
            if seen <= us - self.burst_us:
                break
            recent += 1
        if recent >= self.burst:
            return False
        self.held.append(us)
        return True


def rate_limit_admit(events: DataFrame, limit: int = 60, window_s: float = 60, burst: int = 10, burst_s: float = 1) -> DataFrame:
    """Adds ``admitted`` to events (key, ts, event_id), decided in (ts, event_id) order per key.

    Decisions depend on earlier decisions, but never across a gap of a whole window: a key is cut at
    such gaps, the pieces run in parallel, and a piece streams through its task holding at most ``limit``
    timestamps.
    """
    window_us, burst_us = int(window_s * 1_000_000), int(burst_s * 1_000_000)
    counted = trailing_counts(events, "key", "ts", {"_n": window_s}).withColumn("_us", F.unix_micros("ts"))
    start = F.when(F.col("_n") == 1, F.col("_us"))
    cut = running(counted, ["key"], "_us", {"_piece": ("max", start)}, block=max(window_us * 64, 1)).drop("_n")
    cut = cut.withColumn("_piece", F.coalesce("_piece", F.lit(0)))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, gate = None, None
        for pdf in batches:
            out = []
            for key, piece, us in zip(pdf["key"], pdf["_piece"], pdf["_us"]):
                if (key, piece) != at:
                    at, gate = (key, piece), Admission(limit, window_us, burst, burst_us)
                out.append(gate.admit(us))
            yield pdf.drop(columns=["_piece", "_us"]).assign(admitted=out)

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in events.columns) + ", admitted boolean"
    ordered = cut.repartition("key", "_piece").sortWithinPartitions("key", "_piece", "_us", "event_id")
    return ordered.mapInPandas(decide, schema)


# --- traces ----------------------------------------------------------------------------------------

def span_rollup(spans: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Own plus all descendants' tokens per span, and its duration.

    Pointer doubling: after round r a span holds the sum over descendants closer than 2^r, so a chain of
    depth d takes log2(d) rounds and no ancestor pairs are ever listed. Parents that form a cycle, or chains of more than
    2 ** ``max_rounds`` spans, raise.
    """
    state = cut_lineage(spans.select("span_id", F.col("parent_id").alias("up"), F.col("tokens").cast("long").alias("total")))
    for _ in range(max_rounds):
        if state.filter("up IS NOT NULL").isEmpty():
            break
        gifts = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("span_id")).agg(F.sum("total").alias("gift"))
        above = state.select(F.col("span_id").alias("up"), F.col("up").alias("next_up"))
        state = cut_lineage(state.join(gifts, "span_id", "left").join(above, "up", "left").select(
            "span_id", F.col("next_up").alias("up"), (F.col("total") + F.coalesce("gift", F.lit(0))).alias("total")))
    else:
        if not state.filter("up IS NOT NULL").isEmpty():
            raise ValueError("parents of spans form a cycle")
    duration = F.round((F.col("end_s") - F.col("start_s")) * 1000, 3)
    return spans.join(state.select("span_id", F.col("total").alias("total_tokens")), "span_id").select(
        "trace_id", "span_id", "parent_id", "status", F.coalesce(duration, F.lit(0.0)).alias("duration_ms"), "total_tokens")


def trace_summary(rolled: DataFrame) -> DataFrame:
    return rolled.filter("parent_id IS NULL").select("trace_id", "span_id", "duration_ms", "total_tokens", "status")


# --- reports ---------------------------------------------------------------------------------------

def slow_requests(log: DataFrame, threshold_s: float = 5.0) -> DataFrame:
    return log.filter(F.col("duration_s") > threshold_s).groupBy("path").agg(
        F.count(F.lit(1)).alias("n_slow"), F.round(F.max("duration_s"), 6).alias("slowest_s"))


def allow_deny_filter(requests: DataFrame, deny: DataFrame, allow: DataFrame, key: str) -> DataFrame:
    """Denied keys out; with a non-empty allow list, only its keys stay."""
    passed = requests.join(deny.select(key), key, "left_anti")
    listed = passed.join(allow.select(key).distinct().withColumn("_ok", F.lit(True)), key, "left")
    return listed.filter(F.col("_ok") | (scalar_count(allow) == 0)).drop("_ok")


def paginate(rows: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """One page with ``total`` and ``has_more``; a top-n sort, not a global ranking."""
    total = scalar_count(rows)
    return rows.orderBy(*order).limit(page * page_size).offset((page - 1) * page_size).withColumn(
        "total", total).withColumn("has_more", F.lit(page * page_size) < total)
