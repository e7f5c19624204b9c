"""Continuously updated state: rate limits, page cache, progress, memory, ingest, summaries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from .. import fixed_values as fixed
from ..operators.bookkeeping import Admission, progress_apply
from ..operators.conversations import CHUNK_MESSAGES, CHUNK_TOKENS, point
from ..operators.memory import memory_fifo, memory_upsert
from ..operators.semistructured import extracted_memories
from ..operators.store import suffix
from .runtime import scratch, versions


def _wake_at(handle: StatefulProcessorHandle, ms: int) -> None:
    """One timer per key, moved forward with its newest row."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    handle.registerTimer(ms)


# --- rate limit --------------------------------------------------------------------------------------

class _RateLimit(StatefulProcessor):
    """Keeps the admitted timestamps still inside the window; older ones go when the key is seen again,
    idle keys are emptied by an event-time timer."""

    def __init__(self, limit: int, window_us: int, burst: int, burst_us: int, purge_ms: int):
        self.rules, self.purge_ms = (limit, window_us, burst, burst_us), purge_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        gate, newest = Admission(*self.rules, held=[h[0] for h in self.held.get()]), 0
        for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
            newest = max(newest, r.us)
            yield Row(key=r.key, ts=r.ts, event_id=r.event_id, admitted=gate.admit(r.us))
        self.held.put([(us,) for us in gate.held])
        _wake_at(self.handle, max(newest // 1000 + self.purge_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_rate_limit(events: DataFrame, limit: int = 60, window_s: float = 60, burst: int = 10, burst_s: float = 1,
                      purge_s: float = 120) -> DataFrame:
    """Admission decisions on a stream (key, ts, event_id); rows of a micro-batch are decided in time order.

    Timers run on event time, so a key's state goes ``purge_s`` after its last request.
    """
    out = StructType([StructField("key", StringType()), StructField("ts", TimestampType()),
                      StructField("event_id", LongType()), StructField("admitted", BooleanType())])
    rows = events.withWatermark("ts", f"{int(purge_s)} seconds").select("key", "ts", "event_id", F.unix_micros("ts").alias("us"))
    us = lambda s: int(s * 1_000_000)
    return rows.groupBy("key").transformWithState(
        _RateLimit(limit, us(window_s), burst, us(burst_s), int(purge_s * 1000)), out, "append", "EventTime")


def stream_rate_counts(events: DataFrame, window: str = "60 seconds", slide: str = "1 second", late: str = "1 second") -> DataFrame:
    """Requests per key and sliding event-time window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "key").agg(
        F.count(F.lit(1)).alias("n")).select("key", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


# --- page cache --------------------------------------------------------------------------------------

#: Rows of a stream of fetches as they reach the state; by place, as looking up names costs time at every row.
_CACHED = ("url", "ts", "us", "fetch_id")
_US, _FETCH = _CACHED.index("us"), _CACHED.index("fetch_id")


class _Latest(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", StructType([StructField("us", LongType()), StructField("fetch_id", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best = max((r[_US], r[_FETCH]) for r in rows)
        # Every call to the state is a round trip: one read tells of an entry, and where there is none no timer waits.
        held = self.entry.get()
        if held is None or best > (held[0], held[1]):
            self.entry.update(best)
            wake = max(best[0] // 1000 + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1)
            if held is None:
                self.handle.registerTimer(wake)
            else:
                _wake_at(self.handle, wake)
            yield Row(url=key[0], us=best[0], fetch_id=best[1])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_page_cache(fetches: DataFrame, ttl_s: int = 3600) -> DataFrame:
    """Newest fetch per URL (url, ts, fetch_id); an entry goes once the stream is ``ttl_s`` past it."""
    out = StructType([StructField("url", StringType()), StructField("us", LongType()), StructField("fetch_id", LongType())])
    live = fetches.withWatermark("ts", f"{ttl_s} seconds").withColumn("us", F.unix_micros("ts")).select(*_CACHED)
    newest = live.groupBy("url").transformWithState(_Latest(ttl_s * 1000), out, "append", "EventTime")
    return newest.select("url", F.timestamp_micros("us").alias("ts"), "fetch_id")


def suppress_refetches(fetches: DataFrame, ttl: str = "3600 seconds") -> DataFrame:
    """First fetch of a URL within the watermark; repeats are dropped."""
    return fetches.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["url"])


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


# --- progress, files ---------------------------------------------------------------------------------

def stream_progress_latest(log: DataFrame) -> DataFrame:
    """Current state per document; an aggregation, so a busy document is combined before the shuffle."""
    return progress_apply(log)


def stream_ingest_files(spark: SparkSession, folder: str, extensions=fixed.BATCH_EXTENSIONS) -> DataFrame:
    """New files of a folder, each picked up once (listing only)."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select(name.alias("filename"), F.col("length").alias("file_size"), suffix(name).alias("extension")).filter(
        F.col("extension").isin(*extensions))


# --- memory ------------------------------------------------------------------------------------------

def stream_memory_fold(replies: DataFrame, max_entries: int = 200, folder: str | None = None) -> DataFrame:
    """Extraction replies (session_id, raw, seq) folded into a capped store, batch by batch; returns the store.

    Every batch writes the next version from the last one before it, named by batch id and found in the store itself:
    replays give the same version, and a later run with the same ``folder`` goes on from the last.
    """
    spark = replies.sparkSession
    store, state = (f"{folder}/memory", f"{folder}/memory-state") if folder else (scratch(spark, "memory"), scratch(spark, "memory-state"))
    shape = "id string, type string, content string, keywords array<string>, source_session_id string, seq long"

    def version(before: float) -> DataFrame:
        last = [v for v in versions(spark, store, "v") if v < before]
        return spark.read.schema(shape).parquet(f"{store}/v{last[-1]}") if last else spark.createDataFrame([], shape)

    def fold(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            order = batch.groupBy("session_id").agg(F.max("seq").alias("seq"))
            new = extracted_memories(batch).join(order, F.col("source_session_id") == F.col("session_id")).drop("session_id")
            old = version(batch_id)
            merged = memory_upsert(old.unionByName(new.select(*old.columns)))
            memory_fifo(merged, max_entries).write.mode("overwrite").parquet(f"{store}/v{batch_id}")
        finally:
            batch.unpersist()

    q = replies.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(fold).start()
    q.awaitTermination()
    return version(float("inf"))


# --- chunk summaries ---------------------------------------------------------------------------------

class _Chunks(StatefulProcessor):
    """Holds the points of the open chunk only (fewer than ``size`` rows)."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", StructType([StructField("turn", LongType()), StructField("point", StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = [(h[0], h[1]) for h in self.open.get()]
        for r in sorted(rows, key=lambda r: r.turn):
            held.append((r.turn, r.point))
            if len(held) == self.size:
                chunk = held[0][0] // self.size
                text = " | ".join([p for _, p in held if p][:6])
                yield Row(conv_id=key[0], chunk=int(chunk), summary=text[:CHUNK_TOKENS * 4] if len(text) // 4 > CHUNK_TOKENS else text)
                held = []
        if held:
            self.open.put(held)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def stream_chunk_summaries(messages: DataFrame, messages_per_chunk: int = CHUNK_MESSAGES) -> DataFrame:
    """(conv_id, chunk, summary) emitted when a chunk fills; rows of a conversation must arrive in turn order."""
    points = messages.select("conv_id", "turn", point(80, 100, "User asked: ", "Answered: ").alias("point"))
    out = StructType([StructField("conv_id", LongType()), StructField("chunk", IntegerType()), StructField("summary", StringType())])
    return points.groupBy("conv_id").transformWithState(_Chunks(messages_per_chunk), out, "append", "None")
