"""Streams give what their batch twins give, also when input arrives over several micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sheaf import plans
from sheaf.operators import bookkeeping as b
from sheaf.operators import conversations as c
from sheaf.operators import memory as m
from sheaf.operators import semistructured as j
from sheaf.plans.inputs import Tables
from sheaf.streaming import operators as s
from sheaf.streaming.runtime import latest, run_available, table_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """Events and conversations cut into three files each, in time order."""
    folder = tmp_path_factory.mktemp("split")
    t = Tables(spark, SF)
    for name, df, order in (("events", t.read("events"), "event_id"), ("conversations", t.conversations, "turn")):
        df.limit(0).coalesce(1).write.parquet(f"{folder}/schema-{name}")
        bounds = df.agg(F.max(order)).first()[0] + 1
        for i in range(3):
            part = df.filter(F.floor(F.col(order) * 3 / bounds) == i).coalesce(1).toPandas()
            part.to_parquet(f"{folder}/{name}-{i}.parquet", coerce_timestamps="us")
    return str(folder)


def live(spark, folder, name):
    schema = spark.read.parquet(f"{SF}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}-*.parquet").option("maxFilesPerTrigger", 1).parquet(folder)


def test_rate_limit(spark, split):
    stream = live(spark, split, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    got = run_available(s.stream_rate_limit(stream, 3, 3600, 2, 1800, purge_s=40 * 86400), "rate").select("event_id", "admitted").collect()
    rows = Tables(spark, SF).events.select(F.col("event_type").alias("key"), "ts", "event_id")
    want = b.rate_limit_admit(rows, 3, 3600, 2, 1800).select("event_id", "admitted").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 1000


def test_progress(spark, split):
    t = Tables(spark, SF)
    feed = Tables(spark, SF)
    feed.__dict__["events"] = live(spark, split, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = latest(run_available(s.stream_progress_latest(feed.progress_log), "progress", "update"), ["doc_id"])
    want = b.progress_apply(t.progress_log)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_page_cache(spark, split):
    url = F.concat_ws("/", "event_type", F.col("user_id") % 20).alias("url")
    stream = live(spark, split, "events").select(url, F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("fetch_id"))
    got = latest(run_available(s.stream_page_cache(stream), "cache"), ["url"])
    want = Tables(spark, SF).events.select(url, "ts", F.col("event_id").alias("fetch_id")).groupBy("url").agg(
        F.max(F.struct("ts", "fetch_id")).alias("x")).select("url", "x.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_page_cache_asks_its_state_little():
    calls, timers, value = [], set(), []

    class Entry:
        def exists(self):
            calls.append("exists")
            return bool(value)

        def get(self):
            calls.append("get")
            return value[-1] if value else None

        def update(self, x):
            calls.append("update")
            value.append(x)

        def clear(self):
            value.clear()

    class Handle:
        getValueState = staticmethod(lambda name, schema: Entry())
        registerTimer = staticmethod(lambda ms: (calls.append("timer"), timers.add(ms)))
        deleteTimer = staticmethod(lambda ms: (calls.append("timer"), timers.discard(ms)))
        listTimers = staticmethod(lambda: (calls.append("list"), sorted(timers))[1])

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    cache = s._Latest(1000)
    cache.init(Handle())
    row = Row("url", "ts", "us", "fetch_id")
    put = lambda *pairs: list(cache.handleInputRows(("u",), iter([row("u", None, us, i) for us, i in pairs]), Times()))
    assert put((5000, 1), (7000, 2), (7000, 3)) == [Row(url="u", us=7000, fetch_id=3)]
    assert calls == ["get", "update", "timer"] and timers == {1007}
    # A newer fetch moves the one timer, an older one changes nothing.
    assert put((9000, 4)) == [Row(url="u", us=9000, fetch_id=4)] and timers == {1009}
    assert put((8000, 9)) == [] and timers == {1009} and value[-1] == (9000, 4)
    # Gone with its timer, an entry starts anew.
    timers.clear()
    assert list(cache.handleExpiredTimer(("u",), Times(), None)) == [] and not value
    assert put((1000, 5)) == [Row(url="u", us=1000, fetch_id=5)] and timers == {1001}


def test_refetches_dropped(spark, split):
    stream = live(spark, split, "events").select(F.col("user_id").alias("url"), F.col("ts").cast("timestamp").alias("ts"))
    got = run_available(s.suppress_refetches(stream, "100 days"), "refetch")
    assert got.count() == Tables(spark, SF).events.select("user_id").distinct().count()


def test_chunk_summaries(spark, split):
    got = run_available(s.stream_chunk_summaries(live(spark, split, "conversations"), 2), "chunks")
    t = Tables(spark, SF)
    full = c.chunk_summaries(t.conversations, 2).join(c.history_sizes(t.conversations), "conv_id").filter("(chunk + 1) * 2 <= n_messages")
    assert sorted(map(tuple, got.select("conv_id", "chunk", "summary").collect())) == sorted(
        map(tuple, full.select("conv_id", "chunk", "summary").collect()))


def test_memory_fold(spark, split):
    number = F.regexp_extract("session_id", "s_([0-9]+)_", 1).cast("long") + F.regexp_extract("session_id", "_([0-9]+)$", 1).cast("long") * 100000
    feed = Tables(spark, SF)
    feed.__dict__["conversations"] = live(spark, split, "conversations")
    got = s.stream_memory_fold(feed.memory_json.withColumn("seq", number), 50)
    t = Tables(spark, SF)
    rows = j.extracted_memories(t.memory_json).withColumn("session_id", F.col("source_session_id")).withColumn("seq", number)
    want = m.memory_fifo(m.memory_upsert(rows.drop("session_id")), 50)
    assert sorted(x.id for x in got.collect()) == sorted(x.id for x in want.collect())


def test_a_later_run_goes_on(spark, tmp_path):
    """Files that come after the first run are folded into what it left; nothing is read twice."""
    feed, place = tmp_path / "feed", str(tmp_path / "place")
    feed.mkdir()
    rows = [(f"s_{i}", '{"semantic": [{"content": "note %d", "keywords": "k"}], "episodic": [], "procedural": []}' % i, i) for i in range(6)]

    def arrive(some, name):
        spark.createDataFrame(some, "session_id string, raw string, seq long").coalesce(1).write.parquet(str(feed / name))

    def run():
        stream = spark.readStream.schema("session_id string, raw string, seq long").option("recursiveFileLookup", "true").parquet(str(feed))
        counted = run_available(stream.select("session_id"), "seen", folder=place).count()
        return counted, sorted(x.content for x in s.stream_memory_fold(stream, 50, folder=place).collect())

    arrive(rows[:4], "one")
    assert run() == (4, [f"note {i}" for i in range(4)])
    arrive(rows[4:], "two")
    assert run() == (6, [f"note {i}" for i in range(6)])
    assert run() == (6, [f"note {i}" for i in range(6)])


def test_window_counts(spark, split):
    stream = live(spark, split, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    got = {(x.key, x.start): x.n for x in run_available(s.stream_rate_counts(stream, "6 hours", "3 hours", "10 days"), "counts").collect()}
    batch = Tables(spark, SF).events.groupBy(F.window("ts", "6 hours", "3 hours"), "event_type").count().collect()
    want = {(x.event_type, x.window.start): x["count"] for x in batch}
    assert got and all(want[k] == n for k, n in got.items())
    closed = max(k[1] for k in want) - dt.timedelta(days=11)
    assert all(k in got for k in want if k[1] < closed)


def test_tables_in_folders_of_files(spark, tmp_path):
    """A table may be a folder of files of any name, as Spark writes it: it streams the same rows as one file does."""
    t = Tables(spark, SF)
    t.conversations.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("stream_chunk_summaries", "stream_memory_fold"):
        got, want = (sorted(map(repr, plans.queries()[name](spark, place).collect())) for place in (str(tmp_path), SF))
        assert got == want and got


def test_files_once(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.pdf", "b.TXT", "c.bin", "sub/d.md"):
        (tmp_path / n).write_text(n)
    got = run_available(s.stream_ingest_files(spark, str(tmp_path)), "files").collect()
    assert sorted((x.filename, x.file_size, x.extension) for x in got) == [("a.pdf", 5, ".pdf"), ("b.TXT", 5, ".txt"), ("d.md", 8, ".md")]
