"""File, JSON, JDBC and stored-results-page sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import html as H
from ..functions.skew import scalar_count
from ..functions.text import any_of
from ..operators.store import suffix


def spread(table: DataFrame) -> DataFrame:
    """Rows of a table stored in fewer files than there are cores dealt out evenly; other tables as they are.

    Long texts in a single row group would otherwise keep one core busy. Large tables have many files and
    are never shuffled here.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if len(table.inputFiles()) < cores else table


def scan_document_dir(spark: SparkSession, folder: str, extensions=fixed.BATCH_EXTENSIONS) -> DataFrame:
    """Files below a folder with an accepted extension; only the listing is read, never the contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    listed = files.select(name.alias("filename"), F.col("path").alias("file_path"), F.col("length").alias("file_size"),
                          suffix(name).alias("extension"))
    return listed.filter(F.col("extension").isin(*extensions)).orderBy("file_path")


def read_json_kv(spark: SparkSession, path: str) -> DataFrame:
    """Keyed JSON stores: one object per file as (key, value) rows, values as JSON text."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def write_json_kv(rows: DataFrame, path: str, keys_per_file: int = 10_000) -> None:
    """(key, value) rows as a keyed JSON store: one object per file, values as they stand (maps and structs become nested objects).

    Keys are dealt out over files by their hash, about ``keys_per_file`` to each, so what one task gathers is bounded. Keys are
    unique and not null.
    """
    n = F.greatest(F.lit(1), F.ceil(scalar_count(rows) / keys_per_file)).cast("int")
    held = rows.select("key", "value", F.pmod(F.xxhash64("key"), n).cast("int").alias("file"))
    objects = held.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("value"))
    objects.write.partitionBy("file").text(path)


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None, lower=None, upper=None,
              partitions: int = 1, **options: str) -> DataFrame:
    """A JDBC table, read in parallel ranges when a partition column and its bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.load()


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, **options: str) -> None:
    rows.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(
        **options).mode(mode).save()


RESULT_LINK = '(?s)class="result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>'


def serp_rows_from_html(stored: DataFrame, max_links: int | None = None) -> DataFrame:
    """Result rows (query_id, pos, url, title) of stored results pages (query_id, html); repeated URLs out."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(RESULT_LINK), 1).alias("u"),
                         F.regexp_extract_all("html", F.lit(RESULT_LINK), 2).alias("t"))
    if max_links is not None:
        pairs = F.slice(pairs, 1, max_links)
    rows = stored.select("query_id", F.posexplode(pairs).alias("pos", "p")).select("query_id", "pos", "p.u", "p.t")
    target = F.regexp_extract("u", "[?&]uddg=([^&]*)", 1)
    url = F.when(target != "", F.url_decode(target)).otherwise(F.col("u"))
    found = rows.select("query_id", "pos", url.alias("url"), F.regexp_replace("t", "<[^>]+>", "").alias("title"))
    return found.groupBy("query_id", "url").agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"))


def serp_rows_by_layout(stored: DataFrame, max_results: int = 10) -> DataFrame:
    """Result rows of stored results pages (engine, html, and columns that name a page), by the layout of each engine.

    Adds (pos, title, url, snippet) to the other columns. Results without address or title, and links that lead nowhere or back to the
    engine, are out; rooted links get the engine's root; the first ``max_results`` stay. A page that asks for a check, a null page
    and an unknown engine give no rows; repeated results stay.
    """
    of_engine = lambda values, default: F.coalesce(*[F.when(F.col("engine") == e, v) for e, v in values.items()], default)
    asks = any_of(F.lower("html"), fixed.RESULT_PAGE_BLOCKS)
    root = of_engine({e: F.lit(r) for e, r in fixed.RESULT_ROOTS.items()}, F.lit(""))
    words = lambda table: of_engine({e: F.array(*[F.lit(x) for x in v]) for e, v in table.items()}, F.array().cast("array<string>"))
    rooted = lambda href: F.when(href.startswith("/"), F.concat(root, href)).otherwise(href)
    found = F.transform(H.results("html", "engine"), lambda r: F.struct(
        r["title"].alias("title"), r["href"].alias("href"), rooted(r["href"]).alias("url"), r["snippet"].alias("snippet")))
    good = F.filter(found, lambda r: (r["title"] != "") & (r["href"] != "")
                    & ~F.exists(words(fixed.RESULT_LINK_STARTS_OUT), lambda p: F.startswith(r["href"], p))
                    & ~F.exists(words(fixed.RESULT_LINKS_OUT), lambda p: F.contains(F.lower(r["url"]), p)))
    keys = [c for c in stored.columns if c not in ("html", "pos", "title", "url", "snippet")]
    rows = stored.filter(~asks).select(*keys, F.posexplode(F.slice(good, 1, max_results)).alias("pos", "_r"))
    return rows.select(*keys, "pos", "_r.title", "_r.url", "_r.snippet")
