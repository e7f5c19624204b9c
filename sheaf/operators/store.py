"""Keyed tables: upserts, first-wins inserts, cascaded deletes, look-ups, page store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import col
from ..sources.tables import stored, write_bucketed

#: Pages of one document that share a bucket key.
PAGE_BLOCK = 256


def suffix(name: Column | str) -> Column:
    """Lower-cased extension with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(col(name), "[^./](\\.[^./]+)$", 1))


def validate_ingest(uploads: DataFrame, extensions=fixed.UPLOAD_EXTENSIONS, max_bytes: int = fixed.MAX_UPLOAD_BYTES) -> DataFrame:
    """Adds ``reject_reason`` (null = accepted) to uploads (filename, size)."""
    reason = (F.when(F.coalesce("filename", F.lit("")) == "", "filename is required")
              .when(~suffix("filename").isin(*extensions), F.concat(F.lit("unsupported file type '"), suffix("filename"), F.lit("'")))
              .when(F.col("size") > max_bytes, "file too large"))
    return uploads.withColumn("reject_reason", reason)


def sanitize_filename(name: Column | str, longest: int = 255, stem_chars: int = 200) -> Column:
    plain = F.translate(F.replace(F.replace(col(name), F.lit("/"), F.lit("")), F.lit("\\"), F.lit("")), "\u0000", "")
    ext = F.regexp_extract(plain, "[^.](\\.[^.]+)$", 1)
    stem = F.substring(plain, F.lit(1), F.length(plain) - F.length(ext))
    return F.when(F.length(plain) > longest, F.concat(F.substring(stem, 1, stem_chars), ext)).otherwise(plain)


def page_store_meta(pages: DataFrame, meta: DataFrame) -> DataFrame:
    """Document meta with ``page_count`` taken from the stored pages and the status set."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))
    return meta.drop("page_count", "status").join(counts, "doc_id", "left").withColumn(
        "page_count", F.coalesce("page_count", F.lit(0))).withColumn("status", F.lit("completed"))


def page_block(page: Column | str, size: int = PAGE_BLOCK) -> Column:
    return F.floor((col(page) - 1) / size).cast("int")


def write_page_store(pages: DataFrame, meta: DataFrame, pages_table: str | None = None, meta_table: str | None = None,
                     buckets: int | None = None, block: int = PAGE_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pages (doc_id, page, content) and meta as two tables bucketed alike; returns the stored tables.

    The bucket key is the document and the block of ``block`` pages, so a document with a third of all pages fills many
    buckets. Meta has one row per document and block (the first even for documents without pages), which lets both tables meet
    bucket by bucket. Without names the tables are new ones in the shared folder.
    """
    keys = ["doc_id", "block"]
    cut = pages.withColumn("block", page_block("page", block))
    last = pages.groupBy("doc_id").agg(F.coalesce(F.max(page_block("page", block)), F.lit(0)).alias("_last"))
    spread = page_store_meta(pages, meta).join(last, "doc_id", "left").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.coalesce("_last", F.lit(0))))).drop("_last")
    out = [stored(df, keys, order, buckets) if name is None else write_bucketed(df, name, keys, order, buckets)
           for df, name, order in ((cut, pages_table, ["page"]), (spread, meta_table, []))]
    return out[0], out[1]


def store_meta(stored_meta: DataFrame) -> DataFrame:
    """One row per document of a stored meta table."""
    return stored_meta.filter("block = 0").drop("block")


def read_store_pages(stored_pages: DataFrame, stored_meta: DataFrame, wanted: DataFrame | None = None,
                     block: int = PAGE_BLOCK) -> DataFrame:
    """Stored pages with their document's meta; both tables meet in their buckets, neither is moved.

    ``wanted(doc_id, page_from, page_to)`` keeps only these ranges: their blocks are looked up by the bucket key.
    """
    joined_ = stored_pages.join(stored_meta, ["doc_id", "block"])
    if wanted is not None:
        spans = wanted.filter("page_from <= page_to").select("doc_id", "page_from", "page_to", F.explode(F.sequence(
            page_block("page_from", block), page_block("page_to", block))).alias("block"))
        joined_ = joined_.join(spans, ["doc_id", "block"]).filter("page between page_from and page_to").drop("page_from", "page_to")
    return joined_.drop("block")


def upsert_latest(rows: DataFrame, keys: list[str], order: str, keep_first: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """One row per key out of old and new rows: last values win, ``keep_first`` columns stay from the first row.

    An aggregate with map-side combine: a key updated very often shrinks before the shuffle.
    """
    rest = [c for c in rows.columns if c not in (*keys, *keep_first)]
    firsts = [F.min_by(c, order).alias(c) for c in keep_first]
    out = rows.groupBy(*keys).agg(*firsts, F.max_by(F.struct(*rest), order).alias("_last"))
    return out.select(*keys, *keep_first, "_last.*")


def insert_ignore(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key wins."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(*keys, "_f.*")


def delete_cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed keys (one column named ``key``)."""
    keys = doomed.select(F.col(key).alias("_dead"))
    return (parents.join(keys, F.col(key) == F.col("_dead"), "left_anti"),
            children.join(keys, F.col(foreign) == F.col("_dead"), "left_anti"))


def lookup_by_key(keys: DataFrame, table: DataFrame, key: str, what: str = "Document") -> DataFrame:
    """Requested rows with an ``error`` text where the key is unknown."""
    found = keys.join(table.withColumn("_hit", F.lit(True)), key, "left")
    return found.withColumn("error", F.when(F.col("_hit").isNull(), F.concat(
        F.lit(f"{what} "), key, F.lit(" not found")))).drop("_hit")


def skip_processed(documents: DataFrame, processed: DataFrame, stem: str, key: str, contains: bool = False) -> DataFrame:
    """Documents not processed yet: by equal key, or by a processed key that contains the stem."""
    if not contains:
        return documents.join(processed.select(F.col(key).alias(stem)), stem, "left_anti")
    # Each key shows its substrings of the lengths that stems have; work per key is bounded by its own length.
    lengths = documents.select(F.sort_array(F.collect_set(F.length(stem)))).scalar()
    name = F.col("_key")
    # One more start than there is room for would run backwards.
    spots = lambda n: F.when(F.length(name) >= n, F.sequence(F.lit(1), F.length(name) - n + 1)).otherwise(F.array().cast("array<int>"))
    shown = F.flatten(F.transform(F.col("_n"), lambda n: F.transform(spots(n), lambda i: F.substring(name, i, n))))
    done = processed.select(F.col(key).alias("_key"), lengths.alias("_n")).select(F.explode_outer(F.array_distinct(shown)).alias(stem))
    return documents.join(done.filter(F.col(stem).isNotNull()), stem, "left_anti")


def json_kv(rows: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """Keyed JSON objects as (id, key, value) rows."""
    parsed = F.from_json(json_column, "map<string,string>")
    return rows.select(id_column, F.explode(parsed).alias("key", "value"))
