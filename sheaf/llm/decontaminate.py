"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

A test item is short, a document may be very long, so their Jaccard similarity says nothing; what counts is the share
of the item's word shingles that a document holds. Items are partitioned by their number of shingles. In a
partition of items with at most m shingles and threshold t, an item's signature is its k = m - ceil(t m) + 1
smallest shingle hashes (bottom-k MinHash; an item with n shingles needs n - ceil(t n) + 1, never more than k). A
document that holds t of the item misses at most n - ceil(t n) shingles, so it holds one of the signature: no document
is lost. The largest hash of a partition's signatures bounds what documents have to show for it, and a document shows
nothing for partitions whose smallest items already need more shingles than it has: hashes above the bounds that are
left are dropped before anything is exploded. Candidates are verified on all shingles, as strings of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, saved, shingle_hashes, text_of, words

WIDTH, CONTAINMENT = 5, 0.8


def needed(n: Column, t: float) -> Column:
    """Shingles of n that a document must hold. Ceiling with a guard against 0.8 * 5 = 4.000000001."""
    return F.ceil(n * F.lit(t) - 1e-9).cast("int")


def exact_shingles(w: Column, n: int) -> Column:
    """Shingles as strings of words, for verification; ``w`` is a plain column."""
    full = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))
    return F.when(F.size(w) >= n, F.array_distinct(full)).otherwise(F.array().cast("array<string>"))


def item_signatures(items: DataFrame, width: int, t: float) -> DataFrame:
    """(item_id, width, n, part, signature); items without a word are left out, shorter items are one shingle of their own width."""
    w = items.select("item_id", words(lower_ascii(text_of("text"))).alias("w")).filter(F.size("w") > 0)
    sets = w.select("item_id", F.least(F.size("w"), F.lit(width)).alias("width"),
                    F.array_sort(F.array_distinct(shingle_hashes_any(F.col("w"), width))).alias("h"))
    n = F.size("h")
    # Partition: sizes up to the next power of two.
    return (sets.select("item_id", "width", "h", n.alias("n"), F.ceil(F.log2(n)).cast("int").alias("part"))
            .select("item_id", "width", "n", "part", F.slice("h", F.lit(1), F.col("n") - needed(F.col("n"), t) + 1).alias("signature")))


def shingle_hashes_any(w: Column, width: int) -> Column:
    """Like ``shingle_hashes``, but a text of fewer words is hashed as one window of its own width."""
    short = F.lit(None).cast("array<bigint>")
    for k in range(width - 1, 0, -1):
        short = F.when(F.size(w) == k, F.array(F.xxhash64(*[F.element_at(w, i + 1) for i in range(k)]))).otherwise(short)
    return F.when(F.size(w) >= width, shingle_hashes(w, width)).otherwise(short)


def candidates(documents: DataFrame, items: DataFrame, width: int = WIDTH, t: float = CONTAINMENT) -> DataFrame:
    """(row, item_id): documents that hold a hash of the item's signature and are large enough for its partition."""
    signed = saved(item_signatures(items, width, t))
    # One row per width and partition: at most ``width`` times the binary digits of the largest item.
    bounds = signed.groupBy("width", "part").agg(
        F.max(F.array_max("signature")).alias("top"), F.min(needed(F.col("n"), t)).alias("least")).collect()
    w = documents.select("row", words(lower_ascii(text_of("text"))).alias("w"))
    probes = []
    for k in sorted({r["width"] for r in bounds}):
        parts = [r for r in bounds if r["width"] == k]
        size = F.size("w") - k + 1
        # A document can only hold items of partitions whose least share it is large enough for, so their bounds decide what it shows.
        fits = [F.when(size >= r["least"], F.lit(r["top"])) for r in parts]
        sets = w.select("row", "w", size.alias("size"), (F.greatest(*fits) if len(fits) > 1 else fits[0]).alias("bound"))
        shown = F.array_distinct(F.filter(shingle_hashes(F.col("w"), k), lambda h: h <= F.col("bound")))
        sets = sets.select("row", F.when(F.col("bound").isNotNull(), shown).alias("h"), "size")
        # explode() would add a filter on the array below, which makes all of it again word by word; explode_outer() doesn't.
        probes.append(sets.select("row", "size", F.lit(k).alias("width"), F.explode_outer("h").alias("hash")))
    asked = signed.select("item_id", "width", needed(F.col("n"), t).alias("needed"), F.explode("signature").alias("hash"))
    if not probes:
        return documents.select("row").join(asked.select("item_id"), F.lit(False)).select("row", "item_id").limit(0)
    rows = probes[0]
    for p in probes[1:]:
        rows = rows.union(p)
    return rows.join(asked, ["width", "hash"]).filter(F.col("size") >= F.col("needed")).select("row", "item_id").distinct()


def contained(documents: DataFrame, items: DataFrame, width: int = WIDTH, t: float = CONTAINMENT, key: str = "doc_id", text: str = "text",
              item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): items of which a document holds at least ``t`` of the distinct shingles.

    Words are lower-cased (A-Z). Null and empty texts on either side find nothing; repeated documents or items of one id
    count once each per differing text; an item of fewer than ``width`` words is one shingle of its own length; extra
    columns are ignored; null ids are kept; empty tables give no rows.
    """
    docs = documents.select(F.col(key).alias("row"), F.col(text).alias("text"))
    tests = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).distinct()
    tagged = tests.withColumn("item_id", F.struct("item_id", F.xxhash64("text").alias("h")))
    found = saved(candidates(docs.withColumn("row", F.struct("row", F.xxhash64("text").alias("h"))), tagged, width, t))
    w = F.col("w")
    sets = tagged.select("item_id", words(lower_ascii(text_of("text"))).alias("w")).filter(F.size("w") > 0)
    shingles = sets.select("item_id", F.least(F.size(w), F.lit(width)).alias("k"), "w")
    whole = None
    for k in range(1, width + 1):
        whole = F.when(F.col("k") == k, exact_shingles(w, k)) if whole is None else whole.when(F.col("k") == k, exact_shingles(w, k))
    wanted = found.join(shingles.select("item_id", "k", whole.alias("want")), "item_id")
    asked = saved(found.select("row").distinct())
    texts = docs.select(F.struct("row", F.xxhash64("text").alias("h")).alias("row"), "text").join(asked, "row", "left_semi").distinct()
    held = texts.select("row", words(lower_ascii(text_of("text"))).alias("w")).join(wanted, "row")
    # Only windows that the item asks for leave the transform: a document's own shingles are never materialised as strings.
    exact = None
    for k in range(1, width + 1):
        exact = F.when(F.col("k") == k, exact_shingles(w, k)) if exact is None else exact.when(F.col("k") == k, exact_shingles(w, k))
    counted = held.select("row", "item_id", F.size("want").alias("n_shingles"), F.size(F.array_intersect("want", exact)).alias("n_found"))
    return (counted.filter(F.col("n_found") >= needed(F.col("n_shingles"), t))
            .select(F.col("row.row").alias(key), F.col("item_id.item_id").alias(item), F.col("n_shingles").cast("long").alias("n_shingles"),
                    F.col("n_found").cast("long").alias("n_found")))


def without_items(documents: DataFrame, items: DataFrame, width: int = WIDTH, t: float = CONTAINMENT) -> DataFrame:
    """Rows of ``documents`` that hold no item, all columns as they were; rows with a null id are kept."""
    hit = saved(contained(documents, items, width, t).select("doc_id").distinct())
    return documents.join(hit, "doc_id", "left_anti").select(documents.columns)
