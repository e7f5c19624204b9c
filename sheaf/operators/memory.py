"""Long-term memory: upserts, forgetting, search, context lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.skew import scalar_count, top_k
from ..functions.text import col, joined, words
from .store import upsert_latest

EDGES = r"[,.!?;:()\[\]{}]"


def memory_upsert(rows: DataFrame) -> DataFrame:
    """Entries replaced by id; the last arrival also decides the position (``seq``)."""
    last = rows.withColumn("_at", F.col("seq"))
    return upsert_latest(last, ["id"], "_at", ()).drop("_at")


def memory_fifo(entries: DataFrame, max_entries: int = 200, per: list[str] | None = None,
                quotas: dict[str, int] | None = None) -> DataFrame:
    """Newest entries only: over the whole store, per owner columns, or by a quota per type."""
    newest = [F.col("seq").desc(), F.col("id")]
    if quotas:
        quota = F.coalesce(*[F.when(F.col("type") == k, F.lit(n)) for k, n in quotas.items()], F.lit(max_entries))
        return top_k(entries, ["type"], newest, max([max_entries, *quotas.values()]), "_rn").filter(
            F.col("_rn") <= quota).drop("_rn")
    if per:
        return top_k(entries, per, newest, max_entries, "_rn").drop("_rn")
    return entries.orderBy(*newest).limit(max_entries)


def memory_list(entries: DataFrame, memory_type: str | None = None, enabled_only: bool = False, page: int = 1,
                page_size: int = 50) -> DataFrame:
    """One page in insertion order with the total of the filtered entries."""
    if memory_type and memory_type != "all":
        entries = entries.filter(F.col("type") == memory_type)
    if enabled_only:
        entries = entries.filter("enabled")
    total = scalar_count(entries)
    return entries.orderBy("seq").limit(page * page_size).offset((page - 1) * page_size).withColumn("total", total)


def memory_set_enabled(entries: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with changed flags (id, enabled, at) and the change requests naming unknown ids."""
    new = changes.select("id", F.col("enabled").alias("_e"), F.col("at").alias("_at"))
    updated = entries.join(new, "id", "left").withColumn("enabled", F.coalesce("_e", "enabled")).withColumn(
        "updated_at", F.coalesce("_at", "updated_at")).drop("_e", "_at")
    return updated, changes.join(entries.select("id"), "id", "left_anti")


def memory_forget(entries: DataFrame, ids: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Remaining entries and the number removed; no ids clears the store."""
    gone = entries if ids is None else entries.join(ids.select("id"), "id", "left_semi")
    left = entries.filter(F.lit(False)) if ids is None else entries.join(ids.select("id"), "id", "left_anti")
    return left, gone.agg(F.count(F.lit(1)).alias("n_removed"))


def memory_terms(text: Column | str) -> Column:
    """Distinct words of three or more characters, lower-cased, edge punctuation off (may leave '')."""
    long = F.filter(words(text), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(long, lambda w: F.regexp_replace(F.lower(w), f"^{EDGES}+|{EDGES}+$", "")))


def memory_keyword_search(entries: DataFrame, queries: DataFrame, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """Top k entries per query by shared terms over (distinct entry terms + 1): (query_id, rank, id, score).

    ``by`` names owner columns of both tables: a query then sees its owner's entries only.
    """
    by = by or []
    text = F.concat_ws(" ", "content", F.array_join("keywords", " "))
    terms = entries.select(*by, "id", "seq", memory_terms(text).alias("_t"))
    flat = terms.select(*by, "id", "seq", F.size("_t").alias("_n"), F.explode("_t").alias("term"))
    wanted = queries.select(*by, "query_id", F.explode(memory_terms("query")).alias("term"))
    scored = flat.join(wanted, [*by, "term"]).groupBy("query_id", "id", "seq", "_n").agg(F.count(F.lit(1)).alias("_o")).select(
        "query_id", "id", "seq", F.round(F.col("_o") / (F.col("_n") + 1), 9).alias("score"))
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("seq"), F.col("id")], k).drop("seq")


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)) + 1e-8


def _whole(v: str) -> Column:
    """Vectors that are null, empty or hold nulls count as absent."""
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()), F.lit(False))


def memory_vector_search(entries: DataFrame, queries: DataFrame, k: int = 5, owner: str = "owner") -> DataFrame:
    """Top k entries per query among its owner's by cosine of their vectors, else by words: (query_id, rank, id, score).

    ``entries(id, seq, content, keywords, embedding)`` and ``queries(query_id, query, embedding)`` both carry ``owner``. A query
    without a vector, or whose owner has no entry with one, is searched by words, as a service does whose model did not answer.
    Entries without a vector are no vector hits. The scores of a pair are computed where its rows meet; of each query, k hits a
    task move on. A store is capped per owner (``memory_fifo``), so the entries that meet one query are bounded; owners with
    many queries are split by the join. Ties go to the older entry, then the smaller id.
    """
    held = entries.filter(_whole("embedding")).select(
        F.col(owner).alias("_o"), "id", "seq", F.col("embedding").alias("_e"), _length(F.col("embedding")).alias("_el"))
    known = held.select(F.col("_o").alias("_known")).distinct()
    can = _whole("embedding")
    vectors = queries.filter(can).select("query_id", owner, F.col("embedding").alias("_q"), _length(F.col("embedding")).alias("_ql"))
    dot = F.aggregate(F.zip_with("_e", "_q", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    near = vectors.join(held, F.col(owner) == F.col("_o")).select(
        "query_id", "id", "seq", F.round(dot / (F.col("_el") * F.col("_ql")), 6).alias("score"))
    hits = top_k(near, ["query_id"], [F.col("score").desc(), F.col("seq"), F.col("id")], k).drop("seq")
    spoken = queries.filter(~can).unionByName(queries.filter(can).join(known, F.col(owner) == F.col("_known"), "left_anti"))
    words_ = memory_keyword_search(entries, spoken, k, by=[owner])
    return hits.unionByName(words_.select(hits.columns))


def memory_retrieve(entries: DataFrame, hits: DataFrame, k: int = 5, memory_type: str | None = None) -> DataFrame:
    """Search hits (top 2k, already cut) kept when enabled and of the type, then cut to k."""
    rows = hits.drop("rank").join(entries, "id").filter("enabled")
    if memory_type and memory_type != "all":
        rows = rows.filter(F.col("type") == memory_type)
    return top_k(rows, ["query_id"], [F.col("score").desc(), F.col("seq"), F.col("id")], k)


def type_label(kind: Column | str) -> Column:
    c = col(kind)
    return F.coalesce(*[F.when(c == t, label) for t, _, label in fixed.MEMORY_TYPES], c)


def type_flag(kind: Column | str) -> Column:
    c = col(kind)
    return F.coalesce(*[F.when(c == t, flag) for t, flag, _ in fixed.MEMORY_TYPES], F.lit(0))


def memory_context(retrieved: DataFrame) -> DataFrame:
    """Labelled lines per query and the union of the type flags shown."""
    line = F.concat(F.lit("["), type_label("type"), F.lit("] "), "content")
    return retrieved.groupBy("query_id").agg(joined("\n", line, "rank").alias("context"),
                                             F.bit_or(type_flag("type")).alias("type_flags"))


def memory_relevance_view(retrieved: DataFrame) -> DataFrame:
    return retrieved.select("query_id", "rank", "id", "type", type_label("type").alias("label"), "content",
                            F.array_join("keywords", ", ").alias("keywords"), F.round("score", 4).alias("relevance"),
                            F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))
