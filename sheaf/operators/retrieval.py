"""Page and window retrieval, reranking and context assembly for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.skew import top_k
from ..functions.text import joined, occurrences, terms
from ..session import written
from ..sources.tables import default_buckets, stored, write_bucketed

RULE = "\n\n---\n\n"
#: Characters of a word whose substrings are read in one piece.
PIECE = 256
#: Characters by which places of a word find query words.
GRAM = 5
#: Query words whose finds in a window are the bits of one number.
BITS = 63
#: Hashes of documents over which the postings of one word are spread in a stored index.
POSTING_SLICES = 16
#: Pages, or postings, whose windows one task scores.
PAGES_PER_TASK, POSTINGS_PER_TASK = 16_384, 1 << 19
#: Bytes of text whose words one task reads as one set.
BLOCK_BYTES = 32 << 20


def _window(window_pages: int) -> Column:
    return F.floor((F.col("page") - 1) / window_pages).cast("int")


def _postings(pages: DataFrame, window_pages: int) -> DataFrame:
    """Distinct (doc_id, win, term); words repeated in a task's pages are dropped before the shuffle, and so is what a
    semi-join of the result leaves out."""
    return pages.select("doc_id", _window(window_pages).alias("win"), F.explode(terms("content")).alias("term")).distinct()


def _query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(terms("query")).alias("term"))


def page_spec(first: Column | str, last: Column | str) -> Column:
    first = F.col(first) if isinstance(first, str) else first
    last = F.col(last) if isinstance(last, str) else last
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))


def scoring_tasks(rows: DataFrame, rows_per_task: int = PAGES_PER_TASK) -> int:
    """Tasks among which windows are scored: as many as the rows need, so that what one task holds does not grow with the table."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_task))


def _best_windows(found: DataFrame, wanted: DataFrame, k: int, tasks: int) -> DataFrame:
    """Best ``k`` windows per query by the number of its words among ``found(doc_id, win, term)``, each word once a window.

    A window's words come together once; counting and the first choice happen there, and only ``k`` rows per query leave a task.
    """
    scores = found.repartition(tasks, "doc_id", "win").join(wanted, "term").groupBy("query_id", "doc_id", "win").agg(F.count(F.lit(1)).alias("score"))
    return top_k(scores, ["query_id"], [F.col("score").desc(), F.col("doc_id"), F.col("win")], k)


def _finish(pages: DataFrame, hits: DataFrame, window_pages: int, cut: int) -> DataFrame:
    """Page range and text of the hit windows. Hits are written first: they are computed once, and as their true size is known, they go
    to the pages where they are few, and other pages' text stays."""
    found = written(hits, "hits").join(pages.withColumn("win", _window(window_pages)), ["doc_id", "win"])
    return found.groupBy("query_id", "rank", "doc_id", "win", "score").agg(
        F.min("page").alias("page_from"), F.max("page").alias("page_to"), joined("\n", "content", "page").alias("content")).select(
        "query_id", "rank", "doc_id", "win", page_spec("page_from", "page_to").alias("pages"), "score", F.substring("content", 1, cut).alias("content"))


def _numbered(wanted: DataFrame) -> DataFrame:
    """(term, slot, bit): one bit of one slot for each word of ``wanted(query_id, term)``; words of one length fill slots in their order."""
    at = F.row_number().over(W.partitionBy(F.length("term")).orderBy("term")) - 1
    placed = wanted.select("term").distinct().withColumn("at", at)
    slot = F.shiftleft(F.length("term").cast("long"), 32) + F.floor(F.col("at") / BITS)
    return placed.select("term", slot.alias("slot"), F.expr(f"shiftleft(1L, at % {BITS})").alias("bit"))


def _held(words_: DataFrame, numbered: DataFrame) -> DataFrame:
    """(block, word, slot, bits): the words of ``numbered(term, slot, bit)`` that lie in each word of ``words_(block, word)``.

    At every place of a word, the grams of up to ``GRAM`` characters meet the query words that begin with them (or are them, if shorter) by
    their hashes, and the query word is compared in place: work is linear in the words, and equal hashes do no harm.
    """
    needles = numbered.withColumn("gram", F.xxhash64(F.substring("term", 1, GRAM)))
    # A long word is read in pieces that overlap so far that every query word is whole in one.
    longest = F.coalesce(needles.agg(F.max(F.length("term"))).scalar(), F.lit(0))
    starts = words_.select("block", "word", F.explode(F.sequence(F.lit(1), F.length("word"), F.lit(PIECE))).alias("start"))
    cut = starts.select("block", "word", F.substring("word", F.col("start"), longest + PIECE).alias("piece"))
    spots = cut.select("block", "word", "piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("at"))
    tails = spots.select("block", "word", F.substring("piece", F.col("at"), longest).alias("tail"))
    grams = F.array(*[F.when(F.length("tail") >= n, F.xxhash64(F.substring("tail", 1, n))) for n in range(1, GRAM + 1)])
    held = tails.select("block", "word", "tail", F.explode(grams).alias("gram")).join(needles, "gram").filter(F.startswith("tail", "term"))
    return held.groupBy("block", "word", "slot").agg(F.bit_or("bit").alias("bits"))


def _substring_scores(pages: DataFrame, wanted: DataFrame, window_pages: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, doc_id, win, score): how many distinct words of ``wanted(query_id, term)`` lie in the window; windows without any are left out.

    A query word holds no blanks, so it lies in a window exactly when it lies in one of the window's words. Windows are dealt into blocks
    of about ``block_bytes`` of text, the one time text moves. Each distinct word of a block is searched once, and what it holds goes
    back to the windows that it stands in; all of this, the counting too, stays in the block.
    """
    spark = pages.sparkSession
    size = pages.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # As many as the text needs, in whole rounds of tasks.
    blocks = tasks * max(1, -(-size // (block_bytes * tasks)))
    rows = pages.select("doc_id", _window(window_pages).alias("win"), "content")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "win"), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")
    # Any cut at blanks will do for words that query words lie in, and one at a plain character is the fastest.
    words_ = dealt.select("block", "doc_id", "win", F.explode(F.split(F.lower("content"), " ")).alias("word")).filter("word <> ''")
    numbered = _numbered(wanted)
    held = _held(words_.select("block", "word").distinct(), numbered)
    # Two numbers of 32 bits are looked up as one; the words themselves decide.
    given = held.select("block", F.hash("word").alias("h"), F.col("word").alias("same"), "slot", "bits").hint("shuffle_hash")
    met = words_.withColumn("h", F.hash("word")).join(given, ["block", "h"]).filter("word = same")
    found = met.groupBy("block", "doc_id", "win", "slot").agg(F.bit_or("bits").alias("bits"))
    asked = wanted.join(numbered, "term").groupBy("query_id", "slot").agg(F.bit_or("bit").alias("asked"))
    counts = found.join(asked, "slot").withColumn("n", F.bit_count(F.col("bits").bitwiseAND(F.col("asked")))).filter("n > 0")
    return counts.groupBy("block", "query_id", "doc_id", "win").agg(F.sum("n").alias("score")).drop("block")


def keyword_page_search(pages: DataFrame, queries: DataFrame, window_pages: int = 10, k: int = 5, cut: int = 6000) -> DataFrame:
    """Windows ranked by how many distinct query words occur in them as substrings."""
    scores = _substring_scores(pages, _query_terms(queries), window_pages)
    hits = top_k(scores, ["query_id"], [F.col("score").desc(), F.col("doc_id"), F.col("win")], k)
    return _finish(pages, hits, window_pages, cut)


def keyword_search_backoff(pages: DataFrame, queries: DataFrame, window_pages: int = 10, k: int = 5,
                           cut: int = 6000, backoff_cut: int = 3000) -> DataFrame:
    """Keyword search; a query without any hit gets the first half of the first ``k`` documents."""
    hits = written(keyword_page_search(pages, queries, window_pages, k, cut), "keyword_hits")
    first = pages.groupBy("doc_id").agg(F.max("page").alias("n")).orderBy("doc_id").limit(k)
    half = first.withColumn("last", F.least("n", F.greatest(F.lit(1), F.floor(F.col("n") / 2).cast("int"))))
    heads = (pages.join(half, "doc_id").filter(F.col("page") <= F.col("last"))
             .groupBy("doc_id", "last").agg(joined("\n", "content", "page").alias("content"))
             .select("doc_id", F.concat(F.lit("1-"), "last").alias("pages"),
                     F.substring("content", 1, backoff_cut).alias("content")))
    packed = heads.agg(F.array_sort(F.collect_list(F.struct("doc_id", "pages", "content"))).alias("d")).scalar()
    missed = queries.select("query_id").join(hits.select("query_id").distinct(), "query_id", "left_anti")
    spare = missed.select("query_id", F.posexplode(packed).alias("pos", "d")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), "d.doc_id", F.lit(0).alias("win"), "d.pages",
        F.lit(1).cast("long").alias("score"), "d.content")
    return hits.unionByName(spare)


def posting_index(pages: DataFrame, window_pages: int = 10) -> DataFrame:
    """Inverted index (term, doc_id, win)."""
    return _postings(pages, window_pages).select("term", "doc_id", "win")


def write_posting_index(pages: DataFrame, table: str | None = None, buckets: int | None = None, window_pages: int = 10,
                        slices: int = POSTING_SLICES) -> DataFrame:
    """The index as a stored table (term, slice, doc_id, win) that later searches read without moving it; returns the table.

    Bucketed and sorted by (term, slice). A slice is a hash of the document, so a word of every window fills up to
    ``slices`` buckets. Postings move once: they are made distinct where their bucket is written.
    """
    words_ = pages.select("doc_id", _window(window_pages).alias("win"), F.explode(terms("content")).alias("term"))
    cut = words_.select("term", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"), "doc_id", "win")
    keys, n = ["term", "slice"], buckets or default_buckets(pages.sparkSession)
    distinct = cut.repartition(n, *keys).distinct()
    return stored(distinct, keys, [], n) if table is None else write_bucketed(distinct, table, keys, [], n)


def search_stored_postings(stored_index: DataFrame, queries: DataFrame, k: int = 5, slices: int = POSTING_SLICES) -> DataFrame:
    """``search_postings`` over a stored index: the words of the queries go to the index's buckets, the index stays; only hits move on."""
    wanted = _query_terms(queries)
    places = wanted.select("term").distinct().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    asked = stored_index.join(places, ["term", "slice"], "left_semi").select("doc_id", "win", "term")
    return _best_windows(asked, wanted, k, scoring_tasks(stored_index, POSTINGS_PER_TASK))


def search_postings(index: DataFrame, queries: DataFrame, k: int = 5, tasks: int | None = None) -> DataFrame:
    """Whole-word search over a posting index: (query_id, rank, doc_id, win, score). Words that no query asks for are dropped first.

    ``tasks``: among how many the windows are scored (``scoring_tasks`` of the pages); without it the index is counted.
    """
    wanted = _query_terms(queries)
    asked = index.join(wanted.select("term").distinct(), "term", "left_semi").select("doc_id", "win", "term")
    return _best_windows(asked, wanted, k, tasks or scoring_tasks(index, POSTINGS_PER_TASK))


def search_windows(pages: DataFrame, queries: DataFrame, k: int = 5, window_pages: int = 10,
                   cut: int = 6000) -> DataFrame:
    """Whole-word search with the hit windows' text; only words that queries ask for enter the postings."""
    return _finish(pages, search_postings(posting_index(pages, window_pages), queries, k, scoring_tasks(pages)), window_pages, cut)


# --- reranking ---------------------------------------------------------------------------------

def text_score(query_terms: Column, text_terms: Column, lowered: Column) -> Column:
    """0.5 term overlap + 0.4 term frequency of one text."""
    shared = F.size(F.array_intersect(query_terms, text_terms))
    either = F.size(query_terms) + F.size(text_terms) - shared
    tf = F.aggregate(query_terms, F.lit(0), lambda acc, t: acc + occurrences(lowered, t))
    return (shared / F.greatest(either, F.lit(1))) * 0.5 + (tf / F.greatest(F.size(text_terms), F.lit(1))) * 0.4


def heuristic_rerank(candidates: DataFrame, top_n: int = 0) -> DataFrame:
    """Candidates (query_id, query, idx, text) of bounded lists, scored and ranked from 0.

    The score is the text score + 0.1 for the first and last of more than two. Scoring is the costly part and
    rows are few and long, so they are dealt out over all tasks by (query_id, idx) for it; terms are split once
    per row into columns that the scoring expressions read.
    """
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = (candidates.repartition(tasks, "query_id", "idx")
             .withColumn("_q", terms("query")).withColumn("_c", terms("text")).withColumn("_l", F.lower("text")))
    scored = split.select(*candidates.columns, text_score(F.col("_q"), F.col("_c"), F.col("_l")).alias("_s"))
    per_query = W.partitionBy("query_id")
    n = F.count(F.lit(1)).over(per_query)
    edge = F.when((n > 2) & ((F.col("idx") == 0) | (F.col("idx") == n - 1)), 0.1).otherwise(0.0)
    ranked = scored.withColumn("score", F.round(F.col("_s") + edge, 9)).drop("_s").withColumn(
        "rank", F.row_number().over(per_query.orderBy(F.col("score").desc(), "idx")) - 1)
    return ranked.filter(F.col("rank") < top_n) if top_n else ranked


def listwise_index(scores: DataFrame, batch: int = 64) -> DataFrame:
    """Positions within scoring batches turned into positions within the list."""
    return scores.withColumn("idx", F.col("batch_no") * batch + F.col("batch_idx"))


def rerank_external_scores(candidates: DataFrame, logits: DataFrame, top_n: int) -> DataFrame:
    """Scores come from an external model as raw logits per (query_id, idx)."""
    scored = candidates.join(logits, ["query_id", "idx"]).withColumn(
        "score", F.round(1 / (1 + F.exp(-F.col("logit"))), 9)).drop("logit")
    ranked = top_k(scored, ["query_id"], [F.col("score").desc(), F.col("idx")], top_n)
    return ranked.withColumn("rank", F.col("rank") - 1)


def sandwich_position(rank: Column, n: Column) -> Column:
    """Best third first, worst third in the middle, the rest last (closed form of the new position)."""
    third = F.greatest(F.lit(1), F.floor(n / 3))
    rest = n - third * 3
    begin = third + F.when(rest >= 1, 1).otherwise(0)
    middle = third * 2 + F.when(rest >= 2, 1).otherwise(0)
    return (F.when((n <= 2) | (rank < begin), rank)
            .when(rank >= middle, begin + rank - middle)
            .otherwise(rank + n - middle)).cast("int")


def sandwich_reorder(ranked: DataFrame) -> DataFrame:
    """Adds ``pos`` to ranked bounded lists."""
    n = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    return ranked.withColumn("pos", sandwich_position(F.col("rank"), n))


def rerank_sandwich(candidates: DataFrame, top_n: int = 0) -> DataFrame:
    return sandwich_reorder(heuristic_rerank(candidates, top_n))


# --- context -----------------------------------------------------------------------------------

def assemble_context(blocks: DataFrame, summaries: DataFrame | None = None, limit: int = 8000) -> DataFrame:
    """One context text per query from fetched blocks (query_id, query, idx, doc_name, pages, content).

    Lists longer than two are reranked and sandwiched; summaries (query_id, summary) frame the text.
    """
    texts = blocks.select("query_id", "query", "idx", F.concat(
        F.lit("## "), "doc_name", F.lit(":"), "pages", F.lit("\n\n"), F.substring("content", 1, limit)).alias("text"))
    placed = rerank_sandwich(texts)
    n = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    placed = placed.withColumn("_n", n).withColumn("pos", F.when(F.col("_n") > 2, F.col("pos")).otherwise(F.col("idx")))
    body = placed.groupBy("query_id").agg(joined(RULE, "text", "pos").alias("body"), F.first("_n").alias("n"))
    if summaries is None:
        return body.select("query_id", F.col("body").alias("context"))
    merged = body.join(summaries, "query_id", "left")
    s = F.col("summary")
    framed = F.concat(F.lit("## Agent Summary\n\n"), s, F.lit(RULE), "body", F.lit(RULE),
                      F.lit("[Key findings recap — pay attention]:\n"), s)
    short = F.concat("body", F.lit(RULE + "## Agent Summary\n\n"), s)
    return merged.select("query_id", F.when(s.isNull(), F.col("body")).when(F.col("n") > 2, framed)
                         .otherwise(short).alias("context"))


def source_list(raw: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (doc_id, pages) per query in first-seen order; unnamed documents show 8 id characters."""
    first = raw.groupBy("query_id", "doc_id", "pages").agg(F.min("seq").alias("seq"))
    doc = F.col("doc_id").cast("string")
    return first.join(names, "doc_id", "left").select(
        "query_id", "seq", "doc_id", "pages",
        F.coalesce("doc_name", F.substring(doc, 1, 8)).alias("doc_name"), F.lit("").alias("section"))


def doc_catalog_lines(picked: DataFrame, meta: DataFrame) -> DataFrame:
    """Per query one line per chosen document, in id order."""
    line = F.concat(F.lit("- "), "doc_id", F.lit(": "), F.coalesce("doc_name", F.lit("Unknown")), F.lit(" ("),
                    "page_count", F.lit(" pages) - "), F.coalesce("doc_description", F.lit("")))
    lines = picked.select("query_id", "doc_id").distinct().join(meta, "doc_id")
    return lines.groupBy("query_id").agg(joined("\n", line, "doc_id").alias("catalog"))


def tool_output_context(outputs: DataFrame, limit: int = 6000, shortest: int = 50) -> DataFrame:
    """Outputs (query_id, seq, content) longer than ``shortest``, cut and joined by a rule."""
    kept = outputs.filter(F.length("content") > shortest)
    return kept.groupBy("query_id").agg(
        joined(RULE, F.substring("content", 1, limit), "seq").alias("context"))
