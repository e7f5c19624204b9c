"""Pages, sections, content items and chunks of documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.skew import running
from ..functions.text import col, cut_at_sentence, joined, not_blank, strip, token_count, words
from ..session import cut_lineage

LEVELS = range(1, 7)


# --- pages ---------------------------------------------------------------------------------------

def parse_page_spec(spec: Column | str) -> Column:
    """'5-7,3' -> struct(pages array, error); any bad part makes the whole spec an error."""
    def part(p: Column) -> Column:
        p = strip(p)
        first = strip(F.substring_index(p, "-", 1))
        last = F.when(p.contains("-"), strip(F.regexp_replace(p, "^[^-]*-", ""))).otherwise(first)
        number = "^[+-]?[0-9]+$"
        a = F.when(first.rlike(number), first.try_cast("int"))
        b = F.when(last.rlike(number), last.try_cast("int"))
        return F.struct(a.alias("a"), b.alias("b"))

    parts = F.transform(F.split(col(spec), ","), part)
    bad = F.exists(parts, lambda x: x["a"].isNull() | x["b"].isNull())
    reversed_ = F.exists(parts, lambda x: x["a"] > x["b"])
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda x: F.sequence(x["a"], x["b"])))))
    error = F.when(bad, "not a number").when(reversed_, "start after end")
    return F.struct(F.when(error.isNull(), pages).alias("pages"), error.alias("error"))


def get_pages(requests: DataFrame, pages: DataFrame, known: DataFrame) -> DataFrame:
    """Requested pages (doc_id, spec): content, a placeholder for missing pages, an error row per bad request."""
    parsed = requests.join(known.select("doc_id", F.lit(True).alias("_known")), "doc_id", "left").withColumn(
        "_p", parse_page_spec("spec")).withColumn("error", F.when(
            F.col("_known").isNull(), F.concat(F.lit("Document "), "doc_id", F.lit(" has no page content"))).when(
            F.col("_p.error").isNotNull(), F.concat(F.lit("Invalid pages format: "), F.col("_p.error"))))
    wanted = parsed.select("doc_id", "spec", "error", F.explode_outer(
        F.when(F.col("error").isNull(), F.col("_p.pages"))).alias("page"))
    found = wanted.join(pages.select("doc_id", "page", "content"), ["doc_id", "page"], "left")
    missing = F.when(F.col("error").isNull(), F.concat(F.lit("[Page "), "page", F.lit(" not found]")))
    return found.select("doc_id", "spec", "page", F.coalesce("content", missing).alias("content"), "error")


def page_markers(pages: DataFrame) -> DataFrame:
    tag = F.concat(F.lit("<physical_index_"), "page", F.lit(">\n"))
    marked = F.concat(tag, "content", F.lit("\n"), tag, F.lit("\n"))
    return pages.select("doc_id", "page", marked.alias("marked")).withColumn("tokens", token_count("marked"))


def combine_page_text(pages: DataFrame) -> DataFrame:
    """Per document: non-empty pages under page rules, raw length, pages and pages with content."""
    block = F.when(F.col("content") != "", F.concat(F.lit("\n--- Page "), "page", F.lit(" ---\n"), "content", F.lit("\n")))
    return pages.groupBy("doc_id").agg(
        joined("", block, "page").alias("raw_text"), F.sum(F.length("content")).alias("raw_char_count"),
        F.count(F.lit(1)).alias("total_pages"), F.count_if(not_blank("content")).alias("pages_with_content"))


def page_results(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.length("content").alias("char_count"), not_blank("content").alias("has_content"))


# --- sections ------------------------------------------------------------------------------------

def number_sections(outline: DataFrame, block: int = 65_536) -> DataFrame:
    """Hierarchical numbers for outline rows (doc_id, seq from 1, level, title, page).

    A level may exceed its predecessor by one at most. That left fold equals ``seq + min(0, running
    min(level - seq))``, and a counter at depth d is the running count of level-d rows minus its value at the
    last shallower row - running aggregates, so documents of any size split into blocks. A pass reads its
    input twice; passes are checkpointed so that this does not multiply.
    """
    raw = F.least("level", F.lit(6))
    clamped = cut_lineage(running(outline, ["doc_id"], "seq", {"_m": ("min", raw - F.col("seq"))}, block=block).withColumn(
        "level", (F.col("seq") + F.least(F.lit(0), "_m")).cast("int")).drop("_m"))
    counted = cut_lineage(running(clamped, ["doc_id"], "seq", {
        f"_n{d}": ("sum", (F.col("level") == d).cast("int")) for d in LEVELS}, block=block))
    based = running(counted, ["doc_id"], "seq", {
        f"_b{d}": ("max", F.when(F.col("level") < d, F.col(f"_n{d}"))) for d in LEVELS}, block=block)
    numbers = [F.when(F.col("level") >= d, (F.col(f"_n{d}") - F.coalesce(f"_b{d}", F.lit(0))).cast("string"))
               for d in LEVELS]
    title = F.when(strip("title") == "", F.concat(F.lit("Section "), "page")).otherwise(strip("title"))
    return based.select("doc_id", "seq", "level", F.concat_ws(".", *numbers).alias("structure"),
                        title.alias("title"), F.greatest(F.lit(1), "page").alias("page_from"))


def section_page_ranges(sections: DataFrame, page_counts: DataFrame, block: int = 65_536) -> DataFrame:
    """Adds ``page_to``: up to the next sibling, else the parent's end, else the last page.

    The next row of depth d after a row is also the next after its depth-d ancestor, so one backward and one
    forward running pass find every ancestor's next sibling.
    """
    at = F.struct(F.col("seq").alias("s"), F.col("page_from").alias("p"))
    ahead = cut_lineage(running(cut_lineage(sections), ["doc_id"], "seq", {
        f"_x{d}": ("min", F.when(F.col("level") == d, at)) for d in LEVELS}, block=block, descending=True, exclusive=True))
    both = running(ahead, ["doc_id"], "seq", {
        f"_a{d}": ("max", F.when(F.col("level") == d, at)) for d in LEVELS}, block=block)
    end = F.col("page_count")
    nearest = F.lit(None).cast(sections.schema["seq"].dataType)
    for d in LEVELS:
        sibling = F.col(f"_x{d}")
        has = (F.col("level") >= d) & sibling["s"].isNotNull() & (nearest.isNull() | (sibling["s"] < nearest))
        end = F.when(has, F.greatest(F.col(f"_a{d}")["p"], sibling["p"] - 1)).otherwise(end)
        nearest = F.least(nearest, sibling["s"])
    return both.join(page_counts, "doc_id").select(*sections.columns, end.alias("page_to"))


def page_section_map(sections: DataFrame) -> DataFrame:
    """Title shown for each page: the last section in reading order that covers it."""
    spans = sections.filter((F.col("title") != "") & (F.col("page_from") <= F.col("page_to")))
    return spans.select("doc_id", "seq", "title", F.explode(F.sequence("page_from", "page_to")).alias("page")) \
        .groupBy("doc_id", "page").agg(F.max_by("title", "seq").alias("section"))


def outline_listing(sections: DataFrame) -> DataFrame:
    """One listing line per section, indented by level, without section text."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "structure", F.lit(" "), "title", F.lit(" (p. "),
                    "page_from", F.lit("-"), "page_to", F.lit(")"))
    return sections.select("doc_id", "seq", "structure", "title", "page_from", "page_to", line.alias("line"))


# --- items ---------------------------------------------------------------------------------------

def render_item(kind: Column | str = "type", text: Column | str = "text", level: Column | str = "text_level",
                captions: Column | str = "captions") -> Column:
    kind, text, level, captions = col(kind), col(text), col(level), col(captions)
    listed = F.array_join(captions, ", ")
    some = F.coalesce(F.size(captions), F.lit(0)) > 0
    return (F.when((kind == "text") & (level > 0), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
            .when(kind == "text", text)
            .when((kind == "image") & some, F.concat(F.lit("[Image: "), listed, F.lit("]")))
            .when((kind == "table") & some, F.concat(F.lit("[Table: "), listed, F.lit("]")))
            .otherwise(""))


def page_window_context(items: DataFrame, current: DataFrame, window: int = 1, types: tuple[str, ...] = ("text",),
                        limit: int = 2000) -> DataFrame:
    """Text around each current item (doc_id, idx, page_idx): items of nearby pages, others' pages marked.

    The page window is unrolled into page keys, so the lookup is an equi-join.
    """
    spots = current.select("doc_id", "idx", "page_idx", F.explode(
        F.array(*[F.lit(o) for o in range(-window, window + 1)])).alias("_o")).select(
        "doc_id", "idx", "page_idx", (F.col("page_idx") + F.col("_o")).alias("_page"))
    near = items.filter(F.col("type").isin(*types)).select(
        "doc_id", F.col("page_idx").alias("_page"), F.col("idx").alias("_at"), render_item().alias("_text")).filter(not_blank("_text"))
    line = F.when(F.col("_page") != F.col("page_idx"), F.concat(F.lit("[Page "), "_page", F.lit("] "), "_text")).otherwise(F.col("_text"))
    found = spots.join(near, ["doc_id", "_page"]).groupBy("doc_id", "idx").agg(joined("\n", line, "_at").alias("_c"))
    return _with_context(current, found, limit)


def chunk_window_context(items: DataFrame, current: DataFrame, window: int = 1, types: tuple[str, ...] = ("text",),
                         limit: int = 2000) -> DataFrame:
    """Text of the ``window`` items before and after each current item, the item itself left out."""
    offsets = [o for o in range(-window, window + 1) if o]
    spots = current.select("doc_id", "idx", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_o")).select(
        "doc_id", "idx", (F.col("idx") + F.col("_o")).alias("_at"))
    near = items.filter(F.col("type").isin(*types)).select(
        "doc_id", F.col("idx").alias("_at"), render_item().alias("_text")).filter(not_blank("_text"))
    found = spots.join(near, ["doc_id", "_at"]).groupBy("doc_id", "idx").agg(joined("\n", "_text", "_at").alias("_c"))
    return _with_context(current, found, limit)


def _with_context(current: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    return current.select("doc_id", "idx").join(found, ["doc_id", "idx"], "left").select(
        "doc_id", "idx", cut_at_sentence(F.coalesce("_c", F.lit("")), limit).alias("context"))


def table_to_markdown(body: Column | str, fallback: Column | str) -> Column:
    """Rows of cells as a Markdown table; the fallback text without rows."""
    body = col(body)
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    width = F.array_max(F.transform(body, F.size))
    rule = row(F.array_repeat(F.lit("---"), width))
    lines = F.concat(F.transform(F.slice(body, 1, 1), row), F.array(rule),
                     F.transform(F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0))), row))
    return F.when(body.isNull(), F.coalesce(col(fallback), F.lit(""))).when(F.size(body) == 0, "").otherwise(
        F.array_join(lines, "\n"))


def normalize_captions(captions: Column | str) -> Column:
    """List of captions trimmed, blanks dropped; null becomes an empty list."""
    return F.filter(F.transform(F.coalesce(col(captions), F.array().cast("array<string>")), strip), lambda x: x != "")


def equation_text(text: Column, latex: Column, equation: Column, text_format: Column) -> Column:
    value = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    shown = F.coalesce(value(text), value(latex), value(equation), F.lit(""))
    kind = F.when(value(text).isNull() & value(latex).isNotNull(), F.coalesce(value(text_format), F.lit("latex"))) \
        .otherwise(F.coalesce(value(text_format), F.lit("")))
    return F.struct(shown.alias("text"), kind.alias("format"))


def content_id(content: Column | str, prefix: str = "md-") -> Column:
    return F.concat(F.lit(prefix), F.md5(col(content)))


def entity_name(kind: Column, content: Column, image_path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(image_path, "([^/]*)$", 1), "(?<=.)\\.[^.]*$", "")
    pictured = kind.isin("image", "table")
    return (F.when(pictured & (F.coalesce(image_path, F.lit("")) == ""), F.concat(kind, F.lit("_entity")))
            .when(pictured, F.concat(kind, F.lit("_"), stem))
            .otherwise(F.concat(kind, F.lit("_"), F.substring(F.md5(content), 1, 8))))


def route_by_type(kind: Column | str) -> Column:
    return F.when(col(kind).isin("image", "table", "equation"), col(kind)).otherwise("generic")


def modal_chunk_text(kind: Column, section: Column, neighbor: Column, image_path: Column, captions: Column,
                     footnotes: Column, body: Column, fmt: Column, description: Column) -> Column:
    """Chunk text of a modal item with its description filled into the template of its kind."""
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("None"))
    return (F.when(kind == "image", F.format_string(fixed.IMAGE_CHUNK, section, neighbor, image_path, listed(captions), listed(footnotes), description))
            .when(kind == "table", F.format_string(fixed.TABLE_CHUNK, image_path, listed(captions), body, listed(footnotes), description))
            .when(kind == "equation", F.format_string(fixed.EQUATION_CHUNK, body, fmt, description))
            .otherwise(F.format_string(fixed.GENERIC_CHUNK, kind, body, description)))


def split_text_multimodal(items: DataFrame) -> DataFrame:
    """Per document the joined text, the number of other items, and whether there is any text."""
    text = F.when((F.col("type") == "text") & not_blank("text"), F.col("text"))
    return items.groupBy("doc_id").agg(
        joined("\n\n", text, "idx").alias("text"), F.count_if(F.col("type") != "text").alias("n_multimodal")) \
        .withColumn("has_text", not_blank("text"))


def context_from_record(record: Column, limit: int = 2000) -> Column:
    """``content``, else ``text``, else all values of a string map; cut at a sentence."""
    return cut_at_sentence(F.coalesce(record["content"], record["text"], F.array_join(F.map_values(record), "\n")), limit)


# --- chunks --------------------------------------------------------------------------------------

def chunk_documents(documents: DataFrame, size: int = 1200, overlap: int = 100) -> DataFrame:
    """Overlapping word chunks (chunk_id, doc_id, chunk_order, content), one narrow pass over the texts."""
    split = documents.select("doc_id", words("text").alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size - overlap))
    # Strings are cut before rows are made: no row carries the whole document. The outer form keeps Spark from adding a filter
    # below that would cut them twice; there is a start for every text with words.
    cut = F.transform(starts, lambda at: F.array_join(F.slice("_w", at + 1, F.lit(size)), " "))
    placed = split.select("doc_id", F.posexplode_outer(cut).alias("chunk_order", "content"))
    return placed.select(F.concat_ws("_", F.lit("chunk"), "doc_id", "chunk_order").alias("chunk_id"), "doc_id", "chunk_order", "content")


def doc_status(documents: DataFrame, size: int = 1200, overlap: int = 100) -> DataFrame:
    n = F.size(words("text"))
    return documents.select(
        "doc_id", F.lit("completed").alias("status"), F.substring("text", 1, 100).alias("content_summary"),
        F.length("text").alias("content_length"),
        F.ceil(n / F.lit(size - overlap)).cast("int").alias("chunks_count"))


def pack_paragraphs(documents: DataFrame, limit: int = 4000, sep: str = "\n\n") -> DataFrame:
    """Greedy packing of paragraphs while their summed length stays under ``limit``: (doc_id, part, content).

    Where a part ends depends on where the one before ended, so a text is walked once, in its own task and linear in its length.
    Null texts have no part, an empty text has one.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def packed(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                parts = list(_packs(text.as_py().split(sep), limit, sep)) if text.is_valid else []
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id.as_py()] * len(parts), batch.schema.field("doc_id").type), pa.array(range(len(parts)), pa.int32()),
                         pa.array(parts, pa.string())], ["doc_id", "part", "content"])

    return documents.select("doc_id", "text").mapInArrow(packed, f"doc_id {kind}, part int, content string")


def _packs(paragraphs, limit: int, sep: str):
    held, used = [], 0
    for p in paragraphs:
        if used + len(p) >= limit and held:
            yield sep.join(held)
            held, used = [], 0
        held.append(p)
        used += len(p)
    if held:
        yield sep.join(held)


def split_fixed(documents: DataFrame, limit: int = 3500) -> DataFrame:
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(1), F.length("text"), F.lit(limit)))
    cut = F.transform(starts, lambda at: F.substring(F.col("text"), at, F.lit(limit)))
    return documents.select("doc_id", F.posexplode_outer(cut).alias("part", "content")).filter("part is not null")
