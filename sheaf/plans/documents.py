"""Document, section, item and chunk queries."""

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import documents as d
from . import sqlgen as q
from .inputs import SQL_VIEWS
from .registry import query

SPECS = ("1-3", "2,4", " 5 ", "3-1", "x", "1 , 2-2 ,9999")
SQL_VIEWS["spec_parts"] = ("", f"""
    SELECT doc_id, spec, i, first, CASE WHEN contains(p, '-') THEN {q.strip("regexp_replace(p, '^[^-]*-', '')")} ELSE first END AS last
    FROM (SELECT doc_id, spec, i, {q.strip('parts[i]')} AS p, {q.strip("split_part(parts[i], '-', 1)")} AS first
          FROM (SELECT doc_id, spec, string_split(spec, ',') AS parts
                FROM (SELECT doc_id, {q.text_list(SPECS)}[doc_id % 6 + 1] AS spec FROM documents)),
               unnest(range(1, len(parts) + 1)) AS u(i))""")
SQL_VIEWS["specs"] = ("spec_parts", """
    SELECT doc_id, spec, CASE WHEN bad THEN 'not a number' WHEN rev THEN 'start after end' END AS error,
           CASE WHEN NOT bad AND NOT rev THEN pages END AS pages
    FROM (SELECT doc_id, spec, bool_or(NOT regexp_matches(first, '^[+-]?[0-9]+$') OR NOT regexp_matches(last, '^[+-]?[0-9]+$')) AS bad,
                 coalesce(bool_or(TRY_CAST(first AS INTEGER) > TRY_CAST(last AS INTEGER)), false) AS rev,
                 list_sort(list_distinct(flatten(list(range(TRY_CAST(first AS INTEGER), TRY_CAST(last AS INTEGER) + 1))))) AS pages
          FROM spec_parts GROUP BY 1, 2)""")


def requests(t):
    return t.documents.select("doc_id", F.element_at(F.array(*[F.lit(s) for s in SPECS]), (F.col("doc_id") % 6 + 1).cast("int")).alias("spec"))


@query("parse_page_spec", "SELECT doc_id, spec, array_to_string(pages, ',') AS pages, error FROM specs", "specs")
def _(t):
    p = d.parse_page_spec("spec")
    return requests(t).select("doc_id", "spec", F.array_join(p["pages"], ",").alias("pages"), p["error"].alias("error"))


@query("get_pages", """
    WITH req AS (SELECT * FROM specs UNION ALL SELECT doc_id + 1000000, spec, error, pages FROM specs),
    e AS (SELECT doc_id, spec, pages, CASE WHEN doc_id >= 1000000 THEN 'Document ' || doc_id || ' has no page content'
                 WHEN error IS NOT NULL THEN 'Invalid pages format: ' || error END AS error FROM req),
    w AS (SELECT doc_id, spec, error, CAST(unnest(pages) AS INTEGER) AS page FROM e WHERE error IS NULL
          UNION ALL SELECT doc_id, spec, error, NULL FROM e WHERE error IS NOT NULL)
    SELECT w.doc_id, spec, w.page, coalesce(content, CASE WHEN error IS NULL THEN '[Page ' || w.page || ' not found]' END) AS content, error
    FROM w LEFT JOIN doc_pages p ON p.doc_id = w.doc_id AND p.page = w.page""", "specs doc_pages")
def _(t):
    known = requests(t)
    unknown = known.withColumn("doc_id", F.col("doc_id") + 1000000)
    return d.get_pages(known.unionByName(unknown), t.doc_pages, t.documents)


@query("page_markers", f"""
    SELECT doc_id, page, marked, {q.tokens('marked')} AS tokens
    FROM (SELECT doc_id, page, '<physical_index_' || page || '>' || chr(10) || content || chr(10) || '<physical_index_' || page || '>'
                 || chr(10) || chr(10) AS marked FROM doc_pages)""", "doc_pages")
def _(t):
    return d.page_markers(t.doc_pages)


@query("combine_page_text", f"""
    SELECT doc_id, string_agg(CASE WHEN content <> '' THEN chr(10) || '--- Page ' || page || ' ---' || chr(10) || content || chr(10) ELSE '' END,
                              '' ORDER BY page) AS raw_text,
           CAST(sum(length(content)) AS BIGINT) AS raw_char_count, count(*) AS total_pages,
           count(*) FILTER (length({q.strip('content')}) > 0) AS pages_with_content
    FROM doc_pages GROUP BY 1""", "doc_pages")
def _(t):
    return d.combine_page_text(t.doc_pages)


@query("page_results", f"""
    SELECT doc_id, page, CAST(length(content) AS INTEGER) AS char_count, length({q.strip('content')}) > 0 AS has_content FROM doc_pages""", "doc_pages")
def _(t):
    return d.page_results(t.doc_pages)


# --- sections ------------------------------------------------------------------------------------

def rough_outline(t):
    """Outline whose levels jump, so that clamping shows."""
    return t.outline.withColumn("level", F.col("level") + F.col("page") % 4)


def _numbered_sql(source):
    counts = ", ".join(f"sum(CAST(level = {x} AS INTEGER)) OVER w AS n{x}" for x in range(1, 7))
    bases = ", ".join(f"max(CASE WHEN level < {x} THEN n{x} END) OVER w AS b{x}" for x in range(1, 7))
    parts = ", ".join(f"CASE WHEN level >= {x} THEN CAST(CAST(n{x} - coalesce(b{x}, 0) AS INTEGER) AS VARCHAR) END" for x in range(1, 7))
    frame = "WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
    title = q.strip("title")
    return f"""SELECT doc_id, seq, level, concat_ws('.', {parts}) AS structure,
           CASE WHEN {title} = '' THEN 'Section ' || page ELSE {title} END AS title, greatest(1, page) AS page_from
    FROM (SELECT *, {bases} FROM (SELECT *, {counts} FROM (
            SELECT doc_id, seq, title, page, CAST(seq + least(0, min(least(raw, 6) - seq) OVER w) AS INTEGER) AS level
            FROM (SELECT doc_id, seq, title, page, {source} AS raw FROM outline) {frame}) {frame}) {frame})"""


SQL_VIEWS["rough_numbered"] = ("outline", _numbered_sql("level + page % 4"))
# A row's end is its next sibling's start less one, or else its parent's end.
SQL_VIEWS["parented"] = ("rough_numbered", """
    SELECT r.*, (CASE r.level """ + " ".join(
    f"WHEN {x} THEN max(CASE WHEN level = {x - 1} THEN seq END) OVER w" for x in range(2, 7)) + """ END) AS parent_seq
    FROM rough_numbered r WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
SQL_VIEWS["own_end"] = ("parented", """
    SELECT *, CASE WHEN nxt IS NULL THEN NULL ELSE greatest(page_from, nxt - 1) END AS own
    FROM (SELECT *, lead(page_from) OVER (PARTITION BY doc_id, parent_seq ORDER BY seq) AS nxt FROM parented)""")
_joins, _coal = "", "a1.own"
for _i in range(2, 7):
    _joins += f" LEFT JOIN own_end a{_i} ON a{_i}.doc_id = a1.doc_id AND a{_i}.seq = a{_i - 1}.parent_seq"
    _coal += f", a{_i}.own"
SQL_VIEWS["sections"] = ("own_end", f"""
    SELECT a1.doc_id, a1.seq, a1.level, a1.structure, a1.title, a1.page_from, coalesce({_coal}, n.page_count) AS page_to
    FROM own_end a1 {_joins} JOIN (SELECT doc_id, max(page_from) AS page_count FROM rough_numbered GROUP BY 1) n ON n.doc_id = a1.doc_id""")


def sections(t):
    pages = t.documents_meta.select("doc_id", "page_count")
    return d.section_page_ranges(d.number_sections(rough_outline(t)), pages)


@query("number_sections", "SELECT * FROM rough_numbered", "rough_numbered")
def _(t):
    return d.number_sections(rough_outline(t))


@query("section_page_ranges", "SELECT * FROM sections", "sections")
def _(t):
    return sections(t)


@query("page_section_map", """
    SELECT doc_id, CAST(page AS INTEGER) AS page, arg_max(title, seq) AS section
    FROM sections, unnest(range(page_from, page_to + 1)) AS u(page) WHERE title <> '' GROUP BY 1, 2""", "sections")
def _(t):
    return d.page_section_map(sections(t))


@query("outline_listing", """
    SELECT doc_id, seq, structure, title, page_from, page_to,
           repeat('  ', level - 1) || structure || ' ' || title || ' (p. ' || page_from || '-' || page_to || ')' AS line FROM sections""", "sections")
def _(t):
    return d.outline_listing(sections(t))


# --- items ---------------------------------------------------------------------------------------

def _render(p=""):
    return f"""(CASE WHEN {p}type = 'text' AND {p}text_level > 0 THEN repeat('#', {p}text_level) || ' ' || {p}text WHEN {p}type = 'text' THEN {p}text
        WHEN {p}type = 'image' AND len({p}captions) > 0 THEN '[Image: ' || array_to_string({p}captions, ', ') || ']'
        WHEN {p}type = 'table' AND len({p}captions) > 0 THEN '[Table: ' || array_to_string({p}captions, ', ') || ']' ELSE '' END)"""


def modal(t):
    return t.items.filter("type <> 'text'")


@query("page_window_context", f"""
    SELECT doc_id, idx, {q.cut_at_sentence('c', 2000)} AS context FROM (
      SELECT a.doc_id, a.idx, coalesce(string_agg(CASE WHEN b.page_idx <> a.page_idx THEN '[Page ' || b.page_idx || '] ' ELSE '' END || b.r,
                                                  chr(10) ORDER BY b.idx), '') AS c
      FROM items a LEFT JOIN (SELECT *, {_render()} AS r FROM items WHERE type = 'text' AND length({q.strip(_render())}) > 0) b
        ON b.doc_id = a.doc_id AND b.page_idx BETWEEN a.page_idx - 1 AND a.page_idx + 1
      WHERE a.type <> 'text' GROUP BY 1, 2)""", "items")
def _(t):
    return d.page_window_context(t.items, modal(t), 1)


@query("chunk_window_context", f"""
    SELECT doc_id, idx, {q.cut_at_sentence('c', 2000)} AS context FROM (
      SELECT a.doc_id, a.idx, coalesce(string_agg(b.r, chr(10) ORDER BY b.idx), '') AS c
      FROM items a LEFT JOIN (SELECT *, {_render()} AS r FROM items WHERE type IN ('text', 'image', 'table') AND length({q.strip(_render())}) > 0) b
        ON b.doc_id = a.doc_id AND b.idx BETWEEN a.idx - 2 AND a.idx + 2 AND b.idx <> a.idx
      WHERE a.type <> 'text' GROUP BY 1, 2)""", "items")
def _(t):
    return d.chunk_window_context(t.items, modal(t), 2, ("text", "image", "table"))


@query("render_item", f"SELECT doc_id, idx, {_render()} AS rendered FROM items", "items")
def _(t):
    return t.items.select("doc_id", "idx", d.render_item().alias("rendered"))


@query("truncate_at_sentence", f"SELECT doc_id, {q.cut_at_sentence('text', 2000)} AS cut FROM documents")
def _(t):
    return t.documents.select("doc_id", d.cut_at_sentence("text", 2000).alias("cut"))


@query("table_to_markdown", f"""
    SELECT doc_id, '| ' || array_to_string(body[1], ' | ') || ' |' || chr(10) || '| '
           || array_to_string(list_transform(range(list_max(list_transform(body, lambda r: len(r)))), lambda i: '---'), ' | ') || ' |'
           || CASE WHEN len(body) > 1 THEN chr(10) || array_to_string(list_transform(body[2:],
                lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) ELSE '' END AS markdown
    FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: {q.words('l')}) AS body FROM documents)""")
def _(t):
    body = F.transform(F.split("text", "\n"), words)
    return t.documents.select("doc_id", body.alias("body"), "text").select(
        "doc_id", d.table_to_markdown("body", "text").alias("markdown"))


@query("normalize_captions", f"""
    SELECT doc_id, idx, array_to_string(list_filter(list_transform(coalesce(captions, []), lambda x: {q.strip('x')}), lambda x: x <> ''), '|') AS captions,
           CASE WHEN {q.strip('text')} <> '' THEN {q.strip('text')} WHEN type = 'equation' THEN 'x' ELSE 'y' END AS equation,
           CASE WHEN {q.strip('text')} = '' AND type = 'equation' THEN 'latex' ELSE '' END AS format
    FROM items""", "items")
def _(t):
    eq = d.equation_text(F.col("text"), F.when(F.col("type") == "equation", F.lit("x")), F.lit("y"), F.lit(None).cast("string"))
    return t.items.select("doc_id", "idx", F.array_join(d.normalize_captions("captions"), "|").alias("captions"),
                          eq["text"].alias("equation"), eq["format"].alias("format"))


@query("equation_text", f"""
    SELECT doc_id, idx, CASE WHEN {q.strip('text')} <> '' AND page_idx % 2 = 0 THEN {q.strip('text')} WHEN type = 'equation' THEN 'l' || idx ELSE 'e' END AS text,
           CASE WHEN {q.strip('text')} <> '' AND page_idx % 2 = 0 THEN '' WHEN type = 'equation' THEN 'latex' ELSE '' END AS format FROM items""", "items")
def _(t):
    text = F.when(F.col("page_idx") % 2 == 0, F.col("text"))
    latex = F.when(F.col("type") == "equation", F.concat(F.lit("l"), "idx"))
    eq = d.equation_text(text, latex, F.lit(" e "), F.lit(""))
    return t.items.select("doc_id", "idx", eq["text"].alias("text"), eq["format"].alias("format"))


@query("content_ids", """
    SELECT doc_id, idx, 'md-' || md5(text) AS content_id,
           CASE type WHEN 'image' THEN 'image_fig' || idx WHEN 'table' THEN 'table_entity' ELSE type || '_' || left(md5(text), 8) END AS entity_name
    FROM items""", "items")
def _(t):
    path = F.when(F.col("type") == "image", F.concat(F.lit("/img/fig"), "idx", F.lit(".png"))).otherwise("")
    return t.items.select("doc_id", "idx", d.content_id("text").alias("content_id"),
                          d.entity_name(F.col("type"), F.col("text"), path).alias("entity_name"))


@query("modal_chunk_text", f"""
    SELECT doc_id, idx, CASE type
      WHEN 'image' THEN chr(10) || 'Image Content Analysis:' || chr(10) || '- Section Path: s' || page_idx || chr(10) || '- Neighbor Text: n' || chr(10)
        || 'Image Path: /img/' || idx || chr(10) || 'Captions: ' || c || chr(10) || 'Footnotes: None' || chr(10) || chr(10) || 'Visual Analysis: ' || text
      WHEN 'table' THEN 'Table Analysis:' || chr(10) || 'Image Path: /img/' || idx || chr(10) || 'Caption: ' || c || chr(10) || 'Structure: ' || text
        || chr(10) || 'Footnotes: None' || chr(10) || chr(10) || 'Analysis: ' || text
      WHEN 'equation' THEN 'Mathematical Equation Analysis:' || chr(10) || 'Equation: ' || text || chr(10) || 'Format: latex' || chr(10) || chr(10)
        || 'Mathematical Analysis: ' || text
      ELSE type || ' Content Analysis:' || chr(10) || 'Content: ' || text || chr(10) || chr(10) || 'Analysis: ' || text END AS chunk
    FROM (SELECT *, coalesce(nullif(array_to_string(captions, ', '), ''), 'None') AS c FROM items)""", "items")
def _(t):
    chunk = d.modal_chunk_text(F.col("type"), F.concat(F.lit("s"), "page_idx"), F.lit("n"), F.concat(F.lit("/img/"), "idx"),
                               F.col("captions"), F.lit(None).cast("array<string>"), F.col("text"), F.lit("latex"), F.col("text"))
    return t.items.select("doc_id", "idx", chunk.alias("chunk"))


@query("route_by_type", """
    SELECT doc_id, idx, CASE WHEN type IN ('image', 'table', 'equation') THEN type ELSE 'generic' END AS route FROM items""", "items")
def _(t):
    return t.items.select("doc_id", "idx", d.route_by_type("type").alias("route"))


@query("split_text_multimodal", f"""
    SELECT doc_id, text, n_multimodal, length({q.strip('text')}) > 0 AS has_text FROM (
      SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY idx) FILTER (type = 'text' AND length({q.strip('text')}) > 0), '') AS text,
             count(*) FILTER (type <> 'text') AS n_multimodal FROM items GROUP BY 1)""", "items")
def _(t):
    return d.split_text_multimodal(t.items)


@query("context_from_record", f"""
    SELECT doc_id, {q.cut_at_sentence('c', 2000)} AS context
    FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text ELSE source || chr(10) || text END AS c FROM documents)""")
def _(t):
    record = (F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("content"), "text", F.lit("text"), "lang"))
              .when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("text"), "text", F.lit("z"), "lang"))
              .otherwise(F.create_map(F.lit("a"), "source", F.lit("b"), "text")))
    return t.documents.select("doc_id", record.alias("r")).select("doc_id", d.context_from_record(F.col("r")).alias("context"))


# --- chunks --------------------------------------------------------------------------------------

@query("chunk_documents", f"""
    SELECT 'chunk_' || doc_id || '_' || k AS chunk_id, doc_id, CAST(k AS INTEGER) AS chunk_order,
           array_to_string(w[k * 1100 + 1 : k * 1100 + 1200], ' ') AS content
    FROM (SELECT doc_id, {q.words('text')} AS w FROM documents), unnest(range(0, CAST(ceil(len(w) / 1100.0) AS BIGINT))) AS u(k)""")
def _(t):
    return d.chunk_documents(t.documents)


@query("doc_status", f"""
    SELECT doc_id, 'completed' AS status, left(text, 100) AS content_summary, CAST(length(text) AS INTEGER) AS content_length,
           CAST(ceil(len({q.words('text')}) / 1100.0) AS INTEGER) AS chunks_count FROM documents""")
def _(t):
    return d.doc_status(t.documents)


@query("pack_paragraphs", """RECURSIVE WITH pack(doc_id, i, part, used, text) AS (
      SELECT doc_id, page, 0, CAST(length(content) AS BIGINT), content FROM doc_pages WHERE page = 1
      UNION ALL
      SELECT p.doc_id, d.page, CASE WHEN p.used + length(d.content) < 4000 THEN p.part ELSE p.part + 1 END,
             CASE WHEN p.used + length(d.content) < 4000 THEN p.used + length(d.content) ELSE length(d.content) END, d.content
      FROM pack p JOIN doc_pages d ON d.doc_id = p.doc_id AND d.page = p.i + 1)
    SELECT doc_id, part, string_agg(text, chr(10) ORDER BY i) AS content FROM pack GROUP BY 1, 2""", "doc_pages")
def _(t):
    return d.pack_paragraphs(t.documents, sep="\n")


@query("split_fixed", """
    SELECT doc_id, CAST(k AS INTEGER) AS part, substring(text, CAST(k * 3500 + 1 AS BIGINT), 3500) AS content
    FROM documents, unnest(range(0, CAST(ceil(length(text) / 3500.0) AS BIGINT))) AS u(k)""")
def _(t):
    return d.split_fixed(t.documents)
