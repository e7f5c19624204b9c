"""Search-result queries."""

from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import html as H
from ..operators import serp as s
from . import sqlgen as q
from .inputs import SQL_VIEWS
from .registry import query
from . import web as _web  # noqa: F401  (its views are used here)

LEADS = ("", "Line Chart of ", "analyze data: ", "柱状图 趋势分析 ", "pie chart ", "散点图 compare ", "detailed ",
         "查一下上海2026年的房价 请问 的 ")
SQL_VIEWS["query_log"] = ("", f"SELECT conv_id, turn, {q.text_list(LEADS)}[(conv_id + turn) % 8 + 1] || text AS query FROM conversations")


def query_log(t):
    leads = F.array(*[F.lit(x) for x in LEADS])
    return t.conversations.select("conv_id", "turn", F.concat(
        F.element_at(leads, ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int")), "text").alias("query"))


_chart, _ana = q.contains_any("lower(query)", fixed.CHART_WORDS), q.contains_any("lower(query)", fixed.ANALYSIS_WORDS)
INTENT = f"CASE WHEN {_chart} AND {_ana} THEN 'analyze_and_chart' WHEN {_chart} THEN 'chart' WHEN {_ana} THEN 'analyze' ELSE 'search' END"


@query("detect_intent", f"""
    SELECT conv_id, turn, {INTENT} AS intent, CASE WHEN {q.contains_any('lower(query)', ('柱状图', 'bar chart'))} THEN 'bar'
      WHEN {q.contains_any('lower(query)', ('饼图', 'pie chart'))} THEN 'pie' WHEN {q.contains_any('lower(query)', ('散点图', 'scatter'))} THEN 'scatter'
      ELSE 'line' END AS chart_type, {q.contains_any('lower(query)', fixed.DETAIL_WORDS)} AS detailed FROM query_log""", "query_log")
def _(t):
    return query_log(t).select("conv_id", "turn", s.detect_intent("query").alias("intent"), s.chart_type("query").alias("chart_type"),
                               s.wants_detail("query").alias("detailed"))


@query("intent_counts", f"SELECT {INTENT} AS intent, count(*) AS n_queries FROM query_log GROUP BY 1", "query_log")
def _(t):
    return s.intent_counts(query_log(t), "query")


def _keywords_sql():
    e = q.strip("query")
    for f in s.FILLERS:
        e = f"replace({e}, '{f}', ' ')"
    return f"array_to_string(list_filter({q.words(e)}, lambda w: NOT list_contains({q.text_list(fixed.QUERY_STOP_WORDS)}, w)), ' ')"


KW = f"CASE WHEN length(kw) < 2 THEN {q.strip('query')} ELSE kw END"


@query("extract_keywords_zh", f"SELECT conv_id, turn, {KW} AS keywords FROM (SELECT *, {_keywords_sql()} AS kw FROM query_log)", "query_log")
def _(t):
    return query_log(t).select("conv_id", "turn", s.extract_keywords_zh("query").alias("keywords"))


@query("preprocess_query", f"""
    SELECT conv_id, turn, CASE WHEN length({q.strip('query')}) > 10 AND regexp_matches(query, '[一-鿿]')
      AND {q.contains_any('query', fixed.FILLER_WORDS)} THEN {KW} ELSE {q.strip('query')} END AS search_query
    FROM (SELECT *, {_keywords_sql()} AS kw FROM query_log)""", "query_log")
def _(t):
    return query_log(t).select("conv_id", "turn", s.preprocess_query("query").alias("search_query"))


SQL_VIEWS["variants"] = ("qs", f"""
    SELECT query_id, CAST(i - 1 AS INTEGER) AS variant, forms[i] AS query
    FROM (SELECT query_id, list_distinct_ordered[1:4] AS forms FROM (
            SELECT query_id, list_filter([query, replace(query, ' ', '')] || extra,
                     lambda x, i: list_position([query, replace(query, ' ', '')] || extra, x) = i) AS list_distinct_ordered
            FROM (SELECT query_id, query, list_filter(list_transform(['X ' || query, ' ab ', query, 'x' || query || ' '],
                    lambda x: {q.strip('x')}), lambda x: length(x) >= 4) AS extra FROM qs))),
         unnest(range(1, len(forms) + 1)) AS u(i)""")


def variants(t):
    extra = F.array(F.concat(F.lit("X "), "query"), F.lit(" ab "), F.col("query"), F.concat(F.lit("x"), "query", F.lit(" ")))
    return s.expand_query_variants(t.queries.withColumn("extra", extra), "extra")


@query("expand_query_variants", "SELECT * FROM variants", "variants")
def _(t):
    return variants(t)


SQL_VIEWS["serp_all"] = ("serp variants", """
    SELECT query_id, v.variant, engine, pos, title, url, snippet, CASE engine WHEN 'Bing' THEN 0 WHEN 'Baidu' THEN 1 ELSE 2 END AS engine_no
    FROM serp JOIN (SELECT query_id, variant FROM variants) v USING (query_id)""")


def serp_all(t):
    return t.serp.drop("variant").join(variants(t).select("query_id", "variant"), "query_id")


@query("merge_engines", "SELECT query_id, variant, engine_no, engine, pos, url FROM serp_all", "serp_all")
def _(t):
    merged = s.merge_engines(*[serp_all(t).filter(F.col("engine") == e) for e in fixed.ENGINES])
    return merged.select("query_id", "arrival.variant", "arrival.engine_no", "engine", "arrival.pos", "url")


@query("engine_counts", "SELECT engine, count(*) AS n_results FROM serp_all GROUP BY 1", "serp_all")
def _(t):
    return s.engine_counts(s.merge_engines(serp_all(t)))


SQL_VIEWS["serp_first"] = ("serp_all", """
    SELECT * FROM (SELECT *, split_part(rtrim(url, '/'), '?', 1) AS url_key FROM serp_all)
    QUALIFY row_number() OVER (PARTITION BY query_id, url_key ORDER BY variant, engine_no, pos) = 1""")
_blocked = (f"({q.contains_any('lower(url)', fixed.BLOCKED_URL_PATTERNS)} "
            f"OR {q.contains_any('lower(title)', fixed.BLOCKED_TITLE_PATTERNS)})")
SQL_VIEWS["serp_kept"] = ("serp_first", f"""
    SELECT * EXCLUDE (blocked, lost, rn) FROM (
      SELECT *, bool_and(blocked) OVER (PARTITION BY query_id) AS lost,
             row_number() OVER (PARTITION BY query_id ORDER BY variant, engine_no, pos) AS rn
      FROM (SELECT *, {_blocked} AS blocked FROM serp_first))
    WHERE NOT blocked OR (lost AND rn <= 10)""")
SCORE = """(list_sum(list_transform({w}, lambda w: CASE WHEN contains(lower(title), w) THEN 3.0::DOUBLE ELSE 0 END
    + CASE WHEN contains(lower(snippet), w) THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN contains(lower(url), w) THEN 2.0::DOUBLE ELSE 0 END))
    + CASE WHEN {a} THEN 5.0::DOUBLE ELSE 0 END)""".format(w=q.words("lower(query)"), a=q.contains_any("lower(title)", fixed.AUTHORITY_WORDS))
SQL_VIEWS["serp_top"] = ("serp_kept qs", f"""
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, variant, engine_no, pos) AS INTEGER) AS position,
           engine, pos, title, url, snippet, score
    FROM (SELECT serp_kept.*, {SCORE} AS score FROM serp_kept JOIN qs USING (query_id)) QUALIFY position <= 10""")


def unique(t):
    return s.dedup_url_key(s.merge_engines(serp_all(t)), ["query_id"], ["arrival"])


@query("filter_irrelevant", "SELECT query_id, engine, pos, url FROM serp_kept", "serp_kept")
def _(t):
    return s.filter_irrelevant(unique(t)).select("query_id", "engine", "pos", "url")


@query("score_result", f"SELECT query_id, engine, pos, {SCORE} AS score FROM serp_first JOIN qs USING (query_id)", "serp_first qs")
def _(t):
    return unique(t).join(t.queries, "query_id").select("query_id", "engine", "pos", s.score_result().alias("score"))


@query("federated_search", "SELECT * FROM serp_top", "serp_top")
def _(t):
    return s.federated_search(t.queries, serp_all(t))


@query("context_from_pages", """
    SELECT query_id, chr(10) || chr(10) || repeat('=', 80) || string_agg('[Source ' || position || ': ' || title || '](' || url || ')' || chr(10)
             || CASE WHEN length(content) > 30000 THEN left(content, 30000) || chr(10) || '...(content truncated)' ELSE content END || chr(10),
             chr(10) || chr(10) ORDER BY position) AS context
    FROM (SELECT s.query_id, s.position, s.title, s.url, x.content FROM serp_top s JOIN texts x ON x.page_id = s.pos) GROUP BY 1""", "serp_top texts")
def _(t):
    # Only pages that were found go to the cleaner, so its work follows the results and not the table.
    pages = t.pages.select(F.col("page_id").alias("pos"), "html")
    found = s.federated_search(t.queries, serp_all(t)).join(pages, "pos")
    return s.context_from_pages(found.select("query_id", "position", "title", "url", F.lit("").alias("markdown"),
                                             H.text_of(H.text_pieces(H.clean("html"))).alias("content")))


@query("no_result_flag", """
    SELECT conv_id, turn, lower(a) = '' OR contains(lower(a), 'couldn''t find relevant information') OR contains(lower(a), 'no relevant') AS no_result
    FROM (SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN '' WHEN 1 THEN text || ' No relevant data' ELSE text END AS a FROM conversations)""")
def _(t):
    k = (F.col("conv_id") + F.col("turn")) % 4
    a = F.when(k == 0, "").when(k == 1, F.concat("text", F.lit(" No relevant data"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", s.no_result_flag(a).alias("no_result"))
