"""Conversation queries.

Stored conversations have few turns, so chunk operators run with two messages per chunk.
"""

from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import token_count
from ..operators import conversations as c
from . import sqlgen as q
from .inputs import SQL_VIEWS
from .registry import query
from .retrieval import candidates

P = 2  # messages per chunk
MODELS = ("gpt-4o", "gpt-4o-2024-05-13", "gpt-4-32k-x", "nope", "qwen-max-1", "claude-3-opus", "gemini-2.5-pro-exp", "gpt-4")


@query("count_tokens", f"SELECT conv_id, turn, {q.tokens('text')} AS tokens FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", token_count("text").alias("tokens"))


@query("message_tokens", f"""
    SELECT conv_id, CAST(3 + sum(4 + CASE WHEN role = 'system' THEN list_sum(list_transform(string_split(text, chr(10)), lambda x: {q.tokens('x')}))
        ELSE {q.tokens('text')} END + CASE WHEN role = 'assistant' THEN {q.tokens("'search'")} + {q.tokens(q.first_sentence('text'))} ELSE 0 END) AS BIGINT) AS tokens
    FROM conversations GROUP BY 1""")
def _(t):
    from ..functions.text import first_sentence
    call = F.array(F.struct(F.lit("search").alias("name"), first_sentence("text").alias("arguments")))
    m = t.conversations.withColumn("parts", F.when(F.col("role") == "system", F.split("text", "\n"))).withColumn(
        "tool_calls", F.when(F.col("role") == "assistant", call))
    return c.message_tokens(m)


def _size_sql(first):
    table = fixed.MODEL_CONTEXT_SIZES if first else sorted(fixed.MODEL_CONTEXT_SIZES, key=lambda r: -len(r[0]))
    exact = " ".join(f"WHEN model = '{n}' THEN {s}" for n, s in fixed.MODEL_CONTEXT_SIZES)
    return f"CASE {exact} " + " ".join(f"WHEN starts_with(model, '{n}') THEN {s}" for n, s in table) + f" ELSE {fixed.DEFAULT_CONTEXT_SIZE} END"


@query("model_context_size", f"""
    SELECT event_id, model, CAST({_size_sql(False)} AS INTEGER) AS size, CAST({_size_sql(True)} AS INTEGER) AS first_prefix_size
    FROM (SELECT event_id, {q.text_list(MODELS)}[event_id % 8 + 1] AS model FROM events)""")
def _(t):
    named = t.events.select("event_id", F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("event_id") % 8 + 1).cast("int")).alias("model"))
    return named.select("event_id", "model", c.model_context_size("model").alias("size"),
                        c.model_context_size("model", True).alias("first_prefix_size"))


SQL_VIEWS["costed"] = ("", f"SELECT *, {q.tokens('text')} AS tok, {q.cost('text')} AS cost, turn = 0 AND role = 'system' AS lead FROM conversations")


@query("trim_messages", """
    SELECT conv_id, turn, role, text FROM (
      SELECT *, sum(CASE WHEN lead THEN 0 ELSE cost END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used,
             3 + sum(4 + tok) OVER (PARTITION BY conv_id) AS total, sum(CASE WHEN lead THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM costed)
    WHERE lead OR total <= 500 OR used <= 500 - sys""", "costed")
def _(t):
    budgets = t.conversations.select("conv_id").distinct().withColumn("budget", c.context_budget(F.lit(700), F.lit(200)))
    return c.trim_messages(t.conversations, budgets)


SQL_VIEWS["conv_sizes"] = ("", f"""
    SELECT conv_id, count(*) AS n, count(*) FILTER (role IN ('user', 'assistant')) AS turns,
           CAST(sum({q.tokens('text')}) AS BIGINT) AS system_tokens, CAST(max({q.tokens('text')}) AS INTEGER) AS current_tokens FROM conversations GROUP BY 1""")
@query("adaptive_budgets", """
    WITH many AS (SELECT conv_id, turns * (conv_id % 12) AS turns, system_tokens, current_tokens FROM conv_sizes),
    b AS (SELECT conv_id, turns, CAST(8192 - 4096 - system_tokens - current_tokens AS INTEGER) AS t,
                 least(1.0::DOUBLE, greatest(0.0::DOUBLE, (turns - 5) / 45.0::DOUBLE)) AS d FROM many),
    s AS (SELECT *, least(CAST(trunc(t * 0.03::DOUBLE) AS INTEGER), 200) AS i, CAST(trunc(t * (0.05::DOUBLE + d * 0.15::DOUBLE)) AS INTEGER) AS su,
                 CAST(trunc(t * 0.12::DOUBLE) AS INTEGER) AS re, CASE WHEN turns > 10 THEN CAST(trunc(t * 0.05::DOUBLE) AS INTEGER) ELSE 0 END AS de,
                 CAST(trunc(t * 0.15::DOUBLE) AS INTEGER) AS ra FROM b)
    SELECT conv_id, turns, round(d, 6) AS depth_factor, CASE WHEN t <= 0 THEN 0 ELSE t END AS total_available, CASE WHEN t <= 0 THEN 0 ELSE i END AS instruction,
           CASE WHEN t <= 0 THEN 0 ELSE su END AS summary, CASE WHEN t <= 0 THEN 0 ELSE re END AS recap, CASE WHEN t <= 0 THEN 0 ELSE de END AS dedup,
           CASE WHEN t <= 0 THEN 0 ELSE ra END AS rag, CASE WHEN t <= 0 THEN 0 ELSE greatest(0,
             CAST(trunc(t * (0.60::DOUBLE + d * (0.40::DOUBLE - 0.60::DOUBLE))) AS INTEGER) - i - su - re - de - ra) END AS verbatim_history
    FROM s""", "conv_sizes")
def _(t):
    tok = token_count("text")
    sizes = t.conversations.groupBy("conv_id").agg(
        F.count_if(F.col("role").isin("user", "assistant")).alias("turns"), F.sum(tok).alias("system_tokens"), F.max(tok).alias("current_tokens"))
    sizes = sizes.withColumn("turns", F.col("turns") * (F.col("conv_id") % 12))
    return c.adaptive_budgets(sizes).withColumn("depth_factor", F.round("depth_factor", 6))


def _point(user, answer, u_label, a_label):
    s = q.first_sentence("text")
    return (f"CASE WHEN role = 'user' AND {s} <> '' THEN '{u_label}' || {q.clip(s, user, '...')} "
            f"WHEN role = 'assistant' AND length({q.clip(s, answer, '...')}) > 10 THEN '{a_label}' || {q.clip(s, answer, '...')} END")


SQL_VIEWS["chunks"] = ("conv_sizes", f"""
    SELECT conv_id, chunk, start_turn, end_turn, summary, {q.tokens('summary')} AS tokens FROM (
      SELECT conv_id, chunk, chunk AS start_turn, chunk + 1 AS end_turn, CASE WHEN {q.tokens('s')} > 150 THEN left(s, 600) ELSE s END AS summary
      FROM (SELECT conv_id, CAST(turn // {P} AS INTEGER) AS chunk,
                   array_to_string((list(p ORDER BY turn) FILTER (p IS NOT NULL))[1:6], ' | ') AS s0, coalesce(s0, '') AS s
            FROM (SELECT *, {_point(80, 100, 'User asked: ', 'Answered: ')} AS p FROM conversations) GROUP BY 1, 2)
      JOIN conv_sizes USING (conv_id) WHERE chunk < turns)""")
LINE = "'[Turns ' || start_turn || '-' || end_turn || ']: ' || summary"
SQL_VIEWS["overviews"] = ("chunks", f"""
    SELECT conv_id, overview, {q.tokens('overview')} AS overview_tokens, n_chunks FROM (
      SELECT conv_id, CASE WHEN {q.tokens('t')} > 300 THEN left(t, 1200) ELSE t END AS overview, n_chunks
      FROM (SELECT conv_id, string_agg({LINE}, chr(10) || chr(10) ORDER BY chunk) AS t, count(*) AS n_chunks FROM chunks GROUP BY 1) WHERE n_chunks >= 2)""")


@query("chunk_summaries", "SELECT * FROM chunks", "chunks")
def _(t):
    return c.chunk_summaries(t.conversations, P)


@query("session_summary", "SELECT * FROM overviews", "overviews")
def _(t):
    return c.session_summary(c.chunk_summaries(t.conversations, P))


@query("compressed_context", f"""
    SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS compressed FROM (
      SELECT conv_id, 0 AS pos, {q.lit(fixed.OVERVIEW_HEADING)} || overview AS line FROM overviews
      UNION ALL SELECT conv_id, chunk + 1, {LINE} FROM chunks JOIN (SELECT conv_id, turns // 2 AS r FROM conv_sizes) USING (conv_id) WHERE start_turn < r)
    GROUP BY 1""", "chunks overviews conv_sizes")
def _(t):
    recent = c.history_sizes(t.conversations).select("conv_id", F.floor(F.col("turns") / 2).alias("recent_turns"))
    return c.compressed_context(c.chunk_summaries(t.conversations, P), recent, P)


def _dedup(e):
    stops = q.text_list(fixed.DEDUP_STOP_WORDS)
    return (f"list_filter(list_distinct(regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}_]+')), "
            f"lambda w: length(w) > 1 AND NOT list_contains({stops}, w))")


@query("dedup_tokens", f"SELECT conv_id, turn, array_to_string(list_sort({_dedup('text')}), ' ') AS tokens FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_sort(c.dedup_tokens("text")), " ").alias("tokens"))


SQL_VIEWS["last_user"] = ("", """
    SELECT conv_id, turn AS last_turn, text AS message FROM conversations WHERE role = 'user'
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
SQL_VIEWS["hist"] = ("last_user", "SELECT c.* FROM conversations c JOIN last_user u USING (conv_id) WHERE c.turn < u.last_turn")
SQL_VIEWS["guards"] = ("hist last_user", f"""
    SELECT conv_id, CAST(count(*) AS INTEGER) AS n_similar, {q.lit(fixed.REPEAT_HEADING)} || string_agg(
             k || '. You already answered about ''' || left(uq, 80) || ''' (similarity: ' || CAST(round_even(sim * 100, 0) AS INTEGER) || '%): '
             || CASE WHEN length(b) >= 150 THEN b || '...' ELSE b END, chr(10) ORDER BY k) FILTER (k <= 3) AS hint
    FROM (SELECT conv_id, uq, sim, row_number() OVER (PARTITION BY conv_id ORDER BY rn) AS k, {q.strip("replace(left(ua, 150), chr(10), ' ')")} AS b
          FROM (SELECT u.conv_id, u.rn, u.text AS uq, a.text AS ua, {q.jaccard(_dedup('m.message'), _dedup('u.text'))} AS sim
                FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM hist WHERE role = 'user') u
                JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM hist WHERE role = 'assistant') a USING (conv_id, rn)
                JOIN last_user m USING (conv_id) WHERE rn <= 10) WHERE sim >= 0.05)
    GROUP BY 1""")


def last_user(t):
    last = t.conversations.filter("role = 'user'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m"))
    return last.select("conv_id", F.col("m.turn").alias("last_turn"), F.col("m.text").alias("message"))


def hist(t):
    m = last_user(t).select("conv_id", "last_turn")
    return t.conversations.join(m, "conv_id").filter("turn < last_turn").drop("last_turn")


@query("repetition_guard", "SELECT * FROM guards", "guards")
def _(t):
    return c.repetition_guard(hist(t), last_user(t).select("conv_id", "message"), threshold=0.05)


SQL_VIEWS["fitted"] = ("costed chunks conv_sizes", f"""
    SELECT conv_id, turn, role, text, all_fit, n_kept < n AS was_compressed, n_kept FROM (
      SELECT *, count(*) OVER (PARTITION BY conv_id) AS n_kept FROM (
        SELECT *, total <= 500 AS all_fit FROM (
          SELECT x.*, s.n, 3 + sum(4 + tok) OVER (PARTITION BY x.conv_id) AS total,
                 sum(cost) OVER (PARTITION BY x.conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used
          FROM costed x JOIN conv_sizes s USING (conv_id) LEFT JOIN (SELECT conv_id, count(*) AS k FROM chunks GROUP BY 1) k USING (conv_id)
          WHERE turn >= CASE WHEN coalesce(k, 0) * {P} < n THEN coalesce(k, 0) * {P} ELSE 0 END))
      WHERE all_fit OR used <= 500)""")


def fitted(t):
    """What follows the summarised chunks of each conversation, 600 tokens less 100 for the recap."""
    chunked = c.chunk_summaries(t.conversations, P).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    limits = t.conversations.select("conv_id").distinct().select("conv_id", F.lit(600).alias("token_budget"), F.lit(100).alias("recap_budget"))
    return c.fit_history(t.conversations, limits, chunked, P)


@query("fit_history", "SELECT * FROM fitted", "fitted")
def _(t):
    return fitted(t)


@query("relevance_split", f"""
    WITH r AS (SELECT f.*, u.message, count(*) OVER w AS n, turn - min(turn) OVER w AS at_, role || ': ' || left(text, 200) AS ct
               FROM fitted f LEFT JOIN last_user u USING (conv_id) WINDOW w AS (PARTITION BY conv_id)),
    s AS (SELECT *, round(0.5::DOUBLE * (len(list_intersect(qt, tt))::DOUBLE / greatest(len(qt) + len(tt) - len(list_intersect(qt, tt)), 1))
            + 0.4::DOUBLE * (list_sum(list_transform(qt, lambda x: (length(lower(ct)) - length(replace(lower(ct), x, ''))) // length(x)))::DOUBLE / greatest(len(tt), 1))
            + CASE WHEN n > 2 AND (at_ = 0 OR at_ = n - 1) THEN 0.1::DOUBLE ELSE 0 END, 9) AS score
          FROM (SELECT *, {q.terms('message')} AS qt, {q.terms('ct')} AS tt FROM r))
    SELECT conv_id, turn, role, CASE WHEN n <= 4 OR rk < n // 2 THEN 'key' ELSE 'older' END AS section
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, at_) - 1 AS rk FROM s)""", "fitted last_user")
def _(t):
    return c.relevance_split(fitted(t), last_user(t).select("conv_id", "message")).select("conv_id", "turn", "role", "section")


@query("recap", f"""
    SELECT conv_id, {q.lit(fixed.RECAP_HEADING)} || string_agg('- ' || p, chr(10) ORDER BY turn) AS recap
    FROM (SELECT conv_id, turn, p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
          FROM (SELECT conv_id, turn, {_point(120, 150, 'User asked: ', 'Assistant: ')} AS p FROM conversations) WHERE p IS NOT NULL)
    WHERE rn <= 8 GROUP BY 1""")
def _(t):
    return c.recap(t.conversations)


RULE1, RULE2 = fixed.RULE_PATTERNS


@query("instruction_rules", f"""
    SELECT conv_id, turn, CASE WHEN len(f) = 0 THEN '' ELSE {q.lit(fixed.RULES_HEADING)} || array_to_string(list_transform(
             list_filter(f, lambda r, i: list_position(list_transform(f, lambda z: {q.strip('lower(z)')}), {q.strip('lower(r)')}) = i)[1:5],
             lambda r: '- ' || {q.strip('r')}), chr(10)) END AS rules
    FROM (SELECT conv_id, turn, regexp_extract_all(p, '(?i){RULE1}') || regexp_extract_all(p, '(?i){RULE2}') AS f
          FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE 'You must ' || text || ' Never x. 必须好。 never X. ' || text END AS p FROM conversations))""")
def _(t):
    prompt = F.when(F.col("role") == "user", F.col("text")).otherwise(
        F.concat(F.lit("You must "), "text", F.lit(" Never x. 必须好。 never X. "), "text"))
    return t.conversations.select("conv_id", "turn", prompt.alias("p")).select("conv_id", "turn", c.instruction_rules("p").alias("rules"))


SEP = "chr(10) || '---' || chr(10)"
SQL_VIEWS["rag_contexts"] = ("cands", f"SELECT query_id, any_value(query) AS query, string_agg(text, {SEP} ORDER BY idx) AS rag_context FROM cands WHERE idx < 5 GROUP BY 1")


@query("split_context_blocks", f"""
    WITH b0 AS (SELECT query_id, query, list_filter(list_transform(regexp_split_to_array(rag_context, '\\n---\\n|\\n##\\s'), lambda x: {q.strip('x')}), lambda x: x <> '') AS bs,
                       rag_context FROM rag_contexts),
    b AS (SELECT query_id, query, i - 1 AS idx, bs[i] AS text, len(bs) AS n FROM b0, unnest(range(1, len(bs) + 1)) AS u(i)),
    s AS (SELECT *, round(0.5::DOUBLE * (len(list_intersect(qt, tt))::DOUBLE / greatest(len(qt) + len(tt) - len(list_intersect(qt, tt)), 1))
            + 0.4::DOUBLE * (list_sum(list_transform(qt, lambda x: (length(lt) - length(replace(lt, x, ''))) // length(x)))::DOUBLE / greatest(len(tt), 1))
            + CASE WHEN n > 2 AND (idx = 0 OR idx = n - 1) THEN 0.1::DOUBLE ELSE 0 END, 9) AS score
          FROM (SELECT *, {q.terms('query')} AS qt, {q.terms('text')} AS tt, lower(text) AS lt FROM b)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) - 1 AS rank, greatest(1, n // 3) AS th FROM s),
    p AS (SELECT *, CASE WHEN rank < bb THEN rank WHEN rank >= m THEN bb + rank - m ELSE rank + n - m END AS pos
          FROM (SELECT *, th + CASE WHEN n - 3 * th >= 1 THEN 1 ELSE 0 END AS bb, 2 * th + CASE WHEN n - 3 * th >= 2 THEN 1 ELSE 0 END AS m FROM r)),
    j AS (SELECT query_id, count(*) AS n, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS t FROM p GROUP BY 1)
    SELECT b0.query_id, CASE WHEN coalesce(n, 0) <= 2 THEN left(rag_context, 8000) WHEN {q.tokens('t')} > 2000 THEN left(t, 8000) ELSE t END AS context
    FROM b0 LEFT JOIN j USING (query_id)""", "rag_contexts")
def _(t):
    from ..functions.text import joined
    ctx = candidates(t, 5).groupBy("query_id").agg(F.first("query").alias("query"), joined("\n---\n", "text", "idx").alias("rag_context"))
    return c.sandwich_context(ctx.withColumn("budget", F.lit(2000)))


def built(t):
    from ..functions.text import joined
    requests = last_user(t).select("conv_id", "message")
    prompts = t.conversations.filter("turn = 0").select("conv_id", F.concat(
        F.lit("You are helpful. You MUST answer briefly. "), "text").alias("system_prompt"))
    known = t.conversations.filter("role = 'assistant'").groupBy("conv_id").agg(joined("\n---\n", "text", "turn").alias("rag_context"))
    lines = t.conversations.filter("turn = 1").select("conv_id", F.concat(F.lit("[Raw Conversation] "), F.substring_index("text", ".", 1)).alias("memory_context"))
    req = requests.join(prompts, "conv_id").join(known, "conv_id", "left").join(lines, "conv_id", "left")
    return c.build_messages(req, hist(t), context_size=6144, messages_per_chunk=P, threshold=0.05)


@query("build_messages")
def _(t):
    return built(t)[0]


@query("context_meta")
def _(t):
    return built(t)[1]


@query("list_sessions", "SELECT id, title, updated_at FROM sessions WHERE id NOT LIKE 'search%'", "sessions")
def _(t):
    return c.list_sessions(t.sessions).select("id", "title", "updated_at")


@query("session_messages", """
    SELECT session_id, id, role, content, epoch_ms(created_at) AS timestamp,
           CASE WHEN sources IS NULL THEN '' ELSE json_extract_string(sources, '$[0].doc_id') || '@' || json_extract_string(sources, '$[0].pages') END AS sources
    FROM history_rows""", "history_rows")
def _(t):
    shown = F.array_join(F.transform("sources", lambda s: F.concat(s["doc_id"], F.lit("@"), s["pages"])), ",")
    return c.session_messages(t.history_rows).withColumn("sources", shown)


@query("last_n_history", """
    SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6 GROUP BY 1""")
def _(t):
    return c.last_n_history(t.conversations, 6)
