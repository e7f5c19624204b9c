"""Memory queries."""

from pyspark.sql import functions as F

from ..operators import memory as m
from . import sqlgen as q
from .inputs import SQL_VIEWS
from .registry import query

EDGE = m.EDGES
TERMS = ("list_distinct(list_transform(list_filter({w}, lambda x: length(x) > 2), lambda x: regexp_replace(lower(x), '^{e}+|{e}+$', '', 'g')))")


def _terms(e):
    return TERMS.format(w=q.words(e), e=EDGE)


SQL_VIEWS["memory_log"] = ("memory", """
    SELECT * FROM memory UNION ALL
    SELECT id, type, 'again ' || content, keywords, owner, NOT enabled, seq + 1000000 FROM memory WHERE owner = 'user'""")
SQL_VIEWS["mem_hits"] = ("memory qs", f"""
    SELECT query_id, id, score, seq, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq, id) AS INTEGER) AS rank
    FROM (SELECT b.query_id, a.id, a.seq, round(len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + 1), 9) AS score
          FROM (SELECT id, seq, {_terms("content || ' ' || array_to_string(keywords, ' ')")} AS t FROM memory) a,
               (SELECT query_id, {_terms('query')} AS t FROM qs) b WHERE len(list_intersect(a.t, b.t)) > 0)
    QUALIFY rank <= 10""")
SQL_VIEWS["mem_kept"] = ("mem_hits memory", """
    SELECT query_id, id, score, type, content, keywords, seq,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq, id) AS INTEGER) AS rank
    FROM (SELECT h.query_id, h.id, h.score, x.type, x.content, x.keywords, x.seq FROM mem_hits h JOIN memory x USING (id) WHERE x.enabled)
    QUALIFY rank <= 5""")
FLAT = "array_to_string(keywords, '|') AS keywords"


def flat(df):
    return df.withColumn("keywords", F.array_join("keywords", "|"))


@query("memory_upsert", f"""
    SELECT id, type, content, {FLAT}, owner, enabled, seq FROM memory_log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""", "memory_log")
def _(t):
    again = t.memory.filter("owner = 'user'").withColumn("content", F.concat(F.lit("again "), "content")).withColumn(
        "enabled", ~F.col("enabled")).withColumn("seq", F.col("seq") + 1000000)
    return flat(m.memory_upsert(t.memory.unionByName(again)))


@query("memory_fifo", "SELECT id, type, owner, seq FROM memory ORDER BY seq DESC, id LIMIT 200", "memory")
def _(t):
    return m.memory_fifo(t.memory).select("id", "type", "owner", "seq")


@query("memory_fifo_per_owner", """
    SELECT id, type, owner, seq FROM memory QUALIFY row_number() OVER (PARTITION BY owner ORDER BY seq DESC, id) <= 100""", "memory")
def _(t):
    return m.memory_fifo(t.memory, 100, per=["owner"]).select("id", "type", "owner", "seq")


@query("memory_fifo_quota", """
    SELECT id, type, owner, seq FROM memory QUALIFY row_number() OVER (PARTITION BY type ORDER BY seq DESC, id)
      <= CASE type WHEN 'raw' THEN 20 WHEN 'semantic' THEN 80 ELSE 50 END""", "memory")
def _(t):
    return m.memory_fifo(t.memory, 50, quotas={"raw": 20, "semantic": 80}).select("id", "type", "owner", "seq")


@query("memory_list", f"""
    SELECT id, type, content, {FLAT}, seq, (SELECT count(*) FROM memory WHERE type = 'semantic' AND enabled) AS total
    FROM memory WHERE type = 'semantic' AND enabled ORDER BY seq LIMIT 50 OFFSET 50""", "memory")
def _(t):
    return flat(m.memory_list(t.memory, "semantic", True, page=2).select("id", "type", "content", "keywords", "seq", "total"))


@query("memory_set_enabled", """
    SELECT id, CASE WHEN owner = 'assistant' THEN false ELSE enabled END AS enabled, CASE WHEN owner = 'assistant' THEN seq + 5 ELSE seq END AS updated_at, '' AS problem FROM memory
    UNION ALL SELECT 'x' || id, false, seq + 5, 'unknown id' FROM memory WHERE owner = 'assistant'""", "memory")
def _(t):
    known = t.memory.filter("owner = 'assistant'").select("id", F.lit(False).alias("enabled"), (F.col("seq") + 5).alias("at"))
    changes = known.unionByName(known.withColumn("id", F.concat(F.lit("x"), "id")))
    updated, unknown = m.memory_set_enabled(t.memory.withColumn("updated_at", F.col("seq")), changes)
    return updated.select("id", "enabled", "updated_at", F.lit("").alias("problem")).unionByName(
        unknown.select("id", "enabled", F.col("at").alias("updated_at"), F.lit("unknown id").alias("problem")))


@query("memory_forget", """
    SELECT id, (SELECT count(*) FROM memory WHERE owner = 'user') AS n_removed FROM memory WHERE owner <> 'user'""", "memory")
def _(t):
    left, removed = m.memory_forget(t.memory, t.memory.filter("owner = 'user'"))
    return left.select("id", removed.scalar().alias("n_removed"))


def hits(t):
    return m.memory_keyword_search(t.memory, t.queries, 10)


@query("memory_keyword_search", "SELECT query_id, id, score, rank FROM mem_hits", "mem_hits")
def _(t):
    return hits(t)


@query("memory_retrieve", "SELECT query_id, rank, id, score, type FROM mem_kept", "mem_kept")
def _(t):
    return m.memory_retrieve(t.memory, hits(t), 5).select("query_id", "rank", "id", "score", "type")


LENGTH = "(sqrt(list_sum(list_transform({e}, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-8)"
SQL_VIEWS["capped_memory"] = ("owned_memory", """
    SELECT * FROM owned_memory QUALIFY row_number() OVER (PARTITION BY owner ORDER BY seq DESC, id) <= 200""")
SQL_VIEWS["owned_hits"] = ("capped_memory owner_queries", f"""
    WITH speakers AS (SELECT * FROM owner_queries WHERE embedding IS NOT NULL
                      AND owner IN (SELECT owner FROM capped_memory WHERE embedding IS NOT NULL))
    SELECT query_id, id, score, seq, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq, id) AS INTEGER) AS rank
    FROM (SELECT s.query_id, m.id, m.seq, round(list_dot_product(list_transform(m.embedding, lambda x: x::DOUBLE), list_transform(s.embedding, lambda x: x::DOUBLE))
                 / ({LENGTH.format(e='m.embedding')} * {LENGTH.format(e='s.embedding')}), 6) AS score
          FROM speakers s JOIN capped_memory m USING (owner) WHERE m.embedding IS NOT NULL
          UNION ALL
          SELECT query_id, id, seq, round(len(list_intersect(mt, qt))::DOUBLE / (len(mt) + 1), 9) AS score
          FROM (SELECT w.query_id, m.id, m.seq, {_terms("m.content || ' ' || array_to_string(m.keywords, ' ')")} AS mt, {_terms('w.query')} AS qt
                FROM owner_queries w JOIN capped_memory m USING (owner) WHERE w.query_id NOT IN (SELECT query_id FROM speakers))
          WHERE len(list_intersect(mt, qt)) > 0)
    QUALIFY rank <= 10""")


def owned_hits(t):
    capped = m.memory_fifo(t.owned_memory, 200, per=["owner"])
    return capped, m.memory_vector_search(capped, t.owner_queries, 10)


@query("memory_vector_search", "SELECT query_id, id, score, rank FROM owned_hits", "owned_hits")
def _(t):
    """Vectors first, words where there is none; ten hits, twice what is shown."""
    return owned_hits(t)[1]


@query("memory_retrieve_owned", """
    SELECT query_id, id, score, type, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq, id) AS INTEGER) AS rank
    FROM (SELECT h.query_id, h.id, h.score, x.type, x.seq FROM owned_hits h JOIN capped_memory x USING (id) WHERE x.enabled AND x.type = 'semantic')
    QUALIFY rank <= 5""", "owned_hits")
def _(t):
    capped, hits_ = owned_hits(t)
    return m.memory_retrieve(capped.drop("embedding"), hits_, 5, "semantic").select("query_id", "rank", "id", "score", "type")


LABEL = "CASE type WHEN 'raw' THEN 'Raw Conversation' WHEN 'semantic' THEN 'Semantic Knowledge' WHEN 'episodic' THEN 'Episodic Memory' ELSE 'Procedural Memory' END"


@query("memory_context", f"""
    SELECT query_id, string_agg('[' || {LABEL} || '] ' || content, chr(10) ORDER BY rank) AS context,
           bit_or(CAST(CASE type WHEN 'raw' THEN 1 WHEN 'semantic' THEN 2 WHEN 'episodic' THEN 4 ELSE 8 END AS INTEGER)) AS type_flags FROM mem_kept GROUP BY 1""", "mem_kept")
def _(t):
    return m.memory_context(m.memory_retrieve(t.memory, hits(t), 5))


@query("memory_relevance_view", f"""
    SELECT query_id, rank, id, type, {LABEL} AS label, content, array_to_string(keywords, ', ') AS keywords, round(score, 4) AS relevance,
           strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(seq), '%Y-%m-%d %H:%M:%S') AS updated FROM mem_kept""", "mem_kept")
def _(t):
    dated = t.memory.withColumn("updated_at", F.timestamp_add("SECOND", F.col("seq").cast("int"), F.to_timestamp(F.lit("2024-01-01 00:00:00"))))
    return m.memory_relevance_view(m.memory_retrieve(dated, hits(t), 5))
