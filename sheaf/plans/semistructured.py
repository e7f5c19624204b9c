"""Queries turning stored model replies into rows."""

from pyspark.sql import functions as F

from ..operators import semistructured as j
from . import sqlgen as q
from .inputs import SQL_VIEWS
from .registry import query

SQL_VIEWS["fenced"] = ("llm_outputs", f"""
    SELECT id, raw, {q.strip("CASE WHEN starts_with(" + q.strip('body') + ", '[') OR regexp_extract(body, '(?s)\\[.*\\]') = '' THEN body ELSE regexp_extract(body, '(?s)\\[.*\\]') END")} AS body
    FROM (SELECT id, raw, CASE WHEN regexp_matches(raw, '{j.FENCE}') THEN regexp_extract(raw, '{j.FENCE}', 1) ELSE raw END AS body FROM llm_outputs)""")
SQL_VIEWS["repaired"] = ("fenced", r"""
    SELECT id, raw, body, CASE WHEN json_valid(body) THEN body ELSE trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(body,
      '//.*?\n', '', 'g'), ',\s*([}\]])', '\1', 'g'), '''', '"'), 'None', 'null'), '\s+', ' ', 'g')) END AS repaired FROM fenced""")


@query("strip_json_fence", "SELECT id, body FROM fenced", "fenced")
def _(t):
    return t.llm_outputs.select("id", j.strip_json_fence("raw").alias("body"))


@query("repair_json", "SELECT id, repaired FROM repaired", "repaired")
def _(t):
    return t.llm_outputs.select("id", j.repair_json(j.strip_json_fence("raw")).alias("repaired"))


@query("parse_data_points", """
    WITH p AS (SELECT id, CAST(repaired AS JSON) AS js FROM repaired),
    e AS (SELECT id, CAST(i AS INTEGER) AS pos, js->(i::INTEGER)->>'x' AS x, js->(i::INTEGER)->>'y' AS y
          FROM p, unnest(range(CAST(json_array_length(js) AS BIGINT))) AS u(i)),
    bad AS (SELECT id, CASE WHEN bool_or(x IS NULL OR y IS NULL) THEN 'missing x or y'
                  WHEN bool_or(TRY_CAST(y AS DOUBLE) IS NULL) THEN 'y is not numeric' END AS error FROM e GROUP BY 1)
    SELECT id, pos, x, TRY_CAST(y AS DOUBLE) AS y, error FROM e JOIN bad USING (id) WHERE error IS NULL
    UNION ALL SELECT id, NULL, NULL, NULL, error FROM bad WHERE error IS NOT NULL""", "repaired")
def _(t):
    return j.parse_data_points(t.llm_outputs)


def entity_outputs(t):
    good = F.to_json(F.struct(F.concat(F.lit("about "), "event_type").alias("detailed_description"), F.struct(
        F.concat(F.lit("e"), "event_id").alias("entity_name"), F.col("event_type").alias("entity_type"),
        F.col("props").alias("summary")).alias("entity_info")))
    fence = F.concat(F.lit("```json\n"), good, F.lit("\n```"))
    broken = F.concat(F.lit("not json: "), F.repeat("event_type", 60))
    k = F.col("event_id") % 3
    return t.events.select(F.col("event_id").alias("id"), F.when(k == 0, good).when(k == 1, fence).otherwise(broken).alias("raw"),
                           F.lit("fallback").alias("entity_name"), F.lit("image").alias("entity_type"))


@query("parse_entity_json", """
    SELECT event_id AS id, event_id % 3 <> 2 AS parsed,
           CASE WHEN event_id % 3 <> 2 THEN 'about ' || event_type ELSE bad END AS description,
           CASE WHEN event_id % 3 <> 2 THEN 'e' || event_id ELSE 'fallback' END AS entity_name,
           CASE WHEN event_id % 3 <> 2 THEN event_type ELSE 'image' END AS entity_type,
           CASE WHEN event_id % 3 <> 2 THEN props ELSE left(bad, 200) END AS summary
    FROM (SELECT *, 'not json: ' || repeat(event_type, 60) AS bad FROM events)""")
def _(t):
    return j.parse_entity_json(entity_outputs(t))


ENTRIES = f"""
    WITH e AS (SELECT 's_' || conv_id || '_' || turn AS session_id, text, role, array_to_string(string_split(text, ' ')[1:3], ' ') AS f FROM conversations),
    i AS (SELECT session_id, 0 AS g, 'semantic' AS type, {q.strip('text')} AS content, 'alpha|beta|gamma' AS keywords FROM e
          UNION ALL SELECT session_id, 1, 'procedural', {q.strip('f')}, '' FROM e
          UNION ALL SELECT session_id, 2, 'procedural', role, role FROM e)
    SELECT type || '_' || session_id || '_' || (row_number() OVER (PARTITION BY session_id ORDER BY g) - 1) AS id, type, content, keywords,
           session_id AS source_session_id FROM i WHERE content <> ''"""


@query("extracted_memories", ENTRIES)
def _(t):
    return j.extracted_memories(t.memory_json).withColumn("keywords", F.array_join("keywords", "|"))
