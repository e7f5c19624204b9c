"""Semi-structured text (stored model replies) turned into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import col, strip

FENCE = "(?s)```(?:json)?\\s*\\n?(.*?)\\n?```"
POINTS = "array<struct<x:string,y:string>>"
ENTITY = "struct<detailed_description:string,entity_info:struct<entity_name:string,entity_type:string,summary:string>>"


def fence_body(raw: Column | str) -> Column:
    """Body of the first code fence, else the text."""
    raw = col(raw)
    return F.coalesce(F.nullif(F.regexp_extract(raw, FENCE, 1), F.lit("")), raw)


def bracketed(body: Column | str) -> Column:
    """The outermost brackets of a text that does not start with one."""
    body = col(body)
    listed = F.regexp_extract(body, "(?s)\\[.*\\]", 0)
    return strip(F.when(body.rlike("^\\s*\\[") | (listed == ""), body).otherwise(listed))


def strip_json_fence(raw: Column | str) -> Column:
    return bracketed(fence_body(raw))


def is_json(text: Column | str) -> Column:
    return F.try_parse_json(col(text)).isNotNull()


def repair_json(text: Column | str) -> Column:
    """Text that does not parse gets its usual slips fixed: trailing commas, quotes, comments, None, blanks."""
    c = F.regexp_replace(col(text), "//.*?\\n", "")
    c = F.regexp_replace(c, ",\\s*([}\\]])", "$1")
    c = F.replace(F.replace(c, F.lit("'"), F.lit('"')), F.lit("None"), F.lit("null"))
    c = F.trim(F.regexp_replace(c, "\\s+", " "))
    return F.when(is_json(text), col(text)).otherwise(c)


def parse_data_points(outputs: DataFrame) -> DataFrame:
    """Points (id, pos, x, y) of outputs (id, raw); an output with any bad point is one error row."""
    staged = outputs.select("id", fence_body("raw").alias("_b")).select("id", bracketed("_b").alias("_s")).select(
        "id", repair_json("_s").alias("_r"))
    parsed = staged.select("id", F.from_json("_r", POINTS).alias("p"))
    value = lambda point: point["y"].try_cast("double")
    error = (F.when(F.col("p").isNull() | (F.size("p") == 0), "expected non-empty array")
             .when(F.exists("p", lambda r: r["x"].isNull() | r["y"].isNull()), "missing x or y")
             .when(F.exists("p", lambda r: value(r).isNull()), "y is not numeric"))
    checked = parsed.withColumn("error", error)
    rows = checked.select("id", "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("p"))).alias("pos", "point"))
    return rows.select("id", "pos", "point.x", value(F.col("point")).alias("y"), "error")


def parse_entity_json(outputs: DataFrame) -> DataFrame:
    """Description and entity of replies (id, raw, entity_name, entity_type); unparsable replies keep their text."""
    raw = F.col("raw")
    body = F.when(raw.rlike("(?s)```"), F.regexp_extract(raw, "(?s)```(?:json)?(.*?)(?:```|$)", 1)).otherwise(raw)
    parsed = outputs.withColumn("_b", strip(body)).withColumn("_j", F.when(is_json("_b"), F.from_json("_b", ENTITY)))
    ok = F.col("_j").isNotNull()
    info = F.col("_j.entity_info")
    return parsed.select(
        "id", ok.alias("parsed"),
        F.when(ok, F.coalesce("_j.detailed_description", F.lit(""))).otherwise(raw).alias("description"),
        F.when(ok, info["entity_name"]).otherwise(F.col("entity_name")).alias("entity_name"),
        F.when(ok, info["entity_type"]).otherwise(F.col("entity_type")).alias("entity_type"),
        F.when(ok, info["summary"]).otherwise(F.substring(raw, 1, 200)).alias("summary"))


def extracted_memories(replies: DataFrame) -> DataFrame:
    """Entries of extraction replies (session_id, raw): one JSON object keyed by memory type.

    Values that are not lists and items without content are skipped; ids number the entries of one reply.
    Everything happens inside the row, so replies are never shuffled.
    """
    item = "array<struct<content:string,keywords:string>>"

    def listed(kind: str) -> Column:
        value = F.get_json_object("raw", f"$.{kind}")
        items = F.coalesce(F.when(value.startswith("["), F.from_json(value, item)), F.array().cast(item))
        return F.transform(items, lambda i: F.struct(F.lit(kind).alias("type"), strip(i["content"]).alias("content"),
                                                     i["keywords"].alias("keywords")))

    every = F.concat(*[listed(t) for t, _, _ in fixed.MEMORY_TYPES if t != "raw"])
    kept = replies.select("session_id", F.posexplode(F.filter(every, lambda e: e["content"] != "")).alias("n", "e")).select(
        "session_id", "n", "e.*")
    split = F.filter(F.transform(F.split("keywords", ","), strip), lambda k: k != "")
    keywords = F.when(F.col("keywords").startswith("["), F.from_json("keywords", "array<string>")).otherwise(split)
    return kept.select(
        F.concat_ws("_", "type", "session_id", "n").alias("id"), "type", "content",
        F.coalesce(keywords, F.array().cast("array<string>")).alias("keywords"), F.col("session_id").alias("source_session_id"))
