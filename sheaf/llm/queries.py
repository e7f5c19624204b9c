"""Registered queries of this folder and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, ngrams, pii, prefix_bpe, quality, repeats, segments, simhash, spelling, token_planes, url_rules, vector_codes
from .common import saved, shared_path, table

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.rule_table(spark, url_rules.HOST_RULES, url_rules.PATTERNS)
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def _op6_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    ranked = sorted(url_rules.HOST_RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fit = [(f"(host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)})", h + p, v)
           for v, h, p in ranked]
    rule = " ".join(f"WHEN {c} THEN {quoted(r)}" for c, r, _ in fit)
    verdict = " ".join(f"WHEN {c} THEN {quoted(v)}" for c, _, v in fit)
    patterns = " OR ".join(f"regexp_matches(low, {quoted(url_rules.pattern_regex(p))})" for p in url_rules.PATTERNS)
    lower = f"translate(%s, {quoted('ABCDEFGHIJKLMNOPQRSTUVWXYZ')}, {quoted('abcdefghijklmnopqrstuvwxyz')})"
    return f"""
WITH a AS (SELECT page_id, {lower % "coalesce(url, '')"} AS low,
             CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS head
           FROM pages),
b AS (SELECT page_id, low, {lower % "regexp_extract(head, '^[^/]*', 0)"} AS host,
        substr(head, length(regexp_extract(head, '^[^/]*', 0)) + 1) AS path FROM a)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN {patterns} THEN 'block' ELSE 'allow' END AS verdict
FROM b"""


ORACLES["op6_url_rules"] = _op6_sql()


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge_documents(documents, quality.learn(documents, labels))


@query
def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(found["fp"]).alias("fingerprint"), "component_id", "n_shingles")


@query
def op5_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op5_containment"] = """
WITH w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                              '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
           FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark)),
i AS (SELECT DISTINCT id, least(len(w), 5) AS k, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS s
      FROM w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS u(p) WHERE kind = 'i' AND len(w) > 0),
d AS (SELECT DISTINCT id, k, array_to_string(w[p:p + k - 1], ' ') AS s
      FROM w, (SELECT DISTINCT k FROM i), unnest(range(1, len(w) - k + 2)) AS u(p) WHERE kind = 'd'),
n AS (SELECT id, count(*) AS n FROM i GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n) AS n_shingles, count(*) AS n_found
FROM i JOIN n ON n.id = i.id JOIN d ON d.k = i.k AND d.s = i.s GROUP BY d.id, i.id
HAVING count(*) >= ceil(any_value(n.n) * 0.8::DOUBLE - 1e-9)"""


@query
def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "ids")
    token_planes.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_planes.digest(spark, path)


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.report(documents, pii.learn(documents))


@query
def op4_chat_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return chat.digest(saved(chat.format_turns(conversations.unionByName(tricky))))


@query
def op3_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngrams.score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", *[F.get("levels", F.lit(k)).alias(f"n_{name}") for k, name in enumerate(("unigram", "bigram", "trigram"))],
                         F.col("score").alias("score_micro"))


ORACLES["op1_stupid_backoff"] = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, p, w[p] AS a, CASE WHEN p > 1 THEN w[p - 1] END AS b, CASE WHEN p > 2 THEN w[p - 2] END AS c
      FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
c1 AS (SELECT a, count(*) AS n FROM g GROUP BY a),
c2 AS (SELECT b, a, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, a),
c3 AS (SELECT c, b, a, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY c, b, a),
s AS (SELECT g.doc_id, least(p - 1, 2) AS held,
        CASE WHEN c3.n >= 2 THEN 3 WHEN c2.n >= 2 THEN 2 ELSE 1 END AS level,
        CASE WHEN c3.n >= 2 THEN c3.n / h2.n WHEN c2.n >= 2 THEN c2.n / h1.n ELSE c1.n / (SELECT count(*) FROM g) END AS ratio
      FROM g JOIN c1 ON c1.a = g.a LEFT JOIN c2 ON c2.a = g.a AND c2.b = g.b LEFT JOIN c3 ON c3.a = g.a AND c3.b = g.b AND c3.c = g.c
      LEFT JOIN c1 AS h1 ON h1.a = g.b LEFT JOIN c2 AS h2 ON h2.a = g.b AND h2.b = g.c),
t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (level = 1) AS n_unigram, count(*) FILTER (level = 2) AS n_bigram,
        count(*) FILTER (level = 3) AS n_trigram, sum(floor((ln(ratio) + (held - level + 1) * ln(0.4::DOUBLE)) * 1000000 + 0.5)::BIGINT)::BIGINT AS score_micro
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_unigram, 0) AS n_unigram, coalesce(n_bigram, 0) AS n_bigram,
  coalesce(n_trigram, 0) AS n_trigram, coalesce(score_micro, 0) AS score_micro
FROM d LEFT JOIN t ON t.doc_id = d.doc_id"""


@query
def op10_gumbel_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return segments.read_back(segments.encode(table(spark, sf_dir, "documents"), model, decoded=False), model)


@query
def op11_letter_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.corpus_variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


@query
def op12_value_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query
def op13_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return prefix_bpe.digest(prefix_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
