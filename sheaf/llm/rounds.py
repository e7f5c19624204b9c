"""Question rounds between batches of documents and buckets of keys.

Documents are dealt into batches of a few megabytes by a hash of their id (one shuffle of the texts, reused by every round).
A batch asks: it packs what it wants to know, reduced to distinct keys, into one block per bucket of key hashes. A
bucket gathers the blocks of all batches, answers each, and the answers go back to the batch, which reads its documents again
with them. A key that a third of all rows share is one entry per batch, so no bucket sees its rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a batch and, in the mean, behind a bucket. Both numbers grow with the corpus, neither with a batch's size.
BATCH_BYTES, BUCKET_BYTES = 6_000_000, 8_000_000
BLOCK = "batch long, bucket long, body binary"


def batches(documents: DataFrame, batch_bytes: int = BATCH_BYTES, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(batch, doc_id, body) with the text's bytes, null as empty; and the number of buckets."""
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(8, -(-size // batch_bytes))
    # Rows of one id are spread by their text as well: copies under one id may be many.
    batch = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select(batch.alias("batch"), "doc_id", body.alias("body")), max(8, -(-size // BUCKET_BYTES))


def ask(dealt: DataFrame, question, answers: DataFrame | None = None) -> DataFrame:
    """``question(ids, texts[, answer bodies]) -> {bucket: body}`` for every batch."""
    def rows(batch: int, blocks: dict) -> pa.Table:
        return pa.table({"batch": pa.array([batch] * len(blocks), pa.int64()), "bucket": pa.array(list(blocks), pa.int64()),
                         "body": pa.array(list(blocks.values()), pa.binary())})

    if answers is None:
        return dealt.groupBy("batch").applyInArrow(lambda t: rows(t.column("batch")[0].as_py(), question(*_columns(t))), BLOCK)

    def both(t: pa.Table, a: pa.Table) -> pa.Table:
        if not t.num_rows:
            return rows(0, {})
        return rows(t.column("batch")[0].as_py(), question(*_columns(t), _bodies(a)))

    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(both, BLOCK)


def answer(asked: DataFrame, reply) -> DataFrame:
    """``reply([bodies]) -> [bodies]`` for every bucket, in the order of its batches."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("batch")
        return pa.table({"batch": t.column("batch"), "bucket": t.column("bucket"), "body": pa.array(reply(t.column("body").to_pylist()), pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, BLOCK)


def use(dealt: DataFrame, answers: DataFrame, finish, schema: str) -> DataFrame:
    """``finish(ids, texts, {bucket: body}) -> table`` for every batch that has documents."""
    def both(t: pa.Table, a: pa.Table) -> pa.Table:
        if not t.num_rows:
            return finish([], [], {})
        return finish(*_columns(t), _bodies(a))

    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(both, schema)


def _columns(t: pa.Table) -> tuple[list, list]:
    return t.column("doc_id").to_pylist(), t.column("body").to_pylist()


def _bodies(a: pa.Table) -> dict:
    return dict(zip(a.column("bucket").to_pylist(), a.column("body").to_pylist()))
