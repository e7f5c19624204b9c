"""Registered queries and the pipeline on the smallest tables."""

import gc
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import TABLES, norm
from sheaf.llm import segments
from sheaf.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NATIVE = {"op5_containment", "op6_url_rules", "op8_personal_data", "op9_quality_rules"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in NATIVE:
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        rel = con.sql(ORACLES[name])
        at = [list(rel.columns).index(c) for c in cols]
        assert len(at) == len(rel.columns)
        assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_segments_are_returned_and_read_back(spark):
    P = pytest.importorskip("public_tokenizers")
    model = P.path("piece_bpe_32k.model")
    df = QUERIES["op10_gumbel_segments"](spark, SF)
    got = df.collect()
    assert all(r.round_trip and len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    texts = {r.doc_id: (r.text or "").replace(segments.SPACE, " ") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    back = segments.decode(df, model).select("doc_id", "text").distinct().collect()
    assert {r.doc_id: r.text for r in back} == texts and len(back) == len(texts)
    # round_trip looks at the ids that were written, not at those in memory.
    written = segments.encode(spark.createDataFrame([(1, "some text"), (2, "other text")], "doc_id long, text string"), model, decoded=False)
    torn = written.withColumn("ids", F.when(F.col("doc_id") == 2, F.reverse("ids")).otherwise(F.col("ids")))
    assert {(r.doc_id, r.round_trip) for r in segments.read_back(torn, model).collect()} == {(1, True), (2, False)}


def test_lattices_take_little_memory(spark):
    P = pytest.importorskip("public_tokenizers")
    model = P.path("piece_bpe_32k.model")
    pieces = segments.pieces_for(model, 1.0)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    words = list(dict.fromkeys(w for t in texts for w in segments.units(t)))
    tracemalloc.start()
    lattices = segments.Lattices(words, pieces)
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # Sorting edges took some 150 bytes of each (10 ** 5 edges or more: arrays outweigh all else).
    assert len(lattices.start) > 10 ** 5 and most < 100 * len(lattices.start)
    # A node's edges stand together, long ones first, and end inside its word.
    start, stop = lattices.start, lattices.stop
    assert ((np.diff(start) != 0) | (np.diff(stop) < 0)).all() and not lattices.is_end[start].any()
    # Decoding needs no trie.
    assert not hasattr(segments.spellings_for(model), "keys")
    ids = segments.sample_texts([7], ["caf\u00e9 \U0001F600 x"], pieces, 1)[0][0][0]
    assert segments.decode_ids(ids, segments.spellings_for(model)).decode() == "caf\u00e9 \U0001F600 x"
    # Words of a piece go as soon as it is done.
    gc.disable()
    try:
        tracemalloc.start()
        segments.sample_texts(list(range(len(texts))), texts, pieces, 2)
        assert tracemalloc.get_traced_memory()[0] < 10 * len(words)
    finally:
        tracemalloc.stop()
        gc.enable()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        now = {r.doc_id for r in docs.collect()}
        assert now <= before and len(now) > 0.6 * len(before), name
        before = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in out} == before and all(r.round_trip for r in out)
