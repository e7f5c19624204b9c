"""Every query with a SQL twin gives its answer at the smallest scale; plans stay free of nested products."""

import duckdb
import pytest

from check import KIND, TABLES, norm
from sheaf import plans

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()
#: Vectors, clusters, decisions in time order, packing, and what cleans pages or selects their elements.
PYTHON = {"vector_topk", "related_chunks", "familiarity", "adaptive_route", "cluster_history", "rate_limit_admit",
          "clean_html", "clean_html_nested", "extract_text", "page_metadata", "search_source_stats", "validate_page", "split_scraped",
          "url_content_relevance", "page_quality_report", "context_from_pages", "pack_paragraphs", "serp_rows_by_layout"}


def check_plan(df, name):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in PYTHON:
        assert not any(x in plan for x in ("ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if not name.startswith("stream_"):
        check_plan(df, name)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(x[c]) for c in cols) for x in df.collect()), key=repr)
    rel = duck.sql(SQL[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    want = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in rel.fetchall()), key=repr)
    assert got == want
    kinds = dict(zip(names, (str(x).lower() for x in rel.types)))
    for f in df.schema:
        simple = f.dataType.simpleString()
        if kinds[f.name] in KIND:
            assert {"bigint": "long"}.get(simple, simple) == KIND[kinds[f.name]], f.name


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith("stream_") and n != "context_meta"))
def test_without_sql(spark, name):
    df = QUERIES[name](spark, SF)
    check_plan(df, name)
    assert df.count() > 0


def test_context_cleans_only_the_pages_found(spark):
    plan = plans.queries()["context_from_pages"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # Trees are written from the top: the cleaner stands above the join with the results.
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Join")
