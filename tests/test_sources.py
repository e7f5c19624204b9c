"""File, JSON, JDBC and table sources and sinks."""

import json

from pyspark.sql import functions as F

from sheaf.operators import retrieval as r
from sheaf.operators import store
from sheaf.plans.inputs import Tables
from sheaf.sources import files

SF = "/root/testdata/sf0.001"


def test_scan_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for n in ("b.PDF", "a.md", "x/c.jpeg", "skip.exe", "noext"):
        (tmp_path / n).write_text("12345")
    got = files.scan_document_dir(spark, str(tmp_path)).collect()
    assert [(x.filename, x.file_size, x.extension) for x in got] == [("a.md", 5, ".md"), ("b.PDF", 5, ".pdf"), ("c.jpeg", 5, ".jpeg")]
    plan = files.scan_document_dir(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_json_store(spark, tmp_path):
    (tmp_path / "kv.json").write_text(json.dumps({"u1": {"t": 1}, "u2": "x"}, indent=1))
    got = {x.key: x.value for x in files.read_json_kv(spark, str(tmp_path)).collect()}
    assert json.loads(got["u1"]) == {"t": 1} and got["u2"] == "x"


def test_json_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f'k "{i}"', {"a": str(i), "b": 'x\n"y"'}) for i in range(25)] + [("none", None)], "key string, value map<string,string>")
    files.write_json_kv(rows, str(tmp_path / "kv"), keys_per_file=10)
    back = {x.key: json.loads(x.value) for x in files.read_json_kv(spark, str(tmp_path / "kv")).collect() if x.value is not None}
    assert back == {f'k "{i}"': {"a": str(i), "b": 'x\n"y"'} for i in range(25)}
    assert len(list((tmp_path / "kv").glob("file=*"))) == 3
    files.write_json_kv(rows.limit(0), str(tmp_path / "empty"))
    assert files.read_json_kv(spark, str(tmp_path / "empty")).count() == 0


def test_jdbc_round_trip(spark):
    history = Tables(spark, SF).history_rows.withColumn("turn", F.regexp_extract("id", "_([0-9]+)$", 1).cast("int"))
    url = "jdbc:derby:memory:history;create=true"
    files.write_jdbc(history, url, "chat_messages", "overwrite", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    back = files.read_jdbc(spark, url, "chat_messages", partition_column="turn", lower=0, upper=8, partitions=4,
                           driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert back.count() == history.count() and back.exceptAll(history).count() == 0


def moved_scans(df):
    """Exchanges that stand right over a scan of a stored table (through filters and projections), and the whole plan."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in plan]
    out = []
    for i, line in enumerate(plan):
        if "FileScan" in line and "Bucketed: true" in line:
            at = i
            while at > 0 and depth[at - 1] < depth[at] and any(w in plan[at - 1] for w in ("Filter", "Project", "ColumnarToRow", "Sort ")):
                at -= 1
            out.append("Exchange" in plan[at - 1])
    return out, "\n".join(plan)


def test_stored_index_stays_where_it_is(spark, tmp_path):
    t = Tables(spark, SF)
    spark.sql("CREATE DATABASE IF NOT EXISTS sheaf_test LOCATION '%s'" % (tmp_path / "db"))
    want = sorted(map(tuple, r.search_postings(r.posting_index(t.doc_pages), t.queries, 3).collect()))
    for table in ("sheaf_test.postings", None):
        index = r.write_posting_index(t.doc_pages, table, slices=3)
        assert index.count() == r.posting_index(t.doc_pages).count()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            found = r.search_stored_postings(index, t.queries, 3, slices=3)
            moved, plan = moved_scans(found)
            assert moved == [False], plan
            assert sorted(map(tuple, found.collect())) == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("DROP DATABASE sheaf_test CASCADE")


def test_page_store_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, p, f"p{p}") for p in range(1, 24)] + [(2, 1, ""), (2, 2, None), (4, 1, "no meta")], "doc_id long, page int, content string")
    meta = spark.createDataFrame([(1, "a", 0, "x"), (2, "b", 9, "x"), (3, "empty", 1, "x")], "doc_id long, doc_name string, page_count int, status string")
    spark.sql("CREATE DATABASE IF NOT EXISTS sheaf_pages LOCATION '%s'" % (tmp_path / "db"))
    for names in (("sheaf_pages.pages", "sheaf_pages.meta"), (None, None)):
        stored_pages, stored_meta = store.write_page_store(pages, meta, *names, block=5)
        assert sorted(map(tuple, store.store_meta(stored_meta).select("doc_id", "doc_name", "page_count", "status").collect())) == [
            (1, "a", 23, "completed"), (2, "b", 2, "completed"), (3, "empty", 0, "completed")]
        assert stored_pages.filter("doc_id = 1").select("block").distinct().count() == 5
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            back = store.read_store_pages(stored_pages, stored_meta)
            assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
            assert sorted((x.doc_id, x.page, x.content or "", x.page_count) for x in back.collect()) == [
                (1, p, f"p{p}", 23) for p in range(1, 24)] + [(2, 1, "", 2), (2, 2, "", 2)]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        wanted = spark.createDataFrame([(1, 4, 11), (2, 2, 9), (9, 1, 1)], "doc_id long, page_from int, page_to int")
        some = store.read_store_pages(stored_pages, stored_meta, wanted, block=5)
        assert sorted((x.doc_id, x.page) for x in some.collect()) == [(1, p) for p in range(4, 12)] + [(2, 2)]
    spark.sql("DROP DATABASE sheaf_pages CASCADE")
