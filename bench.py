"""Headline queries timed end to end; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8); ``python bench.py all`` times every query,
``python bench.py name...`` the named ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sheaf import plans
from sheaf.session import local_session

HEADLINE = (
    "keyword_page_search posting_index heuristic_rerank assemble_context vector_topk related_chunks familiarity "
    "alpha_mix_recall clean_html clean_html_nested extract_text page_metadata extract_links validate_page robots_allowed "
    "crawl_frontier dedup_url_key federated_search preprocess_query chunk_documents number_sections section_page_ranges "
    "page_window_context combine_page_text table_to_markdown pack_paragraphs parse_data_points extracted_memories "
    "trim_messages chunk_summaries repetition_guard fit_history memory_keyword_search memory_fifo upsert_latest "
    "progress_apply rate_window_counts rate_limit_admit span_rollup"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus))
    queries = plans.queries()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = sorted(queries)
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
