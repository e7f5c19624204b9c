"""Operators against plain loops on small data, with tiny blocks so that every split path runs."""

import datetime as dt
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf import fixed_values as fixed
from sheaf import plans
from sheaf.functions.skew import running
from sheaf.operators import bookkeeping as b
from sheaf.operators import conversations as c
from sheaf.operators import documents as d
from sheaf.operators import memory as m
from sheaf.operators import retrieval as r
from sheaf.operators import vectors as v
from sheaf.operators import web as w


def test_running_over_blocks(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < .6 else f"k{i % 5}", i, rng.randint(-9, 9)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, i int, x int")
    measures = {"s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.when(F.col("x") > 0, F.col("x")))}
    for descending in (False, True):
        for exclusive in (False, True):
            got = {(x.k, x.i): (x.s, x.lo, x.hi) for x in running(df, ["k"], "i", measures, block=7, descending=descending,
                                                                 exclusive=exclusive).collect()}
            for k, i, _ in data:
                seen = [x for kk, ii, x in data if kk == k and ((ii >= i if descending else ii <= i) and not (exclusive and ii == i))]
                pos = [x for x in seen if x > 0]
                assert got[k, i] == (sum(seen), min(seen, default=None), max(pos, default=None))


def test_keyword_search(spark):
    rng = random.Random(2)
    vocab = ["Alpha", "be", "gam,ma", "x", "alphabet", "no", "ma", "Straße", "été", "(q)"]
    pages = [(doc, p, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 6)))) for doc in range(12) for p in range(1, 26)]
    queries = [(1, "alpha ma x"), (2, "té bet (q)"), (3, "nothing"), (4, "STRASSE straße e"), (5, "")]
    pdf = spark.createDataFrame(pages, "doc_id long, page int, content string")
    qdf = spark.createDataFrame(queries, "query_id long, query string")
    want = []
    for qid, text in queries:
        scored = []
        for doc in range(12):
            for win in range(3):
                t = "\n".join(x for dd, p, x in pages if dd == doc and (p - 1) // 10 == win).lower()
                score = sum(k in t for k in set(text.lower().split()))
                if score:
                    scored.append((-score, doc, win))
        want += [(qid, n + 1, doc, win, -s) for n, (s, doc, win) in enumerate(sorted(scored)[:5])]
    got = r.keyword_page_search(pdf, qdf)
    assert sorted((x.query_id, x.rank, x.doc_id, x.win, x.score) for x in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))
    long = spark.createDataFrame([(1, 1, "x" * 700 + "needle" + "y" * 300), (2, 1, ""), (3, 1, None)], "doc_id long, page int, content string")
    found = r.keyword_page_search(long, spark.createDataFrame([(1, "needle"), (2, "y" * 290), (3, "z" * 900)], "query_id long, query string"))
    assert sorted((x.query_id, x.doc_id) for x in found.collect()) == [(1, 1), (2, 1)]
    assert r.keyword_page_search(long, qdf.limit(0)).collect() == []


def test_each_word_of_a_block_is_searched_once(spark, monkeypatch):
    """What is searched are the distinct words of blocks of text, not those of every page; windows get the same counts in any blocks."""
    rng = random.Random(4)
    vocab = ["alpha", "Beta", "gammadelta", "x", "delta\tma", "omega", "tab\u00a0bed"]
    rows = [(doc, p, " ".join(rng.choice(vocab) for _ in range(8))) for doc in range(60) for p in range(1, 16)] + [(99, 1, None), (99, 2, "")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, content string")
    wanted = [(1, "alpha"), (1, "madel"), (2, "x"), (2, "ta"), (3, "bed"), (3, "nowhere"), (4, "gammadeltas")]
    want = sorted((q, doc, win, n) for q in (1, 2, 3, 4) for doc in range(60) for win in (0, 1)
                  for n in [sum(t in "\n".join(x for d, p, x in rows if d == doc and (p - 1) // 10 == win).lower() for k, t in wanted if k == q)] if n)
    searched, held = [], r._held
    monkeypatch.setattr(r, "_held", lambda words_, numbered: searched.append(words_.count()) or held(words_, numbered))
    for block_bytes, most in ((1 << 20, 4), (5_000, 16)):
        got = r._substring_scores(pages, spark.createDataFrame(wanted, "query_id long, term string"), 10, block_bytes)
        assert sorted((x.query_id, x.doc_id, x.win, x.score) for x in got.collect()) == want
        assert searched[-1] <= most * len(vocab)


def test_scoring_tasks_grow_with_rows(spark):
    """What one task scores is bounded: more rows take more tasks, and a window's words are counted where they meet, without moving again."""
    rows = [(doc, 1, f"w{doc % 5} w{doc % 3} all") for doc in range(200)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, content string")
    queries = spark.createDataFrame([(1, "w1 all"), (2, "w2 w0 none")], "query_id long, query string")
    assert [r.scoring_tasks(pages, n) for n in (200, 10, 3)] == [4, 20, 67]
    answers = []
    for tasks in (1, 67):
        got = r.search_postings(r.posting_index(pages), queries, 7, tasks)
        answers.append(sorted(map(tuple, got.collect())))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert f"RepartitionByExpression [doc_id" in plan and f"], {tasks}" in plan
    want = [(q, doc, s) for q, ask in ((1, {"w1", "all"}), (2, {"w2", "w0", "none"})) for s, doc in sorted(
        (-len(ask & set(text.split())), doc) for doc, _, text in rows if ask & set(text.split()))[:7]]
    assert answers[0] == answers[1] and sorted((x[0], x[1], -x[3]) for x in answers[0]) == sorted(want)


def test_vector_paths_agree(spark):
    rng = np.random.default_rng(3)
    items = rng.integers(-2, 3, (90, 4)).astype(float)   # many exact ties
    df = spark.createDataFrame([(i, [float(z) for z in x]) for i, x in enumerate(items)], "item_id long, embedding array<double>")
    unit = items / (np.linalg.norm(items, axis=1, keepdims=True) + 1e-8)
    sims = np.round(unit @ unit.T, 6)
    want = []
    for i in range(90):
        order = sorted((j for j in range(90) if j != i), key=lambda j: (-sims[i, j], j))[:4]
        want += [(i, n + 1, j) for n, j in enumerate(order)]
    for options in ({}, {"pivots": 7, "block_rows": 20}, {"pivots": 1, "block_rows": 1000}, {"pivots": 90}):
        got = v.related_chunks(df, df, 4, **options).collect()
        assert sorted((x.query_id, x["rank"], x.item_id) for x in got) == want
    named = v.related_chunks(spark.createDataFrame([(7,), (7,), (500,)], "item_id long"), df, 4, pivots=10)
    assert sorted((x.query_id, x["rank"], x.item_id) for x in named.collect()) == [x for x in want if x[0] == 7]


def test_related_chunks_of_every_chunk(spark):
    """The query answers for every stored vector, not only for those that some search returned."""
    sf = "/root/testdata/sf0.01"
    got = plans.queries()["related_chunks"](spark, sf).groupBy("query_id").count()
    assert {x.query_id: x["count"] for x in got.collect()} == {x.vec_id: 5 for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}


def test_vector_search_by_product(spark):
    """Vectors of unequal length, a floor, copies, absent vectors, and no rows at all."""
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 4, (6, 8))
    items = np.concatenate([centre[rng.integers(0, 6, 300)] + rng.normal(0, .3, (300, 8)), np.tile(centre[0], (40, 1))])
    asked = centre + .1
    rows = [(i, [float(z) for z in x]) for i, x in enumerate(items)] + [(900, None), (901, [None] * 8)]
    df = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    qs = spark.createDataFrame([(i, [float(z) for z in x]) for i, x in enumerate(asked)] + [(77, None)], "query_id long, embedding array<double>")
    for threshold in (None, 150.0):
        want, sims = [], np.round(items @ asked.T, 6)
        for j in range(6):
            order = [i for i in sorted(range(340), key=lambda i: (-sims[i, j], i)) if threshold is None or sims[i, j] >= threshold][:9]
            want += [(j, n + 1, i) for n, i in enumerate(order)]
        for options in ({}, {"pivots": 20, "block_rows": 16}):
            got = v.vector_topk(df, qs, 9, threshold=threshold, normalise=False, **options)
            assert sorted((x.query_id, x["rank"], x.item_id) for x in got.collect()) == sorted(want)
    assert v.vector_topk(df.limit(0), qs, 3).collect() == [] and v.vector_topk(df, qs.limit(0), 3).collect() == []


def test_vectors_move_once_per_pair_of_blocks(spark, monkeypatch):
    """Without clusters every query visits every cell: it goes to a shelf once all the same, not to each of its cells, and an item to a part once."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (600, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(z) for z in v_]) for i, v_ in enumerate(x)], "item_id long, embedding array<float>")
    queries, items, real = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), v._best_of_cells

    def counted(wanted, held, *rest):
        queries.add(len(wanted))
        items.add(len(held))
        return real(wanted, held, *rest)

    monkeypatch.setattr(v, "_best_of_cells", counted)
    got = v.related_chunks(df, df, 3, pivots=64, block_rows=25).collect()     # at most 200 rows on a side
    unit = x.astype(np.float64) / (np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True) + 1e-8)
    sims = np.round(unit @ unit.T, 6)
    want = [(i, n + 1, j, sims[i, j]) for i in range(600)
            for n, j in enumerate(sorted((j for j in range(600) if j != i), key=lambda j: (-sims[i, j], j))[:3])]
    assert sorted((r_.query_id, r_["rank"], r_.item_id, r_.score) for r_ in got) == want
    assert 0 < queries.value <= 600 * 5 and 0 < items.value <= 600 * 3


def test_vector_search_leaves_far_cells(spark):
    """Of well separated groups a query meets the items of its own group only."""
    rng = np.random.default_rng(6)
    centre = np.eye(16)
    rows = [(i, [float(z) for z in centre[i % 16] + rng.normal(0, .01, 16)]) for i in range(3200)]
    df = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    seen = spark.sparkContext.accumulator(0)
    real = v._best

    def counted(wanted, items, *rest):
        seen.add(len(wanted) * len(items))
        return real(wanted, items, *rest)

    v._best = counted
    try:
        got = v.vector_topk(df, df.filter("item_id < 4").withColumnRenamed("item_id", "query_id"), 5).collect()
    finally:
        v._best = real
    assert len(got) == 20 and all(x.item_id % 16 == x.query_id % 16 for x in got)
    assert seen.value <= 4 * 3200 / 16


def test_number_sections_folds(spark):
    rng = random.Random(4)
    rows = [(doc, i + 1, rng.randint(1, 8), rng.choice(["t", " "]), rng.randint(0, 5)) for doc in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, seq int, level int, title string, page int")
    got = {(x.doc_id, x.seq): (x.structure, x.title, x.page_from) for x in d.number_sections(df, block=6).collect()}
    for doc in range(4):
        count, prev = [0] * 6, 0
        for _, seq, level, title, page in (x for x in rows if x[0] == doc):
            level = min(level, 6, prev + 1)
            count = count[:level - 1] + [count[level - 1] + 1] + [0] * (6 - level)
            prev = level
            assert got[doc, seq] == (".".join(map(str, count[:level])), title.strip() or f"Section {page}", max(1, page))


def test_section_ranges_recursive(spark):
    rng = random.Random(5)
    rows, page = [], {}
    for doc in range(4):
        p = 1
        for i in range(30):
            rows.append((doc, i + 1, rng.randint(1, 5), "t", p))
            p += rng.randint(0, 2)
        page[doc] = p + 3
    df = spark.createDataFrame(rows, "doc_id int, seq int, level int, title string, page int")
    numbered = d.number_sections(df)
    counts = spark.createDataFrame(list(page.items()), "doc_id int, page_count int")
    got = {(x.doc_id, x.structure): x.page_to for x in d.section_page_ranges(numbered, counts, block=5).collect()}
    tree = {(x.doc_id, x.structure): x.page_from for x in numbered.collect()}

    def assign(doc, names, end):
        for i, n in enumerate(names):
            stop = end if i + 1 == len(names) else max(tree[doc, n], tree[doc, names[i + 1]] - 1)
            assert got[doc, n] == stop
            assign(doc, kids(doc, n), stop)

    def kids(doc, parent):
        k = [s for dd, s in tree if dd == doc and s.rpartition(".")[0] == parent]
        return sorted(k, key=lambda s: int(s.rpartition(".")[2]))

    for doc in range(4):
        assign(doc, kids(doc, ""), page[doc])


def test_pack_paragraphs(spark):
    rng = random.Random(6)
    text = "\n\n".join("x" * rng.randint(0, 30) for _ in range(80))
    got = [x.content for x in d.pack_paragraphs(spark.createDataFrame([(1, text)], "doc_id int, text string"), 50).orderBy("part").collect()]
    packs = []
    for p in text.split("\n\n"):
        if packs and sum(map(len, packs[-1])) + len(p) < 50:
            packs[-1].append(p)
        else:
            packs.append([p])
    assert got == ["\n\n".join(x) for x in packs]


def test_pack_paragraphs_long_and_awkward(spark):
    """100,000 paragraphs of one text take seconds; null, empty, over-long paragraphs and extra columns."""
    long = "\n\n".join("x" * 1500 for _ in range(100_000))
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "y" * 90, "c"), (4, "\n\n", "d")], "doc_id long, text string, part string")
    got = sorted((x.doc_id, x.part, x.content) for x in d.pack_paragraphs(df, 50).collect())
    assert got == [(2, 0, ""), (3, 0, "y" * 90), (4, 0, "\n\n")]
    big = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x" * 1500 + "\n\n"), 99_999).alias("t")).select(
        "doc_id", F.concat("t", F.lit("x" * 1500)).alias("text"))
    started = time.time()
    x = d.pack_paragraphs(big).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars")).first()
    assert (x.n, x.chars) == (50_000, len(long) - 2 * 49_999) and time.time() - started < 30
    assert d.pack_paragraphs(df.limit(0)).collect() == []


def _admit(rows, limit, window, burst, burst_window):
    out, held = {}, {}
    for key, t, i in sorted(rows, key=lambda x: (x[1], x[2])):
        h = held.setdefault(key, [])
        ok = sum(x > t - window for x in h) < limit and sum(x > t - burst_window for x in h) < burst
        out[i] = ok
        if ok:
            h.append(t)
    return out


def test_rate_limit(spark):
    rng = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    rows, t = [], {"hot": 0.0, "a": 0.0, "b": 0.0}
    for i in range(600):
        k = "hot" if rng.random() < .7 else rng.choice("ab")
        t[k] += rng.choice([0, .1, .5, 1, 3, 90 if rng.random() < .1 else 2])
        rows.append((k, t[k], i))
    df = spark.createDataFrame([(k, t0 + dt.timedelta(seconds=x), i) for k, x, i in rows], "key string, ts timestamp, event_id long")
    got = {x.event_id: x.admitted for x in b.rate_limit_admit(df, 12, 60, 3, 1).collect()}
    micro = [(k, round(x * 1_000_000), i) for k, x, i in rows]
    assert got == _admit(micro, 12, 60_000_000, 3, 1_000_000)
    counts = {x.event_id: x.n_in_window for x in b.rate_window_counts(df, window_s=60).collect()}
    for k, x, i in micro:
        assert counts[i] == sum(kk == k and x - 60_000_000 < y <= x for kk, y, _ in micro)


def test_burst_default(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", t0 + dt.timedelta(milliseconds=40 * i), i) for i in range(12)], "key string, ts timestamp, event_id long")
    assert sorted(x.event_id for x in b.rate_limit_admit(df).filter("admitted").collect()) == list(range(10))


def test_span_rollup_chain_and_star(spark):
    rows = [(1, i, i - 1 if i else None, 1) for i in range(70)] + [(2, 1000 + i, 1000 if i else None, i) for i in range(40)]
    df = spark.createDataFrame([(a, s, p, 0.0, 1.5, "ok", n) for a, s, p, n in rows],
                               "trace_id long, span_id long, parent_id long, start_s double, end_s double, status string, tokens long")
    got = {x.span_id: x.total_tokens for x in b.span_rollup(df).collect()}
    assert all(got[i] == 70 - i for i in range(70)) and got[1000] == sum(range(40)) and got[1007] == 7


def test_crawl_order(spark):
    edges = {0: [3, 1, 2], 1: [4, 0], 2: [4, 5], 3: [6, 5], 4: [7], 6: [8]}
    links = spark.createDataFrame([(s, x, o) for s, xs in edges.items() for o, x in enumerate(xs)], "src long, dst long, ord int")
    starts = spark.createDataFrame([(0,)], "start long")
    out = w.crawl_frontier(links, starts, max_depth=2, max_pages=6)
    got = [(x.url_id, x.depth) for x in sorted(out.collect(), key=lambda x: (x.depth, x.place))]
    assert got == [(0, 0), (3, 1), (1, 1), (2, 1), (6, 2), (5, 2)]


def plain_crawl(start, edges, allowed, failed, max_pages, max_depth):
    """The queue itself, one start at a time."""
    queue, seen, out = [(start, 0)], set(), []
    while queue and (max_pages is None or len(out) < max_pages):
        url, depth = queue.pop(0)
        if url in seen or depth > max_depth or url not in allowed:
            continue
        seen.add(url)
        if url in failed:
            continue
        out.append((url, depth))
        if depth < max_depth:
            new = [x for x in dict.fromkeys(edges.get(url, [])) if x not in seen]
            queue += [(x, depth + 1) for x in (new if max_pages is None else new[:max_pages - len(out)])]
    return [(start, u, d, i) for i, (u, d) in enumerate(out)]


@pytest.mark.parametrize("max_pages,max_depth", [(None, 4), (1, 2), (5, 3), (12, 3)])
def test_crawl_is_the_queue(spark, monkeypatch, max_pages, max_depth):
    monkeypatch.setattr(w, "QUEUE_BLOCK", 2)   # many blocks
    rng = random.Random(5)
    edges = {s: [rng.randrange(40) for _ in range(rng.choice([0, 2, 5, 14]))] for s in range(40)}
    edges[3] = list(range(40)) * 2
    allowed, failed = {x for x in range(40) if x % 7 != 4}, {x for x in range(40) if x % 9 == 2}
    rows = [(s, x, o) for s, xs in edges.items() for o, x in enumerate(xs)] + [(1, None, 3), (None, 1, 0)]
    links = spark.createDataFrame(rows, "src long, dst long, ord int")
    ids = lambda xs, name: spark.createDataFrame([(x,) for x in xs], f"{name} long")
    out = w.crawl_frontier(links, ids([*range(40), 0, None, 99], "start"), max_depth, max_pages, ids(allowed, "url_id"), ids(failed, "url_id"))
    got = sorted((x.start, x.url_id, x.depth, x.place) for x in out.collect())
    assert got == sorted(r for s in range(40) for r in plain_crawl(s, edges, allowed, failed, max_pages, max_depth))


def test_crawl_of_nothing(spark):
    links = spark.createDataFrame([], "src long, dst long, ord int")
    one = spark.createDataFrame([(7,)], "start long")
    assert [tuple(r) for r in w.crawl_frontier(links, one, 3).collect()] == [(7, 7, 0, 0)]
    assert w.crawl_frontier(links, one.limit(0), 3, 5).collect() == []


# --- conversations ----------------------------------------------------------------------------------

def tok(t):
    return max(1, len(t) // 4)


def cost(ms):
    return 3 + sum(4 + tok(m[1]) for m in ms)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    out = {}
    for conv in range(9):
        n = rng.choice([0, 1, 3, 7, 18, 30, 45])
        roles = [("system" if i == 0 and conv % 2 else ("user", "assistant")[i % 2]) for i in range(n)]
        out[conv] = [(ro, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + rng.choice([". end", "", "\nmore"])) for ro in roles]
    return out


def frame(spark, talks):
    return spark.createDataFrame([(k, i, ro, t) for k, ms in talks.items() for i, (ro, t) in enumerate(ms)],
                                 "conv_id long, turn long, role string, text string")


def newest_within(ms, budget):
    kept, used = [], 0
    for m in reversed(ms):
        if used + cost([m]) > budget:
            break
        kept.append(m)
        used += cost([m])
    return kept[::-1]


def trimmed(ms, budget):
    if cost(ms) <= budget:
        return ms
    lead = ms[:1] if ms and ms[0][0] == "system" else []
    return lead + newest_within(ms[len(lead):], budget - (cost(lead) if lead else 0))


def test_trim(spark, talks):
    df = frame(spark, talks)
    budgets = spark.createDataFrame([(k, 400) for k in talks], "conv_id long, budget int")
    got = c.trim_messages(df, budgets, block=4).orderBy("conv_id", "turn").collect()
    for k, ms in talks.items():
        kept = [(x.role, x.text) for x in got if x.conv_id == k]
        assert kept == trimmed(ms, 400)


def sentence(t):
    for ch in "。！？\n":
        t = t.replace(ch, ".")
    return t.split(".")[0].strip()


def points(ms, user, answer, a_label):
    out = []
    for ro, t in ms:
        s = sentence(t)
        lim = user if ro == "user" else answer
        if len(s) > lim:
            s = s[:lim] + "..."
        if ro == "user" and s:
            out.append("User asked: " + s)
        elif ro == "assistant" and len(s) > 10:
            out.append(a_label + s)
    return out


def test_build_messages(spark, talks):
    size, reserve, p = 6144, 4096, 6
    prompts = {k: f"Base {k}. You must be kind. Never lie. you MUST be kind. Bye" for k in talks}
    asks = {k: ("alpha beta gamma delta" if k % 3 else " ".join(w for ro, t in ms[:1] for w in t.split()) or "hm") for k, ms in talks.items()}
    rag = {k: ("\n---\n".join(t for _, t in talks[(k + 4) % 9]) or None) for k in talks}
    mem = {k: ("[Raw Conversation] m" if k % 2 else None) for k in talks}
    req = spark.createDataFrame([(k, prompts[k], asks[k], mem[k], rag[k]) for k in talks],
                                "conv_id long, system_prompt string, message string, memory_context string, rag_context string")
    final, meta = c.build_messages(req, frame(spark, talks), context_size=size, reserve=reserve, messages_per_chunk=p, threshold=0.3)
    got = final.orderBy("conv_id", "pos").collect()
    facts = {x.conv_id: x for x in meta.collect()}
    stops = set(fixed.DEDUP_STOP_WORDS)
    bag = lambda t: {z for z in "".join(ch if ch.isalnum() or ch == "_" else " " for ch in t.lower()).split() if z not in stops and len(z) > 1}
    for k, ms in talks.items():
        turns = sum(ro != "system" for ro, _ in ms)
        total = size - reserve - (tok(prompts[k]) + 10) - (tok(asks[k]) + 4)
        depth = min(1.0, max(0.0, (turns - 5) / 45))
        ins, summ, rec = min(int(total * .03), 200), int(total * (0.05 + depth * 0.15)), int(total * .12)
        ded, ragb = (int(total * .05) if turns > 10 else 0), int(total * .15)
        verb = max(0, int(total * (.6 + depth * (.4 - .6))) - ins - summ - rec - ded - ragb)
        chunks = []
        for i in range(turns // (p // 2)):
            part = ms[i * p:(i + 1) * p]
            if part:
                s = " | ".join(points(part, 80, 100, "Answered: ")[:6])
                chunks.append((i * (p // 2), (i + 1) * (p // 2), s[:600] if tok(s) > 150 else s))
        lines = [f"[Turns {a}-{z}]: {s}" for a, z, s in chunks]
        blocks = []
        if len(chunks) >= 2:
            o = "\n\n".join(lines)
            blocks.append(fixed.OVERVIEW_HEADING + (o[:1200] if tok(o) > 300 else o))
        near = max(4, verb // 200) // (p // 2) * (p // 2)
        blocks += [ln for ln, ch in zip(lines, chunks) if ch[0] < near]
        out = [("system", prompts[k]), ("system", fixed.RULES_HEADING + "- must be kind.\n- Never lie.")]
        if blocks:
            s = "\n\n".join(blocks)
            out.append(("system", fixed.SUMMARY_HEADING + (s[:summ * 4] if tok(s) > summ else s)))
        if mem[k]:
            out.append(("system", fixed.MEMORY_HEADING + mem[k] + fixed.MEMORY_FOOTER))
        out.append(("system", fixed.ATTENTION_GUIDANCE))
        if rag[k]:
            pair = lambda t: [("user", fixed.RAG_HEADING + t), ("assistant", fixed.RAG_REPLY)]
            full = pair(rag[k])
            if cost(full) >= ragb:
                bs = [x.strip() for x in rag[k].split("\n---\n") if x.strip()]
                full = pair(rag[k][:ragb * 4]) if len(bs) <= 2 else pair((lambda t: t[:ragb * 4] if tok(t) > ragb else t)("\n\n---\n\n".join(sandwich(asks[k], bs))))
            out += full
        left = total - cost(out)
        assert left > 0 and facts[k].system_tokens == cost(out)
        skip = len(chunks) * p if len(chunks) * p < len(ms) else 0
        recent = ms[skip:]
        fits = cost(recent) <= left - rec
        kept = recent if fits else newest_within(recent, left - rec)
        if len(kept) > 4:
            best = set(ranked(asks[k], [f"{ro}: {t[:200]}" for ro, t in kept])[:len(kept) // 2])
            out += [m for i, m in enumerate(kept) if i in best] + [m for i, m in enumerate(kept) if i not in best]
        else:
            out += kept
        q, similar = bag(asks[k]), []
        us, as_ = [t for ro, t in ms if ro == "user"], [t for ro, t in ms if ro == "assistant"]
        for u, a in list(zip(us[::-1], as_[::-1]))[:10]:
            o = bag(u)
            sim = len(q & o) / len(q | o) if q and o else 0
            if sim >= .3:
                brief = a[:150].replace("\n", " ").strip()
                similar.append(f"{len(similar) + 1}. You already answered about '{u[:80]}' (similarity: {sim:.0%}): {brief + '...' if len(brief) >= 150 else brief}")
        if similar:
            out += [("system", fixed.REPEAT_HEADING + "\n".join(similar[:3])), ("system", fixed.ANTI_REPETITION)]
        if len(kept) >= (6 if fits else 4):
            pts = points(kept, 120, 150, "Assistant: ")[:8]
            if pts:
                t = fixed.RECAP_HEADING + "\n".join("- " + x for x in pts)
                out.append(("system", t[:rec * 4] if tok(t) > rec else t))
        out.append(("user", asks[k]))
        assert [(x.role, x.content) for x in got if x.conv_id == k] == trimmed(out, size - reserve)
        assert facts[k].dedup_triggered == bool(similar) and facts[k].hierarchical_chunks == len(chunks)
        assert facts[k].was_compressed == (len(kept) < len(ms)) and facts[k].turn_count == turns


def ranked(query, texts):
    q = set(query.lower().split())
    scores = []
    for i, t in enumerate(texts):
        low = t.lower()
        ts = set(low.split())
        edge = 0.1 if len(texts) > 2 and i in (0, len(texts) - 1) else 0
        scores.append((-round(len(q & ts) / max(len(q | ts), 1) * .5 + sum(low.count(z) for z in q) / max(len(ts), 1) * .4 + edge, 9), i))
    return [i for _, i in sorted(scores)]


def sandwich(query, texts):
    order = ranked(query, texts)
    n = len(order)
    third = max(1, n // 3)
    rest = n - 3 * third
    b0, m0 = third + (rest >= 1), 2 * third + (rest >= 2)
    return [texts[i] for i in order[:b0] + order[m0:] + order[b0:m0]]


def test_memory_by_vector_then_words(spark):
    """Each query sees its owner; without a vector on either side words decide; ties, disabled entries, types, copies."""
    rng = random.Random(8)
    vec = lambda: [float(rng.randint(-2, 2)) for _ in range(3)]
    words_ = "alpha beta gamma delta kappa".split()
    entries = [(f"e{i}", i, i % 4, " ".join(rng.choices(words_, k=4)), [rng.choice(words_)], None if i % 4 == 2 or i % 5 == 0 else vec(),
                i % 7 != 0, rng.choice(["raw", "semantic"])) for i in range(120)]
    entries += [("hole", 500, 0, "alpha", [], [1.0, None, 0.0], True, "raw"), ("none", 501, 0, None, None, [], True, "raw")]
    queries = [(j, j % 5, " ".join(rng.choices(words_, k=2)), None if j % 3 == 0 else vec()) for j in range(30)] + [(99, 1, None, None), (98, None, "alpha", vec())]
    edf = spark.createDataFrame(entries, "id string, seq long, owner long, content string, keywords array<string>, embedding array<double>, enabled boolean, type string")
    qdf = spark.createDataFrame(queries, "query_id long, owner long, query string, embedding array<double>")

    def terms(text):
        return {re.sub(r"^[,.!?;:()\[\]{}]+|[,.!?;:()\[\]{}]+$", "", w.lower()) for w in (text or "").split() if len(w) > 2}

    def whole(v):
        return bool(v) and None not in v

    want = []
    for query_id, owner, text, q in queries:
        mine = [e for e in entries if e[2] == owner]
        if whole(q) and any(whole(e[5]) for e in mine):
            length = lambda v: np.linalg.norm(v) + 1e-8
            hits = [(round(float(np.dot(e[5], q)) / (length(e[5]) * length(q)), 6) + 0.0, e) for e in mine if whole(e[5])]
        else:
            sets = [(terms((e[3] or "") + " " + " ".join(e[4] or [])), e) for e in mine]
            hits = [(round(len(t & terms(text)) / (len(t) + 1), 9), e) for t, e in sets if t & terms(text)]
        hits.sort(key=lambda h: (-h[0], h[1][1], h[1][0]))
        want += [(query_id, n + 1, h[1][0], h[0]) for n, h in enumerate(hits[:6])]
    hits = m.memory_vector_search(edf, qdf, 6)
    assert sorted((x.query_id, x["rank"], x.id, x.score + 0.0) for x in hits.collect()) == sorted(want)
    by_id = {e[0]: e for e in entries}
    kept = {}
    for query_id, _, entry, score in want:
        if by_id[entry][6] and by_id[entry][7] == "semantic":
            kept.setdefault(query_id, []).append(entry)
    got = m.memory_retrieve(edf.drop("embedding", "owner"), hits, 3, "semantic").orderBy("query_id", "rank").collect()
    shown = {}
    for x in got:
        shown.setdefault(x.query_id, []).append(x.id)
    assert shown == {k: v_[:3] for k, v_ in kept.items()}
    assert m.memory_vector_search(edf.limit(0), qdf, 3).collect() == [] and m.memory_vector_search(edf, qdf.limit(0), 3).collect() == []
