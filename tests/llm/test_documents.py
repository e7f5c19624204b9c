"""Operators on documents against plain versions, on awkward rows, with clashing columns, and on empty tables."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash

from sheaf.llm import decontaminate, ngrams, pii, quality, repeats, segments, simhash, token_planes
from sheaf.llm.common import components, shared_path

from helpers import DOCUMENTS, awkward, clashing, lower, words


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clashing(spark.createDataFrame(rows, DOCUMENTS).repartition(3))


@pytest.fixture(scope="module")
def none(spark):
    return clashing(spark.createDataFrame([], DOCUMENTS))


def test_quality_counts_and_keeping(docs, rows, none):
    rules = [[quality.Test("symbols_per_word", True, 0.2)]]
    got = [tuple(r) for r in quality.judge_documents(docs, rules).drop("rule").collect()]
    want, kept = [], []
    for row in rows:
        t, w = row[1] or "", words(row[1])
        windows = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        symbols = sum(c in "#*$%&|<>" for c in t)
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        keep = not failed and not symbols / len(w) > 0.2
        want.append((row[0], len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside), failed, keep))
        if keep:
            kept.append(row)
    same(got, want)
    same([tuple(r) for r in quality.keep(docs, rules).select("doc_id", "text", "lang", "source", "n_chars").collect()], kept)
    assert quality.keep(docs, rules).columns == docs.columns
    assert quality.judge_documents(none, rules).count() == 0


def test_decision_list_on_held_out_rows():
    rng = np.random.default_rng(1)
    def made(n):
        x = {f: rng.random(n) for f in quality.FEATURES}
        return x, ((x["upper"] > 0.7) & (x["n_words"] > 0.3)) | (x["repeated"] > 0.9)
    x, y = made(4000)
    rules = quality.cover(x, y, 0.95, 12, 4)
    x, y = made(4000)
    said = np.logical_or.reduce([quality._covers(x, r) for r in rules])
    assert (said == y).mean() > 0.97 and (said & ~y).mean() < 0.02


def test_learning_needs_both_classes(spark, docs, none):
    one = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, one) == [] and quality.learn(none, one) == []


def bits(text, n):
    w = [x.encode() for x in words(lower(text or ""))]
    h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + n]), 42) for k in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(n, linked):
    parent = list(range(n))
    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def test_simhash_classes(docs, rows, none):
    fps = [bits(r[1], 3) for r in rows]
    root = reach(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    least = collections.defaultdict(list)
    for r, g in zip(rows, root):
        least[g].append(r[0])
    want = [(r[0], f"{f:016x}", min((i for i in least[g] if i is not None), default=None)) for r, f, g in zip(rows, fps, root)]
    got = simhash.classes(docs)
    same([tuple(r) for r in got.select("doc_id", simhash.hex_digits(got["fp"]), "component_id").collect()], want)
    assert simhash.classes(none).count() == 0


def test_links_in_full_blocks(spark):
    rng = np.random.default_rng(3)
    near = {0}
    while len(near) < 400:
        near.add(int(rng.choice(list(near))) ^ 1 << int(rng.integers(40, 64)) ^ (1 << int(rng.integers(40, 64)) if rng.random() < .5 else 0))
    values = [x - (1 << 64) if x >> 63 else x for x in sorted(near)]
    edges = [tuple(r) for r in simhash.link(spark.createDataFrame([(v,) for v in values], "fp long"), 2).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 2 for a, b in edges)
    at = {v: i for i, v in enumerate(values)}
    known = {(max(at[a], at[b]), min(at[a], at[b])) for a, b in edges}
    assert reach(len(values), lambda a, b: ((values[a] ^ values[b]) & mask).bit_count() <= 2) == reach(len(values), lambda a, b: (a, b) in known)


def test_near_copies(spark, docs, none):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    made = []
    for i in range(150):
        w = list(base)
        for j in rng.integers(0, 300, i % 8):
            w[j] = f"new{i}x{j}"
        made.append((i, " ".join(w)))
    made += [(500 + i, " ".join(f"o{x}" for x in rng.integers(0, 9999, 60))) for i in range(5)]
    sets = [{tuple(words(lower(t))[k:k + 5]) for k in range(len(words(t)) - 4)} for _, t in made]
    root = reach(len(made), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    size = collections.Counter(root)
    want = [(made[i][0], made[g][0]) for i, g in enumerate(root) if size[g] > 1]
    same([tuple(r) for r in simhash.near_copies(spark.createDataFrame(made, "doc_id long, text string")).collect()], want)
    assert simhash.near_copies(none).count() == 0
    assert simhash.near_copies(docs).filter("keeper > doc_id").count() == 0


def copies_by_force(made):
    number = {}
    sets = []
    for _, t in made:
        w = words(lower(t))
        sets.append({number.setdefault(tuple(w[k:k + 5]), len(number)) for k in range(len(w) - 4)})
    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)
    root = reach(len(made), linked)
    size = collections.Counter(root)
    return [(made[i][0], made[g][0]) for i, g in enumerate(root) if size[g] > 1]


def test_near_copies_in_blocks_of_a_shared_passage(spark):
    rng = np.random.default_rng(6)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage, made = fresh(400), []
    for i in range(300):
        own = fresh(60)
        made.append((2 * i, " ".join(passage + own)) if i % 2 else (2 * i, " ".join(passage[:300] + own)))
        if i % 5 == 0:
            w = made[-1][1].split()
            for j in rng.integers(300, len(w), 3):
                w[j] = f"new{i}x{j}"
            made.append((2 * i + 1, " ".join(w)))
    # Copies of copies of a text with the passage: a chain over members that lead nothing.
    w = passage[:250] + fresh(250)
    for i in range(120):
        made.append((2000 + i, " ".join(w)))
        for j in rng.integers(0, 500, 4):
            w[j] = f"link{i}x{j}"
    same([tuple(r) for r in simhash.near_copies(spark.createDataFrame(made, "doc_id long, text string")).collect()], copies_by_force(made))


def join_rows(df):
    """Rows that the joins of an executed plan made."""
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        below = node.children()
        own = [node.metrics().apply("numOutputRows").value()] if "Join" in name else []
        return own + [n for i in range(below.size()) for n in walk(below.apply(i))]
    return walk(df._jdf.queryExecution().executedPlan())


def test_members_meet_the_leaders_of_a_block_in_one_row(spark):
    # 400 close texts share eight full blocks and their eight leaders; one leader is in the group of a member already, one is too short.
    leaders = [(-i, i % 4, 100 if i < 8 else 50, 7 if i == 1 else -i) for i in range(1, 9)]
    members = [(i, i % 3, 100, i) for i in range(1, 401)]
    schema = "t int, k long, salt int, id long, fp long, n long, root long"
    blocks = lambda rows: spark.createDataFrame([(t, 5, 0, *r) for t in range(8) for r in rows], schema)
    got = simhash._led(blocks(members), blocks(leaders), 20, 0.8)
    same([tuple(r) for r in got.collect()], [(m, h) for m, *_, g in members for h, _, n, root in leaders if root != g and n >= 80])
    assert sum(join_rows(got)) == 8 * len(members)


def test_word_hashes_are_those_of_the_words():
    rng = np.random.default_rng(8)
    letters = [bytes([c]) for c in b" \t\n\x0b\x0c\r\x00\x1c\x1d\x85\xa0\xe3\x80AZaz\xff\xc3"]
    for n in range(40):
        texts = [b"".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(0, 30))) for _ in range(n % 6)]
        split = [bytes(c + 32 if 65 <= c <= 90 else c for c in t).split() for t in texts]
        sizes, hashes = ngrams._word_hashes(texts)
        assert sizes.tolist() == [len(w) for w in split]
        assert hashes.tolist() == [xxhash.xxh64_intdigest(x) for w in split for x in w]


def test_questions_sort_no_places(monkeypatch):
    # Only totals need the place of every key: a question must not pay for it.
    monkeypatch.setattr(ngrams.np, "argsort", None)
    level = ngrams.Grams([b"a b a", b"", b"b a b"], 2).level(2)
    assert level.counts.tolist() == [2, 2] and not hasattr(level, "index")


def test_near_copies_with_a_repeated_phrase(spark):
    rng = np.random.default_rng(7)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    made = []
    for i in range(30):
        w, phrase = fresh(1000), fresh(6)
        made += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(w + phrase * 30)), (3 * i + 2, " ".join(w + phrase * 60))]
    fps = [bits(t, 5) for _, t in made]
    assert sum((fps[k] ^ fps[k + 1]).bit_count() > 20 for k in range(0, 90, 3)) > 5
    got = simhash.near_copies(spark.createDataFrame(made, "doc_id long, text string"))
    same([tuple(r) for r in got.collect()], [(i, i - i % 3) for i, _ in made])


def test_near_copies_that_share_no_minimum(spark):
    """A word is changed in every shingle that is a minimum of the first text: no block by minima holds both, yet 0.9 of their shingles agree."""
    rng = np.random.default_rng(9)
    made = []
    for i in range(3):
        w = [f"w{x}" for x in rng.integers(0, 10**9, 1200)]
        h = simhash.shingles_of(" ".join(w), 5)
        factors = [np.uint64(xxhash.xxh64_intdigest(f.to_bytes(8, "little"), 7) | 1) for f in range(8)]
        copy = list(w)
        for f in factors:
            copy[int((h * f).argmin()) + 2] = f"new{i}"
        made += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(copy))]
    documents = spark.createDataFrame(made, "doc_id long, text string")
    minima = {r.doc_id: r.minima for r in simhash.fingerprints(documents, 5, 8).collect()}
    assert all(x != y for i in range(3) for x, y in zip(minima[2 * i], minima[2 * i + 1]))
    same([tuple(r) for r in simhash.near_copies(documents).collect()], [(i, i - i % 2) for i in range(6)])


@pytest.mark.parametrize("full, spare", [(64, 0.5), (3, 0.5), (3, 0.0)])
def test_prefixes_lose_no_pair(spark, monkeypatch, full, spare):
    """Without minima all links come from prefixes: small and crowded blocks, sets that give most of their prefix up and are read again."""
    monkeypatch.setattr(simhash, "FULL", full)
    monkeypatch.setattr(simhash, "SPARE", spare)
    monkeypatch.setattr(simhash, "SPARE_ROWS", 2)
    rng = np.random.default_rng(10)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    lines, made = [fresh(int(n)) for n in rng.integers(5, 60, 6)], []
    for i in range(60):
        w = fresh(int(rng.integers(1, 120)))
        for j in rng.integers(0, 6, rng.integers(0, 4)):
            w += lines[j]
        for c in range(int(rng.integers(1, 4))):
            made.append((len(made), " ".join(w)))
            for j in rng.integers(0, len(w), max(1, len(w) // 60)):
                w[j] = f"new{i}x{c}x{j}"
    made = [(d, t) for d, t in made if len(t.split()) >= 5]
    want = copies_by_force(made)
    assert len(want) > 40
    rows = spark.createDataFrame(made, "doc_id long, text string")
    same([tuple(r) for r in simhash.near_copies(rows, minima=1).collect()], want)


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))} | {(i, i + 1) for i in range(300, 340)}
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    root = reach(len(nodes), lambda a, b: (nodes[a], nodes[b]) in pairs or (nodes[b], nodes[a]) in pairs)
    got = components(spark.createDataFrame([(a, b) for a, b in pairs], "a long, b long"))
    same([tuple(r) for r in got.collect()], [(n, nodes[r]) for n, r in zip(nodes, root)])


def test_containment(spark, docs, rows, none):
    items = [(1, rows[5][1]), (1, rows[5][1]), (2, "ALPHA"), (3, None), (4, ""), (5, "the of"), (None, rows[7][1]), (6, " ".join(words(rows[-1][1])[500:530]))]
    table = clashing(spark.createDataFrame(items, "item_id long, text string"))
    want = set()
    for item, t in set(items):
        w = words(lower(t or ""))
        k = min(5, len(w))
        s = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
        for r in rows:
            d = words(lower(r[1] or ""))
            n = len(s & {tuple(d[j:j + k]) for j in range(len(d) - k + 1)}) if w else 0
            if s and n >= math.ceil(0.8 * len(s) - 1e-9):
                want.add((r[0], item, len(s), n, r[1]))
    got = [tuple(r) for r in decontaminate.contained(docs, table).collect()]
    same(got, [x[:4] for x in want])
    left = decontaminate.without_items(docs, table)
    hit = {x[0] for x in want} - {None}
    assert left.columns == docs.columns and left.count() == sum(r[0] not in hit for r in rows)
    assert decontaminate.contained(none, table).count() == 0 and decontaminate.contained(docs, table.limit(0)).count() == 0


def test_token_planes(spark, docs, rows, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path, library = P.path("byte_bpe_50k.json"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    at, want = 0, []
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, (r[1] or "").encode()))):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for kind in ("byte", "bit"):
        place = shared_path(spark, "test")
        token_planes.write(docs, place, path, kind, block=64, chunk=500)
        same([tuple(r) for r in token_planes.digest(spark, place).collect()], want)
        assert token_planes.read(spark, place).count() == len(rows)
    place = shared_path(spark, "test")
    token_planes.write(none, place, path)
    assert token_planes.digest(spark, place).count() == 0


def test_repeated_passages(docs, rows, none):
    first = {}
    key = lambda i: repeats.LAST if i is None else i
    for r in rows:
        t = (r[1] or "").encode()
        for a in range(len(t) - 49):
            w = t[a:a + 50]
            first[w] = min(first.get(w, key(None)), key(r[0]))
    want = []
    for r in rows:
        t = (r[1] or "").encode()
        gone = bytearray(len(t))
        for a in range(len(t) - 49):
            if first[t[a:a + 50]] < key(r[0]):
                gone[a:a + 50] = b"\1" * 50
        runs = bytes(gone).split(b"\0")
        want.append((r[0], len(t), sum(gone), sum(map(bool, runs)), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    got = repeats.repeated_passages(docs).drop("starts", "ends")
    same([tuple(r) for r in got.collect()], want)
    assert repeats.repeated_passages(none).count() == 0


def test_interval_tree():
    strings = sorted([b"abcx", b"abcy", b"abd", b"abcy", b"b"])
    groups = {(p, tuple(strings[a:b])) for p, a, b in repeats.intervals(strings, 1) if b - a > 1}
    assert groups == {(2, (b"abcx", b"abcy", b"abcy", b"abd")), (3, (b"abcx", b"abcy", b"abcy")), (4, (b"abcy", b"abcy"))}


def test_stupid_backoff(docs, rows, none):
    counts = [collections.Counter() for _ in range(3)]
    split = [words(lower(r[1] or "")) for r in rows]
    for w in split:
        for n in (1, 2, 3):
            counts[n - 1].update(tuple(w[k:k + n]) for k in range(len(w) - n + 1))
    total, want = sum(map(len, split)), []
    for r, w in zip(rows, split):
        score, levels = 0, [0, 0, 0]
        for p in range(len(w)):
            held = min(p, 2)
            for n in range(held + 1, 0, -1):
                g = tuple(w[p - n + 1:p + 1])
                c = counts[n - 1][g]
                if n == 1 or c >= 2:
                    x = math.log(c / (total if n == 1 else counts[n - 2][g[:-1]])) + (held + 1 - n) * math.log(0.4)
                    score += math.floor(x * 1_000_000 + 0.5)
                    levels[n - 1] += 1
                    break
        want.append((r[0], len(w), levels, score))
    same([tuple(r) for r in ngrams.score_documents(docs).collect()], want)
    assert ngrams.score_documents(none).count() == 0


def test_segmentations(docs, rows, none):
    P = pytest.importorskip("public_tokenizers")
    model = P.path("piece_bpe_32k.model")
    got = segments.encode(docs, model, samples=3).collect()
    assert all(r.round_trip for r in got) and {(r.doc_id, r["sample"]) for r in got} >= {(r[0], 0) for r in rows}
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for i, g in collections.Counter(r.doc_id for r in got if r.doc_id is not None).items():
        some = {(r["sample"], tuple(r.ids)) for r in got if r.doc_id == i}
        assert len({ids for _, ids in some}) == len(some), texts[i]
    again = segments.encode(docs.repartition(7), model, samples=3).collect()
    same([tuple(r) for r in got], [tuple(r) for r in again])
    back = segments.decode(segments.encode(docs, model), model).select("doc_id", "text").distinct()
    same([tuple(r) for r in back.collect()], {(r[0], r[1] or "") for r in rows})
    assert segments.encode(none, model).count() == 0


def test_sampling_without_replacement():
    P = pytest.importorskip("public_tokenizers")
    pieces = segments.pieces_for(P.path("piece_bpe_32k.model"), 1.0)
    lattice = segments.Lattices(segments.units("thing"), pieces)

    def paths(node):
        if lattice.is_end[node]:
            yield (), 0.0
            return
        r = lattice.rank[node]
        for e in range(lattice.heads[r], lattice.tails[r]):
            for p, x in paths(lattice.stop[e]):
                yield (int(lattice.piece[e]), *p), x + lattice.log_p[e]

    exact = {p: math.exp(x) for p, x in paths(lattice.first[0])}
    assert abs(sum(exact.values()) - 1) < 1e-9
    n = 6000
    drawn = segments.sample_texts(list(range(n)), ["thing"] * n, pieces, 2)
    one = collections.Counter(tuple(r[0][0].tolist()) for r in drawn)
    two = collections.Counter(tuple(r[1][0].tolist()) for r in drawn)
    for p, x in exact.items():
        assert abs(one[p] / n - x) < 0.03
        assert abs(two[p] / n - sum(exact[q] * x / (1 - exact[q]) for q in exact if q != p)) < 0.03
    # Each path over its inclusion probability: the sum over paths has mean 1.
    assert abs(np.mean([sum(math.exp(x - y) for _, x, y in r) for r in drawn]) - 1) < 0.03
    whole = segments.sample_texts([1], ["a b"], pieces, 50)[0]
    assert len({tuple(i.tolist()) for i, _, _ in whole}) == len(whole) and abs(sum(math.exp(x) for _, x, _ in whole) - 1) < 1e-9
