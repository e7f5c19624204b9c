"""Spelling variants, vector codes and prefix tokens against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCUMENTS, awkward, clashing, lower

from sheaf.llm import prefix_bpe, spelling, vector_codes
from sheaf.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_words(rows):
    n = Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return n


def plain_variants(n):
    """Near words by the forms that one deletion leaves."""
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1:], i].add(w)
            if w[:i] + w[i + 1:] in n:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def test_variants_of_the_corpus(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n = {w: k for w, k in plain_words(rows).items() if len(w) >= 6 and k >= 5}
    assert sorted(tuple(r) for r in QUERIES["op11_letter_gram"](spark, SF).collect()) == plain_variants(n)


def test_variants_of_close_words(spark):
    """Anagrams, chains of forms, ties, repeated letters, long words and small blocks."""
    rng = random.Random(3)
    n = {w: rng.choice([5, 5, 30, 200, 2000]) for w in
         {"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(400)} | {"stream", "master", "maters", "streams", "y" * 3000, "y" * 3001, "z" + "y" * 2999}}
    df = spark.createDataFrame([(w, k) for w, k in n.items()], "word string, n long")
    assert sorted(tuple(r) for r in spelling.variants(df).collect()) == plain_variants(n)
    pairs = lambda block: sorted(map(tuple, spelling.near_pairs(df, block=block).collect()))
    assert pairs(7) == pairs(1000)
    chain = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "abjihg": 3125, "akjihg": 15625}
    got = spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()
    assert {r.root for r in got} == {"akjihg"} and sorted(map(tuple, got)) == plain_variants(chain)


def test_variants_of_awkward_rows(spark):
    rows = [(r[0], (r[1] or "") * 3 if i % 7 else r[1], *r[2:]) for i, r in enumerate(awkward())]
    rows += [(5, "ÀBCDEFG Colour colour colours COLOUR×x colour÷ " * 9, None, None, None), (None, "null colours " * 40, None, None, None)]
    df = clashing(spark.createDataFrame(rows, DOCUMENTS)).withColumnRenamed("h", "word").withColumnRenamed("w", "cell")
    n = {w: k for w, k in plain_words(rows).items() if len(w) >= 6 and k >= 5}
    assert sorted(tuple(r) for r in spelling.corpus_variants(df).collect()) == plain_variants(n)
    assert spelling.corpus_variants(df.limit(0)).collect() == []
    assert "".join(spelling._cut("word " * 900_000)) == "word " * 900_000 and len(list(spelling._cut("word " * 900_000))) == 3


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    good = [r for r in kept if len(r[1]) == width]
    each = width // parts
    cut = lambda v, p: v[p * each:(p + 1) * each]
    books = [[cut(r[1], p) for r in good[:entries]] for p in range(parts)]

    def nearest(x, book):
        ds = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return ds.index(min(ds)), min(ds)

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for r in good:
                held[nearest(cut(r[1], p), books[p])[0]].append(cut(r[1], p))
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e])] if e in held else b for e, b in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], defaultdict(int)
    for i, v, lab in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)] if len(v) == width else None
        err = sum(d for _, d in found) if found else None
        total[lab] += err or 0
        out.append((i, "".join(f"{k:02x}" for k, _ in found) if found else None, err, lab))
    big = {lab for _, c, e, lab in out if c and e >= 1 << 63} | {lab for lab, t in total.items() if t >= 1 << 63}
    empty = {lab for _, _, _, lab in out} - {lab for _, c, _, lab in out if c}
    fix = lambda e: None if e is None or e >= 1 << 63 else e
    return sorted(((i, c, fix(e), None if lab in big | empty else total[lab], sha) for i, c, e, lab in out), key=repr)


def coded(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_codes_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert coded(QUERIES["op12_value_dictionaries"](spark, SF)) == plain_codes(rows)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed, n=60, width=16, big=False):
    rng = random.Random(seed)
    pick = lambda: rng.choice([0.0, -0.0001, 0.25, -0.25, 1.0]) if rng.random() < 0.7 else rng.uniform(-1, 1)
    rows = [(rng.randint(0, 40) if rng.random() < 0.95 else None, [float(np.float32(pick())) for _ in range(width)], rng.choice([None, 1, 2])) for _ in range(n)]
    rows += [rows[0], rows[0], (1, None, 1), (2, [None] * width, 1), (3, [float("nan")] * width, None), (4, [float("-inf")] + [0.0] * (width - 1), 2), (50, [0.5] * 3, 7), (51, [], 1)]
    if big:
        rows += [(60, [float(np.float32(3e38))] + [0.0] * (width - 1), 9), (61, [float(np.float32(-3e38))] + [1e6] * (width - 1), 1), (62, [float(np.float32(1e5))] * width, 8)]
    return rows


@pytest.mark.parametrize("big", [False, True])
def test_codes_of_awkward_rows(spark, big):
    rows = vectors(1, big=big)
    df = spark.createDataFrame(rows, VECTORS)
    assert coded(vector_codes.compress(clashing(df).withColumnRenamed("w", "code").withColumnRenamed("h", "_label"))) == plain_codes(rows)
    few = vectors(2, n=5)
    assert coded(vector_codes.compress(spark.createDataFrame(few, VECTORS))) == plain_codes(few)
    assert vector_codes.compress(df.limit(0)).collect() == []
    assert {r.code for r in vector_codes.compress(spark.createDataFrame([(1, [0.5] * 3, 7)], VECTORS)).collect()} == {None}


def test_codes_decode(spark):
    books = [np.array([[0, 4096], [2048, -4096]])] * 8
    got = vector_codes.decode(spark.createDataFrame([(1, "00" * 7 + "01"), (2, None)], "vec_id long, code string"), books).collect()
    assert {r.vec_id: r.vector for r in got} == {1: [0.0, 1.0] * 7 + [0.5, -1.0], 2: None}


@pytest.fixture(scope="module")
def ranks():
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(path), special_tokens={})
    return path, P.PATTERN, library


def plain_tokens(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_tokens_of_the_table(spark, ranks):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_prefix_tokens"](spark, SF).collect()), key=repr) == plain_tokens(ranks[2], rows)


#: Blanks of all kinds next to each other, contractions, runs, and characters that libraries of other Unicode versions class apart.
BITS = ["a", "b", "the", "'s", "'", " ", " ", "  ", "\n", "\t", "1", "23", "é", "日本", "x", "!", "...", "　", " ", "\x1c", "\x85", "A", "aa", "🙂",
        "<|endoftext|>", "ഃ", "՘", "₏", "\U00010940", "½", "don't"]


def test_tokens_of_awkward_rows(spark, ranks):
    path, pattern, library = ranks
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30)))) for i in range(3000)]
    rows += [(None, "no id"), (1, None), (1, ""), (2, "ab" * 20_000), (3, " " * 5000), (3, "word " * 50_000), (3, "word " * 50_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumnRenamed("h", "ids")
    encoded = prefix_bpe.encode(df, path, pattern)
    assert sorted((tuple(r) for r in prefix_bpe.digest(encoded, path).collect()), key=repr) == plain_tokens(library, rows)
    assert sorted((r.doc_id or -1, bytes(r.bytes)) for r in prefix_bpe.decode(encoded, path).collect()) == sorted((i or -1, (t or "").encode()) for i, t in rows)
    empty = prefix_bpe.encode(df.limit(0), path, pattern)
    assert empty.collect() == [] and prefix_bpe.digest(empty, path).collect() == [] and prefix_bpe.decode(empty, path).collect() == []


def test_edits_and_appends(spark, ranks):
    path, pattern, library = ranks
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice(BITS) for _ in range(rng.randint(0, n)))
    rows = [(i, text(25)) for i in range(1500)]
    changes = [(i, len(rows[i][1]) if i % 3 == 0 else rng.randint(0, 40), 0 if i % 3 == 0 else rng.randint(0, 5), text(4)) for i in range(1400)]
    changes += [(1450, None, None, None), (None, 0, 0, "x"), (9999, 0, 0, "x")]
    want = dict(rows)
    for i, at, n, new in changes[:1400]:
        at = min(at, len(want[i]))
        want[i] = want[i][:at] + new + want[i][at + n:]
    state = prefix_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, pattern, states=True)
    got = prefix_bpe.edit(state, spark.createDataFrame(changes, "doc_id long, start int, removed int, added string"), path, pattern).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows)
    assert all(r.ids == library.encode_ordinary(r.text) for r in got)
    fresh = prefix_bpe.encode(spark.createDataFrame(list(want.items()), "doc_id long, text string"), path, pattern, states=True).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, fresh), key=repr)


def test_a_prefix_has_one_last_token(ranks):
    """The table's tokens are those that encoding each prefix anew ends in."""
    encoder = prefix_bpe.encoder_for(*ranks[:2])
    for word in ("internationalization", "aaaaaaaaaaaaa", "übermäßigerweise", "日本語日本"):
        piece = word.encode()
        last = encoder.table(piece)
        assert [encoder.read_off(last[:i + 1]) for i in range(len(piece))] == [ranks[2]._encode_single_piece(piece[:i + 1]) for i in range(len(piece))]
        assert encoder.table(piece, last[:7]) == last
