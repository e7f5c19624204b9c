"""Groups of spelling variants by blocked Gram matrices of letter counts.

Words one edit apart have letter counts at a squared distance of 1 (one letter more) or 2 (one replaced). Words are filed by
cell: their length and how many letters fall in each of a few letter classes. Only the same cell and those that one edit can reach
hold partners: of the same length, with one letter moved to another class, and one letter longer, with one more in one class.
Cells are cut into blocks of bounded size by a hash; every pair of blocks that may hold partners is one row of a join. A pair
of blocks is one NumPy product of their letter counts, which gives all squared distances; pairs at the right
distance are then verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Letters of a word, and their code points in order.
LETTERS = "A-Za-zÀ-ÿ"
POINTS = [*range(97, 123), *range(0xC0, 0x100)]
LEAST_LENGTH, LEAST_COUNT, RATIO, DELETE = 6, 5, 5, 199
#: Letter classes (code point modulo) and words in a block; words a task counts before it hands them on; characters it takes at a time.
CLASSES, BLOCK, HELD, AT_ONCE = 5, 1024, 400_000, 2_000_000
#: Cells of a comparison of candidates at a time.
COMPARE = 4_000_000
NEAR = "word string, near string, near_n long"


def corpus_words(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, delete: int = DELETE) -> DataFrame:
    """(word, n) over all texts: lower-cased (A-Z) runs of letters, of which ``1 / delete`` have lost a letter, chosen by the crc32 of
    ``<doc_id>:<run>``; words of fewer than ``least`` letters are left out.

    Null and empty texts have no words; a null id reads as nothing before the colon; repeated rows count each; extra columns are ignored.
    """
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches):
        held = Counter()
        for batch in batches:
            for some in _pieces(batch):
                for i, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    head = zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                    for piece in _cut(t or ""):
                        for w, n in Counter(runs.findall(piece)).items():
                            low = w.lower() if w.isascii() else w.translate(_LOWER)
                            h = zlib.crc32(low.encode(), head)
                            if h % delete == 0:
                                at = h % len(low)
                                low = low[:at] + low[at + 1:]
                                if len(low) < least:
                                    continue
                            held[low] += n
                if len(held) > HELD:
                    yield _counts(held)
                    held = Counter()
        if held:
            yield _counts(held)

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_LOWER = {c: c + 32 for c in range(65, 91)}
_OTHER = re.compile(f"[^{LETTERS}]")


def _cut(text: str):
    """The text in pieces of about ``AT_ONCE`` characters that end between words."""
    at = 0
    while len(text) - at > AT_ONCE:
        m = _OTHER.search(text, at + AT_ONCE)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def _pieces(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // AT_ONCE)) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def _class_counts(word: Column) -> Column:
    """How many letters of a word are in each class."""
    groups = ["".join(chr(p) for p in POINTS if p % CLASSES == k) for k in range(CLASSES)]
    return F.array(*[F.length(word) - F.length(F.translate(word, g, "")) for g in groups])


def _reach(counts: Column) -> Column:
    """Cells that hold partners of a cell's words, each pair of cells from one side only: itself, a letter moved to a later class, a letter more."""
    moved = lambda ups, downs: F.transform(F.arrays_zip(counts.alias("c"), F.array(*[F.lit(int(k in ups) - int(k in downs)) for k in range(CLASSES)]).alias("d")),
                                           lambda x: x["c"] + x["d"])
    same = [moved({j}, {i}) for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    longer = [moved({k}, ()) for k in range(CLASSES)]
    return F.array(counts, *same, *longer)


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n), both ways, for words of ``words(word, n)`` that differ by exactly one inserted, deleted or replaced
    character. Words are distinct and made of ``LETTERS``, lower-cased."""
    name = lambda c: F.array_join(c.cast("array<string>"), ",")
    filed = words.select("word", "n", _class_counts(F.col("word")).alias("counts")).withColumn("cell", name(F.col("counts")))
    sizes = filed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks"))
    dealt = filed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("word"), F.col("n_blocks")).cast("int"))
    # A block's rows are as many as the parameter says, give or take the hash's spread.
    blocks = saved(dealt.groupBy("cell", "block").agg(F.first("counts").alias("counts"), F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"),
                                                      F.first("n_blocks").alias("n_blocks")))
    there = blocks.filter("block = 0").select(F.col("cell").alias("other"), F.col("n_blocks").alias("n_others"))
    reach = blocks.select("cell", "block", F.explode(F.transform(_reach(F.col("counts")), name)).alias("other"))
    meets = reach.join(there, "other").select("cell", "block", "other", F.explode(F.sequence(F.lit(0), F.col("n_others") - 1)).alias("other_block"))
    meets = meets.filter((F.col("cell") != F.col("other")) | (F.col("block") <= F.col("other_block")))
    right = blocks.select(F.col("cell").alias("other"), F.col("block").alias("other_block"), F.col("words").alias("others"), F.col("ns").alias("other_ns"))
    left = blocks.select("cell", "block", "words", "ns")
    pairs = meets.join(right, ["other", "other_block"]).join(left, ["cell", "block"])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b = r["words"], r["others"]
                alike = r["cell"] == r["other"] and r["block"] == r["other_block"]
                for i, j in _verified(a, b, alike):
                    rows = [(a[x], b[y], r["other_ns"][y]) for x, y in zip(i, j)] + [(b[y], a[x], r["ns"][x]) for x, y in zip(i, j)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))],
                                                         names=["word", "near", "near_n"])

    return pairs.select("cell", "block", "other", "other_block", "words", "ns", "others", "other_ns").mapInArrow(run, NEAR)


def _grid(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of equally long words, and their counts."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    columns = _COLUMN[codes]
    counts = np.bincount((columns + np.arange(len(words))[:, None] * len(POINTS)).ravel(), minlength=len(words) * len(POINTS))
    # Products of counts stay whole in single precision for all but very long words.
    return codes, counts.reshape(len(words), -1).astype(np.float32 if codes.shape[1] < 2000 else np.float64)


_COLUMN = np.zeros(256, np.int64)
_COLUMN[POINTS] = range(len(POINTS))


def _verified(a: list[str], b: list[str], alike: bool):
    """Index pairs one edit apart; words of ``a`` have one length, those of ``b`` the same or one more."""
    x, cx = _grid(a)
    y, cy = (x, cx) if alike else _grid(b)
    apart = (cx * cx).sum(axis=1)[:, None] + (cy * cy).sum(axis=1)[None, :] - 2 * (cx @ cy.T)
    wanted = 2 if x.shape[1] == y.shape[1] else 1
    i, j = np.nonzero(apart == wanted)
    if alike:
        once = i < j
        i, j = i[once], j[once]
    step = max(1, COMPARE // max(1, y.shape[1]))
    for at in range(0, len(i), step):
        p, q = i[at:at + step], j[at:at + step]
        u, v = x[p], y[q]
        if wanted == 2:
            fits = (u != v).sum(axis=1) == 1
        else:
            # Equal up to some place, and equal behind the letter that is more.
            head = np.cumprod(u == v[:, :-1], axis=1).sum(axis=1)
            tail = np.cumprod((u == v[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            fits = head + tail >= u.shape[1]
        yield p[fits].tolist(), q[fits].tolist()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of ``words(word, n)``.

    ``form`` is the near word of largest n (ties: smallest), if that is at least ``ratio`` times the word's own n; ``root`` is where forms
    lead. Every step multiplies n, so ways are no longer than the logarithm of the largest n; they are halved by joining
    roots to roots. Words without near words have n_near 0 and are their own root; an empty table gives no rows.
    """
    words = saved(words.select("word", "n"))
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    joined = words.join(best, "word", "left")
    holds = F.coalesce(-F.col("b.m") >= F.lit(ratio) * F.col("n"), F.lit(False))
    found = saved(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("b.near")).alias("form"),
                                F.when(holds, -F.col("b.m")).alias("form_n")))
    roots, most = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), found.agg(F.max("n")).first()[0] or 1
    steps, length = 1, 1
    while ratio ** length <= most:
        length += 1
    while steps < length:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = saved(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        steps *= 2
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def corpus_variants(documents: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``variants`` of the words of all texts that occur at least ``least_count`` times."""
    return variants(corpus_words(documents).filter(F.col("n") >= least_count))
