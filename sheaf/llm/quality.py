"""Quality rules: a decision list learned from labelled statistics, emitted as an ordered Spark conditional.

Statistics of a text are column expressions. From a bounded sample of labelled rows, sequential covering grows
conjunctions of thresholds that pick out bad documents, prunes each on rows it was not grown on, and
keeps it only while it stays precise there; rows that a kept rule covers leave the sample before the next one
grows. The list becomes ``CASE WHEN rule 1 THEN .. WHEN rule 2 THEN ..``: one narrow pass over the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, shingle_hashes, text_of, words

#: Labelled rows a list is learned from: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Base rule: fewer words than this, or more than this share (in hundredths) of repeated words, fails.
LEAST_WORDS, MOST_REPEATED = 10, 20


def counts(text: Column) -> list[Column]:
    """Words, lines that hold a word, and character counts of a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0)
    removed = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return [
        words(text).alias("_words"), lines.alias("_lines"),
        F.length(F.translate(text, BLANK_CHARS, "")).cast("long").alias("word_chars"),
        removed(SYMBOLS).cast("long").alias("n_symbols"),
        removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        removed("0123456789").cast("long").alias("n_digits"),
        removed(".!?").cast("long").alias("n_ends"),
    ]


def _sorted_windows(windows: Column) -> Column:
    """(window, place) pairs in order where some window occurs twice, else null."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(windows) > F.size(F.array_distinct(windows)), pairs)


def _repeated_places(pairs: Column) -> Column:
    """Places of windows that have a neighbour with the same window; ``pairs`` must be a plain column, read by position."""
    same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))  # noqa: E731  get() is null outside
    return F.sort_array(F.transform(F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"]))


def _covered_words(places: Column, width: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, first occurrences included; null places: none."""
    fold = F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-1_000_000).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")))
    return F.coalesce(fold["n"], F.lit(0)).cast("long")


def statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, base counts and the ratios that rules test. Null text has no words; ratios of nothing are 0."""
    raw = documents.select(F.col(key).alias("doc_id"), *counts(text_of(text)))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    n = F.size("_words").cast("long")
    # Steps, so that each array is made once and read by everything behind it.
    windows = raw.select("*", shingle_hashes(F.col("_words"), WINDOW).alias("_windows"))
    paired = windows.select("*", _sorted_windows(F.col("_windows")).alias("_pairs"))
    flat = paired.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered_words(_repeated_places(F.col("_pairs"))).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"), "n_upper", "n_digits", "n_ends",
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"))
    return flat.select(
        "*",
        share(F.col("word_chars"), F.col("n_words")).alias("mean_word"),
        share(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_lines"),
        share(F.col("n_repeat_words"), F.col("n_words")).alias("repeated"),
        share(F.col("n_upper"), F.col("word_chars")).alias("upper"),
        share(F.col("n_digits"), F.col("word_chars")).alias("digits"),
        share(F.col("n_ends"), F.col("n_words")).alias("ends_per_word"),
        share(F.col("n_distinct"), F.col("n_words")).alias("distinct_words"))


FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_lines", "repeated", "upper", "digits", "ends_per_word", "distinct_words")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and label of at most ``rows`` labelled documents, chosen by the hash of their id before any text is read."""
    chosen = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # The sample's bound is the size bound of what is broadcast.
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return statistics(texts).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", *FEATURES)


def learn(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, precision: float = 0.95,
          max_rules: int = 12, max_tests: int = 4) -> list[list[Test]]:
    """The ordered list of conjunctions that reject; empty without rows of both classes.

    ``precision`` is asked of a rule on the rows it was not grown on, as a lower bound (Wilson, one deviation).
    """
    got = sorted(tuple(r) for r in labelled_sample(documents, labels, rows).collect())
    if not got:
        return []
    y = np.array([r[1] == 0 for r in got])
    x = {f: np.array([r[2 + i] for r in got], dtype=float) for i, f in enumerate(FEATURES)}
    return cover(x, y, precision, max_rules, max_tests)


def cover(x: dict[str, np.ndarray], y: np.ndarray, precision: float, max_rules: int, max_tests: int) -> list[list[Test]]:
    """Sequential covering: grow on two thirds, prune on one third, keep precise rules, drop covered rows, repeat."""
    left = np.ones(len(y), bool)
    fold = np.arange(len(y)) % 3
    out: list[list[Test]] = []
    while len(out) < max_rules and (y & left).any() and (~y & left).any():
        grow, prune = left & (fold != (len(out) % 3)), left & (fold == (len(out) % 3))
        rule = _prune(x, y, prune, _grow(x, y, grow, max_tests))
        hit = _covers(x, rule) & left
        held = hit & prune
        if not rule or _lower_bound((y & held).sum(), held.sum()) < precision and _lower_bound((y & hit).sum(), hit.sum()) < precision:
            break
        out.append(rule)
        left &= ~hit
    return out


def _covers(x: dict[str, np.ndarray], rule: list[Test]) -> np.ndarray:
    n = len(next(iter(x.values())))
    return np.logical_and.reduce([t.rows(x) for t in rule]) if rule else np.zeros(n, bool)


def _lower_bound(hits: int, n: int) -> float:
    if not n:
        return 0.0
    p = hits / n
    return (p + 1 / (2 * n) - np.sqrt(p * (1 - p) / n + 1 / (4 * n * n))) / (1 + 1 / n)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, rows: np.ndarray, max_tests: int) -> list[Test]:
    """Adds the test with the largest information gain over bad rows until no good row is covered."""
    rule, at = [], rows.copy()
    while len(rule) < max_tests and (~y & at).any() and (y & at).any():
        p0, n0 = (y & at).sum(), at.sum()
        best = None
        for f, v in x.items():
            values, bad = v[at], y[at]
            order = np.argsort(values, kind="stable")
            s, b = values[order], np.cumsum(bad[order])
            cuts = np.flatnonzero(s[1:] > s[:-1])
            if not len(cuts):
                continue
            mid = (s[cuts] + s[cuts + 1]) / 2
            for above, p, n in ((False, b[cuts], cuts + 1), (True, b[-1] - b[cuts], len(s) - cuts - 1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                    best = (gain[k], Test(f, above, float(mid[k])))
        if best is None:
            break
        rule.append(best[1])
        at &= best[1].rows(x)
    return rule


def _prune(x: dict[str, np.ndarray], y: np.ndarray, rows: np.ndarray, rule: list[Test]) -> list[Test]:
    """The shortest beginning of the rule that is best by (bad - good) / covered on held-out rows."""
    def worth(r):
        hit = _covers(x, r) & rows
        return ((y & hit).sum() - (~y & hit).sum()) / max(1, hit.sum())

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=[])


def verdict(rules: list[list[Test]]) -> Column:
    """Number of the first rule that fits (from 1), 0 for none: ``CASE WHEN .. THEN 1 WHEN .. THEN 2 .. ELSE 0``."""
    out = F.lit(0)
    chain = None
    for i, rule in enumerate(rules, 1):
        fits = rule[0].column()
        for t in rule[1:]:
            fits = fits & t.column()
        chain = F.when(fits, i) if chain is None else chain.when(fits, i)
    return out if chain is None else chain.otherwise(0)


def judge_documents(documents: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """One row per document: doc_id, n_words, base counts, base_failed, rule (first that fits, else 0), kept.

    Null and empty texts have no words and fail; repeated rows and null ids are judged each by itself; extra
    columns are ignored; an empty table gives no rows.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return (statistics(documents)
            .select("*", failed.alias("base_failed"), verdict(rules).alias("rule"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule",
                    (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept")))


def keep(documents: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """The rows that the base rule and the list keep, all columns as they were."""
    names = documents.columns
    packed = documents.select(F.col("text"), F.struct(*[F.col(c) for c in names]).alias("row"))
    judged = judge_documents(packed.select(F.col("row").alias("doc_id"), "text"), rules)
    # A filter on the verdict would be moved below the steps that make the arrays and make them again word by word; the outer
    # explode stands between.
    shown = judged.select(F.explode_outer(F.when(F.col("kept"), F.array("doc_id"))).alias("row"))
    return shown.filter("row is not null").select("row.*")
