"""Stupid-backoff scores from n-gram count tables partitioned by hash.

A word's score is count(n-gram) / count(its first n - 1 words) for the longest n-gram that the tables hold, times 0.4 for every
word of context given up; a single word has count / all words. The tables count all documents and leave out n-grams of two
words or more seen less than ``min_count`` times, so that single sightings back off.

The join runs in rounds (see ``rounds``): a batch of documents explodes its n-grams and sends each bucket of hashes the
distinct ones with their counts, sorted and packed. A bucket is one partition of the count table: it adds the counts up and
sends every batch the totals of the n-grams it asked for. The batch joins them to its n-grams and sums per
document. A frequent n-gram is one entry per batch. Words and pairs go in the first round; a longer n-gram goes in a later
one, and only if both n-grams of one word less inside it are in the tables: else it cannot be seen ``min_count`` times itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rounds
from .common import BLANKS, text_of
from .repeats import _bytes_planes, _expand, _from_planes, _press

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 2
#: A word's score is kept in whole millionths of its natural logarithm, so that sums do not depend on their order.
UNIT = 1_000_000
SCHEMA = "doc_id long, n_words long, levels array<long>, score long"
_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = _U(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and XXH64 of all words in a row; split and numbered in Arrow, so only distinct words become Python objects."""
    # Words end at the same six blanks as in ``BLANKS``; the bytes need not be valid UTF-8.
    split = pc.ascii_split_whitespace(pa.array([t.translate(_LOWER) for t in texts], pa.large_binary()).view(pa.large_string()))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    sizes = np.diff(ends[np.concatenate((np.zeros(1, np.int64), np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)))])
    numbered = flat.filter(full).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in numbered.dictionary.view(pa.large_binary()).to_pylist()], _U)
    return sizes, known[numbered.indices.to_numpy()]


class Grams:
    """All n-grams of a batch: hash per order and place (0 where the text has no such n-gram), and each order's distinct hashes."""

    def __init__(self, texts: list[bytes], order: int):
        self.sizes, one = _word_hashes(texts)
        starts = np.cumsum(self.sizes) - self.sizes
        #: Place of each word in its text.
        self.place = np.arange(len(one)) - np.repeat(starts, self.sizes)
        self.hashes = []
        with np.errstate(over="ignore"):
            now = _mixed(one + _STEP)
            for n in range(1, order + 1):
                if n > 1:
                    # Order matters: the earlier words are mixed again with every word that joins.
                    now = np.concatenate((np.zeros(1, _U), _mixed(now[:-1] * _STEP + one[1:] + _U(n)))) if len(now) else now
                # Zero stands for none.
                self.hashes.append(np.where(self.place >= n - 1, now | _U(1), _U(0)))

    def level(self, n: int, keep: np.ndarray | None = None) -> "Level":
        at = self.hashes[n - 1] != 0
        return Level(self.hashes[n - 1], at if keep is None else at & keep)


class Level:
    """Distinct n-grams of one order at the places ``at``, with their counts, and the totals once they are known."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray):
        self.at, self.held = at, hashes[at]
        # Which key stands at each place is worked out when totals come back; a question needs no more than this sort.
        self.keys, self.counts = np.unique(self.held, return_counts=True)

    def cuts(self, n_buckets: int) -> list[int]:
        """Where each bucket's keys begin, and the end of the last: buckets are ranges of hashes, and the keys are sorted, so keys of one lie
        together and their differences are short."""
        bucket = ((self.keys >> _U(32)) * _U(n_buckets)) >> _U(32)
        return np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=_U)).tolist()

    def totals(self, replies: dict[int, bytes], n_buckets: int, base: int, place: int) -> np.ndarray:
        """Total of the n-gram at every word, 0 where none was asked for."""
        total, cuts = np.zeros(len(self.keys), np.int64), self.cuts(n_buckets)
        for b in range(n_buckets):
            if cuts[b] < cuts[b + 1] and base + b in replies:
                total[cuts[b]:cuts[b + 1]] = _numbers(replies[base + b][place])
        out = np.zeros(len(self.at), np.int64)
        order = np.argsort(self.held)
        at = np.flatnonzero(self.at)
        out[at[order]] = np.repeat(total, self.counts)
        return out


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _blocks(levels: list[Level], n_buckets: int, base: int) -> dict[int, bytes]:
    cuts = [v.cuts(n_buckets) for v in levels]
    out = {}
    for b in range(n_buckets):
        mine = [slice(c[b], c[b + 1]) for c in cuts]
        if any(m.start < m.stop for m in mine):
            out[base + b] = _press(*(x for v, m in zip(levels, mine) for x in (_bytes_planes(v.keys[m]), _planes(v.counts[m]))))
    return out


def _joined(g: Grams, answers: dict, order: int, n_buckets: int, min_count: int) -> list[np.ndarray]:
    """Totals per word for orders 1 to ``order``, from the replies of as many rounds as that takes."""
    replies = {b: _expand(body) for b, body in answers.items()}
    per = [g.level(n).totals(replies, n_buckets, 0, n - 1) for n in range(1, min(order, 2) + 1)]
    for n in range(3, order + 1):
        per.append(g.level(n, _possible(per[-1], min_count)).totals(replies, n_buckets, (n - 2) * n_buckets, 0))
    return per


def _possible(shorter: np.ndarray, min_count: int) -> np.ndarray:
    held = shorter >= min_count
    return held & np.r_[False, held[:-1]] if len(held) else held


def _ask(n_buckets: int, order: int):
    def question(ids, texts):
        g = Grams(texts, min(order, 2))
        return _blocks([g.level(n) for n in range(1, min(order, 2) + 1)], n_buckets, 0)

    return question


def _ask_longer(n_buckets: int, n: int, min_count: int):
    def question(ids, texts, answers):
        g = Grams(texts, n)
        per = _joined(g, answers, n - 1, n_buckets, min_count)
        return _blocks([g.level(n, _possible(per[-1], min_count))], n_buckets, (n - 2) * n_buckets)

    return question


def _reply(bodies):
    """Totals of the asked n-grams, level by level."""
    asked = [_expand(b) for b in bodies]
    keys = [[_from_planes(k) for k in x[::2]] for x in asked]
    flat = [k for x in keys for k in x]
    every, index = np.unique(np.concatenate(flat), return_inverse=True)
    totals = np.zeros(len(every), np.int64)
    np.add.at(totals, index, np.concatenate([_numbers(c) for x in asked for c in x[1::2]]))
    out, at = [], 0
    for x in keys:
        reply = []
        for k in x:
            reply.append(_planes(totals[index[at:at + len(k)]]))
            at += len(k)
        out.append(_press(*reply))
    return out


def _finish(n_buckets: int, order: int, backoff: float, min_count: int, n_all: int):
    def finish(ids, texts, answers):
        g = Grams(texts, order)
        per = _joined(g, answers, order, n_buckets, min_count)
        n = len(g.place)
        score, level = np.zeros(n), np.zeros(n, np.int64)
        for k in range(order, 0, -1):
            held = (level == 0) & (g.hashes[k - 1] != 0) & ((per[k - 1] >= min_count) if k > 1 else True)
            context = np.full(n, n_all) if k == 1 else np.concatenate((np.zeros(1, np.int64), per[k - 2][:-1]))
            # Context given up: as many words as the text has before the word, up to order - 1, less those used.
            lost = np.minimum(g.place, order - 1) - (k - 1)
            at = np.flatnonzero(held)
            score[at] = np.log(per[k - 1][at] / context[at]) + lost[at] * np.log(backoff)
            level[at] = k
        units = np.floor(score * UNIT + 0.5).astype(np.int64)
        edges = np.concatenate(([0], np.cumsum(g.sizes)))
        add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[edges])
        levels = np.stack([add(level == k) for k in range(1, order + 1)], axis=1) if len(texts) else np.zeros((0, order), np.int64)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(g.sizes), "levels": pa.array(levels.tolist(), pa.list_(pa.int64())),
                         "score": pa.array(add(units), pa.int64())})

    return finish


def score_documents(documents: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per input row: doc_id, n_words, levels (words scored by n-grams of 1, 2, .. words), score (sum over
    words of the logarithm, in millionths).

    Words are lower-cased (A-Z). Null and empty texts score 0 over no words; repeated rows count and score each by itself; null
    ids are kept; extra columns are ignored; an empty table gives no rows.
    """
    n_all = documents.agg(F.sum(F.regexp_count(text_of("text"), F.lit(BLANKS.replace("[", "[^") + "+")))).first()[0] or 0
    dealt, n = rounds.batches(documents, batch_bytes=2 * rounds.BATCH_BYTES)
    totals = rounds.answer(rounds.ask(dealt, _ask(n, order)), _reply)
    for k in range(3, order + 1):
        totals = totals.union(rounds.answer(rounds.ask(dealt, _ask_longer(n, k, min_count), totals), _reply))
    return rounds.use(dealt, totals, _finish(n, order, backoff, min_count, n_all), SCHEMA)
