"""Repeated passages by a common-prefix interval tree over an enhanced suffix array.

A byte goes if a string of ``WIDTH`` bytes over it also starts in a document with a smaller id. Whole copies of a text with a
smaller id are found first, by digest: they lose everything and take no part. For the rest, two rounds between
batches and buckets (see ``rounds``) find these strings:

1. Anchors. Of the hashes of all ``GRAM``-byte grams, those that are the smallest in some run of WIDTH - GRAM + 1 grams are
   anchors. Equal strings of WIDTH bytes hold an anchor at the same place, so only anchors that occur in two documents
   matter. Batches send theirs, sorted; buckets answer which are shared.
2. Suffixes. Around each shared anchor stands its context: the bytes before it, and the suffix from it on, as far as a string of
   WIDTH bytes that holds the anchor can reach. A bucket sorts the suffixes of an anchor, takes the common prefixes of
   neighbours, and scans them with a stack: every interval of the common-prefix tree that closes has its left sides sorted and
   scanned the same way. Left sides that part into several are the left extensions; each interval of theirs, with the prefix it
   stands in, is a maximal repeat with all its occurrences, not only neighbours. Repeats of WIDTH bytes or more, with
   the smallest document among all occurrences, go back to the batches, where documents behind it lose the bytes.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rounds
from .common import saved

WIDTH, GRAM = 50, 26
#: A null id stands behind all others.
LAST = (1 << 63) - 1
#: Bytes that anchors are computed over at a time.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_MASK = (1 << 64) - 1


def _gram_hashes(b: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n bytes, by doubling: hash(xy) = hash(x) * base ** len(y) + hash(y)."""
    have, size, part = None, 0, b.astype(_U) + _U(1)
    length, power, rest = 1, _BASE, n
    while rest:
        if rest & 1:
            if have is None:
                have, size = part, length
            else:
                m = len(part) - size
                have, size = part[:m] * _U(pow(_BASE, size, 1 << 64)) + have[length:length + m], size + length
        rest >>= 1
        if rest:
            part = part[:-length] * _U(power) + part[length:]
            length, power = length * 2, power * power & _MASK
    have ^= have >> _U(32)
    have *= _U(0xD6E8FEB86659FD93)
    have ^= have >> _U(29)
    return have


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w neighbours."""
    length, out = 1, x
    while length * 2 <= w:
        out = op(out[:-length], out[length:])
        length *= 2
    return op(out[:len(x) - w + 1], out[w - length:]) if w > length else out


def anchors(texts: list[bytes], width: int = WIDTH, gram: int = GRAM):
    """Yields (text number, place, hash) arrays of the anchors of texts of at least ``width`` bytes."""
    w = width - gram + 1
    held, size = [], 0

    def work():
        sizes = np.array([len(p) for _, _, p in held])
        joined = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        starts = np.cumsum(sizes) - sizes
        with np.errstate(over="ignore"):
            h = _gram_hashes(joined, gram)
        least = _slide(h, w, np.minimum)
        # A run that crosses into the next text counts as smaller than any hash.
        for s, n in zip(starts.tolist(), sizes.tolist()):
            least[max(0, s + n - width + 1):s + n] = 0
        wide = np.concatenate((np.zeros(w - 1, _U), least, np.zeros(w - 1, _U)))
        at = np.flatnonzero((_slide(wide, w, np.maximum)[:len(h)] == h) & (h != 0))
        piece = np.searchsorted(starts, at, side="right") - 1
        number = np.array([i for i, _, _ in held])[piece]
        return number, at - starts[piece] + np.array([f for _, f, _ in held])[piece], h[at]

    for i, t in enumerate(texts):
        for first in range(0, max(1, len(t) - width + 1), PIECE):
            p = t[first:first + PIECE + width - 1]
            if len(p) >= width:
                held.append((i, first, p))
                size += len(p)
                if size >= PIECE:
                    yield work()
                    held, size = [], 0
    if held:
        yield work()


def _press(*arrays: bytes) -> bytes:
    head = array("Q", [len(a) for a in arrays]).tobytes()
    return bytes([len(arrays)]) + zstandard.ZstdCompressor(level=1).compress(head + b"".join(arrays))


def _expand(body: bytes) -> list[bytes]:
    raw, n = zstandard.ZstdDecompressor().decompress(body[1:]), body[0]
    sizes = np.frombuffer(raw[:8 * n], "<u8").tolist()
    ends = np.cumsum([8 * n, *sizes]).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def _bytes_planes(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, in byte planes: the high ones nearly vanish."""
    return np.diff(x, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, _U)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=_U)


#: Stands for the bucket of a batch's list of whole copies.
COPIES = -1


def _copies(dealt: DataFrame) -> DataFrame:
    """(batch, bucket, body): the rows of each batch whose text a smaller id has too, as digests of id and text."""
    rows = dealt.select("batch", "doc_id", F.sha2("body", 256).alias("text"))
    firsts = rows.groupBy("text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    later = rows.join(firsts, "text").filter("doc_id is null or doc_id > first")
    pairs = later.select("batch", F.concat_ws(" ", F.coalesce("doc_id", F.lit(LAST)).cast("string"), "text").alias("row")).distinct()
    return pairs.groupBy("batch").agg(F.array_join(F.collect_list("row"), "\n").alias("list")).select(
        "batch", F.lit(COPIES).cast("long").alias("bucket"), F.col("list").cast("binary").alias("body"))


def _without_copies(ids: list, texts: list, answers: dict) -> tuple[list, list, list]:
    """Ids and texts with the copies' texts emptied, and which they are."""
    listed = set(answers.pop(COPIES, b"").split(b"\n"))
    if listed == {b""}:
        return ids, texts, [False] * len(ids)
    out = [f"{LAST if i is None else i} {hashlib.sha256(t).hexdigest()}".encode() in listed for i, t in zip(ids, texts)]
    return ids, [b"" if c else t for c, t in zip(out, texts)], out


def _ask_shared(n_buckets: int, width: int, gram: int):
    def question(ids, texts, answers):
        ids, texts, _ = _without_copies(ids, texts, answers)
        found = [(np.array([LAST if ids[k] is None else ids[k] for k in n.tolist()], np.int64), h) for n, _, h in anchors(texts, width, gram)]
        if not found:
            return {}
        docs, h = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((docs, h))
        docs, h = docs[order], h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        keys = h[first]
        # In several documents of this batch already?
        many = docs[first] != docs[np.r_[first[1:], len(h)] - 1]
        bucket = keys % _U(n_buckets)
        return {b: _press(_bytes_planes(keys[bucket == b]), np.packbits(many[bucket == b]).tobytes()) for b in range(n_buckets)}

    return question


def _reply_shared(bodies):
    parts = [_expand(b) for b in bodies]
    keys = [_from_planes(p[0]) for p in parts]
    many = [np.unpackbits(np.frombuffer(p[1], np.uint8), count=len(k)).astype(bool) for p, k in zip(parts, keys)]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(inverse, minlength=len(every)) > 1
    shared[inverse[np.concatenate(many)]] = True
    ends = np.cumsum([len(k) for k in keys])
    return [_press(_bytes_planes(k[shared[inverse[e - len(k):e]]])) for k, e in zip(keys, ends.tolist())]


def _context(t: bytes, at: int, width: int, gram: int) -> tuple[bytes, bytes]:
    return t[max(0, at - (width - gram)):at], t[at:at + width]


def _among(keys: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, _U)


def _members(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = np.searchsorted(of, h)
    at[at == len(of)] = 0
    return of[at] == h if len(of) else np.zeros(len(h), bool)


def _ask_repeats(n_buckets: int, width: int, gram: int):
    def question(ids, texts, answers):
        ids, texts, _ = _without_copies(ids, texts, answers)
        shared = _among([_from_planes(_expand(b)[0]) for b in answers.values()])
        seen: dict = {}
        for number, place, h in anchors(texts, width, gram):
            hit = _members(h, shared)
            for i, at, k in zip(number[hit].tolist(), place[hit].tolist(), h[hit].tolist()):
                doc = LAST if ids[i] is None else ids[i]
                key = (k, *_context(texts[i], at, width, gram))
                low, high = seen.get(key, (doc, doc))
                seen[key] = (min(low, doc), max(high, doc))
        blocks: dict = {}
        for (k, left, right), (low, high) in sorted(seen.items()):
            blocks.setdefault(k % n_buckets, []).append((k, left, right, low, high))
        return {b: _press(_bytes_planes(np.array([r[0] for r in rows], _U)), bytes(len(r[1]) for r in rows), bytes(len(r[2]) for r in rows),
                          b"".join(r[1] + r[2] for r in rows), array("q", [r[3] for r in rows]).tobytes(), array("q", [r[4] for r in rows]).tobytes())
                for b, rows in blocks.items()}

    return question


def _records(body: bytes):
    k, nl, nr, joined, low, high = _expand(body)
    at = 0
    for key, a, b, lo, hi in zip(_from_planes(k).tolist(), nl, nr, np.frombuffer(low, "<i8").tolist(), np.frombuffer(high, "<i8").tolist()):
        yield key, joined[at:at + a], joined[at + a:at + a + b], lo, hi
        at += a + b


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def intervals(strings: list[bytes], least: int):
    """(common prefix, first, last + 1) of every interval of the common-prefix tree of sorted ``strings`` with a prefix of at
    least ``least``; single strings are leaves with their own length. Found by a stack over neighbours' common prefixes."""
    for i, s in enumerate(strings):
        if len(s) >= least:
            yield len(s), i, i + 1
    stack: list[list[int]] = []
    for i in range(1, len(strings) + 1):
        now = _common(strings[i - 1], strings[i]) if i < len(strings) else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            prefix, first = stack.pop()
            yield prefix, first, i
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append([now, first])


def maximal_repeats(occurrences: list[tuple[bytes, bytes, int, int]], width: int):
    """Of one anchor's distinct contexts (suffix, reversed left side, smallest document, largest), sorted: yields
    (left length, right length, smallest document, members) of every maximal repeat of at least ``width`` bytes around the anchor."""
    suffixes = [o[0] for o in occurrences]
    for right, a, b in intervals(suffixes, 1):
        inside = sorted(range(a, b), key=lambda i: occurrences[i][1]) if b - a > 1 else [a]
        for left, c, d in intervals([occurrences[i][1] for i in inside], max(0, width - right)):
            members = inside[c:d]
            if left + right >= width:
                yield left, right, min(occurrences[i][2] for i in members), members


def _reply_repeats(width: int):
    def reply(bodies):
        every: dict = {}
        for body in bodies:
            for k, left, right, lo, hi in _records(body):
                x = every.setdefault(k, {}).get((right, left[::-1]))
                every[k][right, left[::-1]] = (lo, hi) if x is None else (min(lo, x[0]), max(hi, x[1]))
        found: dict = {}
        for k, contexts in every.items():
            rows = sorted((r, rev, lo, hi) for (r, rev), (lo, hi) in contexts.items())
            for left, right, least, members in maximal_repeats(rows, width):
                for i in members:
                    if rows[i][3] > least:
                        spans = found.setdefault((k, rows[i][0], rows[i][1]), [])
                        # Longer prefixes come first; what one of them covers for as small a document says nothing new.
                        if not any(a >= left and b >= right and x <= least for a, b, x in spans):
                            spans.append((left, right, least))
        out = []
        for body in bodies:
            keys, codes, counts, lefts, rights, least = [], [], [], [], [], []
            for k, left, right, _, hi in _records(body):
                spans = sorted(s for s in found.get((k, right, left[::-1]), ()) if s[2] < hi)
                if spans:
                    keys.append(k)
                    codes.append(xxhash.xxh64_intdigest(left + b"\0" + right + bytes([len(left)])))
                    counts.append(len(spans))
                    for s in spans:
                        lefts.append(s[0])
                        rights.append(s[1])
                        least.append(s[2])
            out.append(_press(_bytes_planes(np.array(keys, _U)), array("Q", codes).tobytes(), array("I", counts).tobytes(), bytes(lefts), bytes(rights),
                              array("q", least).tobytes()))
        return out

    return reply


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def _finish(width: int, gram: int):
    def finish(ids, whole, answers):
        ids, texts, copied = _without_copies(ids, whole, answers)
        cover: dict = {}
        for body in answers.values():
            k, codes, counts, lefts, rights, least = _expand(body)
            spans = zip(lefts, rights, np.frombuffer(least, "<i8").tolist())
            for key, code, n in zip(_from_planes(k).tolist(), np.frombuffer(codes, "<u8").tolist(), np.frombuffer(counts, "<u4").tolist()):
                cover[key, code] = [next(spans) for _ in range(n)]
        wanted = np.unique(np.array([k for k, _ in cover], _U))
        marks: dict = {}
        for number, place, h in anchors(texts, width, gram):
            hit = _members(h, wanted)
            for i, at, k in zip(number[hit].tolist(), place[hit].tolist(), h[hit].tolist()):
                left, right = _context(texts[i], at, width, gram)
                doc = LAST if ids[i] is None else ids[i]
                for a, b, least in cover.get((k, xxhash.xxh64_intdigest(left + b"\0" + right + bytes([len(left)]))), ()):
                    if least < doc:
                        marks.setdefault(i, []).append((at - a, at + b))
        rows = []
        for i, t in enumerate(whole):
            runs: list[list[int]] = [[0, len(t)]] if copied[i] and len(t) >= width else []
            for a, b in sorted(marks.get(i, ())):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(t[at:a])
                at = b
            kept.update(t[at:])
            rows.append((ids[i], len(t), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [a for a, _ in runs], [b for _, b in runs]))
        cols = list(zip(*rows)) or [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2
        return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(SCHEMA.split(", "), cols, kinds)})

    return finish


def repeated_passages(documents: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed runs as starts and ends in bytes.

    Null and empty texts have no bytes; texts shorter than ``width`` lose nothing; rows of one id do not make each other
    lose; null ids stand behind all others; extra columns are ignored; an empty table gives no rows.
    """
    dealt, n = rounds.batches(documents)
    copies = saved(_copies(dealt))
    shared = rounds.answer(rounds.ask(dealt, _ask_shared(n, width, gram), copies), _reply_shared)
    repeats = rounds.answer(rounds.ask(dealt, _ask_repeats(n, width, gram), shared.union(copies)), _reply_repeats(width))
    return rounds.use(dealt, repeats.union(copies), _finish(width, gram), SCHEMA)
