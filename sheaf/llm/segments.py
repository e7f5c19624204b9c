"""Sampled segmentations of whole texts, without replacement, and their decoding.

The pieces of a sentencepiece model span a lattice over a text; a path through it is a segmentation. The model at
hand holds merge ranks, not probabilities, so a piece weighs 1 / (rank + 1), to the power ``sharpness`` (Zipf's law); characters
without a piece fall back to bytes, each at the rank behind the last. No piece crosses the start of a word or a line break, so
lattices are built once per distinct word of a batch, all at once in numpy: a trie walk finds the edges, and a backward pass
over log sums gives every node the mass of its completions.

Gumbel top-k by perturbed A-star search: the root draws the largest perturbed score of all paths. Following a path, the
child drawn by mass inherits its parent's value, and the other children together draw theirs below it. These rests are
the search's queue, ordered by a value that bounds all paths behind it; the best one popped k times gives the k
paths with the largest perturbed scores: distinct, and a sample without replacement. With the next value in the queue as threshold t, a
path of log probability p was included with probability 1 - exp(-exp(p - t)).

All draws are hashes of the row's key, the sample, the word and the step: the same row gives the same samples anywhere.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES, SHARPNESS, SEED = 2, 1.0, 1
SPACE = "▁"
#: Characters of text taken at a time; a longer text is taken alone.
AT_ONCE = 600_000
_U = np.uint64
_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall


class Spellings:
    """Bytes of each piece of a model: all that decoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        self._read(sentencepiece.SentencePieceProcessor(model_file=path))

    def _read(self, model) -> None:
        self.bytes = []
        for i in range(model.get_piece_size()):
            s = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes.append(bytes([int(s[3:5], 16)]))
            else:
                self.bytes.append(s.replace(SPACE, " ").encode() if spelled(model, i) else b"")
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths


def spelled(model, i: int) -> bool:
    """Whether a piece stands for characters."""
    return not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))


class Pieces(Spellings):
    """A model's pieces: trie edges sorted by (node, character), piece and weight of each node, bytes of each piece."""

    def __init__(self, path: str, sharpness: float):
        self.sharpness = sharpness
        super().__init__(path)

    def _read(self, model) -> None:
        super()._read(model)
        sharpness = self.sharpness
        n = self.size = model.get_piece_size()
        self.first_byte = model.piece_to_id("<0x00>")
        next_node: dict[tuple[int, int], int] = {}
        piece = [-1]
        self.weight = np.zeros(n + 1)
        for i in range(n):
            if not spelled(model, i):
                continue
            s = model.id_to_piece(i)
            if SPACE in s.lstrip(SPACE) or "\n" in s:
                raise ValueError("a piece crosses the start of a word or a line")
            rank = -model.get_score(i)
            self.weight[i] = -sharpness * np.log(1 + (rank if rank < n else n))
            at = 0
            for c in s:
                at = next_node.setdefault((at, ord(c)), len(piece))
                if at == len(piece):
                    piece.append(-1)
            piece[at] = i
        self.byte_weight = -sharpness * np.log(1 + n)
        self.longest = max(len(model.id_to_piece(i)) for i in range(n))
        keys = np.array([(a << 21) | c for a, c in next_node], _U)
        order = np.argsort(keys)
        self.keys, self.next, self.piece = keys[order], np.array(list(next_node.values()), np.int32)[order], np.array(piece, np.int32)
        # Nodes that lead on, and where each first character leads (0: nowhere).
        self.inner = np.zeros(len(piece), bool)
        self.inner[self.keys >> _U(21)] = True
        self.first = np.zeros(0x200000, np.int32)
        outset = int(np.searchsorted(self.keys, _U(1 << 21)))
        self.first[self.keys[:outset]] = self.next[:outset]


@lru_cache(maxsize=2)
def pieces_for(path: str, sharpness: float) -> Pieces:
    """Once per Python worker."""
    return Pieces(path, sharpness)


@lru_cache(maxsize=2)
def spellings_for(path: str) -> Spellings:
    return Spellings(path)


def units(text: str) -> list[str]:
    """Words with their leading blank, and line breaks, of a text with one blank put before it."""
    if not text:
        return []
    if "  " in text or SPACE in text or "\0" in text or text[0] == " ":
        return _UNITS(SPACE + text.replace(" ", SPACE))
    if "\n" not in text:
        return (SPACE + text.replace(" ", "\0" + SPACE)).split("\0")
    return [u for u in (SPACE + text.replace(" ", "\0" + SPACE).replace("\n", "\0\n\0")).split("\0") if u]


class Lattices:
    """Lattices of distinct words. Nodes are character places, edges are sorted by start; ``first`` is a word's start node."""

    def __init__(self, words: list[str], pieces: Pieces):
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        self.first = ends - lengths
        codes = np.full(int(ends[-1]) + 1 if len(words) else 0, 0x1FFFFF, np.int32)
        inner = np.ones(len(codes), bool)
        inner[ends] = False
        codes[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        self.codes, self.is_end = codes, ~inner
        nodes = np.flatnonzero(inner).astype(np.int32)
        found = []
        count = np.zeros(len(codes), np.int32)
        state = pieces.first[codes[nodes]]
        at = nodes[state > 0]
        state = state[state > 0]
        for step in range(pieces.longest):
            if step:
                on = pieces.inner[state]
                at, state = at[on], state[on]
                key = (state.astype(_U) << _U(21)) | codes[at + step].astype(_U)
                i = np.searchsorted(pieces.keys, key)
                i[i == len(pieces.keys)] = 0
                ok = pieces.keys[i] == key
                at, state = at[ok], pieces.next[i[ok]]
            if step and not len(at):
                break
            p = pieces.piece[state]
            has = p >= 0
            found.append((at[has], p[has]))
            count[at[has]] += 1
            if step == 0:
                bare = inner.copy()
                bare[at[has]] = False
                bare = np.flatnonzero(bare).astype(np.int32)
                count[bare] += 1
        # Nodes nearest the end of their word first, so that a backward pass goes from front to back; of a node, long pieces first, as
        # they are drawn most. Each step has one edge of a node at most, so edges are put in place step by step and never sorted.
        left = (np.repeat(ends, lengths) - nodes).astype(np.int32)
        order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        nodes, left = nodes[order], left[order]
        sizes = count[nodes]
        tails = np.cumsum(sizes, dtype=np.int64)
        heads = tails - sizes
        total = int(tails[-1]) if len(tails) else 0
        self.start = np.repeat(nodes, sizes)
        self.stop, self.piece, weight = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        free = np.zeros(len(codes), np.int64)
        free[nodes] = heads
        while found:
            at, p = found.pop()
            to = free[at]
            self.stop[to], self.piece[to], weight[to] = at + len(found) + 1, p, pieces.weight[p]
            free[at] += 1
        if len(nodes):
            c, to = codes[bare], free[bare]
            n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            # A byte of its own is a piece; longer characters are marked and written out later.
            self.stop[to], self.piece[to], weight[to] = bare + 1, np.where(n_bytes == 1, pieces.first_byte + c, -1), n_bytes * pieces.byte_weight
        beta = np.zeros(len(codes))
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(left) > 0]), len(heads)] if len(heads) else np.zeros(1, np.int64)
        for a, b in zip(cuts, cuts[1:]):
            lo, hi = heads[a], tails[b - 1]
            v = weight[lo:hi] + beta[self.stop[lo:hi]]
            h = heads[a:b] - lo
            top = np.maximum.reduceat(v, h)
            v -= np.repeat(top, sizes[a:b])
            beta[nodes[a:b]] = top + np.log(np.add.reduceat(np.exp(v, out=v), h))
        # In whole steps of 2 ** -30, so that sums over a text are exact whatever else is in its batch.
        weight += beta[self.stop]
        weight -= np.repeat(beta[nodes], sizes)
        np.minimum(weight, 0.0, out=weight)
        weight *= 1 << 30
        self.log_p = np.divide(np.rint(weight, out=weight), 1 << 30, out=weight)
        self.rank = np.zeros(len(codes), np.int32)
        self.rank[nodes] = np.arange(len(nodes))
        self.heads, self.tails = heads, tails
        inside = np.exp(self.log_p)
        # Running sums inside each node, place by place.
        at, end = heads + 1, tails
        while (go := at < end).any():
            at, end = at[go], end[go]
            inside[at] += inside[at - 1]
            at = at + 1
        inside[tails - 1] = 1.0
        self.inside = inside

    def pick(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each node, by mass."""
        r = self.rank[nodes]
        e = self.heads[r]
        rest = np.flatnonzero(u >= self.inside[e])
        last = self.tails[r] - 1
        while len(rest):
            rest = rest[e[rest] < last[rest]]
            e[rest] += 1
            rest = rest[u[rest] >= self.inside[e[rest]]]
        return e

    def pick_other(self, edge: int, but: list[int], u: float) -> int:
        """An edge out of the same node as ``edge`` and none of ``but``."""
        r = self.rank[self.start[edge]]
        left = [e for e in range(self.heads[r], self.tails[r]) if e not in but]
        c = np.cumsum(np.exp(self.log_p[left] - self.log_p[left].max()))
        return left[min(int(np.searchsorted(c, u * c[-1], side="right")), len(left) - 1)]


def _uniform(*parts) -> np.ndarray:
    """Draws in (0, 1) from whole numbers."""
    with np.errstate(over="ignore"):
        h = np.asarray(parts[0], _U)
        for p in parts[1:]:
            h = (h ^ np.asarray(p).astype(_U)) * _U(0x9E3779B97F4A7C15)
            h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
            h ^= h >> _U(31)
    return ((h >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)


def _walk(lattices: Lattices, nodes: np.ndarray, seeds: np.ndarray, places: np.ndarray, sample: int, steps: np.ndarray):
    """Follows edges from each node to the end of its word: edges of all walks, in order, and how many each took."""
    live = np.flatnonzero(~lattices.is_end[nodes])
    now, taken = nodes[live], []
    counts = np.zeros(len(nodes), np.int64)
    step = 0
    while len(live):
        e = lattices.pick(now, _uniform(seeds[live], places[live], steps[live] + step, sample))
        taken.append((live, e))
        counts[live] += 1
        now = lattices.stop[e]
        on = ~lattices.is_end[now]
        live, now = live[on], now[on]
        step += 1
    at = np.cumsum(counts) - counts
    edges = np.empty(int(counts.sum()), np.int64)
    for s, (who, e) in enumerate(taken):
        edges[at[who] + s] = e
    return edges, counts


def _rests(lattices: Lattices, edges: np.ndarray, prefix: np.ndarray, top: np.ndarray, seed, order: np.ndarray, sample: int) -> np.ndarray:
    """Value of the best path that leaves at each edge: Gumbel at the log mass left there, below the value ``top``."""
    with np.errstate(divide="ignore"):
        mass = prefix + np.log(-np.expm1(lattices.log_p[edges]))
        return -np.logaddexp(-top, np.log(-np.log(_uniform(seed, order, sample, 77))) - mass)


def sample_texts(keys: list[int], texts: list[str], pieces: Pieces, k: int, seed: int = SEED):
    """For every text a list of (ids, log probability, log inclusion), best perturbed score first; at most k, fewer where there
    are no more segmentations; one empty segmentation for an empty text."""
    split = [units(t) for t in texts]
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    kind = np.array([number[w] for s in split for w in s], np.int64)
    number.default_factory = None  # It holds the dictionary, which would wait for the garbage collector.
    lattices = Lattices(list(number), pieces)
    del number
    sizes = np.array([len(s) for s in split], np.int64)
    row_seed = np.array([xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed) for key in keys], _U)
    word_at = np.cumsum(sizes) - sizes
    place = np.arange(len(kind)) - np.repeat(word_at, sizes)
    nodes = lattices.first[kind]
    edges, counts = _walk(lattices, nodes, np.repeat(row_seed, sizes), place, 0, np.zeros(len(kind), np.int64))
    # Tokens of a text: those of its words in a row.
    token_at = np.r_[0, np.cumsum(counts)][np.r_[word_at, len(kind)]]
    lengths = np.diff(token_at)
    logs = lattices.log_p[edges]
    total = np.r_[0.0, np.cumsum(logs)]
    prefix = total[:-1] - np.repeat(total[token_at[:-1]], lengths)
    top = -np.log(-np.log(_uniform(row_seed, 0, 0, 99)))
    order = np.arange(len(edges)) - np.repeat(token_at[:-1], lengths)
    rests = _rests(lattices, edges, prefix, np.repeat(top, lengths), np.repeat(row_seed, lengths), order, 0)
    words_of = np.repeat(np.arange(len(kind)), counts)
    found = []
    for i in range(len(texts)):
        a, b = token_at[i], token_at[i + 1]
        found.append(([(edges[a:b], float(logs[a:b].sum()))], _best(rests[a:b], prefix[a:b], k, 0, edges[a:b]),
                      [words_of[a:b] - word_at[i]]))
    for s in range(1, k):
        jobs = []
        for i, (paths, queue, words) in enumerate(found):
            if not queue:
                continue
            j = max(range(len(queue)), key=lambda q: queue[q][0])
            value, parent, t, before, but = queue.pop(j)
            e = lattices.pick_other(int(paths[parent][0][t]), but, float(_uniform(row_seed[i], t, s, 55)))
            jobs.append((i, value, parent, t, before, [*but, e], e))
        if not jobs:
            break
        # The word left in its middle goes on from the new edge; all later words are drawn anew.
        spans = [(int(found[i][2][parent][t]), int(sizes[i])) for i, _, parent, t, _, _, _ in jobs]
        n_each = np.array([b - a for a, b in spans])
        which = np.repeat(np.arange(len(jobs)), n_each)
        w = np.concatenate([np.arange(a, b) for a, b in spans])
        doc = np.array([j[0] for j in jobs])[which]
        start = lattices.first[kind[word_at[doc] + w]]
        head = np.cumsum(n_each) - n_each
        start[head] = lattices.stop[[j[6] for j in jobs]]
        more, taken = _walk(lattices, start, row_seed[doc], w, s, np.zeros(len(w), np.int64))
        more_at = np.r_[0, np.cumsum(taken)]
        for n, (i, value, parent, t, before, but, e) in enumerate(jobs):
            paths, queue, words = found[i]
            a, b = more_at[head[n]], more_at[head[n] + n_each[n]]
            tail = np.r_[e, more[a:b]]
            path = np.r_[paths[parent][0][:t], tail]
            on = w[head[n]:head[n] + n_each[n]]
            words.append(np.r_[words[parent][:t], on[0], np.repeat(on, taken[head[n]:head[n] + n_each[n]])])
            log_p = lattices.log_p[tail]
            ahead = before + np.r_[0.0, np.cumsum(log_p)[:-1]]
            new = _rests(lattices, tail, ahead, np.full(len(tail), value), row_seed[i], np.arange(t, t + len(tail)), s)
            # At the node itself all edges used so far are gone.
            gone = float(np.exp(lattices.log_p[but]).sum())
            r = lattices.rank[lattices.start[e]]
            if len(but) == lattices.tails[r] - lattices.heads[r]:
                new[0] = -np.inf
            else:
                u = float(_uniform(row_seed[i], t, s, 78))
                new[0] = -np.logaddexp(-value, np.log(-np.log(u)) - (before + np.log(max(1.0 - gone, 1e-300))))
            paths.append((path, float(before + log_p.sum())))
            queue += [(v, s, t + q, h, but if q == 0 else x) for v, _, q, h, x in _best(new, ahead, k, s, tail)]
    out = []
    for paths, queue, _ in found:
        threshold = max((q[0] for q in queue), default=-np.inf)
        out.append([(_ids(lattices, p, pieces), lp, _log_inclusion(lp, threshold)) for p, lp in paths])
    return out


def _best(rests: np.ndarray, prefix: np.ndarray, k: int, sample: int, edges: np.ndarray) -> list:
    """The k best rests of a path as (value, sample, place, log mass before, edges gone): no more can be popped."""
    at = np.argpartition(-rests, k)[:k] if len(rests) > k else np.arange(len(rests))
    return [(float(rests[t]), sample, int(t), float(prefix[t]), [int(edges[t])]) for t in at if rests[t] > -np.inf]


def _log_inclusion(log_p: float, threshold: float) -> float:
    if threshold == -np.inf:
        return 0.0
    x = log_p - threshold
    return round(float(np.log(-np.expm1(-np.exp(min(x, 700.0))))) if x > -30 else x, 6)


def _ids(lattices: Lattices, path: np.ndarray, pieces: Pieces) -> np.ndarray:
    ids = lattices.piece[path]
    if (ids >= 0).all():
        return ids
    out = []
    for e, p in zip(path.tolist(), ids.tolist()):
        out += [p] if p >= 0 else [pieces.first_byte + b for b in chr(lattices.codes[lattices.start[e]]).encode("utf-8", "surrogatepass")]
    return np.array(out, np.int64)


def decode_ids(ids: np.ndarray, pieces: Spellings) -> bytes:
    """The text's UTF-8 bytes; the blank put before it is taken away. Gathers all pieces' bytes at once."""
    n = pieces.lengths[ids]
    index = np.arange(int(n.sum())) + np.repeat(pieces.starts[ids] - (np.cumsum(n) - n), n)
    return pieces.joined[index].tobytes()[1:]


def _pieces_of(column, limit: int):
    start = size = 0
    for i, n in enumerate(pc.utf8_length(column).fill_null(0).to_pylist()):
        size += n
        if size >= limit:
            yield range(start, i + 1)
            start, size = i + 1, 0
    if start < len(column):
        yield range(start, len(column))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    edges = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([np.zeros(0, "<i4"), *parts])))


def encode(documents: DataFrame, model: str, samples: int = SAMPLES, sharpness: float = SHARPNESS, seed: int = SEED, decoded: bool = True,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and sample: doc_id, sample (from 0, best perturbed score first), n_pieces, log_prob, log_inclusion, ids,
    ids_crc32 (of little-endian unsigned 32-bit ids) and round_trip (whether the ids decode to the text).

    Null and empty texts have one empty segmentation; repeated rows repeat their samples; null ids share a seed; a text with
    fewer segmentations gives fewer rows; extra columns are ignored; an empty table gives no rows. The model's own blank
    character decodes to a blank, as the library does it. Without ``decoded`` no ids are decoded here: text_sha256 of the text that
    they have to give stands in place of round_trip, for ``read_back``.
    """
    schema = SCHEMA if decoded else UNREAD

    def run(batches):
        pieces = pieces_for(model, sharpness)
        for b in batches:
            for some in _pieces_of(b.column(1), AT_ONCE):
                keys = b.column(0).slice(some.start, len(some)).to_pylist()
                texts = [t or "" for t in b.column(1).slice(some.start, len(some)).to_pylist()]
                out: list = [[] for _ in range(7)]
                paths = []
                for i, t, found in zip(keys, texts, sample_texts([x or 0 for x in keys], texts, pieces, samples, seed)):
                    raw = t.replace(SPACE, " ").encode("utf-8", "surrogatepass")
                    digest = None if decoded else _text_digest(raw)
                    for s, (ids, log_p, inclusion) in enumerate(found):
                        flat = ids.astype("<i4")
                        paths.append(flat)
                        row = (i, s, len(ids), log_p, inclusion, zlib.crc32(flat), decode_ids(ids, pieces) == raw if decoded else digest)
                        for c, v in zip(out, row):
                            c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_() if decoded else pa.string()]
                columns = [pa.array(c, k) for c, k in zip(out, kinds)]
                columns.insert(5, _lists(paths))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, log_inclusion double, ids array<int>, ids_crc32 long, round_trip boolean"
UNREAD = SCHEMA.replace("round_trip boolean", "text_sha256 string")


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the text of an id column; null ids give null."""
    @F.pandas_udf("string")
    def run(column):
        pieces = spellings_for(model)
        return column.map(lambda x: None if x is None else decode_ids(np.asarray(x, np.int64), pieces).decode("utf-8", "replace"))

    return rows.withColumn(out, run(F.col(ids)))


def read_back(rows: DataFrame, model: str) -> DataFrame:
    """round_trip in place of text_sha256: whether the ids, as the rows hold them, decode to the text.

    Null ids count as none; null keys and repeated rows are kept as they are; an empty table gives no rows.
    """
    names = [x.split()[0] for x in UNREAD.split(", ")]

    def run(batches):
        pieces = spellings_for(model)
        for b in batches:
            column = b.column(names.index("ids"))
            flat = column.flatten().to_numpy(zero_copy_only=False)
            edges = np.concatenate(([0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)))).tolist()
            digests = b.column(names.index("text_sha256")).to_pylist()
            same = [_text_digest(decode_ids(flat[x:y].astype(np.int64), pieces)) == d for x, y, d in zip(edges, edges[1:], digests)]
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(names, b.columns) if n != "text_sha256"), pa.array(same, pa.bool_())],
                                             names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.select(*names).mapInArrow(run, SCHEMA)


def _text_digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
