"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one encoding, so exactly one token can end it: the table ``last`` holds that token for each
prefix. A token may stand behind another when merging their joined bytes gives back the two; an encoding is
right when all its neighbours may stand together. So ``last[i]`` is the one token that ends at byte i and may stand behind
``last[i - its length]``; whole encodings are read off backwards. The table of a prefix does not change when bytes are
appended, and after an edit it is kept up to the first changed byte.

Pieces are the matches of the split pattern. A piece that is a token as a whole is that token, whatever the merges say.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Memory of a worker: segments of text and pairs of tokens it remembers before it starts afresh; characters it takes at a time.
REMEMBER, PAIRS, AT_ONCE = 1_500_000, 1_000_000, 2_000_000
#: Unicode white space as the rank files' split pattern means it; other engines also count \x1c-\x1f.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ENCODED = "doc_id long, ids array<int>"
STATED = ENCODED + ", text string, piece_ends array<int>, last array<int>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=None)
def library_class(name: str) -> str:
    """Members of a Unicode class in the tiktoken library, whose Unicode version may be another than here: what its pattern does not
    match it leaves out."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(probe.encode_ordinary(every)).decode()


def _ranges(chars: set[str]) -> str:
    """A character class of these characters."""
    points = np.array(sorted(map(ord, chars)))
    cuts = np.flatnonzero(np.diff(points) > 1)
    firsts, lasts = points[np.r_[0, cuts + 1]], points[np.r_[cuts, len(points) - 1]]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts)) + "]"


class PrefixEncoder:
    """Encodes pieces by their table of last tokens, and texts piece by piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = dict(zip(ranks.values(), ranks))
        self.longest = max(map(len, ranks))
        spaced = "(?V1)" + pattern.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        exact, unlike = spaced, set()
        for name in set(regex.findall(r"\\p\{\w+\}", pattern)):
            held = set(library_class(name))
            unlike |= held ^ set(regex.findall(name, "".join(map(chr, range(0x110000)))))
            exact = exact.replace(name, _ranges(held))
        self.usual, self.exact = regex.compile(spaced), regex.compile(exact)
        #: Characters that the two libraries class apart; texts with them are split by the other library's classes.
        self.unlike = re.compile(_ranges(unlike) if unlike else "(?!)")
        #: All tokens that end at a byte.
        self.ends = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.ends.add_word(token.decode("latin-1"), (len(token), i))
        self.ends.make_automaton()
        #: Two blanks of which the later is not the start of a word: here neighbours decide how white space is split.
        self.odd = regex.compile(f"[{SPACE}] (?:[{SPACE}]|$)")
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        #: Ids of pieces and of segments, which are whole numbers of pieces.
        self.memory: dict[str, bytes] = {}

    def splitter(self, text: str):
        return self.exact if self.unlike.search(text) else self.usual

    def merged(self, piece: bytes) -> list[bytes]:
        """Plain merging, lowest rank first and leftmost among equals; only ever run over one or two tokens."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_start(self, token: int) -> bool:
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = len(self.merged(self.tokens[token])) == 1
        return known

    def may_follow(self, before: int, token: int) -> bool:
        known = self.pairs.get(before << 32 | token)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            a, b = self.tokens[before], self.tokens[token]
            known = self.pairs[before << 32 | token] = self.merged(a + b) == [a, b]
        return known

    def table(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """``last`` token of each prefix, by its length less one; the given start of the table is kept."""
        last = list(last or ())
        # Tokens that end behind the kept start begin at most the longest token's length before it.
        base = max(0, len(last) - self.longest)
        add, pairs, check = last.append, self.pairs.get, self.may_follow
        held = len(last)
        for end, (size, token) in self.ends.iter(piece[base:].decode("latin-1")):
            end += base
            if end < held:
                continue
            start = end + 1 - size
            if start:
                before = last[start - 1]
                fits = pairs(before << 32 | token)
                if fits is None:
                    fits = check(before, token)
            else:
                fits = self.may_start(token)
            if fits:
                add(token)
                held += 1
        if held != len(piece):
            raise ValueError("a byte of the text has no token")
        return last

    def read_off(self, last: list[int]) -> list[int]:
        """The encoding that a table ends in."""
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers. No piece crosses the start of a word behind a blank, so a text is the sum of
        its words with the blanks before them; these are remembered."""
        parts = [self.splitter(t).findall(t) if self.odd.search(t) else _by_blanks(t) for t in texts]
        distinct = set().union(*parts)
        if len(self.memory) > REMEMBER:
            self.memory = {p: self.memory[p] for p in distinct if p in self.memory}
        self._learn(distinct.difference(self.memory))
        get = self.memory.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def _learn(self, segments: set[str]) -> None:
        split = {}
        for s in segments:
            # A blank and letters are one piece.
            if not (s[1:].isalpha() and s[0] == " " and not self.unlike.search(s)):
                split[s] = self.splitter(s).findall(s)
        memory = self.memory
        pieces = segments.difference(split).union(*split.values()).difference(memory)
        before, last = b"", []
        # In order, so that a piece goes on from the prefix it shares with the one before.
        for raw, piece in sorted((p.encode(), p) for p in pieces):
            whole = self.ranks.get(raw)
            if whole is not None:
                ids = [whole]
            else:
                same = 0
                for x, y in zip(raw, before):
                    if x != y:
                        break
                    same += 1
                before, last = raw, self.table(raw, last[:same])
                ids = self.read_off(last)
            memory[piece] = array("I", ids).tobytes()
        for s, parts in split.items():
            if len(parts) != 1:
                memory[s] = b"".join(map(memory.__getitem__, parts))

    def state(self, text: str) -> dict:
        """Text, ids, where pieces end and the tables of all pieces one behind the other."""
        return self._state(text, [m.end() for m in self.splitter(text).finditer(text)], [], [])

    def _state(self, text: str, ends: list[int], last: list[int], kept: list[int]) -> dict:
        """``kept``: lengths of the tables in ``last`` that stand for the first pieces, the final one perhaps in part."""
        out, ids, used, begin = [], [], 0, 0
        for k, end in enumerate(ends):
            piece = text[begin:end].encode()
            begin = end
            n = kept[k] if k < len(kept) else 0
            table = self.table(piece, last[used:used + n])
            used += n
            out += table
            whole = self.ranks.get(piece)
            ids += [whole] if whole is not None else self.read_off(table)
        return {"text": text, "ids": ids, "piece_ends": ends, "last": out}

    def edited(self, state: dict, start: int, removed: int, added: str) -> dict:
        """State of the text with ``removed`` characters at ``start`` replaced by ``added``; appending is ``start`` at its end.

        A piece that ends two characters before the change does not depend on it. From there the pattern runs
        until it meets an old end behind the change; later pieces and their tables are as before.
        """
        old, ends, last = state["text"], state["piece_ends"], state["last"]
        start = min(max(start, 0), len(old))
        stop = min(start + max(removed, 0), len(old))
        new = old[:start] + added + old[stop:]
        keep = next((k for k, e in enumerate(ends) if e + 2 > start), len(ends))
        begin, shift = ends[keep - 1] if keep else 0, len(new) - len(old)
        later = {e + shift: k for k, e in enumerate(ends) if e >= stop}
        fresh, at, join, match = [], begin, None, self.splitter(new).match
        while at < len(new):
            if at >= start + len(added) and at in later:
                join = later[at]
                break
            at = match(new, at).end()
            fresh.append(at)
        sizes = [len(old[a:b].encode()) for a, b in zip([0, *ends], ends)]
        cut = sum(sizes[:keep])
        # The first fresh piece keeps its table up to the first changed byte.
        if keep < len(ends) and fresh:
            x, y = old[begin:ends[keep]].encode(), new[begin:fresh[0]].encode()
            same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        else:
            same = 0
        head = self._state(new[begin:at], [e - begin for e in fresh], last[cut:cut + same], [same])
        n_ids = _ids_of(self, last[:cut], sizes[:keep], old, ends[:keep])
        tail_at = sum(sizes[:join + 1]) if join is not None else len(last)
        tail_ends = [e + shift for e in ends[join + 1:]] if join is not None else []
        tail_ids = _ids_of(self, last[tail_at:], sizes[join + 1:], old, ends[join + 1:], ends[join]) if join is not None else []
        return {"text": new, "ids": n_ids + head["ids"] + tail_ids, "piece_ends": ends[:keep] + [e + begin for e in head["piece_ends"]] + tail_ends,
                "last": last[:cut] + head["last"] + last[tail_at:]}


def _ids_of(encoder: PrefixEncoder, last: list[int], sizes: list[int], text: str, ends: list[int], begin: int = 0) -> list[int]:
    """Ids read off the tables of whole pieces."""
    ids, used = [], 0
    for n, end in zip(sizes, ends):
        whole = encoder.ranks.get(text[begin:end].encode())
        ids += [whole] if whole is not None else encoder.read_off(last[used:used + n])
        used += n
        begin = end
    return ids


def _by_blanks(text: str) -> list[str]:
    head, *rest = text.split(" ")
    return [head, *map(" ".__add__, rest)]


@lru_cache(maxsize=1)
def tokens_of(path: str) -> list[bytes]:
    """Bytes of each id; ids without a token stand for nothing."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def _id_lists(column) -> list[np.ndarray]:
    """Ids of each row, null as none."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
    return [flat[a:b] for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=1)
def encoder_for(path: str, pattern: str) -> PrefixEncoder:
    """One encoder for all tasks that a Python worker runs."""
    return PrefixEncoder(read_ranks(path), pattern)


def _pieces(batch: pa.RecordBatch, column: int) -> list[pa.RecordBatch]:
    """Runs of rows of about ``AT_ONCE`` bytes or ids in that column."""
    c = batch.column(column)
    sizes = (pc.list_value_length(c) if pa.types.is_list(c.type) else pc.binary_length(c)).fill_null(0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // AT_ONCE)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


def _lists(parts: list[bytes]) -> pa.ListArray:
    edges = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts])))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode(documents: DataFrame, path: str, pattern: str, states: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text; with ``states`` also text, piece_ends and last, from which ``edit`` goes on.

    ``path`` is a rank file, ``pattern`` its split pattern. Null and empty texts have no ids; null ids are kept; repeated rows
    are encoded each by itself; extra columns are ignored; an empty table gives no rows. A row's memory grows with its text.
    """
    def run(batches):
        encoder = encoder_for(path, pattern)
        for batch in batches:
            for some in _pieces(batch, 1):
                texts = [t or "" for t in some.column(1).to_pylist()]
                if states:
                    yield pa.RecordBatch.from_pylist([{"doc_id": d, **encoder.state(t)} for d, t in zip(some.column(0).to_pylist(), texts)], _STATED)
                else:
                    yield pa.RecordBatch.from_arrays([some.column(0), _lists(encoder.encode(texts))], names=["doc_id", "ids"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, STATED if states else ENCODED)


_STATED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string()), ("piece_ends", pa.list_(pa.int32())),
                     ("last", pa.list_(pa.int32()))])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, bytes): the bytes that the ids stand for. Null ids count as none; null doc_ids are kept; repeated rows are decoded each by
    itself; extra columns are ignored; an empty table gives no rows."""
    def run(batches):
        token = tokens_of(path).__getitem__
        for batch in batches:
            for some in _pieces(batch, 1):
                raw = [b"".join(map(token, ids.tolist())) for ids in _id_lists(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(raw, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, ENCODED + ", bytes binary")


def edit(encoded: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """Texts of ``encode(.., states=True)`` after at most one change each, encoded anew only near it.

    ``edits``: doc_id, start, removed (characters), added; the text's length as start appends. Starts behind the end count as
    the end; null numbers count as 0 and null text as empty; rows without an edit, or with a null id, stay as they are; more
    than one edit of a doc_id gives one row for each; extra columns are ignored.
    """
    def run(batches):
        encoder = encoder_for(path, pattern)
        for batch in batches:
            for some in _pieces(batch, 2):
                rows = []
                for r in some.to_pylist():
                    state = {k: r[k] for k in ("text", "ids", "piece_ends", "last")}
                    if r["there"]:
                        state = encoder.edited(state, r["start"], r["removed"], r["added"])
                    rows.append({"doc_id": r["doc_id"], **state})
                yield pa.RecordBatch.from_pylist(rows, _STATED)

    changes = edits.select("doc_id", F.coalesce("start", F.lit(0)).cast("int").alias("start"), F.coalesce("removed", F.lit(0)).cast("int").alias("removed"),
                           F.coalesce("added", F.lit("")).alias("added"), F.lit(True).alias("there"))
    rows = encoded.select("doc_id", "ids", "text", "piece_ends", "last").join(changes, "doc_id", "left")
    return rows.mapInArrow(run, STATED)


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded rows: ids as little-endian unsigned 32-bit integers, and the bytes they decode to.
    Null ids count as none; null doc_ids are kept; repeated rows give a row each; extra columns are ignored; an empty table gives no rows."""
    def run(batches):
        token, sha = tokens_of(path).__getitem__, hashlib.sha256
        for batch in batches:
            for some in _pieces(batch, 1):
                lists = _id_lists(some.column(1))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(map(len, lists), pa.int64()), pa.array([sha(ids.astype("<u4").tobytes()).hexdigest() for ids in lists], pa.string()),
                     pa.array([sha(b"".join(map(token, ids.tolist()))).hexdigest() for ids in lists], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
