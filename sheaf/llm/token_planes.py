"""Token ids in bit-plane or byte-plane chunks.

Texts are dealt out by ranges of their id and sorted, so shard after shard holds ascending documents. Each task encodes
its texts and packs whole documents into chunks. The ids of a chunk are cut into blocks of fixed size; every block is
transposed, so that equal bits (or bytes) of neighbouring ids lie together, and each plane is compressed by itself
with zstandard. A chunk is one row of a Parquet table: number of ids, the documents in it with their lengths, the index
of compressed plane sizes, and the planes. Spark's writer commits shards whole, so a lost executor leaves no
torn file. Readers take any chunk alone.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ids in a block, ids after which a chunk is closed, id appended to each document.
BLOCK, CHUNK, END = 16_384, 262_144, 0
FORMAT = "shard int, chunk int, n_ids long, block int, planes string, docs binary, sizes binary, plane_sizes binary, body binary"
#: Distinct words an encoder remembers before it starts afresh, and characters it takes at a time.
REMEMBER, AT_ONCE = 1_000_000, 4_000_000


class WordEncoder:
    """Byte-level BPE by the tokenizers library, with the ids of words remembered.

    The vocabulary's split pattern never joins characters across the start of a blank-led word, so a text's ids
    are those of its words in a row. Words not seen before are encoded together, a line each. Texts with
    runs of white space around blanks, and those that hold a special token's string, go to the library whole.
    """

    _odd = re.compile(r"\s (?:\s|$)")
    #: A word up to its last letter or digit, and the marks behind it (no apostrophe): the split pattern parts them too.
    _marked = re.compile(r"(\S*[^\W_])([!-&(-/:-@\[-`{-~]*)").fullmatch
    _solid = re.compile(r"\S+").fullmatch

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.newline = self._whole("\n")
        self.line_id = int(np.frombuffer(self.newline, "<u4")[0])
        self._forget()

    def _forget(self):
        #: Ids of words behind a blank, and of words at the start of a text or line.
        self.after, self.first = {"": self._whole(" ")}, {"": b""}

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _lines(self, lines: list[str]) -> list[bytes]:
        """Ids of each line; lines hold no white space but one leading blank."""
        if not lines:
            return []
        ids = np.array(self.library.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.line_id)
        if len(cuts) != len(lines) - 1:
            return [self._whole(x) for x in lines]
        raw = ids.tobytes()
        edges = [-4, *(cuts * 4).tolist(), len(raw)]
        return [raw[a + 4:b] for a, b in zip(edges, edges[1:])]

    def _learn(self, memory: dict, words: set, lead: str) -> None:
        plain, joined, lined = [], [], []
        for w in words.difference(memory):
            if m := self._marked(w):
                core, marks = m.groups()
                if marks:
                    joined.append((w, core, marks))
                else:
                    plain.append(w)
            elif self._solid(w):
                plain.append(w)
            elif all(map(self._solid, w.split("\n"))):
                lined.append(w)
            else:
                memory[w] = self._whole(lead + w)
        plain += {core for _, core, _ in joined if core not in memory}.difference(plain)
        for w, ids in zip(plain, self._lines([lead + w for w in plain])):
            memory[w] = ids
        if joined:
            self._learn(self.first, {m for _, _, m in joined}, "")
            for w, core, marks in joined:
                memory[w] = memory[core] + self.first[marks]
        if lined:
            parts = [w.split("\n") for w in lined]
            self._learn(memory, {p[0] for p in parts}, lead)
            self._learn(self.first, {x for p in parts for x in p[1:]}, "")
            for w, p in zip(lined, parts):
                memory[w] = memory[p[0]] + b"".join(self.newline + self.first[x] for x in p[1:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        split = {}
        for i, t in enumerate(texts):
            if self._odd.search(t) or any(s in t for s in self.special):
                out[i] = self._whole(t)
            else:
                split[i] = t.split(" ")
        after = set().union(*(p[1:] for p in split.values()))
        if len(self.after) + len(self.first) > REMEMBER:
            # What this batch uses stays; the rest is learned again when it comes back.
            used = {w: self.after[w] for w in after if w in self.after}
            self._forget()
            self.after |= used
        self._learn(self.after, after, " ")
        self._learn(self.first, {p[0] for p in split.values()}, "")
        get = self.after.__getitem__
        for i, p in split.items():
            out[i] = self.first[p[0]] + b"".join(map(get, p[1:]))
        return out


@lru_cache(maxsize=1)
def encoder_for(path: str) -> WordEncoder:
    """One encoder for all tasks that a Python worker runs, so words are learned once per worker."""
    return WordEncoder(path)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of one block, lowest first."""
    if kind == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T)]
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").T
    return [p.tobytes() for p in np.packbits(bits, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    grid = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if kind == "byte":
        return np.ascontiguousarray(grid.T).view("<u4").ravel()
    bits = np.unpackbits(grid, axis=1, count=n, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").ravel()


def pack_chunk(ids: bytes, kind: str, block: int, press) -> tuple[bytes, bytes]:
    """(plane_sizes, body) of a chunk."""
    flat = np.frombuffer(ids, "<u4")
    planes = [press.compress(p) for at in range(0, len(flat), block) for p in to_planes(flat[at:at + block], kind)]
    return array("I", map(len, planes)).tobytes(), b"".join(planes)


def unpack_chunk(n: int, kind: str, block: int, plane_sizes: bytes, body: bytes) -> np.ndarray:
    sizes = np.frombuffer(plane_sizes, "<u4")
    ends = np.cumsum(sizes, dtype=np.int64)
    each = 4 if kind == "byte" else 32
    expand = zstandard.ZstdDecompressor()
    out = [np.zeros(0, "<u4")]
    for b, at in enumerate(range(0, n, block)):
        planes = [expand.decompress(body[int(e - s):int(e)]) for e, s in zip(ends[b * each:(b + 1) * each], sizes[b * each:(b + 1) * each])]
        out.append(from_planes(planes, min(block, n - at), kind))
    return np.concatenate(out)


def write(documents: DataFrame, path: str, tokenizer: str, kind: str = "byte", block: int = BLOCK, chunk: int = CHUNK,
          key: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all texts, ascending by id, as chunks under ``path``.

    Null text counts as empty; rows with a null id come first; rows of equal id stand in order of their texts; extra columns
    are ignored; an empty table writes an empty table. A document never spans chunks, so a chunk is as long as
    its longest document asks.
    """
    def run(batches):
        encoder, press = encoder_for(tokenizer), zstandard.ZstdCompressor(level=1)
        shard, number = TaskContext.get().partitionId(), 0
        docs, sizes, parts, held = [], [], [], 0

        def flush():
            nonlocal docs, sizes, parts, held, number
            index, body = pack_chunk(b"".join(parts), kind, block, press)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([block], pa.int32()),
                 pa.array([kind]), *(pa.array([b], pa.binary()) for b in (_packed(docs), array("q", sizes).tobytes(), index, body))],
                names=[x.split()[0] for x in FORMAT.split(", ")])
            docs, sizes, parts, held = [], [], [], 0
            number += 1
            return batch

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for some in _pieces(batch.column(1)):
                texts = [x or "" for x in batch.column(1).slice(some.start, len(some)).to_pylist()]
                for i, raw in zip(ids[some.start:some.stop], encoder.encode(texts)):
                    docs.append(i)
                    parts.append(raw + END.to_bytes(4, "little"))
                    sizes.append(len(raw) // 4 + 1)
                    held += sizes[-1]
                    if held >= chunk:
                        yield flush()
        if docs:
            yield flush()

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FORMAT).write.option("compression", "uncompressed").parquet(path)


def _packed(docs: list) -> bytes:
    """Ids with a byte each that says whether there is one."""
    return bytes(d is not None for d in docs) + array("q", [d or 0 for d in docs]).tobytes()


def _unpacked(raw: bytes) -> list:
    n = len(raw) // 9
    return [d if there else None for there, d in zip(raw[:n], np.frombuffer(raw[n:], "<i8").tolist())]


def _pieces(column) -> list[range]:
    """Runs of rows of about ``AT_ONCE`` characters."""
    out, start, size = [], 0, 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        size += n
        if size >= AT_ONCE:
            out.append(range(start, i + 1))
            start, size = i + 1, 0
    return [*out, range(start, len(column))] if start < len(column) else out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids array<long>) from the chunks; ids include the end id."""
    def run(batches):
        for docs, bounds, flat in _chunks(batches):
            parts = [flat[a:b].astype(np.int64) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return spark.read.schema(FORMAT).parquet(path).mapInArrow(run, "doc_id long, ids array<long>")


def _chunks(batches):
    for batch in batches:
        for r in batch.to_pylist():
            flat = unpack_chunk(r["n_ids"], r["planes"], r["block"], r["plane_sizes"], r["body"])
            yield _unpacked(r["docs"]), np.concatenate(([0], np.cumsum(np.frombuffer(r["sizes"], "<i8")))).tolist(), flat


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the chunks; start counts the ids of all documents before."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                flat = unpack_chunk(r["n_ids"], r["planes"], r["block"], r["plane_sizes"], r["body"]).astype("<u4").tobytes()
                sizes = np.frombuffer(r["sizes"], "<i8")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(flat[4 * a:4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["chunk"]] * n, pa.int32()), pa.array(_unpacked(r["docs"]), pa.int64()),
                     pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["shard", "chunk", "doc_id", "at", "n_tokens", "ids_crc32"])

    chunks = spark.read.schema(FORMAT).parquet(path)
    rows = chunks.mapInArrow(run, "shard int, chunk int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # Ids before a shard, and before a chunk in its shard; shards are as many as tasks.
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before(W.orderBy("shard"), "n").alias("base"))
    starts = chunks.select("shard", "chunk", before(W.partitionBy("shard").orderBy("chunk"), "n_ids").alias("inside"))
    based = starts.join(shards, "shard").select("shard", "chunk", (F.col("base") + F.col("inside")).alias("base"))
    return rows.join(based, ["shard", "chunk"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
