"""Product codes of integer vectors by per-dimension value dictionaries.

Vectors become integers once and are written in blocks: for every dimension the sorted distinct integers of the block (its
dictionary) and one small code per row. A round tabulates, per dimension, the squared difference of every dictionary
value to all codebook entries; the distance of a part is a gather of table rows by code and a sum over its dimensions. Cost
per row is gathers and adds, whatever the values are. Each task sums its rows per part and entry, Spark adds the
tasks' sums, and the next codebooks, parts x entries x width integers, are made from them on the driver.

Integers are 64 bits wide while every distance surely fits; blocks or codebooks with larger values are computed
with Python's integers by the same code.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers in a block, rows of a table of distances that are gathered at a time.
BLOCK, GATHER = 1_000_000, 65_536
#: Magnitude below which a block's sums fit 64 bits; bits of a limb, limbs of a float's integer.
SMALL, LIMB, LIMBS = 1 << 40, 30, 5
BLOCKS = "rows long, keys binary, labels binary, body binary"
SUMS = "part int, entry int, place int, n long, " + ", ".join(f"l{i} long" for i in range(LIMBS))


def _usable(vector: Column) -> Column:
    """True if the vector is there and all components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def _integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); Python integers where 64 bits could be too few."""
    x = np.floor(flat.astype(np.float64) * scale)
    if not len(x) or np.abs(x).max() < SMALL:
        return x.astype(np.int64)
    return np.array([int(v) for v in x], object)


def _write(kept: DataFrame, width: int, scale: int) -> DataFrame:
    """Blocks of rows: per dimension a dictionary and codes."""
    at_once = max(1, BLOCK // max(width, 1))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                some = batch.slice(at, at_once)
                n = some.num_rows
                grid = _integers(some.column(2).flatten().to_numpy(zero_copy_only=False), scale).reshape(n, width)
                columns = []
                for d in range(width):
                    values, codes = np.unique(grid[:, d], return_inverse=True)
                    columns.append((values, codes.astype(np.min_scalar_type(max(len(values) - 1, 0)))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int64())] + [pa.array([pickle.dumps(x)], pa.binary()) for x in (some.column(0).to_pylist(), some.column(1).to_pylist(), columns)],
                    names=["rows", "keys", "labels", "body"])

    return kept.mapInArrow(run, BLOCKS)


def _fits(columns: list, books: list[np.ndarray]) -> bool:
    """Whether all distances fit 64 bits."""
    if any(v.dtype == object for v in (*(v for v, _ in columns), *books)):
        return False
    most = max([int(abs(x)) for v, _ in columns for x in (v[0], v[-1])] + [int(np.abs(b).max()) for b in books])
    return len(columns) * 4 * most * most < 1 << 62


def _assign(columns: list, books: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, parts) nearest entries and their distances; ties to the lower index."""
    kind = np.int64 if _fits(columns, books) else object
    index, error = np.zeros((n, len(books)), np.int64), np.zeros((n, len(books)), kind)
    d = 0
    for p, book in enumerate(books):
        tables = []
        for j in range(book.shape[1]):
            values, codes = columns[d + j]
            tables.append(((values.astype(kind)[:, None] - book[:, j].astype(kind)[None, :]) ** 2, codes))
        for at in range(0, n, GATHER):
            total = np.zeros((min(GATHER, n - at), len(book)), kind)
            for table, codes in tables:
                total += table[codes[at:at + GATHER]]
            best = total.argmin(axis=1)
            index[at:at + GATHER, p], error[at:at + GATHER, p] = best, total[np.arange(len(total)), best]
        d += book.shape[1]
    return index, error


def _limbs(x: int) -> list[int]:
    """Low to high; only the highest is negative, so limbs of many rows add up in 64 bits."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(x & ((1 << LIMB) - 1))
        x >>= LIMB
    return [*out, x]


def _sums(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Per part, entry and place: number of assigned parts and the limbs of their sum; each task adds up its blocks."""
    def run(batches):
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for r in batch.to_pylist():
                columns = pickle.loads(r["body"])
                index, _ = _assign(columns, books, r["rows"])
                d = 0
                for p, book in enumerate(books):
                    count[p] += np.bincount(index[:, p], minlength=len(book))
                    for j in range(book.shape[1]):
                        values, codes = columns[d + j]
                        # How often each dictionary value went to each entry, then values by times.
                        times = np.bincount(codes.astype(np.int64) * len(book) + index[:, p], minlength=len(values) * len(book)).reshape(len(values), -1)
                        total[p][:, j] += (values[:, None] * times).sum(axis=0)
                    d += book.shape[1]
        rows = [(p, e, j, int(count[p][e]), *_limbs(int(total[p][e, j])))
                for p, b in enumerate(books) for e in range(len(b)) if count[p][e] for j in range(b.shape[1])]
        if rows:
            names = [x.split()[0] for x in SUMS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 3 else pa.int64()) for k, c in enumerate(zip(*rows))], names=names)

    return blocks.mapInArrow(run, SUMS).groupBy("part", "entry", "place").agg(*[F.sum(c).alias(c) for c in ["n", *(f"l{i}" for i in range(LIMBS))]])


def _narrow(book: list[list[int]]) -> np.ndarray:
    flat = [abs(v) for row in book for v in row]
    return np.array(book, np.int64 if max(flat, default=0) < SMALL else object).reshape(len(book), -1)


def _floor_div(row) -> int:
    return sum(row[f"l{i}"] << (LIMB * i) for i in range(LIMBS)) // row["n"]


def train(blocks: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after ``rounds`` of assigning every part and taking the floor of each entry's mean; unused entries stay.

    What reaches the driver is parts x entries x width sums, no matter how many rows there are.
    """
    for _ in range(rounds):
        fresh = [[list(map(int, e)) for e in b] for b in books]
        for r in _sums(blocks, books).collect():
            fresh[r["part"]][r["entry"]][r["place"]] = _floor_div(r)
        books = [_narrow(b) if len(b) else old for b, old in zip(fresh, books)]
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped. The width is that of the smallest vec_id's vector;
    vectors of another width, and all of them if ``parts`` does not divide it, are kept with null code and error.
    Codebooks start from the smallest ``entries`` vec_ids (fewer where there are fewer; equal ids by their vectors;
    null ids come last). Repeated rows are coded each by itself; null labels count as one label; extra columns are
    ignored; an empty table gives no rows. Errors that 64 bits cannot hold are null.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits an entry")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(_usable(F.col("vector")))
    order = (F.col("vec_id").asc_nulls_last(), "vector")
    first = [r["vector"] for r in rows.orderBy(*order).limit(entries).collect()]
    width = len(first[0]) if first else 0
    sound = width > 0 and width % parts == 0
    usable = rows.filter(F.size("vector") == width)
    if sound and any(len(v) != width for v in first):
        first = [r["vector"] for r in usable.orderBy(*order).limit(entries).collect()]
    seeds = first if sound else []
    each = width // parts if sound else 0
    start = _integers(np.array(seeds, np.float64).ravel(), scale).reshape(len(seeds), -1) if seeds else np.zeros((0, 0), np.int64)
    books = [_narrow([list(map(int, r)) for r in start[:, p * each:(p + 1) * each]]) for p in range(parts)] if seeds else []
    blocks = saved(_write(usable.select("vec_id", "label", "vector"), width, scale)) if seeds else None
    if seeds:
        books = train(blocks, books, rounds)
        coded = _coded(blocks, books, rows.schema["label"].dataType.simpleString())
    else:
        coded = rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    odd = rows.filter(F.size("vector") != width) if sound else rows
    coded = coded.union(odd.select("vec_id", "label", F.lit(None).cast("string"), F.lit(None).cast("long")))
    if seeds:
        coded = saved(coded)
    # A label that most rows share is one row here after the tasks' own sums.
    totals = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count_if(F.col("code").isNotNull() & F.col("error").isNull()).alias("_big"))
    totals = totals.select(F.col("label").alias("_label"), F.when(F.col("_big") == 0, F.col("label_error")).alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _coded(blocks: DataFrame, books: list[np.ndarray], label: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                index, error = _assign(pickle.loads(r["body"]), books, r["rows"])
                digits = np.array([f"{i:02x}" for i in range(max(len(b) for b in books))])
                total = [int(e) for e in error.sum(axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pickle.loads(r["keys"]), pa.int64()), pa.array(pickle.loads(r["labels"]), wanted),
                     pa.array(["".join(row) for row in digits[index].tolist()], pa.string()), pa.array([e if e < 1 << 63 else None for e in total], pa.int64())],
                    names=["vec_id", "label", "code", "error"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    wanted = to_arrow_type(_parse_datatype_string(label))
    return blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): the codebook entries a code stands for, as components; null for null codes."""
    flat = F.array(*[F.array(*[F.lit([float(v) / scale for v in e]) for e in b]) for b in books])
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.select("vec_id", F.when(F.col("code").isNotNull(), F.flatten(F.array(*[F.get(F.get(flat, F.lit(p)), at(p)) for p in range(len(books))]))).alias("vector"))
