"""What several operators of this folder share: tables, words, shingle hashes, prefix sums, connected components."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.skew import running
from sheaf.session import ensure_checkpoint_dir

#: Blanks that end a word, as a character class and as plain characters.
BLANKS = r"[\x20\x09-\x0D]"
BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_of(c: Column | str) -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z only: other letters keep their length and form."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS + "+"), "")


def shingle_hashes(w: Column, n: int) -> Column:
    """XXH64 of every window of ``n`` words, hashed word after word without building strings.

    Fewer words than ``n``: the whole sequence, joined by blanks, is the only shingle; no word: no shingle.
    ``w`` must be a plain column: it is read by position, so an expression would be made anew for every window.
    """
    size = F.size(w)
    full = F.transform(
        F.sequence(F.lit(1), size - (n - 1)),
        lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(n)]))
    return (F.when(size >= n, full)
            .when(size > 0, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(F.array().cast("array<bigint>")))


def totals_before(sizes: DataFrame, key: str, size: str, out: str) -> DataFrame:
    """Adds the sum of ``size`` over all smaller keys; keys are unique integers, any number of them."""
    one = sizes.withColumn("_all", F.lit(1))
    return running(one, ["_all"], key, {out: ("sum", F.col(size))}, exclusive=True).drop("_all")


def saved(df: DataFrame) -> DataFrame:
    """Written to the cluster's shared folder and read again: made once, survives lost executors, and its size is known.

    The folder is the one ``spark.checkpoint.dir`` names; unlike ``checkpoint()`` the rows are computed a single time.
    """
    spark = df.sparkSession
    path = shared_path(spark, "saved")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Large-star and small-star rounds: every round is two aggregations and joins over the edges, and a star of
    any size is a minimum with partial aggregation before the shuffle. Ends when a round changes nothing.
    """
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        now = saved(_small_star(_large_star(now)))
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))), F.bit_xor(h)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node itself, is linked to the smallest of them. Edges hold b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).distinct()
