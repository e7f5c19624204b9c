"""Ordered computations over keys of any size.

A plain window puts a whole key into one task. These helpers split a key into
blocks of its (integer) order column first, so that one key holding a third of
the rows is still spread over many tasks; only one row per block meets again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import col

BLOCK = 65_536
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, keys: list[str], order: str, measures: dict[str, tuple[str, Column]], *,
            block: int = BLOCK, descending: bool = False, exclusive: bool = False) -> DataFrame:
    """Running aggregates per key over an integer order column, unique within a key.

    ``measures`` maps an output name to (``"sum" | "min" | "max"``, input column); ``exclusive`` leaves the
    current row out. Blocks are ranges of the order column, so the split is the same on every retry.
    """
    src = df.withColumn("_blk", F.floor(col(order) / block))
    src = src.select("*", *[value.alias(f"_in_{name}") for name, (_, value) in measures.items()])
    by = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inner = W.partitionBy(*keys, "_blk").orderBy(by(order)).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    rows = src.select("*", *[_MERGE[kind](f"_in_{name}").over(inner).alias(f"_run_{name}")
                             for name, (kind, _) in measures.items()])
    totals = src.groupBy(*keys, "_blk").agg(
        *[_MERGE[kind](f"_in_{name}").alias(f"_tot_{name}") for name, (kind, _) in measures.items()])
    before = W.partitionBy(*keys).orderBy(by("_blk")).rowsBetween(W.unboundedPreceding, -1)
    prefix = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_blk").alias("_b"),
        *[_MERGE[kind](f"_tot_{name}").over(before).alias(f"_pre_{name}") for name, (kind, _) in measures.items()])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_blk") == F.col("_b")]
    out = []
    for name, (kind, _) in measures.items():
        run, pre = F.col(f"_run_{name}"), F.col(f"_pre_{name}")
        if kind == "sum":
            value = F.coalesce(pre, F.lit(0)) + F.coalesce(run, F.lit(0))
        else:
            value = (F.least if kind == "min" else F.greatest)(run, pre)
        out.append(value.alias(name))
    return rows.join(prefix, on, "left").select(*df.columns, *out)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    ``row_number() <= k`` lets Spark keep k rows per key in each task before the shuffle
    (WindowGroupLimit), so a hot key never travels whole.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_rn").drop("_rn")


def scalar_count(df: DataFrame) -> Column:
    """``SELECT count(*)`` as a scalar subquery: the total without a one-task window."""
    return df.select(F.count(F.lit(1))).scalar()
