"""Bucketed tables in the shared folder: written once, joined and grouped on their keys without moving again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path


def default_buckets(spark: SparkSession) -> int:
    """As many buckets as shuffles have partitions, so that what meets the table is moved to its buckets and not the other way."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(rows: DataFrame, table: str, keys: list[str], order: list[str] = (), buckets: int | None = None,
                   path: str | None = None) -> DataFrame:
    """``rows`` as table ``table``, bucketed by ``keys`` and sorted within by ``keys`` and ``order``; returns the table.

    Rows are dealt out by the bucket function first, so a bucket is one file. ``path`` makes the table external; a table
    of that name is replaced.
    """
    spark = rows.sparkSession
    n = buckets or default_buckets(spark)
    writer = (rows.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys)
              .sortBy(*keys, *order).mode("overwrite"))
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return spark.table(table)


def stored(rows: DataFrame, keys: list[str], order: list[str] = (), buckets: int | None = None) -> DataFrame:
    """``write_bucketed`` under a new name, with the files in the folder that ``spark.checkpoint.dir`` names."""
    name = f"sheaf_{uuid.uuid4().hex}"
    return write_bucketed(rows, name, keys, order, buckets, shared_path(rows.sparkSession, name))
