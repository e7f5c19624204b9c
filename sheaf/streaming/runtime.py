"""Sources and sinks shared by the streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import DEFAULTS, ensure_checkpoint_dir


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with lists and timers needs the RocksDB provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, DEFAULTS[key])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream of its parquet files: ``name*.parquet``, each a file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name}*.parquet")


def versions(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the sub-folders ``prefix<number>`` that were written whole, ascending; read from the store itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [x.getPath() for x in fs.listStatus(path)]
    whole = [p.getName() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[len(prefix):]) for n in whole if n.startswith(prefix) and n[len(prefix):].isdigit())


def run_available(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all available input into a parquet folder and read that back.

    Batches are written under their id, so a replayed batch replaces itself; ``batch`` orders updates. With a
    ``folder`` of the caller's, output and state stay there and a later run goes on where this one ended.
    """
    spark = stream.sparkSession
    use_rocksdb(spark)
    out, state = (f"{folder}/{name}", f"{folder}/{name}-state") if folder else (scratch(spark, name), scratch(spark, f"{name}-state"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(out)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update per key of an update-mode result."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_l"))
    return last.select(*keys, "_l.*")
