"""Files that arrive over time: snapshots kept up to date, requests seen once, samples by time window.

Each step is an ordinary DataFrame function wherever it can be, so batch and stream share it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators.snapshots import Rule, first_per_key, upsert


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Batches whose snapshot is complete: Spark's mark of success is there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or ())


def snapshot(spark: SparkSession, root: str, schema: str, before: int | None = None) -> DataFrame:
    """The latest complete snapshot (of a batch before the one named); no rows if there is none."""
    known = [v for v in _versions(spark, root) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{root}/batch={known[-1]}") if known else spark.createDataFrame([], schema)


def keep_snapshot(stream: DataFrame, root: str, schema: str, keys: list[str], order: list[Column | str], checkpoint: str, rules: dict[str, Rule] | None = None, keep: Column | None = None):
    """Starts a query that folds each arriving batch into the next snapshot under root, and ends when no input is left.

    A batch's rows are made unique by key, the first in order counting. Each batch writes a
    folder of its own from the snapshot before it, so one repeated after a failure gives
    the same rows and no reader sees half of a snapshot.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = snapshot(spark, root, schema, number)
        new = first_per_key(batch.filter(F.concat(*(F.col(k).cast("string") for k in keys)).isNotNull()), keys, order)
        upsert(old, new, keys, rules, keep).drop("change").write.mode("overwrite").parquet(f"{root}/batch={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seen_once(requests: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key's first request; what is older than the delay is forgotten, which bounds the state."""
    if not requests.isStreaming:
        return first_per_key(requests, keys, [time])
    return requests.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def samples(readings: DataFrame, time: str, value: str, every: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """(begun, n, least, mean, greatest) of the readings within each window of time."""
    rows = readings.withWatermark(time, delay) if readings.isStreaming else readings
    rows = rows.groupBy(F.window(time, every).alias("w")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("greatest"))
    return rows.select(F.col("w.start").alias("begun"), "n", "least", "mean", "greatest")


def last_used(table: DataFrame, touches: DataFrame, key: str, time: str = "last_used_at") -> DataFrame:
    """table with the latest time of use of each row, by touches (key, time); rows without any keep theirs."""
    latest = touches.groupBy(key).agg(F.max(time).alias("_t"))
    return table.join(latest, key, "left").withColumn(time, F.greatest(time, "_t")).drop("_t")


def run_now(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Starts a query that appends what has arrived, changed, to Parquet and ends."""
    return change(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
