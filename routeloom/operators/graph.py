"""Tables that several joins read, written where all executors can read them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """A folder of the application's own, gone when Python ends: in the shared folder that the cluster names, or a local one where none is named and driver and tasks are one process (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _folders[app] = f"{(named or 'file://' + tempfile.mkdtemp(prefix='routeloom-')).rstrip('/')}/routeloom-{app}"
        atexit.register(_delete, spark, _folders[app])
    return _folders[app]


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the shared folder as Parquet and read again."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
