"""Tables, scratch storage and row ids shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: What materialise() has written in each of the scopes that are open, the innermost last.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())
#: Rows that Spark hands to Python at once; its default of 10,000 whole texts takes much memory in every task.
_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")

#: Joins are planned with shuffles at every size, and turned into broadcasts only by sizes that Spark has measured.
MEASURED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is named and driver and tasks are one process (tests)."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="routeloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


@contextmanager
def scope(spark: SparkSession, settings: dict[str, str] | None = None) -> Iterator[None]:
    """Deletes at its end what materialise() has written in it, but for tables to keep, which belong to the scope around it.

    Texts go to Python in smaller batches meanwhile, unless the session says otherwise; settings
    hold meanwhile, too. All are put back at the end.
    """
    own: list[str] = []
    held = dict(settings or {})
    if spark.conf.get(_BATCH[0], _BATCH[1]) == _BATCH[1]:
        held.setdefault(_BATCH[0], _BATCH[2])
    before = {k: spark.conf.get(k, None) for k in held}
    token = _written.set((*_written.get(), own))
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        _written.reset(token)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        release(spark, own)
        # shuffle files go once the driver has let go of the plans that wrote them
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()


def materialise(df: DataFrame, label: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and a lost executor costs nothing that was written.

    With keep, the table outlives the scope in which it is written; results rest on such tables.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/routeloom-{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", codec).parquet(path)
    open_scopes = _written.get()[:-1] if keep else _written.get()
    if open_scopes:
        open_scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of the shared storage."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def fresh_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """A new folder in the shared one, gone at the end."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    try:
        yield path
    finally:
        release(spark, [path])


def meet(rows: DataFrame, table: DataFrame, on: list[str], by: str, how: str = "inner", bundles: int = 128) -> DataFrame:
    """rows joined with a table that has each key once at most, whatever share of the rows has one key.

    Rows of a key travel in bundles, dealt by a hash of the column `by`, and at most `bundles`
    of them meet the key in one task. how is inner or left; a null key meets nothing.
    """
    rest = [c for c in rows.columns if c not in on]
    packed = rows.groupBy(*on, F.pmod(F.xxhash64(by), F.lit(bundles)).alias("_bundle")).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    both = packed.join(table, on, how).drop("_bundle")
    return both.withColumn("_rows", F.explode("_rows")).select(*on, *(F.col("_rows")[c].alias(c) for c in rest), *(c for c in table.columns if c not in on))


def running_sums(rows: DataFrame, group: str | None, order: list[str], sums: dict[str, str], of_group: DataFrame | None = None) -> DataFrame:
    """rows with, for each name in sums, the sum of that column over the rows before: those of the same group, in the given order.

    However large a group is, no task holds more of it than a run: rows are sorted by range into
    runs, which are written; sums of whole runs (a row for each run and group) give what lies
    before a run, a window within the run the rest. group has no nulls, or is None for all rows;
    of_group is a table with each group once at most, whose columns are added on the way. Rows
    that order can't tell apart stand in any order.
    """
    keys = [group] if group else []
    runs = materialise(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_run", F.spark_partition_id()), "runs")
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    whole = runs.groupBy("_run", *keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    base = whole.select("_run", *keys, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    if of_group is not None:
        base = base.join(of_group, keys)
    within = Window.partitionBy("_run", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = runs.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()))
    both = own.join(base, ["_run", *keys]).withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums})
    return both.drop("_run", *(f"_{n}" for n in sums))


def with_row_id(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns doc_id and keep, and the long column rid, which names a row; keep holds no column of that name.

    doc_id serves if it is an integer, never null and never repeated (two counts over that
    one column tell); otherwise rows get ids of their own, written first so that they hold.
    """
    if "rid" in keep:
        raise ValueError("rid names the row id; rename the column or fold it into a struct")
    df = df.select("doc_id", *keep)
    if df.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte"):
        n = df.groupBy("doc_id").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count_if(F.col("doc_id").isNull())).first()
        if n[0] <= 1 and n[1] == 0:
            return df.withColumn("rid", F.col("doc_id").cast("long"))
    return materialise(df.withColumn("rid", F.monotonically_increasing_id()), "rows", keep=True)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's vocabulary lies; ROUTELOOM_TOKENIZERS overrides the folder."""
    if folder := os.environ.get("ROUTELOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
