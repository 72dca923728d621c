"""Summaries of call logs and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.operators.graph import written


def histograms(calls: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) of several fields at once; null counts as the value None. One pass: rows are spread before a combined count."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("None")).alias("value")) for f in fields))
    return calls.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))


def latency(calls: DataFrame, keys: list[str], value: str = "latency") -> DataFrame:
    """Count, least, mean, greatest and the nearest-rank 50th, 95th and 99th percentiles of a value.

    Equal values are counted first. The distinct ones are dealt by ranges of group and value;
    the counts of whole ranges, a few rows for each, tell where a range begins in its group, and
    running counts within it tell the place. So one group may span all tasks.
    """
    some = calls.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    dealt = written(some.repartitionByRange(*keys, "v").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "part").agg(F.sum("c").alias("c"))
    own = Window.partitionBy(*keys)
    before = parts.select(*keys, "part", (F.sum("c").over(own.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(own).alias("n"))
    same = None
    for k in [*keys, "part"]:
        cond = F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = cond if same is None else same & cond
    placed = dealt.alias("d").join(before.alias("b"), same).select("d.*", "before", "n")
    upto = F.sum("c").over(Window.partitionBy(*keys, "part").orderBy("v")) + F.col("before")
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(F.lit(p) * (F.col("n") - 1)), F.col("v")))
    return placed.withColumn("upto", upto).groupBy(*keys).agg(F.sum("c").alias("n"), F.min("v").alias("least"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.max("v").alias("greatest"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def request_rows(calls: DataFrame) -> DataFrame:
    """calls (http_status, geocoding_status, failure, said_error, ...) with ok and error: ok are answers of status 200 without a failure whose result isn't an error; a failure is told before what the answer says."""
    ok = F.coalesce(F.col("http_status") == 200, F.lit(False)) & F.col("failure").isNull() & F.coalesce(F.col("geocoding_status") != "error", F.lit(True))
    return calls.withColumns({"ok": ok, "error": F.coalesce(F.nullif("failure", F.lit("")), F.col("said_error"))}).drop("failure", "said_error")
