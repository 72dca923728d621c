"""Tables kept as snapshots: inserts, updates and deletions as joins by key that give the next snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def new_wins(old: Column, new: Column) -> Column:
    return new


def old_unless_null(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def fill_blank(old: Column, new: Column) -> Column:
    """The new value only where the old one is null or blank."""
    return F.coalesce(F.nullif(F.trim(old), F.lit("")), new)


def greatest(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Rule] | None = None, keep: Column | None = None, insert: bool = True, update: bool = True) -> DataFrame:
    """The next snapshot, with old's columns and `change` (inserted, updated, kept).

    keys must be unique on both sides (see first_per_key) and don't match where null. A column's
    rule makes its value from the old and the new one, by default the new one where new has the
    column. `keep` is a condition over o.* of rows that must not change.
    """
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    cond = None
    for k in keys:
        c = F.col(f"o.{k}") == F.col(f"n.{k}")
        cond = c if cond is None else cond & c
    both = o.join(n, cond, "full_outer")
    held = F.col("o._o").isNotNull()
    frozen = F.lit(not update) if keep is None else (F.coalesce(keep, F.lit(False)) | F.lit(not update))
    change = F.when(~held, "inserted").when(F.col("n._n").isNull() | frozen, "kept").otherwise("updated")
    out = []
    for c in old.columns:
        if c in keys:
            value = F.coalesce(f"o.{c}", f"n.{c}")
        elif c in new.columns:
            made = (rules or {}).get(c, new_wins)(F.col(f"o.{c}"), F.col(f"n.{c}"))
            value = F.when(change == "inserted", F.col(f"n.{c}")).when(change == "updated", made).otherwise(F.col(f"o.{c}"))
        else:
            value = F.col(f"o.{c}")
        out.append(value.alias(c))
    res = both.select(*out, change.alias("change"))
    return res if insert else res.filter("change <> 'inserted'")


def changes(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("change").agg(F.count("*").alias("n"))


def deactivate_missing(old: DataFrame, source_keys: DataFrame, keys: list[str]) -> DataFrame:
    """old with is_active false for rows whose key is not in the source; an empty source changes nothing."""
    seen = source_keys.select(*keys).distinct().withColumn("_seen", F.lit(True))
    some = source_keys.limit(1).agg((F.count("*") > 0).alias("_some"))  # one row
    out = old.join(seen, keys, "left").crossJoin(F.broadcast(some))
    gone = F.col("_some") & F.col("_seen").isNull()
    return out.withColumn("is_active", F.when(gone, F.lit(False)).otherwise(F.col("is_active"))).select(*old.columns)


def mark_later(df: DataFrame, key: Column, order: list, id_column: str = "id", frozen: Column | None = None) -> DataFrame:
    """df with duplicate_of: the id of the first row with the same key, for later rows; null keys and frozen rows are left alone, though frozen ones count as first."""
    w = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumn("_k", key).withColumn("_f", F.first(id_column).over(w))
    mark = F.when(F.col("_k").isNotNull() & (F.col("_f") != F.col(id_column)) & ~(F.coalesce(frozen, F.lit(False)) if frozen is not None else F.lit(False)), F.col("_f"))
    return out.withColumn("duplicate_of", mark).drop("_k", "_f")
