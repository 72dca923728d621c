"""Route sheets as imports: items, their states and corrections, and logs of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import scalars
from routeloom.functions import text as T
from routeloom.operators import snapshots

#: States of runs and imports.
RUN_STATES = ("pending", "running", "completed", "failed")


def numbered(rows: DataFrame) -> DataFrame:
    """rows (import_id, image, pos) with row_number over all images of an import, from 1."""
    return rows.withColumn("row_number", F.row_number().over(Window.partitionBy("import_id").orderBy("image", "pos")))


def items(rows: DataFrame) -> DataFrame:
    """Items (import_id, row_number, store, address, confidence, status, geocoding_status) of parsed rows: what isn't sure needs a look."""
    sure = scalars.clamp(F.coalesce("confidence", F.lit(0.65)), 0.0, 0.99)
    return numbered(rows).select("import_id", "row_number", "store", F.nullif(F.trim("address"), F.lit("")).alias("address"), sure.alias("confidence"), F.lit("parsed").alias("status"), F.lit("pending").alias("geocoding_status"))


def geocoded(items: DataFrame, results: DataFrame) -> DataFrame:
    """items (id, address, corrected, confidence) with what the geocoder says of them (id, address_id, geocoding_status, score, normalized_address, error).

    Found ones with a combined confidence of 0.85 are recognised; the others, those without a
    text and those without a result need a look.
    """
    text = scalars.first_filled(F.col("corrected"), F.col("address"))
    both = items.drop("address_id", "geocoding_status", "status", "normalized_address", "error").join(results.withColumnRenamed("geocoding_status", "_state"), "id", "left").withColumn("_text", text)
    state = F.when(F.col("_text").isNull(), "not_found").otherwise(F.coalesce("_state", F.lit("error")))
    sure = F.when(state == "error", F.col("confidence")).when(F.col("_text").isNull(), F.col("confidence")).otherwise(scalars.combined_confidence(F.col("confidence"), F.col("score")))
    out = both.withColumns({"geocoding_status": state, "confidence": sure})
    out = out.withColumn("status", F.when((F.col("geocoding_status") == "found") & (F.col("confidence") >= 0.85), "recognized").otherwise("needs_review"))
    error = F.when(F.col("_text").isNull(), "No address text was extracted.").otherwise(F.col("error"))
    ids = {c: F.when(F.col("_text").isNotNull(), F.col(c)) for c in ("address_id", "normalized_address")}
    return out.withColumns({"error": error, **ids}).drop("_state", "_text", "score")


def corrected(items: DataFrame, patches: DataFrame) -> DataFrame:
    """items with a user's patches (id, store, address, status; null: as it is): a new address makes the item wait for the geocoder again."""
    p = patches.select("id", F.struct(F.trim("store").alias("store"), F.nullif(F.trim("address"), F.lit("")).alias("address"), "status").alias("p"))
    both = items.join(p, "id", "left")
    new = F.col("p.address").isNotNull()
    out = {
        "store": F.coalesce("p.store", "store"),
        "address": F.coalesce("p.address", "address"),
        "corrected": F.coalesce("p.address", "corrected"),
        "normalized_address": F.coalesce(T.cache_key(F.col("p.address")), "normalized_address"),
        "status": F.coalesce("p.status", "status"),
        "geocoding_status": F.when(new, "pending").otherwise(F.col("geocoding_status")),
        "address_id": F.when(~new, F.col("address_id")),
        "error": F.when(F.col("p").isNull(), F.col("error")),
    }
    return both.select(*((out[c] if c in out else F.col(c)).alias(c) for c in items.columns))


def kind(status: Column, geocoding: Column, address_id: Column) -> Column:
    """How an item is shown: rejected, duplicate, ready, failed or review."""
    return (
        F.when(status.isin("rejected", "duplicate"), status)
        .when((geocoding == "found") & address_id.isNotNull(), "ready")
        .when(geocoding.isin("not_found", "error"), "failed")
        .otherwise("review")
    )


def confirm(items: DataFrame, included: DataFrame | None = None, without_problems: bool = True) -> DataFrame:
    """items with `decision` (confirmed, problem or excluded); confirmed ones change their status.

    included (id) are those to take, all if None. Rejected items and duplicates are excluded; those
    without a found address are problems, which keep the import from going on unless they are
    left out (see blocked).
    """
    chosen = items if included is None else items.join(included.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
    wanted = F.lit(True) if included is None else F.col("_in").isNotNull()
    took = wanted & ~F.coalesce(F.col("status").isin("rejected", "duplicate"), F.lit(False))
    good = F.col("address_id").isNotNull() & F.coalesce(F.col("geocoding_status") == "found", F.lit(False))
    decision = F.when(took & good, "confirmed").when(took, "excluded" if without_problems else "problem").otherwise("excluded")
    out = chosen.withColumn("decision", decision)
    return out.withColumn("status", F.when(F.col("decision") == "confirmed", "confirmed").otherwise(F.col("status"))).select(*items.columns, "decision")


def blocked(decided: DataFrame) -> DataFrame:
    """(import_id, error) of the imports that can't go on: problems are left, or nothing is confirmed."""
    out = decided.groupBy("import_id").agg(F.count_if(F.col("decision") == "problem").alias("p"), F.count_if(F.col("decision") == "confirmed").alias("c"))
    error = F.when(F.col("p") > 0, "Some imported records are not geocoded. Fix them or choose to exclude problematic rows.").when(F.col("c") == 0, "No confirmed geocoded rows are available for route building.")
    return out.select("import_id", error.alias("error")).filter("error IS NOT NULL")


def waypoints(decided: DataFrame, addresses: DataFrame) -> DataFrame:
    """(import_id, pos, address, lat, lon) of the confirmed items in their order, the point null where the address has none."""
    a = addresses.select(F.col("id").alias("address_id"), "lat", "lon")
    rows = decided.filter("decision = 'confirmed'").join(a, "address_id", "left")
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    pos = F.row_number().over(Window.partitionBy("import_id").orderBy("row_number"))
    return rows.select("import_id", pos.alias("pos"), F.coalesce("corrected", "address").alias("address"), *(F.when(there, F.col(c)).alias(c) for c in ("lat", "lon")))


def without_notes(rows: DataFrame, words: tuple[str, ...] = ("grid", "test")) -> DataFrame:
    """rows (provider, notes) without the manual ones whose notes hold one of the words; null notes stay."""
    held = F.lit(False)
    for w in words:
        held = held | F.ilike("notes", F.lit(f"%{w}%"))
    return rows.filter(~F.coalesce((F.col("provider") == "manual") & held, F.lit(False)))


def run_log(events: DataFrame) -> DataFrame:
    """(run_id, status, started_at, finished_at, error, report) from events (run_id, at, status, error, report) that are only ever appended.

    The last event's status holds; a run is finished by completed or failed; a later error or
    report replaces an earlier one, null changes nothing.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    done = F.col("status").isin("completed", "failed")
    return events.groupBy("run_id").agg(F.max_by("status", "at").alias("status"), F.min("at").alias("started_at"), F.max(F.when(done, F.col("at"))).alias("finished_at"), last("error").alias("error"), last("report").alias("report"))


def report_json(counters: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `report`, the other columns' sums as a JSON object."""
    names = [c for c in counters.columns if c not in keys]
    return counters.groupBy(*keys).agg(F.to_json(F.struct(*(F.sum(c).alias(c) for c in names))).alias("report"))


def states(imports: DataFrame, changes: DataFrame) -> DataFrame:
    """imports (id, status, raw_text, error, engine) after changes of the same columns, null: as it is; an error goes with the next state."""
    new = changes.withColumn("_e", F.lit(True))
    return snapshots.upsert(imports, new, ["id"], {"status": snapshots.old_unless_null, "raw_text": snapshots.old_unless_null, "engine": snapshots.old_unless_null}, insert=False).drop("change")


def better_recognition(a_rows: Column, a_text: Column, b_rows: Column, b_text: Column) -> Column:
    """Whether the first of two recognitions is strictly better: more rows, then a longer text."""
    return (a_rows > b_rows) | ((a_rows == b_rows) & (F.length(F.coalesce(a_text, F.lit(""))) > F.length(F.coalesce(b_text, F.lit("")))))
