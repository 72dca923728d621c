"""Reports filled up from reverse answers, places filled up from their surroundings, and what goes on to the cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import text as T
from routeloom.functions.scalars import first_filled, safe_double
from routeloom.operators import snapshots

#: Which keys of an answer's address fill a column, the first filled one of each.
PARTS = {
    "city": ("city", "town", "village", "hamlet", "municipality"),
    "district": ("city_district", "district", "county"),
    "suburb": ("suburb", "neighbourhood", "quarter"),
    "street": ("road", "pedestrian", "footway", "path"),
    "house_number": ("house_number",),
    "postcode": ("postcode",),
}


def part(address: Column, name: str) -> Column:
    return first_filled(*(F.element_at(address, k) for k in PARTS[name]))


def compact_address(address: Column, display: Column) -> Column:
    """Town (or suburb), street and house of an address; the display name where there is none of them."""
    street, house = part(address, "street"), part(address, "house_number")
    line = F.concat_ws(", ", F.coalesce(part(address, "city"), part(address, "suburb")), street, house)
    return F.coalesce(F.nullif(line, F.lit("")), display)


def coordinate_key(lat: Column, lon: Column) -> Column:
    """Seven decimals of both, under which an answer is kept; null if one is missing."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.7f,%.7f", lat, lon))


def wanted(rows: DataFrame, every: bool = False) -> DataFrame:
    """(key, lat, lon), one for each different coordinate of the rows that an answer is to be asked for: those without an address, or all."""
    r = rows.withColumns({"lat": safe_double(F.col("latitude")), "lon": safe_double(F.col("longitude"))})
    if not every:
        r = r.filter(first_filled(F.col("address")).isNull())
    keyed = r.withColumn("key", coordinate_key(F.col("lat"), F.col("lon"))).filter("key IS NOT NULL")
    return keyed.groupBy("key").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))


def edited_warnings(warnings: Column) -> Column:
    """A list of warnings that no longer says ADDRESS_MISSING and says REVERSE_GEOCODED at its end."""
    kept = F.filter(F.transform(F.coalesce(warnings, F.array().cast("array<string>")), lambda p: F.trim(p)), lambda w: (w != "") & (w != "ADDRESS_MISSING"))
    return F.when(F.array_contains(kept, F.lit("REVERSE_GEOCODED")), kept).otherwise(F.concat(kept, F.array(F.lit("REVERSE_GEOCODED"))))


def fill(rows: DataFrame, answers: DataFrame, every: bool = False, overwrite: bool = False) -> DataFrame:
    """Report rows (latitude, longitude, address, warnings; all text) with twelve reverse_ columns, the address filled where it is empty.

    answers: (key, display_name, address as a map, osm_type, osm_id), one for each coordinate
    (see wanted); a coordinate without one is not found. A filled row's warnings are edited.
    """
    lat, lon = safe_double(F.col("latitude")), safe_double(F.col("longitude"))
    full = first_filled(F.col("address"))
    r = rows.withColumn("_key", coordinate_key(lat, lon))
    a = answers.select(F.col("key").alias("_key"), F.struct("display_name", "address", "osm_type", "osm_id").alias("_a"))
    both = r.join(a, "_key", "left")
    skipped = F.lit(False) if every else full.isNotNull()
    status = F.when(skipped, "skipped_existing_address").when(F.col("_key").isNull(), "error").when(F.col("_a").isNull(), "not_found").otherwise("found")
    both = both.withColumn("reverse_status", status)
    found = F.col("reverse_status") == "found"
    answer = F.when(found, compact_address(F.col("_a.address"), F.col("_a.display_name")))
    error = F.when(F.col("reverse_status") == "error", "Missing or invalid latitude/longitude").when(F.col("reverse_status") == "not_found", "Nominatim returned no address")
    given = lambda c: F.coalesce(F.when(found, c), F.lit(""))
    both = both.withColumns(
        {"reverse_address": F.coalesce(answer, F.lit("")), "reverse_display_name": given(F.col("_a.display_name"))}
        | {f"reverse_{n}": given(part(F.col("_a.address"), n)) for n in PARTS}
        | {"reverse_osm_type": given(F.col("_a.osm_type")), "reverse_osm_id": given(F.col("_a.osm_id").cast("string")), "reverse_error": F.coalesce(error, F.lit(""))}
    )
    fills = found & (F.col("reverse_address") != "") & (F.lit(overwrite) | full.isNull())
    listed = F.split(F.coalesce("warnings", F.lit("")), ";")
    out = both.withColumns({"warnings": F.when(fills, F.array_join(edited_warnings(listed), ";")).otherwise(F.col("warnings")), "address": F.when(fills, F.col("reverse_address")).otherwise(F.col("address")), "filled": fills})
    return out.drop("_key", "_a")


def fill_counts(filled: DataFrame) -> DataFrame:
    """One row of totals over fill()'s rows: found, not found, errors, skipped, filled."""
    s = F.col("reverse_status")
    return filled.agg(F.count("*").alias("rows"), F.count_if(s == "found").alias("found"), F.count_if(s == "not_found").alias("not_found"), F.count_if(s == "error").alias("errors"), F.count_if(F.startswith(s, F.lit("skipped"))).alias("skipped"), F.count_if("filled").alias("filled"))


def fill_places(places: DataFrame, answers: DataFrame) -> DataFrame:
    """Places (id, lat, lon, city, district, suburb, street, house_number, postcode) with what their answers know beyond them; with street and house, nothing changes."""
    known = F.coalesce((F.length("street") > 0) & (F.length("house_number") > 0), F.lit(False))
    a = answers.select(F.col("key").alias("_key"), F.col("address").alias("_a"))
    both = places.withColumn("_key", coordinate_key(F.col("lat"), F.col("lon"))).join(a, "_key", "left")
    own = {n: F.when(known, F.col(n)).otherwise(F.coalesce(F.nullif(n, F.lit("")), part(F.col("_a"), n))) for n in PARTS if n in places.columns}
    return both.withColumn("_known", known).withColumns({n: F.when(F.col("_known"), F.col(n)).otherwise(v) for n, v in own.items()}).select(*places.columns)


def apply_report(places: DataFrame, report: DataFrame, now: Column) -> DataFrame:
    """The places' next snapshot with the addresses of report rows (osm_type, osm_id, address, confidence): filled where empty, the greater confidence."""
    new = report.filter("osm_id IS NOT NULL AND length(trim(address)) > 0").select("osm_type", "osm_id", "address", "confidence", now.alias("updated_at"))
    new = snapshots.first_per_key(new, ["osm_type", "osm_id"], [F.desc_nulls_last("confidence"), "address"])
    return snapshots.upsert(places, new, ["osm_type", "osm_id"], {"address": snapshots.fill_blank, "confidence": snapshots.greatest}, insert=False)


def report_coverage(report: DataFrame, places: DataFrame) -> DataFrame:
    """One row: report rows, those with a known place, those without one, and known places that no row names."""
    r, p = report.groupBy("osm_type", "osm_id").agg(F.count("*").alias("n")), places.select("osm_type", "osm_id").distinct().withColumn("k", F.lit(1))
    both = r.join(p, ["osm_type", "osm_id"], "full_outer")
    has = lambda c: F.col(c).isNotNull()
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(has("k"), F.col("n"))), F.lit(0)).alias("known"), F.coalesce(F.sum(F.when(~has("k"), F.col("n"))), F.lit(0)).alias("unknown"), F.count_if(has("k") & ~has("n")).alias("unnamed"))


def for_cache(places: DataFrame, default_city: str = "санкт-петербург") -> DataFrame:
    """Active places with an address and a point that aren't duplicates, one for each normalised address: the surest, then the latest, then the greatest id."""
    fit = places.filter("is_active AND NOT is_duplicate AND address IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    keyed = fit.withColumn("normalized_address", T.cache_key(F.col("address"), default_city)).filter("normalized_address IS NOT NULL")
    return snapshots.first_per_key(keyed, ["normalized_address"], [F.desc_nulls_last("confidence"), F.desc_nulls_last("updated_at"), F.desc("id")])


def way_point(nodes: DataFrame) -> DataFrame:
    """(way_id, lat, lon): the mean of a way's nodes (way_id, lat, lon) that have valid coordinates, null if none has.

    Nodes are added in the order of their coordinates, so that the last digits, and with them
    whether a mean lies on a border, don't turn on how rows are dealt.
    """
    good = F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))
    own = nodes.groupBy("way_id").agg(F.array_sort(F.collect_list(F.when(good, F.struct("lat", "lon")))).alias("p"))
    mean = lambda c: F.when(F.size("p") > 0, F.aggregate("p", F.lit(0.0), lambda a, x: a + x[c]) / F.size("p"))
    return own.select("way_id", *(mean(c).alias(c) for c in ("lat", "lon")))
