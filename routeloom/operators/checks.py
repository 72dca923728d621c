"""Rules that inputs must keep, as columns that name the first rule a row or a job breaks; null where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import geo

#: What a status may be, and the bounds of requests.
STATUSES = ("pending", "found", "not_found", "ambiguous", "manual", "error")
MOST_ADDRESSES, MOST_RADIUS_KM, LOW_CONFIDENCE = 100, 500.0, 75.0
ROUTE_TYPE = "auto"


def first_error(*rules: tuple[Column, str]) -> Column:
    """The text of the first rule whose condition holds; an unknown condition breaks nothing."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), text) for c, text in rules))


def ordered_points(points: DataFrame) -> DataFrame:
    """(job, error) for points (job, ord, type): two at least, no order twice, 0 to n - 1, a start first and an end last, stops between."""
    w = Window.partitionBy("job").orderBy("ord")
    n = F.count("*").over(Window.partitionBy("job"))
    at = points.select("job", "ord", "type", (F.row_number().over(w) - 1).alias("at"), n.alias("n"), (F.lag("ord").over(w) == F.col("ord")).alias("twice"))
    inner = (F.col("at") > 0) & (F.col("at") < F.col("n") - 1)
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    out = at.groupBy("job").agg(
        F.max("n").alias("n"), has(F.col("twice")).alias("twice"), has(F.col("ord") != F.col("at")).alias("gap"),
        has((F.col("at") == 0) & ~F.col("type").eqNullSafe("start")).alias("first"), has((F.col("at") == F.col("n") - 1) & ~F.col("type").eqNullSafe("end")).alias("last"),
        F.min_by("type", F.when(inner & ~F.col("type").eqNullSafe("waypoint"), F.col("at"))).alias("odd"), has(inner & ~F.col("type").eqNullSafe("waypoint")).alias("inner"),
    )
    c = F.col
    return out.select("job", first_error(
        (c("n") < 2, "ordered_points must contain at least start and end points"), (c("twice"), "ordered_points contain duplicate order values"), (c("gap"), "ordered_points order values must be sequential"),
        (c("first"), "First point must be start"), (c("last"), "Last point must be end"), (c("inner") & (c("odd") == "start"), "Start point must not appear in the middle of route"),
        (c("inner") & (c("odd") == "end"), "End point must not appear in the middle of route"), (c("inner"), "Intermediate points must have type waypoint"),
    ).alias("error"))


def link_batches(points: DataFrame) -> DataFrame:
    """(job, batch, error) for batch points (job, batch, place): two points at least, no place twice."""
    n = points.groupBy("job", "batch").agg(F.count("place").alias("n"), F.count_distinct("place").alias("d"))
    return n.select("job", "batch", first_error((F.col("n") < 2, "batch must contain at least two points"), (F.col("n") > F.col("d"), "duplicate batch_order values in batch")).alias("error"))


def batch_numbers(batches: DataFrame) -> DataFrame:
    """(job, error) for batches (job, pos, number): a missing number is the place in order, from 1, and none may stand twice."""
    at = F.row_number().over(Window.partitionBy("job").orderBy("pos"))
    own = batches.withColumn("number", F.coalesce(F.nullif("number", F.lit(0)), at))
    n = own.groupBy("job").agg(F.count("*").alias("n"), F.count_distinct("number").alias("d"))
    return n.select("job", first_error((F.col("n") > F.col("d"), "duplicate batch_number values")).alias("error"))


def city_slug(slug: Column) -> Column:
    return first_error((~F.rlike(slug, F.lit("^[a-z0-9-]+$")), "invalid city_slug"))


def route_type(kind: Column) -> Column:
    return first_error((kind != ROUTE_TYPE, "unsupported route_type"))


def coordinates(points: DataFrame, least: int = 2, most: int = 100) -> DataFrame:
    """(job, error) for points (job, lat, lon): so many of them, all on the globe."""
    n = points.groupBy("job").agg(F.count("*").alias("n"), F.count_if(~geo.valid_point("lat", "lon")).alias("bad"))
    return n.select("job", first_error((F.col("n") < least, "too few points"), (F.col("n") > most, "too many points"), (F.col("bad") > 0, "coordinates out of range")).alias("error"))


def address_rows(rows: DataFrame) -> DataFrame:
    """rows (status, confidence, lat, lon) with `error`: a status of the list, a confidence of 0 to 100, coordinates on the globe."""
    c = F.col
    return rows.withColumn("error", first_error((~c("status").isin(*STATUSES), "status"), (~c("confidence").between(0, 100), "confidence"), (~c("lat").between(-90, 90), "latitude"), (~c("lon").between(-180, 180), "longitude")))


def requests(rows: DataFrame) -> DataFrame:
    """requests (addresses, lat, lon, radius_km) with `error`: one to a hundred addresses, a point on the globe, a radius over 0 and up to 500 km."""
    c = F.col
    n = F.coalesce(F.size("addresses"), F.lit(0))
    return rows.withColumn("error", first_error((n < 1, "no addresses"), (n > MOST_ADDRESSES, "too many addresses"), (~c("lat").between(-90, 90), "latitude"), (~c("lon").between(-180, 180), "longitude"), (~((c("radius_km") > 0) & (c("radius_km") <= MOST_RADIUS_KM)), "radius")))


def unsure(rows: DataFrame) -> DataFrame:
    """Rows whose confidence (a percentage) is known and low."""
    return rows.filter(F.col("confidence") < LOW_CONFIDENCE)


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their error) of rows with `error`."""
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL")


def line_string(raw: Column) -> Column:
    """Coordinates (lon, lat) of a GeoJSON LineString of two points at least, all on the globe; null for anything else."""
    line = F.from_json(F.get_json_object(raw, "$.coordinates"), "array<array<double>>")
    on = lambda c: F.coalesce((F.size(c) >= 2) & F.get(c, F.lit(0)).between(-180, 180) & F.get(c, F.lit(1)).between(-90, 90), F.lit(False))
    good = (F.get_json_object(raw, "$.type") == "LineString") & (F.size(line) >= 2) & F.forall(line, on)
    return F.when(F.coalesce(good, F.lit(False)), line)


def line_points(raw: Column) -> Column:
    """(lat, lon) of a GeoJSON LineString's points, those that aren't numbers on the globe left out."""
    line = F.from_json(F.get_json_object(raw, "$.coordinates"), "array<array<double>>")
    pairs = F.transform(F.coalesce(line, F.array().cast("array<array<double>>")), lambda c: F.struct(F.get(c, F.lit(1)).alias("lat"), F.get(c, F.lit(0)).alias("lon")))
    return F.filter(pairs, lambda p: F.coalesce(p["lat"].between(-90, 90) & p["lon"].between(-180, 180), F.lit(False)))


def road_points(raw: Column) -> Column:
    """(lat, lon, name, distance) of a road service's waypoints, whose location is lon, lat; ones without a location are left out."""
    every = F.from_json(F.get_json_object(raw, "$.waypoints"), "array<struct<location:array<double>,name:string,distance:double>>")
    some = F.filter(F.coalesce(every, F.array().cast("array<struct<location:array<double>,name:string,distance:double>>")), lambda w: F.size(w["location"]) >= 2)
    return F.transform(some, lambda w: F.struct(w["location"][1].alias("lat"), w["location"][0].alias("lon"), F.coalesce(w["name"], F.lit("")).alias("name"), w["distance"].alias("distance")))


def road_request(points: Column, radius_m: int | None = None) -> Column:
    """lon,lat;lon,lat ... of points (lat, lon), and after a bar a radius for each if one is given."""
    text = F.array_join(F.transform(points, lambda p: F.format_string("%.6f,%.6f", p["lon"], p["lat"])), ";")
    return text if radius_m is None else F.concat_ws("|", text, F.array_join(F.transform(points, lambda p: F.lit(str(radius_m))), ";"))
