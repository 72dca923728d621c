"""Answers of outside services, fetched beforehand and kept as JSON text, as rows.

Spark never calls a service for a row: answers come as tables, with a column of JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ADDRESS = "STRUCT<house_number: STRING, road: STRING, city: STRING, town: STRING, village: STRING, suburb: STRING, state: STRING, postcode: STRING, country: STRING>"
_PLACE = f"STRUCT<lat: STRING, lon: STRING, display_name: STRING, importance: STRING, place_rank: STRING, osm_type: STRING, osm_id: STRING, address: {_ADDRESS}>"


def _finite(x: Column) -> Column:
    return x.try_cast("double")


def search_candidates(answers: DataFrame, keys: list[str], column: str = "response") -> DataFrame:
    """(keys, pos, lat, lon, display, importance, place_rank, address) of a search's JSON list.

    Places without readable coordinates, importance or rank go; pos keeps the list's numbering.
    """
    rows = answers.select(*keys, F.posexplode(F.from_json(column, f"ARRAY<{_PLACE}>")).alias("pos", "p"))
    lat, lon = _finite(F.col("p.lat")), _finite(F.col("p.lon"))
    whole = lambda c, t: F.col(c).isNull() | F.col(c).try_cast(t).isNotNull()
    rows = rows.filter(lat.isNotNull() & lon.isNotNull() & whole("p.importance", "double") & whole("p.place_rank", "int"))
    return rows.select(*keys, "pos", lat.alias("lat"), lon.alias("lon"), F.coalesce("p.display_name", F.lit("")).alias("display"), _finite(F.col("p.importance")).alias("importance"), F.col("p.place_rank").try_cast("int").alias("place_rank"), F.col("p.address").alias("address"))


def reverse_answers(answers: DataFrame, keys: list[str], column: str = "response") -> DataFrame:
    """(keys, lat, lon, display, city, street, house) of answers to coordinates; an answer without coordinates gives no row."""
    rows = answers.select(*keys, F.from_json(column, _PLACE).alias("p"))
    lat, lon = _finite(F.col("p.lat")), _finite(F.col("p.lon"))
    city = F.coalesce("p.address.city", "p.address.town", "p.address.village")
    return rows.filter(lat.isNotNull() & lon.isNotNull()).select(*keys, lat.alias("lat"), lon.alias("lon"), F.col("p.display_name").alias("display"), city.alias("city"), F.col("p.address.road").alias("street"), F.col("p.address.house_number").alias("house"))


def second_candidates(answers: DataFrame, keys: list[str], column: str = "response") -> DataFrame:
    """(keys, pos, lat, lon, display, confidence) of the second provider's results."""
    kind = "STRUCT<results: ARRAY<STRUCT<formatted: STRING, confidence: DOUBLE, geometry: STRUCT<lat: STRING, lng: STRING>>>>"
    rows = answers.select(*keys, F.posexplode(F.from_json(column, kind)["results"]).alias("pos", "p"))
    lat, lon = _finite(F.col("p.geometry.lat")), _finite(F.col("p.geometry.lng"))
    return rows.filter(lat.isNotNull() & lon.isNotNull()).select(*keys, "pos", lat.alias("lat"), lon.alias("lon"), F.coalesce("p.formatted", F.lit("")).alias("display"), "p.confidence")


def first_with_answers(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The first provider's candidates, and the second's for keys where the first has none."""
    return first.withColumn("provider", F.lit("first")).unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti").withColumn("provider", F.lit("second")), allowMissingColumns=True)


def matrix_cells(answers: DataFrame, keys: list[str], column: str = "response") -> DataFrame:
    """(keys, i, j, duration, distance) of a road matrix; null where there is no way."""
    kind = "STRUCT<durations: ARRAY<ARRAY<DOUBLE>>, distances: ARRAY<ARRAY<DOUBLE>>>"
    rows = answers.select(*keys, F.from_json(column, kind).alias("m")).select(*keys, "m", F.posexplode("m.durations").alias("i", "row"))
    cells = rows.select(*keys, "m", "i", F.posexplode("row").alias("j", "duration"))
    return cells.select(*keys, "i", "j", "duration", F.get(F.get("m.distances", F.col("i")), F.col("j")).alias("distance"))


def route_answers(answers: DataFrame, keys: list[str], column: str = "response") -> DataFrame:
    """(keys, distance_m, duration_s, geometry) of each answer's first route."""
    kind = "STRUCT<routes: ARRAY<STRUCT<distance: DOUBLE, duration: DOUBLE, geometry: STRING>>>"
    route = F.get(F.from_json(column, kind)["routes"], F.lit(0))
    return answers.select(*keys, route.alias("r")).select(*keys, F.col("r.distance").alias("distance_m"), F.col("r.duration").alias("duration_s"), "r.geometry")


def _text(v: Column, path: str) -> Column:
    return F.trim(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def sheet_lines(answers: DataFrame, keys: list[str], column: str = "response") -> DataFrame:
    """(keys, pos, text, confidence) of a reader's answer about an image.

    The lines of the answer count, plain or as objects; if none has text, its route points;
    if there are none, the rows of its table, by their own text or that of their cells.
    """
    v = F.try_parse_json(column)
    pair = lambda text, sure: F.struct(text.alias("text"), sure.try_cast("double").alias("confidence"))
    number = lambda x, path: F.try_variant_get(x, path, "double")
    nothing = F.lit(None).cast("double")
    lines = F.transform(_list(v, "$.lines"), lambda x: F.when(F.schema_of_variant(x) == "STRING", pair(_text(x, "$"), nothing)).otherwise(pair(_text(x, "$.text"), number(x, "$.confidence"))))
    points = F.filter(_list(v, "$.route_points"), lambda x: _text(x, "$.address") != "")
    raw = lambda x: F.coalesce(*(F.nullif(_text(x, p), F.lit("")) for p in ("$.raw_row_text", "$.raw_text", "$.address")))
    points = F.transform(points, lambda x: pair(raw(x), number(x, "$.confidence")))
    cells = lambda x: F.array_join(F.filter(F.transform(_list(x, "$.cells"), lambda c: _text(c, "$.text")), lambda t: t != ""), " ")
    table = F.transform(_list(v, "$.table.rows"), lambda x: pair(F.coalesce(F.nullif(_text(x, "$.raw_text"), F.lit("")), cells(x)), number(x, "$.row_confidence")))
    said = lambda a: F.filter(a, lambda s: s["text"] != "")
    made = answers.select(*keys, said(lines).alias("a"), said(points).alias("b"), said(table).alias("c"))
    best = F.when(F.size("a") > 0, F.col("a")).when(F.size("b") > 0, F.col("b")).otherwise(F.col("c"))
    return made.select(*keys, F.posexplode(best).alias("pos", "l")).select(*keys, "pos", "l.text", "l.confidence")


def route_points(answers: DataFrame, keys: list[str], column: str = "response") -> DataFrame:
    """(keys, pos, source_row_index, original_order, name, address, raw_row_text, confidence, warnings) of the route points in a reader's answer.

    Points without an address, and what isn't an object, are left out, but count in pos; what is
    no number where one is due is null, and 0 for the row's index.
    """
    number = lambda x, path, kind: F.try_variant_get(x, path, kind)
    filled = lambda x, path: F.nullif(_text(x, path), F.lit(""))
    point = lambda x: F.struct(
        F.coalesce(number(x, "$.source_row_index", "int"), F.lit(0)).alias("source_row_index"),
        number(x, "$.original_order", "int").alias("original_order"),
        filled(x, "$.name").alias("name"),
        filled(x, "$.address").alias("address"),
        F.coalesce(filled(x, "$.raw_row_text"), filled(x, "$.raw_text"), filled(x, "$.address")).alias("raw_row_text"),
        number(x, "$.confidence", "double").alias("confidence"),
        F.coalesce(number(x, "$.warnings", "array<string>"), F.array().cast("array<string>")).alias("warnings"),
    )
    points = F.transform(_list(F.try_parse_json(column), "$.route_points"), point)
    return answers.select(*keys, F.posexplode(points).alias("pos", "p")).select(*keys, "pos", "p.*").filter("address IS NOT NULL")
