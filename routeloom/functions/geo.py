"""Distances, boxes and grid cells as Column expressions, and the joins that rest on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions.rules import WORK_AREA
from routeloom.functions.scalars import bound

RADIUS_M = 6_371_000.0
#: Half axes of the spheroid of WGS 84.
AXIS_A_M, AXIS_B_M = 6_378_137.0, 6_356_752.314245179
#: Metres of a degree of latitude, taken small so that cells are never too narrow.
DEGREE_M = 111_000.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine(lat_a, lon_a, lat_b, lon_b) -> Column:
    """Metres on a sphere of 6,371 km; null if a coordinate is."""
    p, q = F.radians(_c(lat_a)), F.radians(_c(lat_b))
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(_c(lon_b)) - F.radians(_c(lon_a))) / 2), 2)
    return F.lit(2 * RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def geodesic(lat_a, lon_a, lat_b, lon_b, turns: int = 30) -> Column:
    """Metres of the shortest way on the spheroid of WGS 84 (Vincenty's inverse formula, to under a millimetre).

    Null if a coordinate is, or for the few nearly antipodal points for which the longitude on
    the auxiliary sphere hasn't settled after `turns` turns.
    """
    f, b = 1 - AXIS_B_M / AXIS_A_M, AXIS_B_M
    reduced = lambda lat: F.atan(F.lit(1 - f) * F.tan(F.radians(_c(lat))))
    given = F.struct(reduced(lat_a).alias("u"), reduced(lat_b).alias("v"), F.radians(_c(lon_b) - _c(lon_a)).alias("way"))
    sides = lambda g: F.struct(F.sin(g["u"]).alias("su"), F.cos(g["u"]).alias("cu"), F.sin(g["v"]).alias("sv"), F.cos(g["v"]).alias("cv"), g["way"].alias("way"))

    def arc(p: Column, lon: Column) -> Column:
        """The arc between the points on the auxiliary sphere, for a longitude there."""
        sine = F.sqrt(F.pow(p["cv"] * F.sin(lon), 2) + F.pow(p["cu"] * p["sv"] - p["su"] * p["cv"] * F.cos(lon), 2))
        return F.struct(sine.alias("sin"), (p["su"] * p["sv"] + p["cu"] * p["cv"] * F.cos(lon)).alias("cos"), lon.alias("lon"))

    def azimuth(p: Column, a: Column) -> Column:
        return bound(F.when(a["sin"] == 0, 0.0).otherwise(p["cu"] * p["cv"] * F.sin(a["lon"]) / a["sin"]), lambda s: F.struct(s.alias("sin"), (1 - s * s).alias("cos2")))

    def middle(p: Column, a: Column, z: Column) -> Column:
        """Cosine of twice the arc from the equator to the middle of the way; 0 on the equator."""
        return F.when(z["cos2"] < 1e-15, 0.0).otherwise(a["cos"] - 2 * p["su"] * p["sv"] / z["cos2"])

    def turn(p: Column, s: Column) -> Column:
        def next_(a: Column, z: Column, m: Column) -> Column:
            c = F.lit(f / 16) * z["cos2"] * (4 + F.lit(f) * (4 - 3 * z["cos2"]))
            lon = bound(c, lambda c: p["way"] + (1 - c) * F.lit(f) * z["sin"] * (F.atan2(a["sin"], a["cos"]) + c * a["sin"] * (m + c * a["cos"] * (2 * m * m - 1))))
            return F.struct(lon.alias("lon"), a["lon"].alias("last"))

        new = bound(arc(p, s["lon"]), lambda a: bound(azimuth(p, a), lambda z: bound(middle(p, a, z), lambda m: next_(a, z, m))))
        return F.when(F.abs(s["lon"] - s["last"]) < 1e-12, s).otherwise(new)

    def metres(p: Column, s: Column) -> Column:
        def length(a: Column, z: Column, m: Column) -> Column:
            u = z["cos2"] * F.lit((AXIS_A_M**2 - b**2) / b**2)
            big = lambda u: 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            small = lambda u: u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            less = lambda k: k * a["sin"] * (m + k / 4 * (a["cos"] * (2 * m * m - 1) - k / 6 * m * (4 * a["sin"] * a["sin"] - 3) * (4 * m * m - 3)))
            return bound(u, lambda u: F.lit(b) * big(u) * (F.atan2(a["sin"], a["cos"]) - bound(small(u), less)))

        out = bound(arc(p, s["lon"]), lambda a: bound(azimuth(p, a), lambda z: bound(middle(p, a, z), lambda m: length(a, z, m))))
        return F.when((F.abs(s["lon"] - s["last"]) < 1e-12) & (F.abs(s["lon"]) <= math.pi), out)

    def solve(p: Column) -> Column:
        start = F.struct(p["way"].alias("lon"), (p["way"] + 1).alias("last"))
        return bound(F.aggregate(F.sequence(F.lit(1), F.lit(turns)), start, lambda s, _: turn(p, s)), lambda s: metres(p, s))

    # the shorter way round
    short = lambda g: F.struct(g["u"].alias("u"), g["v"].alias("v"), (F.pmod(g["way"] + math.pi, F.lit(2 * math.pi)) - math.pi).alias("way"))
    return bound(given, lambda g: bound(short(g), lambda g: bound(sides(g), solve)))


def in_box(lat, lon, box: tuple[float, float, float, float] = WORK_AREA) -> Column:
    """Whether a point lies in (least latitude, greatest, least longitude, greatest), borders included."""
    south, north, west, east = box
    return _c(lat).between(south, north) & _c(lon).between(west, east)


def valid_point(lat, lon) -> Column:
    return F.coalesce(_c(lat).between(-90, 90) & _c(lon).between(-180, 180), F.lit(False))


def _columns(y: Column, metres: float) -> Column:
    """Into how many cells the band y of latitude is cut: at its end nearer to a pole, a cell is still `metres` wide to any meridian."""
    edge = F.least(F.greatest(F.abs(y), F.abs(y + 1)) * F.lit(metres / DEGREE_M), F.lit(90.0))
    share = F.lit(metres / math.degrees(1) / DEGREE_M) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    return F.when(share < 1, F.greatest(F.floor(F.lit(2 * math.pi) / F.asin(share)), F.lit(1))).otherwise(1).cast("long")


def cells(df: DataFrame, metres: float, lat: str = "lat", lon: str = "lon", around: bool = False) -> DataFrame:
    """df with cell_y and cell_x; with around, a row for each cell that can hold a point within `metres` of the row's.

    Bands of latitude are cut into more cells the nearer they are to the equator, and cells go
    round the date line, so that nine cells at most are enough everywhere.
    """
    y = F.floor(F.col(lat) * F.lit(DEGREE_M / metres))

    def x(band: Column) -> Column:
        n = _columns(band, metres)
        return F.least(F.floor(F.pmod(F.col(lon) + 180.0, F.lit(360.0)) / 360.0 * n).cast("long"), n - 1)

    if not around:
        return df.withColumn("cell_y", y).withColumn("cell_x", x(F.col("cell_y")))
    out = df.withColumn("cell_y", F.explode(F.array(*(y + i for i in (-1, 0, 1)))))
    n, own = _columns(F.col("cell_y"), metres), x(F.col("cell_y"))
    return out.withColumn("cell_x", F.explode(F.array_distinct(F.array(*(F.pmod(own + j, n) for j in (-1, 0, 1))))))


def pairs_within(left: DataFrame, right: DataFrame, metres: float, keys: tuple[str, ...] = (), spheroid: bool = False, decimals: int | None = None) -> DataFrame:
    """Pairs (columns of left, those of right, distance_m) within `metres`, on a sphere or on the spheroid; with decimals, distances are rounded after that.

    Both sides have lat and lon, and share no other name but keys, which must be equal. Distances
    are worked out once for each two different points; rows join these by their points. Each left
    point goes to nine grid cells at most, so the joins are equality joins whatever the distance
    and need no broadcast; rows without coordinates pair with nothing.
    """
    # a degree of the spheroid is up to a hundredth shorter than one of the sphere
    reach = metres * (1.01 if spheroid else 1.0)
    there = lambda df: df.filter("lat IS NOT NULL AND lon IS NOT NULL")
    a, b = there(left), there(right).withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    p = cells(a.select(*keys, "lat", "lon").distinct(), reach, around=True)
    q = cells(b.select(*keys, "_lat", "_lon").distinct(), reach, "_lat", "_lon")
    near = p.join(q, [*keys, "cell_y", "cell_x"]).withColumn("distance_m", (geodesic if spheroid else haversine)("lat", "lon", "_lat", "_lon"))
    near = near.filter(F.col("distance_m") <= metres).drop("cell_y", "cell_x")
    if decimals is not None:
        near = near.withColumn("distance_m", F.round("distance_m", decimals))
    out = near.join(a, [*keys, "lat", "lon"]).join(b, [*keys, "_lat", "_lon"])
    return out.select(*keys, *(c for c in left.columns if c not in keys), *(c for c in right.columns if c not in (*keys, "lat", "lon")), "distance_m")


def first_box(lat, lon, boxes: list[tuple[str, float, float, float, float]]) -> Column:
    """Name of the first of an ordered, short list of boxes that holds the point, else null: one expression, no join."""
    out = F.lit(None).cast("string")
    for name, *box in reversed(boxes):
        out = F.when(in_box(lat, lon, tuple(box)), name).otherwise(out)
    return out


def district(lat, lon, text, hints: list[tuple[str, str]], boxes: list[tuple[str, float, float, float, float]]) -> Column:
    """District of a point: the first hint that the text holds, else the first box."""
    words = F.translate(F.lower(_c(text)), "ё", "е")
    out = first_box(lat, lon, boxes)
    for hint, name in reversed(hints):
        out = F.when(F.contains(words, F.lit(hint)), name).otherwise(out)
    return out


def view_box(lat, lon, radius_km) -> Column:
    """west,north,east,south around a point, six decimals."""
    dy = _c(radius_km) / 111.0
    dx = _c(radius_km) / (F.lit(111.0) * F.greatest(F.cos(F.radians(_c(lat))), F.lit(0.1)))
    return F.concat_ws(",", *(F.format_string("%.6f", x) for x in (_c(lon) - dx, _c(lat) + dy, _c(lon) + dx, _c(lat) - dy)))
