"""Where a search looks first: areas named in words, contexts that a request brings, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import geo, rules
from routeloom.functions import text as T

FIELDS = ("label", "latitude", "longitude", "radius_km", "source", "bounded", "type")


def _context(label, latitude, longitude, radius_km, source: str | Column, bounded: bool | Column, kind: str | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(*(lit(x).alias(n) for n, x in zip(FIELDS, (label, latitude, longitude, radius_km, source, bounded, kind), strict=True)))


DEFAULT = (*rules.DEFAULT_CONTEXT, "default", False, "default_spb")
WIDE = (*rules.WIDE_CONTEXT, "default", False, "spb_lenobl")


def first_held(x: Column, names) -> Column:
    """The first of the names, in their order, that x holds anywhere."""
    out = F.lit(None).cast("string")
    for n in reversed(list(names)):
        out = F.when(F.contains(x, F.lit(n)), n).otherwise(out)
    return out


def of_area(area: Column) -> Column:
    """The context of an area in words: the city by default and for its own names, a settlement's centre and radius, else the words about the city's centre."""
    words, label = T.label(area), F.trim(F.coalesce(area, F.lit("")))
    towns = rules.CITY_SETTLEMENTS | rules.REGION_SETTLEMENTS
    name = first_held(words, towns)
    at = F.element_at(F.create_map(*(x for n, v in towns.items() for x in (F.lit(n), F.array(*map(F.lit, v))))), name)
    town = _context(F.initcap(name), F.element_at(at, 1), F.element_at(at, 2), F.element_at(at, 3), "user_area", True, "district")
    _, lat, lon, km = rules.DEFAULT_CONTEXT
    return F.when((words == "") | words.isin(*rules.CITY_ALIASES), _context(*DEFAULT)).when(name.isNotNull(), town).otherwise(_context(label, lat, lon, km, "user_area", True, "custom_area"))


def build(df: DataFrame) -> DataFrame:
    """df with `context`, from area and the request's own type, label, latitude, longitude, radius_km, source, bounded.

    An area in words comes first, then a known type, then the label of an area without a
    point, then a point; nothing gives the city.
    """
    c = F.col
    point = c("latitude").isNotNull() & c("longitude").isNotNull()
    named = c("type").isin("district", "custom_area") & (F.length("label") > 0) & ~point
    given = lambda x: F.nullif(x, F.lit(""))
    label, _, _, km = rules.DEFAULT_CONTEXT
    own = _context(F.coalesce(given(c("label")), F.lit(label)), c("latitude"), c("longitude"), F.coalesce(F.nullif(c("radius_km"), F.lit(0.0)), F.lit(km)), F.coalesce(given(c("source")), F.lit("custom_point")), F.coalesce(c("bounded"), F.lit(False)), F.coalesce(given(c("type")), F.lit("custom_area")))
    out = (
        F.when(F.length("area") > 0, of_area(c("area")))
        .when(c("type") == "spb_lenobl", _context(*WIDE))
        .when(c("type") == "default_spb", _context(*DEFAULT))
        .when(named, of_area(c("label")))
        .when(point, own)
        .otherwise(_context(*DEFAULT))
    )
    return df.withColumn("context", out)


def region_of_label(label: Column) -> Column:
    """The region that a context's label implies, else null."""
    words = T.label(label)
    return (
        F.when(first_held(words, rules.CITY_ALIASES).isNotNull(), rules.CITY)
        .when(F.contains(words, F.lit("ленинград")), rules.REGION)
        .when(first_held(words, rules.CITY_SETTLEMENTS).isNotNull(), rules.CITY)
        .when(first_held(words, rules.REGION_SETTLEMENTS).isNotNull(), rules.REGION)
    )


def constrained(context: Column) -> Column:
    """Whether a context is an area rather than the city as a whole."""
    return context["type"].isin("district", "custom_area")


def default_city(city: Column, context: Column, has_context: Column, area: Column) -> Column:
    """The city to put before an address: none where the request says where to look."""
    said = has_context | (F.length(F.coalesce(area, F.lit(""))) > 0) | (constrained(context) & (F.length(context["label"]) > 0))
    return F.when(~F.coalesce(said, F.lit(False)), city)


def distance_m(lat: Column, lon: Column, context: Column) -> Column:
    """Metres to the context's centre."""
    return geo.haversine(lat, lon, context["latitude"], context["longitude"])


def view_box(context: Column) -> Column:
    """west,south,east,north about a context, six decimals."""
    dy = context["radius_km"] / 111.0
    dx = context["radius_km"] / (111.0 * F.greatest(F.cos(F.radians(context["latitude"])), F.lit(0.01)))
    lat, lon = context["latitude"], context["longitude"]
    return F.format_string("%.6f,%.6f,%.6f,%.6f", lon - dx, lat - dy, lon + dx, lat + dy)


def street_types_to_try(street: Column) -> Column:
    """Types to put before a street that has none, by its ending."""
    return F.when(F.endswith(street, F.lit("ское")), F.array(F.lit("шоссе"))).when(F.endswith(street, F.lit("ский")), F.array(F.lit("проспект"), F.lit("улица"))).otherwise(F.array(F.lit("улица")))
