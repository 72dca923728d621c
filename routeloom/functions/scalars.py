"""Small conversions that never fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_filled(*values: Column) -> Column:
    """The first value that isn't null or blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def safe_int(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit("")).try_cast("bigint")


def safe_bool(x: Column, default: bool = True) -> Column:
    word = F.nullif(F.lower(F.trim(x)), F.lit(""))
    return F.coalesce(word.isin("1", "true", "t", "yes", "y"), F.lit(default))


def safe_double(x: Column) -> Column:
    """A number whose decimal sign may be a comma."""
    return F.translate(F.trim(x), ",", ".").try_cast("double")


def clamp(x: Column, least, most) -> Column:
    return F.greatest(F.lit(least), F.least(x, F.lit(most)))


def combined_confidence(ocr: Column, geo: Column) -> Column:
    """0.45 of the recognition's and 0.55 of the geocoder's confidence (0 to 100 or 0 to 1), at most 0.99."""
    ratio = F.when(geo > 1, geo / 100).otherwise(geo)
    return F.round(F.least(F.coalesce(ocr, F.lit(0.0)) * 0.45 + F.coalesce(ratio, F.lit(0.0)) * 0.55, F.lit(0.99)), 4)


#: Bytes of the size units that container statistics use.
_UNITS = {"b": 1, "kb": 1000, "mb": 1000**2, "gb": 1000**3, "kib": 1024, "mib": 1024**2, "gib": 1024**3}


def size_bytes(x: Column) -> Column:
    """12.3MiB, 4 kB and the like as bytes; null for anything else."""
    number = F.regexp_extract(x, r"^\s*([0-9.]+)\s*([A-Za-z]+)\s*$", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(x, r"^\s*([0-9.]+)\s*([A-Za-z]+)\s*$", 2))
    factor = F.element_at(F.create_map(*(F.lit(v) for kv in _UNITS.items() for v in kv)), unit)
    return (number * factor).cast("bigint")


def percent(x: Column) -> Column:
    return F.regexp_extract(x, r"^\s*([0-9.]+)\s*%\s*$", 1).try_cast("double")


def bound(value: Column, then) -> Column:
    """then(value), where the value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def rounded(x: Column, decimals: int = 2, even: bool = True) -> Column:
    """x to so many decimals as its exact binary value says, a true half to the even digit (else up): 0.125 gives 0.12, and 2.675, which is a little less, 2.67."""
    step = 10.0**decimals
    y = x * step
    # what the product has lost, from the halves of x, whose own products are exact
    high = x * 134217729.0 - (x * 134217729.0 - x)
    lost = (high * step - y) + (x - high) * step
    half = F.abs(y - F.rint(y)) == 0.5
    return F.when(half & (lost > 0), F.ceil(y)).when(half & (lost < 0), F.floor(y)).otherwise(F.rint(y) if even else F.when(half, F.ceil(y)).otherwise(F.rint(y))) / step


def shown_distance(metres: Column) -> Column:
    """Metres under a kilometre, else kilometres with a comma and one decimal; a dash for nothing."""
    return F.when(metres.isNull() | F.isnan(metres.cast("double")), "-").when(metres < 1000, F.format_string("%d м", F.floor(metres + 0.5))).otherwise(F.concat(F.replace(F.format_string("%.1f", rounded(metres / 1000, 1, even=False)), F.lit("."), F.lit(",")), F.lit(" км")))


def shown_duration(seconds: Column) -> Column:
    """Hours and minutes, what is nothing left out; a dash for nothing at all."""
    total = F.floor(seconds + 0.5)
    hours, minutes = F.floor(total / 3600), F.floor((total % 3600) / 60 + 0.5)
    h, m = F.format_string("%d ч", hours), F.format_string("%d мин", minutes)
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")), "-").when(hours == 0, m).when(minutes == 0, h).otherwise(F.concat_ws(" ", h, m))


def shown_coordinate(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "-").otherwise(F.format_string("%.6f", x))

