"""Reading of free-text addresses and brand names, as Column expressions.

Two normalisers exist on purpose: `cache_key` makes the key under which an address is kept,
`cleaned` is what the parts of an address are read from. Patterns carry (?U) or (?iU), as
Java's classes are ASCII without it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import rules
from routeloom.functions.scalars import bound

_END = r"(?=\s|,|$)"
_NUMBER = r"[0-9]+[0-9а-яa-z/-]*"


def _sub(x: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(x, "(?U)" + pattern, by)


def _isub(x: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(x, "(?iU)" + pattern, by)


def _get(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches."""
    return F.nullif(F.regexp_extract(x, "(?iU)" + pattern, group), F.lit(""))


def _words(items) -> str:
    return "|".join(re.escape(i).replace("\\ ", " ") for i in sorted(items, key=len, reverse=True))


def folded(x: Column) -> Column:
    return F.translate(F.lower(x), "ё", "е")


def spaces(x: Column) -> Column:
    """One blank between words, one after a comma, none at the ends."""
    return F.btrim(_sub(_sub(_sub(x, r"\s+", " "), r"\s*,\s*", ", "), ",+", ","), F.lit(" ,"))


def _spelt(x: Column, abbreviations) -> Column:
    for short, word in abbreviations:
        x = _isub(x, rf"\b{re.escape(short)}\.?{_END}\s*", word + " ")
    return x


def _house_parts(x: Column) -> Column:
    """Letters that stand between numbers: 14к2 is number 14, block 2."""
    for short, word in (("к", "корпус"), (r"корп\.?", "корпус"), (r"стр\.?", "строение")):
        x = _isub(x, rf"(?<=\d)\s*{short}\s*(?=\d)", f" {word} ")
    return _isub(x, r"(?<=\d)\s*лит\.?\s*(?=[a-zа-я])", " литера ")


def _suffixes(x: Column) -> Column:
    """A house's letter belongs to its number; a Latin a is a Cyrillic one."""
    x = _isub(x, r"(\d+)\s*a(?=$|[\s,])", "$1а")
    return _isub(x, r"(\d+)\s+([а-я])(?=$|[\s,])", "$1$2")


def _regions_spelt(x: Column) -> Column:
    x = _sub(_sub(x, r"\bг\.\s*"), r"\bгород\s+")
    for pattern, name in (
        (r"\bспб\b", "санкт-петербург"),
        (r"\bс\.?\s*петербург\b", "санкт-петербург"),
        (r"\bсанкт петербург\b", "санкт-петербург"),
        (r"\bпитер\b", "санкт-петербург"),
        (rf"\bлен(?:инградская)?\.?\s*обл\.?{_END}", "ленинградская область"),
        (r"\bленобласть\b", "ленинградская область"),
    ):
        x = _sub(x, pattern, name)
    return x


def _expanded(x: Column) -> Column:
    x = _spelt(_sub(_regions_spelt(x), r"\bулиц[аы]\b", "улица"), rules.STREET_ABBREVIATIONS)
    x = _sub(x, r"\bв\.\s*о\.", "васильевский остров ")
    return _sub(_spelt(x, rules.HOUSE_ABBREVIATIONS), r"\bдом\s+", "дом ")


# Words that only addresses have.
_MARKER = (
    "(?U)"
    + r"\b(?:спб|с\.?\s*петербург|санкт(?:[-\s]+петербург)?|петербург|ленинградская\s+область|ленобласть|улиц[аы]|остров|литера|строение|корпус|дом|"
    + _words({w for _, w in rules.STREET_ABBREVIATIONS} | {"линия"} | set(rules.CITY_MARKERS[2:]))
    + "|"
    + "|".join(re.escape(s) for s, _ in rules.STREET_ABBREVIATIONS + rules.HOUSE_ABBREVIATIONS)
    + r")\b"
    + rf"|\bлен(?:инградская)?\.?\s*обл\.?{_END}"
)


def has_address_marker(x: Column) -> Column:
    return F.rlike(spaces(folded(x)), F.lit(_MARKER))


def place_and_address(x: Column) -> tuple[Column, Column]:
    """(name of a place or null, the rest): a name goes before a colon, a dash or the first comma if it has no word of an address and the rest may be one."""
    clean = lambda c: spaces(F.btrim(c, F.lit(" :-—–|;,\t\n\r")))
    part = lambda flat, pattern, group: F.regexp_extract(flat, "(?iU)" + pattern, group)
    pair = lambda name, rest: F.struct(name.alias("name"), rest.alias("rest"))

    def split(flat: Column, pattern: str, otherwise: Column) -> Column:
        def valid(p: Column) -> Column:
            name, rest = p["name"], p["rest"]
            return F.coalesce((F.length(name) > 0) & (F.length(rest) > 0) & ~has_address_marker(name) & (has_address_marker(rest) | F.rlike(rest, F.lit(r"(?U)\d"))), F.lit(False))

        return bound(pair(clean(part(flat, pattern, 1)), spaces(part(flat, pattern, 2))), lambda p: F.when(valid(p), p).otherwise(otherwise))

    marked, comma = r"^(.+?)\s*(?::|—|–|\s-\s)\s*(.+)$", r"^([^,]+),\s*(.+)$"
    out = bound(spaces(F.translate(x, "\r\n;|\t", ",,,, ")), lambda flat: split(flat, marked, split(flat, comma, pair(F.lit(None).cast("string"), flat))))
    return out["name"], out["rest"]


def cache_key(address: Column, default_city: str | None = "санкт-петербург", place_name: Column | None = None) -> Column:
    """The key of an address: abbreviations spelt, the default city before it if it names no place. Null for blank ones."""
    rest = place_and_address(F.trim(address))[1]
    if place_name is not None:
        given = F.length(F.btrim(F.coalesce(place_name, F.lit("")), F.lit(" :-—–|;,\t\n\r"))) > 0
        rest = F.when(given, F.trim(address)).otherwise(rest)
    x = spaces(F.translate(folded(rest), ";|\t", ",, "))
    x = _suffixes(spaces(_expanded(_house_parts(x))))
    if default_city:
        city = default_city.lower().replace("ё", "е")
        named = lambda x: F.rlike(x, F.lit("|".join(re.escape(m) for m in rules.CITY_MARKERS)))
        x = bound(x, lambda x: F.when(named(x), x).otherwise(F.concat(spaces(_expanded(F.lit(city))), F.lit(", "), x)))
    return F.when(F.length(F.trim(address)) > 0, _suffixes(spaces(x)))


def with_cache_key(df: DataFrame, address: str, name: str = "key", default_city: str | None = "санкт-петербург") -> DataFrame:
    """df with the key of an address column, worked out once for each different address: it takes some thirty patterns."""
    own = df.select(F.col(address).alias("_address")).filter("_address IS NOT NULL").distinct()
    own = own.withColumn(name, cache_key(F.col("_address"), default_city))
    return df.join(own, F.col(address) == F.col("_address"), "left").drop("_address")


def cleaned(address: Column) -> Column:
    x = F.translate(folded(F.coalesce(address, F.lit(""))), ";|\t", ",, ")
    x = F.btrim(_sub(_sub(_house_parts(x), r"\s*,\s*", ", "), r"\s+", " "), F.lit(" ,"))
    x = _spelt(x, [a for a in rules.STREET_ABBREVIATIONS if a[0] != "бульв"] + list(rules.HOUSE_ABBREVIATIONS))
    return F.btrim(_sub(_sub(x, r"\s+", " "), r"\s*,\s*", ", "), F.lit(" ,"))


def label(x: Column) -> Column:
    return F.trim(_sub(_sub(folded(F.coalesce(x, F.lit(""))), r"[,.]+", " "), r"\s+", " "))


def _named(x: Column, items) -> Column:
    """The longest of the items that stands in x as words: one search for all of them, the longest first at each place."""
    order = sorted(items, key=len, reverse=True)
    every = rf"(?U)(?<![^\s,])(?:{'|'.join(re.escape(i) for i in order)})(?![^\s,])"
    rank = F.create_map(*(F.lit(v) for n, i in enumerate(order) for v in (i, n)))
    first = F.array_min(F.transform(F.regexp_extract_all(x, F.lit(every), F.lit(0)), lambda m: F.element_at(rank, m)))
    return F.get(F.array(*(F.lit(i) for i in order)), first)


def _region(x: Column, city_town: Column, region_town: Column) -> Column:
    return (
        F.when(F.rlike(x, F.lit(rf"(?U)(?<![^\s,])(?:{'|'.join(re.escape(i) for i in rules.CITY_ALIASES)})(?![^\s,])")), rules.CITY)
        .when(F.rlike(x, F.lit(r"(?U)\b(ленинградская область|ленобласть|лен обл)\b")), rules.REGION)
        .when(city_town.isNotNull(), rules.CITY)
        .when(region_town.isNotNull(), rules.REGION)
    )


def region_of(clean: Column) -> Column:
    x = label(clean)
    return _region(x, _named(x, rules.CITY_SETTLEMENTS), _named(x, rules.REGION_SETTLEMENTS))


def settlement_of(clean: Column) -> Column:
    x = label(clean)
    return F.coalesce(_named(x, rules.CITY_SETTLEMENTS), _named(x, rules.REGION_SETTLEMENTS))


def without_region(clean: Column) -> Column:
    for p in ("санкт-петербург", "санкт петербург", "спб", "петербург", "ленинградская область", "ленобласть"):
        clean = _isub(clean, rf"^{re.escape(p)}\s*,?\s*")
    return F.btrim(clean, F.lit(" ,"))


def without_settlement(clean: Column, settlement: Column) -> Column:
    x = without_region(clean)
    rest = without_region(_sub(F.substring(x, F.length(settlement) + 1, F.length(x)), r"^\s*,?\s*"))
    return F.when(F.startswith(x, settlement), rest).otherwise(x)


def house_of(clean: Column) -> Column:
    return F.coalesce(_get(clean, rf"\b(?:дом|д)\s*({_NUMBER})"), _get(clean, rf"({_NUMBER})\s+(?:корпус|строение|литера)\s+\S+"), _get(clean, rf"({_NUMBER})\s*$"))


def part_of(clean: Column, name: str) -> Column:
    return _get(clean, rf"\b{name}\s*({_NUMBER})")


def street_of(clean: Column) -> Column:
    types = "|".join(rules.STREET_TYPES)
    end = r"(?:\s+дом\b|\s+корпус\b|\s+строение\b|\s+литера\b|,|$)"
    bare = lambda x: F.btrim(_isub(x, rf"\s+{_NUMBER}\s*$"), F.lit(" ,"))
    before, after = rf"\b({types})\s+(.+?){end}", rf"(.+?)\s+({types}){end}"
    rest = _isub(_isub(without_region(clean), r"\b(корпус|строение|литера)\s+\S+"), rf"\bдом\s*{_NUMBER}")
    rest = F.btrim(_isub(rest, rf"{_NUMBER}\s*$"), F.lit(" ,"))
    return (
        F.when(F.rlike(clean, F.lit("(?iU)" + before)), F.trim(F.concat(_get(clean, before, 1), F.lit(" "), bare(_get(clean, before, 2)))))
        .when(F.rlike(clean, F.lit("(?iU)" + after)), F.trim(F.concat(bare(_get(clean, after, 1)), F.lit(" "), _get(clean, after, 2))))
        .otherwise(F.nullif(rest, F.lit("")))
    )


def parsed(df, address: str = "raw"):
    """df with clean, region, settlement, street, house, corpus, building, letter and normalized_key read from an address column.

    Columns are added step by step, so that each step reads what the one before it has made.
    """
    df = df.withColumn("clean", cleaned(F.col(address)))
    c = F.col("clean")
    df = df.withColumn("_label", label(c)).withColumns({"_city": _named(F.col("_label"), rules.CITY_SETTLEMENTS), "_town": _named(F.col("_label"), rules.REGION_SETTLEMENTS)})
    df = df.withColumns({"region": _region(F.col("_label"), F.col("_city"), F.col("_town")), "settlement": F.coalesce("_city", "_town"), "street": street_of(c), "house": house_of(c)})
    df = df.withColumns({"corpus": part_of(c, "корпус"), "building": part_of(c, "строение"), "letter": part_of(c, "литера")}).drop("_label", "_city", "_town")
    return df.withColumn("normalized_key", F.concat_ws("|", *(F.nullif(F.col(x), F.lit("")) for x in ("region", "settlement", "street", "house", "corpus", "building", "letter"))))


def lookup(x: Column) -> Column:
    return F.trim(_sub(_sub(folded(F.coalesce(x, F.lit(""))), r"[.,;|]+", " "), r"\s+", " "))


def street_name(x: Column) -> Column:
    """A street without its type words."""
    return F.array_join(F.filter(F.split(lookup(x), " "), lambda w: (w != "") & ~w.isin(*rules.STREET_TYPE_WORDS)), " ")


def house_value(x: Column) -> Column:
    x = _sub(_sub(_sub(lookup(x), r"\b(?:дом|д)\s*"), r"\b(?:корпус|корп|к)\s*", "к"), r"\b(?:строение|стр)\s*", "с")
    return _sub(x, r"\s+")


def brand_text(x: Column) -> Column:
    """A brand's name without apostrophes and odd signs, dashes made alike."""
    x = F.translate(folded(F.coalesce(x, F.lit(""))), "‐‑‒–—−'’`ʼ‘´‛", "------")
    x = _sub(_sub(_sub(x, r"[\s_]+", " "), r"\s*-\s*", "-"), r"[^\w -]+")
    return F.trim(_sub(x, " +", " "))


def significant(x: Column) -> Column:
    """Tokens of over one character that aren't stop words."""
    return F.filter(F.regexp_extract_all(folded(x), F.lit("[0-9a-zа-я-]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*rules.STOP_WORDS))


def match_tokens(x: Column) -> Column:
    return F.filter(F.regexp_extract_all(folded(F.coalesce(x, F.lit(""))), F.lit("[0-9a-zа-я]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~F.rlike(t, F.lit("^[0-9]+$")) & ~t.isin(*rules.STREET_STOP_WORDS))


def match_key(x: Column) -> Column:
    """The match tokens of an address put together."""
    return F.array_join(match_tokens(x), "")
