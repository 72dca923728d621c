"""Suggestions while an address is typed: merge, dedupe, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import geo, rules
from routeloom.functions import text as T
from routeloom.functions.similarity import containing_pairs


def dedupe(items: DataFrame) -> DataFrame:
    """Of items (query_id, pos, name, lat, lon) with the same name and place to six decimals, the first."""
    w = Window.partitionBy("query_id", F.round("lat", 6), F.round("lon", 6), F.lower(F.trim("name"))).orderBy("pos")
    return items.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def has_house_number(query: Column) -> Column:
    q = F.trim(T.folded(query))
    return F.rlike(q, F.lit(r"(?U)(^|[\s,])(дом|д)\.?\s*\d")) | F.rlike(q, F.lit(r"(?U)(^|[\s,])\d+[0-9а-яa-z/-]*$"))


def names_street(name: Column, query: Column) -> Column:
    """Whether each token of the query begins some token of the name."""
    n, q = T.match_tokens(name), T.match_tokens(query)
    return (F.size(q) > 0) & F.forall(q, lambda t: F.exists(n, lambda w: F.startswith(w, t)))


def rank(items: DataFrame, limit: int = 10) -> DataFrame:
    """The best `limit` (1 to 10) of items (query_id, query, pos, name, is_street, source, confidence), with place: streets first unless a house is asked for, then what the database has, then confidence."""
    street = ~has_house_number(F.col("query")) & F.col("is_street") & names_street(F.col("name"), F.col("query"))
    w = Window.partitionBy("query_id").orderBy(F.when(street, 0).otherwise(1), F.col("source") != "database", F.desc(F.coalesce("confidence", F.lit(0.0))), "pos")
    return items.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max(1, min(limit, 10)))


def complete_streets(items: DataFrame) -> DataFrame:
    """One item for each set of street tokens of a query, that of the highest confidence, the first of equal ones."""
    key = F.array_join(F.array_sort(F.array_distinct(T.match_tokens(F.col("name")))), " ")
    w = Window.partitionBy("query_id", "key").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "pos")
    named = items.withColumn("key", key).filter((F.col("key") != "") & names_street(F.col("name"), F.col("query")))
    return named.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def main_text(address: Column, display: Column) -> Column:
    """A road with its house, a named thing, or the display name's first two parts."""
    get = lambda *keys: F.coalesce(*(F.nullif(F.element_at(address, k), F.lit("")) for k in keys))
    road, name, house = get("road", "pedestrian", "footway", "path", "neighbourhood"), get("building", "amenity", "shop"), get("house_number")
    parts = F.filter(F.transform(F.split(display, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(F.when(road.isNotNull(), F.concat_ws(", ", road, house)), F.when(name.isNotNull(), F.concat_ws(", ", name, house)), F.array_join(F.slice(parts, 1, 2), ", "))


_HOUSE = r"\d+(?!-?[яйе]\b)[0-9a-zа-я/-]*(?:\s*(?:корпус|корп|к|строение|стр|литера|лит)\.?\s*[0-9a-zа-я/-]+)*"
_TYPES = "|".join(sorted({*rules.SUGGEST_TYPES, *rules.SUGGEST_BARE_TYPES}, key=len, reverse=True))


def _without(x: Column, pattern: str) -> Column:
    return F.btrim(F.regexp_replace(x, "(?iU)" + pattern, ""), F.lit(" ,"))


def street_source(x: Column) -> Column:
    """Text that streets are read from: one blank between words, one after a comma."""
    return F.btrim(T._sub(T._sub(F.translate(F.trim(F.coalesce(x, F.lit(""))), "ё;|\t", "е,, "), r"\s+", " "), r"\s*,\s*", ", "), F.lit(" ,"))


def without_city(x: Column) -> Column:
    x = F.btrim(x, F.lit(" ,"))
    for name in rules.SUGGEST_CITY_PREFIXES:
        x = T._isub(x, rf"^{name}\s*,?\s*")
    return F.btrim(x, F.lit(" ,"))


def without_house(x: Column) -> Column:
    """A text without the house at its end: after its word, after a comma, or after a blank."""
    for before in (r"\b(?:дом|д)\.?\s*", r",\s*", r"\s+"):
        x = _without(F.btrim(x, F.lit(" ,")), rf"{before}{_HOUSE}\s*$")
    return x


def is_house(x: Column) -> Column:
    """Whether a part of an address is a house and nothing else."""
    return F.coalesce(F.rlike(F.btrim(T.folded(x), F.lit(" ,")), F.lit(rf"(?U)^(?:дом|д)?\.?\s*{_HOUSE}$")), F.lit(False))


def has_street_type(x: Column) -> Column:
    return F.rlike(x, F.lit(rf"(?iU)(^|\s)(?:{_TYPES})\.?($|\s)"))


def has_word(x: Column) -> Column:
    return F.rlike(x, F.lit("[a-zA-Zа-яА-Я]{3,}"))


def street_type(x: Column) -> Column:
    """The whole word of a street type, others as they are without dots."""
    key = F.trim(F.replace(F.lower(x), F.lit("."), F.lit("")))
    words = F.create_map(*(F.lit(v) for kv in rules.SUGGEST_TYPES.items() for v in kv))
    return F.coalesce(F.element_at(words, key), F.nullif(key, F.lit("")))


def street_text(x: Column) -> Column:
    """A street with its type spelt out before it, no city and no house."""
    bare = without_house(without_city(street_source(x)))
    ahead = rf"(?iU)^((?:{_TYPES})\.?)\s+(.+)$"
    behind = r"(?iU)^(.+?)\s+(?:ул\.?|улица|улицы)$"
    return (
        F.when(F.rlike(bare, F.lit(ahead)), F.concat_ws(" ", street_type(F.regexp_extract(bare, ahead, 1)), F.btrim(F.regexp_extract(bare, ahead, 2), F.lit(" ,"))))
        .when(F.rlike(bare, F.lit(behind)), F.concat(F.lit("улица "), F.btrim(F.regexp_extract(bare, behind, 1), F.lit(" ,"))))
        .otherwise(bare)
    )


def street_in(x: Column) -> Column:
    """The street that an address names: its first part with a type, else what is left without city and house; null if that tells nothing."""
    source = street_source(x)
    typed = F.get(F.filter(F.transform(F.split(source, ","), lambda p: F.trim(p)), lambda p: (p != "") & has_street_type(p)), F.lit(0))
    bare = without_house(without_city(source))
    return F.when(typed.isNotNull(), street_text(typed)).when((source != "") & (bare != source) & has_word(bare), street_text(bare))


def street_tokens(x: Column) -> Column:
    """Sorted different tokens that tell streets apart: numbers, and words of three letters that are neither city nor type."""
    own = F.regexp_extract_all(T.folded(F.coalesce(x, F.lit(""))), F.lit("[0-9a-zA-Zа-яА-Я]+"), F.lit(0))
    skip = [t for t in (*rules.SUGGEST_CITY_TOKENS, *rules.SUGGEST_TYPES, *rules.SUGGEST_BARE_TYPES[:2])]
    return F.array_sort(F.array_distinct(F.filter(own, lambda t: (F.rlike(t, F.lit("^[0-9]+$")) | (F.length(t) >= 3)) & ~t.isin(*skip))))


def street_of_item(address: Column, main: Column, display: Column) -> Column:
    """The road of an item's address, else what its texts name, else its main text."""
    road = F.coalesce(*(F.nullif(F.element_at(address, k), F.lit("")) for k in ("road", "pedestrian", "footway", "path")))
    return F.coalesce(road, street_in(F.element_at(address, "address")), street_in(main), street_in(display), main, F.lit(""))


def street_secondary(display: Column, secondary: Column, street: Column) -> Column:
    """Up to three parts of the display name that are neither house nor street nor a word of the city but the city itself; else the secondary text."""
    key = F.array_join(street_tokens(street), " ")

    def useful(p: Column) -> Column:
        tokens = F.array_join(street_tokens(p), " ")
        return T.folded(p).isin(*rules.SUGGEST_CITY_PARTS) | (~is_house(p) & (tokens != "") & (tokens != key) & ~T.folded(p).isin(*rules.SUGGEST_CITY_TOKENS))

    parts = F.filter(F.transform(F.split(F.coalesce(display, F.lit("")), ","), lambda p: F.trim(p)), lambda p: (p != "") & useful(p))
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 3), ", ")).when(~is_house(secondary), F.nullif(secondary, F.lit("")))


def secondary_text(address: Column, display: Column) -> Column:
    """What stands behind the main text: the address's wider parts, each once, else the display name from its third part on."""
    get = lambda k: F.nullif(F.element_at(address, k), F.lit(""))
    values = F.array_distinct(F.array_compact(F.array(*(F.coalesce(get(k), get("region")) if k == "state" else get(k) for k in rules.SECONDARY_KEYS))))
    parts = F.filter(F.transform(F.split(display, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.array_join(values, ", ")).when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), ", "))


def item_id(provider: Column, osm_type: Column, osm_id: Column, place_id: Column, address_id: Column) -> Column:
    return (
        F.when(address_id.isNotNull(), F.concat_ws(":", F.lit("address"), address_id.cast("string")))
        .when((F.length(osm_type) > 0) & osm_id.isNotNull(), F.concat_ws(":", provider, osm_type, osm_id.cast("string")))
        .when(place_id.isNotNull(), F.concat_ws(":", provider, F.lit("place"), place_id.cast("string")))
        .otherwise(F.concat_ws(":", provider, F.lit("candidate")))
    )


def item_confidence(importance: Column, place_rank: Column, house: Column, lat: Column, lon: Column) -> Column:
    """0 to 99 from importance, rank, a house number, and whether the place is in the work area."""
    score = 45.0 + F.when(importance.isNotNull(), F.least(importance * 45.0, F.lit(35.0))).otherwise(0.0) + F.when(place_rank >= 30, 15.0).when(place_rank <= 26, -15.0).otherwise(0.0)
    score = score + F.when(F.length(house) > 0, 15.0).otherwise(0.0) - F.when(F.coalesce(geo.in_box(lat, lon), F.lit(False)), 0.0).otherwise(40.0)
    return F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(99.0))), 2)


ITEM = ("id", "provider", "display_name", "main_text", "secondary_text", "lat", "lon", "category", "type", "confidence", "address", "status", "source", "outside")


def items_of_candidates(candidates: DataFrame) -> DataFrame:
    """Items (query_id, pos, ...) of a geocoder's candidates (query_id, pos, display, lat, lon, importance, place_rank, raw as JSON)."""
    raw = lambda k: F.get_json_object("raw", f"$.{k}")
    address = F.coalesce(F.from_json(raw("address"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    c = candidates.withColumn("address", address).withColumn("display_name", F.coalesce("display", F.lit("")))
    a, d = F.col("address"), F.col("display_name")
    return c.select(
        "query_id", "pos", item_id(F.lit("nominatim"), raw("osm_type"), raw("osm_id").try_cast("bigint"), raw("place_id").try_cast("bigint"), F.lit(None)).alias("id"), F.lit("nominatim").alias("provider"), "display_name",
        main_text(a, d).alias("main_text"), secondary_text(a, d).alias("secondary_text"), "lat", "lon", raw("class").alias("category"), raw("type").alias("type"),
        item_confidence(F.col("importance"), F.col("place_rank"), F.element_at(a, "house_number"), F.col("lat"), F.col("lon")).alias("confidence"), "address", F.lit("found").alias("status"), F.lit("nominatim").alias("source"),
        (~F.coalesce(geo.in_box("lat", "lon"), F.lit(False))).alias("outside"),
    )


def items_of_cache(rows: DataFrame) -> DataFrame:
    """Items of cached rows (query_id, pos, address_id, display_name, original_address, provider, score, confidence, status, lat, lon, raw): raw is the address or holds it."""
    whole = F.coalesce(F.get_json_object("raw", "$.address"), F.col("raw"))
    address = F.coalesce(F.when(F.startswith(F.trim(whole), F.lit("{")), F.from_json(whole, "map<string,string>")), F.create_map().cast("map<string,string>"))
    r = rows.withColumn("address", address).withColumns({"display_name": F.coalesce(F.nullif("display_name", F.lit("")), "original_address", F.lit("")), "provider": F.coalesce(F.nullif("provider", F.lit("")), F.lit("nominatim"))})
    a, d = F.col("address"), F.col("display_name")
    return r.select(
        "query_id", "pos", F.concat_ws(":", F.lit("address"), F.col("address_id").cast("string")).alias("id"), "provider", "display_name", main_text(a, d).alias("main_text"), secondary_text(a, d).alias("secondary_text"), "lat", "lon",
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("type"), F.coalesce("score", "confidence").cast("double").alias("confidence"), "address", F.coalesce(F.nullif("status", F.lit("")), F.lit("found")).alias("status"),
        F.lit("database").alias("source"), (~F.coalesce(geo.in_box("lat", "lon"), F.lit(False))).alias("outside"),
    )


def cached(queries: DataFrame, cache: DataFrame, limit: int = 10) -> DataFrame:
    """Cached rows with pos for queries (query_id, query, key): those with the key, then those whose texts hold the key or the query, lately used ones first; three times the limit where a street is asked for.

    cache: address_id, normalized_address, original_address, display_name, status, lat, lon, last_used_at, updated_at and more.
    """
    usable = cache.filter("lat IS NOT NULL AND lon IS NOT NULL AND status IN ('found', 'ambiguous', 'manual')")
    texts = usable.select("address_id", F.explode(F.array_distinct(F.array_compact(F.array(*(F.struct(F.lit(k).alias("k"), F.lower(c).alias("r")) for k, c in ((0, "normalized_address"), (1, "original_address"), (1, "display_name"))))))).alias("t")).select("address_id", "t.k", "t.r").filter("r IS NOT NULL")
    asked = queries.select("query_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lower("key").alias("l")), F.struct(F.lit(1).alias("k"), F.lower(F.trim("query")).alias("l")))).alias("a")).select("query_id", "a.*").filter("length(l) > 0")
    held = containing_pairs(asked.select("l"), texts.select("r"))
    met = asked.join(held, "l").join(texts, ["k", "r"]).select("query_id", "address_id").distinct()
    most = F.when(has_house_number(F.col("query")), limit).otherwise(3 * limit)
    order = Window.partitionBy("query_id").orderBy(F.col("normalized_address") != F.col("key"), F.desc_nulls_last("last_used_at"), F.desc_nulls_last("updated_at"), "address_id")
    full = met.join(queries, "query_id").join(usable, "address_id").withColumn("pos", F.row_number().over(order))
    return full.filter(F.col("pos") <= most)


def is_street(address: Column, category: Column, kind: Column) -> Column:
    has = lambda k: F.coalesce(F.length(F.element_at(address, k)) > 0, F.lit(False))
    road = has("road") | has("pedestrian") | has("footway") | has("path")
    return ~has("house_number") & (road | F.coalesce(F.lower(category) == "highway", F.lit(False)) | F.coalesce(F.lower(kind).isin(*rules.HIGHWAY_KINDS), F.lit(False)))


def names_query(street: Column, query: Column) -> Column:
    """Whether a token of the street begins one of the query, or the other way round."""
    a, b = street_tokens(street), street_tokens(query)
    return F.exists(a, lambda s: F.exists(b, lambda q: F.startswith(s, q) | F.startswith(q, s)))


def streets_of(items: DataFrame) -> DataFrame:
    """Of items with their query, one street item for each set of street tokens: that of the highest confidence, the first of equal ones."""
    s = items.filter("status IN ('found', 'manual')").withColumn("_street", street_of_item(F.col("address"), F.col("main_text"), F.col("display_name"))).filter("_street <> ''")
    s = s.withColumn("_key", F.array_join(street_tokens(F.col("_street")), " ")).filter((F.col("_key") != "") & names_query(F.col("_street"), F.col("query")))
    s = s.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_key").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "pos"))).filter("_n = 1")
    own = F.map_concat(F.map_filter("address", lambda k, v: ~k.isin("house_number", "house", "road")), F.create_map(F.lit("road"), F.col("_street")))
    made = {"id": F.concat(F.lit("street:"), F.lower(street_source(F.col("_street")))), "secondary_text": street_secondary(F.col("display_name"), F.col("secondary_text"), F.col("_street")), "address": own, "category": F.lit("highway"), "type": F.lit("road"), "status": F.lit("found")}
    return s.withColumns(made).withColumns({"display_name": F.col("_street"), "main_text": F.col("_street")}).drop("_street", "_key", "_n")


def suggest(queries: DataFrame, cache: DataFrame, candidates: DataFrame, limit: int = 10) -> DataFrame:
    """The best items (query_id, place, and those of ITEM) for queries (query_id, query, key) of three characters at least.

    Streets made of cached rows come first in the union, then the cached rows, then the
    geocoder's candidates; of items with the same name and place the first stays. Then streets
    that the query names rank first unless it names a house, then what the cache has, then
    confidence.
    """
    from routeloom.operators.graph import written

    limit = max(1, min(limit, 10))
    q = queries.filter(F.length(F.trim("query")) >= 3).select("query_id", "query", "key")
    # what the cache has is found and read once for each different text; null keys count as one
    once = q.groupBy("query", "key").agg(F.min("query_id").alias("query_id"))
    same = once.select(F.col("query_id").alias("asked"), F.col("query").alias("_q"), F.col("key").alias("_k"))
    members = written(q.join(same, (F.col("query") == F.col("_q")) & F.col("key").eqNullSafe(F.col("_k"))).select("query_id", "query", "asked"))
    house = has_house_number(F.col("query"))
    own = items_of_cache(cached(once, cache, limit)).join(once.select("query_id", "query"), "query_id")
    parts = [streets_of(own.filter(~house)), own]
    same_place = ["query_id", F.round("lat", 6), F.round("lon", 6), F.lower(F.trim("display_name"))]
    every = None
    for n, part in enumerate(parts):
        part = part.select("query_id", "query", F.lit(n).alias("part"), "pos", *ITEM)
        every = part if every is None else every.unionByName(part)

    def first(items: DataFrame) -> DataFrame:
        return items.withColumn("_n", F.row_number().over(Window.partitionBy(*same_place).orderBy("part", "pos"))).filter("_n = 1").drop("_n")

    street = ~house & is_street(F.col("address"), F.col("category"), F.col("type")) & names_query(street_of_item(F.col("address"), F.col("main_text"), F.col("display_name")), F.col("query"))
    rank_of = lambda items: items.withColumn("_street", F.when(street, 0).otherwise(1))
    order = Window.partitionBy("query_id").orderBy("_street", F.col("source") != "database", F.desc(F.coalesce("confidence", F.lit(0.0))), "part", "pos")
    best = lambda items: items.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    own = written(rank_of(first(every)).withColumnRenamed("query", "_query"))

    # a candidate with the name and the place of anything that the cache has for its query is left out
    found = items_of_candidates(candidates).join(members, "query_id").select("query_id", "asked", "query", F.lit(2).alias("part"), "pos", *ITEM)
    point = lambda d, p: [F.round("lat", 6).alias(f"{p}lat"), F.round("lon", 6).alias(f"{p}lon"), F.lower(F.trim("display_name")).alias(f"{p}name")]
    taken = own.select(F.col("query_id").alias("_asked"), *point(own, "_t")).distinct()
    seen = (F.col("asked") == F.col("_asked")) & F.round("lat", 6).eqNullSafe(F.col("_tlat")) & F.round("lon", 6).eqNullSafe(F.col("_tlon")) & F.lower(F.trim("display_name")).eqNullSafe(F.col("_tname"))
    found = rank_of(first(found.join(taken, seen, "left_anti").drop("asked")))
    # of a text's own items no more than `limit` can be among the best of any query
    top = best(own).drop("place", "_query").withColumnRenamed("query_id", "asked").join(members.select("query_id", "asked"), "asked").drop("asked")
    return best(top.unionByName(found.drop("query"))).select("query_id", "place", *ITEM)
