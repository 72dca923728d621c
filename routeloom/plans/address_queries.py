"""Queries of the cache, contexts, suggestions, districts and reports, and the SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeloom.functions import geo, rules
from routeloom.functions import text as T
from routeloom.operators import addresses, checks, contexts, enrichment, places, suggestions
from routeloom.plans.registry import query


def _cases(x: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN {x.replace('?', str(a))} THEN '{b}'" for a, b in pairs) + " END"


@query(
    """, c AS (SELECT *, CASE form WHEN 2 THEN 0.9 WHEN 3 THEN 40.0 / 42 ELSE 1.0 END AS similarity FROM cache WHERE status = 'found' AND lat IS NOT NULL AND lon IS NOT NULL)
SELECT a.id, c.address_id, round(c.similarity, 6) AS similarity FROM asks a JOIN c ON c.k = a.k AND c.h = a.h
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY c.similarity DESC, c.provider <> 'known_poi', c.confidence DESC, c.updated_at DESC, c.address_id DESC) = 1""",
    ("asks", "cache"),
)
def similar_street(v):
    return addresses.similar(v("asks").select("id", "street", "house"), v("cache")).select("id", "address_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT a.id, c.address_id, c.status FROM asks a LEFT JOIN cache c ON c.normalized_address = 'санкт-петербург, улица ' || a.w1 || ' ' || a.w2 || ' дом ' || a.h || a.letter", ("asks", "cache"))
def cache_exact(v):
    r = T.with_cache_key(v("asks").select("id", "raw"), "raw").select("id", "key")
    return addresses.exact(r, v("cache")).select("id", "hit.address_id", "hit.status")


@query(
    """SELECT coalesce(c.normalized_address, n.key) AS normalized_address, CASE WHEN n.key IS NULL THEN c.status ELSE n.status END AS status, CASE WHEN n.key IS NULL THEN c.lat WHEN n.lat IS NOT NULL AND n.lon IS NOT NULL THEN n.lat END AS lat, CASE WHEN n.key IS NULL THEN c.confidence ELSE n.confidence END AS confidence,
  CASE WHEN n.key IS NULL THEN c.updated_at ELSE 99 END AS updated_at, CASE WHEN n.key IS NULL THEN 'kept' WHEN c.normalized_address IS NULL THEN 'inserted' ELSE 'updated' END AS change
FROM (SELECT normalized_address, status, lat, confidence, updated_at FROM cache QUALIFY row_number() OVER (PARTITION BY normalized_address ORDER BY address_id) = 1) c
FULL JOIN (SELECT key, status, CASE WHEN lat IS NOT NULL THEN lat END AS lat, lon, confidence FROM (SELECT 'санкт-петербург, улица ' || w1 || ' ' || w2 || ' дом ' || h || letter AS key, CASE id % 4 WHEN 0 THEN 'not_found' WHEN 1 THEN 'manual' ELSE 'found' END AS status, CASE WHEN id % 3 = 0 THEN NULL ELSE 60.0::double END AS lat, 30.0::double AS lon, (id % 90)::double AS confidence, id FROM asks)
  WHERE status <> 'not_found' QUALIFY row_number() OVER (PARTITION BY key ORDER BY confidence DESC, id) = 1) n ON n.key = c.normalized_address""",
    ("asks", "cache"),
)
def cache_upsert(v):
    from routeloom.operators.snapshots import first_per_key

    old = first_per_key(v("cache"), ["normalized_address"], ["address_id"]).select("normalized_address", "original_address", "status", "lat", "lon", "provider", "confidence", "updated_at")
    i = F.col("id")
    state = F.when(i % 4 == 0, "not_found").when(i % 4 == 1, "manual").otherwise("found")
    # original_address carries the id in order, so that of equal confidences the least id comes in
    new = v("asks").select(T.cache_key(F.col("raw")).alias("normalized_address"), F.format_string("%012d", i).alias("original_address"), F.when(i % 3 > 0, 60.0).alias("lat"), F.lit(30.0).alias("lon"), state.alias("status"), F.lit("nominatim").alias("provider"), (i % 90).cast("double").alias("confidence"))
    return addresses.keep(old, new, F.lit(99).cast("long")).select("normalized_address", "status", "lat", "confidence", "updated_at", "change")


_PLACE = "12742000 * asin(sqrt(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2)))"


@query(
    f"""SELECT id, label, type, radius_km, bounded, source, region, is_area, round({_PLACE}, 2) AS distance_m FROM (SELECT id, lat, lon, CASE id % 8 WHEN 2 THEN 'Мурино' WHEN 3 THEN 'Шушары' WHEN 4 THEN 'где-то' WHEN 5 THEN 'Красное Село' ELSE 'Санкт-Петербург' END AS label,
  CASE WHEN id % 8 IN (2, 3, 5) THEN 'district' WHEN id % 8 = 4 THEN 'custom_area' ELSE 'default_spb' END AS type, CASE id % 8 WHEN 2 THEN 12.0 WHEN 3 THEN 12.0 WHEN 5 THEN 15.0 ELSE 60.0 END::double AS radius_km, id % 8 IN (2, 3, 4, 5) AS bounded, CASE WHEN id % 8 IN (2, 3, 4, 5) THEN 'user_area' ELSE 'default' END AS source,
  CASE id % 8 WHEN 2 THEN 'Ленинградская область' WHEN 4 THEN NULL ELSE 'Санкт-Петербург' END AS region, id % 8 IN (2, 3, 4, 5) AS is_area, CASE id % 8 WHEN 2 THEN 60.0444 WHEN 3 THEN 59.8092 WHEN 5 THEN 59.7383 ELSE 59.9386 END AS clat, CASE id % 8 WHEN 2 THEN 30.4486 WHEN 3 THEN 30.3760 WHEN 5 THEN 30.0867 ELSE 30.3141 END AS clon FROM areas)""",
    ("areas",),
)
def context_distance(v):
    a = v("areas").withColumn("c", contexts.of_area(F.col("area")))
    c = F.col("c")
    return a.select("id", "c.label", "c.type", "c.radius_km", "c.bounded", "c.source", contexts.region_of_label(c["label"]).alias("region"), contexts.constrained(c).alias("is_area"), F.round(contexts.distance_m(F.col("lat"), F.col("lon"), c), 2).alias("distance_m"))


@query(
    """SELECT id, CASE WHEN named THEN town WHEN type = 'spb_lenobl' THEN 'Санкт-Петербург и ближайшая Ленинградская область' WHEN type = 'district' AND label <> '' AND latitude IS NULL THEN CASE label WHEN 'Гатчина' THEN 'Гатчина' ELSE 'точка' END WHEN latitude IS NOT NULL THEN coalesce(nullif(label, ''), 'Санкт-Петербург') ELSE 'Санкт-Петербург' END AS label,
  CASE WHEN named THEN CASE WHEN id % 8 = 1 THEN 60.0 WHEN id % 8 = 5 THEN 15.0 WHEN id % 8 = 4 THEN 60.0 ELSE 12.0 END WHEN type = 'spb_lenobl' THEN 120.0 WHEN type = 'district' AND label <> '' AND latitude IS NULL THEN CASE label WHEN 'Гатчина' THEN 20.0 ELSE 60.0 END WHEN latitude IS NOT NULL THEN coalesce(nullif(radius_km, 0), 60.0) ELSE 60.0 END::double AS radius_km,
  CASE WHEN named THEN CASE WHEN id % 8 = 1 THEN 'default' ELSE 'user_area' END WHEN type = 'spb_lenobl' THEN 'default' WHEN type = 'district' AND label <> '' AND latitude IS NULL THEN 'user_area' WHEN latitude IS NOT NULL THEN coalesce(source, 'custom_point') ELSE 'default' END AS source,
  CASE WHEN named THEN id % 8 <> 1 WHEN type = 'spb_lenobl' THEN false WHEN type = 'district' AND label <> '' AND latitude IS NULL THEN true WHEN latitude IS NOT NULL THEN bounded ELSE false END AS bounded
FROM (SELECT *, id % 8 IN (1, 2, 3, 4, 5) AS named, CASE id % 8 WHEN 2 THEN 'Мурино' WHEN 3 THEN 'Шушары' WHEN 4 THEN 'где-то' WHEN 5 THEN 'Красное Село' ELSE 'Санкт-Петербург' END AS town FROM areas)""",
    ("areas",),
)
def context_build(v):
    return contexts.build(v("areas")).select("id", "context.label", "context.radius_km", "context.source", "context.bounded")


_HINTS = _cases("contains(lower(words), '?')", rules.DISTRICT_HINTS)[:-4] + " ELSE " + "CASE " + " ".join(f"WHEN lat BETWEEN {a} AND {b} AND lon BETWEEN {c} AND {d} THEN '{n}'" for n, a, b, c, d in rules.DISTRICT_BOXES) + " END END"


@query(f"SELECT id, {_HINTS} AS district FROM (SELECT id, lat, lon, CASE id % 9 WHEN 0 THEN 'Невский пр.' WHEN 1 THEN 'улица Чапаёва, наб.' WHEN 2 THEN 'Ропшинское ш.' ELSE 'x' END AS raw, replace(raw, 'ё', 'е') AS words FROM areas)", ("areas",))
def district_fixed(v):
    words = F.when(F.col("id") % 9 == 0, "Невский пр.").when(F.col("id") % 9 == 1, "улица Чапаёва, наб.").when(F.col("id") % 9 == 2, "Ропшинское ш.").otherwise("x")
    return v("areas").select("id", geo.district("lat", "lon", words, list(rules.DISTRICT_HINTS), list(rules.DISTRICT_BOXES)).alias("district"))


@query(
    """SELECT id, CASE form WHEN 1 THEN upper(name) || ' пр-т' WHEN 3 THEN 'набережная ' || name WHEN 4 THEN 'шоссе ' || name WHEN 5 THEN 'бульвар ' || name ELSE 'улица ' || name END AS street,
  list_aggregate(list_sort(list_distinct(string_split(name, ' ') || CASE form WHEN 1 THEN ['гатчина', house || coalesce('к' || corpus, '')] WHEN 0 THEN list_filter(['спб', house, corpus], lambda x: x IS NOT NULL) WHEN 2 THEN [house] WHEN 3 THEN [house, 'дом'] WHEN 4 THEN ['мурино', house] ELSE [] END)), 'string_agg', ' ') AS tokens FROM requests""",
    ("requests",),
)
def street_texts(v):
    r = v("requests")
    return r.select("id", suggestions.street_in(F.col("raw")).alias("street"), F.array_join(suggestions.street_tokens(F.col("raw")), " ").alias("tokens"))


@query(
    """, x AS (SELECT f.*, p_name AS road, (pos % 40)::string AS n FROM found_json f JOIN part ON p_partkey = pos % 200)
SELECT query_id, pos, CASE pos % 3 WHEN 0 THEN 'nominatim:way:' || pos ELSE 'nominatim:place:' || (pos % 1000) END AS id,
  CASE WHEN pos % 5 > 0 THEN road || CASE pos % 2 WHEN 0 THEN ', ' || n ELSE '' END WHEN pos % 7 = 0 THEN 'Магазин' || CASE pos % 2 WHEN 0 THEN ', ' || n ELSE '' END ELSE road || ' ' || n || ', Санкт-Петербург' END AS main_text,
  CASE pos % 7 WHEN 0 THEN 'Магазин, ' ELSE '' END || 'Центр, Санкт-Петербург, 19' || (pos % 90 + 10) || ', Россия' AS secondary_text,
  round(greatest(0, least(99, 45 + least(importance * 45, 35) + CASE WHEN place_rank >= 30 THEN 15 WHEN place_rank <= 26 THEN -15 ELSE 0 END + CASE pos % 2 WHEN 0 THEN 15 ELSE 0 END - CASE WHEN lat < 58 THEN 40 ELSE 0 END)), 2)::double AS confidence, lat < 58 AS outside FROM x""",
    ("found_json",),
)
def suggest_items(v):
    return suggestions.items_of_candidates(v("found_json")).select("query_id", "pos", "id", "main_text", "secondary_text", "confidence", "outside")


@query()
def suggest_pipeline(v):
    q = v("asks").select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, F.col("w1")).otherwise(F.concat_ws(" ", "w1", "w2", "h")).alias("query")).withColumn("key", T.cache_key(F.col("query")))
    c = v("cache").withColumns({"score": F.lit(None).cast("double"), "raw": F.lit(None).cast("string")})
    return suggestions.suggest(q, c, v("found_json")).select("query_id", "place", "id", "main_text", "secondary_text", "confidence", "source")


_VARIANTS = {
    0: [("'Санкт-Петербург, ' || rest", 110, "explicit_spb"), ("rest || ', Санкт-Петербург'", 105, "explicit_spb_suffix")],
    1: [("'Ленинградская область, гатчина, ' || rest", 120, "lenobl_settlement"), ("'гатчина, ' || rest || ', Ленинградская область'", 115, "lenobl_settlement_suffix")],
    2: [("'Санкт-Петербург, ' || rest", 80, "default_spb"), ("rest || ', Санкт-Петербург'", 75, "default_spb_suffix"), ("'Ленинградская область, ' || rest", 70, "lenobl_fallback")],
    4: [("'Ленинградская область, мурино, ' || rest", 120, "lenobl_settlement"), ("'мурино, ' || rest || ', Ленинградская область'", 115, "lenobl_settlement_suffix")],
}
_VARIANT_ROWS = " UNION ALL ".join(
    f"SELECT id, {n} AS pos, {q} AS query, {p} AS priority, '{note}' AS note FROM r WHERE {'form IN (2, 3, 5)' if form == 2 else f'form = {form}'}" for form, rows in _VARIANTS.items() for n, (q, p, note) in enumerate([*rows, ("clean", 10, "raw")])
)


@query(
    f""", r AS (SELECT id, form, CASE form WHEN 0 THEN 'улица ' || name || ' дом ' || house || coalesce(' корпус ' || corpus, '') WHEN 1 THEN lower(name) || ' проспект, ' || house || coalesce(' корпус ' || corpus, '') WHEN 2 THEN 'улица ' || name || ' ' || house WHEN 3 THEN 'набережная ' || name || ', дом ' || house
  WHEN 4 THEN 'шоссе ' || name || ' дом ' || house ELSE 'бульвар ' || name END AS rest, CASE form WHEN 0 THEN 'спб, ' WHEN 1 THEN 'гатчина, ' WHEN 4 THEN 'мурино, ' ELSE '' END || rest AS clean FROM requests)
SELECT id, cast(pos AS int) AS pos, query, cast(priority AS int) AS priority, note FROM ({_VARIANT_ROWS})""",
    ("requests",),
)
def query_variants(v):
    from routeloom.operators.geocoding import query_variants as variants

    return variants(T.parsed(v("requests")))


_REPORT = """, r AS (SELECT *, CASE WHEN id % 6 > 1 THEN a || ':' || b END AS key, nullif(trim(coalesce(address, '')), '') AS own FROM reports), x AS (SELECT *, CASE WHEN own IS NOT NULL THEN 'skipped_existing_address' WHEN key IS NULL THEN 'error' WHEN (a + b) % 5 = 0 THEN 'not_found' ELSE 'found' END AS state FROM r)"""


@query(
    f"""{_REPORT} SELECT id, state AS reverse_status, CASE state WHEN 'found' THEN CASE a % 3 WHEN 0 THEN 'город ' || a || ', улица ' || b || ', ' || b WHEN 1 THEN 'район ' || a || ', улица ' || b ELSE 'имя' END ELSE '' END AS reverse_address,
  CASE WHEN state = 'found' AND a % 3 = 0 THEN b::string ELSE '' END AS reverse_house_number, CASE state WHEN 'error' THEN 'Missing or invalid latitude/longitude' WHEN 'not_found' THEN 'Nominatim returned no address' ELSE '' END AS reverse_error, state = 'found' AS filled,
  CASE WHEN state = 'found' THEN CASE id % 3 WHEN 0 THEN 'X;REVERSE_GEOCODED' ELSE 'REVERSE_GEOCODED' END ELSE warnings END AS warnings FROM x""",
    ("reports",),
)
def reverse_fill(v):
    r = v("reports")
    answers = enrichment.wanted(r, every=True).select("key", F.round((F.col("lat") - 59.9) * 500).cast("int").alias("a"), F.round((F.col("lon") - 30.25) * 160).cast("int").alias("b")).filter("(a + b) % 5 <> 0")
    s = lambda *x: F.concat_ws(" ", *(F.lit(c) if isinstance(c, str) else c.cast("string") for c in x))
    a, b = F.col("a"), F.col("b")
    address = F.when(a % 3 == 0, F.create_map(F.lit("town"), s("город", a), F.lit("road"), s("улица", b), F.lit("house_number"), b.cast("string"))).when(a % 3 == 1, F.create_map(F.lit("suburb"), s("район", a), F.lit("footway"), s("улица", b)))
    answers = answers.select("key", F.lit("имя").alias("display_name"), address.alias("address"), F.lit("node").alias("osm_type"), F.lit(1).cast("long").alias("osm_id"))
    return enrichment.fill(r, answers).select("id", "reverse_status", "reverse_address", "reverse_house_number", "reverse_error", "filled", "warnings")


@query(f"{_REPORT} SELECT count(*) AS rows, count(*) FILTER (state = 'found') AS found, count(*) FILTER (state = 'not_found') AS not_found, count(*) FILTER (state = 'error') AS errors, count(*) FILTER (state LIKE 'skipped%') AS skipped, count(*) FILTER (state = 'found') AS filled FROM x", ("reports",))
def reverse_counts(v):
    r = v("reports")
    answers = enrichment.wanted(r, every=True).filter("(round((lat - 59.9) * 500) + round((lon - 30.25) * 160)) % 5 <> 0").select("key", F.lit("имя").alias("display_name"), F.lit(None).cast("map<string,string>").alias("address"), F.lit("node").alias("osm_type"), F.lit(1).cast("long").alias("osm_id"))
    return enrichment.fill_counts(enrichment.fill(r, answers))


@query(
    """SELECT 'улица ' || w1 || ' ' || w2 || ' дом ' || h AS key, max_by(id, struct_pack(c := confidence, u := u, i := id)) AS id FROM (SELECT id, w1, w2, h, (id % 23)::double AS confidence, id % 29 AS u FROM asks WHERE letter = '' AND id % 3 > 0 AND id % 4 > 0) GROUP BY ALL""",
    ("asks",),
)
def places_for_cache(v):
    i = F.col("id")
    p = v("asks").select("id", F.when(F.col("letter") == "", F.col("raw")).alias("address"), (i % 3 > 0).alias("is_active"), (i % 4 == 0).alias("is_duplicate"), F.lit(60.0).alias("lat"), F.lit(30.0).alias("lon"), (i % 23).cast("double").alias("confidence"), (i % 29).alias("updated_at"))
    return enrichment.for_cache(p, None).select(F.col("normalized_address").alias("key"), "id")


@query(
    """SELECT c.id, CASE WHEN n.address IS NULL THEN c.address ELSE coalesce(nullif(trim(c.address), ''), n.address) END AS address, CASE WHEN n.address IS NULL THEN c.confidence ELSE greatest(c.confidence, n.confidence) END AS confidence, CASE WHEN n.address IS NULL THEN 'kept' ELSE 'updated' END AS change FROM
(SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'своя' END AS address, (c_custkey % 10)::double AS confidence FROM customer) c
LEFT JOIN (SELECT o_custkey AS id, 'адрес ' || (o_orderkey % 9) AS address, (o_orderkey % 15)::double AS confidence FROM orders WHERE o_orderkey % 4 > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 15) DESC, 'адрес ' || (o_orderkey % 9)) = 1) n ON n.id = c.id""",
    ("places",),
)
def report_applied(v):
    i = F.col("id")
    known = v("places").select("id", F.lit("node").alias("osm_type"), i.alias("osm_id"), F.when(i % 3 == 0, " ").when(i % 3 == 2, "своя").alias("address"), (i % 10).cast("double").alias("confidence"), F.lit(0).alias("updated_at"))
    rows = v("attempts").select(F.lit("node").alias("osm_type"), F.col("id").alias("osm_id"), F.when(F.col("pos") % 4 > 0, F.concat(F.lit("адрес "), (F.col("pos") % 9).cast("string"))).otherwise(" ").alias("address"), (F.col("pos") % 15).cast("double").alias("confidence"))
    return enrichment.apply_report(known, rows, F.lit(1)).select("id", "address", "confidence", "change")


@query("SELECT (SELECT count(*) FROM orders) AS rows, (SELECT count(*) FROM orders WHERE o_custkey % 2 = 0) AS known, (SELECT count(*) FROM orders WHERE o_custkey % 2 = 1) AS unknown, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)) AS unnamed", ("places",))
def report_coverage(v):
    rows = v("attempts").select(F.lit("node").alias("osm_type"), F.col("id").alias("osm_id"))
    return enrichment.report_coverage(rows, v("places").filter("id % 2 = 0").select(F.lit("node").alias("osm_type"), F.col("id").alias("osm_id")))


@query(
    f"""SELECT query_id, id, match, round(d, 3) AS distance_m FROM (SELECT q.query_id, p.id, CASE WHEN contains(lower(p.normalized), q.key) THEN 0 WHEN contains(lower(p.address), q.low) THEN 1 WHEN contains(lower(p.name), q.low) THEN 2 ELSE 3 END AS match, q.b,
  {_PLACE.replace("clat", "q.lat").replace("clon", "q.lon").replace("radians(lat)", "radians(p.lat)").replace("- lat", "- p.lat").replace("- lon", "- p.lon")} AS d, p.confidence, contains(lower(p.normalized), q.key) OR contains(lower(p.address), q.low) OR contains(lower(p.name), q.low) OR contains(lower(p.brand), q.low) AS held, p.brand FROM
  (SELECT query_id, lat, lon, CASE query_id % 3 WHEN 0 THEN 'BUILDING' END AS b, CASE query_id % 3 WHEN 1 THEN 'street ' || (query_id % 40) || ',' ELSE 'mach' END AS low, CASE query_id % 3 WHEN 1 THEN 'street ' || (query_id % 40) ELSE 'mach' END AS key FROM queries) q
  JOIN (SELECT *, 'street ' || (id % 40) AS normalized FROM places) p ON q.b = p.brand OR q.b IS NULL) WHERE d <= 5000 AND (b = brand OR b IS NULL AND held)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY match, confidence DESC, id) <= CASE WHEN b IS NULL THEN 100 ELSE 300 END""",
    ("queries", "places"),
)
def place_candidates(v):
    i = F.col("query_id")
    text = F.when(i % 3 == 1, F.concat(F.lit("street "), (i % 40).cast("string"), F.lit(","))).otherwise("mach")
    q = v("queries").select("query_id", text.alias("text"), F.when(i % 3 == 0, "BUILDING").alias("brand"), "lat", "lon")
    p = v("places").withColumns({"normalized_address": F.concat(F.lit("street "), (F.col("id") % 40).cast("string")), "updated_at": F.lit(0)})
    return places.by_class(q, p).select("query_id", "id", "match", F.round("distance_m", 3).alias("distance_m"))


@query(
    """SELECT address_id AS id, CASE WHEN status = 'ambiguous' AND address_id % 2 = 0 THEN 'status' WHEN confidence > 10 THEN 'confidence' WHEN lat IS NOT NULL AND address_id % 31 = 0 THEN 'latitude' WHEN address_id % 37 = 0 THEN 'longitude' END AS error FROM cache""",
    ("cache",),
)
def address_checks(v):
    i = F.col("address_id")
    rows = v("cache").select(i.alias("id"), F.when((F.col("status") == "ambiguous") & (i % 2 == 0), "odd").otherwise(F.col("status")).alias("status"), (F.col("confidence") * F.when(F.col("confidence") > 10, 10).otherwise(1)).alias("confidence"), F.when((i % 31 == 0) & F.col("lat").isNotNull(), 91.0).otherwise(F.col("lat")).alias("lat"), F.when(i % 37 == 0, -181.0).otherwise(F.col("lon")).alias("lon"))
    return checks.address_rows(rows).select("id", "error")


@query(
    """SELECT id, CASE WHEN id % 6 = 0 THEN 'no addresses' WHEN id % 6 = 1 THEN 'too many addresses' WHEN id % 6 = 2 THEN 'latitude' WHEN id % 6 = 3 THEN 'radius' END AS error, CASE id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 0 END AS n_points, id % 4 = 0 AS is_line FROM areas""",
    ("areas",),
)
def request_checks(v):
    i = F.col("id")
    n = F.when(i % 6 == 0, 0).when(i % 6 == 1, 101).otherwise(3)
    rows = v("areas").select("id", F.slice(F.array_repeat(F.lit("a"), 101), F.lit(1), n).alias("addresses"), F.when(i % 6 == 2, 90.5).otherwise(60.0).alias("lat"), F.lit(30.0).alias("lon"), F.when(i % 6 == 3, 500.5).otherwise(5.0).alias("radius_km"))
    shape = F.when(i % 4 == 0, '{"type":"LineString","coordinates":[[30.1,59.9],[30.2,59.8]]}').when(i % 4 == 1, '{"type":"Point","coordinates":[30,59]}').when(i % 4 == 2, '{"type":"LineString","coordinates":[[30.1,59.9],[230.2,59.8]]}').otherwise("no json")
    return checks.requests(rows).withColumn("shape", shape).select("id", "error", F.size(checks.line_points(F.col("shape"))).alias("n_points"), checks.line_string(F.col("shape")).isNotNull().alias("is_line"))
