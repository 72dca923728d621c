"""The registered queries: each applies operators to derived views; SQL beside it says what must come out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from routeloom.functions import geo, scalars
from routeloom.functions import text as T
from routeloom.functions.similarity import similar_pairs
from routeloom.operators import geocoding, metrics, places, register, routes, sheets, snapshots, suggestions
from routeloom.plans.registry import query

_METRES = "12742000 * atan2(sqrt(h), sqrt(1 - h))"
_H = "pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)"
_GRAMS = """, words_of AS (SELECT DISTINCT s, unnest(string_split_regex(lower(s), '[^0-9a-zа-яё_]+')) AS w FROM texts),
padded AS (SELECT s, '  ' || w || ' ' AS p FROM words_of WHERE w <> ''),
grams AS (SELECT DISTINCT s, substr(p, cast(i AS int), 3) AS g FROM (SELECT s, p, unnest(range(1, length(p) - 1)) AS i FROM padded)),
sizes AS (SELECT s, count(*) AS n FROM grams GROUP BY s),
shared AS (SELECT a.s AS l, b.s AS r, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g GROUP BY a.s, b.s),
sim AS (SELECT l, r, c / (x.n + y.n - c) AS similarity FROM shared JOIN sizes x ON x.s = l JOIN sizes y ON y.s = r)"""


@query(f", texts AS (SELECT DISTINCT full_name AS s FROM streets){_GRAMS} SELECT l, r, round(similarity, 6) AS similarity FROM sim WHERE similarity > 0.5", ("streets",))
def trigram_pairs(v):
    s = v("streets")
    return similar_pairs(s.select(F.col("full_name").alias("l")), s.select(F.col("full_name").alias("r")), 0.5).select("l", "r", F.round("similarity", 6).alias("similarity"))


_STREETS = f""", asked AS (SELECT DISTINCT CASE form WHEN 1 THEN 'гатчина, ' || lower(name) || ' проспект' WHEN 2 THEN 'улица ' || name WHEN 3 THEN 'набережная ' || name WHEN 4 THEN 'шоссе ' || name WHEN 5 THEN 'бульвар ' || name ELSE 'улица ' || name END AS street, CASE form WHEN 1 THEN 'гатчина ' ELSE '' END || lower(name) AS bare FROM requests), asks AS (SELECT *, replace(street, ',', '') AS lookup FROM asked),
texts AS (SELECT DISTINCT lookup AS s FROM asks UNION SELECT DISTINCT bare FROM asks UNION SELECT DISTINCT lower(full_name) FROM streets UNION SELECT DISTINCT lower(name) FROM streets){_GRAMS},
met AS (SELECT street, object_id, full_name, region_code, (lower(full_name) = lookup OR lower(name) = bare) AS exact, greatest(coalesce(x.similarity, 0), coalesce(y.similarity, 0)) AS score,
  contains(lower(full_name), bare) OR contains(lower(name), bare) AS held
  FROM asks CROSS JOIN streets LEFT JOIN sim x ON x.l = lower(full_name) AND x.r = lookup LEFT JOIN sim y ON y.l = lower(name) AND y.r = bare),
found AS (SELECT *, row_number() OVER (PARTITION BY street ORDER BY exact DESC, score DESC, object_id) AS place FROM met WHERE exact OR held OR score > 0.25 QUALIFY place <= 10)"""


@query(f"{_STREETS} SELECT street, object_id, full_name, region_code, exact, round(score, 6) AS score, cast(place AS int) AS place FROM found", ("requests", "streets"))
def register_streets(v):
    read = T.parsed(v("requests")).select("street")
    out = register.candidate_streets(read, v("streets"))
    return out.select("street", "object_id", "full_name", "region_code", "exact", F.round("score", 6).alias("score"), "place")


@query(
    f"""{_STREETS},
r AS (SELECT id, CASE form WHEN 1 THEN 'гатчина, ' || lower(name) || ' проспект' WHEN 2 THEN 'улица ' || name WHEN 3 THEN 'набережная ' || name WHEN 4 THEN 'шоссе ' || name WHEN 5 THEN 'бульвар ' || name ELSE 'улица ' || name END AS street,
  CASE WHEN form < 5 THEN house END AS house, CASE WHEN form < 2 THEN corpus END AS corpus FROM requests),
h AS (SELECT parent_object_id AS object_id, house_id, house_number, building_number, replace(house_number, ' ', '') AS k1, house_number || 'к' || coalesce(building_number, '') AS k2, house_number || coalesce(building_number, '') AS k3 FROM houses),
own AS (SELECT DISTINCT street, house, corpus FROM r),
hits AS (SELECT DISTINCT o.street, o.house, o.corpus, f.object_id, f.place, h.house_id, h.house_number, h.building_number, (h.k1 = o.house) AS exact FROM own o JOIN found f ON f.street = o.street JOIN h ON h.object_id = f.object_id
  AND (h.k1 = o.house OR h.k2 = o.house || coalesce('к' || o.corpus, '') OR h.k3 = o.house || coalesce('к' || o.corpus, ''))),
top AS (SELECT *, row_number() OVER (PARTITION BY object_id, street, house, corpus ORDER BY exact DESC, house_id) AS hp FROM hits QUALIFY hp <= 10),
n AS (SELECT o.street, o.house, o.corpus, count(DISTINCT f.object_id) AS ns FROM own o JOIN found f ON f.street = o.street GROUP BY ALL),
m AS (SELECT street, house, corpus, count(*) AS nh FROM top GROUP BY ALL)
SELECT r.id, r.street, r.house, coalesce(ns, 0) AS n_streets, coalesce(nh, 0) AS n_houses,
  CASE WHEN ns IS NULL THEN 'not_found' WHEN r.house IS NULL THEN CASE WHEN ns > 1 THEN 'ambiguous' ELSE 'partial_match' END WHEN nh = 1 THEN 'exact_match' WHEN nh > 1 THEN 'ambiguous' ELSE 'partial_match' END AS status,
  cast(CASE WHEN ns IS NULL THEN 0 WHEN r.house IS NULL THEN CASE WHEN ns > 1 THEN 0.6 ELSE 0.72 END WHEN nh = 1 THEN 0.97 WHEN nh > 1 THEN 0.74 ELSE 0.55 END AS double) AS confidence
FROM r LEFT JOIN n ON n.street = r.street AND n.house IS NOT DISTINCT FROM r.house AND n.corpus IS NOT DISTINCT FROM r.corpus
LEFT JOIN m ON m.street = r.street AND m.house = r.house AND m.corpus IS NOT DISTINCT FROM r.corpus""",
    ("requests", "streets", "houses"),
)
def register_verdict(v):
    out = register.verdicts(v("requests").select("id", "raw"), v("streets"), v("houses"))
    return out.select("id", "street", "house", "status", "confidence", "n_streets", "n_houses")


@query(
    """SELECT id, CASE form WHEN 0 THEN 'Санкт-Петербург' WHEN 1 THEN 'Ленинградская область' WHEN 4 THEN 'Ленинградская область' END AS region, CASE form WHEN 1 THEN 'гатчина' WHEN 4 THEN 'мурино' END AS settlement,
  CASE form WHEN 1 THEN 'гатчина, ' || lower(name) || ' проспект' WHEN 2 THEN 'улица ' || name WHEN 3 THEN 'набережная ' || name WHEN 4 THEN 'шоссе ' || name WHEN 5 THEN 'бульвар ' || name ELSE 'улица ' || name END AS street,
  CASE WHEN form < 5 THEN house END AS house, CASE WHEN form < 2 THEN corpus END AS corpus FROM requests""",
    ("requests",),
)
def parse_components(v):
    return T.parsed(v("requests")).select("id", "region", "settlement", "street", F.col("house"), "corpus")


@query(
    """SELECT id, CASE form WHEN 0 THEN 'санкт-петербург, улица ' || name || ' дом ' || house || coalesce(' корпус ' || corpus, '')
  WHEN 1 THEN 'гатчина, ' || lower(name) || ' проспект, ' || house || coalesce(' корпус ' || corpus, '') WHEN 2 THEN 'санкт-петербург, улица ' || name || ' ' || house
  WHEN 3 THEN 'санкт-петербург, набережная ' || name || ', дом ' || house WHEN 4 THEN 'мурино, шоссе ' || name || ' дом ' || house ELSE 'санкт-петербург, бульвар ' || name END AS key FROM requests""",
    ("requests",),
)
def cache_keys(v):
    return T.with_cache_key(v("requests").select("id", "raw"), "raw").select("id", "key")


@query(f"SELECT query_id, id, round({_METRES}, 3) AS distance_m FROM (SELECT query_id, id, {_H} AS h FROM queries a CROSS JOIN places b) WHERE {_METRES} <= 500", ("places", "queries"))
def places_within(v):
    out = geo.pairs_within(v("queries").select("query_id", "lat", "lon"), v("places").select("id", "lat", "lon"), 500.0, decimals=3)
    return out.select("query_id", "id", "distance_m")


#: Queries that name an address, a name, a brand or a street, some with a brand, some without a point.
_SOUGHT = """SELECT query_id, query_id % 4 AS f, query_id % 40 AS street, query_id % 7 AS house, CASE query_id % 4 WHEN 0 THEN concat('Street ', cast(query_id % 40 AS string), ' ', cast(query_id % 7 AS string)) WHEN 1 THEN 'Customer#00000000' WHEN 2 THEN 'Machinery' ELSE concat('street ', cast(query_id % 40 AS string)) END AS text,
  CASE WHEN query_id % 4 = 2 THEN 'MACHINERY' END AS brand, CASE WHEN query_id % 5 > 0 THEN lat END AS lat, CASE WHEN query_id % 5 > 0 THEN lon END AS lon FROM {queries}"""
#: The search in SQL: the queries' texts stand in the places' words, so the whole of them is the block that matches.
_SEARCH = f""", s AS ({_SOUGHT.replace("{queries}", "queries")}),
t AS (SELECT *, lower(text) AS low, CASE f WHEN 0 THEN 'street ' || street || ' ' || house WHEN 1 THEN 'customer00000000' ELSE lower(text) END AS q FROM s),
m AS (SELECT a.query_id, a.q, a.brand AS asked, a.lat IS NOT NULL AS placed, b.id, b.confidence, lower(b.brand) AS brand, replace(b.address, ',', '') AS address, replace(b.address, ',', '') || ' ' || replace(lower(b.name), '#', '') || ' ' || lower(b.brand) AS hay,
  CASE WHEN contains(replace(lower(b.address), ',', ''), a.low) THEN 0 WHEN contains(lower(b.name), a.low) THEN 2 ELSE 3 END AS match, {_H} AS h
  FROM t a JOIN places b ON CASE WHEN a.brand IS NULL THEN contains(replace(lower(b.address), ',', ''), a.low) OR contains(lower(b.name), a.low) OR contains(lower(b.brand), a.low) ELSE a.brand = b.brand END),
c AS (SELECT *, CASE WHEN placed THEN {_METRES} END AS d FROM m WHERE NOT placed OR {_METRES} <= 5000 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY match, confidence DESC, id) <= CASE WHEN asked IS NULL THEN 100 ELSE 300 END),
x AS (SELECT *, 2.0::double * length(q) / (length(q) + length(hay)) AS base FROM c),
y AS (SELECT *, CASE WHEN q = address THEN 1.0::double WHEN q = brand THEN 0.72::double WHEN regexp_matches(q, '[0-9]') THEN greatest(base, 0.96::double) ELSE greatest(base, 0.88::double) END AS t FROM x),
z AS (SELECT query_id, id, d, match, round(greatest(0, least(1, t * 0.62::double + confidence * 0.28::double + CASE WHEN d IS NULL THEN 0 ELSE greatest(0, least(1, 1 - d / 5000)) END * 0.1::double)), 4) AS score FROM y),
found AS (SELECT query_id, id, round(d, 3) AS distance_m, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match, id) AS int) AS place FROM z QUALIFY place <= 5)"""


def _search(v):
    q = v("queries")
    p = v("places").withColumns({"normalized_address": F.replace("address", F.lit(","), F.lit("")), "updated_at": F.lit(0)})
    return places.search(q.sparkSession.sql(_SOUGHT, queries=q), p)


@query(f"{_SEARCH} SELECT query_id, id, distance_m, score, place FROM found", ("queries", "places"))
def place_search(v):
    return _search(v).withColumn("distance_m", F.round("distance_m", 3))


@query(
    f"""{_SEARCH}, b AS (SELECT query_id, max(CASE WHEN place = 1 THEN score END) AS s1, max(CASE WHEN place = 2 THEN score END) AS s2, max(CASE WHEN place = 1 THEN id END) AS first FROM found GROUP BY query_id), v AS (SELECT *, s1 >= 0.86 AND (s2 IS NULL OR s1 - s2 >= 0.08) AS sure FROM b)
SELECT query_id, CASE WHEN sure THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN sure THEN first END AS id FROM v""",
    ("queries", "places"),
)
def place_resolve(v):
    return places.resolve(_search(v))


@query(f"SELECT brand, a, b, round({_METRES}, 3) AS distance_m FROM (SELECT a.brand, a.id AS a, b.id AS b, a.address = b.address AS same, {_H} AS h FROM near_places a JOIN near_places b ON a.brand = b.brand AND a.id < b.id) WHERE {_METRES} <= 30 OR same AND {_METRES} <= 80", ("near_places",))
def duplicate_pairs(v):
    return places.duplicate_pairs(v("near_places")).select("brand", "a", "b", F.round("distance_m", 3).alias("distance_m"))


#: The greedy choice in SQL: one place after another, with the marks and scores of its brand in lists.
_MARKED = f""", n AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY ord) AS i FROM near_places),
e AS (SELECT brand, i, list(j ORDER BY j) AS later FROM (SELECT a.brand, a.i, b.i AS j, a.address = b.address AS same, {_H} AS h FROM n a JOIN n b ON a.brand = b.brand AND a.i < b.i) WHERE {_METRES} <= 30 OR same AND {_METRES} <= 80 GROUP BY brand, i),
g AS (SELECT brand, list(id ORDER BY i) AS ids, list(filled ORDER BY i) AS fills, list(kind ORDER BY i) AS kinds, list(confidence ORDER BY i) AS scores, list(NULL::bigint ORDER BY i) AS marks, count(*) AS n FROM n GROUP BY brand),
w AS (SELECT brand, 0::bigint AS i, scores, marks FROM g
  UNION ALL SELECT w.brand, w.i + 1, CASE WHEN k.best IS NULL THEN w.scores ELSE list_transform(w.scores, lambda s, x: CASE WHEN x <> k.best AND list_contains(k.own, x) THEN round(greatest(0, s - 0.2), 4) ELSE s END) END, CASE WHEN k.best IS NULL THEN w.marks ELSE list_transform(w.marks, lambda m, x: CASE WHEN x <> k.best AND list_contains(k.own, x) THEN k.best ELSE m END) END
  FROM w JOIN g ON g.brand = w.brand AND w.i < g.n LEFT JOIN e ON e.brand = w.brand AND e.i = w.i + 1,
  LATERAL (SELECT own, CASE WHEN own IS NOT NULL THEN -list_reverse_sort([{{'f': g.fills[x], 'k': g.kinds[x], 's': w.scores[x], 'n': -x}} FOR x IN own])[1].n END AS best FROM (SELECT CASE WHEN w.marks[w.i + 1] IS NULL AND e.later IS NOT NULL THEN list_prepend(w.i + 1, e.later) END AS own)) k),
marked AS (SELECT unnest(g.ids) AS id, unnest(list_transform(w.marks, lambda m: g.ids[m])) AS duplicate_of, unnest(w.scores) AS confidence FROM w JOIN g ON g.brand = w.brand AND w.i = g.n)"""


@query(f"WITH RECURSIVE {_MARKED[2:]} SELECT id, duplicate_of, confidence FROM marked", ("near_places",))
def duplicates_marked(v):
    return places.mark_duplicates(v("near_places"))


@query(f"WITH RECURSIVE {_MARKED[2:]} SELECT p.brand, count(*) AS n, count(duplicate_of) AS duplicates, count(CASE WHEN m.confidence < 0.75 THEN 1 END) AS low, count(CASE WHEN coalesce(trim(p.address), '') = '' THEN 1 END) AS no_address FROM near_places p JOIN marked m ON m.id = p.id GROUP BY p.brand", ("near_places",))
def place_report(v):
    p = v("near_places")
    return places.report(p.drop("confidence").join(places.mark_duplicates(p), "id"))


_ALIASES = "(VALUES ('A', 'ring', 0), ('A', 'small ring', 1), ('B', 'Widget', 2), ('C', 'red', 3), ('D', 'gear', 4), ('E', 'bl', 5)) AS t(brand, alias, ord)"


@query(
    f"SELECT id, brand, alias FROM (SELECT object_id AS id, brand, alias, row_number() OVER (PARTITION BY object_id ORDER BY name <> lower(alias), length(alias) DESC, ord) AS n FROM streets JOIN {_ALIASES} ON contains(name, lower(alias)) AND (length(alias) > 2 OR name = lower(alias))) WHERE n = 1",
    ("streets",),
)
def brand_detect(v):
    s = v("streets")
    aliases = s.sparkSession.sql(f"SELECT * FROM {_ALIASES}")
    return places.detect_brands(s.select(F.col("object_id").alias("id"), F.lit(0).alias("ord"), F.col("name").alias("value")), aliases)


@query(
    """SELECT id, round(greatest(0.0, least(1.0, 0.4 + CASE WHEN id % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN id % 4 > 0 THEN 0.2 ELSE 0 END + 0.1 + 0.1
  - CASE WHEN id % 4 = 0 THEN 0.2 ELSE 0 END - CASE WHEN id % 3 > 0 THEN 0.2 ELSE 0 END)), 4)::double AS confidence FROM places""",
    ("places",),
)
def place_confidence(v):
    p = v("places")
    yes = F.lit(True)
    shop = F.when(F.col("id") % 3 == 0, "supermarket")
    house = F.when(F.col("id") % 4 > 0, F.lit("7"))
    warn = F.array_compact(F.array(F.when(F.col("id") % 4 == 0, "ADDRESS_MISSING"), F.when(F.col("id") % 3 > 0, "SHOP_TAG_MISSING")))
    return p.select("id", places.confidence(yes, shop, F.col("address"), house, F.lit("x"), F.lit(None).cast("string"), yes, warn).alias("confidence"))


_BOXES = [("first", 59.90, 59.91, 30.30, 30.32), ("second", 59.905, 59.92, 30.31, 30.33), ("third", 59.90, 59.93, 30.30, 30.325)]


@query(
    """SELECT id, CASE WHEN contains(lower(address), 'street 7,') THEN 'hinted' WHEN lat BETWEEN 59.90 AND 59.91 AND lon BETWEEN 30.30 AND 30.32 THEN 'first'
  WHEN lat BETWEEN 59.905 AND 59.92 AND lon BETWEEN 30.31 AND 30.33 THEN 'second' WHEN lat BETWEEN 59.90 AND 59.93 AND lon BETWEEN 30.30 AND 30.325 THEN 'third' END AS district FROM places""",
    ("places",),
)
def district_assign(v):
    return v("places").select("id", geo.district("lat", "lon", "address", [("street 7,", "hinted")], _BOXES).alias("district"))


_UPSERT = """coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL OR o.provider IS NOT DISTINCT FROM 'manual' THEN 'kept' ELSE 'updated' END AS change"""


@query(
    f"""SELECT id, change, CASE change WHEN 'inserted' THEN nn WHEN 'updated' THEN nn ELSE oname END AS name, CASE change WHEN 'inserted' THEN ns WHEN 'updated' THEN greatest(ns, os) ELSE os END AS score,
  CASE change WHEN 'inserted' THEN np WHEN 'updated' THEN coalesce(np, op) ELSE op END AS provider, true AS is_active FROM (SELECT {_UPSERT}, n.name AS nn, o.name AS oname, n.score AS ns, o.score AS os, n.provider AS np, o.provider AS op FROM old_rows o FULL JOIN new_rows n ON o.id = n.id)""",
    ("old_rows", "new_rows"),
)
def upsert_keep_manual(v):
    return snapshots.upsert(v("old_rows"), v("new_rows"), ["id"], {"score": snapshots.greatest, "provider": snapshots.old_unless_null}, keep=F.col("o.provider") == "manual")


@query(f"SELECT change, count(*) AS n FROM (SELECT {_UPSERT} FROM old_rows o FULL JOIN new_rows n ON o.id = n.id) GROUP BY change", ("old_rows", "new_rows"))
def upsert_counts(v):
    return snapshots.changes(snapshots.upsert(v("old_rows"), v("new_rows"), ["id"], keep=F.col("o.provider") == "manual"))


@query("SELECT id, name, score, provider, id IN (SELECT id FROM new_rows) AS is_active FROM old_rows", ("old_rows", "new_rows"))
def deactivate_missing(v):
    return snapshots.deactivate_missing(v("old_rows"), v("new_rows"), ["id"])


@query("SELECT o.id, o.name, o.score, coalesce(nullif(trim(o.provider), ''), n.provider) AS provider, o.is_active, CASE WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS change FROM old_rows o LEFT JOIN new_rows n ON o.id = n.id", ("old_rows", "new_rows"))
def patch_items(v):
    return snapshots.upsert(v("old_rows"), v("new_rows").select("id", "provider"), ["id"], {"provider": snapshots.fill_blank}, insert=False)


@query("SELECT id, brand, address FROM (SELECT *, row_number() OVER (PARTITION BY brand, address ORDER BY confidence DESC, id DESC) AS n FROM places) WHERE n = 1", ("places",))
def sync_first_wins(v):
    return snapshots.first_per_key(v("places"), ["brand", "address"], [F.desc_nulls_last("confidence"), F.desc("id")]).select("id", "brand", "address")


@query("SELECT id, CASE WHEN f <> id THEN f END AS duplicate_of FROM (SELECT id, min(id) OVER (PARTITION BY lower(trim(address))) AS f FROM places)", ("places",))
def mark_later(v):
    return snapshots.mark_later(v("places"), F.lower(F.trim("address")), ["ord", "id"]).select("id", "duplicate_of")


@query("SELECT id, pos, query, score, house_match, score = m AND pos = p AS selected FROM (SELECT *, min(CASE WHEN score = m THEN pos END) OVER (PARTITION BY id) AS p FROM (SELECT *, max(score) OVER (PARTITION BY id) AS m FROM (SELECT a.* FROM attempts a LEFT JOIN (SELECT id, min(pos) AS s FROM attempts WHERE score >= 90 AND house_match GROUP BY id) f ON f.id = a.id WHERE f.s IS NULL OR a.pos <= f.s)))", ("attempts",))
def attempt_early_exit(v):
    return geocoding.attempts_until_sure(v("attempts"))


_CANDIDATES = """SELECT name, object_id AS pos, object_id, concat(full_name, CASE object_id % 5 WHEN 0 THEN ', Санкт-Петербург' WHEN 1 THEN ', Ленинградская область' WHEN 2 THEN ', Россия' ELSE '' END, CASE object_id % 3 WHEN 0 THEN concat(', ', cast(object_id % 60 + 10 AS string), ' к') ELSE '' END) AS display,
    CASE object_id % 2 WHEN 0 THEN 'opencage' ELSE 'nominatim' END AS provider, cast(object_id % 101 AS double) / 100 AS importance, cast(object_id % 11 AS double) AS confidence, CASE object_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 30 WHEN 2 THEN 26 ELSE 28 END AS place_rank,
    CASE object_id % 7 WHEN 6 THEN NULL WHEN 5 THEN cast(55.75 AS double) ELSE cast(59.93 AS double) + cast(object_id % 7 AS double) / 50 END AS lat, cast(30.33 AS double) + cast(object_id % 9 AS double) / 30 AS lon"""


@query(
    f""", c AS ({_CANDIDATES} FROM streets), r AS (SELECT id, name, house, name || ' ' || house AS query, CASE form WHEN 0 THEN 'Санкт-Петербург' WHEN 1 THEN 'Ленинградская область' WHEN 2 THEN '' END AS hint FROM requests),
m AS (SELECT DISTINCT name, house, query, hint FROM r),
x AS (SELECT m.*, c.* EXCLUDE (name), lower(display) AS d, string_split(query, ' ') AS words, regexp_matches(lower(display), '(^|[\\s,/])' || house || '($|[\\s,/])') AS hm,
  lat BETWEEN 58.30 AND 61.40 AND lon BETWEEN 27.20 AND 35.80 AS inside, 12742000 * asin(sqrt(pow(sin(radians(59.93 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(59.93)) * pow(sin(radians(30.33 - lon) / 2), 2))) AS metres FROM m JOIN c ON c.name = m.name),
y AS (SELECT *, 30 + 4 * len(list_filter(words, lambda w: contains(d, w))) + CASE provider WHEN 'opencage' THEN least(confidence * 6, 45) ELSE least(importance * 40, 35) END
  + CASE WHEN place_rank >= 30 THEN 10 WHEN place_rank <= 26 THEN -20 ELSE 0 END + 12 + CASE WHEN hm THEN 25 ELSE -35 END
  + CASE WHEN coalesce(hint, '') = '' THEN 0 WHEN hint = 'Санкт-Петербург' AND contains(d, 'петербург') THEN 10 WHEN hint = 'Ленинградская область' AND contains(d, 'ленинградская область') THEN 10 WHEN contains(d, 'россия') THEN -5 ELSE 0 END
  + CASE WHEN lat IS NULL THEN 0 WHEN NOT inside THEN -50 ELSE CASE WHEN metres <= 10000 THEN 20 ELSE -20 END + CASE WHEN metres <= 3000 THEN 10 ELSE 0 END END AS raw FROM x),
b AS (SELECT *, greatest(0.0, least(100.0, raw))::double AS score FROM y QUALIFY row_number() OVER (PARTITION BY name, house, query, hint ORDER BY greatest(0.0, least(100.0, raw)) DESC, pos) = 1)
SELECT r.id, object_id, CASE WHEN score < 35 THEN 'not_found' WHEN score >= 80 AND hm THEN 'found' ELSE 'ambiguous' END AS status, round(score, 6) AS score, round(CASE WHEN inside THEN metres END, 3) AS distance_m
FROM r JOIN b ON b.name = r.name AND b.house = r.house AND b.hint IS NOT DISTINCT FROM r.hint""",
    ("requests", "streets"),
)
def candidate_best(v):
    hint = F.when(F.col("form") == 0, "Санкт-Петербург").when(F.col("form") == 1, "Ленинградская область").when(F.col("form") == 2, "")
    r = v("requests").select("id", "name", F.col("name").alias("street"), "house", F.concat_ws(" ", "name", "house").alias("query"), hint.alias("region_hint"))
    r = r.withColumns({k: F.lit(x) for k, x in {"area_lat": 59.93, "area_lon": 30.33, "area_km": 10.0}.items()})
    s = v("streets")
    c = s.sparkSession.sql(f"{_CANDIDATES} FROM {{streets}}", streets=s)
    out = geocoding.best_for_requests(r, c, ["name"])
    return out.select("id", "object_id", "status", F.round("score", 6).alias("score"), F.round("distance_m", 3).alias("distance_m"))


@query("SELECT query_id, pos, name, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lat, lon, lower(trim(name)) ORDER BY pos) AS n FROM items) WHERE n = 1", ("items",))
def suggest_dedupe(v):
    return suggestions.dedupe(v("items")).select("query_id", "pos", "name", "lat", "lon")


@query(
    """SELECT query_id, pos, cast(place AS int) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT ends_with(query, ' 12') AND is_street AND (starts_with(name, query) OR contains(name, ' ' || query)) THEN 0 ELSE 1 END, source <> 'database', confidence DESC, pos) AS place FROM items) WHERE place <= 10""",
    ("items",),
)
def suggest_rank(v):
    return suggestions.rank(v("items")).select("query_id", "pos", "place")


@query("SELECT query_id, pos, name, key FROM (SELECT *, array_to_string(list_sort(list_distinct(string_split(name, ' '))), ' ') AS key FROM items) QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY confidence DESC, pos) = 1", ("items",))
def street_completion(v):
    return suggestions.complete_streets(v("items")).select("query_id", "pos", "name", "key")


@query(
    """SELECT job, points, CASE WHEN cells <> points * points THEN 'shape' WHEN missing > 0 THEN 'missing' WHEN endless > 0 THEN 'not finite' WHEN negative > 0 THEN 'negative' WHEN diagonal > 0 THEN 'diagonal' END AS error
FROM (SELECT job, max(greatest(i, j)) + 1 AS points, count(*) AS cells, count(*) FILTER (cost IS NULL) AS missing, count(*) FILTER (isinf(cost) OR isnan(cost)) AS endless, count(*) FILTER (cost < 0) AS negative, count(*) FILTER (i = j AND cost > 1) AS diagonal FROM broken GROUP BY job)""",
    ("broken",),
)
def matrix_validate(v):
    return routes.check_matrix(v("broken"))


# the cells of the view matrix that an order asks for, by their formula: all of them are a job's points squared
@query("SELECT a.job, cast(a.ord AS int) AS from_order, cast(b.ord AS int) AS to_order, CASE WHEN a.stop = b.stop THEN 0 ELSE (a.job * 31 + a.stop * 17 + b.stop * 29) % 97 + 1 END::double AS cost FROM order_ a JOIN order_ b ON a.job = b.job AND b.ord = a.ord + 1", ("order_",))
def route_legs(v):
    return routes.legs(v("order_"), v("matrix")).select("job", "from_order", "to_order", "cost")


@query("SELECT a.job, sum(m.cost) AS cost FROM order_ a JOIN order_ b ON a.job = b.job AND b.ord = a.ord + 1 JOIN matrix m ON m.job = a.job AND m.i = a.stop AND m.j = b.stop GROUP BY a.job", ("order_", "matrix"))
def path_cost(v):
    return routes.path_cost(v("order_"), v("matrix"))


_NEAREST = """WITH RECURSIVE m AS (SELECT *, max(i) OVER (PARTITION BY job) AS last FROM matrix), w AS (
  SELECT DISTINCT job, 0 AS ord, 0 AS stop, [0] AS seen, last FROM m
  UNION ALL SELECT w.job, w.ord + 1, arg_min(m.j, m.cost * 1000 + m.j), list_append(w.seen, arg_min(m.j, m.cost * 1000 + m.j)), w.last FROM w JOIN m ON m.job = w.job AND m.i = w.stop AND m.j < w.last AND NOT list_contains(w.seen, m.j) GROUP BY w.job, w.ord, w.seen, w.last)
SELECT job, cast(ord AS int) AS ord, cast(stop AS int) AS stop FROM w UNION ALL SELECT DISTINCT job, cast(last AS int), cast(last AS int) FROM m"""


@query(_NEAREST, ("matrix",))
def nearest_stops(v):
    return routes.order_stops(v("matrix"), improve=False)


@query()
def two_opt(v):
    m = v("matrix")
    return routes.path_cost(routes.order_stops(m), m)


@query()
def cheapest_insertion(v):
    n = F.row_number().over(Window.partitionBy("brand", "block").orderBy("id"))
    p = v("places").withColumn("block", F.floor(F.col("id") / 200)).select(F.concat_ws("-", "brand", "block").alias("job"), (n - 1).cast("int").alias("stop"), "lat", "lon")
    return routes.order_by_insertion(p)


_FIXED = """, g AS (SELECT job, ord, type, CASE type WHEN 'start' THEN 0 WHEN 'waypoint' THEN (ord - 1) // 15 ELSE greatest(0, (max(ord) OVER (PARTITION BY job) - 2) // 15) END AS b, district FROM points),
lasts AS (SELECT job, b, max(ord) AS ord FROM g WHERE type = 'waypoint' GROUP BY job, b QUALIFY b < max(b) OVER (PARTITION BY job)),
rows_ AS (SELECT job, b + 1 AS batch, ord, district, false AS is_transition FROM g UNION ALL SELECT l.job, l.b + 2, l.ord, p.district, true FROM lasts l JOIN points p ON p.job = l.job AND p.ord = l.ord)"""


@query(f"{_FIXED} SELECT job, cast(batch AS int) AS batch, cast(row_number() OVER (PARTITION BY job, batch ORDER BY ord) - 1 AS int) AS place, ord, district, is_transition FROM rows_", ("points",))
def batch_fixed(v):
    return routes.batches(v("points"), by_district=False)


@query(f"{_FIXED}, d AS (SELECT job, batch, district, min(ord) AS o FROM rows_ WHERE NOT is_transition AND district IS NOT NULL GROUP BY job, batch, district), e AS (SELECT job, batch, string_agg(district, ',' ORDER BY o) AS districts, count(*) AS n, min(district) AS one FROM d GROUP BY job, batch), l AS (SELECT job, batch, round_even(sum(((job + ord * 37) % 1000) / 8.0), 2) AS cost FROM (SELECT *, lead(ord) OVER (PARTITION BY job, batch ORDER BY ord) AS nxt FROM rows_) WHERE nxt IS NOT NULL GROUP BY job, batch) SELECT r.job, cast(r.batch AS int) AS batch, count(*) AS points, coalesce(any_value(districts), '') AS districts, CASE WHEN any_value(n) = 1 THEN any_value(one) END AS district, any_value(cost) AS cost FROM rows_ r LEFT JOIN e ON e.job = r.job AND e.batch = r.batch LEFT JOIN l ON l.job = r.job AND l.batch = r.batch GROUP BY r.job, r.batch", ("points",))
def batch_totals(v):
    p = v("points")
    legs = p.filter("type <> 'end'").select("job", F.col("ord").alias("from_order"), (F.col("ord") + 1).alias("to_order"), (((F.col("job") + F.col("ord") * 37) % 1000) / 8.0).alias("cost"))
    out = routes.batch_totals(routes.batches(p, by_district=False), legs)
    return out.select("job", "batch", "points", F.array_join("districts", ",").alias("districts"), "district", "cost")


@query(
    """WITH RECURSIVE w AS (SELECT job, ord, 0 AS g, 1 AS n, district AS d FROM stops WHERE ord = 1
  UNION ALL SELECT job, o, CASE WHEN new THEN g + 1 ELSE g END, CASE WHEN new THEN 1 ELSE n + 1 END, CASE WHEN new THEN e ELSE coalesce(d, e) END FROM (SELECT w.*, s.ord AS o, s.district AS e, w.n >= 15 OR (w.d IS NOT NULL AND s.district IS NOT NULL AND w.d <> s.district) AS new FROM w JOIN stops s ON s.job = w.job AND s.ord = w.ord + 1)),
g AS (SELECT w.job, w.ord, w.g, s.district FROM w JOIN stops s ON s.job = w.job AND s.ord = w.ord), m AS (SELECT job, max(g) AS last, max(ord) AS n FROM g GROUP BY job),
r AS (SELECT job, g + 1 AS batch, ord, district, false AS is_transition FROM g UNION ALL SELECT job, 1, 0, NULL, false FROM m UNION ALL SELECT job, last + 1, n + 1, NULL, false FROM m
  UNION ALL SELECT g.job, g.g + 2, g.ord, g.district, true FROM g JOIN m ON m.job = g.job AND g.g < m.last QUALIFY row_number() OVER (PARTITION BY g.job, g.g ORDER BY g.ord DESC) = 1)
SELECT job, cast(batch AS int) AS batch, cast(row_number() OVER (PARTITION BY job, batch ORDER BY ord) - 1 AS int) AS place, cast(ord AS int) AS ord, district, is_transition FROM r""",
    ("stops",),
)
def batch_district(v):
    return routes.batches(v("stops").unionByName(v("points").filter("type <> 'waypoint'")))


@query(
    f"""{_FIXED}, c AS (SELECT *, 59 + ((job * 13 + ord * 7) % 1000)::double / 1000 AS lat, 30 + ((job * 3 + ord * 11) % 997)::double / 1000 AS lon FROM rows_ WHERE NOT (is_transition AND job % 3 = 0)),
n AS (SELECT job, cast(batch AS int) AS batch, count(*) AS n, max(CASE WHEN is_transition THEN 1 ELSE 0 END) AS held, 'https://example.org/def/?ll=' || printf('%.6f%%2C%.6f', round(avg(lon), 9), round(avg(lat), 9)) || '&mode=routes&rtext=' || string_agg(printf('%.6f%%2C%.6f', lat, lon), '~' ORDER BY ord) || '&rtn=1&rtt=auto' AS url FROM c GROUP BY job, batch)
SELECT job, batch, url, concat_ws(';', CASE WHEN n > 12 THEN 'Batch contains many points' END, CASE WHEN batch > 1 AND held = 0 THEN 'Transition point is missing' END, 'City slug was not provided, default value used', CASE WHEN length(url) > 400 THEN 'URL length exceeds recommended limit' END) AS warnings FROM n""",
    ("points",),
)
def route_links(v):
    rows = routes.batches(v("points"), by_district=False).filter("NOT (is_transition AND job % 3 = 0)")
    rows = rows.withColumns({"lat": 59.0 + ((F.col("job") * 13 + F.col("ord") * 7) % 1000) / 1000.0, "lon": 30.0 + ((F.col("job") * 3 + F.col("ord") * 11) % 997) / 1000.0})
    return routes.links(rows, "https://example.org", default_slug="def", most_points=12, longest=400).select("job", "batch", "url", F.array_join("warnings", ";").alias("warnings"))


@query("SELECT job, CASE WHEN sum(CASE WHEN status = 'provider_error' THEN 1 ELSE 0 END) > 0 THEN 'GEOCODING_PROVIDER_ERROR' WHEN sum(CASE WHEN status = 'not_found' THEN 1 ELSE 0 END) > 0 THEN 'ADDRESS_NOT_FOUND' WHEN sum(CASE WHEN status = 'ambiguous' THEN 1 ELSE 0 END) > 0 THEN 'ADDRESS_AMBIGUOUS' END AS code, count(CASE WHEN status <> 'found' THEN 1 END) AS failed FROM (SELECT id AS job, CASE WHEN score < 5 THEN 'provider_error' WHEN score < 20 THEN 'not_found' WHEN score < 50 THEN 'ambiguous' ELSE 'found' END AS status FROM attempts) GROUP BY job", ("attempts",))
def failed_codes(v):
    s = F.col("score")
    return geocoding.failures(v("attempts").select(F.col("id").alias("job"), F.when(s < 5, "provider_error").when(s < 20, "not_found").when(s < 50, "ambiguous").otherwise("found").alias("status")))


@query("SELECT image, cast(block AS int) AS block, par, line, string_agg(text, ' ' ORDER BY pos) AS text, round(avg(CASE WHEN confidence >= 0 THEN confidence END), 4) AS confidence FROM words GROUP BY image, block, par, line", ("words",))
def ocr_lines(v):
    return sheets.lines_of(v("words"))


@query()
def sheet_fuzzy_dedupe(v):
    rows = v("requests").select(F.floor(F.col("id") / 50).alias("image"), F.col("id").alias("pos"), F.col("raw").alias("address"), F.lit(0.7).alias("confidence"))
    return sheets.drop_fuzzy_repeats(rows)


@query("SELECT grp, island, cast(round_even(avg(v), 0) AS bigint) AS centre, count(*) AS n FROM (SELECT grp, v, sum(s) OVER (PARTITION BY grp ORDER BY v) AS island FROM (SELECT grp, v, CASE WHEN v - lag(v) OVER (PARTITION BY grp ORDER BY v) > 3 THEN 1 ELSE 0 END AS s FROM marks)) GROUP BY grp, island", ("marks",))
def grid_islands(v):
    return sheets.islands(v("marks"), 3)


@query(
    """WITH RECURSIVE r AS (SELECT grp, v, row_number() OVER (PARTITION BY grp ORDER BY v) AS n FROM marks), w AS (SELECT grp, n, [v] AS lines FROM r WHERE n = 1
  UNION ALL SELECT w.grp, r.n, CASE WHEN r.v - w.lines[-1] < 4 THEN list_append(w.lines[:-2], (w.lines[-1] + r.v) // 2) ELSE list_append(w.lines, r.v) END FROM w JOIN r ON r.grp = w.grp AND r.n = w.n + 1)
SELECT grp, array_to_string(lines, ',') AS lines FROM w QUALIFY n = max(n) OVER (PARTITION BY grp)""",
    ("marks",),
)
def grid_merge(v):
    return sheets.merged_lines(v("marks"), 4).select("grp", F.array_join("lines", ",").alias("lines"))


@query("SELECT grp, cast(dense_rank() OVER (PARTITION BY grp ORDER BY y) - 1 AS int) AS row, cast(dense_rank() OVER (PARTITION BY grp ORDER BY x) - 1 AS int) AS col, x, y, width, height FROM (SELECT b.grp, a.v AS x, a.s AS width, b.v AS y, b.s AS height FROM (SELECT grp, v, lead(v) OVER (PARTITION BY grp ORDER BY v) - v AS s FROM m) a JOIN (SELECT grp, v, lead(v) OVER (PARTITION BY grp ORDER BY v) - v AS s FROM m) b ON a.grp = b.grp WHERE a.s >= 40 AND b.s >= 30)".replace("FROM m)", "FROM (SELECT DISTINCT grp, (v // 50) * 50 AS v FROM marks))"), ("marks",))
def grid_cells(v):
    m = v("marks").select("grp", (F.floor(F.col("v") / 50) * 50).alias("v")).distinct()
    return sheets.grid_cells(m, m, 40, 30)


@query("SELECT 'status' AS field, coalesce(status, 'None') AS value, count(*) AS n FROM calls GROUP BY 2 UNION ALL SELECT 'provider', coalesce(provider, 'None'), count(*) FROM calls GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'None'), count(*) FROM calls GROUP BY 2", ("calls",))
def call_histograms(v):
    return metrics.histograms(v("calls"), ["status", "provider", "source"])


@query("SELECT status, count(latency) AS n, min(latency) AS least, round(avg(latency), 6) AS mean, max(latency) AS greatest, max(CASE WHEN r = round_even(0.5 * (c - 1), 0) THEN latency END) AS p50, max(CASE WHEN r = round_even(0.95 * (c - 1), 0) THEN latency END) AS p95, max(CASE WHEN r = round_even(0.99 * (c - 1), 0) THEN latency END) AS p99 FROM (SELECT status, latency, row_number() OVER (PARTITION BY status ORDER BY latency) - 1 AS r, count(*) OVER (PARTITION BY status) AS c FROM calls WHERE latency IS NOT NULL) GROUP BY status", ("calls",))
def call_latency(v):
    return metrics.latency(v("calls"), ["status"]).withColumn("mean", F.round("mean", 6))


@query("SELECT id, round(least(0.45 * confidence + 0.55 * CASE WHEN filled > 1 THEN filled / 100.0 ELSE filled END, 0.99), 4) AS c FROM places", ("places",))
def combined_confidence(v):
    return v("places").select("id", scalars.combined_confidence(F.col("confidence"), F.col("filled").cast("double")).alias("c"))


@query("SELECT s.object_id, s.full_name, coalesce(CASE WHEN s.object_id % 4 > 0 THEN s.region_code END, h.region_code) AS region_code, h.path FROM streets s LEFT JOIN (SELECT s_suppkey AS object_id, CASE s_suppkey % 3 WHEN 0 THEN NULL ELSE '01' END AS region_code, s_name AS path FROM supplier) h ON h.object_id = s.object_id", ("streets",))
def hierarchy_join(v):
    h = v("queries").select(F.col("query_id").alias("object_id"), F.lit(None).cast("long").alias("parent_object_id"), F.when(F.col("query_id") % 3 != 0, "01").alias("region_code"), F.col("text").alias("path"))
    own = F.when(F.col("object_id") % 4 > 0, F.col("region_code"))
    s = v("streets").withColumns({"parent_object_id": F.lit(None).cast("long"), "path": F.lit(None).cast("string"), "region_code": own})
    return register.object_rows(s, h).select("object_id", "full_name", "region_code", "path")


@query("SELECT id, cast(CASE WHEN id % 2 = 0 AND id % 3 > 0 AND id % 5 > 0 THEN 0.95 WHEN id % 2 = 0 AND id % 3 > 0 THEN 0.75 WHEN id % 2 = 0 OR id % 5 > 0 THEN 0.65 ELSE 0 END AS double) AS c, (CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 3 > 0 THEN 1 ELSE 0 END) AS filled FROM places", ("places",))
def completeness(v):
    i = F.col("id")
    street, house, city = F.when(i % 2 == 0, F.lit("s")), F.when(i % 3 > 0, F.lit("1")), F.when(i % 5 > 0, F.lit("c"))
    return v("places").select("id", places.reverse_confidence(city, street, house).alias("c"), places.completeness(street, house).alias("filled"))
