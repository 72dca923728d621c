"""Queries of route jobs and imports, and the SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeloom.functions import scalars
from routeloom.functions import text as T
from routeloom.operators import addresses, checks, geocoding, imports, metrics, places, route_jobs, routes
from routeloom.plans.registry import query
from routeloom.sources import responses

@query("SELECT id, round_even((id::decimal(20,6) / 8)::decimal(20,6), 2)::double AS half_even, CASE WHEN m < 1000 THEN floor(m + 0.5)::bigint || ' м' ELSE replace(CASE WHEN m % 500 = 250 THEN printf('%.1f', ceil(m / 100) / 10) ELSE printf('%.1f', m / 1000) END, '.', ',') || ' км' END AS distance, CASE WHEN hh = 0 THEN mm || ' мин' WHEN mm = 0 THEN hh || ' ч' ELSE hh || ' ч ' || mm || ' мин' END AS duration, printf('%.6f', m / 7) AS coordinate FROM (SELECT id, (id * 7 % 5000)::double AS m, (id * 97 % 20000) // 3600 AS hh, floor(((id * 97 % 20000) % 3600) / 60.0 + 0.5)::bigint AS mm FROM attempts_ids)".replace("attempts_ids", "(SELECT pos AS id FROM attempts)"), ("attempts",))
def shown_values(v):
    i = F.col("pos")
    m = ((i * 7) % 5000).cast("double")
    return v("attempts").select(i.alias("id"), scalars.rounded(i / 8.0).alias("half_even"), scalars.shown_distance(m).alias("distance"), scalars.shown_duration(((i * 97) % 20000).cast("double")).alias("duration"), scalars.shown_coordinate(m / 7).alias("coordinate"))


@query("SELECT job, original_index, role, address FROM job_rows", ("job_rows",))
def route_roles(v):
    r = v("job_rows").groupBy("job").agg(F.transform(F.array_sort(F.collect_list(F.struct("original_index", "address"))), lambda x: x["address"]).alias("a"))
    jobs = r.select("job", F.get("a", F.lit(0)).alias("start_address"), F.slice("a", F.lit(2), F.size("a") - 2).alias("addresses"), F.element_at("a", -1).alias("end_address"))
    return route_jobs.prepared(jobs).select("job", "original_index", "role", "address")


_BAD = "SELECT *, CASE WHEN status = 'ambiguous' THEN 'ADDRESS_AMBIGUOUS' WHEN status = 'error' THEN 'ADDRESS_GEOCODER_ERROR' ELSE 'ADDRESS_NOT_FOUND' END AS code FROM job_rows WHERE lat IS NULL OR status NOT IN ('found', 'manual')"


@query(
    f"""SELECT job, original_index, code, coalesce(error, CASE WHEN status = 'ambiguous' THEN 'Address was resolved ambiguously' ELSE 'Address coordinates were not found' END) AS error,
  CASE WHEN status = 'ambiguous' THEN 'Адрес найден неоднозначно. Проверьте область поиска или уточните дом.' WHEN status = 'error' THEN coalesce(error, 'Сбой геокодера. Проверьте настройки провайдера или повторите попытку.') ELSE 'Адрес не найден геокодером.' END AS reason FROM ({_BAD})""",
    ("job_rows",),
)
def route_failures(v):
    return route_jobs.failed(v("job_rows")).select("job", "original_index", "code", "error", "reason")


@query(
    f"""SELECT job, failed, CASE WHEN a THEN 'ADDRESS_REVIEW_REQUIRED' WHEN e THEN 'GEOCODER_ERROR' WHEN s AND NOT n AND NOT w THEN 'START_ADDRESS_NOT_FOUND' WHEN n AND NOT s AND NOT w THEN 'END_ADDRESS_NOT_FOUND' WHEN w AND NOT s AND NOT n THEN 'WAYPOINT_ADDRESS_NOT_FOUND' ELSE 'ADDRESS_NOT_FOUND' END AS code
FROM (SELECT job, count(*) AS failed, bool_or(code = 'ADDRESS_AMBIGUOUS') AS a, bool_or(code = 'ADDRESS_GEOCODER_ERROR') AS e, bool_or(role = 'start') AS s, bool_or(role = 'end') AS n, bool_or(role = 'waypoint') AS w FROM ({_BAD}) GROUP BY job)""",
    ("job_rows",),
)
def route_failure_codes(v):
    return route_jobs.failure_of_jobs(route_jobs.failed(v("job_rows"))).select("job", "failed", "code")


@query(
    """SELECT r.job, r.original_index, CASE WHEN c THEN CASE WHEN r.job % 4 = 0 THEN 'error' ELSE 'found' END WHEN n % 9 = 0 THEN 'not_found' ELSE 'ambiguous' END AS status, CASE WHEN c THEN 'selected' ELSE 'geocoder' END AS source, CASE WHEN c THEN 50.0 WHEN n % 9 = 0 THEN NULL ELSE n::double END AS lat, CASE WHEN NOT c AND n % 9 > 0 THEN 'e' END AS error
FROM (SELECT *, (job + original_index) % 3 = 0 AS c, (job * 7 + original_index) % 50 AS n FROM job_rows) r""",
    ("job_rows",),
)
def route_chosen(v):
    r = v("job_rows")
    chosen = r.filter("(job + original_index) % 3 = 0").select("job", "original_index", F.lit(1).cast("long").alias("id"), F.lit(50.0).alias("lat"), F.lit(30.0).alias("lon"), F.when(F.col("job") % 4 == 0, "error").when(F.col("job") % 4 == 1, "manual").alias("status"), F.lit(9.0).alias("confidence"))
    n = F.regexp_extract("address", r"(\d+)", 1).cast("int")
    found = r.select("address").distinct().filter(n % 9 > 0).select("address", n.cast("long").alias("id"), n.cast("double").alias("lat"), F.lit(30.0).alias("lon"), F.lit("ambiguous").alias("status"), F.lit("x").alias("provider"), F.lit(1.0).alias("confidence"), F.lit("d").alias("display_name"), F.lit("e").alias("error"))
    return route_jobs.with_chosen(r.select("job", "role", "original_index", "address"), chosen, found).select("job", "original_index", "status", "source", "lat", "error")


@query(
    """SELECT coalesce(d.job, m.job) AS job, CASE WHEN d.error IS NOT NULL THEN 'durations: ' || d.error END AS error FROM (SELECT job, CASE WHEN cells <> points * points THEN 'shape' WHEN missing > 0 THEN 'missing' WHEN endless > 0 THEN 'not finite' WHEN negative > 0 THEN 'negative' WHEN diagonal > 0 THEN 'diagonal' END AS error
FROM (SELECT job, max(greatest(i, j)) + 1 AS points, count(*) AS cells, count(*) FILTER (cost IS NULL) AS missing, count(*) FILTER (isinf(cost) OR isnan(cost)) AS endless, count(*) FILTER (cost < 0) AS negative, count(*) FILTER (i = j AND cost > 1) AS diagonal FROM broken GROUP BY job)) d FULL JOIN (SELECT DISTINCT job FROM distances) m ON m.job = d.job""",
    ("broken", "distances"),
)
def matrices_validate(v):
    return route_jobs.both_matrices(v("broken"), v("distances"))


@query("SELECT job, CASE WHEN job % 4 < 3 THEN 'legs do not match ordered_points' END AS error FROM (SELECT DISTINCT job FROM job_points)", ("job_points",))
def legs_validate(v):
    p = v("job_points")
    legs = p.filter("ord > 0").select("job", (F.col("ord") - 1).alias("from_order"), F.col("ord").alias("to_order"))
    wrong = legs.filter("(job % 4 = 0 AND from_order = 0)").unionByName(p.filter("job % 4 = 1 AND ord = 0").select("job", F.col("ord").alias("from_order"), (F.col("ord") + 2).alias("to_order")))
    return route_jobs.legs_match(p, legs.unionByName(wrong).filter("NOT (job % 4 = 2 AND from_order = 0)"))


@query(
    """SELECT job, CASE job % 8 WHEN 0 THEN 'ordered_points contain duplicate order values' WHEN 1 THEN 'ordered_points order values must be sequential' WHEN 2 THEN 'First point must be start' WHEN 3 THEN 'Last point must be end' WHEN 4 THEN 'Start point must not appear in the middle of route' WHEN 5 THEN 'Intermediate points must have type waypoint' WHEN 6 THEN 'ordered_points must contain at least start and end points' END AS error FROM (SELECT DISTINCT job FROM job_points)""",
    ("job_points",),
)
def ordered_points_validate(v):
    p = v("job_rows").select("job", F.col("original_index").alias("ord"), F.col("role").alias("type"))
    j, o = F.col("job") % 8, F.col("ord")
    ord_ = F.when((j == 0) & (o == 1), 0).when((j == 1) & (o > 0), o + 1).otherwise(o)
    kind = F.when((j == 2) & (o == 0), "waypoint").when((j == 3) & (F.col("type") == "end"), "start").when((j == 4) & (o == 1), "start").when((j == 5) & (o == 1), "via").otherwise(F.col("type"))
    return checks.ordered_points(p.filter(~((j == 6) & (o > 0))).select("job", ord_.alias("ord"), kind.alias("type")))


@query("SELECT job, batch, CASE WHEN n < 2 THEN 'batch must contain at least two points' WHEN job % 2 = 0 THEN 'duplicate batch_order values in batch' END AS error FROM (SELECT job, cast(ord % 3 AS int) AS batch, count(*) AS n FROM job_points GROUP BY ALL)", ("job_points",))
def link_points_validate(v):
    p = v("job_points").select("job", (F.col("ord") % 3).cast("int").alias("batch"), F.when(F.col("job") % 2 == 0, 0).otherwise(F.col("ord")).alias("place"))
    return checks.link_batches(p)


@query()
def route_totals(v):
    return route_jobs.optimised(v("matrix"), v("distances"))[1]


@query(
    """, p AS (SELECT *, CASE WHEN lat IS NOT NULL AND status IN ('found', 'manual') THEN 1 ELSE 0 END AS good FROM job_rows), ok AS (SELECT job FROM p GROUP BY job HAVING min(good) = 1)
SELECT p.job, cast(original_index AS int) AS stop, role AS type, round(lat, 6) AS lat FROM p JOIN ok ON ok.job = p.job""",
    ("job_rows",),
)
def route_inputs(v):
    return route_jobs.points(v("job_rows")).select("job", "stop", "type", F.round("lat", 6).alias("lat"))


@query()
def route_answer(v):
    rows = v("job_rows")
    out = route_jobs.answer(rows, v("matrix"), v("distances"), "https://example.org", size=4)
    return out.select("job", "status", "points", "distance_m", "duration_s", F.size("ordered_points").alias("n_points"), F.size("legs").alias("n_legs"), F.size("batches").alias("n_batches"), F.array_join("warnings", ";").alias("warnings"))


@query()
def route_tables(v):
    rows = v("job_rows")
    return route_jobs.tables(route_jobs.answer(rows, v("matrix"), v("distances"), "https://example.org", slug="x", size=4), rows)[2]


_ITEM = "coalesce(corrected, nullif(trim(address), ''))"


@query("SELECT import_id, cast(row_number() OVER (PARTITION BY import_id ORDER BY image, pos) AS int) AS row_number, store, nullif(trim(address), '') AS address, CASE WHEN confidence IS NULL THEN 0.65 ELSE least(0.99, confidence) END AS confidence, 'parsed' AS status, 'pending' AS geocoding_status FROM imported", ("imported",))
def import_items(v):
    return imports.items(v("imported"))


@query(
    f"""SELECT id, state AS geocoding_status, CASE WHEN state = 'found' AND sure >= 0.85 THEN 'recognized' ELSE 'needs_review' END AS status, sure AS confidence, address_id FROM (SELECT id, CASE WHEN t IS NULL THEN 'not_found' WHEN id % 3 = 0 THEN 'error' WHEN id % 3 = 1 THEN 'found' ELSE 'ambiguous' END AS state,
  CASE WHEN t IS NULL OR id % 3 = 0 THEN confidence ELSE round(least(coalesce(confidence, 0) * 0.45 + (id % 101) / 100.0 * 0.55, 0.99), 4) END AS sure, CASE WHEN t IS NOT NULL AND id % 3 > 0 THEN id + 1 END AS address_id FROM (SELECT *, {_ITEM} AS t FROM imported))""",
    ("imported",),
)
def import_geocoded(v):
    i = F.col("id")
    r = v("imported").filter("id % 3 > 0").select("id", (i + 1).alias("address_id"), F.when(i % 3 == 1, "found").otherwise("ambiguous").alias("geocoding_status"), ((i % 101) / 100.0).alias("score"), F.lit("k").alias("normalized_address"), F.lit(None).cast("string").alias("error"))
    return imports.geocoded(v("imported"), r).select("id", "geocoding_status", "status", "confidence", "address_id")


@query(
    """SELECT id, CASE WHEN p THEN coalesce(CASE WHEN id % 4 = 0 THEN 'Лента' END, store) ELSE store END AS store, CASE WHEN a THEN 'ул. Новая 1' ELSE address END AS address, CASE WHEN a THEN 'ул. Новая 1' ELSE corrected END AS corrected, CASE WHEN a THEN 'санкт-петербург, улица новая 1' END AS normalized_address, CASE WHEN p AND id % 6 = 0 THEN 'rejected' ELSE status END AS status,
  CASE WHEN a THEN 'pending' ELSE geocoding_status END AS geocoding_status, CASE WHEN NOT a THEN address_id END AS address_id, CASE WHEN NOT p THEN error END AS error FROM (SELECT *, id % 2 = 0 AS p, id % 10 = 0 AS a FROM imported)""",
    ("imported",),
)
def import_corrected(v):
    i = F.col("id")
    p = v("imported").filter("id % 2 = 0").select("id", F.when(i % 4 == 0, " Лента ").alias("store"), F.when(i % 10 == 0, "ул. Новая 1").otherwise(" ").alias("address"), F.when(i % 6 == 0, "rejected").alias("status"))
    return imports.corrected(v("imported"), p).select("id", "store", "address", "corrected", "normalized_address", "status", "geocoding_status", "address_id", "error")


@query(
    """SELECT id, CASE WHEN status IN ('rejected', 'duplicate') THEN status WHEN geocoding_status = 'found' AND address_id IS NOT NULL THEN 'ready' WHEN geocoding_status IN ('not_found', 'error') THEN 'failed' ELSE 'review' END AS kind,
  CASE WHEN id % 13 = 0 OR status IN ('rejected', 'duplicate') THEN 'excluded' WHEN address_id IS NOT NULL AND geocoding_status = 'found' THEN 'confirmed' ELSE 'problem' END AS decision FROM imported""",
    ("imported",),
)
def import_decided(v):
    r = v("imported")
    return imports.confirm(r.withColumn("kind", imports.kind(F.col("status"), F.col("geocoding_status"), F.col("address_id"))), r.filter("id % 13 <> 0").select("id"), without_problems=False).select("id", "kind", "decision")


_CONFIRMED = "SELECT *, address_id IS NOT NULL AND geocoding_status = 'found' AND status NOT IN ('rejected', 'duplicate') AS good FROM imported"


@query(f"SELECT import_id, CASE WHEN max(CASE WHEN status NOT IN ('rejected', 'duplicate') AND NOT good THEN 1 ELSE 0 END) = 1 THEN 'Some imported records are not geocoded. Fix them or choose to exclude problematic rows.' ELSE 'No confirmed geocoded rows are available for route building.' END AS error FROM ({_CONFIRMED}) GROUP BY import_id HAVING max(CASE WHEN status NOT IN ('rejected', 'duplicate') AND NOT good THEN 1 ELSE 0 END) = 1 OR max(CASE WHEN good THEN 1 ELSE 0 END) = 0", ("imported",))
def import_blocked(v):
    return imports.blocked(imports.confirm(v("imported"), without_problems=False))


@query(f"SELECT import_id, cast(row_number() OVER (PARTITION BY import_id ORDER BY id) AS int) AS pos, coalesce(corrected, address) AS address, CASE WHEN address_id % 4 > 0 THEN address_id::double END AS lat FROM ({_CONFIRMED}) WHERE good", ("imported",))
def import_waypoints(v):
    a = v("places").select("id", F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("lat"), F.lit(30.0).alias("lon"))
    rows = v("imported").withColumn("row_number", F.col("id"))
    return imports.waypoints(imports.confirm(rows), a).select("import_id", "pos", "address", "lat")


@query("SELECT id AS run_id, arg_max(CASE pos % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END, pos) AS status, min(pos) AS started_at, max(CASE WHEN pos % 4 > 1 THEN pos END) AS finished_at, arg_max(CASE WHEN pos % 4 = 3 THEN 'e' || pos END, CASE WHEN pos % 4 = 3 THEN pos END) AS error FROM attempts GROUP BY id", ("attempts",))
def run_log(v):
    p = F.col("pos")
    events = v("attempts").select(F.col("id").alias("run_id"), p.alias("at"), F.element_at(F.array(*map(F.lit, imports.RUN_STATES)), (p % 4 + 1).cast("int")).alias("status"), F.when(p % 4 == 3, F.concat(F.lit("e"), p.cast("string"))).alias("error"), F.lit(None).cast("string").alias("report"))
    return imports.run_log(events).select("run_id", "status", "started_at", "finished_at", "error")


@query("""SELECT id, '{"rows":' || count(*) || ',"sure":' || sum(CASE WHEN house_match THEN 1 ELSE 0 END) || '}' AS report FROM attempts GROUP BY id""", ("attempts",))
def run_report(v):
    return imports.report_json(v("attempts").select("id", F.lit(1).alias("rows"), F.col("house_match").cast("int").alias("sure")), ["id"])


@query("SELECT address_id AS id FROM cache WHERE NOT (provider = 'known_poi' AND address_id % 3 = 0) AND NOT (provider = 'known_poi' AND address_id % 3 = 1 AND address_id % 2 = 0)", ("cache",))
def notes_deleted(v):
    i = F.col("address_id")
    rows = v("cache").select(i.alias("id"), F.when(F.col("provider") == "known_poi", "manual").otherwise("x").alias("provider"), F.when(i % 3 == 0, "a GRID").when((i % 3 == 1) & (i % 2 == 0), "Testing").when(i % 3 == 1, "other").alias("notes"))
    return imports.without_notes(rows).select("id")


@query("SELECT query_id, importance, CASE WHEN abs(importance - second) < 0.02 THEN 'ambiguous' ELSE 'found' END AS status FROM (SELECT query_id, importance, lead(importance) OVER (PARTITION BY query_id ORDER BY pos) AS second, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM found_json) WHERE n = 1", ("found_json",))
def importance_gap(v):
    return geocoding.first_status(v("found_json"), ["query_id"])


@query("SELECT id, 'ул' || w1 || w2 || CASE WHEN letter <> '' THEN house ELSE '' END AS key FROM asks", ("asks",))
def match_keys(v):
    return v("asks").select("id", T.match_key(F.col("raw")).alias("key"))


@query("SELECT job, original_index, concat_ws(' ', address, CASE WHEN ord % 2 = 0 THEN 'Невский' END, CASE WHEN ord % 3 > 0 THEN 'у. ' || job END, display_name) AS said FROM (SELECT *, original_index AS ord FROM job_rows)", ("job_rows",))
def district_texts(v):
    i = F.col("original_index")
    rows = v("job_rows").withColumns({"original_address": F.when(i % 2 == 0, "Невский"), "normalized_address": F.when(i % 3 > 0, F.concat(F.lit("у. "), "job")).otherwise("")})
    return rows.select("job", "original_index", route_jobs.district_text(rows).alias("said"))


@query(
    """SELECT id, '{"source":"known_pois","known_poi_id":' || id || ',"canonical_brand":"' || brand || '","name":"' || name || '","address":' || CASE WHEN id % 4 = 0 THEN 'null' ELSE '"' || address || '"' END || ',"distance_m":' || CASE WHEN id % 5 = 0 THEN 'null' ELSE (id % 9) || '.5' END || ',"match_score":0.' || (id % 9 + 1) || '}' AS raw FROM places""",
    ("places",),
)
def kept_answers(v):
    i = F.col("id")
    p = v("places").withColumns({"address": F.when(i % 4 > 0, F.col("address")), "distance_m": F.when(i % 5 > 0, i % 9 + 0.5), "score": ((i % 9 + 1) / 10.0).cast("double")})
    return p.select("id", addresses.raw_response().alias("raw"))


@query(
    """SELECT id, cast(1 AS int) AS pos, cast(CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END AS int) AS source_row_index, cast(CASE WHEN id % 4 > 0 THEN id % 9 END AS int) AS original_order, CASE WHEN id % 2 = 0 THEN 'Магнит' END AS name, 'ул. Мира, ' || id AS address, CASE WHEN id % 5 = 0 THEN 'строка ' || id ELSE 'ул. Мира, ' || id END AS raw_row_text, CASE WHEN id % 7 > 0 THEN 0.5::double END AS confidence, CASE WHEN id % 6 = 0 THEN 'A,B' ELSE '' END AS warnings FROM areas""",
    ("areas",),
)
def payload_points(v):
    i = F.col("id")
    said = lambda when, text: F.when(when, text).otherwise("")
    own = F.concat(
        F.lit('{"address":" ул. Мира, '), i, F.lit(' "'), said(i % 3 > 0, F.concat(F.lit(',"source_row_index":'), i % 50)), F.lit(',"original_order":'), F.when(i % 4 > 0, F.concat(F.lit('"'), i % 9, F.lit('"'))).otherwise(F.lit('"x"')),
        said(i % 2 == 0, F.lit(',"name":" Магнит"')), said(i % 5 == 0, F.concat(F.lit(',"raw_text":"строка '), i, F.lit('"'))), said(i % 7 > 0, F.lit(',"confidence":0.5')), said(i % 6 == 0, F.lit(',"warnings":["A","B"]')), F.lit("}"),
    )
    raw = v("areas").select("id", F.concat(F.lit('{"route_points":[{"address":" "},'), own, F.lit(',"no object"]}')).alias("response"))
    out = responses.route_points(raw, ["id"])
    return out.withColumn("warnings", F.array_join("warnings", ","))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 500 ELSE 200 END AS http_status, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'error' ELSE 'found' END AS geocoding_status, id % 4 > 0 AND id % 7 > 0 AND coalesce(id % 5 <> 1, true) AS ok, CASE WHEN id % 7 = 0 THEN 'timeout' WHEN id % 5 = 1 THEN 'bad' END AS error FROM areas", ("areas",))
def request_results(v):
    i = F.col("id")
    rows = v("areas").select("id", F.when(i % 4 == 0, 500).otherwise(200).alias("http_status"), F.when(i % 5 == 0, None).when(i % 5 == 1, "error").otherwise("found").alias("geocoding_status"), F.when(i % 7 == 0, "timeout").alias("failure"), F.when(i % 5 == 1, "bad").alias("said_error"))
    return metrics.request_rows(rows)


@query("SELECT id, cast(" + " + ".join(f"CASE WHEN id % {n} > 0 THEN 1 ELSE 0 END" for n in range(2, 11)) + " AS int) AS filled FROM places", ("places",))
def filled_fields(v):
    tags = F.map_from_arrays(F.array(*(F.lit(f"addr:{k}") for k in ("city", "region", "district", "suburb", "street", "housenumber", "postcode", "place", "full"))), F.array(*(F.when(F.col("id") % n > 0, "x").otherwise("") for n in range(2, 11))))
    return v("places").select("id", places.completeness(*places.address_fields(tags).values()).alias("filled"))


@query("SELECT job, CASE WHEN job % 3 = 0 AND n > 1 THEN 'duplicate batch_number values' END AS error FROM (SELECT job, count(*) AS n FROM job_points GROUP BY job)", ("job_points",))
def batch_numbers(v):
    rows = v("job_points").select("job", F.col("ord").alias("pos"), F.when(F.col("job") % 3 == 0, 1).when(F.col("job") % 3 == 1, F.col("ord") + 1).alias("number"))
    return checks.batch_numbers(rows)
