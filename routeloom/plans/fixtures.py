"""Views that derive the engine's inputs from the tables at hand, in SQL that Spark and other engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

#: Views by name; {table} stands for a table, [view] for another view.
VIEWS = {
    "places": """SELECT c_custkey AS id, c_custkey AS ord, c_mktsegment AS brand, c_name AS name, concat('street ', cast(c_custkey % 40 AS string), ', ', cast(c_custkey % 7 AS string)) AS address,
        cast(59.9 AS double) + cast((c_custkey * 37) % 300 AS double) / 10000 AS lat, cast(30.3 AS double) + cast((c_custkey * 53) % 300 AS double) / 10000 AS lon,
        cast(c_custkey % 100 AS double) / 100 AS confidence, cast(c_custkey % 9 AS int) AS filled, cast(c_custkey % 2 AS int) AS kind FROM {customer}""",
    "near_places": """SELECT id, ord, brand, name, CASE WHEN id % 3 = 0 THEN concat('q', cast(id % 97 AS string), 'z') ELSE address END AS address, lat, lon, confidence, filled, kind FROM [places]""",
    "queries": """SELECT s_suppkey AS query_id, s_name AS text, cast(59.9 AS double) + cast((s_suppkey * 41) % 300 AS double) / 10000 AS lat, cast(30.3 AS double) + cast((s_suppkey * 59) % 300 AS double) / 10000 AS lon FROM {supplier}""",
    "streets": """SELECT p_partkey AS object_id, p_name AS name, concat(lower(p_type), ' ', p_name) AS full_name, CASE p_size % 2 WHEN 0 THEN '78' ELSE '47' END AS region_code FROM {part}""",
    "houses": """SELECT l_partkey AS parent_object_id, l_orderkey * 10 + l_linenumber AS house_id, cast(l_linenumber * 10 + l_suppkey % 10 AS string) AS house_number,
        nullif(cast(l_suppkey % 4 AS string), '0') AS building_number, cast(NULL AS string) AS structure_number FROM {lineitem}""",
    "requests": """SELECT o_orderkey AS id, p_name AS name, cast(o_orderkey % 6 AS int) AS form, cast(o_custkey % 60 + 10 AS string) AS house, nullif(cast(o_orderkey % 4 AS string), '0') AS corpus,
        CASE o_orderkey % 6
          WHEN 0 THEN concat('СПб, ул. ', p_name, ' д. ', cast(o_custkey % 60 + 10 AS string), coalesce(concat(' к. ', nullif(cast(o_orderkey % 4 AS string), '0')), ''))
          WHEN 1 THEN concat('Гатчина, ', upper(p_name), ' пр-т, ', cast(o_custkey % 60 + 10 AS string), coalesce(concat('к', nullif(cast(o_orderkey % 4 AS string), '0')), ''))
          WHEN 2 THEN concat('ул ', p_name, '  ', cast(o_custkey % 60 + 10 AS string))
          WHEN 3 THEN concat('наб. ', p_name, ' | дом ', cast(o_custkey % 60 + 10 AS string))
          WHEN 4 THEN concat('Мурино; ш. ', p_name, ' д ', cast(o_custkey % 60 + 10 AS string))
          ELSE concat('бул. ', p_name) END AS raw
        FROM {orders} JOIN {part} ON p_partkey = o_orderkey % 200""",
    "stops": """SELECT l_partkey AS job, cast(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount) AS int) AS ord, 'waypoint' AS type,
        CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat('d', cast(l_linenumber % 3 AS string)) END AS district FROM {lineitem}""",
    "points": """SELECT job, ord, type, CASE WHEN ord % 5 < 3 THEN concat('d', cast(job % 3 AS string)) END AS district FROM [stops]
        UNION ALL SELECT job, cast(0 AS int), 'start', cast(NULL AS string) FROM [stops] GROUP BY job
        UNION ALL SELECT job, cast(max(ord) + 1 AS int), 'end', cast(NULL AS string) FROM [stops] GROUP BY job""",
    "job_points": """SELECT l_orderkey AS job, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS int) AS ord FROM {lineitem}
        UNION ALL SELECT l_orderkey, cast(0 AS int) FROM {lineitem} GROUP BY l_orderkey
        UNION ALL SELECT l_orderkey, cast(count(*) + 1 AS int) FROM {lineitem} GROUP BY l_orderkey""",
    "matrix": """SELECT a.job, a.ord AS i, b.ord AS j, CASE WHEN a.ord = b.ord THEN cast(0 AS double) ELSE cast((a.job * 31 + a.ord * 17 + b.ord * 29) % 97 + 1 AS double) END AS cost
        FROM [job_points] a JOIN [job_points] b ON a.job = b.job""",
    "distances": "SELECT job, i, j, cost * 10 + CASE WHEN i = j THEN 0 ELSE (i * 7 + j) % 13 END AS cost FROM [matrix]",
    "broken": """SELECT job, i, j, CASE WHEN job % 8 = 1 AND i = 1 AND j = 0 THEN NULL WHEN job % 8 = 2 AND i = 0 AND j = 1 THEN cast('Infinity' AS double) WHEN job % 8 = 3 AND i = 1 AND j = 0 THEN -cost - 1
        WHEN job % 8 = 4 AND i = j AND i = 1 THEN cast(1.5 AS double) WHEN job % 8 = 5 AND i = 1 AND j = 1 THEN cast('NaN' AS double) ELSE cost END AS cost FROM [matrix] WHERE NOT (job % 8 = 6 AND i = 1 AND j = 1)""",
    "order_": "SELECT job, ord, CASE WHEN ord = 0 OR ord = last THEN ord ELSE last - ord END AS stop FROM (SELECT job, ord, max(ord) OVER (PARTITION BY job) AS last FROM [job_points]) t",
    # words of letters that are told apart by hashes, so that different streets are never alike
    "cache": """SELECT address_id, k, h, form, w1, w2, concat('санкт-петербург, улица ', street, ' дом ', house) AS normalized_address, concat('СПб, ул. ', street, ' д. ', house) AS original_address,
        CASE WHEN address_id % 3 = 0 THEN NULL ELSE concat('улица ', street, ', ', house, ', Санкт-Петербург') END AS display_name, CASE address_id % 7 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'not_found' ELSE 'found' END AS status,
        CASE WHEN address_id % 11 = 0 THEN NULL ELSE cast(59.9 AS double) + cast(address_id % 400 AS double) / 4000 END AS lat, cast(30.3 AS double) + cast(address_id % 300 AS double) / 3000 AS lon,
        CASE address_id % 5 WHEN 0 THEN 'known_poi' ELSE 'nominatim' END AS provider, cast(address_id % 13 AS double) AS confidence, cast(address_id % 17 AS bigint) AS updated_at, cast(address_id % 19 AS bigint) AS last_used_at
        FROM (SELECT *, concat(w1, CASE form WHEN 2 THEN '' WHEN 3 THEN concat(' ', w2, 'ок') ELSE concat(' ', w2) END) AS street, concat(cast(h AS string), CASE form WHEN 1 THEN 'а' ELSE '' END) AS house FROM
          (SELECT c_custkey AS address_id, c_custkey % 211 AS k, c_custkey % 7 + 10 AS h, cast(c_custkey % 4 AS int) AS form, substr(translate(md5(cast(c_custkey % 211 AS string)), '0123456789', 'ghijklmnop'), 1, 12) AS w1,
             substr(translate(md5(cast(c_custkey % 211 + 1000 AS string)), '0123456789', 'ghijklmnop'), 1, 8) AS w2 FROM {customer}) t) u""",
    "asks": """SELECT id, k, h, letter, w1, w2, concat('улица ', w1, ' ', w2) AS street, concat(cast(h AS string), letter) AS house, concat('ул. ', w1, ' ', w2, ' д. ', cast(h AS string), letter) AS raw FROM
        (SELECT o_orderkey AS id, o_orderkey % 211 AS k, o_orderkey % 7 + 10 AS h, CASE o_orderkey % 5 WHEN 0 THEN 'б' ELSE '' END AS letter, substr(translate(md5(cast(o_orderkey % 211 AS string)), '0123456789', 'ghijklmnop'), 1, 12) AS w1,
        substr(translate(md5(cast(o_orderkey % 211 + 1000 AS string)), '0123456789', 'ghijklmnop'), 1, 8) AS w2 FROM {orders}) t""",
    "areas": """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'СПб' WHEN 2 THEN 'Мурино, дом' WHEN 3 THEN 'посёлок  Шушары.' WHEN 4 THEN 'где-то' WHEN 5 THEN 'Красное Село' ELSE NULL END AS area,
        CASE c_custkey % 3 WHEN 0 THEN 'spb_lenobl' WHEN 1 THEN 'district' ELSE NULL END AS type, CASE c_custkey % 5 WHEN 0 THEN 'Гатчина' WHEN 1 THEN '' ELSE 'точка' END AS label,
        CASE WHEN c_custkey % 2 = 0 THEN cast(60.0 AS double) END AS latitude, cast(30.1 AS double) AS longitude, cast(c_custkey % 4 AS double) AS radius_km, CASE c_custkey % 6 WHEN 0 THEN 'form' END AS source, c_custkey % 7 = 0 AS bounded,
        cast(59.7 AS double) + cast(c_custkey % 500 AS double) / 1000 AS lat, cast(30.0 AS double) + cast(c_custkey % 900 AS double) / 1000 AS lon FROM {customer}""",
    "found_json": """SELECT o_custkey AS query_id, o_orderkey AS pos, concat(p_name, ' ', cast(o_orderkey % 40 AS string), ', Санкт-Петербург, Россия') AS display, cast(o_orderkey % 83 AS double) / 100 AS importance,
        CASE o_orderkey % 4 WHEN 0 THEN 30 WHEN 1 THEN 26 WHEN 2 THEN 28 END AS place_rank, CASE o_orderkey % 9 WHEN 0 THEN cast(55.7 AS double) ELSE cast(59.93 AS double) END AS lat, cast(30.33 AS double) + cast(o_orderkey % 50 AS double) / 1000 AS lon,
        concat(chr(123), '"osm_type":"way",', CASE o_orderkey % 3 WHEN 0 THEN concat('"osm_id":', cast(o_orderkey AS string), ',') ELSE '' END, '"place_id":', cast(o_orderkey % 1000 AS string), ',"class":"highway","address":', chr(123), CASE o_orderkey % 5 WHEN 0 THEN '' ELSE concat('"road":"', p_name, '",') END,
        CASE o_orderkey % 2 WHEN 0 THEN concat('"house_number":"', cast(o_orderkey % 40 AS string), '",') ELSE '' END, CASE o_orderkey % 7 WHEN 0 THEN '"shop":"Магазин",' ELSE '' END, '"suburb":"Центр","city":"Санкт-Петербург","postcode":"19', cast(o_orderkey % 90 + 10 AS string), '","country":"Россия"', chr(125), chr(125)) AS raw
        FROM {orders} JOIN {part} ON p_partkey = o_orderkey % 200""",
    "reports": """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'x' WHEN 1 THEN '' ELSE replace(cast(cast(59.9 AS double) + cast(o_custkey % 50 AS double) / 500 AS string), '.', ',') END AS latitude, cast(cast(30.25 AS double) + cast(o_custkey % 40 AS double) / 160 AS string) AS longitude, o_custkey % 50 AS a, o_custkey % 40 AS b,
        CASE o_orderkey % 4 WHEN 0 THEN ' улица ' WHEN 1 THEN ' ' END AS address, CASE o_orderkey % 3 WHEN 0 THEN 'ADDRESS_MISSING; X' WHEN 1 THEN 'REVERSE_GEOCODED' END AS warnings FROM {orders}""",
    "imported": """SELECT o_orderkey AS id, o_custkey AS import_id, o_orderkey % 3 AS image, o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'Магнит' END AS store, CASE o_orderkey % 9 WHEN 0 THEN ' ' ELSE concat('улица ', p_name) END AS address, CASE o_orderkey % 10 WHEN 0 THEN 'улица Новая' END AS corrected,
        CASE o_orderkey % 6 WHEN 0 THEN NULL ELSE cast(o_orderkey % 101 AS double) / 100 END AS confidence, CASE o_orderkey % 8 WHEN 0 THEN 'rejected' WHEN 1 THEN 'duplicate' ELSE 'parsed' END AS status, CASE o_orderkey % 5 WHEN 0 THEN 'not_found' WHEN 1 THEN 'error' WHEN 2 THEN 'pending' ELSE 'found' END AS geocoding_status,
        CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE o_orderkey % 100 END AS address_id, cast(NULL AS string) AS normalized_address, CASE o_orderkey % 5 WHEN 1 THEN 'e' END AS error FROM {orders} JOIN {part} ON p_partkey = o_orderkey % 200""",
    "job_rows": """SELECT job, ord AS original_index, CASE WHEN ord = 0 THEN 'start' WHEN ord = last THEN 'end' ELSE 'waypoint' END AS role, concat('улица ', cast((job * 7 + ord) % 50 AS string)) AS address, job * 100 + ord AS id, CASE WHEN job % 5 = 4 AND ord % 3 = 1 THEN NULL ELSE cast(59.8 AS double) + cast((job * 3 + ord * 17) % 300 AS double) / 1000 END AS lat,
        cast(30.1 AS double) + cast((job * 11 + ord * 5) % 500 AS double) / 1000 AS lon, CASE WHEN job % 7 = 1 AND ord = last THEN 'ambiguous' WHEN job % 7 = 2 AND ord = 0 THEN 'error' WHEN job % 7 = 3 AND ord = 1 THEN 'not_found' WHEN job % 7 = 4 AND ord = last THEN 'not_found' WHEN job % 7 = 5 AND ord = 0 THEN 'not_found' WHEN ord % 4 = 3 THEN 'manual' ELSE 'found' END AS status,
        CASE WHEN job % 3 = 0 THEN 'away' END AS error, 'x' AS display_name FROM (SELECT job, ord, max(ord) OVER (PARTITION BY job) AS last FROM [job_points]) t""",
    "old_rows": "SELECT c_custkey AS id, c_name AS name, c_acctbal AS score, CASE c_custkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN cast(NULL AS string) ELSE 'auto' END AS provider, true AS is_active FROM {customer} WHERE c_nationkey < 18",
    "new_rows": "SELECT c_custkey AS id, concat(c_name, '*') AS name, c_acctbal + 1 AS score, CASE c_custkey % 2 WHEN 0 THEN 'auto' ELSE cast(NULL AS string) END AS provider, true AS is_active FROM {customer} WHERE c_nationkey >= 8",
    "attempts": "SELECT o_custkey AS id, o_orderkey AS pos, o_orderstatus AS query, cast(o_orderkey % 100 AS double) AS score, o_orderkey % 3 > 0 AS house_match FROM {orders}",
    "items": """SELECT o_custkey AS query_id, concat(substr(p_name, 1, 3), CASE o_orderkey % 5 WHEN 0 THEN ' 12' ELSE '' END) AS query, o_orderkey AS pos, p_name AS name, o_orderkey % 2 = 0 AS is_street,
        CASE o_orderkey % 3 WHEN 0 THEN 'database' ELSE 'remote' END AS source, cast(o_orderkey % 50 AS double) AS confidence, cast(o_orderkey % 4 AS double) AS lat, cast(o_orderkey % 3 AS double) AS lon
        FROM {orders} JOIN {part} ON p_partkey = o_orderkey % 200""",
    "calls": "SELECT event_type AS status, cast(event_id % 3 AS string) AS provider, CASE event_id % 10 WHEN 0 THEN cast(NULL AS string) ELSE cast(event_id % 4 AS string) END AS source, value AS latency FROM {events}",
    "map_nodes": """SELECT p_partkey AS osm_id, CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN cast(95 AS double) ELSE cast(59 AS double) + cast(p_partkey * 37 % 1000 AS double) / 1000 END AS lat, cast(30 AS double) + cast(p_partkey * 53 % 1000 AS double) / 1000 AS lon,
        CASE p_partkey % 5 WHEN 0 THEN p_name END AS shop FROM {part}""",
    "map_refs": "SELECT l_orderkey AS way_id, l_linenumber AS pos, CASE l_partkey % 13 WHEN 0 THEN -1 ELSE l_partkey END AS node FROM {lineitem}",
    "words": "SELECT l_orderkey AS image, l_linenumber % 2 AS block, 0 AS par, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos, concat('w', cast(l_partkey AS string)) AS text, cast(l_suppkey % 12 - 1 AS double) AS confidence FROM {lineitem}",
    "marks": "SELECT DISTINCT l_suppkey AS grp, l_partkey AS v FROM {lineitem}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    named = {v: view(spark, sf_dir, v) for v in re.findall(r"\[(\w+)\]", sql)}
    named |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(re.sub(r"\[(\w+)\]", r"{\1}", sql), **named)


def with_views(*names: str) -> str:
    """The views, and those under them, as a WITH clause that reads plain table names."""
    done: list[str] = []

    def add(name: str) -> None:
        for v in re.findall(r"\[(\w+)\]", VIEWS[name]):
            add(v)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'[\[\]{}]', '', VIEWS[n])})" for n in done)
