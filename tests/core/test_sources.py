"""Readers and writers on small files, and streams over folders of files."""

import json
import os

from pyspark.sql import functions as F

from routeloom.sources import files, register_xml, responses
from routeloom.streaming import ingest


def test_register_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    put = lambda name, tag, rows: (tmp_path / "a" / name).write_text(f"<?xml version='1.0'?><R>{''.join('<' + tag + ' ' + ' '.join(f'{k}={json.dumps(v, ensure_ascii=False)}' for k, v in r.items()) + '/>' for r in rows)}</R>")
    put("AS_ADM_HIERARCHY_1.XML", "ITEM", [{"OBJECTID": "10", "PARENTOBJID": "1", "REGIONCODE": "78", "PATH": "1.10", "ISACTIVE": "1"}, {"OBJECTID": "20", "PATH": "1.20", "ISACTIVE": "0"}, {"OBJECTID": "x"}, {"OBJECTID": "30", "REGIONCODE": "99"}])
    put("AS_ADM_HIERARCHY_2.xml", "ITEM", [{"OBJECTID": "10", "PARENTOBJID": "2", "REGIONCODE": "78", "PATH": "2.10"}])
    put("AS_ADDR_OBJ.xml", "OBJECT", [{"OBJECTID": "10", "NAME": " Невский ", "TYPENAME": "Пр-кт.", "LEVEL": "8"}, {"OBJECTID": "20", "NAME": "улица Мира", "TYPENAME": "ул", "REGIONCODE": "47"}, {"OBJECTID": "30", "NAME": "X", "REGIONCODE": "99"}, {"OBJECTID": "40", "NAME": ""}])
    put("AS_HOUSES.xml", "HOUSE", [{"OBJECTID": "50", "HOUSENUM": "5", "ADDNUM1": "2", "PARENTOBJID": "10", "ISACTUAL": "0"}, {"OBJECTID": "20", "HOUSEID": "7", "PARENTOBJID": "3"}])
    objects, houses = register_xml.read_register(spark, str(tmp_path), ["78", "47"])
    got = {r.object_id: (r.full_name, r.parent_object_id, r.region_code, r.path, r.is_active, r.object_level) for r in objects.collect()}
    assert got == {10: ("проспект Невский", 2, "78", "2.10", True, 8), 20: ("улица Мира", None, "47", "1.20", False, None)}
    got = {r.house_id: (r.object_id, r.parent_object_id, r.house_number, r.building_number, r.is_actual, r.is_active) for r in houses.collect()}
    assert got == {50: (50, 10, "5", "2", False, True), 7: (20, None, None, None, True, False)}


def test_answers_of_services(spark):
    table = lambda *xs: spark.createDataFrame(list(enumerate(xs)), "id int, response string")
    search = table(json.dumps([{"lat": "59.9", "lon": 30.3, "display_name": "a", "importance": 0.5}, {"lat": "x", "lon": "1"}, {"lat": "1", "lon": "2", "place_rank": 30}]), "[]", None, "{", "[1]")
    got = [(r.id, r.pos, r.lat, r.display, r.place_rank) for r in responses.search_candidates(search, ["id"]).orderBy("id", "pos").collect()]
    assert got == [(0, 0, 59.9, "a", None), (0, 2, 1.0, "", 30)]
    back = table(json.dumps({"lat": "1", "lon": "2", "address": {"town": "t", "road": "r"}}), json.dumps({"error": "no"}), None)
    assert [tuple(r) for r in responses.reverse_answers(back, ["id"]).select("id", "city", "street", "house").collect()] == [(0, "t", "r", None)]
    second = responses.second_candidates(table(json.dumps({"results": [{"geometry": {"lat": 1, "lng": 2}, "confidence": 7}, {}]}), "{}"), ["id"])
    assert [(r.lat, r.lon, r.confidence) for r in second.collect()] == [(1.0, 2.0, 7.0)]
    cells = responses.matrix_cells(table(json.dumps({"durations": [[0, 1], [None, 0]], "distances": [[0, 5], [6, 0]]}), json.dumps({"durations": [[3]]}), None), ["id"]).orderBy("id", "i", "j")
    assert [(r.id, r.i, r.j, r.duration, r.distance) for r in cells.collect()] == [(0, 0, 0, 0, 0), (0, 0, 1, 1, 5), (0, 1, 0, None, 6), (0, 1, 1, 0, 0), (1, 0, 0, 3, None)]
    way = responses.route_answers(table(json.dumps({"routes": [{"distance": 3, "duration": 4, "geometry": "g"}]}), "{}"), ["id"]).orderBy("id").collect()
    assert [tuple(r) for r in way] == [(0, 3.0, 4.0, "g"), (1, None, None, None)]


def test_lines_of_a_sheet_answer(spark):
    said = [
        {"lines": ["a ", {"text": "b", "confidence": 0.5}, "", 7], "route_points": [{"address": "no"}]},
        {"lines": [], "route_points": [{"address": "p", "raw_row_text": "1 p"}, {"address": " "}]},
        {"table": {"rows": [{"raw_text": "r"}, {"cells": [{"text": "x"}, {}, {"text": "y"}], "row_confidence": 0.25}, {}]}},
        {"lines": "no list"},
    ]
    df = spark.createDataFrame([*((i, json.dumps(x)) for i, x in enumerate(said)), (4, None), (5, "{")], "id int, response string")
    got = [(r.id, r.text, r.confidence) for r in responses.sheet_lines(df, ["id"]).orderBy("id", "pos").collect()]
    assert got == [(0, "a", None), (0, "b", 0.5), (1, "1 p", None), (2, "r", None), (2, "x y", 0.25)]


def test_uploads_have_a_limit(spark, tmp_path):
    for name in ("a/1.png", "a/2.png", "a/3.txt", "b/1.png", "b/2.doc"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = files.intake(files.images(spark, str(tmp_path), 5), 2).select("path", "error").collect()
    assert sorted((r.path[-7:], r.error) for r in got) == [("a/1.png", "TOO_MANY_FILES"), ("a/2.png", "TOO_MANY_FILES"), ("a/3.txt", "TOO_MANY_FILES"), ("b/1.png", None), ("b/2.doc", "UNSUPPORTED_TYPE")]


def test_reports_have_fixed_columns_and_a_mark(spark, tmp_path):
    found = spark.createDataFrame([("b", "n", "ул. 5", 59.5, 30.5, 0.5, ["X", "Y"], "node", 7, False)], "brand string, name string, original_address string, lat double, lon double, confidence_score double, warnings array<string>, osm_type string, osm_id long, is_duplicate boolean")
    paths = files.write_place_reports(files.report_rows(found), str(tmp_path / "out"), "1")
    parts = [p.read_bytes().decode() for p in (tmp_path / "out" / "poi_import_1.csv").iterdir() if p.suffix == ".csv"]
    assert next(t for t in parts if "ул. 5" in t) == "\ufeff" + ",".join(files.REPORT_COLUMNS) + "\nb,n,ул. 5,59.5,30.5,0.5,X;Y,node,7,,false\n"
    assert spark.read.option("header", "true").csv(paths["csv"]).first().canonical_brand == "b"


def test_lists_reports_and_tables(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\n\n  Невский 1 \nМира 2\n")
    assert sorted(r.address for r in files.address_list(spark, str(tmp_path / "list.txt")).collect()) == ["Мира 2", "Невский 1"]
    items = spark.createDataFrame([(1, 'a "b", c', 0.5, False, ["X", "Y"]), (2, "d", 0.9, True, [])], "id int, name string, confidence_score double, is_duplicate boolean, warnings array<string>")
    paths = files.write_place_reports(items, str(tmp_path / "out"), "20260101_000000")
    back = spark.read.options(header="true", escape='"').csv(paths["csv"]).orderBy("id").collect()
    assert [(r.name, r.warnings or "") for r in back] == [('a "b", c', "X;Y"), ("d", "")]
    assert [spark.read.option("header", "true").csv(paths[k]).count() for k in ("duplicates_csv", "low_confidence_csv")] == [1, 1]
    assert files.enriched_path("x/poi_import_1.csv", "7") == "x/poi_import_1_reverse_geocoded_7.csv"
    (tmp_path / "in").mkdir()
    for name in ("poi_import_1.csv", "poi_import_1_reverse_geocoded_2.csv", "other.csv"):
        (tmp_path / "in" / name).write_text("﻿id,name\n1,x\n", encoding="utf-8")
    assert [(r.id, r.report) for r in files.reports(spark, str(tmp_path / "in")).collect()] == [("1", "poi_import_1.csv")]
    (tmp_path / "r.json").write_text('{"items": [{"id": 1}, {"id": 2}]}')
    assert files.json_report(spark, str(tmp_path / "r.json"), "id: int").count() == 2
    assert files.with_columns_of(items, ["id", "city"]).columns[-1] == "city"
    pages = spark.createDataFrame([(1, "<table><tr><th>a</th><td>b &amp; c<table><tr><td>in</td></tr></table></td></tr><tr></tr><tr><td> d\n e</td></tr></table>"), (2, None), (3, "<td>x")], "id int, html string")
    got = [(r.id, r.tbl, r.row, r.cells) for r in files.html_tables(pages, "id").orderBy("id", "tbl", "row").collect()]
    assert got == [(1, 0, 0, ["a", "b & c"]), (1, 0, 1, ["d e"]), (1, 1, 0, ["in"])]
    assert spark.range(1).select(files.markdown_row(F.array(F.lit("a|b"), F.lit(None).cast("string"))).alias("x")).first().x == "| a\\|b |  |"


def test_images(spark, tmp_path):
    for folder, name, size in (("a", "x.png", 3), ("a", "y.txt", 3), ("a", "z.JPG", 0), ("b", "w.jpeg", 9)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(b"1" * size)
        os.utime(tmp_path / folder / name, (size, 1_000_000 + size))
    got = files.images(spark, str(tmp_path), 5)
    assert {r.name: r.error for r in got.select("name", "error").collect()} == {"x.png": None, "y.txt": "UNSUPPORTED_TYPE", "w.jpeg": "TOO_LARGE"}
    assert files.newest_folder(got).select("name").collect() == [("w.jpeg",)]


def test_snapshots_follow_a_stream(spark, tmp_path):
    schema = "id int, name string"
    rows = lambda: {r.id: r.name for r in ingest.snapshot(spark, str(tmp_path / "snap"), schema).collect()}
    assert rows() == {}
    for n, batch in enumerate(([(1, "a"), (2, "b"), (None, "x")], [(2, "c"), (2, "d"), (3, "e")], [])):
        if batch:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.keep_snapshot(stream, str(tmp_path / "snap"), schema, ["id"], [F.desc("name")], str(tmp_path / "cp")).awaitTermination()
        assert rows() == ({1: "a", 2: "b"} if n == 0 else {1: "a", 2: "d", 3: "e"})


def test_samples_and_requests_seen_once(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp'2026-01-01 00:00:00', 2.0D), (1, timestamp'2026-01-01 00:00:01', 4.0D), (2, timestamp'2026-01-01 00:00:03', 9.0D) AS t(id, ts, v)")
    assert [(r.n, r.least, r.mean, r.greatest) for r in ingest.samples(df, "ts", "v").orderBy("begun").collect()] == [(2, 2, 3, 4), (1, 9, 9, 9)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest.run_now(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: ingest.seen_once(d, ["id"], "ts", "1 minute")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    table = spark.sql("SELECT 1 AS id, timestamp'2020-01-01' AS last_used_at UNION ALL SELECT 5, null")
    assert {r.id: r.y for r in ingest.last_used(table, df.withColumnRenamed("ts", "last_used_at"), "id").select("id", F.year("last_used_at").alias("y")).collect()} == {1: 2026, 5: None}
