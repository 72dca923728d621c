"""Orders of stops, distances everywhere, sheets and jobs, against plain versions of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from routeloom.functions import geo, scalars
from routeloom.operators import addresses, route_jobs, routes, sheets, suggestions
from routeloom.sources import register_xml


def nearest(cost):
    order, left = [0], set(range(1, len(cost) - 1))
    while left:
        k = min(left, key=lambda j: (cost[order[-1]][j], j))
        order.append(k)
        left.remove(k)
    return [*order, len(cost) - 1]


def reversals(order, cost, most=100):
    price = lambda o: sum(cost[a][b] for a, b in zip(o, o[1:]))
    for _ in range(most):
        for s, e in [(s, e) for s in range(1, len(order) - 2) for e in range(s + 1, len(order) - 1)]:
            new = order[:s] + order[s : e + 1][::-1] + order[e + 1 :]
            if price(new) < price(order) - 1e-9:
                order = new
                break
        else:
            break
    return order


def cells_of(jobs):
    return [(job, i, j, float(x)) for job, cost in jobs.items() for i, row in enumerate(cost) for j, x in enumerate(row)]


def orders(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.job, r.ord)):
        out.setdefault(r.job, []).append(r.stop)
    return out


def test_orders_equal_the_plain_loops(spark):
    rng = random.Random(6)
    jobs = {}
    for job in range(40):
        n = rng.choice([2, 3, 4, 5, 9, 14])
        # few different costs make ties
        jobs[job] = [[0 if i == j else rng.randint(1, 4 if job % 2 else 50) for j in range(n)] for i in range(n)]
    n = 60
    jobs[40] = [[0 if i == j else abs(i * 37 % n - j * 37 % n) + (i > j) for j in range(n)] for i in range(n)]
    m = spark.createDataFrame(cells_of(jobs), "job int, i int, j int, cost double")
    first = {j: nearest(c) for j, c in jobs.items()}
    assert orders(routes.order_stops(m, False).collect()) == first
    assert orders(routes.order_stops(m).collect()) == {j: reversals(first[j], c) for j, c in jobs.items()}


def test_jobs_that_break_a_rule(spark):
    good = [[0, 1, 2], [1, 0, 1], [2, 1, 0]]
    bad = {1: ("negative", 0, 1, -1.0), 2: ("not finite", 1, 2, float("nan")), 3: ("diagonal", 1, 1, 2.0), 4: ("missing", 2, 0, None)}
    rows = cells_of({j: good for j in range(6)})
    rows = [(j, a, b, bad[j][3] if j in bad and (a, b) == bad[j][1:3] else c) for j, a, b, c in rows if not (j == 5 and (a, b) == (1, 2))]
    rows += [(9, i, j, 1.0 if i != j else 0.0) for i in range(103) for j in range(103)] + [(8, i, j, 1.0 if i != j else 0.0) for i in range(102) for j in range(102)]
    m = spark.createDataFrame(rows, "job int, i int, j int, cost double")
    assert {r.job: r.error for r in routes.check_matrix(m).collect()} == {0: None, 5: "shape", 8: None, 9: "too many points"} | {j: b[0] for j, b in bad.items()}
    assert {r.job for r in routes.order_stops(m).select("job").distinct().collect()} == {0, 8}


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 12_742_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("lat, lon, reach", [(0, 0, 500), (60, 30, 500), (70, 179.99, 5000), (-80, -179.9, 20_000), (89.9, 10, 30_000), (-89.99, 0, 900_000), (45, 180, 50)])
def test_pairs_everywhere_on_the_globe(spark, lat, lon, reach):
    rng = random.Random(2)
    side = reach / 111_000 * 3

    def point():
        x = lon + rng.uniform(-1, 1) * min(180, side / max(0.001, math.cos(math.radians(lat))))
        return max(-90.0, min(90.0, lat + rng.uniform(-1, 1) * side)), (x + 180) % 360 - 180

    a, b = ([(i, *point()) for i in range(150)] for _ in range(2))
    left, right = spark.createDataFrame(a, "a int, lat double, lon double"), spark.createDataFrame(b, "b int, lat double, lon double")
    got = {(r.a, r.b) for r in geo.pairs_within(left, right, float(reach)).collect()}
    want = {(i, j) for i, *p in a for j, *q in b if metres(p, q) <= reach}
    assert got == want and len(want) > 100


def test_rounding_follows_the_binary_value(spark):
    rng = random.Random(9)
    xs = [0.125, 2.675, 1.005, -0.125, 1e9 + 0.125, 0.0] + [rng.randint(0, 10**6) / 800 for _ in range(300)] + [rng.random() * 1000 for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalars.rounded(F.col("x")).alias("y")).collect()
    assert all(r.y == round(r.x, 2) for r in rows)


def test_sheet_lines(spark):
    lines = ["Пятерочка", "Луга, Ленина ул. 5", "Пудомяги д. 5", "12 345 Магнит Гатчина, 25 Октября пр. 12 88812345", "склад Ленина ул. 5", "г. Санкт-Петербург, Дружмая ш 3к2 вход 9", "abc", None]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "image int, pos int, text string")
    got = {r.pos: (r.store, r.address, r.confidence) for r in sheets.delivery_records(df).collect()}
    assert got == {1: ("Пятерочка", "Луга, Ленина ул. 5", 0.95), 2: (None, "Пудомяги д. 5", 0.69), 3: ("Магнит", "Гатчина, 25 Октября пр. 12", 0.95), 5: (None, "г. Санкт-Петербург, Дружная ш 3к2", 0.83)}


def test_mangled_text_is_mended(spark):
    texts = ["Ленина ул. 5", "Ленина".encode().decode("cp1251"), "Санкт-Петербург".encode().decode("cp1251", "ignore"), "plain", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sheets.unmangled("t").alias("x")).collect()]
    assert got[0] == texts[0] and got[3] == "plain" and got[4] is None and got[2] == "Санкт-Петербург"
    # no sign of it is among those that count
    assert got[1] == texts[1]


def test_border_lines(spark):
    df = spark.createDataFrame([([5, 50],), ([30, 50],), ([],)], "v array<long>")
    assert [r.x for r in df.select(sheets.with_borders(F.col("v"), 100, 10).alias("x")).collect()] == [[5, 50, 100], [0, 30, 50, 100], [0, 100]]


def test_similar_streets(spark):
    pairs = [("ул. Ленина", "улица Ленина", 0.9), ("Большая Морская", "Морская", 0.9), ("Садовая", "Лиговский", 0.0), ("", "Садовая", 0.0), ("Просвещения", "Просвещенияя", 22 / 23)]
    rows = spark.createDataFrame(pairs, "a string, b string, s double").select("s", addresses.street_similarity(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(abs(r.x - max(r.s, 0)) < 1e-9 or (r.s == 0.9 and r.x >= 0.9) for r in rows)
    houses = [("5", "5а", True), ("5а", "5б", True), ("5", "6", False), ("12/3", "12", False), (None, "5", False)]
    rows = spark.createDataFrame(houses, "a string, b string, s boolean").select("s", addresses.same_house(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r.x == r.s for r in rows)


def test_suggestions_put_streets_first(spark):
    cache = spark.createDataFrame(
        [(1, "санкт-петербург, улица ленина дом 5", "СПб, ул. Ленина, 5", "улица Ленина, 5, Санкт-Петербург", "found", 59.9, 30.3, "nominatim", None, 80.0, '{"address":{"road":"улица Ленина","house_number":"5","city":"Санкт-Петербург"}}', 3, 1)],
        "address_id int, normalized_address string, original_address string, display_name string, status string, lat double, lon double, provider string, score double, confidence double, raw string, last_used_at int, updated_at int",
    )
    q = spark.createDataFrame([(1, "Ленина", "санкт-петербург, ленина"), (2, "Ле", "ле"), (3, "Ленина 5", "санкт-петербург, ленина 5")], "query_id int, query string, key string")
    found = spark.createDataFrame([(1, 0, "Дом, Ленина", 59.8, 30.2, 0.9, 30, '{"class":"building","address":{"building":"Дом"}}')], "query_id int, pos int, display string, lat double, lon double, importance double, place_rank int, raw string")
    got = suggestions.suggest(q, cache, found).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.id, r.main_text) for r in got] == [(1, "street:улица ленина", "улица Ленина"), (1, "address:1", "улица Ленина, 5"), (1, "nominatim:candidate", "Дом")]
    assert got[0].secondary_text == "Санкт-Петербург" and got[0].address["road"] == "улица Ленина" and "house_number" not in got[0].address


def test_route_answer(spark):
    rows = [(7, "start", 0, 59.90, "found"), (7, "waypoint", 1, 59.93, "found"), (7, "waypoint", 2, 59.91, "manual"), (7, "end", 3, 59.94, "found"), (8, "start", 0, 59.9, "found"), (8, "end", 1, None, "not_found")]
    df = spark.createDataFrame([(j, r, i, f"a{i}", 100 * j + i, la, 30.3, s, None, "x") for j, r, i, la, s in rows], "job int, role string, original_index int, address string, id int, lat double, lon double, status string, error string, display_name string")
    cost = [[0 if i == j else abs([0, 30, 10, 40][i] - [0, 30, 10, 40][j]) + 0.125 for j in range(4)] for i in range(4)]
    m = spark.createDataFrame(cells_of({7: cost}), "job int, i int, j int, cost double")
    out = route_jobs.answer(df, m, m.withColumn("cost", F.col("cost") * 10), "https://example.org", slug="x", size=1)
    r = out.collect()[0]
    assert [p.original_index for p in r.ordered_points] == [0, 2, 1, 3] and (r.duration_s, r.distance_m, r.points) == (40.38, 403.75, 4)
    assert [(b.batch, b.points, b.warnings) for b in r.batches] == [(1, 2, []), (2, 3, [])] and r.status == "completed"
    assert [(x.from_order, x.to_order, x.duration_s) for x in r.legs] == [(0, 1, 10.12), (1, 2, 20.12), (2, 3, 10.12)]
    jobs, batches, points = route_jobs.tables(out, df)
    assert jobs.collect()[0].start_id == 700 and batches.count() == 2
    assert sorted((p.ord, p.address_id, p.batch, p.duration_s) for p in points.collect()) == [(0, 700, 1, None), (1, 702, 1, 10.12), (2, 701, 2, 20.12), (3, 703, 2, 10.12)]
    assert {f.job: f.code for f in route_jobs.failure_of_jobs(route_jobs.failed(df)).collect()} == {8: "END_ADDRESS_NOT_FOUND"}


def test_region_codes():
    assert register_xml.region_codes(None) == [] and register_xml.region_codes("spb-lenobl") == ["78", "47"] and register_xml.region_codes("7; 47,x") == ["07", "47", "x"]
