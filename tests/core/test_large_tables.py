"""What went wrong on larger tables: each test holds the rows, and what made the work grow."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from routeloom.functions import geo, similarity, text
from routeloom.operators import enrichment, places, routes, sheets, suggestions


def test_mean_of_a_way_does_not_turn_on_the_order_of_its_nodes(spark):
    lats = (0.1, 0.2, 0.3, 0.7)
    rows = [(n, x, -x) for n, p in enumerate(permutations(lats)) for x in p] + [(-1, None, 1.0), (-2, 95.0, 1.0), (-2, 0.5, 2.0)]
    got = {r.way_id: (r.lat, r.lon) for r in enrichment.way_point(spark.createDataFrame(rows, "way_id long, lat double, lon double").coalesce(1)).collect()}
    assert got.pop(-1) == (None, None) and got.pop(-2) == (0.5, 2.0)
    assert len(got) == 24 and len(set(got.values())) == 1


def test_cells_of_a_grid_are_made_last(spark):
    xs = spark.createDataFrame([(1, 0), (1, 50), (1, 60), (1, 110), (2, 0), (3, 5), (3, 90)], "grp int, v long")
    ys = spark.createDataFrame([(1, 0), (1, 30), (1, 80), (2, 0), (2, 99)], "grp int, v long")
    out = sheets.grid_cells(xs, ys, 40, 30)
    want = [(1, r, c, x, y, w, h) for r, (y, h) in enumerate([(0, 30), (30, 50)]) for c, (x, w) in enumerate([(0, 50), (60, 50)])]
    assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window"), plan


def test_key_of_an_address_is_read_once_for_each_different_address(spark):
    same = "Магазин: наб. реки 5 | дом 7"
    df = spark.createDataFrame([(n, same if n % 2 else None) for n in range(4)] + [(9, "ул. Мира д. 5"), (10, " "), (11, "Гатчина, ул. Мира к. 2")], "id int, raw string")
    got = {r.id: r.key for r in text.with_cache_key(df, "raw").select("id", "key").collect()}
    want = {r.id: r.key for r in df.select("id", text.cache_key(F.col("raw")).alias("key")).collect()}
    assert got == want and got[1] == "санкт-петербург, набережная реки 5, дом 7" and got[0] is None and got[10] is None
    # parts that are read several times are not written out each time (that made 150)
    plan = df.select(text.cache_key(F.col("raw")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") < 30, plan.count("translate(")


@pytest.mark.parametrize("spheroid", [False, True])
def test_distances_are_worked_out_once_for_two_points(spark, spheroid):
    points = [(59.9 + n / 1000, 30.3 + n / 700) for n in range(4)]
    left = [(k, n, *points[n % 4]) for k in "ab" for n in range(400)] + [("a", -1, None, 30.3)]
    right = [(k, n, *points[n % 4]) for k in "bc" for n in range(200)]
    a, b = spark.createDataFrame(left, "brand string, i int, lat double, lon double"), spark.createDataFrame(right, "brand string, j int, lat double, lon double")
    out = geo.pairs_within(a, b, 200.0, ("brand",), spheroid, decimals=1)
    assert out.columns == ["brand", "i", "lat", "lon", "j", "distance_m"]
    each = (geo.geodesic if spheroid else geo.haversine)("lat", "lon", "_lat", "_lon")
    want = a.join(b.withColumnsRenamed({"lat": "_lat", "lon": "_lon"}), "brand").withColumn("d", each).filter("d <= 200").select("brand", "i", "j", F.round("d", 1)).collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, out.select("brand", "i", "j", "distance_m").collect()))
    # the join above which a distance is worked out is one of points
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("ATAN2"), plan


def test_places_of_one_point_and_like_queries(spark):
    here, there = (59.9, 30.3), (59.91, 30.3)
    rows = [(n, None if n % 3 else "Ленинка", f"Дом {n}", "улица Мира 5", "улица мира 5", n % 50 / 50, 0, *(here if n < 130 else there)) for n in range(300)]
    rows += [(999, None, None, "улица Мира 5", None, 0.5, 0, None, None)]
    p = spark.createDataFrame(rows, "id long, brand string, name string, address string, normalized_address string, confidence double, updated_at int, lat double, lon double")
    asks = [(n, "улица Мира", None, *here) for n in range(5)] + [(10, "улица Мира", None, None, None), (11, "улица Мира", None, None, None), (12, "дом", "Ленинка", *here), (13, "дом", "Ленинка", *here)]
    q = spark.createDataFrame(asks, "query_id long, text string, brand string, lat double, lon double")
    got = {}
    for r in places.by_class(q, p, 500.0).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.id, r.match))
    near = [x for x in rows if x[7] == 59.9 or x[7] is None]
    key = lambda x: (x[4] is None, -x[5], x[0])
    match = lambda x: 0 if x[4] else 1
    assert all(got[n] == [(x[0], match(x)) for x in sorted(near, key=key)[:100]] for n in range(5))
    assert got[10] == got[11] == [(x[0], match(x)) for x in sorted(rows, key=key)[:100]]
    assert got[12] == got[13] == [(x[0], 2) for x in sorted((x for x in near if x[1]), key=lambda x: (-x[5], x[0]))]
    found = places.search(q, p, 500.0).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score")))).collect()
    by = {r[0]: r[1] for r in found}
    assert len(by) == 9 and all(by[n] == by[0] for n in range(5)) and by[10] == by[11] and by[12] == by[13]


def test_few_texts_go_to_every_task(spark):
    a, b = spark.createDataFrame([("ab",), ("мира",)], "l string"), spark.createDataFrame([("улица мира",), ("cab",), ("x",)], "r string")
    out = similarity.containing_pairs(a, b)
    assert sorted(map(tuple, out.collect())) == [("ab", "cab"), ("мира", "улица мира")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2


def test_jobs_of_one_size_are_ordered_together(spark):
    import numpy as np

    r = np.random.default_rng(3)
    cells = lambda job, m: [(job, i, j, float(x)) for (i, j), x in np.ndenumerate(m)]
    sizes = {job: 1 + job % 12 for job in range(60)} | {60: routes.MAX_POINTS, 61: routes.MAX_POINTS + 1}
    matrices = {job: r.integers(1, 30, (n, n)) * (1 - np.eye(n)) for job, n in sizes.items()}
    bad = {5: -1.0, 17: float("nan"), 29: None}
    rows = [(job, i, j, bad[job] if job in bad and (i, j) == (0, 1) else x) for job, m in matrices.items() for job, i, j, x in cells(job, m)]
    rows = [x for x in rows if not (x[0] == 30 and x[1:3] == (1, 1))]
    a = spark.createDataFrame(rows, "job long, i int, j int, cost double")
    b = a.withColumn("cost", F.when(F.col("job") == 41, -F.lit(1.0)).otherwise(F.col("cost") * 2))
    got = {}
    for x in routes.planned([a, b]).orderBy("job", "ord").collect():
        got.setdefault(x.job, []).append(x)
    assert set(got) == set(sizes) - {*bad, 30, 41, 61}

    def plain(m):
        left, order = list(range(1, len(m) - 1)), [0]
        while left:
            order.append(min(left, key=lambda k: (m[order[-1]][k], k)))
            left.remove(order[-1])
        order += [len(m) - 1] if len(m) > 1 else []
        first, total = order, lambda o: sum(m[x][y] for x, y in zip(o, o[1:], strict=False))
        for _ in range(100):
            new = (order[:s] + order[s : e + 1][::-1] + order[e + 1 :] for s in range(1, len(m) - 2) for e in range(s + 1, len(m) - 1))
            better = next((o for o in new if total(o) < total(order) - 1e-9), None)
            if better is None:
                break
            order = better
        return order, total(order), total(first)

    for job, out in got.items():
        if job < 60:
            order, cost, first = plain(matrices[job].tolist())
            legs = out[:-1]
            assert [x.stop for x in out] == order and sum(x.cost0 for x in legs) == cost and sum(x.cost1 for x in legs) == 2 * cost and sum(x.first0 for x in legs) == first


def test_suggestions_are_found_once_for_each_text(spark, monkeypatch):
    cache = [(n, f"улица мира дом {n}", f"ул. Мира д. {n}", f"улица Мира, {n}, Санкт-Петербург", "found", 59.9 + n / 1000, 30.3, "nominatim", 5.0 + n, 0, n, None, None) for n in range(1, 30)]
    cache = spark.createDataFrame(cache, "address_id long, normalized_address string, original_address string, display_name string, status string, lat double, lon double, provider string, confidence double, updated_at int, last_used_at int, score double, raw string")
    queries = spark.createDataFrame([(n, "улица мира" if n % 2 else "мира", None) for n in range(40)], "query_id long, query string, key string")
    # the first is what the cache has, the second isn't
    raw = '{"osm_type":"way","osm_id":7,"address":{"road":"Мира"}}'
    found = spark.createDataFrame([(n, n, f"улица Мира, {n}, Санкт-Петербург", 59.9 + n / 1000 + d, 30.3, 0.5, 30, raw) for n in (2, 3) for d in (0.0, 0.5)], "query_id long, pos long, display string, lat double, lon double, importance double, place_rank int, raw string")
    asked, cached = [], suggestions.cached
    monkeypatch.setattr(suggestions, "cached", lambda q, *rest: (asked.append(q.count()), cached(q, *rest))[1])
    got = {}
    for r in suggestions.suggest(queries, cache, found).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.place, r.id, r.lat))
    assert asked == [2] and len(got) == 40
    assert all([p for p, _, _ in v] == list(range(1, len(v) + 1)) for v in got.values())
    assert all(got[n] == got[n % 2] for n in range(4, 40))
    near = [x for n in (2, 3) for x in got[n] if x[1].startswith("nominatim") and x[2] < 60.2]
    assert not near
