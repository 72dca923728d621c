"""Facts about single operators, against plain versions of them."""

import random
from difflib import SequenceMatcher
from itertools import permutations

from pyspark.sql import functions as F

from routeloom.functions import similarity
from routeloom.functions import text as T
from routeloom.operators import places, routes, sheets, snapshots


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_trigram_similarity_of_known_words(spark):
    assert round(one(spark, similarity.trigram_similarity(F.lit("word"), F.lit("two words"))), 6) == 0.363636


def test_ratio_is_not_symmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(similarity.ratio("a", "b")).collect()] == [SequenceMatcher(None, a, b).ratio() for a, b in (("tide", "diet"), ("diet", "tide"), ("", "x"))]


def test_similar_pairs_lose_nothing(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("абвг", k=rng.randint(1, 6))) + " " + "".join(rng.choices("абв", k=3)) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "l string")
    right = df.withColumnRenamed("l", "r")
    for least in (0.25, 0.6):
        got = {(r.l, r.r) for r in similarity.similar_pairs(df, right, least).collect()}
        want = df.crossJoin(right).filter(similarity.trigram_similarity(F.col("l"), F.col("r")) > least).distinct()
        assert got == {(r.l, r.r) for r in want.collect()}


def test_containing_pairs(spark):
    left = spark.createDataFrame([("a",), ("ab",), ("abc",), ("zz",), ("",)], "l string")
    right = spark.createDataFrame([("xabcx",), ("ba",), (None,), ("ab",)], "r string")
    got = {(r.l, r.r) for r in similarity.containing_pairs(left, right).collect()}
    assert got == {(a, b) for a in ("a", "ab", "abc", "zz") for b in ("xabcx", "ba", "ab") if a in b}


def test_address_reading(spark):
    rows = spark.createDataFrame([("СПб, Невский пр-т, д. 12 к2",), ("Пятёрочка, ул. Ленина 5",), ("",), (None,)], "raw string")
    got = [r.asDict() for r in T.parsed(rows.withColumn("key", T.cache_key(F.col("raw")))).collect()]
    assert got[0]["key"] == "санкт-петербург, невский проспект, дом 12 корпус 2" and got[0]["house"] == "12" and got[0]["corpus"] == "2"
    assert got[1]["key"] == "санкт-петербург, улица ленина 5" and got[1]["street"] == "улица ленина" and got[1]["house"] == "5"
    assert got[2]["key"] is None and got[3]["key"] is None and got[3]["street"] is None


def test_reversals_find_a_better_order_and_never_a_worse_one(spark):
    rng = random.Random(3)
    cells, cost = [], {}
    for job in range(6):
        for i in range(6):
            for j in range(6):
                cost[job, i, j] = 0.0 if i == j else float(rng.randint(1, 60))
                cells.append((job, i, j, cost[job, i, j]))
    m = spark.createDataFrame(cells, "job int, i int, j int, cost double")
    price = lambda job, o: sum(cost[job, a, b] for a, b in zip(o, o[1:]))
    orders = {}
    for improve in (False, True):
        for r in routes.order_stops(m, improve).orderBy("job", "ord").collect():
            orders.setdefault((improve, r.job), []).append(r.stop)
    for job in range(6):
        first, better = orders[False, job], orders[True, job]
        assert first[0] == better[0] == 0 and first[-1] == better[-1] == 5 and sorted(better) == list(range(6))
        assert min(price(job, (0, *p, 5)) for p in permutations(range(1, 5))) <= price(job, better) <= price(job, first)


def test_batches_by_district(spark):
    def plain(ds, size):
        groups, now, known = [], [], None
        for d in ds:
            if now and (len(now) >= size or (known and d and d != known)):
                groups.append(len(now))
                now, known = [], None
            now.append(d)
            known = known or d
        return groups + [len(now)] if now else []

    rng = random.Random(8)
    jobs = {j: [rng.choice(["a", "b", None, "a"]) for _ in range(rng.randint(0, 30))] for j in range(20)}
    rows = [r for j, ds in jobs.items() for r in [(j, 0, "start", None), *((j, i + 1, "waypoint", d) for i, d in enumerate(ds)), (j, len(ds) + 1, "end", None)]]
    out = routes.batches(spark.createDataFrame(rows, "job int, ord int, type string, district string"), size=4).collect()
    for j, ds in jobs.items():
        sizes = {}
        for r in out:
            if r.job == j and not r.is_transition and 0 < r.ord <= len(ds):
                sizes[r.batch] = sizes.get(r.batch, 0) + 1
        assert [sizes[b] for b in sorted(sizes)] == plain(ds, 4)
        assert any(r.job == j for r in out)


def test_greedy_duplicates_follow_the_order(spark):
    p = spark.createDataFrame([(i, i, "b", "n", "addr", 59.9 + i * 0.0002, 30.3, 0.5 + i / 10, i % 2, 1) for i in range(4)], "id long, ord long, brand string, name string, address string, lat double, lon double, confidence double, filled int, kind int")
    got = {r.id: (r.duplicate_of, round(r.confidence, 4)) for r in places.mark_duplicates(p).collect()}
    # 22 m apiece: 0 gathers 1, 2 and 3; of those filled, 3 is surest and keeps, and 1 and 2 are marked already
    assert got == {0: (3, 0.3), 1: (3, 0.4), 2: (3, 0.5), 3: (None, 0.8)}


def test_fuzzy_rows_give_way_to_better_ones(spark):
    rows = spark.createDataFrame([(1, 0, "Ленина ул. 5", 0.6), (1, 1, "Луга, Ленина ул 5", 0.9), (1, 2, "Мира пр. 7", 0.7), (2, 0, None, 0.1)], "image int, pos int, address string, confidence double")
    got = sorted((r.image, r.row, r.address or "") for r in sheets.drop_fuzzy_repeats(rows).collect())
    assert got == [(1, 1, "Луга, Ленина ул 5"), (1, 2, "Мира пр. 7"), (2, 1, "")]


def test_empty_source_deactivates_nothing(spark):
    old = spark.createDataFrame([(1, True), (2, True)], "id int, is_active boolean")
    none = old.filter("id > 5").select("id")
    assert {r.is_active for r in snapshots.deactivate_missing(old, none, ["id"]).collect()} == {True}
