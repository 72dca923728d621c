"""Distances on the spheroid against known values."""

import pytest

from routeloom.functions import geo

#: Two points, and the metres between them: along the equator and a meridian, and lines that surveys publish.
KNOWN = [
    ((0, 0, 0, 1), 111319.490793),
    ((0, 0, 1, 0), 110574.388558),
    ((0, 0, 90, 0), 10001965.729312),
    ((-37.951033416667, 144.424867888889, -37.652821138889, 143.926495527778), 54972.271139),
    ((60, 30, 60, 30), 0.0),
    ((60, 179.999, 60, -179.999), 111.590),
    ((90, 10, 90, 50), 0.0),
]


def test_known_lines(spark):
    rows = spark.createDataFrame([(*map(float, p), m) for p, m in KNOWN], "a double, b double, c double, d double, m double")
    for r in rows.select("*", geo.geodesic("a", "b", "c", "d").alias("got"), geo.geodesic("c", "d", "a", "b").alias("back")).collect():
        # to a millimetre
        assert r.got == pytest.approx(r.m, abs=0.001 if r.m != 111.590 else 0.05) and r.back == pytest.approx(r.got, abs=1e-6), r


def test_nearly_antipodal_points_are_null_or_right(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.5, 179.5, 19936288.579), (0.0, 0.0, 0.5, 179.7, 19944127.421), (0.0, 0.0, 0.0, 179.9, 20000000.0), (None, 0.0, 1.0, 1.0, 0.0)], "a double, b double, c double, d double, m double")
    got = [r.got for r in rows.select(geo.geodesic("a", "b", "c", "d", turns=200).alias("got")).collect()]
    assert got[0] == pytest.approx(19936288.579, abs=0.001)
    assert got[1] is None or got[1] == pytest.approx(19944127.421, abs=0.01)
    assert got[3] is None


def test_pairs_on_the_spheroid_equal_all_pairs(spark):
    left = spark.createDataFrame([(i, 59.9 + i * 0.0007, 30.3 + i * 0.0011) for i in range(25)], "a long, lat double, lon double")
    right = spark.createDataFrame([(i, 59.905 + i * 0.0005, 30.31 - i * 0.0009) for i in range(25)], "b long, lat double, lon double")
    got = {(r.a, r.b) for r in geo.pairs_within(left, right, 700.0, spheroid=True).collect()}
    both = left.crossJoin(right.withColumnsRenamed({"lat": "y", "lon": "x"}))
    assert got == {(r.a, r.b) for r in both.filter(geo.geodesic("lat", "lon", "y", "x") <= 700).collect()} and got
