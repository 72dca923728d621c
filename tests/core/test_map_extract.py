"""A map extract written here, byte by byte, and what is read of it."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.sources import map_extract


def number(n):
    n &= 2**64 - 1
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def zig(n):
    return number(n << 1 if n >= 0 else (-n << 1) - 1)


def part(k, data):
    return number(k << 3 | 2) + number(len(data)) + data


def plain(k, n):
    return number(k << 3) + number(n)


def deltas(values):
    return b"".join(zig(b - a) for a, b in zip([0, *values[:-1]], values, strict=True))


def block(strings, groups, granularity=100, lat_offset=0, lon_offset=0):
    return part(1, b"".join(part(1, s.encode()) for s in strings)) + b"".join(part(2, g) for g in groups) + plain(17, granularity) + plain(19, lat_offset) + plain(20, lon_offset)


def blob(kind, data, packed=True):
    body = plain(2, len(data)) + part(3, zlib.compress(data)) if packed else part(1, data)
    head = part(1, kind.encode()) + plain(3, len(body))
    return struct.pack(">i", len(head)) + head + body


@pytest.fixture(scope="module")
def extract(tmp_path_factory):
    """A file with dense and single nodes, ways and a relation in several blobs, and its objects."""
    r = random.Random(6)
    strings = ["", "name", "Лента", "shop", "supermarket", "brand", "x"]
    objects, blobs = {}, [blob("OSMHeader", b"")]
    for n in range(5):
        ids = [1000 * n + i for i in range(40)]
        lat, lon = ([r.randint(-899_999_999, 899_999_999) for _ in ids] for _ in range(2))
        tags = [r.choice([[], [], [1, 2, 3, 4], [5, 6]]) for _ in ids]
        dense = part(1, deltas(ids)) + part(8, deltas(lat)) + part(9, deltas(lon)) + part(10, b"".join(number(x) for t in tags for x in [*t, 0]))
        granularity, off = (100, 0) if n < 3 else (50, -(10**9))
        for i, a, b, t in zip(ids, lat, lon, tags, strict=True):
            objects["node", i] = ({strings[k]: strings[v] for k, v in zip(t[::2], t[1::2], strict=True)}, (off + granularity * a) / 1e9, (off + granularity * b) / 1e9, None)
        one = number(1 << 3) + zig(-7 - n) + part(2, number(1)) + part(3, number(6)) + number(8 << 3) + zig(-5) + number(9 << 3) + zig(123456789)
        objects["node", -7 - n] = ({"name": "x"}, (off - 5 * granularity) / 1e9, (off + granularity * 123456789) / 1e9, None)
        ways = b""
        for w in range(6):
            refs = [r.choice(ids) for _ in range(r.randint(0, 5))] + [99_999]
            ways += part(3, plain(1, 50_000 + 10 * n + w) + part(2, number(3)) + part(3, number(4)) + part(8, deltas(refs)))
            objects["way", 50_000 + 10 * n + w] = ({"shop": "supermarket"}, None, None, refs)
        objects["relation", n] = ({"brand": "x"}, None, None, None)
        relation = part(4, plain(1, n) + part(2, number(5)) + part(3, number(6)))
        blobs.append(blob("OSMData", block(strings, [part(2, dense) + part(1, one), ways, relation], granularity, off, off), packed=n % 2 == 0))
    path = tmp_path_factory.mktemp("map") / "some.osm.pbf"
    path.write_bytes(b"".join(blobs))
    return str(path), objects


@pytest.mark.parametrize("run_bytes", [1, 3000, 64 << 20])
def test_reads_back_what_was_written(spark, extract, run_bytes):
    path, objects = extract
    found = map_extract.objects(spark, path, run_bytes)
    got = {(r.osm_type, r.osm_id): (r.tags, r.lat, r.lon, r.refs) for r in found.collect()}
    assert got == objects
    assert found.rdd.getNumPartitions() == {1: 6, 64 << 20: 1}.get(run_bytes, found.rdd.getNumPartitions())


def test_ways_get_the_mean_of_their_nodes(spark, extract):
    path, objects = extract
    found = map_extract.objects(spark, path)
    got = {(r.osm_type, r.osm_id): (r.lat, r.lon) for r in map_extract.with_points(found).collect()}
    want = {}
    for (kind, i), (tags, lat, lon, refs) in objects.items():
        if kind == "node" and tags:
            want[kind, i] = (lat, lon)
        elif kind == "way":
            at = [objects["node", n][1:3] for n in refs if ("node", n) in objects]
            at = [p for p in at if abs(p[0]) <= 90 and abs(p[1]) <= 180]
            want[kind, i] = (sum(p[0] for p in at) / len(at), sum(p[1] for p in at) / len(at)) if at else (None, None)
    assert got.keys() == want.keys()
    assert all((got[k] == want[k]) if want[k][0] is None else np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_a_scan_is_counted(spark, extract):
    path, objects = extract
    shop = F.element_at("tags", "shop").isNotNull()
    r = map_extract.scanned(map_extract.objects(spark, path), shop, (-90, 90, -180, 180)).first()
    wanted = [k for k, v in objects.items() if "shop" in v[0]]
    lost = [k for k in wanted if k[0] == "way" and not [n for n in objects[k][3] if ("node", n) in objects]]
    assert (r.objects_scanned, r.relations_seen, r.candidates, r.skipped) == (len(objects), 5, len(wanted), len(lost))


def test_an_empty_file(spark, tmp_path):
    (tmp_path / "none.osm.pbf").write_bytes(b"")
    assert map_extract.objects(spark, str(tmp_path / "none.osm.pbf")).count() == 0
