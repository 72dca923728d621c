"""Map extracts in the binary format of OpenStreetMap (.osm.pbf) as a data source, and the places of their nodes and ways.

A file is a row of blobs, each with a header that gives its size. The driver reads the headers
only and makes partitions of neighbouring blobs; tasks unpack and decode them: numbers of
variable length and differences with array operations, coordinates and ids likewise. Ways get
their coordinates from their nodes by a join.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from routeloom.operators.enrichment import way_point

FORMAT = "map_extract"
SCHEMA = "osm_type string, osm_id long, tags map<string,string>, lat double, lon double, refs array<long>"
_ARROW = pa.schema([("osm_type", pa.string()), ("osm_id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", pa.list_(pa.int64()))])
#: Numbers of the format's fields.
_BLOB_TYPE, _BLOB_SIZE, _RAW, _ZLIB = 1, 3, 1, 3
_STRINGS, _GROUP, _GRANULARITY, _LAT_OFFSET, _LON_OFFSET = 1, 2, 17, 19, 20
_NODE, _DENSE, _WAY, _RELATION = 1, 2, 3, 4
_ID, _KEYS, _VALUES, _LAT, _LON, _REFS, _DENSE_TAGS = 1, 2, 3, 8, 9, 8, 10


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields in order; a value of a length is a stretch of bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"a field of kind {kind}")
        yield number, value


def varints(data: memoryview) -> np.ndarray:
    """Numbers of variable length, one after another."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(b < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & np.uint8(0x7F)).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def signed(x: np.ndarray) -> np.ndarray:
    """Numbers whose last bit is their sign."""
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _unpacked(blob: memoryview) -> bytes:
    for number, value in fields(blob):
        if number == _RAW:
            return bytes(value)
        if number == _ZLIB:
            return zlib.decompress(value)
    raise ValueError("a blob is packed in a way that isn't read")


class _Block:
    """A block's objects, as columns."""

    def __init__(self, data: bytes):
        self.kinds: list[str] = []
        self.ids: list[np.ndarray] = []
        self.lats: list[np.ndarray] = []
        self.lons: list[np.ndarray] = []
        self.tags: list[list[tuple[str, str]]] = []
        self.refs: list[np.ndarray | None] = []
        self.strings: list[str] = []
        self.granularity, self.lat_offset, self.lon_offset = 100, 0, 0
        groups = []
        for number, value in fields(memoryview(data)):
            if number == _STRINGS:
                self.strings = [bytes(s).decode("utf-8", "replace") for _, s in fields(value)]
            elif number == _GROUP:
                groups.append(value)
            elif number == _GRANULARITY:
                self.granularity = value
            elif number in (_LAT_OFFSET, _LON_OFFSET):
                offset = int(np.array(value, np.uint64).astype(np.int64))
                setattr(self, "lat_offset" if number == _LAT_OFFSET else "lon_offset", offset)
        for g in groups:
            for number, value in fields(g):
                if number == _DENSE:
                    self._dense(value)
                elif number in (_NODE, _WAY, _RELATION):
                    self._one(number, value)

    def _degrees(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (self.lat_offset + self.granularity * lat) / 1e9, (self.lon_offset + self.granularity * lon) / 1e9

    def _add(self, kind: str, ids: np.ndarray, lat: np.ndarray, lon: np.ndarray, tags: list[list[tuple[str, str]]], refs: list[np.ndarray | None]) -> None:
        self.kinds += [kind] * len(ids)
        self.ids.append(ids)
        self.lats.append(lat)
        self.lons.append(lon)
        self.tags += tags
        self.refs += refs

    def _dense(self, data: memoryview) -> None:
        own = dict(fields(data))
        ids, lat, lon = (np.cumsum(signed(varints(own.get(k, memoryview(b""))))) for k in (_ID, _LAT, _LON))
        tags: list[list[tuple[str, str]]] = [[] for _ in ids]
        pairs, node, at = varints(own.get(_DENSE_TAGS, memoryview(b""))).tolist(), 0, 0
        # keys and values in turn; a zero ends a node's
        while at < len(pairs):
            if pairs[at] == 0:
                node, at = node + 1, at + 1
            else:
                tags[node].append((self.strings[pairs[at]], self.strings[pairs[at + 1]]))
                at += 2
        self._add("node", ids, *self._degrees(lat, lon), tags, [None] * len(ids))

    def _one(self, kind: int, data: memoryview) -> None:
        own = dict(fields(data))
        keys, values = (varints(own.get(k, memoryview(b""))).tolist() for k in (_KEYS, _VALUES))
        tags = [[(self.strings[k], self.strings[v]) for k, v in zip(keys, values, strict=True)]]
        none = np.array([np.nan])
        if kind == _NODE:
            ids, lat, lon = (signed(np.array([own[k]], np.uint64)) for k in (_ID, _LAT, _LON))
            self._add("node", ids, *self._degrees(lat, lon), tags, [None])
        else:
            ids = np.array([own[_ID]], np.uint64).astype(np.int64)
            refs = np.cumsum(signed(varints(own.get(_REFS, memoryview(b""))))) if kind == _WAY else None
            self._add("way" if kind == _WAY else "relation", ids, none, none, tags, [refs])

    def batch(self) -> pa.RecordBatch | None:
        if not self.kinds:
            return None
        lat, lon = (pa.array(np.concatenate(x), from_pandas=True) for x in (self.lats, self.lons))
        # of equal keys the last one holds
        tags = pa.array([list(dict(t).items()) for t in self.tags], _ARROW.field("tags").type)
        return pa.RecordBatch.from_arrays([pa.array(self.kinds), pa.array(np.concatenate(self.ids)), tags, lat, lon, pa.array(self.refs, pa.list_(pa.int64()))], schema=_ARROW)


def store_of(path: str):
    """The local, shared or remote store of a path, as pyarrow knows it, and the path in it."""
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def open_file(path: str):
    store, name = store_of(path)
    return store.open_input_file(name)


@dataclass
class _Run(InputPartition):
    """Neighbouring blobs of a file."""

    path: str
    begin: int
    end: int


def _blobs(f, begin: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(type, place, size) of the blobs whose headers begin in a stretch of a file; contents aren't read."""
    at = begin
    while at < end:
        (n,) = struct.unpack(">i", f.read_at(4, at))
        head = dict(fields(memoryview(f.read_at(n, at + 4))))
        size = int(head[_BLOB_SIZE])
        yield bytes(head[_BLOB_TYPE]).decode(), at + 4 + n, size
        at += 4 + n + size


class _Reader(DataSourceReader):
    def __init__(self, path: str, run_bytes: int):
        self.path, self.run_bytes = path, run_bytes

    def partitions(self) -> list[_Run]:
        out, begin = [], 0
        with open_file(self.path) as f:
            whole = f.size()
            for _, place, size in _blobs(f, 0, whole):
                if place + size - begin >= self.run_bytes or place + size == whole:
                    out.append(_Run(self.path, begin, place + size))
                    begin = place + size
        return out or [_Run(self.path, 0, 0)]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        with open_file(partition.path) as f:
            for kind, place, size in _blobs(f, partition.begin, partition.end):
                if kind == "OSMData" and (b := _Block(_unpacked(memoryview(f.read_at(size, place)))).batch()) is not None:
                    yield b


class MapExtract(DataSource):
    """spark.read.format("map_extract").load(path): SCHEMA, a row for each node, way and relation; run_bytes is the least size of a partition."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("run_bytes", 64 << 20)))


def objects(spark: SparkSession, path: str, run_bytes: int = 64 << 20) -> DataFrame:
    """The objects of a map extract: SCHEMA; ways have refs, nodes coordinates, relations neither."""
    spark.dataSource.register(MapExtract)
    return spark.read.format(FORMAT).option("run_bytes", run_bytes).load(path)


def with_points(found: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(osm_type, osm_id, tags, lat, lon) of the nodes and ways that `wanted`, a condition on tags, holds for; without one, of those that have tags.

    A way's point is the mean of its nodes' valid coordinates, a node that it names twice
    counting twice; null if none is valid or in the extract. Only nodes that such ways name
    take part in the join. Of rows with equal type and id (extracts that overlap) one counts.
    """
    wanted = F.coalesce(F.size("tags") > 0, F.lit(False)) if wanted is None else F.coalesce(wanted, F.lit(False))
    nodes = found.filter("osm_type = 'node'")
    ways = found.filter((F.col("osm_type") == "way") & wanted).dropDuplicates(["osm_id"])
    refs = ways.select(F.col("osm_id").alias("way_id"), F.explode("refs").alias("node"))
    at = nodes.select(F.col("osm_id").alias("node"), "lat", "lon").dropDuplicates(["node"])
    points = way_point(refs.join(at, "node", "left").select("way_id", "lat", "lon"))
    placed = ways.select("osm_type", "osm_id", "tags").join(points.withColumnRenamed("way_id", "osm_id"), "osm_id", "left")
    own = nodes.filter(wanted).dropDuplicates(["osm_id"]).select("osm_type", "osm_id", "tags", "lat", "lon")
    return own.unionByName(placed)


def scanned(found: DataFrame, wanted: Column, box: tuple[float, float, float, float]) -> DataFrame:
    """One row (objects_scanned, relations_seen, candidates, skipped) of a scan for `wanted`: skipped are wanted relations, and candidates without a point in the box (least latitude, greatest, least longitude, greatest)."""
    from routeloom.functions.geo import in_box

    held = F.coalesce(wanted, F.lit(False))
    seen = found.agg(F.count("*").alias("objects_scanned"), F.count_if(F.col("osm_type") == "relation").alias("relations_seen"), F.count_if(held & (F.col("osm_type") == "relation")).alias("of_relations"))
    kept = with_points(found, wanted).agg(F.count("*").alias("candidates"), F.count_if(~F.coalesce(in_box("lat", "lon", box), F.lit(False))).alias("away"))
    return seen.join(kept).select("objects_scanned", "relations_seen", "candidates", (F.col("of_relations") + F.col("away")).alias("skipped"))
