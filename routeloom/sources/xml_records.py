"""Elements of XML files with their attributes and their place, from folders of files or from a zip archive.

A file is cut at each "<", which attributes can't hold, so Spark splits large files as it does
lines of text; a piece's place is where its stretch of the file begins, and its number within
the stretch. Of an archive, the driver reads the list of members only; one task reads one
member as a stream, without unpacking it anywhere.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from routeloom.sources.map_extract import open_file

FORMAT = "zipped_xml"
_SCHEMA = "file string, begin long, number long, piece string"
#: The signs that XML spells out.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


@dataclass
class _Member(InputPartition):
    path: str
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Member]:
        with open_file(self.path) as f, zipfile.ZipFile(f) as z:
            names = sorted(n for n in z.namelist() if n.lower().endswith(".xml"))
        return [_Member(self.path, n) for n in names] or [_Member(self.path, "")]

    def read(self, partition: _Member) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        number, rest = 0, b""
        with open_file(partition.path) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as member:
            while chunk := member.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"<")
                if whole:
                    yield self._batch(partition, number, whole)
                number += len(whole)
        yield self._batch(partition, number, [rest])

    def _batch(self, at: _Member, number: int, pieces: list[bytes]) -> pa.RecordBatch:
        n = len(pieces)
        texts = pa.array([p.decode("utf-8", "replace") for p in pieces], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([f"{at.path}/{at.name}"] * n), pa.array([0] * n, pa.int64()), pa.array(range(number, number + n), pa.int64()), texts], ["file", "begin", "number", "piece"])


class ZippedXml(DataSource):
    """spark.read.format("zipped_xml").load(path): the pieces of an archive's XML members."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def _plain(value: Column) -> Column:
    """An attribute's text, its spelt-out signs read."""
    numbers = F.array_distinct(F.regexp_extract_all(value, F.lit("&#(?:x[0-9a-fA-F]+|[0-9]+);"), F.lit(0)))
    code = lambda e: F.when(F.startswith(e, F.lit("&#x")), F.conv(F.regexp_extract(e, "&#x([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(e, "&#([0-9]+);", 1)).try_cast("long")
    sign = lambda e: F.coalesce(F.when(code(e).between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code(e)), 8, "0")), "UTF-32")), e)
    out = F.aggregate(numbers, value, lambda v, e: F.replace(v, e, sign(e)))
    for spelt, plain in ENTITIES.items():
        out = F.replace(out, F.lit(spelt), F.lit(plain))
    return F.when(F.contains(value, F.lit("&")), out).otherwise(value)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, begin, number, piece) of all XML files at a path: a file, a folder or a zip archive."""
    if path.lower().endswith(".zip"):
        spark.dataSource.register(ZippedXml)
        return spark.read.format(FORMAT).load(path)
    rows = spark.read.options(lineSep="<", recursiveFileLookup="true", pathGlobFilter="*.[xX][mM][lL]").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("number"), F.col("value").alias("piece"))


def elements(found: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(tag, attributes, file, begin, number) of the elements in pieces() with one of these names, whatever their case and prefix; attributes have names in capitals.

    Elements of a file come in the order of begin and number. What a comment holds counts too.
    """
    tag = F.upper(F.regexp_extract("piece", r"^(?:[\w.-]+:)?([\w.-]+)", 1))
    own = found.withColumn("tag", tag).filter(F.col("tag").isin(*tags))
    each = F.regexp_extract_all("piece", F.lit(r"""[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*')"""), F.lit(0))
    pair = lambda p: F.struct(F.upper(F.regexp_extract(p, r"^[\w:.-]+", 0)).alias("key"), _plain(F.regexp_extract(p, r"""(?s)=\s*.(.*).$""", 1)).alias("value"))
    # of attributes that differ in case only the last one holds
    pairs = F.transform(each, pair)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return own.select("tag", F.map_from_entries(last).alias("attributes"), "file", "begin", "number")
