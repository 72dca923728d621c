"""Address lists, reports, images, places and HTML tables as DataFrames, and the writers of reports and tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of images that are taken in, names of report files, the bound of low confidence.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp")
REPORT_FILES = "poi_{import,low_confidence,duplicates}_*.csv"
ENRICHED = "_reverse_geocoded_"
LOW_CONFIDENCE = 0.75
#: The columns of a report.
REPORT_COLUMNS = ("canonical_brand", "name", "address", "latitude", "longitude", "confidence_score", "warnings", "osm_type", "osm_id", "source", "is_duplicate")


def address_list(spark: SparkSession, path: str) -> DataFrame:
    """(address) of a text file's lines; blank ones and those that begin with # go, and none left is an error."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("address")).filter((F.col("address") != "") & ~F.startswith("address", F.lit("#")))
    if rows.isEmpty():
        raise ValueError(f"no addresses in {path}")
    return rows


def chains(spark: SparkSession, path: str) -> DataFrame:
    """(brand, alias, ord) of a JSON-lines file of chains (brand, aliases), for detect_brands."""
    rows = spark.read.schema("brand string, aliases array<string>, ord long").json(path)
    return rows.select("brand", F.posexplode("aliases").alias("n", "alias"), "ord").select("brand", "alias", (F.coalesce("ord", F.lit(0)) * 1000 + F.col("n")).alias("ord"))


def places(spark: SparkSession, path: str) -> DataFrame:
    """Map objects taken out of a map extract: (osm_type, osm_id, tags, lat, lon), Parquet, nodes and ways with coordinates."""
    rows = spark.read.parquet(path).select("osm_type", "osm_id", "tags", "lat", "lon")
    return rows.filter(F.col("osm_type").isin("node", "way") & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a folder's CSV reports, all columns text, with the file's name; those enriched before are left out."""
    rows = spark.read.options(header="true", multiLine="true", escape='"', pathGlobFilter=REPORT_FILES, recursiveFileLookup="true").csv(folder)
    return rows.select("*", F.col("_metadata.file_name").alias("report")).filter(~F.contains("report", F.lit(ENRICHED)))


def json_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of JSON reports; a report without a list of items is an error."""
    rows = spark.read.option("multiLine", "true").schema(f"items array<struct<{schema}>>").json(path)
    whole = F.when(F.col("items").isNull(), F.raise_error(F.lit("a report has no list of items"))).otherwise(F.col("items"))
    return rows.select(F.inline(whole))


def images(spark: SparkSession, folder: str, most_bytes: int) -> DataFrame:
    """(path, name, length, modificationTime, content, error) of a folder's files; contents are read only where `content` is asked for. Spark lists no empty files, so they give no row."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    error = F.when(~suffix.isin(*IMAGE_SUFFIXES), "UNSUPPORTED_TYPE").when(F.col("length") > most_bytes, "TOO_LARGE")
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime", "content", error.alias("error"))


def newest_folder(files: DataFrame) -> DataFrame:
    """Files of the folder whose newest file is the newest of all; the one row that names it comes from an aggregate."""
    of = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    last = files.agg(F.max_by(of, F.struct("modificationTime", "path")).alias("_f"))
    return files.withColumn("_f", of).join(F.broadcast(last), "_f", "left_semi").drop("_f")  # one row


class _Rows(HTMLParser):
    """Texts of the cells of each table's rows; an inner table is a table of its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell = [False]

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
            self.cell.append(False)
        elif self.open and tag == "tr":
            self.open[-1].append([])
            self.cell[-1] = False
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append("")
            self.cell[-1] = True

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
            self.cell.pop()
        elif tag in ("td", "th", "tr"):
            self.cell[-1] = False

    def handle_data(self, data):
        if self.cell[-1]:
            self.open[-1][-1][-1] += data


def _table_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for key, html in zip(b.iloc[:, 0], b.iloc[:, 1]):
            p = _Rows()
            p.feed(html or "")
            p.close()
            for t, rows in enumerate(p.tables):
                out += [(key, t, r, [" ".join(c.split()) for c in cells]) for r, cells in enumerate(x for x in rows if x)]
        yield pd.DataFrame(out, columns=[b.columns[0], "tbl", "row", "cells"])


def intake(found: DataFrame, most: int) -> DataFrame:
    """images() whose folders are uploads: with more than `most` files, all of an upload have the error TOO_MANY_FILES."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    n = found.groupBy(folder.alias("_folder")).agg(F.count("*").alias("_n"))
    both = found.withColumn("_folder", folder).join(n, "_folder")
    return both.withColumn("error", F.when(F.col("_n") > most, "TOO_MANY_FILES").otherwise(F.col("error"))).select(*found.columns)


def html_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, tbl, row, cells) of all tables of HTML texts; rows without cells go, null texts have none."""
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(_table_rows, f"{key} {kind}, tbl int, row int, cells array<string>")


def markdown_row(cells: Column) -> Column:
    """One line of a Markdown table: bars within cells escaped, line breaks made spaces."""
    clean = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def report_rows(candidates: DataFrame) -> DataFrame:
    """Candidates (brand, original_address, lat, lon, ...) as rows of a report: its fixed columns, empty where candidates have none."""
    named = {"canonical_brand": "brand", "address": "original_address", "latitude": "lat", "longitude": "lon"}
    return candidates.select(*(F.col(named.get(c, c)).alias(c) if named.get(c, c) in candidates.columns else F.lit(None).cast("string").alias(c) for c in REPORT_COLUMNS))


def write_delimited(rows: DataFrame, path: str, sep: str = ",", mark: bool = False) -> None:
    """CSV with a header; lists become their items joined by ;. With mark, files begin with the byte order mark by which spreadsheets know UTF-8."""
    if mark:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    flat = [F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array<") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.options(header="true", sep=sep, escape='"').csv(path)


def write_place_reports(items: DataFrame, folder: str, stamp: str) -> dict[str, str]:
    """Writes all items as JSON and CSV, duplicates and those of low confidence as CSV; the paths by kind. The stamp is given, no clock is read."""
    out = {"json": f"{folder}/poi_import_{stamp}.json", "csv": f"{folder}/poi_import_{stamp}.csv", "duplicates_csv": f"{folder}/poi_duplicates_{stamp}.csv", "low_confidence_csv": f"{folder}/poi_low_confidence_{stamp}.csv"}
    items.write.json(out["json"])
    write_delimited(items, out["csv"], mark=True)
    write_delimited(items.filter("is_duplicate"), out["duplicates_csv"], mark=True)
    write_delimited(items.filter(F.col("confidence_score") < LOW_CONFIDENCE), out["low_confidence_csv"], mark=True)
    return out


def enriched_path(path: str, stamp: str) -> str:
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}{ENRICHED}{stamp}.{suffix}" if dot else f"{path}{ENRICHED}{stamp}"


def with_columns_of(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """rows with the wanted columns that they lack, empty, at the end."""
    return rows.select("*", *(F.lit("").alias(c) for c in wanted if c not in rows.columns))
