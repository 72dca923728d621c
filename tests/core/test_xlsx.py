"""Spreadsheets: round trips, books of other writers, and failures that leave nothing."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from routeloom.sources import sheets_xlsx


def test_round_trip(spark, tmp_path):
    rows = [("a", 0, ["№", "Адрес", None]), ("a", 1, ["1", "ул. <Мира> & \"5\"\n", " x "]), ("a", 5, [None, "", "\x01y"]), ("b", 0, [str(i) for i in range(60)]), ("b", 1, []), ("c", 3, None)]
    path = str(tmp_path / "out")
    sheets_xlsx.write_sheets(spark.createDataFrame(rows, "file string, row int, cells array<string>").repartition(4), path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.xlsx", "b.xlsx", "c.xlsx"]
    got = [tuple(r) for r in sheets_xlsx.read_sheets(spark, path).orderBy("file", "row").collect()]
    assert got == [
        ("a.xlsx", "Table", 0, ["№", "Адрес"]), ("a.xlsx", "Table", 1, ["1", "ул. <Мира> & \"5\"\n", " x "]), ("a.xlsx", "Table", 5, [None, "", "y"]),
        ("b.xlsx", "Table", 0, [str(i) for i in range(60)]), ("b.xlsx", "Table", 1, []), ("c.xlsx", "Table", 3, []),
    ]
    assert sheets_xlsx.read_sheets(spark, path + "/b.xlsx").count() == 2


def test_columns_have_letters():
    assert [sheets_xlsx.column_name(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(sheets_xlsx.column_number(sheets_xlsx.column_name(n)) == n for n in range(2000))


def test_shared_strings_and_numbers():
    main, rel = sheets_xlsx._MAIN, sheets_xlsx._RELATIONS
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="x"/><sheet name="Two" sheetId="2" r:id="y"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><A Id="x" Target="worksheets/s1.xml"/><A Id="y" Target="/xl/worksheets/s2.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c><v>2.5</v></c></row><row><c t="s"><v>0</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
    assert list(sheets_xlsx.read_book(out)) == [("One", 1, [None, "bc", "2.5"]), ("One", 2, ["a"])]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("t"), F.col("id") % 8).alias("file"), F.col("id").alias("row"), F.array(F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.lit("x"))).alias("cells"))
    with pytest.raises(Exception):
        sheets_xlsx.write_sheets(rows, str(tmp_path / "out"))
    assert not list((tmp_path).rglob("*.xlsx"))


def test_nothing_to_write_or_read(spark, tmp_path):
    sheets_xlsx.write_sheets(spark.createDataFrame([], "file string, row int, cells array<string>"), str(tmp_path / "out"))
    assert sheets_xlsx.read_sheets(spark, str(tmp_path / "out")).count() == 0
