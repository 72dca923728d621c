"""Register files: the last row counts wherever files are split, and archives give the same as folders."""

import zipfile
from itertools import permutations

import pytest

from routeloom.sources import register_xml, xml_records


def xml(tag, rows):
    return "\ufeff<?xml version='1.0'?>\n<R>" + "".join(f"<{tag} {r} />" for r in rows) + "</R>"


ITEMS = ['OBJECTID="10" PARENTOBJID="1" PATH="1.10" UPDATEDATE="2026"', 'objectid=\'10\' ParentObjId="2" path="a &gt; b &amp;#38; &#1052;&#x41; > c" UPDATEDATE="2001"', 'OBJECTID="10" PATH="z"', 'OBJECTID="20" PATH="1.20"']


@pytest.mark.parametrize("order", list(permutations(range(3))))
def test_the_last_row_of_a_file_counts(spark, tmp_path, order):
    (tmp_path / "AS_HIERARCHY.xml").write_text(xml("ns:item", [ITEMS[i] for i in order] + [ITEMS[3]]))
    got = {r.object_id: r.path for r in register_xml.hierarchy(spark, str(tmp_path)).collect()}
    assert got == {10: ["1.10", "a > b &#38; МA > c", "z"][order[-1]], 20: "1.20"}


def test_the_last_row_counts_in_split_files(spark, tmp_path):
    rows = [f'OBJECTID="{i % 50}" PATH="{i}"' for i in range(5000)]
    (tmp_path / "AS_HIERARCHY_1.xml").write_text(xml("ITEM", rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = register_xml.hierarchy(spark, str(tmp_path))
        assert xml_records.pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 5
        assert {r.object_id: r.path for r in found.collect()} == {i: str(4950 + i) for i in range(50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_archives_equal_folders(spark, tmp_path):
    files = {"x/AS_HIERARCHY_1.xml": xml("ITEM", [ITEMS[0], ITEMS[3]]), "x/AS_HIERARCHY_2.XML": xml("ITEM", [ITEMS[2]]), "AS_ADDR_OBJ.xml": xml("OBJECT", ['OBJECTID="10" NAME="Мира" TYPENAME="ул"', 'OBJECTID="20" NAME="Новая"']), "AS_HOUSES.xml": xml("HOUSE", ['OBJECTID="50" HOUSENUM="5" PARENTOBJID="10"'] * 3000), "notes.txt": "<ITEM OBJECTID='9'/>"}
    folder = tmp_path / "plain"
    with zipfile.ZipFile(tmp_path / "all.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            (folder / name).parent.mkdir(parents=True, exist_ok=True)
            (folder / name).write_text(text)
            z.writestr(name, text)
    for a, b in zip(register_xml.read_register(spark, str(folder)), register_xml.read_register(spark, str(tmp_path / "all.zip")), strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) != []


def test_an_archive_without_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("a.txt", "x")
    assert xml_records.pieces(spark, str(tmp_path / "none.zip")).count() == 0
