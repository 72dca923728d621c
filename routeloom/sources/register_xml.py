"""The official address register, read from its XML files or from a zip archive of them.

Files are told apart by name; rows are elements, whatever the case of their names, and all
attributes are read as text. Of several rows for one key the last in the last file counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators.register import in_regions, object_rows
from routeloom.sources import xml_records

#: The attributes that may hold a field; the first that isn't empty counts.
ITEM_FIELDS = {
    "object_id": ("OBJECTID", "OBJID", "ID"),
    "parent_object_id": ("PARENTOBJID", "PARENTOBJECTID", "PARENTID"),
    "region_code": ("REGIONCODE", "REGION_CODE"),
    "path": ("PATH",),
    "is_active": ("ISACTIVE",),
}
OBJECT_FIELDS = {
    "gar_id": ("OBJECTGUID", "AOGUID", "AOID", "GUID"),
    "object_id": ("OBJECTID", "OBJID", "ID"),
    "parent_object_id": ("PARENTOBJID", "PARENTID"),
    "object_level": ("LEVEL", "OBJECTLEVEL"),
    "name": ("NAME", "FORMALNAME", "OFFNAME"),
    "type_name": ("TYPENAME", "SHORTNAME", "TYPESHORTNAME"),
    "region_code": ("REGIONCODE", "REGION_CODE"),
    "is_actual": ("ISACTUAL",),
    "is_active": ("ISACTIVE",),
}
HOUSE_FIELDS = {
    "gar_id": ("OBJECTGUID", "HOUSEGUID", "AOGUID", "GUID"),
    "object_id": ("OBJECTID", "OBJID"),
    "house_id": ("HOUSEID", "ID"),
    "parent_object_id": ("PARENTOBJID", "PARENTID"),
    "house_number": ("HOUSENUM", "HOUSENUMBER", "HOUSE_NUM"),
    "building_number": ("ADDNUM1", "BUILDNUM", "BUILDINGNUM"),
    "structure_number": ("ADDNUM2", "STRUCNUM", "STRUCTURENUM"),
    "house_type": ("HOUSETYPE", "HOUSE_TYPE"),
    "building_type": ("ADDTYPE1", "BUILDTYPE"),
    "structure_type": ("ADDTYPE2", "STRUCTYPE"),
    "postcode": ("POSTALCODE", "POSTCODE"),
    "region_code": ("REGIONCODE", "REGION_CODE"),
    "is_actual": ("ISACTUAL",),
    "is_active": ("ISACTIVE",),
}
#: Short type words and what they stand for; words that say yes.
TYPE_WORDS = {"ул": "улица", "пр-кт": "проспект", "просп": "проспект", "пер": "переулок", "наб": "набережная", "пл": "площадь", "ш": "шоссе", "б-р": "бульвар", "бул": "бульвар"}
YES = ("1", "true", "t", "yes", "y")
_NUMBERS, _FLAGS = ("object_id", "house_id", "parent_object_id"), ("is_actual", "is_active")


def kind_of(file_name: Column) -> Column:
    """hierarchy, houses, objects or null, by the file's name; asked in this order."""
    holds = lambda *words: F.rlike(F.upper(file_name), F.lit("|".join(words)))
    return F.when(holds("HIERARCHY"), "hierarchy").when(holds("HOUSE"), "houses").when(holds("ADDR_OBJ", "ADDRESS_OBJECT", "OBJECTS"), "objects")


def _rows(spark: SparkSession, path: str, kind: str, tag: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    found = xml_records.pieces(spark, path)
    found = found.filter(kind_of(F.element_at(F.split("file", "/"), -1)) == kind)
    raw = xml_records.elements(found, (tag,))
    out = {}
    for field, options in fields.items():
        value = F.coalesce(*(F.nullif(F.element_at("attributes", F.lit(a)), F.lit("")) for a in options))
        if field in _NUMBERS:
            value = F.trim(value).try_cast("long")
        elif field == "object_level":
            value = F.trim(value).try_cast("int")
        elif field in _FLAGS:
            value = F.lower(F.trim(value)).isin(*YES)
        out[field] = value
    return raw.select(*(v.alias(k) for k, v in out.items()), F.struct("file", "begin", "number").alias("_place"))


def _last(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key: the last one of the last file by name."""
    rest = [c for c in rows.columns if c not in (key, "_place")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_place").alias("r")).select(key, "r.*")


def hierarchy(spark: SparkSession, path: str, regions: list[str] | None = None) -> DataFrame:
    """(object_id, parent_object_id, region_code, path, is_active), one row for each object; rows without a region belong to all."""
    rows = in_regions(_rows(spark, path, "hierarchy", "ITEM", ITEM_FIELDS).filter("object_id IS NOT NULL"), regions or [])
    return _last(rows.withColumn("is_active", F.coalesce("is_active", F.lit(True))), "object_id")


def type_word(x: Column) -> Column:
    """A type's whole word: short forms spelt out, whatever their case and dots; an unknown type as it is given."""
    words = F.create_map(*(F.lit(w) for pair in TYPE_WORDS.items() for w in pair))
    return F.coalesce(F.element_at(words, F.lower(F.replace(F.trim(x), F.lit("."), F.lit("")))), F.nullif(F.trim(x), F.lit("")))


#: Names for the codes of regions.
REGION_NAMES = {"spb": ["78"], "saint_petersburg": ["78"], "sankt_peterburg": ["78"], "lenobl": ["47"], "lenoblast": ["47"], "spb_lenobl": ["78", "47"]}


def region_codes(region: str | None) -> list[str]:
    """Codes of a name, or of a list with commas or semicolons; numbers have two digits."""
    value = (region or "").strip().lower().replace("-", "_")
    parts = [p.strip() for p in value.replace(";", ",").split(",")]
    return REGION_NAMES.get(value) or [p.zfill(2) if p.isdigit() else p for p in parts if p]


def full_name(name: Column, kind: Column) -> Column:
    """The type before the name, unless the name begins with it."""
    return F.when(kind.isNull() | F.startswith(F.lower(name), F.concat(F.lower(kind), F.lit(" "))), name).otherwise(F.concat_ws(" ", kind, name))


def objects(spark: SparkSession, path: str, items: DataFrame, regions: list[str] | None = None) -> DataFrame:
    """Streets, settlements and the like, one row for each object_id, with what the hierarchy knows of them."""
    rows = _rows(spark, path, "objects", "OBJECT", OBJECT_FIELDS).filter("object_id IS NOT NULL AND name IS NOT NULL")
    rows = _last(rows, "object_id").withColumns({"name": F.trim("name"), "type_name": type_word(F.col("type_name")), "path": F.lit(None).cast("string")})
    rows = rows.withColumn("full_name", full_name(F.col("name"), F.col("type_name")))
    return in_regions(_flagged(object_rows(rows, items)), regions or [])


def houses(spark: SparkSession, path: str, items: DataFrame, regions: list[str] | None = None) -> DataFrame:
    """Houses, one row for each house_id (the object's id where a house has none of its own)."""
    rows = _rows(spark, path, "houses", "HOUSE", HOUSE_FIELDS).withColumn("house_id", F.coalesce(F.nullif("house_id", F.lit(0)), "object_id"))
    rows = _last(rows.filter("house_id IS NOT NULL"), "house_id").withColumn("path", F.lit(None).cast("string"))
    return in_regions(_flagged(object_rows(rows, items)).drop("path"), regions or [])


def _flagged(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.lit(True)) for c in _FLAGS})


def read_register(spark: SparkSession, path: str, regions: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, houses) of all register files beneath a folder."""
    items = hierarchy(spark, path, regions)
    return objects(spark, path, items, regions), houses(spark, path, items, regions)
