"""Matching of read addresses with an official register of streets and houses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import text as T
from routeloom.functions.rules import REGION_CODES
from routeloom.functions.similarity import containing_pairs, similar_pairs, trigram_similarity
from routeloom.operators.graph import written


def object_rows(objects: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """objects with what the hierarchy (object_id, parent_object_id, region_code, path[, is_active], one row for each) knows of them.

    Parent, path and activity are the hierarchy's wherever it has the object, even where null
    there; an object's own region wins over the hierarchy's.
    """
    known = [c for c in ("parent_object_id", "path", "is_active") if c in hierarchy.columns and c in objects.columns]
    h = hierarchy.select("object_id", F.lit(True).alias("_met"), F.col("region_code").alias("_region_code"), *(F.col(c).alias(f"_{c}") for c in known))
    out = objects.join(h, "object_id", "left")
    made = {c: F.when(F.col("_met"), F.col(f"_{c}")).otherwise(F.col(c)) for c in known} | {"region_code": F.coalesce("region_code", "_region_code")}
    return out.withColumns(made).select(*objects.columns)


def in_regions(df: DataFrame, codes: list[str]) -> DataFrame:
    """Rows of the regions; all if none is named; rows without a region stay."""
    return df.filter(F.col("region_code").isNull() | F.col("region_code").isin(*codes)) if codes else df


def candidate_streets(names: DataFrame, streets: DataFrame, regions: list[str] | None = None, least: float = 0.25, top: int = 10) -> DataFrame:
    """Rows (street, object_id, full_name, region_code, exact, score, place) of the best register streets for each text names.street.

    A register street is a candidate if it is the text, holds its bare name, or its trigrams
    are similar beyond `least`. The joins run over distinct texts by rare trigrams; objects
    come in afterwards. Equal scores are decided by level, then object_id.
    """
    if "is_active" in streets.columns:
        streets = streets.filter("is_active AND is_actual")
    if regions:
        streets = streets.filter(F.col("region_code").isin(*regions))
    q = names.select("street").filter("street IS NOT NULL").distinct().withColumns({"lookup": T.lookup(F.col("street")), "bare": T.street_name(F.col("street"))})
    s = streets.select(F.lower("full_name").alias("f"), F.lower("name").alias("n")).distinct()
    # both are read by several joins: written once, they cost one reading of the addresses
    q, s = written(q), written(s)
    key = F.when(F.col("bare") != "", F.col("bare")).otherwise(F.col("lookup"))
    found = None
    for l, r, pairs in (
        (F.col("lookup"), "f", lambda a, b: similar_pairs(a, b, least).select("l", "r")),
        (F.col("bare"), "n", lambda a, b: similar_pairs(a, b, least).select("l", "r")),
        (key, "f", containing_pairs),
        (key, "n", containing_pairs),
    ):
        own = q.select("street", l.alias("l"))
        met = own.join(pairs(own, s.select(F.col(r).alias("r"))), "l").select("street", F.col("r").alias(r)).join(s, r).select("street", "f", "n")
        found = met if found is None else found.unionByName(met)
    scored = found.distinct().join(q, "street")
    exact = (F.col("f") == F.col("lookup")) | (F.col("n") == F.col("bare"))
    scored = scored.select("street", "f", "n", exact.alias("exact"), F.greatest(trigram_similarity(F.col("f"), F.col("lookup")), trigram_similarity(F.col("n"), F.col("bare"))).alias("score"))
    level = F.col("object_level") if "object_level" in streets.columns else F.lit(None).cast("int")
    rows = streets.select("object_id", "full_name", "region_code", level.alias("_level"), F.lower("full_name").alias("f"), F.lower("name").alias("n"))
    order = Window.partitionBy("street").orderBy(F.desc("exact"), F.desc("score"), F.desc_nulls_last("_level"), "object_id")
    out = scored.join(rows, ["f", "n"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    return out.select("street", "object_id", "full_name", "region_code", "exact", "score", "place")


def match_houses(wanted: DataFrame, houses: DataFrame, top: int = 10) -> DataFrame:
    """Rows (object_id, house, corpus, house_id, house_number, building_number, structure_number, exact, place): houses of a street that a number may mean.

    wanted has (object_id, house, corpus). A house is known by its number, and by number and
    building with or without a к between: each is a key, and keys are joined by equality.
    """
    num, bld = F.lower(F.coalesce("house_number", F.lit(""))), F.lower(F.coalesce("building_number", F.lit("")))
    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    with_k = bare(F.concat(num, F.lit("к"), bld))
    keys = F.array(F.struct(bare(num).alias("key"), F.lit(True).alias("alone")), F.struct(with_k.alias("key"), F.lit(False).alias("alone")), F.struct(bare(F.concat(num, bld)).alias("key"), F.lit(False).alias("alone")))
    if "is_active" in houses.columns:
        houses = houses.filter("is_active AND is_actual")
    h = houses.select(F.col("parent_object_id").alias("object_id"), "house_id", "house_number", "building_number", "structure_number", F.inline(keys))
    w = wanted.select("object_id", "house", "corpus").filter("house IS NOT NULL").distinct()
    whole = T.house_value(F.concat_ws(" корпус ", "house", "corpus"))
    w = w.select("object_id", "house", "corpus", F.inline(F.array(F.struct(T.house_value(F.col("house")).alias("key"), F.lit(True).alias("alone")), F.struct(whole.alias("key"), F.lit(False).alias("alone")))))
    met = w.join(h, ["object_id", "key", "alone"])
    met = met.groupBy("object_id", "house", "corpus", "house_id", "house_number", "building_number", "structure_number").agg(F.max("alone").alias("exact"))
    order = Window.partitionBy("object_id", "house", "corpus").orderBy(F.desc("exact"), "house_id")
    return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def house_display(house, building, structure):
    part = lambda word, x: F.concat(F.lit(word), F.nullif(x, F.lit("")))
    return F.when(F.length(house) > 0, F.concat_ws(" ", house, part("корп ", building), part("стр ", structure)))


def region_label(code):
    """Name of a region by its code, else the code."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in REGION_CODES.items() for x in kv)), code), F.nullif(code, F.lit("")))


def full_address(region_code, settlement, street, house):
    region = region_label(region_code)
    town = F.when(F.lower(settlement) != F.lower(F.coalesce(region, F.lit(""))), settlement)
    return F.concat_ws(", ", region, F.nullif(town, F.lit("")), street, F.concat(F.lit("д "), house))


def verdicts(requests: DataFrame, streets: DataFrame, houses: DataFrame, regions: list[str] | None = None) -> DataFrame:
    """requests (id, raw) with street, house, status, confidence, n_streets, n_houses and the best match's address and ids.

    Work is done once for each different street, and each different street with a house.
    """
    read = written(T.parsed(requests.select("id", "raw")).select("id", "street", "house", "corpus", "settlement", "clean"))
    found = written(candidate_streets(read, streets, regions))
    asked = read.select("street", "house", "corpus").distinct()
    own = asked.join(found, "street")
    met = _with_houses(own, match_houses(own, houses))
    first = F.min_by(F.struct("full_name", "region_code", "object_id", "house_id", house_display(F.col("house_number"), F.col("building_number"), F.col("structure_number")).alias("shown")), F.struct(F.col("house_id").isNull(), "place", "house_place"))
    best = met.groupBy("street", "house", "corpus").agg(F.count_distinct("object_id").alias("n_streets"), F.count("house_id").alias("n_houses"), first.alias("best"))
    out = read.join(best.withColumnsRenamed({"street": "_s", "house": "_h", "corpus": "_c"}), F.col("street").eqNullSafe(F.col("_s")) & F.col("house").eqNullSafe(F.col("_h")) & F.col("corpus").eqNullSafe(F.col("_c")), "left")
    streets_n, houses_n = F.coalesce("n_streets", F.lit(0)), F.coalesce("n_houses", F.lit(0))
    status = F.when(streets_n == 0, "not_found").when(F.col("house").isNull(), F.when(streets_n > 1, "ambiguous").otherwise("partial_match")).when(houses_n == 1, "exact_match").when(houses_n > 1, "ambiguous").otherwise("partial_match")
    sure = F.when(streets_n == 0, 0.0).when(F.col("house").isNull(), F.when(streets_n > 1, 0.6).otherwise(0.72)).when(houses_n == 1, 0.97).when(houses_n > 1, 0.74).otherwise(0.55)
    address = F.when(streets_n == 0, F.col("clean")).otherwise(full_address(F.col("best.region_code"), F.col("settlement"), F.col("best.full_name"), F.col("best.shown")))
    return out.select("id", "street", "house", status.alias("status"), sure.alias("confidence"), streets_n.alias("n_streets"), houses_n.alias("n_houses"), address.alias("address"), F.col("best.object_id").alias("object_id"), F.col("best.house_id").alias("house_id"))


def _with_houses(own: DataFrame, met: DataFrame) -> DataFrame:
    h = met.select(F.col("object_id").alias("_o"), F.col("house").alias("_h"), F.col("corpus").alias("_c"), "house_id", "house_number", "building_number", "structure_number", F.col("place").alias("house_place"))
    return own.join(h, (F.col("object_id") == F.col("_o")) & (F.col("house") == F.col("_h")) & F.col("corpus").eqNullSafe(F.col("_c")), "left").drop("_o", "_h", "_c")
