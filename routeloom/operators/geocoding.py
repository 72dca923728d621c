"""Scores and states of geocoder candidates, the attempts that led to them, and cached addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import geo
from routeloom.functions import text as T
from routeloom.functions.rules import CITY, REGION, WORK_AREA
from routeloom.operators.graph import written


def _apart(folded: Column) -> Column:
    """A text between blanks, its blanks, commas and slashes made blanks: what stands between two of them is bounded."""
    return F.concat(F.lit(" "), F.regexp_replace(folded, r"(?U)[\s,/]", " "), F.lit(" "))


def _holds_house(house: Column, apart: Column, display: Column, display_apart: Column) -> Column:
    # a house whose own sign is a bound must stand as it is, too
    return F.contains(display, house) & F.contains(display_apart, apart)


def house_matches(house: Column, display: Column, raw_house: Column | None = None) -> Column:
    """Whether a candidate has the house asked for: in its own field, or bounded in its name. No house asked for matches all."""
    h, d = T.folded(house), T.folded(display)
    own = F.coalesce(T.folded(raw_house) == h, F.lit(False)) if raw_house is not None else F.lit(False)
    return F.coalesce(F.length(house) == 0, F.lit(True)) | own | F.coalesce(_holds_house(h, _apart(h), d, _apart(d)), F.lit(False))


def provider_score(provider: Column, importance: Column, confidence: Column) -> Column:
    return F.when(provider == "opencage", F.least(F.coalesce(confidence, F.lit(0)) * 6.0, F.lit(45.0))).otherwise(F.least(F.coalesce(importance, F.lit(0.0)) * 40.0, F.lit(35.0)))


_ASKED, _OFFERED = ("_tokens", "_first", "_house", "_house_apart", "_hint"), ("_d", "_d_apart")


def asked(requests: DataFrame) -> DataFrame:
    """requests (query, street, house, region_hint) with what scores read of them, worked out once for each."""
    h = T.folded(F.col("house"))
    first = F.slice(T.significant(F.coalesce("street", F.lit(""))), 1, 2)
    return requests.withColumns(dict(zip(_ASKED, (T.significant(F.col("query")), first, h, _apart(h), T.folded(F.coalesce("region_hint", F.lit("")))), strict=True)))


def offered(candidates: DataFrame) -> DataFrame:
    """candidates (display) with what scores read of them."""
    d = T.folded(F.coalesce("display", F.lit("")))
    return candidates.withColumns({"_d": d, "_d_apart": _apart(d)})


def candidate_score(df: DataFrame) -> DataFrame:
    """df with house_match, distance_m and score (0 to 100).

    df has query, display, provider, importance, confidence, place_rank, street, house,
    region_hint, lat, lon, and the search area's area_lat, area_lon, area_km. It may have come
    through asked() and offered() before both sides were joined.
    """
    if "_tokens" not in df.columns:
        df = asked(df)
    if "_d" not in df.columns:
        df = offered(df)
    d, h, hint = F.col("_d"), F.col("_house"), F.col("_hint")
    held = F.size(F.filter("_tokens", lambda t: F.contains(d, t))) * 4.0
    rank = F.when(F.col("place_rank") >= 30, 10.0).when((F.col("place_rank") <= 26) & (F.length("house") > 0), -20.0).otherwise(0.0)
    street = F.when((F.size("_first") > 0) & F.forall("_first", lambda t: F.contains(d, t)), 12.0).otherwise(0.0)
    house = F.when(F.length("house") > 0, F.when(F.col("house_match"), 25.0).otherwise(-35.0)).otherwise(0.0)
    region = (
        F.when(F.length(hint) == 0, 0.0)
        .when(F.contains(hint, F.lit("санкт")) & F.contains(d, F.lit("петербург")), 10.0)
        .when(F.contains(hint, F.lit("ленинград")) & F.contains(d, F.lit("ленинградская область")), 10.0)
        .when(F.contains(d, F.lit("россия")), -5.0)
        .otherwise(0.0)
    )
    inside = F.coalesce(geo.in_box("lat", "lon", WORK_AREA), F.lit(False))
    metres = F.when(inside, geo.haversine("lat", "lon", "area_lat", "area_lon"))
    near = F.when(F.col("lat").isNull() | F.col("lon").isNull(), 0.0).when(~inside, -50.0).otherwise(F.when(F.col("distance_m") <= F.col("area_km") * 1000, 20.0).otherwise(-20.0) + F.when(F.col("distance_m") <= 3000, 10.0).otherwise(0.0))
    own = F.coalesce(T.folded(F.col("raw_house")) == h, F.lit(False)) if "raw_house" in df.columns else F.lit(False)
    match = F.coalesce(F.length("house") == 0, F.lit(True)) | own | F.coalesce(_holds_house(h, F.col("_house_apart"), d, F.col("_d_apart")), F.lit(False))
    df = df.withColumns({"house_match": match, "distance_m": metres})
    total = 30.0 + held + provider_score(F.col("provider"), F.col("importance"), F.col("confidence")) + rank + street + house + region + near
    return df.withColumn("score", F.greatest(F.lit(0.0), F.least(total, F.lit(100.0)))).drop(*_ASKED, *_OFFERED)


def best_candidates(scored: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """The row of the highest score for each key, the first of equal ones, and its status."""
    rest = [c for c in scored.columns if c not in keys]
    best = scored.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("score", -F.col(position))).alias("b")).select(*keys, "b.*")
    status = F.when(F.col("score") < 35, "not_found").when((F.col("score") >= 80) & F.col("house_match"), "found").otherwise("ambiguous")
    return best.withColumn("status", status)


def first_status(candidates: DataFrame, keys: list[str], position: str = "pos", gap: float = 0.02) -> DataFrame:
    """(keys, importance, status) of each key's first candidate: ambiguous if the second one's importance, both being known, is less than `gap` away, else found."""
    order = Window.partitionBy(*keys).orderBy(position)
    two = candidates.select(*keys, "importance", F.row_number().over(order).alias("n")).filter("n <= 2")
    own = two.groupBy(*keys).agg(F.max(F.when(F.col("n") == 1, F.col("importance"))).alias("importance"), F.max(F.when(F.col("n") == 2, F.col("importance"))).alias("_second"))
    close = F.coalesce(F.abs(F.col("importance") - F.col("_second")) < gap, F.lit(False))
    return own.select(*keys, "importance", F.when(close, "ambiguous").otherwise("found").alias("status"))


def best_for_requests(requests: DataFrame, candidates: DataFrame, on: list[str]) -> DataFrame:
    """The best candidate (see candidate_score) for each request, with its columns, score and status.

    requests have id and what they ask for (query, street, house, region_hint, the area); candidates
    share the columns `on` with them, have a place in order `pos` and what else scores are made
    of. Requests that ask for the same are scored once, and only a row's place and score take
    part in the choice: the candidate's columns come back to it by `on` and `pos`.
    """
    ask = [c for c in requests.columns if c != "id"]
    one = written(asked(requests.select(*ask).distinct().withColumn("_ask", F.monotonically_increasing_id())))
    scored = candidate_score(one.join(offered(candidates), on)).select("_ask", "pos", "score", "house_match", "distance_m")
    best = best_candidates(scored, ["_ask"])
    same = None
    for c in ask:
        cond = F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
        same = cond if same is None else same & cond
    chosen = one.select("_ask", *ask).join(best, "_ask").join(candidates, [*on, "pos"])
    return requests.alias("r").join(chosen.drop("_ask").alias("o"), same).select("r.id", "o.*")


def attempts_until_sure(attempts: DataFrame) -> DataFrame:
    """The attempts (id, pos, query, score, house_match) that a search makes before it stops, with `selected` for the best.

    A search stops after the first attempt with a score of 90 and the house; of those made, the
    highest score is selected, the first of equal ones.
    """
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sure = F.coalesce((F.col("score") >= 90) & F.col("house_match"), F.lit(False))
    made = attempts.withColumn("_s", F.coalesce(F.max(sure).over(w), F.lit(False))).filter("NOT _s").drop("_s")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc_nulls_last("score"), "pos"))
    return made.withColumn("selected", (best == 1) & F.col("score").isNotNull())


def simple_confidence(query: Column, display: Column, importance: Column) -> Column:
    """5 for each of the query's tokens that the name holds, up to 20 for importance, 99 at most."""
    d = T.folded(display)
    tokens = F.filter(F.split(T.folded(query), r"(?U)[\s,]+"), lambda t: F.length(t) > 2)
    return F.least(F.lit(50.0) + F.size(F.filter(tokens, lambda t: F.contains(d, t))) * 5.0 + F.least(F.coalesce(importance, F.lit(0.0)) * 30.0, F.lit(20.0)), F.lit(99.0))


def query_variants(parsed: DataFrame) -> DataFrame:
    """(id, pos, query, priority, note) for parsed addresses (id, clean, region, settlement): what a geocoder is asked, the most promising first.

    Of equal texts the first one stays.
    """
    rest, bare = T.without_region(F.col("clean")), T.without_settlement(F.col("clean"), F.coalesce("settlement", F.lit("")))
    squeezed = lambda q: F.btrim(F.regexp_replace(q, r"(?U)\s+", " "), F.lit(" ,"))
    one = lambda q, p, note: F.struct(squeezed(q).alias("query"), F.lit(p).alias("priority"), F.lit(note).alias("note"))
    both = lambda place, x, p, note: [one(F.concat_ws(", ", F.lit(place), x), p, note), one(F.concat_ws(", ", x, F.lit(place)), p - 5, note + "_suffix")]
    from routeloom.functions.rules import CITY_SETTLEMENTS, REGION_SETTLEMENTS

    town = F.concat_ws(", ", "settlement", bare)
    raw = one(F.col("clean"), 10, "raw")
    made = (
        F.when(F.col("settlement").isin(*CITY_SETTLEMENTS), F.array(*both(CITY, town, 120, "spb_settlement"), raw))
        .when(F.col("settlement").isin(*REGION_SETTLEMENTS), F.array(*both(REGION, town, 120, "lenobl_settlement"), raw))
        .when(F.col("region") == CITY, F.array(*both(CITY, rest, 110, "explicit_spb"), raw))
        .when(F.col("region") == REGION, F.array(*both(REGION, rest, 110, "explicit_lenobl"), raw))
        .otherwise(F.array(*both(CITY, rest, 80, "default_spb"), one(F.concat_ws(", ", F.lit(REGION), rest), 70, "lenobl_fallback"), raw))
    )
    each = parsed.select("id", F.posexplode(made).alias("at", "q")).select("id", "at", "q.*").filter("query <> ''")
    first = F.row_number().over(Window.partitionBy("id", "query").orderBy("at"))
    kept = each.withColumn("_n", first).filter("_n = 1").drop("_n")
    return kept.select("id", (F.row_number().over(Window.partitionBy("id").orderBy(F.desc("priority"), "at")) - 1).alias("pos"), "query", "priority", "note")


def usable_cached(rows: DataFrame) -> DataFrame:
    """Cached rows that answer a request: found, with a place in the work area."""
    return rows.filter((F.col("status") == "found") & F.coalesce(geo.in_box("lat", "lon", WORK_AREA), F.lit(False)))


def failures(rows: DataFrame) -> DataFrame:
    """(job, code, failed) for geocoded rows (job, status): the gravest reason why a job can't be planned, null if none."""
    has = lambda s: F.max(F.col("status") == s)
    code = F.when(has("provider_error"), "GEOCODING_PROVIDER_ERROR").when(has("not_found"), "ADDRESS_NOT_FOUND").when(has("ambiguous"), "ADDRESS_AMBIGUOUS")
    return rows.groupBy("job").agg(code.alias("code"), F.count_if(F.col("status") != "found").alias("failed"))
