"""Routes by addresses, end to end: roles, chosen places, what failed, order, batches, links, and one nested answer for each job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import geo, rules
from routeloom.functions.scalars import rounded
from routeloom.operators import routes
from routeloom.operators.graph import written

# Messages of a job whose addresses can't all be used.
AMBIGUOUS, UNREACHED = "Некоторые адреса найдены неоднозначно.", "Не удалось выполнить резервное геокодирование."
ROLE_MESSAGES = {"start": "Начальный адрес не найден.", "end": "Конечный адрес не найден.", "waypoint": "Один или несколько промежуточных адресов не найдены."}
ANY_MESSAGE = "Некоторые адреса не удалось обработать."
REASONS = {
    "ambiguous": "Адрес найден неоднозначно. Проверьте область поиска или уточните дом.",
    "error": "Сбой геокодера. Проверьте настройки провайдера или повторите попытку.",
    "not_found": "Адрес не найден геокодером.",
}


def prepared(jobs: DataFrame) -> DataFrame:
    """(job, role, original_index, address) of jobs (job, start_address, addresses, end_address): the start is 0, stops count from 1, the end comes last."""
    every = F.concat(F.array(F.col("start_address")), F.coalesce("addresses", F.array().cast("array<string>")), F.array(F.col("end_address")))
    rows = jobs.select("job", F.size(every).alias("_n"), F.posexplode(every).alias("original_index", "address"))
    role = F.when(F.col("original_index") == 0, "start").when(F.col("original_index") == F.col("_n") - 1, "end").otherwise("waypoint")
    return rows.select("job", role.alias("role"), "original_index", "address")


def with_chosen(rows: DataFrame, chosen: DataFrame, results: DataFrame) -> DataFrame:
    """Prepared rows with id, lat, lon, status, provider, confidence, display_name, source, error: of the place that the user chose (job, original_index, ...), else of the geocoder's result for the address (address, ...)."""
    fields = ("id", "lat", "lon", "status", "provider", "confidence", "display_name", "error")
    c = chosen.select("job", "original_index", F.struct(*(F.col(f) if f in chosen.columns else F.lit(None).cast("string").alias(f) for f in fields)).alias("c"))
    g = results.select("address", F.struct(*fields).alias("g"))
    both = rows.join(c, ["job", "original_index"], "left").join(g, "address", "left")
    took = F.col("c").isNotNull()
    state = F.coalesce(F.col("c.status"), F.lit("found"))
    own = {
        "status": F.when(took, F.when(state.isin("not_found", "error"), state).otherwise("found")).otherwise(F.coalesce("g.status", F.lit("not_found"))),
        "provider": F.when(took, "nominatim").otherwise(F.col("g.provider")),
        "error": F.when(~took, F.col("g.error")),
    }
    out = [own[f].alias(f) if f in own else F.when(took, F.col(f"c.{f}")).otherwise(F.col(f"g.{f}")).alias(f) for f in fields]
    return both.select("job", "role", "original_index", "address", *out, F.when(took, "selected").otherwise("geocoder").alias("source"))


def failed(rows: DataFrame) -> DataFrame:
    """Rows without coordinates or not found, with code, message and reason."""
    bad = rows.filter(~(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.coalesce(F.col("status").isin("found", "manual"), F.lit(False))))
    s, error = F.col("status"), F.nullif("error", F.lit(""))
    code = F.when(s == "ambiguous", "ADDRESS_AMBIGUOUS").when(s == "error", "ADDRESS_GEOCODER_ERROR").otherwise("ADDRESS_NOT_FOUND")
    message = F.coalesce(error, F.when(s == "ambiguous", "Address was resolved ambiguously").otherwise("Address coordinates were not found"))
    reason = F.when(s == "ambiguous", REASONS["ambiguous"]).when(s == "error", F.coalesce(error, F.lit(REASONS["error"]))).otherwise(REASONS["not_found"])
    return bad.select("job", "role", "original_index", "address", "status", code.alias("code"), message.alias("error"), reason.alias("reason"))


def failure_of_jobs(failures: DataFrame) -> DataFrame:
    """(job, code, message, failed): what a job's failures amount to, the gravest first."""
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    flags = {"a": has(F.col("code") == "ADDRESS_AMBIGUOUS"), "e": has(F.col("code") == "ADDRESS_GEOCODER_ERROR")} | {r: has(F.col("role") == r) for r in ROLE_MESSAGES}
    j = failures.groupBy("job").agg(F.count("*").alias("failed"), *(v.alias(f"_{k}") for k, v in flags.items()))
    roles = sum((F.col(f"_{r}").cast("int") for r in ROLE_MESSAGES), F.lit(0))
    code, message = F.when(F.col("_a"), "ADDRESS_REVIEW_REQUIRED").when(F.col("_e"), "GEOCODER_ERROR"), F.when(F.col("_a"), AMBIGUOUS).when(F.col("_e"), UNREACHED)
    for r, text in ROLE_MESSAGES.items():
        code, message = code.when(F.col(f"_{r}") & (roles == 1), f"{r.upper()}_ADDRESS_NOT_FOUND"), message.when(F.col(f"_{r}") & (roles == 1), text)
    return j.select("job", code.otherwise("ADDRESS_NOT_FOUND").alias("code"), message.otherwise(ANY_MESSAGE).alias("message"), "failed")


#: Columns of a job's row that may say which district it is in; the last is a label for what has no address.
DISTRICT_TEXTS = ("address", "original_address", "normalized_address", "address_for_geocoding", "display_name")


def district_text(rows: DataFrame) -> Column:
    """What a row's texts say, one after another; columns that rows haven't, null and empty ones are left out."""
    return F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in DISTRICT_TEXTS if c in rows.columns))


def points(rows: DataFrame) -> DataFrame:
    """(job, stop, type, lat, lon, district) of jobs whose addresses all have a place, one start and one end; the others are left out (see failed)."""
    near = geo.district("lat", "lon", district_text(rows), list(rules.DISTRICT_HINTS), list(rules.DISTRICT_BOXES))
    ok = rows.groupBy("job").agg(F.min(F.coalesce(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("status").isin("found", "manual"), F.lit(False))).alias("_ok"), F.count_if(F.col("role") == "start").alias("_s"), F.count_if(F.col("role") == "end").alias("_e"))
    fit = ok.filter("_ok AND _s = 1 AND _e = 1").select("job")
    return rows.join(fit, "job", "left_semi").select("job", F.col("original_index").cast("int").alias("stop"), F.col("role").alias("type"), "lat", "lon", near.alias("district"))


def both_matrices(durations: DataFrame, distances: DataFrame) -> DataFrame:
    """(job, error): the first rule that a job's durations, then its distances, break, or that they don't speak of the same points; null if none."""
    a, b = (routes.check_matrix(m).select("job", F.col("points").alias(f"{n}_points"), F.col("error").alias(n)) for n, m in (("durations", durations), ("distances", distances)))
    both = a.join(b, "job", "full_outer")
    named = lambda n: F.when(F.col(f"{n}_points").isNull(), f"{n}: missing").when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}: "), F.col(n)))
    return both.select("job", F.coalesce(named("durations"), named("distances"), F.when(F.col("durations_points") != F.col("distances_points"), "sizes differ")).alias("error"))


def optimised(durations: DataFrame, distances: DataFrame, by: str = "duration") -> tuple[DataFrame, DataFrame]:
    """(order (job, ord, stop), totals): stops ordered by one of the two matrices, and what that saves in duration against the first order.

    totals: job, points, distance_m, duration_s, initial_s, saved_s, saved_percent, all to two
    decimals. Jobs with an invalid matrix have neither (see both_matrices).
    """
    if by not in ("duration", "distance"):
        raise ValueError("by must be duration or distance")
    plan = written(_planned(durations, distances, by))
    return plan.select("job", "ord", "stop"), _totals(plan)


def _planned(durations: DataFrame, distances: DataFrame, by: str) -> DataFrame:
    """(job, ord, stop, duration, distance, initial): what the leg to the next stop costs, and what that of the first order takes; jobs with an invalid matrix left out."""
    plan = routes.planned([durations, distances], ("duration", "distance").index(by))
    cost = lambda c: F.when(~F.isnan(c), F.col(c))
    return plan.select("job", "ord", "stop", cost("cost0").alias("duration"), cost("cost1").alias("distance"), cost("first0").alias("initial"))


def _totals(plan: DataFrame) -> DataFrame:
    t = plan.groupBy("job").agg(F.count("*").alias("points"), *(F.sum(c).alias(c) for c in ("distance", "duration", "initial"))).filter("points > 1")
    saved = F.greatest(F.lit(0.0), F.col("initial") - F.col("duration"))
    share = F.when(F.col("initial") > 0, saved / F.col("initial") * 100).otherwise(0.0)
    return t.select("job", "points", rounded(F.col("distance")).alias("distance_m"), rounded(F.col("duration")).alias("duration_s"), rounded(F.col("initial")).alias("initial_s"), rounded(saved).alias("saved_s"), rounded(share).alias("saved_percent"))


def legs_match(order: DataFrame, legs: DataFrame) -> DataFrame:
    """(job, error): whether legs (job, from_order, to_order) are each pair of neighbours in an order (job, ord) once and nothing else."""
    w = Window.partitionBy("job").orderBy("ord")
    want = order.select("job", F.col("ord").alias("from_order"), F.lead("ord").over(w).alias("to_order"), F.lit(1).alias("w"))
    have = legs.groupBy("job", "from_order", "to_order").agg(F.count("*").alias("h"))
    both = want.filter("to_order IS NOT NULL").join(have, ["job", "from_order", "to_order"], "full_outer")
    wrong = F.col("w").isNull() | F.col("h").isNull() | (F.col("h") > 1)
    return both.groupBy("job").agg(F.when(F.max(wrong), "legs do not match ordered_points").alias("error"))


def answer(rows: DataFrame, durations: DataFrame, distances: DataFrame, base: str, slug: str = "", by: str = "duration", size: int = 15, by_district: bool = True, default_slug: str = "") -> DataFrame:
    """One row for each job that can be planned: totals, ordered_points, legs, batches with links, and the batches' different warnings in order.

    rows are with_chosen()'s; the matrices' points are the rows' original_index.
    """
    p = written(points(rows))
    if by not in ("duration", "distance"):
        raise ValueError("by must be duration or distance")
    can = p.select("job").distinct()
    plan = written(_planned(*(m.join(can, "job", "left_semi") for m in (durations, distances)), by))
    order, totals = plan.select("job", "ord", "stop"), _totals(plan)
    placed = written(order.join(p, ["job", "stop"]))
    ordered = placed.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("ord", "type", F.col("stop").alias("original_index"), "lat", "lon", "district"))).alias("ordered_points"))
    last = F.max("ord").over(Window.partitionBy("job"))
    both = plan.withColumn("_last", last).filter("ord < _last").select("job", F.col("ord").alias("from_order"), (F.col("ord") + 1).alias("to_order"), F.col("duration").alias("cost"), F.col("distance").alias("m"))
    leg_s = both.select("job", "from_order", "to_order", "cost")
    steps = both.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("from_order", "to_order", rounded(F.col("m")).alias("distance_m"), rounded(F.col("cost")).alias("duration_s")))).alias("legs"))
    cut = written(routes.batches(placed.select("job", "ord", "type", "district"), size, by_district))
    where = placed.select("job", "ord", "lat", "lon", F.col("stop").alias("original_index"))
    sums = routes.batch_totals(cut, leg_s).withColumnRenamed("cost", "duration_s").join(routes.batch_totals(cut, both.select("job", "from_order", "to_order", F.col("m").alias("cost"))).select("job", "batch", F.col("cost").alias("distance_m")), ["job", "batch"])
    stops = cut.join(where, ["job", "ord"])
    listed = stops.groupBy("job", "batch").agg(F.array_sort(F.collect_list(F.struct("place", "ord", "original_index", "lat", "lon", "is_transition"))).alias("stops"))
    links = routes.links(stops, base, slug, default_slug)
    whole = sums.join(listed, ["job", "batch"]).join(links, ["job", "batch"], "left")
    one = F.struct("batch", "points", "district", "districts", "distance_m", "duration_s", F.length("url").alias("url_length"), (F.size("warnings") > 0).alias("has_warning"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), "url", "stops")
    batches = whole.groupBy("job").agg(F.array_sort(F.collect_list(one)).alias("batches"))
    out = totals.join(ordered, "job").join(steps, "job").join(batches, "job")
    said = F.array_distinct(F.flatten(F.transform("batches", lambda b: b["warnings"])))
    status = F.when(F.size(said) > 0, "completed_with_warnings").otherwise("completed")
    return written(out.select("*", said.alias("warnings"), status.alias("status")))


def tables(answers: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, batches, points) to append: a row for each job with its first start's and end's address, for each batch, and for each ordered point with the leg before it and its batch."""
    role = lambda r: F.min_by("id", F.when((F.col("role") == r) & F.col("id").isNotNull(), F.col("original_index")))
    ends = rows.groupBy("job").agg(role("start").alias("start_id"), role("end").alias("end_id"))
    jobs = answers.join(ends, "job", "left").select("job", "status", "points", "distance_m", "duration_s", "start_id", "end_id")
    b = answers.select("job", F.explode("batches").alias("b"))
    batches = b.select("job", "b.batch", "b.points", "b.district", "b.distance_m", "b.duration_s", "b.url")
    own = b.select("job", "b.batch", F.explode("b.stops").alias("s")).filter("NOT s.is_transition").select("job", "batch", F.col("s.ord").alias("ord"))
    before = answers.select("job", F.inline("legs")).select("job", F.col("to_order").alias("ord"), "distance_m", "duration_s")
    p = answers.select("job", F.inline("ordered_points")).join(before, ["job", "ord"], "left").join(own, ["job", "ord"], "left")
    points = p.join(rows.select("job", "original_index", F.col("id").alias("address_id")), ["job", "original_index"], "left")
    return jobs, batches, points.select("job", "ord", "type", "original_index", "address_id", "lat", "lon", "distance_m", "duration_s", "batch")
