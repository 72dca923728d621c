"""Routes: checks of cost matrices, order of stops, legs, batches with totals, links.

Jobs are independent and small (a hundred stops at most), so whatever needs a job's rows in
order is one group of that size or a fold over its sorted array.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions.scalars import rounded

#: A start, an end and a hundred stops between them.
MAX_POINTS = 102


def check_matrix(matrix: DataFrame) -> DataFrame:
    """(job, points, error) for cells (job, i, j, cost): the first rule that a matrix breaks, or null; over MAX_POINTS points are too many."""
    c = F.col("cost")
    out = matrix.groupBy("job").agg(
        F.max(F.greatest("i", "j")).alias("last"),
        F.count("*").alias("cells"),
        F.count_distinct("i", "j").alias("places"),
        F.count_if(c.isNull()).alias("missing"),
        F.count_if(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))).alias("endless"),
        F.count_if(c < 0).alias("negative"),
        F.count_if((F.col("i") == F.col("j")) & (F.abs(c) > 1.0)).alias("diagonal"),
    )
    n = F.col("last") + 1
    error = F.when(n > MAX_POINTS, "too many points").when((F.col("cells") != n * n) | (F.col("places") != n * n), "shape").when(F.col("missing") > 0, "missing").when(F.col("endless") > 0, "not finite").when(F.col("negative") > 0, "negative").when(F.col("diagonal") > 0, "diagonal")
    return out.select("job", n.alias("points"), error.alias("error"))


#: Cells of matrices that a task holds at once, and of one array that it works on.
_HELD, _AT_ONCE = 400_000, 400_000


def _nearest(cost: np.ndarray) -> np.ndarray:
    """Orders for matrices of one size (jobs, n, n): the nearest next stop, the first of equal ones."""
    jobs, n, _ = cost.shape
    each = np.arange(jobs)
    order = np.full((jobs, n), n - 1)
    order[:, 0] = 0
    gone = np.zeros((jobs, n), bool)
    gone[:, [0, n - 1]] = True
    for k in range(1, n - 1):
        order[:, k] = np.where(gone, np.inf, cost[each, order[:, k - 1]]).argmin(axis=1)
        gone[each, order[:, k]] = True
    return order


def _improved(order: np.ndarray, cost: np.ndarray, most: int = 100, least: float = 1e-9) -> np.ndarray:
    """Reversals of stretches, of each job the first that shortens the directed path each time; both ways' sums price all stretches at once."""
    order = order.copy()
    n = order.shape[1]
    s, e = np.arange(1, n - 2), np.arange(2, n - 1)
    later = e[None, :] > s[:, None]
    at = np.arange(n)
    live = np.arange(len(order)) if n > 3 else np.arange(0)
    for _ in range(most):
        if not len(live):
            break
        o = order[live]
        way = cost[live[:, None, None], o[:, :, None], o[:, None, :]]
        none = np.zeros((len(live), 1))
        ahead = np.concatenate([none, np.cumsum(way[:, at[:-1], at[1:]], axis=1)], axis=1)
        back = np.concatenate([none, np.cumsum(way[:, at[1:], at[:-1]], axis=1)], axis=1)
        gain = ahead[:, None, e + 1] - ahead[:, s - 1, None] - way[:, s[:, None] - 1, e[None, :]] - (back[:, None, e] - back[:, s, None]) - way[:, s[:, None], e[None, :] + 1]
        better = ((gain > least) & later).reshape(len(live), -1)
        some = better.any(axis=1)
        live, first = live[some], better[some].argmax(axis=1)
        begin, end = s[first // len(e)][:, None], e[first % len(e)][:, None]
        order[live] = np.take_along_axis(o[some], np.where((at >= begin) & (at <= end), begin + end - at, at), axis=1)
    return order


def _sound(cost: np.ndarray) -> np.ndarray:
    """Which matrices (jobs, n, n) break no rule of check_matrix for values."""
    with np.errstate(invalid="ignore"):
        return np.isfinite(cost).all(axis=(1, 2)) & (cost >= 0).all(axis=(1, 2)) & (np.abs(np.diagonal(cost, axis1=1, axis2=2)) <= 1.0).all(axis=1)


def _planned(cells: pd.DataFrame, kinds: int, by: int, improve: bool):
    """Tables (job, ord, stop, first, and cost0, first0, ... of the leg to the next stop in both orders) for whole jobs' sorted cells (job, kind, i, j, cost)."""
    jobs, i, j, cost = cells["job"].to_numpy(), *(cells[c].to_numpy(float) for c in ("i", "j", "cost"))
    kind = cells["kind"].to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(jobs[1:] != jobs[:-1]) + 1, [len(jobs)]])
    begin, count = cuts[:-1], np.diff(cuts)
    side = np.rint(np.sqrt(count / kinds)).astype(int)
    for n in np.unique(side[(side > 0) & (side <= MAX_POINTS) & (side * side * kinds == count)]):
        own = begin[(side == n) & (n * n * kinds == count)]
        k = np.arange(n * n * kinds)
        for part in np.array_split(own, -(-len(own) * len(k) // _AT_ONCE)):
            at = part[:, None] + k
            fits = ((i[at] == k // n % n) & (j[at] == k % n) & (kind[at] == k // (n * n))).all(axis=1)
            at = at[fits]
            m = cost[at].reshape(len(at), kinds, n, n)
            fits = np.logical_and.reduce([_sound(m[:, c]) for c in range(kinds)])
            m, names = m[fits], jobs[at[fits, 0]]
            if not len(m):
                continue
            first = _nearest(m[:, by])
            order = _improved(first, m[:, by]) if improve else first
            out = {"job": np.repeat(names, n), "ord": np.tile(np.arange(n, dtype=np.int32), len(m)), "stop": order.ravel().astype(np.int32)}
            each = np.arange(len(m))[:, None]
            for c in range(kinds):
                for name, o in ((f"cost{c}", order), (f"first{c}", first)):
                    legs_ = np.full((len(m), n), np.nan)
                    legs_[:, :-1] = m[:, c][each, o[:, :-1], o[:, 1:]]
                    out[name] = legs_.ravel()
            yield pd.DataFrame(out)


def planned(matrices: list[DataFrame], by: int = 0, improve: bool = True) -> DataFrame:
    """(job, ord, stop, and cost0, first0, ... for each matrix): from point 0 to the last one by the nearest next stop, then (improve) by reversals while these help; what the leg to the next stop costs in this order and in the first one.

    Jobs of which a matrix breaks a rule, or whose matrices differ in size, have no rows here;
    check_matrix names the rule. Rows are dealt by job and sorted, and one call of the function
    takes the many jobs of a task, those of one size together, each a matrix of MAX_POINTS
    points at most; what a larger one brings is passed over as it comes.
    """
    job, kinds = matrices[0].schema["job"].dataType.simpleString(), len(matrices)
    most = kinds * MAX_POINTS**2

    def run(parts):
        held, rest, size = [], [], 0
        for part in parts:
            if not len(part):
                continue
            jobs = part["job"].to_numpy()
            cuts = np.flatnonzero(jobs[1:] != jobs[:-1]) + 1
            same = bool(rest) and rest[-1]["job"].iloc[-1] == jobs[0]
            if rest and not same:
                held, rest = [*held, *rest], []
            if len(cuts):
                held, rest = [*held, *rest, part.iloc[: cuts[-1]]], [part.iloc[cuts[-1] :]]
            elif sum(map(len, rest)) <= most:
                rest.append(part)
            size = sum(map(len, held))
            if size >= _HELD:
                yield from _planned(pd.concat(held), kinds, by, improve)
                held = []
        if held or rest:
            yield from _planned(pd.concat([*held, *rest]), kinds, by, improve)

    every = [m.select("job", F.lit(k).cast("byte").alias("kind"), "i", "j", "cost").filter("job IS NOT NULL") for k, m in enumerate(matrices)]
    dealt = reduce(DataFrame.unionByName, every).repartition("job").sortWithinPartitions("job", "kind", "i", "j")
    return dealt.mapInPandas(run, f"job {job}, ord int, stop int" + "".join(f", cost{k} double, first{k} double" for k in range(kinds)))


def order_stops(matrix: DataFrame, improve: bool = True) -> DataFrame:
    """(job, ord, stop) of planned(), for one matrix."""
    return planned([matrix], improve=improve).select("job", "ord", "stop")


def legs(order: DataFrame, matrix: DataFrame) -> DataFrame:
    """(job, from_order, to_order, from_stop, to_stop, cost) of neighbours in an order (job, ord, stop)."""
    w = Window.partitionBy("job").orderBy("ord")
    pairs = order.select("job", F.col("ord").alias("from_order"), F.col("stop").alias("from_stop"), F.lead("ord").over(w).alias("to_order"), F.lead("stop").over(w).alias("to_stop")).filter("to_order IS NOT NULL")
    cells = matrix.select("job", F.col("i").alias("from_stop"), F.col("j").alias("to_stop"), "cost")
    return pairs.join(cells, ["job", "from_stop", "to_stop"], "left").select("job", "from_order", "to_order", "from_stop", "to_stop", "cost")


def path_cost(order: DataFrame, matrix: DataFrame) -> DataFrame:
    return legs(order, matrix).groupBy("job").agg(F.sum("cost").alias("cost"))


def groups_by_size(points: DataFrame, size: int) -> DataFrame:
    """points (job, ord, type, district) with grp, from 0, for waypoints by size alone; null for start and end."""
    w = Window.partitionBy("job", "type").orderBy("ord")
    return points.withColumn("grp", F.when(F.col("type") == "waypoint", F.floor((F.row_number().over(w) - 1) / size).cast("int")))


def groups_by_district(points: DataFrame, size: int) -> DataFrame:
    """The same where a change of district, both known, ends a group too. The size starts anew with each group, so it is a fold over the job's sorted points."""
    empty = F.struct(F.lit(-1).alias("g"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("d"), F.array().cast("array<struct<ord:int,grp:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        new = (a["g"] < 0) | (a["n"] >= size) | F.coalesce(a["d"] != p["district"], F.lit(False))
        g = F.when(new, a["g"] + 1).otherwise(a["g"])
        d = F.when(new, p["district"]).otherwise(F.coalesce(a["d"], p["district"]))
        n = F.when(new, 1).otherwise(a["n"] + 1)
        return F.struct(g.alias("g"), n.alias("n"), d.alias("d"), F.concat(a["out"], F.array(F.struct(p["ord"].alias("ord"), g.alias("grp")))).alias("out"))

    way = points.filter("type = 'waypoint'").select("job", F.col("ord").cast("int").alias("ord"), "district")
    folded = way.groupBy("job").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("ord", "district"))), empty, step)["out"].alias("out"))
    return points.join(folded.select("job", F.inline("out")), ["job", "ord"], "left")


def batches(points: DataFrame, size: int = 15, by_district: bool = True, transition: bool = True) -> DataFrame:
    """(job, batch, place, ord, district, is_transition): the points of each batch of up to `size` (1 to 20) waypoints.

    The first batch begins at the start, the last one ends at the end; the others begin with the
    last stop of the one before (transition). A job without waypoints has one batch.
    """
    if not 1 <= size <= 20:
        raise ValueError("size must be from 1 to 20")
    g = groups_by_district(points, size) if by_district else groups_by_size(points, size)
    last = F.max("grp").over(Window.partitionBy("job"))
    g = g.withColumn("grp", F.when(F.col("type") == "start", 0).when(F.col("type") == "end", F.coalesce(last, F.lit(0))).otherwise(F.col("grp")))
    rows = g.select("job", F.col("grp").alias("batch"), "ord", "district", F.lit(False).alias("is_transition"))
    if transition:
        ends = g.filter("type = 'waypoint'").groupBy("job", "grp").agg(F.max_by(F.struct("ord", "district"), "ord").alias("p"))
        again = ends.withColumn("more", F.max("grp").over(Window.partitionBy("job"))).filter("grp < more")
        rows = rows.unionByName(again.select("job", (F.col("grp") + 1).alias("batch"), "p.ord", "p.district", F.lit(True).alias("is_transition")))
    place = F.row_number().over(Window.partitionBy("job", "batch").orderBy("ord")) - 1
    return rows.select("job", (F.col("batch") + 1).alias("batch"), place.alias("place"), "ord", "district", "is_transition")


def batch_totals(rows: DataFrame, leg_rows: DataFrame | None = None) -> DataFrame:
    """(job, batch, points, districts, district, cost): ordered distinct districts of a batch's own stops, the only one if there is one, and its legs' sum."""
    own = F.when(~F.col("is_transition") & F.col("district").isNotNull(), F.struct("ord", "district"))
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(own)), lambda s: s["district"]))
    out = rows.groupBy("job", "batch").agg(F.count("*").alias("points"), names.alias("districts"))
    out = out.withColumn("district", F.when(F.size("districts") == 1, F.element_at("districts", 1)))
    if leg_rows is None:
        return out.withColumn("cost", F.lit(None).cast("double"))
    w = Window.partitionBy("job", "batch").orderBy("ord")
    steps = rows.select("job", "batch", F.col("ord").alias("from_order"), F.lead("ord").over(w).alias("to_order")).filter("to_order IS NOT NULL")
    cost = steps.join(leg_rows.select("job", "from_order", "to_order", "cost"), ["job", "from_order", "to_order"], "left").groupBy("job", "batch").agg(rounded(F.sum("cost")).alias("cost"))
    return out.join(cost, ["job", "batch"], "left")


def links(rows: DataFrame, base: str, slug: str = "", default_slug: str = "", decimals: int = 6, most_points: int = 20, longest: int = 2000) -> DataFrame:
    """(job, batch, url, warnings) for batch points (job, batch, place, lat, lon, is_transition): a map link with the stops in order, centred on their mean."""
    number = lambda x: F.format_string(f"%.{decimals}f", rounded(x, decimals))
    own = rows.groupBy("job", "batch").agg(
        F.array_sort(F.collect_list(F.struct("place", "lat", "lon", "is_transition"))).alias("p"), F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lon"), 9).alias("lon")
    )
    stops = F.array_join(F.transform("p", lambda s: F.concat_ws(",", number(s["lat"]), number(s["lon"]))), "~")
    centre = F.concat_ws(",", number(F.col("lon")), number(F.col("lat")))
    url = F.concat(F.lit(f"{base}/{slug or default_slug}/?ll="), F.replace(centre, F.lit(","), F.lit("%2C")), F.lit("&mode=routes&rtext="), F.replace(stops, F.lit(","), F.lit("%2C")), F.lit("&rtn=1&rtt=auto"))
    # fixed values: the texts of the warnings
    warnings = F.array_compact(
        F.array(
            F.when(F.size("p") > most_points, "Batch contains many points"),
            F.when((F.col("batch") > 1) & ~F.element_at("p", 1)["is_transition"], "Transition point is missing"),
            F.when(F.lit(not slug), "City slug was not provided, default value used"),
            F.when(F.length("url") > longest, "URL length exceeds recommended limit"),
        )
    )
    return own.withColumn("url", url).select("job", "batch", "url", warnings.alias("warnings"))


def insert_cheapest(route: list[tuple[float, float]], stop: tuple[float, float]) -> int:
    """Where a stop lengthens a route least (before which place, 1 at least), by distance on a sphere; the first of equal ones."""

    def metres(a, b):
        p, q = np.radians(a[..., 0]), np.radians(b[..., 0])
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(b[..., 1] - a[..., 1]) / 2) ** 2
        return 12_742_000.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

    r, s = np.array(route, float), np.array(stop, float)
    return int(np.argmin(metres(r[:-1], s[None]) + metres(s[None], r[1:]) - metres(r[:-1], r[1:]))) + 1


def order_by_insertion(points: DataFrame) -> DataFrame:
    """(job, ord, stop) for points (job, stop, lat, lon), stop 0 the start and the last the end: stops go in one by one where they cost least."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("stop")
        at = dict(zip(rows["stop"], zip(rows["lat"], rows["lon"], strict=True), strict=True))
        order = [rows["stop"].iloc[0], rows["stop"].iloc[-1]]
        for s in rows["stop"].iloc[1:-1]:
            order.insert(insert_cheapest([at[o] for o in order], at[s]), s)
        return pd.DataFrame({"job": rows["job"].iloc[0], "ord": range(len(rows)), "stop": order[: len(rows)]})

    job = points.schema["job"].dataType.simpleString()
    return points.groupBy("job").applyInPandas(run, f"job {job}, ord int, stop int")
