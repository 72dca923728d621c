"""Near-duplicate classes by Order MinHash over word shingles.

Shingles of `shingle` words are labelled with their occurrence number in the text. Each of
`sketches` sketches keeps the `minima` least labelled shingles under a hash of its own, in the
order in which the text has them: texts agree on it the likelier the more of their shingles
they share in the same order. Texts with a sketch in common meet in a bucket.

Copies of one word sequence are put together first. In a bucket, nobody meets everybody: the
most central text (the one whose sketches are the commonest, so rather an original than one
of its edited copies) meets the others, candidates are verified by a banded alignment of
the shingle sequences and by nothing else, and what is verified joins into classes. Buckets that still hold more
than one class go on with the next leader, and so on; small rests meet pairwise. The texts of
large rests meet by an exact prefix filter: ordered from rare to common, two texts that are
alike have a shingle in common so early that those of a shared template seldom count.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm._common import materialise, meet, scope, with_row_id
from routeloom.llm._words import SPACES, Words, mix, pieces

_SALTS = mix(np.arange(1, 129, dtype=np.uint64), 11)
_TIMES = mix(np.arange(1, 129, dtype=np.uint64), 12) | np.uint64(1)
_MOST = np.uint64(2**64 - 1)
#: Cells in which shingles are counted to put rare ones first; any order gives the same pairs.
_CELLS = 1 << 20
#: Joins are planned with shuffles at every size, and turned into broadcasts only by sizes that Spark has measured.
_JOINS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
#: Rows of a bucket that are dealt together.
_DEALT = 1000
#: Edits up to which an alignment is looked for diagonal by diagonal.
_FEW_EDITS = 48
#: Cells of a block, and arrays of a block that are added together.
_BLOCK, _TOGETHER = 1 << 16, 64
#: Bundles of a token that meet in one task.
_MET = 64
#: Rows of a written table up to which joins hand it to every task.
_FEW = 200_000


def _shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the shingles, in order; a row of fewer than k words, but not none, is one shingle."""
    fits = w.fits(k)
    at = np.flatnonzero(fits)
    rows = w.rows()
    h, r = w.grams(k, 5)[at], rows[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(few):
        from routeloom.llm._words import spans

        h = np.concatenate([h, spans(w.hashes, w.first[few], w.counts[few], 6)])
        r = np.concatenate([r, few])
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def _labelled(h: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Hashes of shingles with their occurrence number in their row."""
    order = np.lexsort((h, r))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (r[order][1:] == r[order][:-1])
    at = np.arange(len(h))
    begin = np.maximum.accumulate(np.where(same, 0, at))
    times = np.empty(len(h), np.uint64)
    times[order] = (at - begin).astype(np.uint64)
    return mix(h + times * np.uint64(0xA24BAED4963EE407))


def _sketch(k: int, sketches: int, minima: int):
    def run(batches):
        for b in batches:
            rid = b.column("rid")
            for i, j, data, offsets in pieces(b.column("text")):
                w = Words(data, offsets)
                h, r = _shingles(w, k)
                x = _labelled(h, r)
                first = np.searchsorted(r, np.arange(j - i + 1))
                some = np.flatnonzero(np.diff(first))
                begin, n = first[:-1][some], np.diff(first)[some]
                keys = np.zeros((len(some), sketches), np.int64)
                for s in range(sketches if len(some) else 0):
                    y = (x ^ _SALTS[s]) * _TIMES[s]
                    values, places = [], []
                    for _ in range(minima):
                        low = np.minimum.reduceat(y, begin)
                        is_low = y == np.repeat(low, n)
                        at = np.flatnonzero(is_low)
                        values.append(low)
                        places.append(at[np.searchsorted(at, begin)])
                        y = np.where(is_low, _MOST, y)
                    # in the order of the text
                    order = np.argsort(np.stack(places), axis=0, kind="stable")
                    key = np.full(len(some), s, np.uint64)
                    for v in np.take_along_axis(np.stack(values), order, axis=0):
                        key = mix(key * np.uint64(3) + v, 1)
                    keys[:, s] = key.view(np.int64)
                sums = [np.add.reduceat(mix(h + (np.arange(len(h)) - np.repeat(begin, n)).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25), salt), begin) if len(some) else np.zeros(0, np.uint64) for salt in (8, 9)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * sketches), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([rid.slice(i, j - i).take(pa.array(some)), *(pa.array(x.view(np.int64)) for x in sums), pa.array(n.astype(np.int32)), lists], ["rid", "h1", "h2", "size", "keys"])

    return run


def aligned(a: list[int], b: list[int], most: int) -> int:
    """Matches of the best alignment of two sequences, or -1 if it leaves more than `most` elements unmatched.

    Diagonals further than `most` from the first are never looked at.
    """
    n, m = len(a), len(b)
    lead = 0
    while lead < n and lead < m and a[lead] == b[lead]:
        lead += 1
    a, b = a[lead:], b[lead:]
    tail = 0
    while tail < len(a) and tail < len(b) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if n + m == 0 or not n or not m:
        return lead + tail if n + m <= most else -1
    # few edits show at once: the furthest places that d of them reach, diagonal by diagonal
    reach = {1: 0}
    for d in range(min(most, n + m, _FEW_EDITS) + 1):
        for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
            x = reach.get(k + 1, -1) if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach.get(k - 1, -1) + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            reach[k] = x
            if x >= n and y >= m:
                return lead + tail + (n + m - d) // 2
    if most <= _FEW_EDITS:
        return -1
    # many: rows of the table as long numbers, a zero bit for each place where a match adds to the best
    places: dict[int, list[int]] = {}
    for x, v in enumerate(a):
        places.setdefault(v, []).append(x)
    whole = (1 << n) - 1
    row = whole
    for y, v in enumerate(b):
        own = places.get(v)
        if own is None:
            continue
        # only what lies within the band
        hit = 0
        for x in own[bisect.bisect_left(own, y - most) : bisect.bisect_right(own, y + most)]:
            hit |= 1 << x
        hit &= row
        row = ((row + hit) | (row - hit)) & whole
    matches = n - row.bit_count()
    return lead + tail + matches if n + m - 2 * matches <= most else -1


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the best alignment of two shingle sequences matches at least `least` of all their shingles, a matched pair counted once."""
    if not len(a) or not len(b):
        return False
    # matches / (n + m - matches) >= least leaves so many unmatched at most
    most = int((1 - least) / (1 + least) * (len(a) + len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    _, x = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = np.bincount(x[: len(a)], minlength=x.max() + 1), np.bincount(x[len(a) :], minlength=x.max() + 1)
    # no order of shingles matches more than these
    if len(a) + len(b) - 2 * int(np.minimum(*n).sum()) > most:
        return False
    return aligned(x[: len(a)].tolist(), x[len(a) :].tolist(), most) >= 0


def _sequence(text: str, k: int) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _shingles(Words(data, np.array([0, len(data)]), SPACES), k)[0]


def _verify(k: int, least: float):
    def run(batches):
        last, held = None, np.zeros(0, np.uint64)
        # few rows at a time: texts are many times as large as what is kept of them
        for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            found = []
            for i, (u, s, t) in enumerate(zip(*(b.column(c).to_pylist() for c in ("u", "a", "b")), strict=True)):
                if u != last:
                    last, held = u, _sequence(s, k)
                if similar(held, _sequence(t, k), least):
                    found.append(i)
            yield b.select(["u", "v", "cu", "cv"]).take(pa.array(found, pa.int64()))

    return run


def _few(table: DataFrame, columns: int = 3) -> bool:
    """Whether a written table has at most _FEW rows of three numbers, or less of wider ones: counted, not guessed."""
    most = _FEW * 3 // max(3, columns)
    return table.select(F.lit(1)).limit(most + 1).count() <= most


def _handed(rows: DataFrame, table: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """meet() for a written table; one of few rows goes to every task, and the rows stay where they are."""
    if _few(table, len(table.columns)):
        return rows.join(F.broadcast(table), on, how).select(*on, *(c for c in rows.columns if c not in on), *(c for c in table.columns if c not in on))
    return meet(rows, table, on, by, how)


def _cells(h: np.ndarray) -> np.ndarray:
    return (mix(h, 21) >> np.uint64(44)).astype(np.int64)


def _blocks(n: np.ndarray):
    """(block, cells, counts) of the counts that aren't 0, as little-endian numbers."""
    for block in range(_CELLS // _BLOCK):
        own = n[block * _BLOCK : (block + 1) * _BLOCK]
        at = np.flatnonzero(own)
        if len(at):
            yield block, at.astype("<u2").tobytes(), own[at].astype("<i8").tobytes()


def _count_cells(k: int):
    def run(batches):
        from pyspark import TaskContext

        n = np.zeros(_CELLS, np.int64)
        for b in batches:
            for _, _, data, offsets in pieces(b.column("text")):
                n += np.bincount(_cells(_labelled(*_shingles(Words(data, offsets, SPACES), k))), minlength=_CELLS)
        rows = [(TaskContext.get().partitionId(), *x) for x in _blocks(n)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "cells", "counts"])

    return run


def _added(batches):
    """The counts of each row's arrays put together."""
    for b in batches:
        out = []
        for part, block, arrays in zip(*(b.column(c).to_pylist() for c in ("part", "block", "m")), strict=True):
            n = np.zeros(_BLOCK, np.int64)
            for x in arrays:
                n[np.frombuffer(x["cells"], "<u2")] += np.frombuffer(x["counts"], "<i8")
            at = np.flatnonzero(n)
            out.append((part, block, at.astype("<u2").tobytes(), n[at].astype("<i8").tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "cells", "counts"])


def cell_levels(texts: DataFrame, k: int) -> np.ndarray:
    """How common the shingles of each cell are, on a scale of logarithms: a byte for each cell, whatever the size of the input.

    Tasks count into arrays, which are added up _TOGETHER at a time until one is left.
    """
    shape = "part int, block int, cells binary, counts binary"
    counted = materialise(texts.select("text").mapInArrow(_count_cells(k), shape), "cells")
    while counted.agg(F.max("part")).first()[0]:
        some = counted.groupBy((F.col("part") / _TOGETHER).cast("int").alias("part"), "block").agg(F.collect_list(F.struct("cells", "counts")).alias("m"))
        counted = materialise(some.mapInArrow(_added, shape), "cells")
    level = np.zeros(_CELLS, np.uint8)
    for r in counted.collect():
        n = np.frombuffer(r["counts"], "<i8")
        level[r["block"] * _BLOCK + np.frombuffer(r["cells"], "<u2").astype(np.int64)] = np.minimum(255, np.ceil(8 * np.log2(n)))
    return level


def _prefixes(k: int, least: float, level: np.ndarray):
    """Rows (rid, label, token, at, size, early) of the shingles, with occurrence numbers, by which a text can meet one that is alike.

    `at` is the place among the text's `size` shingles from rare to common. The larger of two
    texts has the first one that they share among its first size * (1 - least), the smaller
    one (early) among the first size * (1 - least) / (1 + least).
    """

    def run(batches):
        for b in batches:
            rid, label = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "label"))
            for i, j, data, offsets in pieces(b.column("text")):
                h, q = _shingles(Words(data, offsets, SPACES), k)
                t = _labelled(h, q)
                order = np.lexsort((t, level[_cells(t)], q))
                t, q = t[order], q[order]
                size, at = np.bincount(q, minlength=j - i)[q], np.arange(len(t)) - np.searchsorted(q, q)
                kept = at <= size * (1 - least) + 1e-6
                t, q, size, at = t[kept], q[kept], size[kept], at[kept]
                early = at <= size * ((1 - least) / (1 + least)) + 1e-6
                # a cell that counts one shingle holds no shared one
                some = np.flatnonzero(level[_cells(t)] > 0)
                for f in range(0, len(some), 50_000):
                    s = some[f : f + 50_000]
                    cols = [rid[i:j][q[s]], label[i:j][q[s]], t[s].view(np.int64), at[s].astype(np.int32), size[s].astype(np.int32), early[s]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["rid", "label", "token", "at", "size", "early"])

    return run


def prefix_pairs(texts: DataFrame, labels: DataFrame, k: int, least: float) -> DataFrame:
    """All pairs (u, v, cu, cv) of the texts in labels (rid, label), of different labels cu and cv, that can be alike by `least`; some more than once."""
    rest = texts.join(F.broadcast(labels) if _few(labels) else labels, "rid").select("rid", "text", "label")
    level = cell_levels(rest, k)
    tokens = materialise(rest.mapInArrow(_prefixes(k, least, level), "rid long, label long, token long, at int, size int, early boolean"), "prefixes")
    # neighbouring shingles are shared by the same texts: tokens with the same texts, told by hashes over them, count as one
    same = [F.bit_xor(F.xxhash64("rid", F.lit(i))).alias(f"k{i}") for i in (1, 2)]
    mixed = tokens.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max("early").alias("e"), *same).filter("a <> b AND e").select("token", "k1", "k2")
    mixed = materialise(mixed, "mixed")
    packed = tokens.join(F.broadcast(mixed) if _few(mixed) else mixed, "token").groupBy("k1", "k2", "rid", "label", "size").agg(F.min("at").alias("at"), F.max("early").alias("early"))
    # alike texts are of like size: the same band of sizes or the next
    packed = materialise(packed.withColumn("band", F.floor(F.log("size") / F.lit(-math.log(least)))), "packed")
    # members of one class stand together, which never meet: a thousand in a row
    group = ["k1", "k2", "band", "label"]
    counted = materialise(packed.groupBy(*group).agg((F.count("*") / _DEALT).cast("int").alias("parts")).filter("parts > 0"), "counted")
    part = F.pmod(F.xxhash64("rid"), F.coalesce("parts", F.lit(0)) + 1).alias("part")
    own = _handed(packed, counted, group, "rid", "left").groupBy(*group, part).agg(F.collect_list(F.struct("rid", "at", "size", "early")).alias("m"))
    # of a bundle: the least size, and the most shingles that stand from a place on
    early = F.filter("m", lambda x: x["early"])
    sizes = lambda m: (F.array_min(F.transform(m, lambda x: x["size"])), F.array_max(F.transform(m, lambda x: x["size"] - x["at"])))
    own = materialise(own.withColumns({"least": sizes("m")[0], "rest": sizes("m")[1]}), "meetings")
    # bundles of a token that many classes share are dealt over salts, what meets them goes to each
    many = own.groupBy("k1", "k2", "band").agg((F.count("*") / _MET).cast("int").alias("salts")).filter("salts > 0")
    many = materialise(many, "many")
    many = F.broadcast(many) if _few(many, 4) else many
    at = F.pmod(F.xxhash64("label", "part"), F.coalesce("salts", F.lit(0)) + 1).alias("salt")
    dealt = own.join(many, ["k1", "k2", "band"], "left").select("k1", "k2", "band", at, "label", "least", "rest", F.col("m").alias("y"))
    short = own.select("k1", "k2", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("label").alias("c"), early.alias("x")).filter("size(x) > 0")
    short = short.withColumns({"xleast": sizes("x")[0], "xrest": sizes("x")[1]}).join(many, ["k1", "k2", "band"], "left")
    short = short.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(0))))).drop("salts")
    reach = F.least("xrest", "rest") + F.lit(1e-6) >= (F.col("xleast") + F.col("least")) * F.lit(least / (1 + least))
    met = short.join(dealt, ["k1", "k2", "band", "salt"]).filter((F.col("c") != F.col("label")) & reach)

    def can_meet(x, y):
        ahead = (x["size"] < y["size"]) | ((x["size"] == y["size"]) & (x["rid"] < y["rid"]))
        return ahead & (F.least(x["size"] - x["at"], y["size"] - y["at"]) + F.lit(1e-6) >= (x["size"] + y["size"]) * F.lit(least / (1 + least)))

    # pairs that sizes or places rule out never become rows
    pairs = F.flatten(F.transform("x", lambda x: F.transform(F.filter("y", lambda y: can_meet(x, y)), lambda y: F.struct(x["rid"].alias("u"), y["rid"].alias("v")))))
    return met.select("c", "label", F.explode(pairs).alias("p")).select("p.u", "p.v", F.col("c").alias("cu"), F.col("label").alias("cv"))


def components(links: DataFrame) -> DataFrame:
    """Rows (id, label), label the least id of its component, for the ids in links (u, v).

    Least labels spread over links and along labels until nothing changes; each turn is
    written, so lineage stays short. An id with many links, and a label of many ids, travel in
    bundles (see meet).
    """
    links = materialise(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    both = links.union(links.select("v", "u"))
    labels = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "id"), "labels")
    # there are as many labels in every turn
    few = _few(labels)
    join = (lambda rows, table, on, by: rows.join(F.broadcast(table), on)) if few else meet
    while True:
        seen = labels.select(F.col("id").alias("v"), F.col("label").alias("near"))
        near = join(both, seen, ["v"], "u").groupBy("u").agg(F.min("near").alias("near")).withColumnRenamed("u", "id")
        least = join(near, labels, ["id"], "near") if few else labels.join(near, "id")
        least = least.select("id", "label", F.least("label", "near").alias("next"))
        far = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        new = materialise(join(least, far, ["next"], "id").select("id", "label", F.least("next", "far").alias("next")), "labels")
        if new.filter("label <> next").isEmpty():
            return labels
        labels = new.select("id", F.col("next").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, sketches: int = 16, minima: int = 3, rounds: int = 1, small: int = 24) -> DataFrame:
    """Rows (doc_id, rid, class_id), one for each row of docs; class_id is the least rid of the class.

    rid is doc_id where that is a unique integer, else an id of its own. Two texts are linked
    if an alignment of their sequences of shingles matches at least `similarity` of all their
    shingles, a matched pair counted once; classes are the components of links. Texts of fewer
    words than a shingle are one shingle; null, empty and blank texts have none and each is a
    class of its own. Texts with the same words in the same order are one class at once,
    however many there are; rows with equal doc_id stay apart. Other columns, whatever their
    names, aren't looked at, and no rows give no rows.

    Texts without any sketch in common never meet; for two texts that match by 0.8, that
    happens with a chance of about (1 - 0.8 ** minima) ** sketches, one in 100,000. `rounds` and `small` only say
    when buckets with several classes go from leaders to pairs, and up to which size pairs
    are drawn directly rather than through the prefix filter; neither drops a pair.
    """
    return classes(with_row_id(docs, ["text"]), shingle, similarity, sketches, minima, rounds, small)


def without_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """docs, with all their columns whatever their names, without the rows that have a row of lesser rid in their class (see near_duplicates)."""
    rows = with_row_id(docs.select("doc_id", "text", F.struct(*docs.columns).alias("routeloom_row")), ["text", "routeloom_row"])
    first = classes(rows, **settings).filter("rid = class_id").select("rid")
    return rows.join(first, "rid", "left_semi").select(*(F.col("routeloom_row")[c].alias(c) for c in docs.columns))


def _pairs_of_turn(buckets: DataFrame, lead: bool, small: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mixed buckets (key, n, top, salt), pairs (u, v, cu, cv, salt) to look at, and what is left of large buckets (rid, label).

    Rows of a bucket are dealt over its salts, and what is known of the bucket goes to each.
    Texts of which one has under `least` of the other's shingles are never alike.
    """
    like = lambda a, b: F.least(a, b) >= F.greatest(a, b) * F.lit(least) - F.lit(1e-6)
    mixed = buckets.groupBy("key", "n").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max(F.when(~F.col("led"), F.struct("weight", "rid", "label", "size"))).alias("top"))
    mixed = materialise(mixed.filter("a <> b AND top IS NOT NULL").select("key", "n", "top", F.explode(F.sequence(F.lit(0), (F.col("n") / _DEALT).cast("int"))).alias("salt")), "mixed")
    held = buckets.drop("n").join(F.broadcast(mixed) if _few(mixed, 6) else mixed, ["key", "salt"])
    large = held.filter(F.col("n") > small).select("rid", "label").distinct()
    if lead:
        # the leader and the texts of other classes
        pairs = held.filter((F.col("label") != F.col("top.label")) & like(F.col("size"), F.col("top.size"))).select(F.col("top.rid").alias("u"), F.col("rid").alias("v"), F.col("top.label").alias("cu"), F.col("label").alias("cv"), "salt")
        return mixed, pairs, large
    rest = held.filter(F.col("n") <= small)
    pairs = rest.select("key", F.col("rid").alias("u"), F.col("label").alias("cu"), F.col("size").alias("su")).join(rest.select("key", F.col("rid").alias("v"), F.col("label").alias("cv"), F.col("size").alias("sv")), "key")
    return mixed, pairs.filter((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & like(F.col("su"), F.col("sv"))).select("u", "v", "cu", "cv", F.lit(0).alias("salt")), large


def classes(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, sketches: int = 16, minima: int = 3, rounds: int = 1, small: int = 24) -> DataFrame:
    """near_duplicates for rows (rid, doc_id, text) whose rid names a row."""
    with scope(rows.sparkSession, _JOINS):
        whole = materialise(_classes(rows.select("rid", "text"), shingle, similarity, sketches, minima, rounds, small), "near-classes", keep=True)
    return rows.select("doc_id", "rid").join(whole, "rid", "left").select("doc_id", "rid", F.coalesce("class_id", "rid").alias("class_id"))


def _classes(texts: DataFrame, shingle: int, similarity: float, sketches: int, minima: int, rounds: int, small: int) -> DataFrame:
    """(rid, class_id) of the texts (rid, text) that have a word.

    Each turn's tables stay until the last has been read.
    """
    drawn = materialise(texts.mapInArrow(_sketch(shingle, sketches, minima), "rid long, h1 long, h2 long, size int, keys array<long>"), "sketches")
    # of copies of one word sequence, one goes on
    first = materialise(drawn.groupBy("h1", "h2").agg(F.min(F.struct("rid", "size", "keys")).alias("t")).select("h1", "h2", "t.*"), "first")
    own = first.select("rid", "size", F.explode("keys").alias("key"))
    shared = materialise(own.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    buckets = materialise(_handed(own, shared, ["key"], "rid"), "buckets")
    central = materialise(buckets.groupBy("rid").agg(F.sum("n").alias("weight")), "central")
    few = _few(central)
    held = F.broadcast(central) if few else central
    salt = F.pmod(F.xxhash64("rid"), (F.col("n") / _DEALT).cast("long") + 1).cast("int")
    buckets = materialise(buckets.join(held, "rid").select("key", "n", salt.alias("salt"), "rid", "size", "weight", F.lit(False).alias("led"), F.col("rid").alias("label")), "buckets")
    # only texts that share a bucket are ever looked at again
    texts = materialise(texts.join(held.select("rid"), "rid", "left_semi"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs.groupBy("u", "v").agg(F.min("salt").alias("salt"), F.min("cu").alias("cu"), F.min("cv").alias("cv")), "pairs")
        # one copy of a leader's text for each salt under which it is asked for; texts are never broadcast, and stay where they are if pairs are few
        hint = "broadcast" if _few(pairs, len(pairs.columns)) else "merge"
        leads = pairs.select("u", "salt").distinct().hint(hint).join(texts.select(F.col("rid").alias("u"), F.col("text").alias("a")), "u")
        both = pairs.hint(hint).join(texts.select(F.col("rid").alias("v"), F.col("text").alias("b")), "v").join(leads.hint("merge"), ["u", "salt"])
        return materialise(both.select("u", "v", "cu", "cv", "a", "b").mapInArrow(_verify(shingle, similarity), "u long, v long, cu long, cv long"), "links")

    labels = central.select("rid", F.col("rid").alias("label"))
    for turn in range(rounds + 1):
        # what a turn has written goes with it, but for the classes and the buckets that go on
        with scope(texts.sparkSession):
            mixed, pairs, large = _pairs_of_turn(buckets, turn < rounds, small, similarity)
            if turn == rounds:
                large = materialise(large, "large")
                if not large.isEmpty():
                    pairs = pairs.unionByName(prefix_pairs(texts, large, shingle, similarity).withColumn("salt", F.lit(0)))
            found = verified(pairs)
            # classes that a link joins become one
            new = components(found.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
            new = new.select(F.col("id").alias("label"), F.col("label").alias("next"))
            labels = materialise(_handed(labels, new, ["label"], "rid", "left").select("rid", F.coalesce("next", "label").alias("label")), "classes", keep=True)
            if turn < rounds:
                # only buckets that held more than one class go on
                led = mixed.select("key", "salt", F.col("top.rid").alias("leader"))
                new = buckets.drop("label").join(F.broadcast(led) if _few(led) else led, ["key", "salt"]).withColumn("led", F.col("led") | (F.col("rid") == F.col("leader"))).drop("leader")
                buckets = materialise(new.join(F.broadcast(labels) if few else labels, "rid").select("key", "n", "salt", "rid", "size", "weight", "led", "label"), "buckets", keep=True)
            del mixed, pairs, large, found, new
        if turn < rounds and buckets.isEmpty():
            break
    labelled = first.select("h1", "h2", "rid").join(F.broadcast(labels) if few else labels, "rid", "left").select("h1", "h2", F.coalesce("label", "rid").alias("class_id"))
    return _handed(drawn.select("rid", "h1", "h2"), materialise(labelled, "labelled"), ["h1", "h2"], "rid").select("rid", "class_id")
