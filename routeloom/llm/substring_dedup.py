"""Removal of long repeated passages through a compacted de Bruijn graph of words.

An edge of the graph is a window of `window` words, and its ends are the stretches one word
shorter. A row's edges are cut into paths: maximal runs of windows that share one occurrence
of their least inner k-gram. Equal windows share that k-gram, so only paths with a k-gram that
occurs twice can hold a repeated edge, and the k-gram is what paths are joined by.

* Paths of a k-gram that all spell the same words don't branch: they repeat as a whole and are
  one unit.
* Where a k-gram has paths that differ, one copy of each is looked up at its source
  coordinates and its edges are spelt out and counted. Repeated edges that always follow one
  another are a unit; where ways part or meet, a unit ends.
* Units of different k-grams are joined along the rows: one that is always followed by the same
  unit, which always follows it, makes a chain with it. Chains grow by joins that double their
  reach each turn.

Source rows and word positions travel with all of these. At the end, the words at the source
coordinates of each chain's copies are read again and their digests compared: only what at
least two places spell alike is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.llm._common import materialise, meet, scope, with_row_id
from routeloom.llm._words import Words, pieces, scan, sliding_min, spans

PATHS = "m long, c long, rid long, s int, n int"
EDGES = "m long, c long, i int, e long, before long, after long, weight long"
#: Stands for no edge before or after.
NONE = 0


def _paths_of(w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and counts of windows, and the k-gram, of each path."""
    n = len(w) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, fits = w.grams(k, 1), w.fits(window)
    least = sliding_min(grams, window - k + 1)
    opens, closes = fits.copy(), fits.copy()
    # a window whose first k-gram is the least ends its path, even if an equal one follows: no edge is twice in a path
    same = (least[1:] == least[:-1]) & (grams[: n - 1] != least[:-1]) & fits[1:] & fits[:-1]
    opens[1:] &= ~same
    closes[:-1] &= ~same
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1 - starts, least[starts]


def _emit_paths(window: int, k: int, only_grams: bool):
    def run(batches):
        for b in batches:
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            for i, _, w in scan(b.column("text")):
                starts, n, m = _paths_of(w, window, k)
                if not len(starts):
                    continue
                if only_grams:
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64))], ["m"])
                    continue
                row = np.searchsorted(w.first, starts, "right") - 1
                c = spans(w.hashes, starts, n + window - 1, 3)
                out = (m.view(np.int64), c.view(np.int64), rid[i + row], (starts - w.first[row]).astype(np.int32), n.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["m", "c", "rid", "s", "n"])

    return run


def _emit_edges(window: int):
    def run(batches):
        for b in batches:
            lists = b.column("paths")
            for i, j, data, offsets in pieces(b.column("text")):
                w = Words(data, offsets)
                bounds = lists.offsets.to_numpy()[i : j + 1]
                p = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
                s, n, m, c, weight = (p.field(x).to_numpy(zero_copy_only=False) for x in ("s", "n", "m", "c", "weight"))
                first = w.first[np.repeat(np.arange(j - i), np.diff(bounds))] + s
                owner = np.repeat(np.arange(len(n)), n)
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                e = spans(w.hashes, first[owner] + at, window, 2).view(np.int64)
                before, after = np.full(len(e), NONE, np.int64), np.full(len(e), NONE, np.int64)
                inner = np.flatnonzero(at > 0)
                before[inner], after[inner - 1] = e[inner - 1], e[inner]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (m[owner], c[owner], at.astype(np.int32), e, before, after, weight[owner])], ["m", "c", "i", "e", "before", "after", "weight"])

    return run


def _digests(window: int):
    """(rid, chain, s, n, digest) of each span's words, read at its place."""

    def run(batches):
        for b in (x.slice(i, 512) for x in batches for i in range(0, x.num_rows, 512)):
            rows, texts, lists = b.column("rid").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist()
            out: list[list] = [[], [], [], [], []]
            for rid, text, spans_of in zip(rows, texts, lists, strict=True):
                own = text.encode().split()
                for p in spans_of:
                    words = b" ".join(own[p["s"] : p["s"] + p["n"] + window - 1])
                    for o, v in zip(out, (rid, p["chain"], p["s"], p["n"], hashlib.blake2b(words, digest_size=16).digest()), strict=True):
                        o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["rid", "chain", "s", "n", "digest"])

    return run


def _cut(window: int):
    def run(batches):
        for b in (x.slice(i, 512) for x in batches for i in range(0, x.num_rows, 512)):
            doc, texts, lists = b.column("doc_id"), b.column("text").to_pylist(), b.column("spans").to_pylist()
            words, removed, kept = [], [], []
            for text, found in zip(texts, lists, strict=True):
                own = (text or "").encode().split()
                hit = np.zeros(len(own) + 1, np.int32)
                for p in found or ():
                    hit[p["s"]] += 1
                    hit[p["s"] + p["n"] + window - 1] -= 1
                gone = np.cumsum(hit[:-1]) > 0
                words.append(len(own))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(own if not removed[-1] else [own[i] for i in np.flatnonzero(~gone)]).decode())
            yield pa.RecordBatch.from_arrays([doc, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _units(texts: DataFrame, window: int, k: int) -> DataFrame:
    """Occurrences (rid, s, n, unit): each unit of repeated windows at each place where it stands, n windows from word s on."""
    grams = texts.mapInArrow(_emit_paths(window, k, True), "m long").groupBy("m").count().filter("count > 1").select("m")
    found = materialise(meet(texts.mapInArrow(_emit_paths(window, k, False), PATHS), grams, ["m"], "rid"), "paths")
    contents = materialise(found.groupBy("m", "c").agg(F.min(F.struct("rid", "s", "n")).alias("at"), F.count("*").alias("weight")), "contents")
    branching = contents.groupBy("m").count().filter("count > 1").select("m", F.lit(True).alias("branches"))
    several = meet(contents, branching, ["m"], "c")
    wanted = several.select("at.rid", F.struct("at.s", "at.n", "m", "c", "weight").alias("p")).groupBy("rid").agg(F.collect_list("p").alias("paths"))
    edges = materialise(texts.join(wanted, "rid").select("text", "paths").mapInArrow(_emit_edges(window), EDGES), "edges")
    # an edge's ways on and back, over all the paths that hold it
    ways = edges.groupBy("m", "e").agg(F.sum("weight").alias("x"), *(f(c).alias(f"{n}_{c}") for c in ("before", "after") for n, f in (("least", F.min), ("most", F.max))))
    only = lambda c: (F.col(f"least_{c}") == F.col(f"most_{c}")) & (F.col(f"least_{c}") != NONE)
    twice = ways.filter("x > 1").select("m", "e", only("before").alias("one_before"), only("after").alias("one_after"))
    spelt = meet(edges.select("m", "c", "i", "e"), twice, ["m", "e"], "c")
    own = Window.partitionBy("m", "c").orderBy("i")
    follows = (F.lag("i").over(own) == F.col("i") - 1) & F.lag("one_after").over(own) & F.col("one_before")
    run = F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(own)
    runs = spelt.withColumn("run", run).groupBy("m", "c", "run").agg(F.min_by("e", "i").alias("e"), F.min("i").alias("i"), F.count("*").cast("int").alias("n"))
    runs = runs.groupBy("m", "c").agg(F.collect_list(F.struct("i", "n", F.xxhash64("m", "e").alias("unit"))).alias("units"))
    told = materialise(meet(found, branching, ["m"], "rid", "left"), "told")
    whole = told.filter("branches IS NULL").select("rid", "s", "n", F.xxhash64("m", "c").alias("unit"))
    partly = meet(told.filter("branches").drop("n", "branches"), runs, ["m", "c"], "rid").select("rid", "s", F.explode("units").alias("u"))
    return whole.unionByName(partly.select("rid", (F.col("s") + F.col("u.i")).alias("s"), F.col("u.n").alias("n"), F.col("u.unit").alias("unit")))


def _chains(units: DataFrame) -> DataFrame:
    """(unit, chain, ahead) of the units that make chains with others: the chain's first unit, and how many windows of the chain come ahead."""
    row = Window.partitionBy("rid").orderBy("s")
    touching = F.when(F.col("s") + F.col("n") == F.lead("s").over(row), F.lead("unit").over(row))
    steps = units.withColumn("after", touching).withColumn("before", F.when(F.lag("s").over(row) + F.lag("n").over(row) == F.col("s"), F.lag("unit").over(row)))
    one = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    ends = materialise(steps.groupBy("unit").agg(F.min("n").alias("n"), one("before").alias("before"), one("after").alias("after")).filter("before IS NOT NULL OR after IS NOT NULL"), "ends")
    links = ends.filter("after IS NOT NULL").select(F.col("unit").alias("chain"), F.col("after").alias("unit"), F.col("n").alias("ahead"))
    links = links.join(ends.select("unit", "before"), "unit").filter("before = chain").select("unit", "chain", F.col("ahead").cast("long").alias("ahead"))
    chains = materialise(links, "chains")
    while True:
        # each turn a unit looks as far ahead again as the one that it has reached
        far = chains.select(F.col("unit").alias("chain"), F.col("chain").alias("further"), F.col("ahead").alias("more"))
        new = materialise(chains.join(far, "chain", "left").select("unit", F.coalesce("further", "chain").alias("chain"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead"), F.col("further").isNotNull().alias("went")), "chains")
        if new.filter("went").isEmpty():
            return chains
        chains = new.drop("went")


def remove_repeats(docs: DataFrame, window: int = 35, k: int = 10) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept), one for each row of docs; kept is what is left, joined by one space.

    A word goes if a window of `window` words that covers it also starts anywhere else, in
    the same row or another. All rows count, those with equal doc_id too (each is a document
    of its own); null and empty texts have no words; rows under `window` words keep all; no rows
    give no rows. Other columns of docs, whatever their names, are not looked at.
    """
    if not 0 < k <= window:
        raise ValueError("k must be from 1 to window")
    rows = with_row_id(docs, ["text"])
    texts = rows.select("rid", "text")
    listed = F.collect_list(F.struct("s", "n", "chain")).alias("spans")
    with scope(docs.sparkSession):
        units = materialise(_units(texts, window, k), "units")
        placed = meet(units, _chains(units), ["unit"], "rid", "left")
        start = (F.col("s") - F.coalesce("ahead", F.lit(0))).cast("int").alias("s")
        spans_of = materialise(placed.select("rid", F.coalesce("chain", "unit").alias("chain"), start, "n").groupBy("rid", "chain", "s").agg(F.sum("n").cast("int").alias("n")), "spans")
        read = materialise(texts.join(spans_of.groupBy("rid").agg(listed), "rid").mapInArrow(_digests(window), "rid long, chain long, s int, n int, digest binary"), "digests")
        alike = read.groupBy("chain", "digest").count().filter("count > 1").select("chain", "digest")
        good = materialise(meet(read, alike, ["chain", "digest"], "rid").groupBy("rid").agg(listed), "repeats", keep=True)
    doc = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(good, "rid", "left").select("doc_id", "text", "spans").mapInArrow(_cut(window), f"doc_id {doc}, n_words long, n_removed long, kept string")
