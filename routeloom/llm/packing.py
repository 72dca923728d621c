"""Best-fit packing of tokenised documents into sequences, by matching of large items.

Only lengths matter for a packing, and there are at most `capacity` of them, so the packing
is worked out on the histogram of lengths: a plan of bin classes, each a multiset of lengths
and a number of bins. Pieces over a third of the capacity meet at most twice in a bin: each,
from the longest on, is matched with the longest other such piece that still fits. Then the
shorter ones, from the longest on, go to the tightest gap that takes them. Every step uses up
a length or a gap class, so the plan has a few thousand classes whatever the input.

Spark does the rest: pieces get a rank among those of their length (counted in salted
groups), and the rank tells the bin.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.llm._common import materialise, scope, tokenizer_path, with_row_id
from routeloom.llm._tokens import binary, encoded

#: Rows of a salted group, and the most groups that there can be besides one for each length.
GROUP, GROUPS = 128, 200_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin classes (bins, [(length, pieces of it in a bin), ...]) that hold counts[length] pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    small = sorted((n for n in left if 3 * n <= capacity), reverse=True)
    bins: list[list] = []
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at < 0:
            bins.append([left[a], [(a, 1)]])
            large.pop()
            continue
        b = large[at]
        if a == b:
            if left[a] > 1:
                bins.append([left[a] // 2, [(a, 2)]])
            if left[a] % 2:
                bins.append([1, [(a, 1)]])
            large.pop()
            continue
        n = min(left[a], left[b])
        bins.append([n, [(a, 1), (b, 1)]])
        for x in (a, b):
            left[x] -= n
            if not left[x]:
                large.remove(x)
    gaps: dict[int, list[int]] = {}
    free = lambda k: capacity - sum(n * m for n, m in bins[k][1])
    for k in range(len(bins)):
        gaps.setdefault(free(k), []).append(k)
    order = sorted(gaps)
    for n in small:
        todo = left[n]
        while todo:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                m = capacity // n
                whole, rest = divmod(todo, m)
                for many, each in ((whole, m), (1, rest)):
                    if many and each:
                        bins.append([many, [(n, each)]])
                        gap = free(len(bins) - 1)
                        if gap not in gaps:
                            gaps[gap] = []
                            bisect.insort(order, gap)
                        gaps[gap].append(len(bins) - 1)
                break
            gap = order[at]
            k = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            many, m = bins[k][0], min(gap // n, todo)
            full = min(many, todo // m)
            if full < many:
                bins.append([many - full, list(bins[k][1])])
                bins[k][0] = full
                gaps.setdefault(gap, []).append(len(bins) - 1)
                if len(gaps[gap]) == 1:
                    bisect.insort(order, gap)
            bins[k][1].append((n, m))
            todo -= full * m
            gap = free(k)
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append(k)
    return [(many, each) for many, each in bins]


def _places(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, columns: first rank, first bin, pieces in a bin, offset of the first."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first = 0
    for many, each in bins:
        offset = 0
        for n, m in each:
            r = ranks.get(n, 0)
            out.setdefault(n, []).append((r, first, m, offset))
            ranks[n] = r + many * m
            offset += n * m
        first += many
    return {n: np.array(x, np.int64).T for n, x in out.items()}


def _cut(path: str, end_id: int, capacity: int):
    def run(batches):
        for b, ids, n in encoded(batches, path, end_id):
            each = -(-n // capacity)
            at = np.repeat(np.arange(len(n)), each)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            start = piece * capacity
            length = np.minimum(capacity, n[at] - start)
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(rows), b.column("rid").take(rows), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), binary(ids.astype("<u4"), length)],
                ["doc_id", "rid", "piece", "start", "length", "ids"],
            )

    return run


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids, sequence_id, offset), one for each piece of a document.

    ids are little-endian unsigned 32-bit numbers. A document's ids end with end_id (null and
    empty texts have it alone); those with more than capacity are cut into pieces of capacity
    and a rest. sequence_id counts from 0, offset is the place of the piece's first id there;
    sequences have no gaps and no padding. Rows with equal doc_id, or none, are documents of
    their own; no rows give no rows; other columns, whatever their names, aren't looked at.
    """
    doc = docs.schema["doc_id"].dataType.simpleString()
    rows = with_row_id(docs, ["text"])
    pieces = rows.mapInArrow(_cut(tokenizer_path(tokenizer), end_id, capacity), f"doc_id {doc}, rid long, piece int, start long, length long, ids binary")
    with scope(docs.sparkSession):
        pieces = materialise(pieces, "pieces", keep=True)
    counts = dict(pieces.groupBy("length").count().collect())  # at most `capacity` rows
    group = max(GROUP, sum(counts.values()) // GROUPS)
    spark = docs.sparkSession
    salts = spark.createDataFrame([(n, c // group + 1) for n, c in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("rid", "piece"), F.col("salts")))
    # at most GROUPS groups and one for each length
    sizes = salted.groupBy("length", "salt").count().orderBy("length", "salt").toPandas() if counts else pd.DataFrame({"length": [], "salt": [], "count": []})
    sizes["before"] = sizes.groupby("length")["count"].cumsum() - sizes["count"]
    before = {n: g.to_numpy(np.int64) for n, g in sizes.groupby("length")["before"]}
    box = spark.sparkContext.broadcast((before, _places(plan(counts, capacity))))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, salt: pd.Series, nth: pd.Series) -> pd.DataFrame:
        before, places = box.value
        n, s, r = (x.to_numpy(np.int64) for x in (length, salt, nth))
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        cuts = np.flatnonzero(np.diff(n[order], prepend=-1))
        for at in np.split(order, cuts[1:]) if len(order) else ():
            own = int(n[at[0]])
            rank = before[own][s[at]] + r[at] - 1
            first, bins, each, offset = places[own]
            k = np.searchsorted(first, rank, "right") - 1
            seq[at] = bins[k] + (rank - first[k]) // each[k]
            off[at] = offset[k] + (rank - first[k]) % each[k] * own
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("rid", "piece"))
    placed = salted.withColumn("nth", nth).withColumn("at", place("length", "salt", F.col("nth").cast("long")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset")
