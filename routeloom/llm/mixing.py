"""A mix of sources by target weights: how many words of each document it takes.

Sources get targets by their weights, limited by how often a source may be repeated; the
limits are resolved at once, from sources sorted by the level at which each reaches its own.
Documents get keys that are random but fixed (a digest of doc_id), are sorted by range within
their source, and distributed prefix sums of their sizes tell where the source's budget ends:
whole epochs first, then the documents before the cut once more, and of the document at the
cut as many words as are left.

All is done by DataFrame operations on built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.llm._common import MEASURED, materialise, running_sums, scope, with_row_id

WORD = r"[^\x20\x09-\x0D]+"


def _exact(c: str | Column) -> Column:
    """Products of two such values are exact."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Rows (tree, source_size, target) of the sources in rows (tree, size), tree being their order.

    Sources share the sum of all sizes by weights that repeat; a target stops at `most` times
    its source's size, and the excess goes to the others by their weights. At a common level
    (words for each unit of weight) a source is full that reaches its limit below it, so the
    full ones are the first in the order of that limit, and two prefix sums tell each by itself.
    """
    if not weights or min(weights) < 1 or most < 1:
        raise ValueError("weights are whole numbers from 1 on, and so is most")
    whole = sizes.groupBy("tree").agg(F.sum("size").alias("source_size"), F.lit(1).cast("long").alias("one"))
    ranked = running_sums(materialise(whole, "sources"), None, ["tree"], {"rank": "one"})
    of_rank = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), (F.col("rank") % len(weights) + 1).cast("int"))
    # the limit for each unit of weight, as a whole number
    level = F.col("source_size") * of_rank([math.lcm(*weights) // w for w in weights])
    own = materialise(ranked.select("tree", "source_size", of_rank(weights).alias("weight"), (F.col("source_size") * most).alias("limit"), level.alias("level")), "weights")
    total, heavy = own.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return own.select("tree", "source_size", F.lit(0.0).alias("target"))
    sums = running_sums(own, None, ["level", "tree"], {"limits": "limit", "heavier": "weight"})
    full = _exact(F.lit(total) - F.col("limits")) * _exact("weight") > _exact("limit") * _exact(F.lit(heavy) - F.col("heavier"))
    sums = materialise(sums.withColumn("full", full), "targets")
    used, gone = sums.filter("full").agg(F.coalesce(F.sum("limit"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    shared = _exact(F.lit(total - used)) * _exact("weight")
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared.cast("double") / F.lit(float(heavy - gone) or 1.0))
    return sums.select("tree", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, extra columns, size, source_size, target, epochs, cut, taken), one for each row of docs.

    size is the number of words, 0 for null. Sources are ordered by code point, null last,
    and targets come from them (see targets). The mix takes a document whole `epochs` times,
    and once more its first `cut` words; taken is the sum. A source gives its target, rounded
    down, to the word. The order within a source is that of digests of seed and doc_id, then
    of doc_id, size and a digest of the text, so reruns agree, and rows with equal doc_id
    stay apart; where all of these are equal rows are alike. Sources without words have target
    0. Other columns, whatever their names, aren't looked at; no rows give no rows. extra may
    name columns but none of the result's.
    """
    own = docs.select("doc_id", F.struct(*extra).alias("rest") if extra else F.lit(None).cast("int").alias("rest"), "source", "text")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = own.select(F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("tree"), "doc_id", "rest", size.alias("size"), key.alias("key"), F.xxhash64("text").alias("text_key"))
    with scope(docs.sparkSession, MEASURED):
        sized = materialise(sized, "sizes")
        placed = running_sums(sized, "tree", ["key", "doc_id", "size", "text_key"], {"before": "size"}, targets(sized, weights, most))
        budget = F.floor("target")
        epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
        left = budget - F.col("epochs") * F.col("source_size") - F.col("before")
        cut = F.greatest(F.least(left, F.col("size")), F.lit(0)).cast("long")
        placed = placed.withColumn("epochs", epochs).withColumn("cut", cut)
        out = placed.select("doc_id", *(F.col("rest")[c].alias(c) for c in extra), "size", "source_size", "target", "epochs", "cut", (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"))
        return materialise(out, "mix", keep=True)


def mixed_texts(docs: DataFrame, **settings) -> DataFrame:
    """Rows (doc_id, source, epoch, text): the texts that the mix takes, each once for each epoch, the last one cut after its words.

    A text that is taken whole stays to the letter; a cut one ends with its last word. Texts
    travel once, when the mix is known.
    """
    rows = with_row_id(docs, ["source", "text"])
    taken = mix(rows, extra=("rid",), **settings).filter("taken > 0").select("rid", "size", "epochs", "cut")
    each = rows.join(taken, "rid").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs")))).filter("epoch < epochs OR cut > 0")
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    first = F.array_join(F.slice(words, F.lit(1), F.col("cut").cast("int")), "")
    return each.select("doc_id", "source", "epoch", F.when((F.col("epoch") < F.col("epochs")) | (F.col("cut") == F.col("size")), F.col("text")).otherwise(first).alias("text"))
