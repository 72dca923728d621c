import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from routeloom.llm.mixing import mix, mixed_texts

SCHEMA = "doc_id long, source string, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares the excess again and again until no target is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        heavy = sum(w[s] for s in order if s not in full)
        out = {s: Fraction(most * sizes[s]) if s in full else Fraction(rest * w[s], heavy) for s in order}
        above = {s for s in order if out[s] > most * sizes[s]}
        if not above:
            return out
        full |= above


def plain(rows, **settings):
    sizes = {}
    for r in rows:
        sizes[r[1]] = sizes.get(r[1], 0) + len(words(r[2]))
    targets, out = plain_targets(sizes, **settings), []
    for s, size in sizes.items():
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, len(words(r[2]))))
        budget, before = int(targets[s]), 0
        epochs = budget // size if size else 0
        for r in own:
            n = len(words(r[2]))
            out.append((r[0], n, size, float(targets[s]), epochs * n + max(0, min(n, budget - epochs * size - before))))
            before += n
    return out


def some_rows(seed, sources, n):
    r = random.Random(seed)
    names = [*(f"s{i}" for i in range(sources)), "É", "~", None, ""]
    # the first source has a third of all
    return [(i, names[0] if r.random() < 1 / 3 else r.choice(names), r.choice([None, "", " \n", "w " * r.randint(1, 40), "a\tb\vc\x1fd e"])) for i in range(n)]


@pytest.mark.parametrize(
    "rows, settings",
    [
        ([], {}),
        ([(1, "a", None), (2, None, "")], {}),
        ([(1, "a", "b c d")], {}),
        (some_rows(1, 3, 400), {}),
        (some_rows(2, 40, 900), {}),
        ([(i, "big" if i else "small", "w " * 50) for i in range(60)], {"weights": (1, 50), "most": 2}),
        ([(4, "a", "x y"), (4, "a", "x y"), (4, "a", "x"), (None, "a", "z"), (None, "b", "one two three four five six seven eight nine ten")], {}),
    ],
)
def test_equals_a_plain_loop(spark, rows, settings):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("x"), "tree": F.lit(1), "key": F.lit(2)})
    got = mix(docs, **settings).select("doc_id", "size", "source_size", "target", "taken").collect()
    key = lambda r: repr((*r[:3], round(r[3], 6), r[4]))
    assert sorted(map(key, got)) == sorted(map(key, plain(rows, **settings)))


def test_sources_give_their_targets_and_texts_follow(spark):
    rows = some_rows(5, 9, 700)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mix(docs, extra=("source",)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(r.taken == int(r.target) and r.over <= 0 for r in out)
    taken = {r.doc_id: r.taken for r in mix(docs).collect()}
    texts, whole = {}, {r[0]: r[2] for r in rows}
    for r in mixed_texts(docs).collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert {i: sum(len(words(t)) for t in own) for i, own in texts.items()} == {i: n for i, n in taken.items() if n}
    for i, own in texts.items():
        cut = [t for t in own if t != whole[i]]
        assert len(cut) <= 1 and all(whole[i].startswith(t) for t in cut)
    assert mix(docs).exceptAll(mix(docs)).isEmpty()
