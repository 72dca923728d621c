import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from routeloom.llm.near_dedup import _sequence, aligned, near_duplicates, prefix_pairs, similar, without_near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least=0.8, k=5):
    def matched(a, b):
        t = np.zeros(len(b) + 1, int)
        for x in a:
            new = t.copy()
            for j, y in enumerate(b):
                new[j + 1] = max(new[j], t[j + 1], t[j] + (x == y))
            t = new
        return t[-1]

    sh = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        sh[d] = [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    top = {d: d for d in sh}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sh)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            a, b = sh[x], sh[y]
            if not a or not b:
                continue
            both = sum((Counter(a) & Counter(b)).values())
            if both >= least * (len(a) + len(b) - both) and (m := matched(a, b)) >= least * (len(a) + len(b) - m):
                top[max(find(x), find(y))] = min(find(x), find(y))
    return {d: find(d) for d in sh}


def test_alignment():
    r = random.Random(1)
    for _ in range(200):
        a = [r.randrange(4) for _ in range(r.randrange(12))]
        b = [r.randrange(4) for _ in range(r.randrange(12))]
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + (x == y))
        m = int(t[-1, -1])
        left = len(a) + len(b) - 2 * m
        assert aligned(a, b, 100) == m and aligned(a, b, left) == m and (left == 0 or aligned(a, b, left - 1) == -1)


def test_alignment_of_long_sequences():
    r = random.Random(2)
    for n in (500, 900):
        a = [r.randrange(n // 2) for _ in range(n)]
        b = [x for x in a if r.random() > 0.1]
        b = [r.randrange(n) if r.random() < 0.04 else x for x in b]
        t = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(new[j], t[j + 1], t[j] + (x == y)))
            t = new
        left = len(a) + len(b) - 2 * t[-1]
        assert left > 60 and aligned(a, b, left) == t[-1] == aligned(a, b, left + 9) and aligned(a, b, left - 1) == -1


def test_alignment_of_a_hundred_thousand_words_takes_seconds():
    r = random.Random(3)
    a = list(range(100_000))
    b = [x for x in a if r.random() > 0.09]
    begun = time.time()
    assert aligned(a, b, 22_000) == len(b) and time.time() - begun < 5
    assert aligned(a, a[::-1], 22_000) == -1


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("rid", "key", "label", "u")})
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == brute(rows)
    return got


def test_edited_copies(spark):
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(500)]
    rows, d = [], 0
    for g in range(12):
        base = r.choices(vocab, k=r.randrange(40, 200))
        for c in range(r.choice([1, 2, 12])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
                own[r.randrange(len(own))] = f"n{r.random()}"
            rows.append((d, " ".join(own)))
            d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, " "), (d + 3, "a b"), (d + 4, "a  b"), (d + 5, "a b c"), (d + 6, "z " * 400), (d + 7, "z " * 401)]
    got = check(spark, rows)
    assert got[d + 3] == got[d + 4] != got[d + 5] and got[d] != got[d + 1]


def test_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "q"), (2, "x")], "doc_id long, text string")
    out = near_duplicates(rows).collect()
    assert len(out) == 4 and len({r.class_id for r in out}) == 3
    assert near_duplicates(rows.limit(0)).count() == 0


def test_reordered_and_kept_columns(spark):
    words = [f"w{i}" for i in range(400)]
    turned = words[200:] + words[:200]
    rows = [(1, " ".join(words), "a", 5), (2, " ".join(turned), "b", 6), (3, " ".join(words[:395]), "c", 7), (4, "q " * 30_000, "d", 8), (5, "q " * 30_001, "e", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string, label int")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}
    assert sorted(without_near_duplicates(df).collect()) == sorted(df.filter("doc_id IN (1, 2, 4)").collect())


def test_documents(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_families_under_a_template(spark):
    rows = []
    # the template's shingles decide most sketches, so most members share large buckets only
    for share, own in ((164, 36), (170, 30)):
        template = [f"t{share}x{i}" for i in range(share)]
        for g in range(100):
            family = [f"f{share}x{g}x{i}" for i in range(own)]
            for c in range(2):
                w = template + family
                for i in (4, 10, 16, 22):
                    w[share + i] = f"n{share}x{g}x{c}x{i}"
                rows.append((len(rows), " ".join(w)))
    # every word stands once in a text, so the order says nothing more than the sets
    w = {d: t.split(" ") for d, t in rows}
    sh = {d: {tuple(x[i : i + 5]) for i in range(len(x) - 4)} for d, x in w.items()}
    links = [(u, v) for u in sh for v in sh if u < v and len(sh[u] & sh[v]) >= 0.8 * len(sh[u] | sh[v])]
    first = {v: u for u, v in links}
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(links) == 200 and got == {d: first.get(d, d) for d in sh}


def test_prefix_pairs(spark):
    r = random.Random(8)
    rows = []
    for g in range(30):
        base = r.choices("abcdef", k=r.randrange(3, 60))
        for c in range(4):
            own = [r.choice("abcdef") if r.random() < 0.03 else x for x in base] + r.choices("abcdef", k=r.randrange(3))
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "rid long, text string")
    found = prefix_pairs(df, df.select("rid", F.col("rid").alias("label")), 2, 0.8).select(F.least("u", "v"), F.greatest("u", "v")).collect()
    seqs = {d: _sequence(t, 2) for d, t in rows}
    alike = {(u, v) for u in seqs for v in seqs if u < v and similar(seqs[u], seqs[v], 0.8)}
    assert len(alike) > 50 and alike <= {tuple(x) for x in found}


def test_few_rows_go_to_every_task(spark, monkeypatch):
    from routeloom.llm import near_dedup

    r = random.Random(9)
    rows = []
    for g in range(3):
        base = [f"b{g}x{i}" for i in range(120)]
        for c in range(40):
            own = list(base)
            for _ in range(r.choice([1, 3, 6])):
                own[r.randrange(len(own))] = f"n{len(rows)}x{r.random()}"
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def run():
        # shuffles have numbers in the order in which they are planned
        before = spark.sparkContext._jsc.sc().newShuffleId()
        out = {x.doc_id: x.class_id for x in near_duplicates(df).collect()}
        return out, spark.sparkContext._jsc.sc().newShuffleId() - before

    few, shuffles = run()
    monkeypatch.setattr(near_dedup, "_FEW", -1)
    many, more = run()
    assert few == many == brute(rows) and 2 * shuffles < more
