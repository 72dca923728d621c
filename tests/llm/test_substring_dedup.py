import re
from collections import Counter

from routeloom.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def check(spark, rows, window, k):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in remove_repeats(df, window, k).collect()], key=str)
    assert got == brute(rows, window)


def test_against_brute_force(spark):
    import random

    r = random.Random(3)
    base = [f"w{r.randrange(400)}" for _ in range(400)]
    rows = []
    for d in range(60):
        a, b = r.randrange(350), r.randrange(40)
        own = [f"x{r.randrange(30)}é" for _ in range(r.randrange(40))]
        rows.append((d, (" \n" if d % 3 else "\t").join(own + base[a : a + b] + own[:5])))
    rows += [(60, rows[5][1]), (61, None), (62, ""), (63, "same " * 300), (64, " \n "), (65, "a b"), (66, rows[7][1].replace("w1", "W1"))]
    check(spark, rows, 8, 3)
    check(spark, rows, 5, 5)
    check(spark, rows, 1, 1)


def test_repeated_ids_and_nulls(spark):
    t = " ".join(f"q{i}" for i in range(20))
    check(spark, [(1, t), (1, t), (1, "z y x"), (None, t + " more"), (None, None)], 6, 2)
    check(spark, [], 6, 2)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("rid", df_lit()).withColumn("m", df_lit())
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted([tuple(r) for r in remove_repeats(df).collect()], key=str)
    assert got == brute(rows, 35)


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")
