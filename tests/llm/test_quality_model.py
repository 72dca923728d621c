import zlib

import numpy as np
from pyspark.sql import functions as F

from routeloom.llm.quality_model import Additive, score, train


def test_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    d = d.withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    got = {r.doc_id: r for r in score(d, train(d, labels)).collect()}
    assert len(got) == d.count()
    out = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(out) > 30 and np.mean([a == b for a, b in out]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "a b"), (3, "\n"), (4, "w " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (4, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = score(docs, train(docs, known)).collect()
        assert len(rows) == 6 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert score(docs.limit(0), train(docs.limit(0), labels)).count() == 0


def test_interaction_is_learnt():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = Additive().fit(x, y).score(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.85
