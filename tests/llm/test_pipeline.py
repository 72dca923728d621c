import os

import pytest
from pyspark.sql import functions as F

from routeloom.llm import pipeline
from routeloom.llm.decontaminate import words_of
from tests.llm.test_near_dedup import brute as classes
from tests.llm.test_pii import brute as personal
from tests.llm.test_quality_rules import base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage makes of documents with a few odd rows and columns more."""
    root = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("rid", F.lit("clash"))
    more = [(10**6 + i, t, "en", None, None) for i, t in enumerate([None, "", "a b c d e f g h i j k l", "a b c d e f g h i j  k l", "x " * 30])]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), True)
    out = [docs]
    for name, f in pipeline.STAGES:
        f(spark, out[-1], SF).write.parquet(f"file://{root}/{name}")
        out.append(spark.read.parquet(f"file://{root}/{name}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, stages):
    docs, good, apart, clean, masked, packed = stages
    assert all(x.columns == docs.columns for x in stages[:5])
    a, b, c, d, e = map(texts, stages[:5])
    assert set(b) == {k for k, t in a.items() if not base(t)[-1]} and all(b[k] == a[k] for k in b)
    own = classes(list(b.items()))
    assert set(c) == set(own.values())
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    parts = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    for k, t in c.items():
        w = words_of(t)
        if not any(tuple(w[i : i + 10]) in parts for i in range(len(w))):
            assert d[k] == t
        elif k in d:
            assert len(d[k]) < len(t)
    for k, t in d.items():
        assert e[k] == t if not personal(t) else (e[k] != t and not personal(e[k]))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(e)
    assert all(r.n_chars == len(r.text) for r in masked.collect() if r.text is not None)


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 100 and os.path.isdir(SF)


def test_odd_tables(spark):
    """Empty tables, repeated and null ids, columns with clashing names: rows stay rows in every stage."""
    clash = ("rid", "r", "h", "host", "key", "kept", "start", "label")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(f"own {c}") for c in clash})
    some = docs.filter("doc_id < 20")
    twice = some.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("long")))
    for name, f in pipeline.STAGES:
        assert f(spark, docs.limit(0), SF).count() == 0
        out = f(spark, twice, SF)
        if name == "packing":
            assert out.filter("piece = 0").count() == twice.count()
            continue
        assert out.columns == twice.columns
        rows = out.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in clash)
        # of three equal rows all stay, or one where copies go
        n = {d: sum(r.text == d for r in rows) for d in {r.text for r in rows}}
        assert name == "benchmark_decontamination" or all(k % 3 == 0 for k in n.values()) or name == "near_dedup"
        if name == "near_dedup":
            assert all(k == 1 for t, k in n.items() if t and t.strip())
