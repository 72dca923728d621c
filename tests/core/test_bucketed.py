"""Snapshots in buckets: only those that a batch touches are written, and a batch counts once."""

import random

from routeloom.operators import snapshots
from routeloom.streaming.bucketed import BucketedSnapshot

SCHEMA = "id long, kind string, value long"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_batches_equal_a_plain_table(spark, tmp_path):
    r, want = random.Random(2), {}
    table = BucketedSnapshot(spark, str(tmp_path), SCHEMA, ["id"], buckets=8)
    assert table.read().count() == 0
    for number in range(4):
        rows = [(r.choice([None, *range(40)]), r.choice("ab"), r.randint(0, 99)) for _ in range(15)]
        assert table.apply(spark.createDataFrame(rows, SCHEMA), number, ["value", "kind"], rules={"value": snapshots.greatest})
        for i in {x[0] for x in rows} - {None}:
            _, kind, value = min((x for x in rows if x[0] == i), key=lambda x: (x[2], x[1]))
            want[i] = (kind, max(value, want[i][1]) if i in want else value)
        assert {x.id: (x.kind, x.value) for x in table.read().collect()} == want
    again = BucketedSnapshot(spark, str(tmp_path), SCHEMA, ["id"], buckets=99)
    assert again.buckets == 8 and again.read().count() == len(want)
    table.vacuum()
    assert {x.id: (x.kind, x.value) for x in table.read().collect()} == want
    assert [p.name for p in (tmp_path / "manifest").glob("*.json")] == ["3.json"]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = BucketedSnapshot(spark, str(tmp_path), SCHEMA, ["id"], buckets=16)
    table.apply(spark.range(500).selectExpr("id", "'a' AS kind", "id AS value"), 0, ["value"])
    before = files(tmp_path)
    one = spark.createDataFrame([(7, "b", -1)], SCHEMA)
    assert table.apply(one, 1, ["value"])
    after = files(tmp_path)
    assert before.items() <= after.items() and len(after) == len(before) + 1
    # the same batch again changes nothing
    assert not table.apply(one, 1, ["value"]) and files(tmp_path) == after
    assert table.read().count() == 500 and [tuple(x) for x in table.read_keys(one).collect()] == [(7, "b", -1)]
    assert table.read_keys(one).inputFiles() and len(table.read_keys(one).inputFiles()) == 1


def test_a_batch_that_broke_before_its_manifest_is_not_seen(spark, tmp_path):
    table = BucketedSnapshot(spark, str(tmp_path), SCHEMA, ["id"], buckets=4)
    table.apply(spark.range(20).selectExpr("id", "'a' AS kind", "id AS value"), 0, ["value"])
    broken = tmp_path / "data" / "batch=1" / "_bucket=0"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half")
    assert table.read().count() == 20
    assert table.apply(spark.createDataFrame([(100, "n", 1)], SCHEMA), 1, ["value"]) and table.read().count() == 21
    # a batch of nothing leaves a manifest and no folder
    assert table.apply(spark.createDataFrame([(None, "n", 1)], SCHEMA), 2, ["value"]) and table.read().count() == 21


def test_streams_fold_their_batches(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1), (2, "a", 2)], SCHEMA).coalesce(1).write.parquet(str(source))
    table = BucketedSnapshot(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=4)
    for extra in ([], [(2, "z", 9), (3, "z", 9)]):
        if extra:
            spark.createDataFrame(extra, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        table.keep(spark.readStream.schema(SCHEMA).parquet(str(source)), ["value"], str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 1), (2, "z", 9), (3, "z", 9)]
