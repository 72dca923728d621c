"""Snapshots of which a batch rewrites only the buckets that it touches.

Rows lie in buckets by a hash of their key. A batch writes new folders for its buckets and
then one small manifest, which says what folder each bucket is in; readers follow the latest
manifest, so they see a batch whole or not at all, and folders of other buckets stay as they
are. A manifest is made once: of two writers of the same batch one fails.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators.snapshots import Rule, first_per_key, upsert


class BucketedSnapshot:
    """The table of a schema under the folder root, its rows unique by keys; the number of buckets holds for the folder's life."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        known = self._latest()
        self.buckets = known["buckets"] if known else buckets

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self, before: int | None = None) -> dict | None:
        """The manifest of the last batch (before one), or None."""
        p, fs = self._path("manifest/*.json")
        numbers = sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.globStatus(p) or ())
        numbers = [n for n in numbers if before is None or n < before]
        if not numbers:
            return None
        text = self.spark.read.text(f"{self.root}/manifest/{numbers[-1]}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as the last whole batch has left it; no rows if there is none."""
        known = self._latest()
        return self._rows(sorted(f"{self.root}/{f}" for f in known["folders"].values()) if known else [])

    def read_keys(self, wanted: DataFrame) -> DataFrame:
        """The rows whose keys are in wanted; only buckets that can hold them are read. Their numbers, as many as there are buckets at most, go through the driver."""
        known = self._latest()
        touched = self._touched(wanted)
        rows = self._rows(sorted(f"{self.root}/{known['folders'][b]}" for b in touched if b in known["folders"]) if known else [])
        return rows.join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def _touched(self, rows: DataFrame) -> list[str]:
        return [str(r["b"]) for r in rows.select(self._bucket().alias("b")).distinct().collect()]

    def apply(self, batch: DataFrame, number: int, order: list[Column | str], rules: dict[str, Rule] | None = None, keep: Column | None = None) -> bool:
        """Folds a batch into the table as upsert() does, its first row in order counting for a key; False if the batch has been applied already.

        Rows with a null in their key go. Batches come in the order of their numbers; one that is
        repeated after a failure writes its folders anew before its manifest.
        """
        last = self._latest()
        if last and last["batch"] >= number:
            return False
        rows = batch
        for k in self.keys:
            rows = rows.filter(F.col(k).isNotNull())
        rows = first_per_key(rows, self.keys, order)
        folders = dict(last["folders"]) if last else {}
        touched = self._touched(rows)
        if touched:
            old = self._rows([f"{self.root}/{folders[b]}" for b in touched if b in folders])
            new = upsert(old, rows, self.keys, rules, keep).drop("change").withColumn("_bucket", self._bucket())
            out = f"data/batch={number}"
            new.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/{out}")
            folders |= {b: f"{out}/_bucket={b}" for b in touched}
        p, fs = self._path(f"manifest/{number}.json")
        stream = fs.create(p, False)
        try:
            stream.write(bytearray(json.dumps({"batch": number, "buckets": self.buckets, "folders": folders}).encode()))
        finally:
            stream.close()
        return True

    def vacuum(self) -> None:
        """Deletes folders that the last manifest doesn't name, and older manifests; no reader may be at them."""
        known = self._latest()
        if not known:
            return
        named = {f"{f}" for f in known["folders"].values()}
        p, fs = self._path("data/batch=*/_bucket=*")
        for f in fs.globStatus(p) or ():
            own = f.getPath()
            if f"data/{own.getParent().getName()}/{own.getName()}" not in named:
                fs.delete(own, True)
        p, fs = self._path("manifest/*.json")
        for f in fs.globStatus(p) or ():
            if f.getPath().getName() != f"{known['batch']}.json":
                fs.delete(f.getPath(), False)

    def keep(self, stream: DataFrame, order: list[Column | str], checkpoint: str, rules: dict[str, Rule] | None = None, keep: Column | None = None, change: Callable[[DataFrame], DataFrame] = lambda d: d):
        """Starts a query that applies each arriving batch, and ends when no input is left."""
        fold = lambda batch, number: self.apply(change(batch), number, order, rules, keep)
        return stream.writeStream.foreachBatch(lambda b, n: fold(b, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
