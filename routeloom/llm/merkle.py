"""A Merkle manifest of a dataset: one digest for all rows, and a proof for each row.

A row's leaf is the digest of its columns. The leaves of a source, in order of doc_id, form a
tree: every `FAN` consecutive nodes of a level become one node of the next, until one is
left. The sources' last nodes form one more tree in the same way.

The nodes are kept in a store: leaves are sorted into runs and stream from there to the first
level, each level is made from the one before alone, and is a folder of Parquet of its own.
A node has a coordinate (tree, level, place), so proofs come from merging levels by
coordinate, from the root down. Sixteen nodes at most meet in a group, whatever share of the
rows a source has, and the table of one level is a sixteenth of that before it.

All steps are DataFrame operations on built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm._common import MEASURED, materialise, running_sums, scope

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The trees of sources have keys that begin with a digit: 0 for null, 1 and the name for others.
_TOP = ""
_PATH = "array<struct<left:string,right:string>>"


def digest(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the values one after another: "-" for null, else number of UTF-8 bytes, colon, value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")


def _runs(nodes: DataFrame, *more: str) -> DataFrame:
    """Rows (tree, run, n, nodes) for each FAN consecutive nodes of trees that go on."""
    own = nodes.filter("n > 1").groupBy("tree", F.expr(f"at div {FAN}").alias("run"))
    return own.agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest", *more))).alias("nodes"))


def _grow(nodes: DataFrame, path: str) -> int:
    """Writes the levels of trees whose lowest level is given, rows (tree, at, n, digest, ...), n being the nodes of that level; the number of levels."""
    spark = nodes.sparkSession
    nodes.write.parquet(f"{path}/level=0")
    most, level = _level(spark, path, 0).agg(F.max("n")).first()[0] or 0, 0
    while most > 1:
        below = _level(spark, path, level).select("tree", "at", "n", "digest")
        level, most = level + 1, -(-most // FAN)
        new = _runs(below).select("tree", F.col("run").alias("at"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.sha2(_joined(F.col("nodes")), 256).alias("digest"))
        new.write.parquet(f"{path}/level={level}")
    return level + 1


def _level(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.parquet(f"{path}/level={level}")


def _last(spark: SparkSession, path: str, levels: int) -> DataFrame:
    """Rows (tree, digest): what remains of each tree."""
    return reduce(DataFrame.unionByName, (_level(spark, path, k).filter("n = 1").select("tree", "digest") for k in range(levels)))


class Store:
    """A manifest's nodes in the folder path: documents/level=N and sources/level=N."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.levels = {k: self._count(k) for k in ("documents", "sources")}

    def _count(self, name: str) -> int:
        jvm, at = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return len(p.getFileSystem(at).listStatus(p))

    def root(self) -> str | None:
        """The one digest of all rows; None where there are none."""
        top = _last(self.spark, f"{self.path}/sources", self.levels["sources"]).first()
        return top["digest"] if top else None

    def subroots(self) -> DataFrame:
        """Rows (tree, digest), one for each source."""
        return _last(self.spark, f"{self.path}/documents", self.levels["documents"])

    def _down(self, name: str, ends: DataFrame, lowest: DataFrame, more: tuple[str, ...]) -> DataFrame:
        """Rows (tree, at, digest, path, more of the lowest level, columns of ends) of the lowest level's nodes.

        ends has each tree once: where its last node's path to the root goes on.
        """
        carried = [c for c in ends.columns if c not in ("tree", "path")]
        paths = None
        for level in reversed(range(self.levels[name])):
            nodes, extra = (_level(self.spark, f"{self.path}/{name}", level), ()) if level else (lowest, more)
            last = nodes.filter("n = 1").join(ends, "tree").select("tree", "at", "digest", *extra, *carried, "path")
            if paths is not None:
                above = paths.select("tree", F.col("at").alias("run"), F.col("path").alias("above"), *carried)
                both = _runs(nodes, *extra).join(above, ["tree", "run"])
                size = F.size("nodes")
                step = F.transform("nodes", lambda x, i: F.struct(x["at"].alias("at"), x["digest"].alias("digest"), *(x[c].alias(c) for c in extra), _joined(F.slice("nodes", F.lit(1), i)).alias("left"), _joined(F.slice("nodes", i + 2, size)).alias("right")))
                each = both.select("tree", *carried, "above", F.explode(step).alias("x"))
                own = each.select("tree", "x.at", "x.digest", *(f"x.{c}" for c in extra), *carried, F.concat(F.array(F.struct("x.left", "x.right")), "above").cast(_PATH).alias("path"))
                last = own.unionByName(last)
            paths = materialise(last, "paths") if level else last
        return paths

    def proofs(self, more: tuple[str, ...] = ()) -> DataFrame:
        """Rows (doc_id, tree, at, leaf, subroot, path, more), one for each row of the dataset.

        path lists, level by level up to the root, the digests to the left and to the right of
        the node, joined; more names columns that build() has kept beside the leaves.
        """
        top = _level(self.spark, f"{self.path}/sources", 0)
        start = self.spark.createDataFrame([(_TOP, [])], f"tree string, path {_PATH}")
        ends = self._down("sources", start, top, ("of",)).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "path")
        ends = materialise(ends, "ends")
        leaves = _level(self.spark, f"{self.path}/documents", 0)
        return self._down("documents", ends, leaves, ("doc_id", *more)).withColumnRenamed("digest", "leaf")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda d, x: F.sha2(F.concat(x["left"], d, x["right"]), 256))


def build(docs: DataFrame, path: str, altered: Column | None = None) -> Store:
    """Writes the manifest of docs to the folder path, a new one.

    A leaf is the digest of COLUMNS; other columns, whatever their names, don't count. Nulls
    have a leaf like any value, a null source is a source of its own, before all others, and
    null doc_ids come first in their source. Rows with equal doc_id are ordered by their
    leaves, and rows equal in all columns are leaves of their own. No rows have no root.

    altered is a text that someone claims a row to have: its leaf is kept in the column
    "seen", from the same pass over the texts, for checks against the manifest.
    """
    spark = docs.sparkSession
    fields = [F.col(c) for c in COLUMNS]
    own = docs.select(*COLUMNS, *([] if altered is None else [altered.alias("routeloom_altered")]))
    rows = own.select(
        F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("tree"),
        "doc_id",
        digest(fields).alias("digest"),
        F.lit(1).cast("long").alias("one"),
        *([] if altered is None else [F.when(F.col("routeloom_altered").eqNullSafe(F.col("text")), None).otherwise(digest([*fields[:-1], F.col("routeloom_altered")])).alias("seen")]),
    )
    with scope(spark, MEASURED):
        # written first, as sorting by range reads its input twice
        rows = materialise(rows, "leaves")
        counts = rows.groupBy("tree").agg(F.count("*").alias("n"))
        placed = running_sums(rows, "tree", ["doc_id", "digest"], {"at": "one"}, counts).drop("one")
        levels = _grow(placed, f"{path}/documents")
        subroots = _last(spark, f"{path}/documents", levels).select(F.col("tree").alias("of"), "digest", F.lit(1).cast("long").alias("one"))
        subroots = materialise(subroots, "subroots")
        n = subroots.count()
        top = running_sums(subroots, None, ["of"], {"at": "one"}).select(F.lit(_TOP).alias("tree"), "of", "at", F.lit(n).cast("long").alias("n"), "digest")
        _grow(top, f"{path}/sources")
    return Store(spark, path)


def check(store: Store, seen: str = "seen") -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's claimed leaf, or where there is none its own, against the manifest."""
    spark, root = store.spark, store.root()
    with scope(spark, MEASURED):
        proofs = store.proofs((seen,))
        out = proofs.select(
            "doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce(seen, "leaf"), F.col("path")).alias("folded_root")
        )
        return materialise(out.withColumn("verified", F.col("folded_root") == F.col("root")), "proofs", keep=True)
