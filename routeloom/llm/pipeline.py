"""A training corpus from documents: quality rules, near-dedup, decontamination, masking of personal data, packing.

Each stage takes what the one before it kept, as written to Parquet and read again. All but
the last return the columns of documents, whatever these are; n_chars follows the text. Rows
stay rows: those with equal doc_id or none are documents of their own, a null text counts as
an empty one, and no rows give no rows. A stage keeps no state; of the tables that it writes,
only those stay that its result rests on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import _common
from routeloom.llm.decontaminate import decontaminate
from routeloom.llm.near_dedup import without_near_duplicates
from routeloom.llm.packing import pack
from routeloom.llm.pii import find_personal_data, mask
from routeloom.llm.quality_rules import without_boilerplate

_REST = "routeloom_rest"


def _folded(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns once more in one struct, so that no name clashes."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias(_REST))


def _unfolded(rows: DataFrame, columns: list[str]) -> DataFrame:
    out = []
    for c in columns:
        if c in ("doc_id", "text"):
            out.append(F.col(c))
        elif c == "n_chars":
            out.append(F.length("text").cast("long").alias(c))
        else:
            out.append(F.col(_REST)[c].alias(c))
    return rows.select(*out)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and boilerplate lines go from the others (operator 5)."""
    changed = without_boilerplate(docs, changed=_REST)
    if "n_chars" in docs.columns:
        # only texts that lost lines are counted anew
        changed = changed.withColumn("n_chars", F.when(F.col(_REST), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least doc_id (operator 10)."""
    return without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go from texts; documents of little else go whole (operator 2)."""
    items = _common.read(spark, sf_dir, "benchmark")
    return _unfolded(decontaminate(_folded(docs), items, extra=(_REST,)), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind (operator 1)."""
    rows, spans = find_personal_data(_folded(docs), extra=(_REST,))
    return _unfolded(mask(rows, spans), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens in sequences of at most 2048 (operator 4)."""
    return pack(docs)


STAGES = [(f.__name__, f) for f in (quality_rules, near_dedup, benchmark_decontamination, personal_data, packing)]
#: SQL can express neither the dedup nor the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.read(spark, sf_dir, "documents")
    root = f"{_common.scratch_root(spark)}/corpus-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
