"""The corpus pipeline: toxicity, exact dedup, near-duplicate join, decontamination, packing.

Each stage takes the documents that its predecessor kept (same columns, any extra ones too) and works on all
of them; the last returns the packed pieces.  A stage that compares documents numbers its rows first and
decides by that number, so rows with a null or shared id stand each for itself.  Where one of several rows
stays, it is that with the smallest id (a null comes after all others), and of equal ids the first row.
Null texts are never toxic, count as empty in exact dedup, join nothing, and pack as one end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import op03_exact, op04_decontaminate, op05_packing, op07_toxicity, op10_jaccard
from veilframe.llm.common import free_of, fresh_path, read, stored, temporary, written


#: Column that holds a row's number inside a stage.
ROW = "_corpus_row"


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for each row, written with the table so that all readers see the same."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def _firsts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their group; groups: _row, _group."""
    ids = docs.select(F.col(ROW).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    rank = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first")
    first = groups.join(ids, "_row").groupBy("_group").agg(rank).select(F.col("first._row").alias(ROW))
    return docs.join(first, ROW, "left_semi").select(docs.columns).drop(ROW)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    model = op07_toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return op07_toxicity.accepted(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    rows = _numbered(docs, "exact-rows")
    groups = op03_exact.exact_groups(rows, id_col=ROW)
    return _firsts(rows, groups.select(F.col("doc_id").alias("_row"), F.col("text_sha256").alias("_group")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join, the row with the smallest id stays."""
    rows = _numbered(docs, "near-rows")
    groups = op10_jaccard.jaccard_components(rows, id_col=ROW)
    return _firsts(rows, groups.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go."""
    rows = _numbered(docs, "benchmark-rows")
    bad = op04_decontaminate.contaminated(rows, read(spark, sf_dir, "benchmark"), id_col=ROW)
    return rows.join(bad.select(F.col("doc_id").alias(ROW)).distinct(), ROW, "left_anti").select(rows.columns).drop(ROW)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op05_packing.packed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces.  A stage's own tables go once its result is stored, and that result once the next one is."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with temporary(spark):
            docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            free_of(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Toxicity is a trained model: SQL can't express it.
ORACLE_SQL = None
