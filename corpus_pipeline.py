"""Corpus preparation as a chain of stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir). The first four return the columns of
documents: rejected documents go, shared lines are taken out of texts, one
document of each near-duplicate group stays, documents that hold a benchmark
passage go. The last returns the packed pieces.

Nulls, empties, repeats, in any stage: a null text counts as empty (such documents
fail the quality rules, which come first); a null doc_id is judged by its text and
is never dropped as a near-duplicate; repeated rows are near-duplicates of each
other, so one stays; ties go to the smallest doc_id, then to the smallest hash of
the text; a very long text is taken whole; extra columns, whatever their names,
pass through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftspark.llm import decontam, linededup, neardup, packing, rules
from shiftspark.llm.common import new_path, table
from shiftspark.ship import connect


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    connect(spark)
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    connect(spark)
    return linededup.drop_shared_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    connect(spark)
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    connect(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    connect(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
