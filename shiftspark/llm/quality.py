"""Quality scores: gradient-boosted trees over statistics of whole texts.

The trees are fitted on at most SAMPLE_ROWS labelled documents, none of them
held out; every document is scored in one scan, statistics and walk together.

Nulls, empties, repeats: a null or empty text is scored by its statistics, all
zero; a null doc_id is scored and counts as not held out; rows whose label is
null are not learned from; repeated rows are scored one by one; a very long
text is measured whole; at a tie a tree goes left up to its threshold, and a score at THRESHOLD is good; without labels
every score is the constant 0.5; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.llm import gbt, textstats
from shiftspark.llm.common import hash_sample, held_out_ids, one_in_five, table, tidied

#: Labelled documents that a model is fitted on at most, picked by a hash of their ids.
SAMPLE_ROWS = 8_000
THRESHOLD = 0.3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and label of a bounded sample of documents that are not held out."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~one_in_five(F.col("doc_id")))
    picked = hash_sample(marked.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")), rows, "doc_id")
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")  # at most ``rows`` rows


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> gbt.Trees:
    names = textstats.RATIOS

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, stats in textstats.slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(first, n), *(pa.array(stats[k].astype(float)) for k in names)], ["label", *names])

    sample = labelled_sample(docs, labels, "quality", rows).select("doc_id", "text", "label")
    got = sample.mapInArrow(run, "label int, " + ", ".join(f"{k} double" for k in names)).toPandas()
    if not len(got):
        return gbt.fit(np.zeros((1, len(names))), np.array([0.5]))
    return gbt.fit(got[names].to_numpy(), got["label"].to_numpy(float))


def score(docs: DataFrame, model: gbt.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, stats in textstats.slices(batch):
                own = model.score(textstats.matrix(stats))
                ids = batch.column(0).slice(first, n)
                held = held_out_ids(ids.to_pylist()) & np.asarray(ids.is_valid())
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(own), pa.array((own >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
