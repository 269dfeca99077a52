"""Helpers that the operators share."""

import pyarrow as pa
from pyspark.sql import functions as F

from shiftspark.llm import common


def test_hash_sample_is_bounded_and_repeats(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 7)
    got = common.hash_sample(df, 600, "id")
    ids = sorted(r.id for r in got.collect())
    assert 450 < len(ids) <= 600 and ids == sorted(r.id for r in common.hash_sample(df.repartition(7), 600, "id").collect())
    assert common.hash_sample(df, 5000, "id").count() == 5000
    assert common.hash_sample(df.where("false"), 10, "id").count() == 0


def test_byte_slices_cover_all_rows():
    texts = pa.array(["x" * n for n in (0, 5, 100, 3, 3, 0, 50)] + [None, "é"])
    for limit in (1, 10, 1000):
        parts = list(common.byte_slices(texts, limit))
        assert [i for a, n in parts for i in range(a, a + n)] == list(range(len(texts)))
    assert list(common.byte_slices(texts.slice(0, 0))) == []


def test_stash_and_sizes(spark):
    df = common.stash(spark.range(5), "five")
    assert df.count() == 5 and common.fits_broadcast(df, 5) and not common.fits_broadcast(df, 4)
    assert common.shared_dir(spark) in common.new_path(spark, "x")


def test_held_out_agrees_with_the_column(spark):
    ids = list(range(200))
    got = [r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").select(common.one_in_five(F.col("i")).alias("h")).collect()]
    assert got == common.held_out_ids(ids).tolist()
