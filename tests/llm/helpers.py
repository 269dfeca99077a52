"""Small tables and plain single-process versions to hold the operators against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)"""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b c"), (6, "a b c d"), (6, "a b c d"), (None, "a b c d"), (8, "É ß İ  x y"), (9, "w " * 30_000),
    (10, "x" * 100_000), (11, "\n\n\n"), (12, "😀 𝔘 á"),
]


def edge_documents(spark):
    """Odd rows, with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = documents(spark, ODD)
    for name in ("score", "fp", "rep", "length", "size", "h", "kept", "rule", "start", "n", "label", "pos", "word", "spans", "_doc", "t"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def empty_documents(spark):
    return documents(spark, [])
