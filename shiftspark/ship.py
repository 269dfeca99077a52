"""Bring this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

#: Bytes of an Arrow batch where the session has Spark's default: a task's memory
#: then hangs on neither the number of rows in a batch nor the length of a row.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def connect(spark: SparkSession) -> SparkSession:
    """Ship the package's source to the session's Python workers and bound their batches, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="shiftspark-"), "shiftspark.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, f"{root.name}/{path.relative_to(root)}")
        context.addPyFile(target)
        if spark.conf.get(_BATCH) in ("64m", "64MB", "67108864", "67108864b"):
            spark.conf.set(_BATCH, str(BATCH_BYTES))
        _SHIPPED.add(context.applicationId)
    return spark
