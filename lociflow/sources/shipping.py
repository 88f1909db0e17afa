"""Python workers need this package: it is sent to them once a context, as a zip file that Spark distributes."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


ARROW_ROWS = 2_000
ARROW_BYTES = 32 << 20


def ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if getattr(context, "_lociflow_shipped", None):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    handle, path = tempfile.mkstemp(prefix="lociflow-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(top)))
    context.addPyFile(path)
    context._lociflow_shipped = path


def ship_bounded(spark: SparkSession) -> None:
    """ship(), and bound the Arrow batches that Python workers get: the session's own bounds stay where they are smaller."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = str(spark.conf.get(key)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
