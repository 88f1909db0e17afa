"""Tables that an iteration reads again and again: their lineage ends in the shared folder, so lost executors lose nothing. And how
many tasks share the rows of a table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset a local master gets a folder of its own; any
    other master is refused, since its executors wouldn't see a folder of the driver's machine."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set; executors and driver need a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="lociflow-held-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def held(df: DataFrame) -> DataFrame:
    """The rows, computed once and read from the shared folder from then on."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def task_count(most: int, *tables: DataFrame) -> int:
    """Tasks among which the rows of all tables are dealt, about `most` a task: adaptive execution would put as many in a task as fit
    its size of a shuffle, however wide they become there, and a fixed number of tasks would hold more the more rows there are."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-sum(t.count() for t in tables) // most))
