"""Several tables that appear together or not at all.

All are written below a staged folder beside their place, then a record of what they hold, then the folder is renamed. A write
that fails removes the stage; a driver that dies leaves a hidden stage that no reader looks at and clear_stages() removes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RECORD = "_set"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish_set(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> dict[str, dict]:
    """Write tables below a folder that must be new; (name -> rows, columns) as the record has it. Rows are counted as they are
    written."""
    if not tables:
        raise ValueError("a set has one table at least")
    if bad := [n for n in tables if not n or n.startswith(("_", ".")) or "/" in n]:
        raise ValueError(f"no names of tables: {bad}")
    spark = next(iter(tables.values())).sparkSession
    fs, target = _files(spark, folder)
    if fs.exists(target):
        raise FileExistsError(folder)
    staged = f"{target.getParent().toString()}/.{target.getName()}-{uuid.uuid4().hex}"
    _, stage = _files(spark, staged)
    try:
        record = {}
        for name, table in tables.items():
            seen = Observation(name)
            writer = table.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
            (writer.option("header", True) if kind == "csv" else writer).format(kind).save(f"{staged}/{name}")
            record[name] = {"rows": seen.get["rows"], "columns": table.columns, "kind": kind}
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(f"{staged}/{RECORD}")
        # a rename into a folder that is there would put the stage inside it
        if fs.exists(target) or not fs.rename(stage, target):
            raise FileExistsError(folder)
    except BaseException:
        fs.delete(stage, True)
        raise
    return record


def read_set(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a published set; one that lacks rows is an error."""
    record = json.loads(spark.read.text(f"{folder}/{RECORD}").first().value)
    out = {}
    for name, told in record.items():
        reader = spark.read.option("header", True) if told["kind"] == "csv" else spark.read
        out[name] = reader.format(told["kind"]).load(f"{folder}/{name}")
        if out[name].count() != told["rows"]:
            raise ValueError(f"{name} has not the {told['rows']} rows of the record")
    return out


def clear_stages(spark: SparkSession, folder: str) -> int:
    """Remove what drivers that died have left beside a place; how many there were. No set may be in the making there."""
    fs, target = _files(spark, folder)
    if not fs.exists(target.getParent()):
        return 0
    left = [s.getPath() for s in fs.listStatus(target.getParent()) if s.getPath().getName().startswith(f".{target.getName()}-")]
    for path in left:
        fs.delete(path, True)
    return len(left)
