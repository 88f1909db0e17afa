"""What the operators share: the cluster's shared folder, tables that cut lineage, and bounded Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.sources.shipping import ship as ship_package

ARROW_ROWS = 2_000
ARROW_BYTES = 32 << 20
#: Lists of the paths that cut() has written, one for each passing() around it.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset a local master gets a folder of its own; any other master is refused, since its executors
    wouldn't see a folder of the driver's machine.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set; executors and driver need a shared folder")
    folder = "file://" + tempfile.mkdtemp(prefix="lociflow-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for each call, below the shared folder."""
    return f"{shared_folder(spark)}/lociflow/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, last: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends there, and it survives lost executors. The
    `last` one of a passing() stays after it."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    for made in _MADE.get()[: -1 if last else None]:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(folder: str):
    """pyarrow's file system of a folder, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3a://", "s3://", folder))


@contextmanager
def passing() -> Iterator[None]:
    """Tables that are written within are removed at the end, so nothing that is read later may need them. They stay in a
    folder that pyarrow's file systems do not know."""
    made: list[str] = []
    before = _MADE.set((*_MADE.get(), made))
    try:
        yield
    finally:
        _MADE.reset(before)
        for path in made:
            for outer in _MADE.get():
                if path in outer:
                    outer.remove(path)
            remove(path)


def remove(path: str) -> None:
    """Remove a table. It stays, with a warning, in a folder that pyarrow's file systems do not know."""
    try:
        where, at = file_system(path)
        where.delete_dir(at)
    except (pa.ArrowException, OSError) as e:
        warnings.warn(f"{path} stays: {e}", stacklevel=3)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, and bound the Arrow batches that Python workers get: the session's own
    bounds stay where they are smaller."""
    ship_package(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = str(spark.conf.get(key)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def spread(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of a table of fewer files than there are cores, dealt to all of them: such a file may be one row group, which one
    task reads. Tables of more files stay as they are, so no large corpus is shuffled for it."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return documents if len(documents.inputFiles()) >= cores else documents.repartition(2 * cores, key)


def words(text: Column) -> Column:
    """Array of the maximal runs of other characters than white space; an empty array for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def let(value: Column, body) -> Column:
    """body(x) with x bound to a value that is computed once, though the body names it often or inside another lambda."""
    return F.transform(F.array(value), body)[0]


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * F.lit(2.0**-53)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
