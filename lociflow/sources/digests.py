"""Files of any size by what they hold: digest, size, lines and first line in one pass of bounded pieces, a task a file."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.sources.shipping import ship

#: Bytes of a file that a worker holds at a time, and of a first line at most.
PIECE, LONGEST = 1 << 20, 1 << 20
DIGESTS = "path string, sha256 string, bytes long, lines long, header string"


def digest_of(path: str, piece: int = PIECE) -> tuple[str, int, int, str]:
    """(sha256, bytes, lines that are not empty, first line) of a file in a file system that pyarrow knows."""
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(re.sub("^s3a://", "s3://", path) if "://" in path else f"file://{re.sub('^file:', '', path)}")
    told, size, lines, header, line_is_open = hashlib.sha256(), 0, 0, b"", False
    in_header = True
    with where.open_input_stream(at) as source:
        while part := source.read(piece):
            told.update(part)
            size += len(part)
            first, *rest = part.split(b"\n")
            if in_header and len(header) < LONGEST:
                header += first
            in_header = in_header and not rest
            # a line counts when its first byte is seen
            lines += (not line_is_open and bool(first)) + sum(map(bool, rest))
            line_is_open = bool(rest[-1]) if rest else line_is_open or bool(first)
    return told.hexdigest(), size, lines, header.decode("utf-8", "replace").rstrip("\r")


def file_digests(files: DataFrame, path: str = "path", piece: int = PIECE) -> DataFrame:
    """DIGESTS of the files that a column names; null digests for one that can't be read."""
    ship(files.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                try:
                    row = digest_of(name, piece)
                except OSError:
                    row = (None, None, None, None)
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "sha256", "bytes", "lines", "header"), (name, *row), strict=True))], schema)

    schema = pa.schema([("path", pa.string()), ("sha256", pa.string()), ("bytes", pa.int64()), ("lines", pa.int64()), ("header", pa.string())])
    named = files.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct()
    return named.repartition("path").mapInArrow(each, DIGESTS)


def listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, file) of a folder's files, without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return found.withColumn("file", F.regexp_extract("path", "([^/]+)$", 1))


def artifact_faults(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """(file, rule): files of an artifact whose content, row count or columns differ from the index (file, sha256, rows, columns)."""
    files = listed(spark, folder, "*.csv")
    told = file_digests(files).join(files, "path").select("file", F.col("sha256").alias("found_sha256"), (F.col("lines") - 1).alias("found_rows"), F.split("header", ",").alias("found_columns"))
    both = index.join(told, "file", "full_outer")
    rule = F.when(F.col("sha256").isNull(), "not in the index").when(F.col("found_sha256").isNull(), "missing").when(F.col("sha256") != F.col("found_sha256"), "content differs").when(F.col("rows") != F.col("found_rows"), "row count differs").when(F.col("columns") != F.col("found_columns"), "columns differ")
    return both.withColumn("rule", rule).where("rule IS NOT NULL").select("file", "rule")


def manifest_file_faults(manifest: DataFrame, root: str) -> DataFrame:
    """(validation_case_id, trace_path, rule): a path that is absolute or leaves the root, a file that isn't there, and one whose
    content is not the manifest's."""
    path = F.col("trace_path")
    away = path.isNull() | path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    rows = manifest.select("validation_case_id", "trace_path", "trace_sha256", away.alias("away"), F.when(~away, F.concat(F.lit(root.rstrip("/") + "/"), path)).alias("__path"))
    told = file_digests(rows, "__path").select(F.col("path").alias("__path"), F.col("sha256").alias("found"))
    rule = F.when(F.col("away"), "path leaves the root").when(F.col("found").isNull(), "file is missing").when(F.col("found") != F.lower("trace_sha256"), "content differs")
    return rows.join(told, "__path", "left").withColumn("rule", rule).where("rule IS NOT NULL").select("validation_case_id", "trace_path", "rule")
