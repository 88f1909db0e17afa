"""Measurement rows: JSON lines with their numbers, and the rules that each line and each file must keep.

Line numbers come from Spark's own text reader, so files are split at line ends and may lie in any store: rows of a split come
in order, and the lines of the splits before it are counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.operators.held import held
from lociflow.operators.windows import running

#: What a line holds, and which of it is the same in all lines of a file. The names are fixed values of the format.
ROW = "schema_version string, sample_id string, position_1based string, signal_version string, reference_sha256 string, configuration_sha256 string, reads string, observations array<struct<read_sha256:string>>"
IDENTITY = ("signal_version", "reference_sha256", "configuration_sha256")
VERSION = "validation_locus/v2"


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line, and the partition columns of the folder) of text files; lines count from 1 within a file."""
    found = spark.read.text(path)
    rows = found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"), F.col("value").alias("line"), *[c for c in found.columns if c != "value"])
    blocks = rows.groupBy("file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a split
    blocks = blocks.select("file", "__block", "__first", before.alias("__before"))
    out = rows.join(blocks, ["file", "__block"])
    return out.withColumn("line_no", F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__block", "__at", "__first", "__before")


def measurement_rows(lines: DataFrame, case: str, width: int = 65_536) -> DataFrame:
    """(file, case, line_no, row, position, before, first): the parsed line (null if it is no JSON object), its position, the one
    that stands before it in the file, and the identity of the file's first line that has one. The parsed lines are held, since
    several steps here and all rules read them: a line is parsed once."""
    blank = F.trim("line") == ""
    is_object = F.ltrim("line").startswith("{")
    parsed = F.when(~blank & is_object & F.try_parse_json("line").isNotNull(), F.from_json("line", ROW))
    rows = lines.select("file", F.col(case).alias("case"), "line_no", blank.alias("blank"), parsed.alias("row"))
    whole = F.when(F.col("row.position_1based").rlike("^-?[0-9]+$"), F.col("row.position_1based").try_cast("long"))
    rows = held(rows.withColumn("position", whole))
    told = running(rows, ["file"], "line_no", width, latest={"before": F.col("position")}, inclusive=False)
    named = F.when(F.col("row").isNotNull(), F.struct(*[F.col(f"row.{n}") for n in IDENTITY]))
    firsts = rows.groupBy("file").agg(F.min_by(named, F.when(F.col("row").isNotNull(), F.col("line_no"))).alias("first"))
    return told.join(firsts, "file", "left")


def row_faults(rows: DataFrame, expected: DataFrame, version: str = VERSION) -> DataFrame:
    """(case, file, line_no, rule) of measurement_rows() and the reads (case, read_sha256) that a case has; file and line are null
    where a rule is about the case. A line's rules stand in the order of the format."""
    c, row = F.col, lambda n: F.col(f"row.{n}")
    no = lambda x: ~F.coalesce(x, F.lit(False))
    has = c("row").isNotNull()
    names = F.transform(row("observations"), lambda o: o.read_sha256)
    digest = lambda n: no(X.sha256_name(row(n)))
    rules = X.flags(
        ("empty row", c("blank")), ("no JSON object", ~c("blank") & ~has), ("schema version", has & no(row("schema_version") == version)), ("sample differs", has & no(row("sample_id") == c("case"))),
        ("position does not increase", has & no((c("position") > 0) & (c("position") > F.coalesce(c("before"), F.lit(0))))), ("no version", has & no(F.length(row(IDENTITY[0])) > 0)), ("reference digest", has & digest("reference_sha256")), ("configuration digest", has & digest("configuration_sha256")),
        ("identity changes", has & ~F.struct(*[row(n) for n in IDENTITY]).eqNullSafe(c("first"))), ("no observations", has & row("observations").isNull()), ("read count differs", has & no(row("reads").try_cast("int") == F.size(names))), ("read repeated", has & F.coalesce(F.size(F.array_distinct(names)) < F.size(names), F.lit(False))),
    )
    own = rows.select("case", "file", "line_no", F.explode(rules).alias("rule"))
    seen = rows.where(has).select("case", "file", "line_no", F.explode(F.array_distinct(names)).alias("read_sha256"))
    known = expected.select("case", "read_sha256").distinct()
    unknown = seen.join(known, ["case", "read_sha256"], "left_anti").select("case", "file", "line_no", F.lit("unknown read").alias("rule")).distinct()
    nowhere = [F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line_no")]
    unused = known.join(seen, ["case", "read_sha256"], "left_anti").select("case").distinct().select("case", *nowhere, F.lit("read without locus").alias("rule"))
    return reduce(DataFrame.unionByName, [own, unknown, unused])
