"""How the star-schema tables stand in for reads, traces and loci. Each bridge is deterministic, and SQL can say the same."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.operators.held import task_count
from lociflow.sources import abif
from lociflow.sources.shipping import ship_bounded

LETTERS, CODES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Letters of a trace: about what one read of a sequencer gives.
READ = 700
#: Trace files of an Arrow batch.
FILES = 128


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, part, bases): all letters of a document as bases, in parts of READ to 2 READ - 1 letters (a shorter text is one
    part) that follow each other."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    whole = table(spark, folder, "documents").select("doc_id", F.translate(letters, LETTERS, CODES).alias("all")).where(F.length("all") > 0)
    n = F.greatest(F.floor(F.length("all") / READ), F.lit(1))
    start = lambda k: F.floor(F.length("all") * k / F.col("n"))
    cut = lambda k: F.substr("all", (start(k) + 1).cast("int"), (start(k + 1) - start(k)).cast("int"))
    # the parts of a text at once: a row a part beside the whole text would grow with the square of its length
    parts = whole.withColumn("n", n).select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), cut)).alias("part", "bases"))
    return parts.select("doc_id", F.col("part").cast("long").alias("part"), "bases")


def trace_files(spark: SparkSession, folder: str, mixed_call: int = 5, height: int = 400) -> DataFrame:
    """(path, content): a trace of each sequence, with an A of `height` at one call, if there is such a call; the vendor says the
    bases. A path is `document/part`."""
    ship_bounded(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, FILES):  # a file is fifty times its bases
                some = b.slice(at, FILES)
                files = [abif.synthetic(x, calls=x, secondary={mixed_call: ("A", height)} if x[mixed_call : mixed_call + 1] not in ("", "A") else None) for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(files, pa.binary())], names=["path", "content"])

    # a row is small and its work is not, and the given files have one row group: deal the rows to all cores
    found = sequences(spark, folder).repartition(spark.sparkContext.defaultParallelism, "doc_id", "part")
    return found.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("part").cast("string")).alias("path"), "bases").mapInArrow(write, "path string, content binary")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    start = F.col("o_orderkey") % 5000
    return o.select(F.col("o_orderpriority").alias("sample"), F.col("o_orderkey").alias("read"), start.alias("seg_start"), (start + 1 + F.col("o_custkey") % 50).alias("seg_end"), (F.col("o_custkey") % 2 == 0).alias("forward"))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """(sample, read, position, base, reference, forward, weights): suppliers read parts; one row for each."""
    li = table(spark, folder, "lineitem")
    raw = F.array(F.col("l_quantity"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100), F.col("l_linenumber").cast("double"))
    first = li.withColumn("rn", F.row_number().over(Window.partitionBy("l_returnflag", "l_suppkey", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice"))).where("rn = 1")
    letter = lambda i: F.substr(F.lit("ACGTN-"), i + 1, F.lit(1))
    weights = F.when(F.col("l_quantity") > 5, F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, y: a + y)))
    odd = (F.col("l_orderkey") % 6).cast("int")
    return first.select(
        F.col("l_returnflag").alias("sample"), F.col("l_suppkey").alias("read"), F.col("l_partkey").alias("position"), F.when(F.col("l_orderkey") % 5 == 0, letter(odd)).otherwise(letter((F.col("l_partkey") % 4).cast("int"))).alias("base"),
        letter((F.col("l_partkey") % 4).cast("int")).alias("reference"), (F.col("l_suppkey") % 2 == 0).alias("forward"), weights.alias("weights"),
    )


#: Events of a task, about. What follows is keyed by user and stays in the task, and a candidate offset makes fifty rows of one.
EVENTS = 100_000


def series(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, i, v, base): a user's events in order as one channel."""
    e = table(spark, folder, "events")
    e = e.repartition(task_count(EVENTS, e), "user_id")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    base = F.expr("CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'C' WHEN 'signup' THEN 'G' WHEN 'purchase' THEN 'T' ELSE 'N' END")
    return e.select("user_id", i.cast("long").alias("i"), F.floor("value").cast("long").alias("v"), base.alias("base"), "event_id")


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """series() as calls: locations grow by 10 a call and wobble."""
    s = series(spark, folder)
    n = F.count("*").over(Window.partitionBy("user_id"))
    return s.select("user_id", F.col("i").alias("call_index"), (F.col("i") * 10 + F.col("event_id") % 5).alias("ploc"), F.col("base").alias("ambiguity"), (n * 10 + 5).alias("sample_count"), "v")


def phase_observations(spark: SparkSession, folder: str) -> DataFrame:
    """series() behind a tract: distance from 1, the event's base, and a profile of four residues; none for each ninth event."""
    s = series(spark, folder)
    raw = F.array(*[(F.col("v") % m + 1).cast("double") for m in (7, 11, 13, 17)])
    weights = F.when(F.col("event_id") % 9 != 0, F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, y: a + y)))
    return s.select("user_id", (F.col("i") + 1).alias("distance"), "base", weights.alias("weights"))


#: The same in SQL, as common table expressions of the oracles.
SQL = {
    "sequences": """letters AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS letters FROM documents),
pieces AS (SELECT doc_id, letters, length(letters) AS total, greatest(length(letters) // 700, 1) AS n, unnest(range(0, greatest(length(letters) // 700, 1))) AS part FROM letters WHERE length(letters) > 0),
sequences AS (SELECT doc_id, part, CAST(doc_id AS VARCHAR) || '/' || CAST(part AS VARCHAR) AS name, substr(letters, CAST(total * part // n + 1 AS INT), CAST(total * (part + 1) // n - total * part // n AS INT)) AS bases FROM pieces)""",
    "segments": """segments AS (SELECT o_orderpriority AS sample, o_orderkey AS read, o_orderkey % 5000 AS seg_start, o_orderkey % 5000 + 1 + o_custkey % 50 AS seg_end, o_custkey % 2 = 0 AS forward FROM orders)""",
    "observations": """firsts AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) = 1),
observations AS (SELECT l_returnflag AS sample, l_suppkey AS read, l_partkey AS position,
  CASE WHEN l_orderkey % 5 = 0 THEN substr('ACGTN-', CAST(l_orderkey % 6 AS INT) + 1, 1) ELSE substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1) END AS base, substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1) AS reference,
  l_suppkey % 2 = 0 AS forward, l_quantity > 5 AS held, l_quantity AS x0, round(l_discount * 100) AS x1, round(l_tax * 100) AS x2, CAST(l_linenumber AS DOUBLE) AS x3, l_quantity + round(l_discount * 100) + round(l_tax * 100) + l_linenumber AS xs FROM firsts)""",
    "states": """states AS (SELECT *, CASE WHEN base = '-' THEN 'deletion' WHEN base NOT IN ('A', 'C', 'G', 'T') THEN 'unresolved' WHEN base = reference THEN 'reference' ELSE 'alternate' END AS state FROM observations)""",
    "series": """series AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(floor(value) AS BIGINT) AS v,
  CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'C' WHEN 'signup' THEN 'G' WHEN 'purchase' THEN 'T' ELSE 'N' END AS base, event_id FROM events)""",
    "calls": """calls AS (SELECT user_id, i AS call_index, i * 10 + event_id % 5 AS ploc, base AS ambiguity, count(*) OVER (PARTITION BY user_id) * 10 + 5 AS sample_count, v FROM series)""",
    "phase": """phase AS (SELECT user_id, i + 1 AS distance, base, event_id % 9 <> 0 AS held, CAST(v % 7 + 1 AS DOUBLE) AS x0, CAST(v % 11 + 1 AS DOUBLE) AS x1, CAST(v % 13 + 1 AS DOUBLE) AS x2, CAST(v % 17 + 1 AS DOUBLE) AS x3,
  CAST(v % 7 + 1 AS DOUBLE) + (v % 11 + 1) + (v % 13 + 1) + (v % 17 + 1) AS xs FROM series)""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
