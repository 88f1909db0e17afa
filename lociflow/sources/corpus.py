"""Text sources: reference sequences, manifests, measurements, artifacts bound by their hash, reviewer tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_REFERENCE = 50_000
#: Columns of a manifest, in order. Fixed values of the contract, as are the next two tuples.
MANIFEST = (
    "validation_case_id", "trace_path", "trace_sha256", "source_group_id", "specimen_group_id", "pcr_replicate_id", "sequencing_run_id", "instrument_id", "amplicon_id", "declared_direction", "truth_class",
    "truth_method", "truth_locus", "truth_reference", "truth_alternate", "known_mixture_fraction", "artifact_tags", "include_in_threshold_fit", "holdout_group", "approval_record", "redistribution_status", "notes",
)
#: Those that must not differ between the traces of a case.
CASE = ("source_group_id", "specimen_group_id", "truth_class", "truth_method", "truth_locus", "truth_reference", "truth_alternate", "known_mixture_fraction", "include_in_threshold_fit", "holdout_group", "approval_record", "redistribution_status", "notes")
#: Columns of a reviewer table.
REVIEWER = ("Sample ID", "Batch", "Analyzed Range (Sequencher)", "Variants (Sequencher)")


class SourceError(ValueError):
    pass


@dataclass(frozen=True)
class ReferenceSequence:
    name: str
    bases: str
    circular: bool

    @property
    def sha256(self) -> str:
        return hashlib.sha256(self.bases.encode()).hexdigest()


def read_reference(spark: SparkSession, path: str, circular: bool = False) -> ReferenceSequence:
    """One FASTA record of A, C, G, T, N. The file is small by rule, so it is read whole on the driver, by Spark's reader."""
    lines = [r.value.strip() for r in spark.read.text(path).limit(MAX_REFERENCE + 2).collect()]
    lines = [x for x in lines if x]
    if not lines or not lines[0].startswith(">") or any(x.startswith(">") for x in lines[1:]):
        raise SourceError("a reference holds one FASTA record")
    name, bases = lines[0][1:].split(), "".join(lines[1:]).upper()
    if not name or not 1 <= len(bases) <= MAX_REFERENCE or set(bases) - set("ACGTN"):
        raise SourceError("a reference has a name and 1 to 50,000 of A, C, G, T, N")
    return ReferenceSequence(name[0], bases, circular)


def reference_bases(spark: SparkSession, reference: ReferenceSequence) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.split(F.lit(reference.bases), "")).alias("pos0", "base"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with its exact header, without blank rows."""
    schema = ", ".join(f"`{c}` string" for c in MANIFEST)
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", nullValue="")
    return rows.dropna("all")


def manifest_faults(manifest: DataFrame) -> DataFrame:
    """(rule, subject): case metadata that differs, traces of two cases, repeated traces, source groups across holdout groups."""
    case = [F.count_distinct(F.coalesce(F.col(c), F.lit("\0"))) for c in CASE]
    differs = manifest.groupBy("validation_case_id").agg(*[x.alias(f"n{i}") for i, x in enumerate(case)]).where(" OR ".join(f"n{i} > 1" for i in range(len(case)))).select(F.lit("case metadata differ").alias("rule"), F.col("validation_case_id").alias("subject"))
    owners = manifest.groupBy("trace_sha256").agg(F.count_distinct("validation_case_id").alias("cases"), F.count("*").alias("rows")).where("rows > 1")
    shared = owners.select(F.when(F.col("cases") > 1, "trace of several cases").otherwise("trace repeated").alias("rule"), F.col("trace_sha256").alias("subject"))
    spans = manifest.groupBy("source_group_id").agg(F.count_distinct(F.coalesce("holdout_group", F.lit("\0"))).alias("n")).where("n > 1").select(F.lit("source group spans holdout groups").alias("rule"), F.col("source_group_id").alias("subject"))
    return differs.unionByName(shared).unionByName(spans)


def select_cases(manifest: DataFrame, wanted: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the cases asked for, or of the first `limit` cases by identifier."""
    if wanted is not None:
        return manifest.where(F.col("validation_case_id").isin(wanted))
    if limit is not None:
        first = manifest.select("validation_case_id").distinct().orderBy("validation_case_id").limit(limit)
        return manifest.join(first, "validation_case_id", "left_semi")
    return manifest


def measurement_faults(loci: DataFrame, reads: DataFrame) -> DataFrame:
    """(rule, case_id, position) over locus rows (case_id, line, position_1based, reads, observations with input_sha256) and the
    reads that a case declares (case_id, input_sha256)."""
    w = Window.partitionBy("case_id").orderBy("line")
    names = F.transform("observations", lambda o: o.input_sha256)
    rows = loci.select("case_id", F.col("position_1based").alias("position"), "reads", names.alias("names"), F.lag("position_1based").over(w).alias("before"))
    rule = F.when(F.col("position") <= F.col("before"), "positions do not increase").when(F.col("reads") != F.size("names"), "read count differs").when(F.size(F.array_distinct("names")) != F.size("names"), "read repeated")
    own = rows.withColumn("rule", rule).where("rule IS NOT NULL").select("rule", "case_id", "position")
    seen = rows.select("case_id", "position", F.explode("names").alias("input_sha256"))
    unknown = seen.join(reads, ["case_id", "input_sha256"], "left_anti").select(F.lit("unknown read").alias("rule"), "case_id", "position")
    unused = reads.join(seen, ["case_id", "input_sha256"], "left_anti").select(F.lit("read without locus").alias("rule"), "case_id", F.lit(None).cast("int").alias("position"))
    return own.unionByName(unknown).unionByName(unused)


def research_observations(loci: DataFrame) -> DataFrame:
    """One row an observation, its four-vectors as columns."""
    from lociflow.functions.expressions import BASES

    flat = loci.select("case_id", "position_1based", "reference_base", F.posexplode("observations").alias("observation", "o")).select("case_id", "position_1based", "reference_base", "observation", "o.*")
    for name, kind in flat.dtypes:
        if kind in ("array<double>", "array<int>"):
            flat = flat.select([c for c in flat.columns if c != name] + [F.get(F.col(name), F.lit(i)).alias(f"{name}_{b.lower()}") for i, b in enumerate(BASES)])
    return flat


def curve_faults(windows: DataFrame, candidates: DataFrame, offsets: list[int]) -> DataFrame:
    """Windows that lack an offset, repeat one or have others: each must have exactly the given set."""
    have = candidates.groupBy("window_id").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    return windows.join(have, "window_id", "left").where(F.col("offsets").isNull() | (F.col("offsets") != F.lit(sorted(offsets)))).select("window_id")


def discover_traces(spark: SparkSession, folder: str, samples: list[str]) -> DataFrame:
    """(sample, path, owners) of `*_<sample>_*.ab1`; more than one owner is a fault."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ab1").option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    owned = files.withColumn("sample", F.explode(F.filter(F.lit(samples), lambda s: F.contains(name, F.concat(F.lit("_"), s, F.lit("_"))))))
    return owned.withColumn("owners", F.count("*").over(Window.partitionBy("path")))


def read_reviewer_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table with the case that ends each sample's name: its columns, case_id and sample_id."""
    rows = spark.read.csv(path, sep="\t", header=True, encoding="utf-8")
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    if missing := [c for c in REVIEWER if c not in rows.columns]:
        raise SourceError(f"missing columns: {missing}")
    return rows.withColumns({"case_id": F.regexp_extract(REVIEWER[0], "(AB\\d+)$", 1), "sample_id": F.col(REVIEWER[0])})


def read_reviewer(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, sample_id, token): the table's tokens, with the case that ends the sample's name."""
    rows = read_reviewer_rows(spark, path)
    token = F.explode(F.filter(F.split(F.col(REVIEWER[3]), "[,;\\s]+"), lambda x: x != ""))
    return rows.select("case_id", "sample_id", token.alias("token"))


def reviewer_table_faults(rows: DataFrame) -> DataFrame:
    """(rule, subject) of a reviewer table's rows (case_id, sample_id): a name without a case, a sample or a case told twice."""
    unnamed = rows.where(F.coalesce("case_id", F.lit("")) == "").select(F.lit("sample without a case").alias("rule"), F.col("sample_id").alias("subject"))
    twice = lambda c, rule: rows.where(F.coalesce(c, F.lit("")) != "").groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(c).alias("subject"))
    return unnamed.unionByName(twice("sample_id", "sample repeated")).unionByName(twice("case_id", "case repeated"))


def sample_variants(spark: SparkSession, path: str) -> DataFrame:
    """Variants of sample documents that any eligible read supports."""
    schema = "sample_id string, variants array<struct<position_1based:int,reference:string,alternate:string,kind:string,support_topology:struct<eligible_reads:int>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    return rows.select("sample_id", F.explode("variants").alias("v")).where("v.support_topology.eligible_reads > 0").select("sample_id", "v.position_1based", "v.reference", "v.alternate", "v.kind")


def read_typed(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A research CSV whose header is exactly that of the schema, each value of its type; anything else fails the read."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", nullValue="", nanValue="\0")


#: A research corpus index and what each case says of its files.
INDEX = "schema_version string, cases array<struct<validation_case_id:string,sample_evidence:string,reads:array<struct<read_sha256:string,trace_path:string>>>>"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(schema_version, validation_case_id, sample_evidence, read_sha256, trace_path): a row for each read of the index."""
    cases = spark.read.schema(INDEX).json(path, multiLine=True, mode="FAILFAST").select("schema_version", F.explode("cases").alias("c"))
    return cases.select("schema_version", "c.validation_case_id", "c.sample_evidence", F.explode("c.reads").alias("r")).select("schema_version", "validation_case_id", "sample_evidence", "r.*")


def index_faults(index: DataFrame) -> DataFrame:
    """(rule, subject): names outside the grammar, reads or files that occur twice."""
    from lociflow.functions import expressions as X

    case, read = F.col("validation_case_id"), F.col("read_sha256")
    named = index.select(F.when(~X.case_name(case), "case name").when(~X.sha256_name(read), "read digest").alias("rule"), F.when(~X.case_name(case), case).otherwise(read).alias("subject")).where("rule IS NOT NULL").distinct()
    twice = index.groupBy("read_sha256").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("read repeated").alias("rule"), F.col("read_sha256").alias("subject"))
    files = index.select("validation_case_id", "sample_evidence").distinct().groupBy("sample_evidence").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("evidence of several cases").alias("rule"), F.col("sample_evidence").alias("subject"))
    return named.unionByName(twice).unionByName(files)


def read_runtime(spark: SparkSession, folders: list[str], windows: str, candidates: str) -> tuple[DataFrame, DataFrame]:
    """Windows and candidates of many phase artifacts, each with the folder it comes from."""
    found = []
    for name, schema in (("windows.csv", windows), ("candidates.csv", candidates)):
        table = read_typed(spark, [f"{x}/{name}" for x in folders], schema)
        found.append(table.withColumn("artifact", F.regexp_extract(F.input_file_name(), f"([^/]+)/{name}", 1)))
    return found[0], found[1]
