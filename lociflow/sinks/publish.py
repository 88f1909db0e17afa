"""Sinks: tables and documents that appear whole or not at all and never replace what is there."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.operators import calls as C


def publish_table(df: DataFrame, path: str, columns: tuple[str, ...], kind: str = "parquet") -> None:
    """Write exactly the named columns, in order, to a path that must be new; the commit protocol shows it when whole."""
    if tuple(df.columns) != tuple(columns):
        raise ValueError(f"columns are {df.columns}, not {list(columns)}")
    writer = df.write.mode("errorifexists")
    writer.option("header", True).option("lineSep", "\n").csv(path) if kind == "csv" else writer.format(kind).save(path)


def staged(folder: str):
    """A keep() for plans.analysis: writes a table below a folder that all executors see, once, and reads it from there on."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return keep


def publish_document(document: dict, path: str) -> str:
    """One indented JSON document on the driver: a synced sibling is linked to its place, so it never replaces another."""
    data = (json.dumps(document, indent=2, ensure_ascii=False) + "\n").encode()
    folder = os.path.dirname(os.path.abspath(path))
    staged = os.path.join(folder, f".{uuid.uuid4().hex}")
    try:
        with open(staged, "xb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.link(staged, path)  # fails if the path exists
    finally:
        if os.path.exists(staged):
            os.unlink(staged)
    handle = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)
    return hashlib.sha256(data).hexdigest()


def json_rows(df: DataFrame) -> DataFrame:
    """Compact JSON, a row each; null fields are left out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def basecall_documents(calls: DataFrame, keys: tuple[str, ...] = ("input_name", "input_sha256")) -> DataFrame:
    """A trace's calls as one row: sequences and ordered call structs, with counts that must agree."""
    fields = [c for c in calls.columns if c not in keys]
    ordered = F.array_sort(F.collect_list(F.struct("call_index", *[c for c in fields if c != "call_index"])))
    out = calls.groupBy(*keys).agg(ordered.alias("calls"))
    text = lambda name: F.array_join(F.transform("calls", lambda c: c[name]), "")
    out = out.select(*keys, F.lit("basecalls/v2").alias("schema"), F.size("calls").alias("call_count"), text("primary").alias("primary_sequence"), text("ambiguity").alias("ambiguity_sequence"), "calls")
    return out.withColumn("consistent", (F.length("primary_sequence") == F.col("call_count")) & (F.length("ambiguity_sequence") == F.col("call_count")))


def sample_documents(sample: str, **parts: DataFrame) -> DataFrame:
    """One row a sample: each part's rows as an array of structs in full order."""
    out = None
    for name, rows in parts.items():
        fields = [c for c in rows.columns if c != sample]
        packed = rows.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = packed if out is None else out.join(packed, sample, "full_outer")
    return out.withColumn("schema", F.lit("sample_evidence/v8"))


def variant_reports(variants: DataFrame, calls: DataFrame, alignments: DataFrame, keys: tuple[str, ...] = ("input_name", "input_sha256")) -> DataFrame:
    """(keys, variants): a read's reported variants in order, each with its calls as the reference strand has them: role, base,
    heights and relative quality. `calls` has primary, primary_heights and relative_quality by call_index."""
    reported = variants.where("position_1based IS NOT NULL AND size(exclusion_reasons) = 0")
    event = ["position_1based", "reference", "alternate", "kind"]
    role = lambda c, name: F.transform(c, lambda i: F.struct(i.alias("call_index"), F.lit(name).alias("role")))
    each = reported.select(*keys, *event, F.explode_outer(F.concat(role("supporting", "supporting"), role("flanking", "flanking"))).alias("m")).select(*keys, *event, "m.*")
    reverse = F.col("orientation") == "reverse"
    joined = each.join(alignments.select(*keys, "orientation"), list(keys)).join(calls.select(*keys, "call_index", "primary", "primary_heights", "relative_quality"), [*keys, "call_index"], "left")
    call = F.struct("call_index", "role", X.strand_base(F.col("primary"), reverse).alias("base"), X.strand_vector(F.col("primary_heights"), reverse).alias("peaks"), F.col("relative_quality").alias("quality"))
    packed = joined.groupBy(*keys, *event).agg(F.array_sort(F.collect_list(F.when(F.col("call_index").isNotNull(), call))).alias("calls"))
    return packed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*event, "calls"))).alias("variants"))


def analysis_documents(done, traces: DataFrame, reference, settings) -> DataFrame:
    """One row a placed read: provenance, read, trace quality, alignment, variants and warnings. `done` is plans.analysis.Analysis,
    `reference` a ReferenceSequence."""
    keys = ["input_name", "input_sha256"]
    called = done.quality.groupBy(*keys).agg(
        F.count("*").alias("call_count"), F.count_if(F.col("primary") == "N").alias("unresolved_primary_calls"), F.count_if((F.col("ambiguity") == "N") & (F.size("qualifying") > 2)).alias("multi_channel_unresolved_calls"),
    )
    integrity = C.trace_integrity(traces)
    mismatches = (F.coalesce("primary_length_differs", F.lit(False)).cast("int") + F.coalesce("quality_length_differs", F.lit(False)).cast("int")).alias("ploc_vendor_length_mismatches")
    integrity = integrity.select(*keys, mismatches, "clipped_samples", F.struct("n_calls", "n_samples", "min_spacing", "median_spacing", "max_spacing", "clipped_samples").alias("integrity"))
    noisy = done.noisy.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("region_start", "region_end", "min_snr"))).alias("noisy_regions"))
    excluded = done.variants.where("size(exclusion_reasons) > 0").groupBy(*keys).agg(F.count("*").alias("excluded_variant_candidates"))
    out = done.alignments.where("error_class IS NULL")
    for part in (called, integrity, done.trims):
        out = out.join(part, keys)
    for part in (noisy, excluded, variant_reports(done.variants, done.quality, done.alignments)):
        out = out.join(part, keys, "left")
    listed = lambda name: F.coalesce(name, F.array())
    topology = "circular" if reference.circular else "linear"
    return out.select(
        *keys, F.lit("analysis/v7").alias("schema_version"),
        F.struct(F.struct(F.col("input_sha256").alias("sha256")).alias("input"), F.struct(F.lit(reference.name).alias("name"), F.lit(topology).alias("topology"), F.lit(reference.sha256).alias("sha256")).alias("reference"), F.lit(settings.sha256).alias("configuration_sha256")).alias("provenance"),
        F.struct("call_count", F.struct(F.col("trim_start").alias("start"), F.col("trim_end").alias("end")).alias("trim")).alias("read"),
        F.struct("integrity", listed("noisy_regions").alias("noisy_regions")).alias("trace_quality"),
        F.struct("orientation", F.col("callable_columns").alias("callable_bases"), F.col("callable_identity").alias("identity"), F.col("unresolved").alias("unresolved_bases"), "gap_opens", X.reference_segments(F.col("start0"), F.col("end0"), len(reference.bases)).alias("reference_segments"), "wraps_origin").alias("alignment"),
        listed("variants").alias("variants"),
        F.struct("unresolved_primary_calls", "multi_channel_unresolved_calls", "ploc_vendor_length_mismatches", F.col("clipped_samples").alias("clipped_channel_samples"), F.coalesce("excluded_variant_candidates", F.lit(0)).alias("excluded_variant_candidates")).alias("warnings"),
    )


def phase_artifact(windows: DataFrame, candidates: DataFrame, folder: str) -> DataFrame:
    """windows and candidates as CSV below a new folder, and their index (file, part, sha256, rows, columns), which is written
    last: a row for each part file, its digest and rows taken by Spark from what is on disk."""
    spark, parts = windows.sparkSession, []
    for name, table in (("windows.csv", windows), ("candidates.csv", candidates)):
        publish_table(table, f"{folder}/{name}", tuple(table.columns), "csv")
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{name}")
        lines = F.size(F.filter(F.split(F.decode("content", "utf-8"), "\n"), lambda x: x != "")) - 1
        parts.append(files.select(F.lit(name).alias("file"), F.regexp_extract("path", "([^/]+)$", 1).alias("part"), F.sha2("content", 256).alias("sha256"), lines.cast("long").alias("rows"), F.lit(list(table.columns)).alias("columns")))
    parts[0].unionByName(parts[1]).coalesce(1).write.mode("errorifexists").json(f"{folder}/index")
    return spark.read.schema("file string, part string, sha256 string, rows long, columns array<string>").json(f"{folder}/index")


def complete_samples(reads: DataFrame, sample: str = "sample") -> DataFrame:
    """Samples none of whose traces failed: one failure holds the sample's aggregate back, and nothing else."""
    failed = reads.where("error_class IS NOT NULL").select(sample).distinct()
    return reads.join(failed, sample, "left_anti")


class EventLog:
    """Lines `time | LEVEL | module:line - run_id=... event=... key=value`, appended; separators in values are escaped."""

    def __init__(self, path: str, run_id: str | None = None) -> None:
        self.path, self.run_id = path, run_id or uuid.uuid4().hex

    def write(self, event: str, level: str = "INFO", place: str = "pipeline:0", **fields) -> None:
        now = time.time()
        stamp = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(now)) + f".{int(now * 1000) % 1000:03d}"
        shown = lambda v: json.dumps(str(v), ensure_ascii=False) if any(c in str(v) for c in ' "|=\n\r\t') or not str(v) else str(v)
        said = " ".join(f"{k}={shown(v)}" for k, v in {"run_id": self.run_id, "event": event, **fields}.items())
        with open(self.path, "a", encoding="utf-8") as out:
            out.write(f"{stamp} | {level:<8} | {place} - {said}\n")
