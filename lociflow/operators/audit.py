"""Audits and roll-ups of the research layer: cases, reads, controls, recurrent loci, warnings, events as text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.operators.calls import warning_counts

EDGE = 10


def event_parts(text: Column) -> dict[str, Column]:
    """Kind, position, reference and alternate of `KIND:POS:REF>ALT`; null where the text is no event."""
    pattern = "^(SNV|INS|DEL):([0-9]+):([ACGT]+)>([ACGT]+)$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return {"kind": part(1), "position": part(2).cast("int"), "reference": part(3), "alternate": part(4)}


def footprint(kind: Column, position: Column, reference: Column) -> tuple[Column, Column]:
    """First and last reference position that an event touches, inclusive: an insertion touches both neighbours, a deletion
    its deleted bases."""
    start = F.when(kind == "DEL", position + 1).otherwise(position)
    end = F.when(kind == "DEL", position + F.length(reference) - 1).when(kind == "INS", position + 1).otherwise(position)
    return start, end


def applicable(reference_length: int, circular: bool, sha256: str, known_sha256: str, length: int = 16_569) -> bool:
    """Whether tract geometry holds for a reference: circular, of the known length and content."""
    return circular and reference_length == length and sha256 == known_sha256


def mass_faults(candidates: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Candidates whose informative masses do not sum up to one, or have means without information."""
    total = F.col("mean_zero") + F.col("mean_shifted") + F.col("mean_residual")
    return candidates.where((F.abs(total - 1) > tolerance) | ((F.col("informative") == 0) != F.col("mean_zero").isNull()))


def case_geometry(loci: DataFrame, case: str, mixed: str, state: str = "state") -> DataFrame:
    """Loci of a case: how many, how many mixed, and their states."""
    counts = [F.count_if(F.col(state) == s).alias(f"{s}_loci") for s in ("reference", "alternate", "deletion", "unresolved")]
    return loci.groupBy(case).agg(F.count("*").alias("loci"), F.count_if(F.col(mixed)).alias("mixed_loci"), *counts)


def mixed_audit(loci: DataFrame, observations: DataFrame, keys: Sequence[str], edge: str = "edge_distance", forward: str = "forward", noisy: str = "noisy") -> DataFrame:
    """Alternate observations at mixed loci by direction, noise and nearness to a read's edge (EDGE calls or fewer)."""
    joined = observations.where("state = 'alternate'").join(loci.select(*keys), list(keys), "left_semi")
    f, n, e = F.col(forward), F.col(noisy), F.col(edge) <= EDGE
    out = joined.groupBy(*keys).agg(F.count("*").alias("alternates"), F.count_if(f).alias("forward"), F.count_if(~f).alias("reverse"), F.count_if(n).alias("noisy"), F.count_if(e).alias("near_edge"), F.min(edge).alias("least_edge_distance"))
    return out.withColumn("edge_discordant", (F.col("near_edge") == F.col("alternates")) & (F.least("forward", "reverse") == 0))


def case_audit(reads: DataFrame, mixed: DataFrame, case: str, metrics: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """A case's reads: count, least, greatest and 95th nearest-rank value of each metric, how many carry each flag, and its
    mixed loci."""
    out = reads.groupBy(case).agg(F.count("*").alias("reads"), *[x for m in metrics for x in (F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), X.nearest_rank(m, 0.95).alias(f"{m}_p95"))], *[F.count_if(F.col(f)).alias(f"{f}_reads") for f in flags])
    return out.join(mixed.groupBy(case).agg(F.count("*").alias("mixed_loci"), F.count_if("edge_discordant").alias("edge_discordant_loci")), case, "left").fillna(0, ["mixed_loci", "edge_discordant_loci"])


def decisions_template(queue: DataFrame, columns: Sequence[str] = ("decision", "reviewer", "decided_at", "notes")) -> DataFrame:
    return queue.select("*", *[F.lit("").alias(c) for c in columns])


def constant_orientation(loci: DataFrame, declared: DataFrame, keys: Sequence[str], orientation: str = "orientation") -> DataFrame:
    """(keys, rule): reads whose orientation is not the same at all loci, declared reads without locus, reads not declared."""
    seen = loci.groupBy(*keys).agg(F.min(orientation).alias("__a"), F.max(orientation).alias("__b"))
    keys = list(keys)
    parts = [
        seen.where("__a <> __b").select(*keys, F.lit("orientation differs").alias("rule")), declared.join(seen, keys, "left_anti").select(*keys, F.lit("declared read without locus").alias("rule")), seen.join(declared, keys, "left_anti").select(*keys, F.lit("read not declared").alias("rule")),
    ]
    return reduce(DataFrame.unionByName, parts)


def control_loci(rows: DataFrame, keys: Sequence[str], role: str, weights: str = "weights", base: str = "base") -> DataFrame:
    """Mean profile of either role at a locus, their total variation, and the sorted different bases seen."""
    mean = lambda side: F.array(*[F.avg(F.when(side, F.get(F.col(weights), F.lit(i)))) for i in range(4)])
    out = rows.groupBy(*keys).agg(mean(F.col(role)).alias("with_mean"), mean(~F.col(role)).alias("without_mean"), F.array_join(F.sort_array(F.collect_set(base)), ";").alias("bases"))
    whole = lambda a: F.when(F.get(F.col(a), F.lit(0)).isNotNull(), F.col(a))
    return out.withColumn("distance", X.total_variation(whole("with_mean"), whole("without_mean")))


def read_envelope(envelopes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Window envelopes of a read: windows, the widest range, the greatest share and the mean of the greatest masses."""
    return envelopes.groupBy(*keys).agg(F.count("*").alias("windows"), F.max("mean_shifted_range").alias("widest_range"), F.max("shifted_share_max").alias("greatest_share"), F.avg("mean_shifted_max").alias("mean_of_greatest"))


def recurrent_context(positions: DataFrame, members: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Windows that hold a recurrent position, and those windows' candidates. `positions` has the column distance."""
    windows = members.select(*keys, "window", "distance").join(positions.distinct(), "distance").groupBy(*keys, "window").agg(F.count("*").alias("recurrent_positions"))
    return windows, candidates.join(windows, [*keys, "window"])


def sample_metrics(topology: DataFrame, sample: str) -> DataFrame:
    """Sums over a sample's loci of every count column."""
    counts = [c for c, kind in topology.dtypes if c != sample and kind in ("bigint", "int") and c != "position"]
    return topology.groupBy(sample).agg(F.count("*").alias("loci"), *[F.sum(c).alias(c) for c in counts])


def read_warnings(traces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Warnings of a read: ambiguous calls, calls that differ from the vendor's, calls without a peak, noisy regions, and their sum.
    Each trace counts its own, so no row of a call or window leaves its task."""
    kinds = ("ambiguous_calls", "vendor_disagreements", "calls_without_peak", "noisy_regions")
    out = warning_counts(traces, tuple(keys)).groupBy(*keys).agg(*[F.sum(k).alias(k) for k in kinds])
    return out.withColumn("warnings", F.col("ambiguous_calls") + F.col("vendor_disagreements") + F.col("calls_without_peak") + F.col("noisy_regions"))


def topology_faults(topology: DataFrame) -> DataFrame:
    """Rows whose counts do not add up."""
    states = F.col("reference_reads") + F.col("alternate_reads") + F.col("deletion_reads") + F.col("unresolved_reads")
    return topology.where((F.col("forward_reads") + F.col("reverse_reads") != F.col("reads")) | (states != F.col("reads")) | (F.col("alternate_forward") + F.col("alternate_reverse") != F.col("alternate_reads")))
