"""From trace files to placed reads, variants and sample evidence: one plan over all traces, errors kept in their rows.

Each step's table is used by several others. Without `keep` all are lazy and computed again wherever they are used; a keep()
such as sinks.publish.staged() writes each once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.operators import alignment as A
from lociflow.operators import calls as C
from lociflow.operators import phase as H
from lociflow.operators import samples as S
from lociflow.operators import windows as W
from lociflow.sources.corpus import ReferenceSequence
from lociflow.sources.settings import Settings

KEYS = ("input_name", "input_sha256")


@dataclass(frozen=True)
class Analysis:
    """Tables of an analysis."""

    calls: DataFrame
    runs: DataFrame
    noisy: DataFrame
    loci: DataFrame
    quality: DataFrame
    trims: DataFrame
    alignments: DataFrame
    columns: DataFrame
    variants: DataFrame


Keep = Callable[[DataFrame, str], DataFrame]


def analyze(traces: DataFrame, reference: ReferenceSequence, settings: Settings | None = None, keep: Keep = lambda df, name: df) -> Analysis:
    s = settings or Settings()
    keys = list(KEYS)
    traces = keep(traces, "traces")
    called = keep(C.call_bases(traces, s.basecalling.secondary_peak_ratio), "calls")
    runs = C.call_windows(traces, s.noise_windows.window_size_bases, s.noise_windows.minimum_primary_snr)
    noisy = W.noisy_regions(runs, keys, s.noise_windows.minimum_noisy_windows)
    loci = keep(C.locus_evidence(traces, s.noise_windows.window_size_bases), "loci")
    q = s.quality_control
    scored = keep(W.relative_quality(W.penalties(called, keys, q.trim_window_size), keys, q.max_relative_quality_score), "scored")
    trims = W.trim(scored, W.best_section(scored, keys, q.best_section_fraction), keys, q.trim_window_size, q.trim_stringency, q.minimum_retained_bases)
    kept = scored.select(*keys, "call_index", "primary").join(trims.where("retained"), keys).where("call_index >= trim_start AND call_index < trim_end").join(loci.select(*keys, "call_index", "profile"), [*keys, "call_index"])
    ordered = F.array_sort(F.collect_list(F.struct("call_index", "primary", "profile")))
    reads = kept.groupBy(*keys).agg(ordered.alias("x")).select(*keys, F.array_join(F.transform("x", lambda v: v.primary), "").alias("query"), F.transform("x", lambda v: v.profile).alias("profiles"), F.col("x")[0].call_index.alias("first_call"))
    a = s.alignment
    scoring = A.Scoring(a.match_score, a.mismatch_score, a.gap_open_score, a.gap_extension_score, a.ambiguous_score, a.minimum_callable_bases, a.minimum_identity)
    placed = keep(A.align_reads(reads, reference.bases, reference.circular, scoring, KEYS), "alignments")
    columns = A.alignment_columns(placed, KEYS)
    v = s.variant_calling
    found = A.merge_variants(A.variants(columns, reference.bases, reference.circular, v.max_indel_length, KEYS), KEYS)
    evidence = scored.select(*keys, "call_index", F.array_max(F.transform("peaks", lambda p: p.height)).alias("highest_peak"), "relative_quality", F.size("qualifying").alias("n_qualifying"))
    judged = keep(A.filter_variants(found, evidence, list(v.regions), v.minimum_peak_height, v.relative_quality_threshold, KEYS), "variants")
    return Analysis(called, runs, noisy, loci, scored, trims, placed, columns, judged)


@dataclass(frozen=True)
class Tract:
    """A row of one base around another on a circle: its first and last place and that of the other base, from 0."""

    name: str
    first: int
    last: int
    interrupt: int
    bases: str


#: The two tracts of the known reference. Fixed values.
TRACTS = (Tract("hv2", 302, 314, 309, "CCCCCCCTCCCCC"), Tract("hv1", 16_183, 16_192, 16_188, "CCCCCTCCCC"))


def phase_evidence(done: Analysis, reference: ReferenceSequence, tracts: tuple[Tract, ...] = TRACTS, size: int = H.SIZE, step: int = H.STEP, most: int = H.OFFSET, keep: Keep = lambda df, name: df) -> dict[str, DataFrame]:
    """For every placed read and tract: whether it can be measured or why not, with the read's base at the interrupt
    (`availability`), the windows and the candidate offsets of those that can (`windows`, `candidates`), and reference
    places that a read shows twice (`faults`). A reference that is no circle, or whose tracts are not there, is an error."""
    if not reference.circular:
        raise ValueError("tracts lie on a circle")
    if wrong := [t.name for t in tracts if reference.bases[t.first : t.last + 1] != t.bases]:
        raise ValueError(f"other bases at {wrong}")
    keys, named = list(KEYS), [*KEYS, "tract"]
    reverse = F.col("orientation") == "reverse"
    profiles = done.loci.select(*keys, "call_index", "profile")
    seen = done.columns.where("ref_pos0 IS NOT NULL").join(profiles, [*keys, "call_index"], "left")
    seen = keep(seen.select(*keys, reverse.alias("reverse"), F.col("ref_pos0").alias("position"), F.col("reference_base").alias("base"), F.col("query_base").alias("read_base"), "call_index", F.when(reverse, F.reverse("profile")).otherwise(F.col("profile")).alias("weights")), "phase-observations")
    faults = seen.groupBy(*keys, "position").agg(F.count("*").alias("n")).where("n > 1").select(*keys, "position")
    after, told = [], []
    for t in tracts:
        behind = H.after_tract(seen.drop("read_base"), keys, t.first, t.last, len(reference.bases)).withColumn("tract", F.lit(t.name))
        inside = seen.where(F.col("position").between(t.first, t.last)).withColumn("tract", F.lit(t.name))
        at = inside.where(F.col("position") == t.interrupt).groupBy(*named).agg(F.first("read_base").alias("interrupt_base"))
        after.append(behind)
        told.append(H.availability(inside, behind, named, t.last - t.first + 1, size).join(at, named, "left"))
    after, told = (reduce(DataFrame.unionByName, x) for x in (after, told))
    every = done.alignments.where("error_class IS NULL").select(*keys, F.explode(F.lit([t.name for t in tracts])).alias("tract"))
    status = keep(every.join(told, named, "left").withColumn("status", F.coalesce("status", F.lit("no_tract_coverage"))).fillna(0, ["covered", "called", "profiled"]), "phase-availability")
    measured = keep(after.join(status.where("status = 'measured'").select(*named), named, "left_semi"), "phase-measured")
    held = H.members(measured, named, size, step)
    return {"availability": status, "windows": H.windows(held, named), "candidates": H.candidates(held, measured, named, most), "faults": faults}


def sample_evidence(done: Analysis, samples: DataFrame, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Coverage, overlaps, locus topology and support, and variants of samples (input_name, sample)."""
    s = settings or Settings()
    reverse = F.col("orientation") == "reverse"
    columns = done.columns.join(samples, "input_name").where("ref_pos0 IS NOT NULL")
    profiles = done.loci.select(*KEYS, "call_index", "profile")
    seen = columns.join(profiles, [*KEYS, "call_index"], "left").select(
        "sample", F.col("input_sha256").alias("read"), F.col("ref_pos0").alias("position"), F.col("query_base").alias("base"), F.col("reference_base").alias("reference"), (~reverse).alias("forward"), F.when(reverse, F.reverse("profile")).otherwise(F.col("profile")).alias("weights"),
    )
    seen = S.with_state(seen)
    placed = done.alignments.where("error_class IS NULL").join(samples, "input_name").select("sample", F.col("start0").alias("seg_start"), F.col("end0").alias("seg_end"), (F.col("orientation") == "forward").alias("forward"))
    differs = S.differential_loci(seen, "sample", "position")
    found = done.variants.where("position_1based IS NOT NULL").join(samples, "input_name").join(done.alignments.select(*KEYS, "orientation"), list(KEYS))
    found = found.select("sample", "position_1based", "reference", "alternate", "kind", F.col("input_sha256").alias("read"), (F.col("orientation") == "forward").alias("forward"), (F.size("exclusion_reasons") == 0).alias("eligible"))
    r = s.sample_reconciliation
    return {
        "coverage": W.coverage_depth(placed, ["sample"]),
        "overlaps": S.overlaps(seen, "sample", "read", "position", "base", r.minimum_comparable_bases, r.minimum_overlap_agreement),
        "topology": S.locus_topology(differs, ["sample", "position"]),
        "support": S.locus_support(differs, ["sample", "position"]),
        "variants": S.variant_topology(found, ["sample", "position_1based", "reference", "alternate", "kind"]),
    }
