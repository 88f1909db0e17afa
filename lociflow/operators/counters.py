"""Counters of a sample's evidence, taken by a group or along a write, and how many different units groups have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.operators.held import held


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _known(c: str) -> Column:
    return F.count(F.col(c))


def _positive(c: str) -> Column:
    return F.coalesce(F.sum(F.size(F.filter(c, lambda x: x > 0))), F.lit(0))


def locus_counters() -> dict[str, Column]:
    """Over loci with their topology and support (samples.locus_topology and locus_support, joined)."""
    mass = F.aggregate("total_mean", F.lit(0.0), lambda a, x: a + x) * F.col("total_contributors")
    both = F.col("forward_mean").isNotNull() & F.col("reverse_mean").isNotNull()
    return {
        "profiled_locus_observations": _total("total_contributors"), "profiled_locus_forward_reads": _total("forward_contributors"), "profiled_locus_reverse_reads": _total("reverse_contributors"),
        "nucleotide_support_loci": _known("total_mean"), "bidirectional_nucleotide_support_loci": F.count_if(both), "unweighted_nucleotide_profile_mass": F.coalesce(F.sum(mass), F.lit(0.0)),
        "profile_geometry_loci": _known("total_total"), "within_profile_impurity_sum": _total("total_within"), "between_profile_dispersion_sum": _total("total_between"), "total_profile_heterogeneity_sum": _total("total_total"),
        "forward_profile_geometry_loci": _known("forward_total"), "reverse_profile_geometry_loci": _known("reverse_total"), "directional_profile_distance_loci": _known("directional_distance"), "directional_profile_distance_sum": _total("directional_distance"),
        **{f"locus_{n}_reads": _total(f"{n}_reads") for n in ("forward", "reverse", "reference", "alternate", "unresolved", "deletion")},
    }


def observation_counters() -> dict[str, Column]:
    """Over observations (state, weights, noisy, corrected, snrs)."""
    part = X.contribution(F.col("state"), F.col("weights"))
    return {
        "noisy_locus_observations": F.count_if("noisy"), "eligible_nucleotide_locus_observations": F.count_if(part == "eligible"), "missing_profile_locus_observations": F.count_if(part == "missing_profile"),
        "deletion_event_locus_observations": F.count_if(part == "deletion_event"), "locus_positive_corrected_channels": _positive("corrected"), "locus_positive_snr_channels": _positive("snrs"),
    }


def call_counters() -> dict[str, Column]:
    """Over the calls that support variants (profile, noisy, corrected, snrs)."""
    return {"profiled_variant_calls": _known("profile"), "noisy_variant_calls": F.count_if("noisy"), "variant_positive_corrected_channels": _positive("corrected"), "variant_positive_snr_channels": _positive("snrs")}


def counted(rows: DataFrame, counters: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """Rows that are counted as they pass: write the frame, then read the observation's `get`. No second pass is made. An action
    that runs the frame twice would count the first run."""
    seen = Observation()
    return rows.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


def sample_counters(loci: DataFrame, observations: DataFrame, calls: DataFrame | None, sample: str) -> DataFrame:
    """All counters of each sample: one aggregate a table, then joins of a row a sample."""
    parts = [(loci, locus_counters()), (observations, observation_counters())] + ([(calls, call_counters())] if calls is not None else [])
    out = None
    for rows, counters in parts:
        one = rows.groupBy(sample).agg(*[c.alias(n) for n, c in counters.items()])
        out = one if out is None else out.join(one, sample, "full_outer")
    return out.fillna(0)


#: Groups whose numbers are sent to every task, and rows of a task that counts.
SENT_GROUPS, COUNTED_ROWS = 100_000, 250_000


def distinct_units(rows: DataFrame, keys: Sequence[str], units: dict[str, Column], sums: dict[str, Column] | None = None, parts: dict[str, Column] | None = None) -> DataFrame:
    """For each group how many different values each unit has (nulls none), and sums. Groups are numbered once, so what is sent of a
    row are its group's number and the values, not the keys; no row is joined to a number of its value.

    `parts` names for a unit a part of its value, which may be its whole: units of one part are counted where its rows meet, by one
    shuffle. A value lies in one task then, so the tasks' counts add up. Units without a part, or alone with it, are counted by an
    aggregate that merges repeats before it sends them; so a part that few values share should not be named."""
    parts, marks = parts or {}, {k: f"__k{i}" for i, k in enumerate(keys)}
    groups = held(rows.groupBy(*keys).agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in (sums or {}).items()]).withColumn("__g", F.monotonically_increasing_id()))
    number, n_rows = groups.agg(F.count("*"), F.sum("rows")).first()
    names = groups.select("__g", *[F.col(k).alias(m) for k, m in marks.items()])
    values = {n: f"__v{i}" for i, n in enumerate(units)}
    given = rows.select(*keys, *[c.alias(values[n]) for n, c in units.items()], *[c.alias(f"__p{values[n]}") for n, c in parts.items()])
    numbered = given.join(F.broadcast(names) if number <= SENT_GROUPS else names, [given[k].eqNullSafe(names[m]) for k, m in marks.items()])
    met: dict[str, list[str]] = {}
    for n in units:
        met.setdefault(str(parts[n]) if n in parts else f"alone {n}", []).append(n)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n_rows or 0) // COUNTED_ROWS)
    out = groups
    for i, some in enumerate(met.values()):
        if len(some) > 1:
            part = f"__p{values[some[0]]}"
            dealt = numbered.select("__g", F.col(part).alias("__part"), *[values[n] for n in some]).repartition(tasks, "__part")
            # a row a unit by explode, which keeps the rows' tasks; the Expand of several distinct counts would shuffle them again
            entry = lambda n: F.struct(F.lit(n).alias("__u"), *[(F.col(values[m]) if m == n else F.lit(None)).alias(values[m]) for m in some])
            each = dealt.select("__g", "__part", F.explode(F.array(*[F.when(F.col(values[n]).isNotNull(), entry(n)) for n in some])).alias("__x")).where("__x IS NOT NULL").select("__g", "__part", "__x.*").distinct()
            found = each.groupBy("__g").agg(*[F.count_if(F.col("__u") == n).alias(n) for n in some])
        else:
            found = numbered.groupBy("__g").agg(F.count_distinct(values[some[0]]).alias(some[0]))
        out = out.join(found.withColumnRenamed("__g", f"__g{i}"), F.col("__g") == F.col(f"__g{i}"), "left").drop(f"__g{i}")
    return out.select(*keys, "rows", *(sums or {}), *[F.coalesce(n, F.lit(0)).alias(n) for n in units])
