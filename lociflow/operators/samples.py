"""Evidence of many reads of a sample: overlaps, locus support, heterogeneity, variants, regions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.operators.ranks import HOT_ROWS, grouped_ranks
from lociflow.operators.windows import running

STATES = ("reference", "alternate", "deletion", "unresolved")


def ordered_reads(reads: DataFrame, sample: str, digest: str) -> DataFrame:
    """Reads numbered from 0 by their content digest; a digest that repeats within a sample is told."""
    same = F.count("*").over(Window.partitionBy(sample, digest)) > 1
    return reads.withColumn("read_index", F.row_number().over(Window.partitionBy(sample).orderBy(digest)) - 1).withColumn("duplicate_content", same)


def interval_counts(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str, width: int = 4_096) -> DataFrame:
    """Points with how many half-open intervals hold them, `held`: starts so far less ends so far, summed in two levels. No pair
    of a point and an interval is formed, so many intervals over many points cost no more than both."""
    good = intervals.where(F.col(start) < F.col(end))
    ends = good.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("__at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("__at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.*")
    asked = points.select(*keys, F.col(point).alias("__at"), F.lit(0).alias("d"))
    steps = ends.unionByName(asked).where("__at IS NOT NULL").groupBy(*keys, "__at").agg(F.sum("d").alias("d"))
    depth = running(steps, keys, "__at", width, sums={"held": F.col("d")}).select(*[F.col(k).alias(f"__{k}") for k in keys], "__at", "held")
    same = reduce(lambda a, b: a & b, [points[k].eqNullSafe(depth[f"__{k}"]) for k in keys], points[point] == depth["__at"])
    return points.join(depth, same, "left").drop("__at", *[f"__{k}" for k in keys]).withColumn("held", F.coalesce("held", F.lit(0)))


#: Positions of a bitmap.
BITS = 64


def base_bitmaps(observations: DataFrame, sample: str, read: str, position: str, base: str) -> DataFrame:
    """(sample, block, read, covered, A, C, G, T): for each block of BITS positions the bits of those that a read covers, and of
    those at which it has each base. A read has one observation at a position."""
    bit = F.expr(f"shiftleft(1L, CAST(pmod(`{position}`, {BITS}) AS INT))")
    held = observations.select(F.col(sample).alias("sample"), F.floor(F.col(position) / BITS).alias("block"), F.col(read).alias("read"), F.col(base).alias("base"), bit.alias("bit"))
    some = lambda c: F.coalesce(F.bit_or(F.when(c, F.col("bit"))), F.lit(0))
    return held.groupBy("sample", "block", "read").agg(F.bit_or("bit").alias("covered"), *[some(F.col("base") == b).alias(b) for b in X.BASES])


def overlaps(observations: DataFrame, sample: str, read: str, position: str, base: str, least: int = 25, agreement: float = 0.5) -> DataFrame:
    """Pairs of reads that share positions. Reads meet by blocks of positions, not by positions: what they share, can compare and
    agree on in a block are bits that both have, so a pair gives a row a block before the aggregate. Agreement is null without
    comparable positions; reasons stand in their fixed order."""
    maps = base_bitmaps(observations, sample, read, position, base)
    side = lambda name: maps.select("sample", "block", F.col("read").alias(f"{name}_read"), *[F.col(c).alias(f"{name}_{c}") for c in ("covered", *X.BASES)])
    pairs = side("left").join(side("right"), ["sample", "block"]).where("left_read < right_read")
    both = lambda a, b: F.bit_count(a.bitwiseAND(b))
    any_base = lambda name: reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"{name}_{b}") for b in X.BASES])
    same = reduce(lambda x, y: x + y, [both(F.col(f"left_{b}"), F.col(f"right_{b}")) for b in X.BASES])
    met = pairs.select("sample", "left_read", "right_read", both(F.col("left_covered"), F.col("right_covered")).alias("shared"), both(any_base("left"), any_base("right")).alias("comparable"), same.alias("agreements")).where("shared > 0")
    out = met.groupBy("sample", "left_read", "right_read").agg(*[F.sum(c).alias(c) for c in ("shared", "comparable", "agreements")])
    out = out.withColumn("conflicts", F.col("comparable") - F.col("agreements")).withColumn("agreement", X.ratio(F.col("agreements"), F.col("comparable")))
    reasons = X.flags(("insufficient_comparable_bases", F.col("comparable") < least), ("agreement_below_minimum", F.coalesce(F.col("agreement") < agreement, F.lit(True))))
    return out.withColumn("reasons", X.flag_text(reasons)).withColumn("eligible", F.size(reasons) == 0)


def with_state(observations: DataFrame, base: str = "base", reference: str = "reference") -> DataFrame:
    kind = F.when(F.col(base) == "-", "deletion").otherwise("base")
    return observations.withColumn("state", X.locus_state(kind, F.col(base), F.col(reference)))


def differential_loci(observations: DataFrame, sample: str, position: str, all_covered: bool = False) -> DataFrame:
    """All observations at the positions where any read differs from the reference (one window, one shuffle), or at all
    positions that a read covers."""
    if all_covered:
        return observations
    differs = F.max((F.col("state") != "reference").cast("int")).over(Window.partitionBy(sample, position))
    return observations.withColumn("__differs", differs).where("__differs = 1").drop("__differs")


def locus_topology(observations: DataFrame, keys: Sequence[str], forward: str = "forward") -> DataFrame:
    counts = [F.count("*").alias("reads"), F.count_if(F.col(forward)).alias("forward_reads"), F.count_if(~F.col(forward)).alias("reverse_reads")]
    counts += [F.count_if(F.col("state") == s).alias(f"{s}_reads") for s in STATES]
    counts += [F.count_if((F.col("state") == "alternate") & d).alias(n) for n, d in (("alternate_forward", F.col(forward)), ("alternate_reverse", ~F.col(forward)))]
    return observations.groupBy(*keys).agg(*counts)


def locus_support(observations: DataFrame, keys: Sequence[str], forward: str = "forward", weights: str = "weights") -> DataFrame:
    """Unweighted sums of profiles in all and in either direction: contributors, mean profile (null without), within, total
    and between heterogeneity, and the distance between the directions' means."""
    w, out = F.col(weights), []
    sides = {"total": F.lit(True), "forward": F.col(forward), "reverse": ~F.col(forward)}
    for name, side in sides.items():
        held = w.isNotNull() & side
        out.append(F.count_if(held).alias(f"{name}_contributors"))
        out += [F.sum(F.when(held, F.get(w, F.lit(i)))).alias(f"__{name}_{i}") for i in range(4)]
        out.append(F.avg(F.when(held, X.gini_impurity(w))).alias(f"{name}_within"))
    table = observations.groupBy(*keys).agg(*out)
    columns = [F.col(k) for k in keys]
    for name in sides:
        n = F.col(f"{name}_contributors")
        mean = F.when(n > 0, F.array(*[F.col(f"__{name}_{i}") / n for i in range(4)]))
        table = table.withColumn(f"{name}_mean", mean).withColumn(f"{name}_total", X.gini_impurity(F.col(f"{name}_mean")))
        between = F.col(f"{name}_total") - F.col(f"{name}_within")
        table = table.withColumn(f"{name}_between", F.when((between < 0) & (between >= -1e-12), F.lit(0.0)).otherwise(between))
        columns += [n, F.col(f"{name}_mean"), F.col(f"{name}_within"), F.col(f"{name}_total"), F.col(f"{name}_between")]
    return table.select(*columns, X.total_variation(F.col("forward_mean"), F.col("reverse_mean")).alias("directional_distance"))


def variant_topology(found: DataFrame, keys: Sequence[str], forward: str = "forward", eligible: str = "eligible", read: str = "read") -> DataFrame:
    """Supporting reads of each variant in six ways; a read that names a variant twice is told."""
    f, e = F.col(forward), F.col(eligible)
    ways = {"reads": F.lit(True), "forward_reads": f, "reverse_reads": ~f, "eligible_reads": e, "eligible_forward": e & f, "eligible_reverse": e & ~f}
    return found.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in ways.items()], (F.count(read) > F.count_distinct(read)).alias("repeated_read"))


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str, width: int) -> DataFrame:
    """Points joined with the half-open intervals that hold them. Intervals are dealt to bins of `width`, so that the join is
    an equi-join that shuffles by key and bin instead of a nested loop."""
    binned = intervals.where(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    placed = points.withColumn("__bin", F.floor(F.col(point) / width))
    return placed.join(binned, [*keys, "__bin"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("__bin")


def metric_summary(rows: DataFrame, keys: Sequence[str], name: str, limit: int = HOT_ROWS) -> DataFrame:
    """n, missing, min, mean, exact nearest-rank quantiles and max of a metric in each group."""
    plain = [F.count(name).alias("n"), F.count_if(F.col(name).isNull()).alias("missing"), F.min(name).alias("min"), F.avg(name).alias("mean"), F.max(name).alias("max")]
    ranks = {f"p{round(100 * p)}": (name, p) for p in (0.5, 0.9, 0.95, 0.99)}
    return grouped_ranks(rows, keys, plain, ranks, limit).select(*keys, "n", "missing", "min", "mean", *ranks, "max")


def neighbour_mass(profiles: DataFrame, read: Sequence[str], position: str, mass: str, length: int) -> DataFrame:
    """Each locus of a read beside the mass at the one before and after it on a circle; two equi-joins on the shifted key. The
    place looked for is turned, not the places that are there, so that one beyond the circle is nobody's neighbour."""
    shifted = lambda step: F.pmod(F.col(position) + step, F.lit(length))
    there = lambda at, name: profiles.select(*read, F.col(position).alias(at), F.col(mass).alias(name))
    asked = profiles.select(*read, position, shifted(-1).alias("__before"), shifted(1).alias("__after"))
    both = asked.join(there("__before", "previous_mass"), [*read, "__before"], "left").join(there("__after", "next_mass"), [*read, "__after"], "left")
    return both.select(*read, position, "previous_mass", "next_mass")
