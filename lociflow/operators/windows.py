"""Window patterns: islands, sweep lines, count windows, neighbours and best sections. All keep their keys' partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import expressions as X


def _partition(keys: Sequence[str]):
    return Window.partitionBy(*keys)


def locus_windows(calls: DataFrame, keys: Sequence[str], order: str = "call_index", ploc: str = "ploc", samples: str = "sample_count") -> DataFrame:
    """Half-open sample window of each call: up to the midpoints to its neighbours; the outer halves repeat the first and
    last spacing. Reads of fewer than two calls have no windows."""
    w = _partition(keys).orderBy(order)
    before, after, here = F.lag(ploc).over(w), F.lead(ploc).over(w), F.col(ploc)
    start = F.when(before.isNull(), F.greatest(here - F.floor((after - here) / 2), F.lit(0))).otherwise(F.floor((before + here) / 2))
    end = F.when(after.isNull(), F.least(here + F.ceil((here - before) / 2), F.col(samples))).otherwise(F.floor((here + after) / 2))
    return calls.withColumn("w_start", start.cast("long")).withColumn("w_end", end.cast("long")).where("w_start IS NOT NULL AND w_end IS NOT NULL")


def local_maxima(series: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Positive values not below the left neighbour and above the right one, or above the left and not below the right."""
    w = _partition(keys).orderBy(order)
    left, right, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    peak = (v > 0) & (((left <= v) & (v > right)) | ((left < v) & (v >= right)))
    return series.withColumn("is_peak", F.coalesce(peak, F.lit(False)))


def context_starts(calls: DataFrame, keys: Sequence[str], size: int, index: str = "call_index") -> DataFrame:
    """First call of a context of `size` calls around each call, kept within the read."""
    n = F.count("*").over(_partition(keys))
    return calls.withColumn("context_start", F.least(F.greatest(F.col(index) - (size - 1) // 2, F.lit(0)), F.greatest(n - size, F.lit(0))))


def nearest_event(peaks: DataFrame, keys: Sequence[str], centre: Column, position: str, height: str) -> DataFrame:
    """The peak nearest to a locus's centre, the higher of equally near ones, then the first: (keys, event_position)."""
    best = F.min(F.struct(F.abs(F.col(position) - centre).alias("d"), (-F.col(height)).alias("h"), F.col(position).alias("p")))
    return peaks.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.p").alias("event_position"))


def noisy_regions(windows: DataFrame, keys: Sequence[str], least: int, start: str = "w_start", end: str = "w_end", noisy: str = "noisy", snr: str = "min_snr") -> DataFrame:
    """Runs of noisy windows that touch or overlap; those of `least` windows or more, with their bounds and lowest ratio."""
    w = _partition(keys).orderBy(start)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    was = F.lag(noisy).over(w)
    broken = F.when(F.col(noisy), (~F.coalesce(was, F.lit(False))) | (F.col(start) > F.max(F.when(F.col(noisy), F.col(end))).over(earlier))).otherwise(F.lit(True))
    runs = windows.withColumn("run", F.sum(broken.cast("int")).over(w)).where(noisy)
    return runs.groupBy(*keys, "run").agg(F.min(start).alias("region_start"), F.max(end).alias("region_end"), F.count("*").alias("n_windows"), F.min(snr).alias("min_snr")).where(F.col("n_windows") >= least).drop("run")


def running(rows: DataFrame, keys: Sequence[str], order: str, width: int, sums: dict[str, Column] | None = None, latest: dict[str, Column] | None = None, inclusive: bool = True, following: str | None = None) -> DataFrame:
    """Running sums and latest non-null values along a numeric order, without a window over a whole key: rows are dealt to
    buckets of `width` of the order, each bucket is aggregated, the buckets' aggregates are carried forward, and each row
    adds what comes before it in its bucket. `inclusive` counts the row itself; `following` names the next row's order.
    A key's buckets meet in one small window, a bucket's rows in another."""
    sums, latest = sums or {}, latest or {}
    told = rows.withColumn("__b", F.floor(F.col(order) / width)).withColumns({f"__{n}": c for n, c in sums.items()} | {f"__{n}": F.when(c.isNotNull(), F.struct(F.col(order).alias("o"), c.alias("v"))) for n, c in latest.items()})
    parts = told.groupBy(*keys, "__b").agg(F.min(order).alias("__first"), *[F.sum(f"__{n}").alias(f"__all_{n}") for n in sums], *[F.max(f"__{n}").alias(f"__all_{n}") for n in latest])
    w = Window.partitionBy(*keys).orderBy("__b")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__b"])], F.lead("__first").over(w).alias("__next"), *[F.sum(f"__all_{n}").over(earlier).alias(f"__to_{n}") for n in sums], *[F.max(f"__all_{n}").over(earlier).alias(f"__to_{n}") for n in latest])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, "__b"])])
    v = Window.partitionBy(*keys, "__b").orderBy(order)
    here = v.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = told.join(carried, same).withColumns({n: F.coalesce(F.col(f"__to_{n}"), F.lit(0)) + F.coalesce(F.sum(f"__{n}").over(here), F.lit(0)) for n in sums} | {n: F.greatest(F.max(f"__{n}").over(here), F.col(f"__to_{n}"))["v"] for n in latest})
    if following:
        out = out.withColumn(following, F.coalesce(F.lead(order).over(v), F.col("__next")))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *sums, *latest, *([following] if following else []))


def coverage_depth(segments: DataFrame, keys: Sequence[str], start: str = "seg_start", end: str = "seg_end", forward: str = "forward", width: int = 4_096) -> DataFrame:
    """Run-length depth of half-open segments: signed events, summed by position, cumulated in two levels (running()). A position
    where both sums are zero changes nothing and is left out, so a run of one depth is one row across buckets too."""
    f, r = F.col(forward).cast("int"), (~F.col(forward)).cast("int")
    ends = lambda name, sign: F.struct(F.col(name).alias("start"), (sign * f).alias("df"), (sign * r).alias("dr"))
    events = segments.select(*keys, F.explode(F.array(ends(start, 1), ends(end, -1))).alias("e")).select(*keys, "e.*")
    steps = events.groupBy(*keys, "start").agg(F.sum("df").alias("df"), F.sum("dr").alias("dr")).where("df <> 0 OR dr <> 0")
    runs = running(steps, keys, "start", width, sums={"forward_reads": F.col("df"), "reverse_reads": F.col("dr")}, following="end")
    depth = F.col("forward_reads") + F.col("reverse_reads")
    return runs.where(F.col("end").isNotNull() & (depth > 0)).select(*keys, "start", "end", depth.alias("reads"), "forward_reads", "reverse_reads")


def segment_faults(segments: DataFrame, read: Sequence[str], start: str = "seg_start", end: str = "seg_end") -> DataFrame:
    """Segments that are empty, reversed, or overlap an earlier one of the same read."""
    w = _partition(read).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fault = F.when(F.col(start) == F.col(end), "empty").when(F.col(start) > F.col(end), "reversed").when(F.col(start) < reach, "overlapping")
    return segments.withColumn("fault", fault).where("fault IS NOT NULL")


def count_windows(rows: DataFrame, keys: Sequence[str], rank: str, size: int, step: int) -> DataFrame:
    """Each row once for every window of `size` consecutive ranks (from 1) that holds it; windows start every `step` ranks
    and only complete ones stay. Adds `window`."""
    first = F.greatest(F.ceil((F.col(rank) - size) / step), F.lit(0)).cast("long")
    last = F.floor((F.col(rank) - 1) / step).cast("long")
    n = F.count("*").over(_partition(keys))
    whole = F.least(last, F.floor((n - size) / step).cast("long"))
    ranged = rows.withColumn("__first", first).withColumn("__last", whole).where("__first <= __last")
    return ranged.withColumn("window", F.explode(F.sequence("__first", "__last"))).drop("__first", "__last")


def rolling_sum(rows: DataFrame, keys: Sequence[str], order: str, value: str, size: int) -> DataFrame:
    """Sum over this row and the `size - 1` next ones; shorter at the end of a key."""
    w = _partition(keys).orderBy(order).rowsBetween(0, size - 1)
    return rows.withColumn("window_sum", F.sum(value).over(w)).withColumn("window_rows", F.count("*").over(w))


def penalties(calls: DataFrame, keys: Sequence[str], size: int, index: str = "call_index", ploc: str = "ploc", ambiguity: str = "ambiguity") -> DataFrame:
    """Penalty of each call: ambiguous calls of its window plus the floor of half the sum of how far the window's largest and
    smallest spacing are from the read's mean. The window starts size / 2 calls earlier and keeps its width at the left edge."""
    w = _partition(keys).orderBy(index)
    spaced = calls.withColumn("__gap", F.col(ploc) - F.lag(ploc).over(w)).withColumn("__n", F.count("*").over(_partition(keys)))
    spaced = spaced.withColumn("__mean", F.avg("__gap").over(_partition(keys)))
    # the window of a call is a slice of the read: early calls share the first one, so frames of fixed width won't do
    vague = (~X.canonical(F.col(ambiguity))).cast("int")
    ahead = w.rowsBetween(0, size - 1)
    inner = w.rowsBetween(1, size - 1)
    framed = spaced.select("*", F.sum(vague).over(ahead).alias("__vague"), F.max("__gap").over(inner).alias("__max"), F.min("__gap").over(inner).alias("__min"))
    start = F.greatest(F.col(index) - size // 2, F.lit(0))
    at = framed.select(*keys, F.col(index).alias("__start"), "__vague", "__max", "__min")
    joined = framed.drop("__vague", "__max", "__min").withColumn("__start", start).join(at, [*keys, "__start"])
    off = F.coalesce(F.floor((F.abs(F.col("__max") - F.col("__mean")) + F.abs(F.col("__min") - F.col("__mean"))) / 2), F.lit(0))
    return joined.withColumn("penalty", (F.col("__vague") + off).cast("long")).drop("__gap", "__n", "__mean", "__start", "__vague", "__max", "__min")


def best_section(rows: DataFrame, keys: Sequence[str], fraction: float, index: str = "call_index", value: str = "penalty") -> DataFrame:
    """The section of max(1, floor(n * fraction)) rows with the smallest sum, the first of equals: (keys, best_start, best_end, best_sum, n)."""
    n = F.count("*").over(_partition(keys))
    w = _partition(keys).orderBy(index)
    before = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # differences of running sums, since a frame's width can't depend on the row count
    run = rows.select(*keys, index, value, n.alias("n"), F.coalesce(before, F.lit(0)).alias("__before")).withColumn("__size", F.greatest(F.lit(1), F.floor(F.col("n") * fraction)).cast("int"))
    ends = run.select(*keys, (F.col(index) - F.col("__size") + 1).alias("__start"), (F.col("__before") + F.col(value)).alias("__through"))
    both = run.select(*keys, F.col(index).alias("__start"), "__before", "__size", "n").join(ends, [*keys, "__start"])
    best = F.min(F.struct((F.col("__through") - F.col("__before")).alias("s"), F.col("__start").alias("i"), F.col("__size").alias("w"), F.col("n").alias("n")))
    return both.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.i").alias("best_start"), (F.col("b.i") + F.col("b.w")).alias("best_end"), F.col("b.s").alias("best_sum"), F.col("b.n").alias("n"))


def relative_quality(rows: DataFrame, keys: Sequence[str], most: int, value: str = "penalty") -> DataFrame:
    worst = F.max(value).over(_partition(keys))
    score = F.when(worst <= 0, F.lit(most)).otherwise(F.floor(most * F.least(F.greatest(1 - F.col(value) / worst, F.lit(0.0)), F.lit(1.0))))
    return rows.withColumn("relative_quality", score.cast("int"))


def trim(rows: DataFrame, best: DataFrame, keys: Sequence[str], size: int, stringency: float, least: int, index: str = "call_index", value: str = "penalty") -> DataFrame:
    """Trim bounds: from the best section outwards to the first window whose sum exceeds stringency * best average * size."""
    summed = rolling_sum(rows, keys, index, value, size).join(best, list(keys))
    # a decimal factor: 1.2 as a double times 3 lies below 3.6, and a window of just the limit would exceed it
    limit = (F.lit(Decimal(str(stringency))) * F.col("best_sum")).cast("double") / (F.col("best_end") - F.col("best_start")) * size
    high = F.col("window_sum") > limit
    left = F.max(F.when(high & (F.col(index) < F.col("best_start")), F.least(F.col(index) + size, F.col("best_start"))))
    right = F.min(F.when(high & (F.col(index) >= F.col("best_end")), F.col(index)))
    bounds = summed.groupBy(*keys).agg(F.coalesce(left, F.lit(0)).cast("long").alias("trim_start"), F.coalesce(right, F.max("n")).cast("long").alias("trim_end"))
    return bounds.withColumn("retained", (F.col("trim_end") - F.col("trim_start")) >= least)


def baseline_noise(series: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, baseline, noise): the median, and the median absolute deviation of first differences scaled to a standard
    deviation of one sample, at least 1. `series` has one array of values a key in order."""
    def median(a: Column) -> Column:
        s, n = F.array_sort(a), F.size(a)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    v = F.col(value)
    steps = F.transform(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda x, i: (x - F.get(v, i)).cast("double"))
    table = series.withColumn("__steps", steps).withColumn("__mid", median(F.col("__steps")))
    table = table.withColumn("__off", F.transform("__steps", lambda x: F.abs(x - F.col("__mid"))))
    sigma = F.greatest(median(F.col("__off")) / (0.67448975 * 2**0.5), F.lit(1.0))
    return table.select(*keys, median(v).alias("baseline"), F.when(F.size(v) >= 2, sigma).alias("noise"))


def rolling_baseline(series: DataFrame, keys: Sequence[str], order: str, value: str, size: int) -> DataFrame:
    """Framed median of each full window of `size` rows, and the noise of its first differences."""
    w = _partition(keys).orderBy(order)
    ahead = w.rowsBetween(0, size - 1)
    framed = series.select(*keys, order, F.collect_list(value).over(ahead).alias("v")).where(F.size("v") == size)
    return baseline_noise(framed, [*keys, order], "v")
