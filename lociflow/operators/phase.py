"""Phase evidence behind a tract: availability, windows of profile-bearing observations, and candidate offsets.

Rows are observations (keys, distance, base, weights): distance counts from the tract's exit in read order, base is the
reference base there, weights the profile or null. Windows count profile-bearing observations; an offset looks its base up
among all observations, so a gap widens a window without hiding bases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.operators.windows import count_windows, running

SIZE, STEP, OFFSET = 25, 5, 5


def members(observations: DataFrame, keys: Sequence[str], size: int = SIZE, step: int = STEP) -> DataFrame:
    """Profile-bearing observations with a canonical base, once for each complete window that holds them."""
    held = observations.where(F.col("weights").isNotNull() & X.canonical(F.col("base")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("distance"))
    return count_windows(held.withColumn("rank", rank), keys, "rank", size, step)


def windows(held: DataFrame, keys: Sequence[str]) -> DataFrame:
    return held.groupBy(*keys, "window").agg(
        F.min("distance").alias("first_distance"), F.max("distance").alias("last_distance"), F.count("*").alias("observations"),
        F.avg(X.max_impurity(F.col("weights"))).alias("mean_impurity"), F.avg(X.mass(F.col("weights"), F.col("base"))).alias("mean_zero_mass"),
    )


def _informs() -> tuple[Column, list[tuple[str, Column]]]:
    """Whether a shifted observation informs, and its masses."""
    informs = X.canonical(F.col("shifted_base")) & (F.col("shifted_base") != F.col("base"))
    zero, moved = X.mass(F.col("weights"), F.col("base")), X.mass(F.col("weights"), F.col("shifted_base"))
    return informs, [("mean_zero", zero), ("mean_shifted", moved), ("mean_residual", F.greatest(F.lit(0.0), 1 - zero - moved))]


def candidates(held: DataFrame, observations: DataFrame, keys: Sequence[str], most: int = OFFSET) -> DataFrame:
    """Each window at each offset. An observation informs if the base there is known, canonical and another one; means are over
    those, null without any.

    What lies around an observation is gathered in one window over the read, before it is dealt to its windows and offsets. So what
    is shuffled are a few rows an observation; the rows of its windows and offsets are made and summed where they are."""
    offsets = [o for o in range(-most, most + 1) if o]
    once = held.groupBy(*keys, "distance", "base", "weights").agg(F.collect_list("window").alias("__windows"))
    both = once.unionByName(observations.select(*keys, "distance", F.struct("distance", "base").alias("__seen")), allowMissingColumns=True)
    around = Window.partitionBy(*keys).orderBy("distance").rangeBetween(-most, most)
    once = both.withColumn("__near", F.collect_list("__seen").over(around)).where("__windows IS NOT NULL")
    # one entry for each observation at the offset, or an empty one
    there = lambda o: F.filter("__near", lambda x: x["distance"] == F.col("distance") + o)
    entry = lambda o, base: F.struct(F.lit(o).alias("offset"), base.alias("shifted_base"))

    def at(o: int) -> Column:
        found, none = F.transform(there(o), lambda x: entry(o, x["base"])), F.array(entry(o, F.lit(None).cast("string")))
        return F.when(F.size(found) > 0, found).otherwise(none)

    each = F.flatten(F.array(*[at(o) for o in offsets]))
    both = once.select(*keys, "__windows", "base", "weights", F.explode(each).alias("x")).select(*keys, "__windows", "base", "weights", "x.*")
    informs, masses = _informs()
    both = both.select(*keys, F.explode("__windows").alias("window"), "offset", informs.alias("__informs"), *[F.when(informs, x).alias(f"__{n}") for n, x in masses])
    return both.groupBy(*keys, "window", "offset").agg(F.count_if("__informs").alias("informative"), *[F.avg(f"__{n}").alias(n) for n, _ in masses])


def availability(tract_calls: DataFrame, after: DataFrame, keys: Sequence[str], tract_length: int, size: int = SIZE) -> DataFrame:
    """The first reason why a read has no windows at a tract, or measured. `tract_calls` are its columns inside the tract
    (position, call_index), `after` its observations behind it."""
    inside = tract_calls.groupBy(*keys).agg(F.count_distinct("position").alias("covered"), F.count("call_index").alias("called"))
    behind = after.groupBy(*keys).agg(F.count_if(F.col("weights").isNotNull() & X.canonical(F.col("base"))).alias("profiled"))
    rows = inside.join(behind, list(keys), "full_outer").fillna(0, ["covered", "called", "profiled"])
    status = F.when(F.col("covered") == 0, "no_tract_coverage").when(F.col("covered") < tract_length, "incomplete_tract_coverage").when(F.col("called") == 0, "no_call_backed_tract_span").when(F.col("profiled") < size, "no_complete_profile_window").otherwise("measured")
    return rows.withColumn("status", status)


def after_tract(observations: DataFrame, keys: Sequence[str], first: int, last: int, length: int) -> DataFrame:
    """(keys, distance, base, call_index, weights) of what a read shows behind a tract (positions first..last of a circle):
    called later than the tract's last call, outside the tract, at a distance from its exit in read order. `observations` has
    (keys, reverse, position, base, call_index, weights). A read without a call in the tract has none."""
    inside = F.col("position").between(first, last)
    latest = F.max(F.when(inside, F.col("call_index"))).over(Window.partitionBy(*keys))
    leaves = F.when(F.col("reverse"), F.lit(first)).otherwise(F.lit(last))
    distance = X.oriented_distance(F.col("position"), leaves, F.col("reverse"), length)
    behind = observations.withColumn("__latest", latest).withColumn("distance", distance).where((F.col("call_index") > F.col("__latest")) & ~inside & (F.col("distance") > 0))
    return behind.select(*keys, "distance", "base", "call_index", "weights")


def distance_faults(after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distances that a read shows more than once behind a tract."""
    return after.groupBy(*keys, "distance").agg(F.count("*").alias("n")).where("n > 1").select(*keys, "distance")


def sensitivity(observations: DataFrame, keys: Sequence[str], sizes: Sequence[int], steps: Sequence[int], offsets: Sequence[int], width: int = 4_096) -> DataFrame:
    """The full grid of parameters. Observations are ranked once and meet their neighbours once, at the widest offset; their masses
    are summed along the ranks, and a window of any size and step is the difference of two sums. So a grid point costs a row
    a window and offset, not one a member."""
    held = observations.where(F.col("weights").isNotNull() & X.canonical(F.col("base")))
    held = held.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("distance")))
    shifted = held.withColumn("offset", F.explode(F.lit([o for o in range(-max(offsets), max(offsets) + 1) if o]))).withColumn("__at", F.col("distance") + F.col("offset"))
    both = shifted.join(observations.select(*keys, F.col("distance").alias("__at"), F.col("base").alias("shifted_base")), [*keys, "__at"], "left")
    informs, masses = _informs()
    names = [n for n, _ in masses]
    flat = both.select(*keys, "offset", "rank", F.coalesce(informs, F.lit(False)).cast("long").alias("informative"), *[F.coalesce(F.when(informs, x), F.lit(0.0)).alias(n) for n, x in masses])
    summed = running(flat.withColumnsRenamed({n: f"__{n}" for n in ("informative", *names)}), [*keys, "offset"], "rank", width, sums={n: F.col(f"__{n}") for n in ("informative", *names)})
    summed = summed.select(*keys, "offset", "rank", F.struct("informative", *names).alias("s"))
    grid = F.array(*[F.struct(F.lit(a).alias("size"), F.lit(b).alias("step")) for a in sizes for b in steps])
    cells = held.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("g", F.explode(grid)).select(*keys, "n", "g.*").where("n >= size")
    cells = cells.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - F.col("size")) / F.col("step")))))
    cells = cells.select(*keys, "size", "step", "window", (F.col("window") * F.col("step")).alias("__before"), (F.col("window") * F.col("step") + F.col("size")).alias("__last"))
    upto = summed.select(*keys, "offset", F.col("rank").alias("__last"), F.col("s").alias("__b"))
    before = summed.select(*keys, "offset", F.col("rank").alias("__before"), F.col("s").alias("__a"))
    met = cells.join(upto, [*keys, "__last"]).join(before, [*keys, "offset", "__before"], "left")
    part = lambda n: F.col(f"__b.{n}") - F.coalesce(F.col(f"__a.{n}"), F.lit(0))
    out = met.withColumn("informative", part("informative"))
    out = out.select(*keys, "size", "step", "window", "offset", "informative", *[F.when(F.col("informative") > 0, F.greatest(F.lit(0.0), part(n) / F.col("informative"))).alias(n) for n in names])
    return out.withColumn("most", F.explode(F.lit(list(offsets)))).where(F.abs("offset") <= F.col("most"))


def persistence(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each candidate beside the next window's at the same offset, with absolute changes (null where either is)."""
    w = Window.partitionBy(*keys, "offset").orderBy("window")
    out = found
    for name in ("mean_zero", "mean_shifted", "mean_residual"):
        out = out.withColumn(f"{name}_change", F.abs(F.lead(name).over(w) - F.col(name)))
    return out.withColumn("next_window", F.lead("window").over(w)).where("next_window IS NOT NULL")


def trajectory(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Candidates of all windows by offset, and by `keys` if there are any: windows, informative observations, mean masses."""
    means = [F.avg(n).alias(n) for n in ("mean_zero", "mean_shifted", "mean_residual")]
    return found.groupBy(*keys, "offset").agg(F.count("*").alias("windows"), F.sum("informative").alias("informative"), *means)


def envelope(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range of each window's candidates, and the greatest share of shifted in shifted and residual mass."""
    share = X.ratio(F.col("mean_shifted"), F.nullif(F.col("mean_shifted") + F.col("mean_residual"), F.lit(0.0)))
    ranged = [e for n in ("mean_shifted", "mean_residual") for e in (F.min(n).alias(f"{n}_min"), F.max(n).alias(f"{n}_max"), (F.max(n) - F.min(n)).alias(f"{n}_range"))]
    return found.groupBy(*keys, "window").agg(*ranged, F.max(share).alias("shifted_share_max"))
