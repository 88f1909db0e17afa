"""Exact nearest-rank quantiles of groups of any size.

`percentile_disc` holds all values of a group in one task. Groups of more than a limit are selected instead: a histogram of the
range that holds a rank tells the bin of it, that bin is the next range, and so on until the range is one value. Each round is
an aggregate with partial sums, and reads only rows of the ranges that are left.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.operators.held import held

#: Rows of a group that one task may sort, bins of a histogram, and ranges or names of groups that are sent to every task.
HOT_ROWS, BINS, SENT = 1_000_000, 1_024, 100_000


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys], F.lit(True))


def _marked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.withColumnsRenamed({k: f"__{k}" for k in keys})


def _sent(small: DataFrame, n: int) -> DataFrame:
    """A side of a join with the rows of large groups: sent to every task if it is small, since a join by group would bring a whole
    group to one task."""
    return F.broadcast(small) if n <= SENT else small


def select_ranks(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """(keys, one column for each share): the value of rank max(1, ceil(share * n)) among a group's n values. Nulls are left out;
    NaN is the largest value, as in an order by it. A group without values has no row."""
    rows = rows.select(*keys, F.col(value).alias("__v")).where("__v IS NOT NULL")
    real = F.col("__v").cast("double")
    finite = ~F.isnan(real) & (F.abs(real) < float("inf"))
    ends = lambda c: (F.min(F.when(c, F.col("__v"))).alias("__low"), F.max(F.when(c, F.col("__v"))).alias("__high"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in shares.items()])).alias("__s")
    state = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *ends(finite)).select("*", wanted)
    state = state.select(*keys, F.col("__s.name").alias("__name"), F.greatest(F.lit(1), F.ceil(F.col("__s.p") * F.col("__n"))).alias("__rank"), "__low", "__high", F.lit(True).alias("__open"), F.lit(True).alias("__whole"))
    state = held(state)
    while n_open := state.where("__open").count():
        ranges = _sent(_marked(state.where("__open"), keys), n_open)
        some = rows.join(ranges, _same(rows, ranges, keys) & (F.col("__whole") | F.col("__v").between(F.col("__low"), F.col("__high"))))
        low, high = F.col("__low").cast("double") / 2, F.col("__high").cast("double") / 2
        place = F.floor((real / 2 - low) / (high - low) * bins)
        place = F.when(high > low, place).otherwise((F.col("__v") > F.col("__low")).cast("long"))  # values that one double stands for
        place = F.when(F.isnan(real), bins + 2).when(real == float("inf"), bins + 1).when(real == float("-inf"), -1).otherwise(F.coalesce(place, F.lit(0)))
        bars = some.groupBy(*keys, "__name", "__rank", place.alias("__bin")).agg(F.count("*").alias("__c"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        upto = bars.withColumn("__to", F.sum("__c").over(Window.partitionBy(*keys, "__name").orderBy("__bin")))
        hit = upto.where("__to >= __rank AND __to - __c < __rank")
        now = hit.select(*keys, "__name", (F.col("__rank") - F.col("__to") + F.col("__c")).alias("__rank"), "__low", "__high", (F.col("__low") < F.col("__high")).alias("__open"), F.lit(False).alias("__whole"))
        state = held(state.where("NOT __open").unionByName(now))
    return state.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, F.col("__low"))).alias(n) for n in shares])


def grouped_ranks(rows: DataFrame, keys: Sequence[str], plain: Sequence[Column], ranks: dict[str, tuple[str, float]], limit: int = HOT_ROWS) -> DataFrame:
    """Aggregates of each group beside nearest ranks, name -> (column, share). No group of more than `limit` rows is one task's;
    either way gives the same value."""
    at_once = lambda some: some.groupBy(*keys).agg(*plain, *[X.nearest_rank(c, p).alias(n) for n, (c, p) in ranks.items()])
    hot = held(rows.groupBy(*keys).agg(F.count("*").alias("__m")).where(F.col("__m") > limit).drop("__m"))
    if not (n_hot := hot.count()):
        return at_once(rows)
    names = _sent(_marked(hot, keys), n_hot)
    few, many = (rows.join(names, _same(rows, names, keys), how) for how in ("left_anti", "left_semi"))
    out = many.groupBy(*keys).agg(*plain)
    for column in dict.fromkeys(c for c, _ in ranks.values()):
        found = _marked(select_ranks(many, keys, column, {n: p for n, (c, p) in ranks.items() if c == column}), keys)
        out = out.join(found, _same(out, found, keys), "left").drop(*[f"__{k}" for k in keys])
    return at_once(few).unionByName(out)
