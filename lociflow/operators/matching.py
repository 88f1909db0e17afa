"""Reviewed events against called ones: exact, equal one by one, equal as runs of neighbouring events.

An event (position, reference, alternate) replaces bases of the reference. Two events may be written otherwise and still spell
the same sequence: `81 AA>A` and `82 AA>A` both take one A out of a row of them. No sequence is spelled to find that out:

* a single event has a normal form: common ends are trimmed and an insertion or deletion is rolled to the right as far as the
  reference repeats it. Events are equal if their forms are, so an equi-join finds them;
* a run of neighbouring events has a polynomial hash that follows from prefix sums over the reference and over the events, so
  any run's hash costs the same. What the hashes find is spelled once and compared.

Events have their place `at` among the events of their side in a sample, counted from 0 in the order of their positions.
A null or wrong reference allele, or a position outside, gives an event no form and no run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lociflow.functions import expressions as X
from lociflow.operators.held import held
from lociflow.operators.held import task_count as proportional
from lociflow.sources.shipping import ship

#: Bases of a reference at most; it is sent to every worker.
MAX_REFERENCE = 50_000
PRIMES, POINTS = (2**31 - 1, 2**31 - 19), (1_178_406_263, 934_507_021)
#: Candidates that are compared with all others at a time.
BLOCK = 256
#: Samples are worked on together until the squares of their events, which bound their runs, come to so many.
RUNS = 262_144
#: Events of both sides that a task holds, about.
HELD_EVENTS = 250_000


class Repeats:
    """A reference and how far it repeats itself at each distance that is asked for; a circle goes on at its start."""

    def __init__(self, bases: str, circular: bool = False) -> None:
        if len(bases) > MAX_REFERENCE:
            raise ValueError(f"{len(bases)} bases; at most {MAX_REFERENCE}")
        self.bases, self.circular = bases, circular
        self.codes = np.frombuffer(bases.encode("latin-1"), np.uint8)
        self._runs: dict[int, np.ndarray] = {}

    def part(self, start: int, length: int) -> str:
        n = len(self.bases)
        if not self.circular or start + length <= n:
            return self.bases[start : start + length]
        return "".join(self.bases[(start + i) % n] for i in range(length))

    def run(self, lag: int, start: int) -> int:
        """How many bases from `start` on equal the base `lag` further; on a circle less than its length."""
        n = len(self.bases)
        if lag not in self._runs:
            if self.circular:
                same = np.tile(self.codes == np.roll(self.codes, -lag % n), 2)
            else:
                same = np.append(self.codes[:-lag] == self.codes[lag:], np.zeros(min(lag, n), bool)) if lag < n else np.zeros(n, bool)
            place = np.where(same, len(same), np.arange(len(same)))
            ends = np.minimum.accumulate(place[::-1])[::-1] - np.arange(len(same))
            self._runs[lag] = np.minimum(ends[:n], n - 1)
        return int(self._runs[lag][start]) if start < n else 0

    def form(self, position: int, known: str, alternate: str) -> tuple[int, str, str] | None:
        """(first base replaced from 0, bases removed, bases added); None if the event does not fit the reference."""
        n, start = len(self.bases), position - 1
        if not known or not 0 <= start < n or len(known) > n or self.part(start, len(known)) != known:
            return None
        if known == alternate:
            return 0, "", ""
        if len(known) == len(alternate) == 1:
            return start, known, alternate
        i = 0
        while i < min(len(known), len(alternate)) and known[i] == alternate[i]:
            i += 1
        known, alternate, start = known[i:], alternate[i:], start + i
        while known and alternate and known[-1] == alternate[-1]:
            known, alternate = known[:-1], alternate[:-1]
        if self.circular:
            start %= n
        if known and not alternate:
            by = self.run(len(known), start)
            return self._at(start + by), self.part(self._at(start + by), len(known)), ""
        if alternate and not known:
            size, by = len(alternate), 0
            ahead = self.part(start, size)
            while by < len(ahead) and ahead[by] == alternate[by]:
                by += 1
            if by == size:
                by += self.run(size, start)
            rolled = alternate[by:] + self.part(start, by) if by <= size else self.part(self._at(start + by - size), size)
            return self._at(start + by), "", rolled
        return start, known, alternate

    def _at(self, start: int) -> int:
        return start % len(self.bases) if self.circular else start


def with_form(events: DataFrame, reference: str, circular: bool = False, position: str = "position", known: str = "reference", alternate: str = "alternate") -> DataFrame:
    """Add `form` (first, removed, added), equal for events that spell the same sequence; null if an event does not fit."""
    ship(events.sparkSession)
    repeats = Repeats(reference, circular)

    @F.pandas_udf("first int, removed string, added string")
    def forms(at: pd.Series, old: pd.Series, new: pd.Series) -> pd.DataFrame:
        found = [repeats.form(int(p), a, b) if a is not None and b is not None and p == p else None for p, a, b in zip(at, old, new, strict=True)]
        return pd.DataFrame([f or (None, None, None) for f in found], columns=["first", "removed", "added"]).astype({"first": "Int32"})

    told = events.withColumn("__form", forms(F.col(position).cast("double"), F.col(known), F.col(alternate)))
    return told.withColumn("form", F.when(F.col("__form.first").isNotNull(), F.col("__form"))).drop("__form")


def task_count(*events: DataFrame) -> int:
    return proportional(HELD_EVENTS, *events)


def paired(truth: DataFrame, called: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """(sample, truth, called): one-to-one pairs of `at` that agree in all keys. Several of one key meet in their order, without
    all pairs of them; an event that several rows name (one for each alternate) takes the first it meets. Both sides meet in one
    shuffle by their keys, and the pairs in one by sample."""
    by = ["sample", *keys]
    side = lambda rows, name: rows.select(*by, "at", F.lit(name).alias("__side")).dropna(subset=by)
    both = side(truth, "truth").unionByName(side(called, "called")).repartition(tasks, *by)
    both = both.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__side").orderBy("at")))
    of = lambda name: F.col("__side") == name
    met = both.groupBy(*by, "__n").agg(F.max(F.when(of("truth"), F.col("at"))).alias("truth"), F.max(F.when(of("called"), F.col("at"))).alias("called"), F.count("*").alias("__both"))
    met = met.where("__both = 2").select("sample", "truth", "called").repartition(tasks, "sample")
    return met.groupBy("sample", "truth").agg(F.min("called").alias("called")).groupBy("sample", "called").agg(F.min("truth").alias("truth")).select("sample", "truth", "called")


def without(events: DataFrame, places: DataFrame, tasks: int) -> DataFrame:
    """Events whose place (sample, at) is not among those given."""
    dealt = lambda rows: rows.repartition(tasks, "sample", "at")
    return dealt(events).join(dealt(places), ["sample", "at"], "left_anti")


class Side:
    """Events of one side in the order of their samples and places, and the hashes of their runs, which stay within a sample.
    `samples` numbers the sample of each row; without it all are of one."""

    def __init__(self, rows: list[tuple[int, int, str, str]], reference: str, sums: np.ndarray, samples: Sequence[int] | None = None) -> None:
        told = zip(samples if samples is not None else repeat(0), rows, strict=samples is not None)
        self.rows = sorted((s, *r) for s, r in told if r[2] and 0 < r[1] and reference[r[1] - 1 : r[1] - 1 + len(r[2])] == r[2])
        self.reference, self.sums = reference, sums
        self.sample, self.at, position = (np.array([r[k] for r in self.rows], np.int64) for k in range(3))
        self.start = position - 1
        self.end = self.start + np.array([len(r[3]) for r in self.rows], np.int64)
        self.put = np.array([len(r[4]) for r in self.rows], np.int64)
        self.starts, self.ends = self.start.tolist(), self.end.tolist()

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, behind the last) for each event: of the maximal row of events of its sample, with places one after the other
        that do not overlap, in which it is."""
        cut = np.flatnonzero((np.diff(self.sample) != 0) | (np.diff(self.at) != 1) | (self.start[1:] < self.end[:-1])) + 1
        edges = np.concatenate([[0], cut, [len(self.at)]])
        return tuple(np.repeat(x, np.diff(edges)) for x in (edges[:-1], edges[1:]))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first, last) of every run, by index of the event.

        With c the bases gained before an event, a run from i to j spells sum(base * x ** place) = S(start i) + x ** -c(i) * (T(j) -
        T(i) + U(j)): S are the reference's prefix sums, T those of each event and the reference up to the next, U the last
        event and the rest of the reference."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, behind = self.stretches()
        index = np.arange(len(self.at))
        i = np.repeat(index, behind - index)
        j = i + _within(behind - index)
        total = np.append(0, np.cumsum(self.put - (self.end - self.start)))
        before, after = total[:-1] - total[first], total[1:] - total[first]
        codes = np.frombuffer("".join(r[4] for r in self.rows).encode("latin-1"), np.uint8).astype(np.int64)
        place, edge = _within(self.put), np.append(0, np.cumsum(self.put))
        following = np.append(self.start[1:], self.end[-1:])  # of the last of a stretch no run reads it
        hashed = np.zeros(len(i), np.uint64)
        for s, p, x in zip(self.sums, PRIMES, POINTS, strict=True):
            spelt = np.append(0, np.cumsum(codes * _powers(x, place, p) % p))
            new = _powers(x, self.start, p) * ((spelt[edge[1:]] - spelt[edge[:-1]]) % p) % p
            event, power = _powers(x, before, p) * new % p, _powers(x, after, p)
            rest = (event + power * ((s[-1] - s[self.end]) % p)) % p
            to_next = power * ((s[following] - s[self.end]) % p) % p
            sums = np.append(0, np.cumsum((event + to_next) % p))
            value = (s[self.start][i] + _powers(x, -before, p)[i] * ((sums[j] - sums[i] + rest[j]) % p)) % p
            hashed = hashed << np.uint64(31) | value.astype(np.uint64)
        return hashed, i, j

    def spelled(self, first: int, last: int, low: int, high: int) -> str:
        """The bases from low to high, which hold the run's, with the run in them."""
        out, at = [], low
        for k in range(first, last + 1):
            out += [self.reference[at : self.starts[k]], self.rows[k][4]]
            at = self.ends[k]
        return "".join([*out, self.reference[at:high]])

    def places(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, values) of the places of the events from first to last, a list for each."""
        n = last - first + 1
        return np.append(0, np.cumsum(n)), self.at[np.repeat(first, n) + _within(n)]


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1 ... of each length, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _powers(x: int, exponents: np.ndarray, p: int) -> np.ndarray:
    some, which = np.unique(exponents, return_inverse=True)
    return np.array([pow(x, e, p) for e in some.tolist()], np.int64)[which]


def prefix_sums(reference: str) -> np.ndarray:
    """For each prime: sums of base * x ** place over the first 0, 1 ... bases."""
    codes, out = reference.encode("latin-1"), []
    for p, x in zip(PRIMES, POINTS, strict=True):
        total, power, row = 0, 1, [0]
        for c in codes:
            total, power = (total + c * power) % p, power * x % p
            row.append(total)
        out.append(row)
    return np.array(out, np.int64)


def _first_of_each(pairs: np.ndarray, fixed: tuple[int, int], free: tuple[int, int], sign: int) -> np.ndarray:
    """Of the pairs with the same fixed ends, those whose free ends no other undercuts on both sides."""
    order = np.lexsort((sign * pairs[:, free[1]], sign * pairs[:, free[0]], pairs[:, fixed[1]], pairs[:, fixed[0]]))
    pairs = pairs[order]
    same = (np.diff(pairs[:, fixed[0]]) == 0) & (np.diff(pairs[:, fixed[1]]) == 0)
    group = np.append(0, np.cumsum(~same))
    value = sign * pairs[:, free[1]]
    wide = int(np.ptp(value)) + 2 if len(value) else 1
    least = np.minimum.accumulate(value - group * wide)  # a new group lies below all before it
    return pairs[np.append(True, ~same | (value[1:] - group[1:] * wide < least[:-1]))[: len(pairs)]]


def least_pairs(pairs: np.ndarray) -> np.ndarray:
    """Rows (truth first, truth last, called first, called last) within which no other row lies."""
    pairs = np.unique(pairs, axis=0)
    if not len(pairs):
        return pairs
    pairs = _first_of_each(_first_of_each(pairs, (0, 2), (1, 3), 1), (1, 3), (0, 2), -1)
    # what lies within a pair begins where its truth does or behind, and not behind its end
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    low, high = np.searchsorted(pairs[:, 0], pairs[:, 0]), np.searchsorted(pairs[:, 0], pairs[:, 1], side="right")
    held = []
    for at in range(0, len(pairs), BLOCK):
        p, others = pairs[at : at + BLOCK, None, :], pairs[None, low[at] : high[at : at + BLOCK].max(), :]
        within = (others[..., 0] >= p[..., 0]) & (others[..., 1] <= p[..., 1]) & (others[..., 2] >= p[..., 2]) & (others[..., 3] <= p[..., 3])
        held.append(within.sum(axis=1) == 1)  # itself
    return pairs[np.concatenate(held)]


def _alone(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which runs share none of their events, of n, with another."""
    uses = np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1))
    shared = np.append(0, np.cumsum(uses > 1))
    return shared[last + 1] == shared[first]


def _equal_runs(truth: Side, called: Side) -> np.ndarray:
    """Rows (truth first, truth last, called first, called last) of equal_runs(), by index of the event, in their order."""
    th, ti, tj = truth.runs()
    ch, ci, cj = called.runs()
    # a number for each hash of a sample, in place of the two
    key, of = np.concatenate([th, ch]), np.concatenate([truth.sample[ti], called.sample[ci]])
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    number = np.zeros(len(order), np.int64)
    number[order[1:]] = np.cumsum((key[1:] != key[:-1]) | (of[1:] != of[:-1]))
    th, ch = number[: len(th)], number[len(th) :]
    order = np.argsort(th, kind="stable")
    first = np.searchsorted(th[order], ch)
    n = np.searchsorted(th[order], ch, side="right") - first
    row = np.repeat(np.arange(len(ch)), n)
    other = order[_within(n) + np.repeat(first, n)]
    pairs = np.stack([ti[other], tj[other], ci[row], cj[row]], axis=1)
    pairs = least_pairs(pairs[(pairs[:, 0] < pairs[:, 1]) | (pairs[:, 2] < pairs[:, 3])])

    def same(a: int, b: int, c: int, d: int) -> bool:
        low, high = min(truth.starts[a], called.starts[c]), max(truth.ends[b], called.ends[d])
        return truth.spelled(a, b, low, high) == called.spelled(c, d, low, high)

    pairs = pairs[np.array([same(*x) for x in pairs.tolist()], bool)]
    pairs = pairs[_alone(pairs[:, 0], pairs[:, 1], len(truth.at)) & _alone(pairs[:, 2], pairs[:, 3], len(called.at))]
    return pairs[np.lexsort(pairs.T[::-1])]


def equal_runs(truth: Side, called: Side) -> list[tuple[list[int], list[int]]]:
    """Places of the events of each pair of runs of a sample that spell the same sequence, unlike one event against one; a pair
    has no other within it, and none of its events is in another."""
    return [(truth.at[a : b + 1].tolist(), called.at[c : d + 1].tolist()) for a, b, c, d in _equal_runs(truth, called).tolist()]


def run_pairs(events: DataFrame, reference: str, tasks: int | None = None) -> DataFrame:
    """(sample, group, truth, called): arrays of places of equal_runs(), numbered from 1, among the events (sample, side, at, position, reference,
    alternate) that nothing else has matched. Only samples with both sides are sent; one sample's such events fit a
    worker, whose work grows with the square of the longest unbroken stretch of them. Small samples are worked on together."""
    ship(events.sparkSession)
    if len(reference) > MAX_REFERENCE:
        raise ValueError(f"{len(reference)} bases; at most {MAX_REFERENCE}")
    n = lambda side: F.count_if(F.col("side") == side).over(Window.partitionBy("sample"))
    kind = events.schema["sample"].dataType.simpleString()
    columns = ["sample", "side", "at", "position", "reference", "alternate"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = prefix_sums(reference)

        def told(names: list, rows: dict[str, list], of: dict[str, list]) -> pa.RecordBatch:
            sides = [Side(rows[x], reference, sums, of[x]) for x in rows]
            pairs = _equal_runs(*sides)
            sample = sides[0].sample[pairs[:, 0]]
            group = np.arange(len(pairs)) - np.searchsorted(sample, sample) + 1
            lists = [side.places(pairs[:, k], pairs[:, k + 1]) for side, k in zip(sides, (0, 2), strict=True)]
            small = lambda x: pa.array(x).cast(pa.int32())
            held = [pa.array([names[k] for k in sample.tolist()], schema.field("sample").type), small(group), *(pa.ListArray.from_arrays(small(x), small(y)) for x, y in lists)]
            return pa.RecordBatch.from_arrays(held, schema=schema)

        names, rows, of, runs = [], {"truth": [], "called": []}, {"truth": [], "called": []}, 0
        read = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for sample, group in groupby(read, key=itemgetter(0)):
            held = {side: len(x) for side, x in rows.items()}
            for r in group:
                rows[r[1]].append(r[2:])
            for side, x in rows.items():
                more = len(x) - held[side]
                of[side] += [len(names)] * more
                runs += more * more
            names.append(sample)
            if runs >= RUNS:
                yield told(names, rows, of)
                names, rows, of, runs = [], {"truth": [], "called": []}, {"truth": [], "called": []}, 0
        if names:
            yield told(names, rows, of)

    out = f"sample {kind}, group int, truth array<int>, called array<int>"
    schema = to_arrow_schema(StructType.fromDDL(out))
    # a stated number of tasks: the rows are few and the work is not, so they must not be drawn together
    tasks = tasks or max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), task_count(events))
    told = events.select(*columns).where("sample IS NOT NULL").repartition(tasks, "sample").withColumns({"t": n("truth"), "c": n("called")}).where("t > 0 AND c > 0 AND t + c > 2")
    whole = told.where("at IS NOT NULL AND position IS NOT NULL AND alternate IS NOT NULL").select(*columns)
    return whole.sortWithinPartitions("sample").mapInArrow(found, out)


def run_events(events: DataFrame, reference: str) -> DataFrame:
    """The events of run_pairs(), a row each, with the number of their pair in the sample."""
    pairs = run_pairs(events, reference)
    # both sides of a pair from one row of it, so that the pairs are found once
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).alias("places"))
    placed = pairs.select("sample", "group", F.explode(F.array(side("truth"), side("called"))).alias("x")).select("sample", "group", "x.side", F.explode("x.places").alias("at"))
    return placed.join(events, ["sample", "side", "at"]).select("sample", "group", "side", "at", "position", "reference", "alternate")


def compare(truth: DataFrame, called: DataFrame, reference: str, circular: bool = False) -> DataFrame:
    """(sample, status, truth, called) of events (sample, at, kind, position, reference, alternates) and (sample, at, kind, position,
    reference, alternate): `exact`, `equivalent` (one event each), `group` (runs), `missing` and `extra`, with the places of
    both sides. An event with several alternates allows any of them, and is in no run. Each step's pairs are held, since all
    later ones read them."""
    each = truth.withColumn("alternate", F.explode("alternates"))
    tasks = task_count(truth, called)
    exact = held(paired(each, called, ["kind", "position", "reference", "alternate"], tasks))
    places = lambda pairs, side: pairs.select("sample", F.col(side).alias("at"))
    rest_t, rest_c = without(each, places(exact, "truth"), tasks), without(called, places(exact, "called"), tasks)
    form = ["form.first", "form.removed", "form.added"]
    flat = lambda rows: with_form(rows, reference, circular).where("form IS NOT NULL").select("sample", "at", *form)
    equal = held(paired(flat(rest_t), flat(rest_c), ["first", "removed", "added"], tasks))
    pairs = exact.unionByName(equal)
    columns = ["sample", "at", "position", "reference", "alternate"]
    rest = lambda rows, side: without(rows, places(pairs, side), tasks).select(*columns, F.lit(side).alias("side"))
    runs = held(run_pairs(rest(each.where(F.size("alternates") == 1), "truth").unionByName(rest(called, "called")), reference, tasks))
    single_pairs = lambda pairs, status: pairs.select("sample", F.lit(status).alias("status"), F.array(F.col("truth").cast("int")).alias("truth"), F.array(F.col("called").cast("int")).alias("called"))
    met = single_pairs(exact, "exact").unionByName(single_pairs(equal, "equivalent")).unionByName(runs.select("sample", F.lit("group").alias("status"), "truth", "called"))
    none = F.array().cast("array<int>")
    # the places of pairs are columns already; only those of runs are made of arrays
    seen = lambda side: places(pairs, side).unionByName(runs.select("sample", F.explode(side).alias("at")))
    left = lambda rows, side: without(rows.select("sample", "at"), seen(side), tasks)
    missing = left(truth, "truth").select("sample", F.lit("missing").alias("status"), F.array(F.col("at").cast("int")).alias("truth"), none.alias("called"))
    extra = left(called, "called").select("sample", F.lit("extra").alias("status"), none.alias("truth"), F.array(F.col("at").cast("int")).alias("called"))
    return met.unionByName(missing).unionByName(extra)


def held_matches(truth: DataFrame, called: DataFrame, reference: str, circular: bool = False) -> DataFrame:
    """compare(), computed once for what reads it several times."""
    return held(compare(truth, called, reference, circular))


def event_text(kind: Column, position: Column, known: Column, alternates: Column) -> Column:
    """`SNV:73:A>C,G`; alternates is an array."""
    return F.concat(kind, F.lit(":"), position.cast("string"), F.lit(":"), known, F.lit(">"), F.array_join(F.array_sort(alternates), ","))


def difference_rows(matches: DataFrame, truth: DataFrame, called: DataFrame) -> DataFrame:
    """A row for each match that is not exact: what differs (missing, extra, representation), and the positions, events and tokens
    of both sides as text. `truth` may have `tokens`, an array for each event. `matches` is read several times: write it."""
    odd = matches.where("status <> 'exact'")
    key = F.struct("sample", "status", "truth", "called")

    def told(side: str, events: DataFrame) -> DataFrame:
        rows = odd.select(key.alias("match"), "sample", F.explode(side).alias("at")).join(events, ["sample", "at"])
        listed = F.array_sort(F.collect_list(F.struct("at", "position", "text", "tokens")))
        listing = rows.groupBy("match").agg(listed.alias("x"))
        join = lambda name, by: F.array_join(F.transform("x", lambda e: e[name].cast("string")), by)
        positions = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("x", lambda e: e.position))), lambda p: p.cast("string")), ";")
        return listing.select("match", positions.alias(f"{side}_positions"), join("text", "|").alias(f"{side}_events"), join("tokens", "|").alias(f"{side}_tokens"), F.size("x").alias(f"{side}_count"))

    tokens = F.array_join("tokens", ";") if "tokens" in truth.columns else F.lit("")
    t = truth.select("sample", F.col("at").cast("int").alias("at"), "position", event_text(F.col("kind"), F.col("position"), F.col("reference"), F.col("alternates")).alias("text"), tokens.alias("tokens"))
    c = called.select("sample", F.col("at").cast("int").alias("at"), "position", event_text(F.col("kind"), F.col("position"), F.col("reference"), F.array("alternate")).alias("text"), F.lit("").alias("tokens"))
    both = told("truth", t).join(told("called", c).drop("called_tokens"), "match", "full_outer")
    difference = F.when(F.col("match.status").isin("missing", "extra"), F.col("match.status")).otherwise("representation")
    text = lambda name: F.coalesce(name, F.lit("")).alias(name)
    number = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return both.select("match.sample", difference.alias("difference"), text("truth_tokens"), text("truth_positions"), text("truth_events"), text("called_positions"), text("called_events"), number("truth_count"), number("called_count"))


def profile_counts(matches: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Events and groups of each sample: a group is a match, or an event without one; what a match joins counts once."""
    is_met = F.col("status").isin("exact", "equivalent", "group")
    other = F.col("status").isin("equivalent", "group")
    n = lambda side: F.sum(F.size(side)).alias(f"{side}_events")
    joined = lambda side: F.coalesce(F.sum(F.when(other, F.size(side) - 1)), F.lit(0)).alias(f"collapsed_{side}_events")
    out = matches.groupBy(*keys).agg(n("truth"), n("called"), F.count_if(is_met).alias("matched_groups"), F.count_if(other).alias("representation_groups"), joined("truth"), joined("called"), F.count_if(F.col("status") == "missing").alias("missing_groups"), F.count_if(F.col("status") == "extra").alias("extra_groups"))
    exact = (F.col("missing_groups") == 0) & (F.col("extra_groups") == 0) & (F.col("representation_groups") == 0)
    hits = F.col("matched_groups")
    return out.select("*", exact.alias("exact_profile"), X.ratio(hits, hits + F.col("extra_groups")).alias("precision"), X.ratio(hits, hits + F.col("missing_groups")).alias("recall"))
