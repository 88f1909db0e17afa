"""Placement of reads on a reference: semi-global affine-gap alignment of evidence profiles, a numpy kernel for each read.

Scores are in 1/1024 units. The whole query is used and the reference's flanks are free. A circular reference is doubled,
and a placement may not span more than one turn. Gaps are moved right as far as the score allows. Two equal placements of
the better orientation, or equal orientations, are an error of that read, told in its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lociflow.functions import expressions as X
from lociflow.sources.shipping import ship_bounded

UNIT = 1024
MAX_CELLS = 100_000_000
LOW = -(1 << 60)
#: Reads whose placement a task remembers.
REMEMBERED = 4_096
ALIGNMENT = (
    "orientation string, score long, start0 long, end0 long, wraps_origin boolean, exact_matches int, mismatches int, gap_opens int, callable_columns int, callable_identity double, unresolved int, "
    "columns array<struct<query_base:string,reference_base:string,call_index:int,ref_pos0:int>>, error_class string, error_message string"
)


@dataclass(frozen=True)
class Scoring:
    match: int = 3
    mismatch: int = -5
    gap_open: int = -10
    gap_extension: int = -4
    ambiguous: int = 0
    least_callable: int = 20
    least_identity: float = 0.80


@dataclass
class Placement:
    """Columns as (query index or -1, reference index or -1), and the score."""

    score: int
    columns: list[tuple[int, int]]

    @property
    def start(self) -> int:
        return next(r for _, r in self.columns if r >= 0)

    @property
    def end(self) -> int:
        return next(r for _, r in reversed(self.columns) if r >= 0) + 1


def substitutions(profiles: list, scoring: Scoring) -> np.ndarray:
    """Score of each profile against each of A, C, G, T and anything else."""
    out = np.full((len(profiles), 5), scoring.ambiguous * UNIT, np.int64)
    for i, p in enumerate(profiles):
        if p is not None:
            x = np.asarray(p, float) * UNIT
            whole = np.floor(x)
            q = np.clip(whole + (x - whole >= 0.5), 0, UNIT).astype(np.int64)
            out[i, :4] = q * scoring.match + (UNIT - q) * scoring.mismatch
    return out


def codes(bases: str) -> np.ndarray:
    table = np.full(128, 4, np.int8)
    table[[ord(b) for b in "ACGT"]] = range(4)
    return table[np.frombuffer(bases.encode("ascii", "replace"), np.uint8) & 127]


def fill(scores: np.ndarray, reference: np.ndarray, scoring: Scoring) -> tuple[np.ndarray, np.ndarray]:
    """(traceback bytes, last rows of the match, deletion and insertion states). A row is computed at once: deletions are a
    running maximum of matches less their extension. Bits 0-1 tell the state before a match (0 match, 1 deletion, 2 insertion),
    bit 2 an extended insertion, bit 3 an extended deletion."""
    width, ext = len(reference) + 1, scoring.gap_extension * UNIT
    both, steps = (scoring.gap_open + scoring.gap_extension) * UNIT, np.arange(width, dtype=np.int64) * ext
    trace = np.zeros((len(scores) + 1, width), np.uint8)
    m, d, i = np.zeros(width, np.int64), np.full(width, LOW, np.int64), np.full(width, LOW, np.int64)
    for row, own in enumerate(scores, 1):
        opened, longer = m + both, i + ext
        extended = longer >= opened
        best = np.maximum(np.maximum(m, d), i)
        source = np.where(m == best, 0, np.where(d == best, 1, 2)).astype(np.uint8)
        new_m = np.full(width, LOW, np.int64)
        new_m[1:] = best[:-1] + own[reference]
        new_d = np.full(width, LOW, np.int64)
        new_d[1:] = np.maximum.accumulate(new_m - steps)[:-1] + both + steps[1:] - ext
        bits = extended.astype(np.uint8) << 2
        bits[1:] |= source[:-1] | ((new_d[:-1] + ext >= new_m[:-1] + both).astype(np.uint8) << 3)
        trace[row] = bits
        m, d, i = new_m, new_d, np.where(extended, longer, opened)
    return trace, np.stack([m, d, i])


def walk(trace: np.ndarray, column: int, state: int) -> list[tuple[int, int]]:
    """Columns from an endpoint back to the query's start."""
    row, out = len(trace) - 1, []
    while row > 0:
        bits = trace[row, column]
        if state == 0:
            out.append((row - 1, column - 1))
            state, row, column = int(bits & 3), row - 1, column - 1
        elif state == 2:
            out.append((row - 1, -1))
            state, row = (2 if bits & 4 else 0), row - 1
        else:
            out.append((-1, column - 1))
            state, column = (1 if bits & 8 else 0), column - 1
    return out[::-1]


def total(columns: list[tuple[int, int]], scores: np.ndarray, reference: np.ndarray, scoring: Scoring) -> int:
    out, last = 0, 0
    for q, r in columns:
        kind = 1 if q < 0 else 2 if r < 0 else 0
        out += int(scores[q, reference[r]]) if not kind else (scoring.gap_extension + (scoring.gap_open if kind != last else 0)) * UNIT
        last = kind
    return out


def move_gaps(place: Placement, query: str, bases: str, scores: np.ndarray, reference: np.ndarray, scoring: Scoring, turn: int | None) -> None:
    """Move gaps to the right as long as the score stays. A gap that goes one column on gives its first base to the column
    after it; only what that column scores before and after decides, unless a like gap follows, with which it would merge."""
    columns = place.columns
    kind = lambda i: 0 if i >= len(columns) else 1 if columns[i][0] < 0 else 2 if columns[i][1] < 0 else 0
    last = len(columns) - 1
    while last >= 0:  # the rightmost gaps first: what lies behind has come to rest
        gap = kind(last)
        if not gap:
            last -= 1
            continue
        first = last
        while first and kind(first - 1) == gap:
            first -= 1
        at, size = first, last - first + 1
        while at + size < len(columns) and not kind(at + size):
            (q0, r0), (q1, r1) = columns[at], columns[at + size]
            if gap == 1:  # bases of the reference alone: the query's base moves in front of them
                fits = bases[r0] == bases[r1] and not (turn and r0 // turn != r1 // turn)
                change, moved = int(scores[q1, reference[r0]]) - int(scores[q1, reference[r1]]) if fits else 1, ((q1, r0), (-1, r1))
            else:
                fits = query[q0] == bases[r1] and not (turn and r1 % turn == 0)
                change, moved = int(scores[q0, reference[r1]]) - int(scores[q1, reference[r1]]) if fits else 1, ((q0, r1), (q1, -1))
            if kind(at + size + 1) == gap and not change:
                change = scoring.gap_open * -UNIT  # two gaps become one
            if change:
                break
            columns[at], columns[at + size] = moved
            at += 1
        last = first - 1


def placements(query: str, profiles: list, bases: str, scoring: Scoring, turn: int | None = None) -> list[Placement]:
    """Up to two different placements of the best score."""
    if not query or not bases:
        raise ValueError("query and reference must not be empty")
    if (len(query) + 1) * (len(bases) + 1) > MAX_CELLS:
        raise ValueError("too many cells")
    scores, reference = substitutions(profiles, scoring), codes(bases)
    trace, ends = fill(scores, reference, scoring)
    best = ends.max(axis=0)
    found: list[Placement] = []
    seen: set = set()
    for column in np.lexsort((np.arange(len(best)), -best)):
        if found and best[column] < found[0].score:
            break
        place = Placement(int(best[column]), walk(trace, int(column), int(ends[:, column].argmax())))
        if all(r < 0 for _, r in place.columns):
            continue
        move_gaps(place, query, bases, scores, reference, scoring, turn)
        if turn and place.end - place.start > turn:
            continue
        key = (place.start % turn if turn else place.start, tuple((q, bases[r] if r >= 0 else "-") for q, r in place.columns))
        if key not in seen:
            seen.add(key)
            found.append(place)
            if len(found) == 2:
                break
    return found


COMPLEMENT = str.maketrans("ACGTRYSWKMBDHV", "TGCAYRSWMKVHDB")


def align_read(query: str, profiles: list, first_call: int, bases: str, circular: bool, scoring: Scoring) -> list:
    """Row of ALIGNMENT for one read, the better of both orientations."""
    turn = len(bases) if circular else None
    working = bases * 2 if circular else bases
    n = len(query)
    sides = (
        ("forward", query, profiles, list(range(first_call, first_call + n))),
        ("reverse", query.translate(COMPLEMENT)[::-1], [None if p is None else p[::-1] for p in profiles[::-1]], list(range(first_call + n - 1, first_call - 1, -1))),
    )
    try:
        tried = [(side, placements(side[1], side[2], working, scoring, turn)) for side in sides]
        if not all(p for _, p in tried):
            raise ValueError("no placement within one turn")
        if tried[0][1][0].score == tried[1][1][0].score:
            raise ValueError("both orientations score alike")
        (name, read, _, calls), found = max(tried, key=lambda x: x[1][0].score)
        if len(found) > 1:
            raise ValueError("several placements score alike")
        place, length = found[0], len(bases)
        letters = [(read[q] if q >= 0 else "-", working[r] if r >= 0 else "-") for q, r in place.columns]
        exact = sum(a == b and a in "ACGT" for a, b in letters)
        wrong = sum(a != b and a in "ACGT" and b in "ACGT" for a, b in letters)
        kinds = [1 if a == "-" else 2 if b == "-" else 0 for a, b in letters]
        opens = sum(k and k != p for k, p in zip(kinds, [0, *kinds], strict=False))
        if exact + wrong < scoring.least_callable:
            raise ValueError(f"{exact + wrong} callable columns")
        identity = exact / (exact + wrong)
        if identity < scoring.least_identity:
            raise ValueError(f"callable identity {identity:.4f}")
        columns = [{"query_base": a, "reference_base": b, "call_index": calls[q] if q >= 0 else None, "ref_pos0": r % length if r >= 0 else None} for (a, b), (q, r) in zip(letters, place.columns, strict=True)]
        start = place.start % length
        return [name, place.score, start, start + place.end - place.start, start + place.end - place.start > length, exact, wrong, opens, exact + wrong, identity, sum(a == "N" for a, _ in letters), columns, None, None]
    except ValueError as e:
        return [None] * 12 + ["alignment", str(e)]


def read_contents(query: pa.Array, profiles: pa.ListArray, first_call: pa.Array) -> list[tuple]:
    """What tells a read of a batch from others: its letters, first call, and the bytes of its profiles. Two reads of the same
    contents have the same placement."""
    found = []
    for q, p, f in zip(query.to_pylist(), profiles, first_call.to_pylist(), strict=True):
        inner = p.values
        values = inner.flatten()
        found.append((q, f, values.to_numpy(zero_copy_only=False).tobytes(), np.asarray(inner.value_lengths().fill_null(-1)).tobytes()))
    return found


def align_reads(reads: DataFrame, bases: str, circular: bool = False, scoring: Scoring | None = None, keys: tuple[str, ...] = ("read",)) -> DataFrame:
    """Align rows (keys, query, profiles, first_call). The reference, of bounded length, goes along with the function; a
    read's work is its own, so rows stay in their partitions. Reads of the same contents are placed once a task, as long as
    it remembers them (REMEMBERED reads)."""
    ship_bounded(reads.sparkSession)
    scoring, n_keys = scoring or Scoring(), len(keys)
    kinds = ", ".join(f"`{k}` {reads.schema[k].dataType.simpleString()}" for k in keys)
    fields = list(to_arrow_schema(StructType.fromDDL(ALIGNMENT)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list] = {}
        for b in batches:
            query, profiles, first_call = b.columns[n_keys:]
            place: dict[tuple, tuple[int, list]] = {}
            at = []
            for i, contents in enumerate(read_contents(query, profiles, first_call)):
                if contents not in place:
                    if contents not in known:
                        if len(known) >= REMEMBERED:
                            known.pop(next(iter(known)))
                        known[contents] = align_read(contents[0], profiles[i].as_py(), int(contents[1]), bases, circular, scoring)
                    place[contents] = len(place), known[contents]
                at.append(place[contents][0])
            rows = [row for _, row in place.values()]
            out = [pa.array([r[j] for r in rows], x.type).take(pa.array(at, pa.int32())) for j, x in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], *out], names=[*keys, *(x.name for x in fields)])

    return reads.select(*keys, "query", "profiles", "first_call").mapInArrow(each, f"{kinds}, {ALIGNMENT}")


def alignment_columns(alignments: DataFrame, keys: tuple[str, ...] = ("read",)) -> DataFrame:
    return alignments.where("error_class IS NULL").select(*keys, "orientation", F.posexplode("columns").alias("col_idx", "c")).select(*keys, "orientation", "col_idx", "c.*")


def variants(columns: DataFrame, bases: str, circular: bool = False, longest: int = 50, keys: tuple[str, ...] = ("read",)) -> DataFrame:
    """Variants of alignment columns: substitutions one by one, runs of inserted or deleted bases as one event anchored at the
    reference base before it (at position 0 of a linear reference, at the base after it). Excluded events have reasons."""
    w = Window.partitionBy(*keys).orderBy("col_idx")
    gap = F.when(F.col("query_base") == "-", "DEL").when(F.col("reference_base") == "-", "INS").when(F.col("query_base") != F.col("reference_base"), "SNV")
    base = columns.withColumn("kind", gap)
    flank = F.when(F.col("call_index").isNotNull() & F.col("ref_pos0").isNotNull(), F.col("call_index"))
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    base = base.select(
        "*", F.last("ref_pos0", True).over(before).alias("prev_ref"), F.first("ref_pos0", True).over(after).alias("next_ref"), F.last(flank, True).over(before).alias("prev_flank"), F.first(flank, True).over(after).alias("next_flank"),
        (~F.coalesce((F.lag("kind").over(w) == F.col("kind")) & (F.col("kind") != "SNV"), F.lit(False))).cast("int").alias("new"),
    )
    base = base.withColumn("event", F.sum("new").over(w)).where("kind IS NOT NULL")
    order = F.array_sort(F.collect_list(F.struct("col_idx", "query_base", "reference_base", "call_index", "ref_pos0", "prev_ref", "next_ref", "prev_flank", "next_flank")))
    events = base.groupBy(*keys, "event", "kind").agg(order.alias("x"))
    first, last = F.col("x")[0], F.element_at("x", -1)
    joined = lambda name: F.array_join(F.transform("x", lambda s: s[name]), "")
    events = events.select(
        *keys, "event", "kind", joined("query_base").alias("q"), joined("reference_base").alias("r"), first.ref_pos0.alias("first_ref"), first.prev_ref.alias("prev_ref"), last.next_ref.alias("next_ref"),
        first.prev_flank.alias("prev_flank"), last.next_flank.alias("next_flank"), F.array_compact(F.transform("x", lambda s: s.call_index)).alias("supporting"),
    )
    length = len(bases)
    allele = F.when(F.col("kind") == "DEL", F.col("r")).otherwise(F.col("q"))
    reasons = F.array_compact(F.array(F.when((F.col("kind") != "SNV") & (F.length(allele) > longest), "allele_too_long"), F.when(~F.concat(F.col("q"), F.col("r")).rlike("^[ACGT-]*$"), "non_canonical_allele")))
    target = F.coalesce(F.when(F.col("kind") == "DEL", F.col("first_ref")), F.col("next_ref"))
    lead = F.pmod(target - 1, F.lit(length)) if circular else F.when(target > 0, target - 1)
    events = events.withColumn("reasons", reasons).withColumn("anchor", F.coalesce("prev_ref", lead))
    letter = lambda p: F.substr(F.lit(bases), p + 1, F.lit(1))
    anchored = F.col("anchor").isNotNull()
    right = F.coalesce(letter(F.col("next_ref")), F.lit(""))
    position = F.when(F.col("kind") == "SNV", F.col("first_ref") + 1).when(anchored, F.col("anchor") + 1).when(F.col("kind") == "INS", F.col("next_ref") + 1).otherwise(F.lit(1))
    reference = F.when(F.col("kind") == "SNV", F.col("r")).when(F.col("kind") == "INS", F.when(anchored, letter(F.col("anchor"))).otherwise(right)).otherwise(F.when(anchored, F.concat(letter(F.col("anchor")), "r")).otherwise(F.concat("r", right)))
    alternate = F.when(F.col("kind") == "SNV", F.col("q")).when(F.col("kind") == "INS", F.when(anchored, F.concat(letter(F.col("anchor")), "q")).otherwise(F.concat("q", right))).otherwise(F.when(anchored, letter(F.col("anchor"))).otherwise(right))
    flanking = F.when(F.col("kind") == "SNV", F.array().cast("array<int>")).otherwise(F.array_compact(F.array("prev_flank", "next_flank")))
    return events.select(*keys, "kind", F.when((F.size("reasons") == 0) | (F.col("kind") == "SNV"), position).cast("int").alias("position_1based"), reference.alias("reference"), alternate.alias("alternate"), "supporting", flanking.alias("flanking"), "reasons")


def merge_variants(found: DataFrame, keys: tuple[str, ...] = ("read",)) -> DataFrame:
    """Equal reported events of a read become one, with the calls of all in order and each once. Excluded events have no
    allele to be equal in and stay as they are."""
    same = [*keys, "kind", "position_1based", "reference", "alternate"]
    calls = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    reported = found.where(F.size("reasons") == 0).groupBy(*same).agg(calls("supporting"), calls("flanking"), F.first("reasons").alias("reasons"))
    return reported.unionByName(found.where(F.size("reasons") > 0))


def reference_faults(found: DataFrame, bases: str, circular: bool = False, keys: tuple[str, ...] = ("read",)) -> DataFrame:
    """Reported events whose reference allele is not what the reference has at their position."""
    there = F.substr(F.lit(bases + bases if circular else bases), F.col("position_1based"), F.length("reference"))
    return found.where((F.size("reasons") == 0) & (F.col("position_1based").isNull() | (there != F.col("reference")))).select(*keys, "kind", "position_1based", "reference", there.alias("expected"))


def filter_variants(found: DataFrame, calls: DataFrame, regions: list[tuple[int, int]], least_peak: int = 150, quality: int = 30, keys: tuple[str, ...] = ("read",)) -> DataFrame:
    """Add exclusion reasons in their fixed order: outside the regions, low peak, low quality, mixed calls (SNV only).
    Deletions have no calls of their own to judge. `calls` has (keys, call_index, highest_peak, relative_quality, n_qualifying).
    A variant is known by all that it holds, so nothing is numbered; equal rows of it become one."""
    support = found.withColumn("call_index", F.explode_outer("supporting")).join(calls.select(*keys, "call_index", "highest_peak", "relative_quality", "n_qualifying"), [*keys, "call_index"], "left")
    judged = support.groupBy(*found.columns).agg(F.bool_or(F.col("highest_peak") < least_peak).alias("low_peak"), F.bool_or(F.col("relative_quality") <= quality).alias("low_quality"), F.bool_or(F.col("n_qualifying") > 1).alias("mixed"))
    inside = X.in_regions(F.col("position_1based"), regions)
    counted = F.col("kind") != "DEL"
    reasons = X.flags(
        ("outside_configured_region", ~inside), ("peak_below_minimum", counted & F.col("low_peak")), ("relative_quality_not_above_threshold", counted & F.col("low_quality")),
        ("mixed_supporting_signal", (F.col("kind") == "SNV") & F.col("mixed")),  # names of reasons are fixed values
    )
    return judged.withColumn("exclusion_reasons", F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(reasons)).drop("low_peak", "low_quality", "mixed", "reasons")
