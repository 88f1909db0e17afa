"""Column expressions for bases, profiles and positions.

Four-vectors are arrays in the order A, C, G, T. A locus without any height has a null profile, never a uniform one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: IUPAC codes and the bases each stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG",
    "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT",
}
COMPLEMENT = ("ACGTRYSWKMBDHV", "TGCAYRSWMKVHDB")


def complement(base: Column) -> Column:
    """Complement of each IUPAC letter; any other character becomes N."""
    return F.regexp_replace(F.translate(base, *COMPLEMENT), "[^ACGTRYSWKMBDHVN]", "N")


def reverse_complement(bases: Column) -> Column:
    return F.reverse(complement(bases))


def canonical(base: Column) -> Column:
    return F.coalesce(base.isin(*BASES), F.lit(False))


def neighbour_counts(bases: Column) -> Column:
    """array<struct<pair, n>>: how often each two letters stand side by side in a string of A, C, G and T alone, by lengths without a
    pair. Two different letters can't overlap their like; a letter that is followed by itself is one that neither another letter
    nor the end follows."""
    n = lambda part: F.length(bases) - F.length(F.replace(bases, F.lit(part), F.lit("")))
    pairs = {(a, b): (n(a + b) / 2).cast("long") for a in BASES for b in BASES if a != b}
    entry = lambda pair, count: F.struct(F.lit(pair).alias("pair"), count.cast("long").alias("n"))
    same = [entry(a + a, n(a) - (F.substr(bases, F.length(bases), F.lit(1)) == a).cast("int") - sum((pairs[a, b] for b in BASES if b != a), F.lit(0))) for a in BASES]
    return F.array(*[entry(a + b, c) for (a, b), c in pairs.items()], *same)


def iupac_code(bases: Column) -> Column:
    """Code of an array of one or two different bases; N for any other number."""
    pairs = {v: k for k, v in IUPAC.items() if len(v) <= 2}
    joined = F.array_join(F.array_sort(F.array_distinct(bases)), "")
    known = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(known, joined), F.lit("N"))


def iupac_bases(code: Column) -> Column:
    """Array of the bases that a code stands for; null for an unknown code."""
    known = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    return F.split(F.try_element_at(known, code), "")


def strand_base(base: Column, reverse: Column) -> Column:
    """A base as the reference strand has it; what is not A, C, G or T stays."""
    return F.when(reverse & canonical(base), F.translate(base, "ACGT", "TGCA")).otherwise(base)


def strand_vector(values: Column, reverse: Column) -> Column:
    return F.when(reverse, F.reverse(values)).otherwise(values)


def corrected(height: Column, baseline: Column) -> Column:
    return F.greatest(height - baseline, F.lit(0.0))


def round_metric(value: Column) -> Column:
    """Six decimals, halves away from zero, decided on the scaled value."""
    return F.round(value * 1e6) / 1e6


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def profile(heights: Column) -> Column:
    """Weights that sum up to one, or null without a positive total."""
    return F.when(total(heights) > 0, F.transform(heights, lambda h: h / total(heights)))


def gini_impurity(weights: Column) -> Column:
    """One less the sum of squares; the sample layer's measure."""
    return F.when(weights.isNotNull(), 1 - F.aggregate(weights, F.lit(0.0), lambda a, w: a + w * w))


def max_impurity(weights: Column) -> Column:
    """One less the greatest weight; the phase layer's measure."""
    return 1 - F.array_max(weights)


def total_variation(left: Column, right: Column) -> Column:
    both = left.isNotNull() & right.isNotNull()
    return F.when(both, F.aggregate(F.zip_with(left, right, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / 2)


def mass(weights: Column, base: Column) -> Column:
    """Weight of a base; null for a base that is not A, C, G or T."""
    return F.get(weights, F.nullif(F.instr(F.lit(BASES), base), F.lit(0)) - 1)


def valid_profile(weights: Column) -> Column:
    """Null, or four finite weights in [0, 1] that sum up to one within 1e-9."""
    inside = F.forall(weights, lambda w: w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w <= 1))
    return weights.isNull() | ((F.size(weights) == 4) & inside & (F.abs(total(weights) - 1) <= 1e-9))


def one_based(position: Column) -> Column:
    return position + 1


def oriented_distance(position: Column, exit_position: Column, reverse: Column, length: int) -> Column:
    """Steps from a tract's exit in read order on a circle."""
    step = F.when(reverse, exit_position - position).otherwise(position - exit_position)
    return F.pmod(step, F.lit(length))


def path_region(call: Column, first: Column, last: Column) -> Column:
    """Where a call lies by call order: before, inside or after a tract's calls; unresolved without them."""
    return F.when(call.isNull() | first.isNull() | last.isNull(), "unresolved").when(call < first, "before").when(call > last, "after").otherwise("inside")


def span_distance(call: Column, first: Column, last: Column) -> Column:
    return F.when(call < first, first - call).when(call > last, call - last).otherwise(F.lit(0))


def edge_distance(call: Column, trim_start: Column, trim_end: Column) -> Column:
    return F.least(call - trim_start, trim_end - 1 - call)


def in_regions(position: Column, regions: list[tuple[int, int]]) -> Column:
    """Inclusive ranges, any of them."""
    out = F.lit(False)
    for first, last in regions:
        out = out | position.between(first, last)
    return out


def flags(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, in the order given, as an array."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in named]))


def flag_text(flag_array: Column) -> Column:
    return F.array_join(flag_array, ";")


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def difference_id(*fields: Column) -> Column:
    """SHA-256 of the fields joined by a NUL character."""
    return F.sha2(F.concat_ws("\0", *fields), 256)


def locus_state(kind: Column, base: Column, reference: Column) -> Column:
    """deletion, then unresolved, then reference, then alternate."""
    return F.when(kind == "deletion", "deletion").when(~canonical(base), "unresolved").when(base == reference, "reference").otherwise("alternate")


def nearest_rank(name: str, p: float) -> Column:
    """Exact quantile of a column without interpolation: the value of rank max(1, ceil(p * n))."""
    return F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY `{name.replace('`', '``')}`)")


def vector_columns(vector: str, prefix: str) -> list[Column]:
    """A four-vector as four columns with the suffixes _a, _c, _g and _t."""
    return [F.get(F.col(vector), F.lit(i)).alias(f"{prefix}_{b.lower()}") for i, b in enumerate(BASES)]


def sample_name(name: Column) -> Column:
    """1 to 128 letters, digits, `_`, `.` or `-` of ASCII, a letter or digit first."""
    return F.coalesce(name.rlike("^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}\\z"), F.lit(False))


def case_name(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Za-z0-9][A-Za-z0-9_.-]*\\z"), F.lit(False))


def sha256_name(name: Column) -> Column:
    return F.coalesce(name.rlike("^[0-9a-f]{64}\\z"), F.lit(False))


def finite(value: Column) -> Column:
    """Whether a number is null or neither infinite nor no number."""
    return value.isNull() | (~F.isnan(value) & (F.abs(value) < float("inf")))


def contribution(state: Column, weights: Column) -> Column:
    """What a retained observation adds to a locus's nucleotides."""
    return F.when(state == "deletion", "deletion_event").when(weights.isNotNull(), "eligible").otherwise("missing_profile")


def vendor_quality_applies(qualities: Column, index: Column, agrees: Column) -> Column:
    """Whether the vendor says a quality for a call (one byte each) and both call the same base."""
    return F.coalesce((index < F.octet_length(qualities)) & agrees, F.lit(False))


def reference_segments(start: Column, end: Column, length: int) -> Column:
    """One half-open interval of a placed read, or two where it runs over the origin of a circle."""
    one = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    return F.when(end > length, F.array(one(start, F.lit(length)), one(F.lit(0), end - length))).otherwise(F.array(one(start, end)))
