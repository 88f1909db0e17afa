"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target from its weight; each of its documents is to be taken target / size-of-source times on
average. The whole part of that is given at once. The fractional parts are rounded together: two units meet, mass
(probability times size) moves from one to the other in a random direction that keeps both means, and one of them becomes
integral. Blocks of about BLOCK units do this one after the other and leave one fractional unit at most; the residuals of
BLOCK blocks meet again, and so on up a reduction tree until a source has one, which goes to the nearer side. So a
source's taken words differ from its target by half a document at most. All draws are hashes: reruns agree.

Rows alike in identifier, source and size are one unit: m of them are to be taken m times the rate, of which only the
fraction needs a draw. The copies are then dealt evenly over the rows, by numbers that are counted part by part, so any
number of such rows costs no task more than PART of them at a time.

Defined cases: a null source is a source of its own, last in order; a null or blank text has size 0 and is drawn by its
fraction alone; ties of size fall by hash; very long texts are words like others; an empty table gives an empty one; a
table in which no row has a word has targets of 0; other columns are carried along and can't clash, but for names that
begin with `__mix_`. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.shared import cut, let, n_words, uniform

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BLOCK = 64
#: Rows alike that are numbered together: a power of two.
PART_BITS = 16
PART = 1 << PART_BITS
SEED = 20240117
TINY = 1e-9


def numbered(rows: DataFrame, order: Column, name: str, number: str) -> DataFrame:
    """Add the place of each row in an order, from 0, without sorting in one task: ranges are sorted by themselves, and the
    rows before each range are counted."""
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__mix_at", F.monotonically_increasing_id())
    ranged = cut(ranged, name).withColumn("__mix_range", F.shiftright("__mix_at", 33))
    counts = ranged.groupBy("__mix_range").agg(F.count("*").alias("__mix_n"))
    before = F.coalesce(F.sum("__mix_n").over(Window.orderBy("__mix_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    offsets = counts.select(F.col("__mix_range").alias("__mix_r"), before.alias("__mix_before"))
    out = ranged.join(F.broadcast(offsets), F.col("__mix_range") == F.col("__mix_r"))  # a row a range, of which there are spark.sql.shuffle.partitions at most
    return out.withColumn(number, F.col("__mix_before") + F.col("__mix_at") - F.shiftleft("__mix_range", 33)).drop("__mix_at", "__mix_range", "__mix_r", "__mix_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, n_units, source_size, target) from rows (source, size, m), m equal rows each.

    Targets are min(most * source_size, level * weight). The level at which they sum up to share * total is found by sums:
    it rises as long as a rise brings further sources to their caps.
    """
    known = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n_units"))
    known = numbered(known, F.col("source").asc_nulls_last(), "mix-sources", "place")
    known = known.withColumn("weight", F.get(F.lit([float(w) for w in weights]), (F.col("place") % len(weights)).cast("int")))
    known = known.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    known = cut(known.select("source", "n_units", "source_size", "weight", "cap"), "mix-caps")
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        n, caps, rest, total = known.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.sum("source_size")).first()
        if n == capped or not rest:
            break
        capped, level = n, (total * share - (caps or 0.0)) / rest
    target = F.least("cap", F.col("weight") * F.lit(level)) if rest else F.col("cap")
    return known.select("source", "n_units", "source_size", target.alias("target"))


def _pivot(a: Column, b: Column, seed: int) -> Column:
    """One meeting of two fractional units: what each becomes, and which of them are whole."""
    raise_a = F.least((1 - a.p) * a.size, b.p * b.size)
    raise_b = F.least(a.p * a.size, (1 - b.p) * b.size)
    draw = uniform(F.lit(seed), a.id, b.id, a.size, b.size)

    def moved(x: Column) -> Column:
        up, ta, tb = x.draw * (x.ta + x.tb) < x.tb, x.ta, x.tb
        return F.struct(
            F.when(up, a.p + ta / a.size).otherwise(a.p - tb / a.size).alias("pa"),
            F.when(up, b.p - ta / b.size).otherwise(b.p + tb / b.size).alias("pb"),
            F.when(up, F.lit(1)).otherwise(F.lit(0)).alias("end_a"),
            F.when(up, F.lit(0)).otherwise(F.lit(1)).alias("end_b"),
            F.when(up, (1 - a.p) * a.size <= b.p * b.size).otherwise(a.p * a.size <= (1 - b.p) * b.size).alias("whole_a"),
            F.when(up, (1 - a.p) * a.size >= b.p * b.size).otherwise(a.p * a.size >= (1 - b.p) * b.size).alias("whole_b"),
        )

    step = F.struct(raise_a.alias("ta"), raise_b.alias("tb"), draw.alias("draw"))
    return let(step, moved)


def _fold(units: Column, id_type: str, seed: int) -> Column:
    """All units of a block, in their order: struct(done array, open unit or null)."""
    unit, end = f"struct<id:{id_type},low:bigint,size:double,p:double>", f"struct<id:{id_type},low:bigint,size:double,up:int>"
    start = F.struct(F.array().cast(f"array<{end}>").alias("done"), F.lit(None).cast(unit).alias("open"))
    whole = lambda u, up: F.array(F.struct(u.id.alias("id"), u.low.alias("low"), u.size.alias("size"), up.cast("int").alias("up")))
    still = lambda u, p: F.struct(u.id.alias("id"), u.low.alias("low"), u.size.alias("size"), p.alias("p"))

    def meet(acc: Column, b: Column) -> Column:
        a, none = acc.open, F.lit(None).cast(unit)

        def after(x: Column) -> Column:
            done = F.when(x.whole_a & x.whole_b, F.concat(acc.done, whole(a, x.end_a), whole(b, x.end_b))).when(x.whole_a, F.concat(acc.done, whole(a, x.end_a))).otherwise(F.concat(acc.done, whole(b, x.end_b)))
            left = F.when(x.whole_a & x.whole_b, none).when(x.whole_a, still(b, x.pb)).otherwise(still(a, x.pa))
            return F.struct(done.alias("done"), left.alias("open"))

        first = F.struct(acc.done.alias("done"), still(b, b.p).alias("open"))
        return F.when(a.isNull(), first).otherwise(let(_pivot(a, b, seed), after))

    return F.aggregate(units, start, meet)


def copies(units: DataFrame, id_type: str, seed: int = SEED) -> DataFrame:
    """(source, id, size, copies) from (source, id, size, expected, n_units), one row a unit: how often each is taken."""
    n_blocks = F.ceil(F.col("n_units") / BLOCK).cast("long")
    p, low = F.col("expected") - F.floor("expected"), F.floor("expected").cast("long")
    rows = units.select("source", "id", "size", low.alias("low"), p.alias("p"), F.pmod(F.xxhash64(F.lit(seed), "id", "size"), n_blocks).alias("block"))
    # whole numbers need no rounding, and units without mass are drawn alone
    alone = (F.col("p") < TINY) | (F.col("p") > 1 - TINY) | (F.col("size") <= 0)
    drawn = F.when(F.col("p") < TINY, 0).when(F.col("p") > 1 - TINY, 1).otherwise((uniform(F.lit(seed), F.col("id"), F.col("size")) < F.col("p")).cast("int"))
    done = [rows.where(alone).select("source", "id", "size", (F.col("low") + drawn).alias("copies"))]
    left, most = rows.where(~alone), units.agg(F.max(n_blocks)).first()[0] or 1
    level = 0
    while True:
        # large ones first: what a block leaves open is then one of its smaller documents
        one = F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(seed + level), "id", "size").alias("h"), F.col("id"), F.col("low"), F.col("size").cast("double").alias("size"), F.col("p"))
        grouped = left.groupBy("source", "block").agg(F.sort_array(F.collect_list(one)).alias("units"))
        folded = grouped.select("source", "block", _fold(F.col("units"), id_type, seed + level).alias("x"))
        both = F.concat(
            F.transform("x.done", lambda u: F.struct(u.id.alias("id"), u.low.alias("low"), u.size.alias("size"), u.up.alias("up"), F.lit(None).cast("double").alias("p"))),
            F.when(F.col("x.open").isNull(), F.array()).otherwise(F.array(F.struct(F.col("x.open.id").alias("id"), F.col("x.open.low").alias("low"), F.col("x.open.size").alias("size"), F.lit(None).cast("int").alias("up"), F.col("x.open.p").alias("p")))),
        )
        table = cut(folded.select("source", "block", F.explode(both).alias("u")).select("source", "block", "u.*"), f"mix-{level}")
        done.append(table.where("up IS NOT NULL").select("source", "id", F.col("size").cast("long").alias("size"), (F.col("low") + F.col("up")).alias("copies")))
        last = table.where("up IS NULL")
        if most <= 1:
            done.append(last.select("source", "id", F.col("size").cast("long").alias("size"), (F.col("low") + (uniform(F.lit(seed + level), F.col("id"), F.col("size")) < F.col("p")).cast("int")).alias("copies")))
            return reduce(DataFrame.unionByName, done)
        left = last.select("source", "id", "size", "low", "p", F.floor(F.col("block") / BLOCK).cast("long").alias("block"))
        most, level = -(-most // BLOCK), level + 1


def taken_units(documents: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(id, source, size, m, source_size, target, copies): rows alike in the first three are one unit of m rows, which are
    taken `copies` times in all."""
    sizes = documents.select(F.col(id_col).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    counted = cut(sizes.groupBy("id", "source", "size").agg(F.count("*").alias("m")), "mix-sizes")
    targets = cut(source_targets(counted, weights, share), "mix-targets")
    named = targets.withColumnRenamed("source", "__of")
    each = counted.join(named, F.col("source").eqNullSafe(F.col("__of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    each = each.select("source", "id", "size", "m", "source_size", "target", "n_units", (rate * F.col("m")).alias("expected"))
    found = copies(each.select("source", "id", "size", "expected", "n_units"), counted.schema["id"].dataType.simpleString(), seed)
    found = found.join(named.drop("n_units"), F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    several = counted.where("m > 1").select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "m")
    alike = F.col("id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size"))
    return found.join(several, alike, "left").select("id", "source", "size", F.coalesce("m", F.lit(1)).alias("m"), "source_size", "target", "copies")


def dealt(total: Column, rows: Column, place: Column) -> Column:
    """How many of `total` copies the row at `place` of `rows` rows gets."""
    low = F.floor(total / rows).cast("long")
    return low + (place < total - low * rows).cast("long")


def mix(documents: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(id, source, k, size, source_size, target, copies): one row for each row of `documents`; k numbers identical rows."""
    units = taken_units(documents, id_col, text, source, weights, share, seed)
    # PART rows of a unit at a time, which a shuffle deals over the tasks if there are many
    parts = units.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(PART).cast("long"))))
    some, many = parts.where(F.col("m") <= PART), parts.where(F.col("m") > PART)
    parts = some.unionByName(many.repartition(F.xxhash64("id", "source", "size", "first")))
    rows = parts.withColumn("k", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + (PART - 1), F.col("m") - 1))))
    return rows.select("id", "source", "k", "size", "source_size", "target", dealt(F.col("copies"), F.col("m"), F.col("k")).alias("copies"))


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with the columns of `documents`.

    The join on the identifier is the one shuffle of texts. Of a unit of several rows, those are numbered part by part: the
    rows of each part, then the parts.
    """
    columns = [F.col(f"__mix_row.`{c}`") for c in documents.columns]
    unit = ["__mix_id", "__mix_source", "__mix_size"]
    taken = taken_units(documents, id_col, text, source, seed=seed).select(F.col("id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"), F.col("m").alias("__mix_m"), F.col("copies").alias("__mix_copies"))
    taken = cut(taken, "mix-taken")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__mix_row"), F.col(id_col).alias("__i"), F.col(source).alias("__s"), n_words(F.col(text)).alias("__w"))
    joined = rows.join(taken, F.col("__i").eqNullSafe(F.col("__mix_id")) & F.col("__s").eqNullSafe(F.col("__mix_source")) & (F.col("__w") == F.col("__mix_size"))).drop("__i", "__s", "__w")
    once = joined.where("__mix_m = 1").select("__mix_row", F.col("__mix_copies").alias("__mix_n"))
    out = once
    if not taken.where("__mix_m > 1").isEmpty():
        many = joined.where("__mix_m > 1").withColumn("__mix_at", F.monotonically_increasing_id())
        many = cut(many, "mix-alike").withColumn("__mix_part", F.shiftright("__mix_at", PART_BITS))
        parts = many.groupBy(*unit, "__mix_part").agg(F.count("*").alias("__mix_c"))
        before = F.sum("__mix_c").over(Window.partitionBy(*unit).orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for PART rows
        parts = cut(parts.select(*[F.col(c).alias(f"{c}_") for c in unit], F.col("__mix_part").alias("__mix_part_"), F.coalesce(before, F.lit(0)).alias("__mix_before")), "mix-parts")
        same = (F.col("__mix_part") == F.col("__mix_part_")) & (F.col("__mix_size") == F.col("__mix_size_")) & F.col("__mix_id").eqNullSafe(F.col("__mix_id_")) & F.col("__mix_source").eqNullSafe(F.col("__mix_source_"))
        place = F.row_number().over(Window.partitionBy(*unit, "__mix_part").orderBy("__mix_at")) - 1 + F.col("__mix_before")
        out = out.unionByName(many.join(parts, same).select("__mix_row", dealt(F.col("__mix_copies"), F.col("__mix_m"), place).alias("__mix_n")))
    return out.where("__mix_n > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_n")))).select(*columns)


def document_mix(documents: DataFrame) -> DataFrame:
    return mix(documents).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
