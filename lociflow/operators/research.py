"""Relational steps of the research layer: summaries, strata, flags, queues, parity, matching."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.operators.ranks import HOT_ROWS, grouped_ranks
from lociflow.operators.windows import running


def grouping_summary(rows: DataFrame, keys: Sequence[str], value: str, fit: str) -> DataFrame:
    """Overall and each group, with the rows used to fit beside all: one pass over two grouping sets."""
    out = rows.groupingSets([[], list(keys)], *keys).agg(F.grouping_id().alias("__g"), F.count("*").alias("rows"), F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.count_if(F.col(fit)).alias("fit_rows"), F.avg(F.when(F.col(fit), F.col(value))).alias("fit_mean"))
    return out.withColumn("scope", F.when(F.col("__g") == 0, "group").otherwise("overall")).drop("__g")


def strata_bounds(rows: DataFrame, strata: Sequence[str], value: str, low: float = 0.05, high: float = 0.95, limit: int = HOT_ROWS) -> DataFrame:
    return grouped_ranks(rows, strata, [F.count(value).alias("stratum_n")], {"low": (value, low), "high": (value, high)}, limit)


def tail_flags(rows: DataFrame, bounds: DataFrame, strata: Sequence[str], value: str, least: int = 20) -> DataFrame:
    """low or high at or beyond a bound; unbenchmarked in strata of fewer than `least` rows or without a stratum."""
    joined = rows.join(bounds, list(strata), "left")
    small = F.coalesce(F.col("stratum_n") < least, F.lit(True))
    flag = F.when(small, "unbenchmarked").when(F.col(value) <= F.col("low"), "low").when(F.col(value) >= F.col("high"), "high").otherwise("typical")
    return joined.withColumn("flag", flag)


def curation_queue(loci: DataFrame, flagged: DataFrame) -> DataFrame:
    """Mixed loci (case_id, position, reason) by how many cases share the position, then flagged reads (case_id, read, reason).
    Cases are counted by groups and joined back, so a position that all cases share is no task's alone."""
    shared = loci.select("case_id", "position").distinct().groupBy("position").agg(F.count("*").cast("int").alias("recurrence"))
    first = loci.join(shared, "position").select(F.lit("locus").alias("item"), "case_id", F.col("position"), F.lit(None).cast("long").alias("read"), "reason", "recurrence")
    second = flagged.select(F.lit("read").alias("item"), "case_id", F.lit(None).cast("long").alias("position"), F.col("read"), "reason", F.lit(None).cast("int").alias("recurrence"))
    return first.unionByName(second)


def queue_items(queue: DataFrame) -> DataFrame:
    """The queue as items: one for each locus or read of a case with all its reasons in order, an identifier that follows from
    what it is, and its place: most shared loci first, then reads."""
    items = queue.groupBy("item", "case_id", "position", "read").agg(F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reasons"), F.max("recurrence").alias("recurrence"))
    name = X.difference_id(F.col("item"), F.col("case_id").cast("string"), F.coalesce(F.col("position").cast("string"), F.lit("")), F.coalesce(F.col("read").cast("string"), F.lit("")))
    order = Window.partitionBy("case_id").orderBy("item", F.desc_nulls_last("recurrence"), F.asc_nulls_last("position"), F.asc_nulls_last("read"))
    return items.withColumn("item_id", name).withColumn("place", F.row_number().over(order))


def readiness_counts(rows: DataFrame, keys: Sequence[str], units: dict[str, Sequence[str]]) -> DataFrame:
    """Rows of each group, and how many different units of each name it has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count_distinct(*c).alias(n) for n, c in units.items()])


def crossing_reads(observations: DataFrame, read: Sequence[str], position: str, first: int, last: int) -> DataFrame:
    """Reads that hold every position of a tract, with the span of their calls there."""
    inside = observations.where(F.col(position).between(first, last))
    return inside.groupBy(*read).agg(F.count_distinct(position).alias("positions"), F.min("call_index").alias("first_call"), F.max("call_index").alias("last_call")).where(F.col("positions") == last - first + 1)


def matched_groups(rows: DataFrame, keys: Sequence[str], role: str) -> DataFrame:
    """Groups in which both values of a role occur, with both sides' counts; no pairs are formed."""
    a, b = F.count_if(F.col(role)), F.count_if(~F.col(role))
    return rows.groupBy(*keys).agg(a.alias("with_role"), b.alias("without_role")).where("with_role > 0 AND without_role > 0")


def parity(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """One row: keys of either side alone, values present on one side only, the largest difference, and whether it holds."""
    l = left.select(*keys, F.struct(*values).alias("l"))  # noqa: E741
    r = right.select(*keys, F.struct(*values).alias("r"))
    both = l.join(r, list(keys), "full_outer")
    gaps = reduce(lambda a, b: a + b, [(F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col(f"l.{v}").isNull() != F.col(f"r.{v}").isNull())).cast("int") for v in values])
    widest = [F.abs(F.col(f"l.{v}") - F.col(f"r.{v}")) for v in values]
    widest = F.greatest(*widest) if len(widest) > 1 else widest[0]
    counted = both.agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), F.coalesce(F.sum(gaps), F.lit(0)).alias("presence_differences"), F.max(widest).alias("max_delta"))
    return counted.withColumn("holds", (F.col("left_only") + F.col("right_only") + F.col("presence_differences") == 0) & (F.coalesce("max_delta", F.lit(0.0)) <= tolerance))


def exact_matches(truth: DataFrame, called: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer match one to one: the n-th equal event of either side meets the other's n-th."""
    w = Window.partitionBy(*keys).orderBy(F.lit(1))
    t = truth.select(*keys).withColumn("__n", F.row_number().over(w)).withColumn("__t", F.lit(1))
    c = called.select(*keys).withColumn("__n", F.row_number().over(w)).withColumn("__c", F.lit(1))
    status = F.when(F.col("__t").isNull(), "extra").when(F.col("__c").isNull(), "missing").otherwise("exact")
    return t.join(c, [*keys, "__n"], "full_outer").select(*keys, status.alias("status"))


def precision_recall(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and ratios, null without a denominator. True negatives and specificity have no meaning here and stay null."""
    tp, fp, fn = (F.count_if(F.col("status").isin(*s)) for s in (("exact", "equivalent"), ("extra",), ("missing",)))
    out = matches.groupBy(*keys).agg(tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"))
    none = F.lit(None).cast("double")
    return out.select("*", X.ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives")).alias("precision"), X.ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_negatives")).alias("recall"), none.alias("true_negatives"), none.alias("specificity"))


def read_context(rows: DataFrame, read: str, constants: Sequence[str], position: str, first: int, last: int) -> DataFrame:
    """One row a read: its constant columns, how many positions of a tract it holds, and how many rules it breaks (a constant
    that differs between rows, a position of the tract twice)."""
    inside = F.when(F.col(position).between(first, last), F.col(position))
    differs = reduce(lambda a, b: a + b, [(~F.min(c).eqNullSafe(F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))).cast("int") for c in constants])
    twice = (F.count(inside) > F.count_distinct(inside)).cast("int")
    return rows.groupBy(read).agg(*[F.max(c).alias(c) for c in constants], F.count_distinct(inside).alias("tract_positions"), (differs + twice).alias("faults"))


def stratified_summary(rows: DataFrame, strata: Sequence[str], flag: str, values: Sequence[str], limit: int = HOT_ROWS) -> DataFrame:
    """Observations of each stratum, how many carry a flag, and mean, median and 90th nearest-rank value of each metric."""
    plain = [F.count("*").alias("observations"), F.count_if(F.col(flag)).alias("flagged"), *[F.avg(v).alias(f"{v}_mean") for v in values]]
    ranks = {f"{v}_p{round(100 * p)}": (v, p) for v in values for p in (0.5, 0.9)}
    return grouped_ranks(rows, strata, plain, ranks, limit).select(*strata, "observations", "flagged", *[f"{v}_{x}" for v in values for x in ("mean", "p50", "p90")])


#: Tokens of a reviewer: a substitution, an inserted base, a deleted base. Fixed patterns.
TOKENS = {"SNV": "^([1-9][0-9]*)([ACGTRYSWKMBDHVN])$", "INS": "^([1-9][0-9]*)\\.([1-9][0-9]*)([ACGT])$", "DEL": "^([1-9][0-9]*)DEL$"}


def _read_tokens(tokens: DataFrame, sample: str, token: Column) -> DataFrame:
    """(sample, token, kind, position, place, letter): place is an inserted base's index; kind is null outside the grammar."""
    t = tokens.select(F.col(sample).alias("sample"), F.upper(F.trim(token)).alias("token"))
    kind = F.coalesce(*[F.when(F.col("token").rlike(p), k) for k, p in TOKENS.items()])
    part = lambda k, i: F.regexp_extract("token", TOKENS[k], i)
    return t.select("sample", "token", kind.alias("kind"), F.regexp_extract("token", "^([0-9]+)", 1).try_cast("int").alias("position"), part("INS", 2).try_cast("int").alias("place"), F.coalesce(F.nullif(part("SNV", 2), F.lit("")), part("INS", 3)).alias("letter"))


def reviewer_faults(tokens: DataFrame, sample: str, token: Column, reference: str) -> DataFrame:
    """(sample, token, rule): tokens outside the grammar or the reference, that say nothing, that repeat a substitution, a
    deletion or an inserted place, and insertions whose places are not 1, 2 ... without a gap (the first token stands for all)."""
    t = _read_tokens(tokens, sample, token)
    inside = F.col("position").between(1, len(reference))
    here = F.substr(F.lit(reference), F.col("position"), F.lit(1))
    alone = t.withColumn("rule", F.when(F.col("kind").isNull(), "unsupported token").when(~F.coalesce(inside, F.lit(False)), "position outside the reference").when((F.col("kind") == "SNV") & (F.col("letter") == here), "no difference from the reference"))
    alone = alone.where("rule IS NOT NULL").select("sample", "token", "rule")
    twice = t.where("kind IS NOT NULL").groupBy("sample", "kind", "position", "place").agg(F.count("*").alias("n"), F.min("token").alias("token")).where("n > 1")
    gaps = t.where("kind = 'INS'").groupBy("sample", "position").agg(F.max("place").alias("last"), F.count_distinct("place").alias("n"), F.min_by("token", "place").alias("token")).where("last <> n")
    return reduce(DataFrame.unionByName, [alone, twice.select("sample", "token", F.lit("duplicate token").alias("rule")), gaps.select("sample", "token", F.lit("gap in inserted places").alias("rule"))])


def reviewer_events(tokens: DataFrame, sample: str, token: Column, reference: str) -> DataFrame:
    """(sample, kind, position, reference, alternates) of reviewer tokens: `73G` or an IUPAC letter, one event with the other
    bases it stands for, any of which may be called; `310.1C` joined by position in the order of their index; `249DEL` with
    its neighbours one deletion, anchored at the base before (on a circle). A sample with a fault has no events."""
    length = len(reference)
    letter = lambda p: F.substr(F.lit(reference), p, F.lit(1))
    faulty = reviewer_faults(tokens, sample, token, reference).select("sample").distinct()
    t = _read_tokens(tokens, sample, token).join(faulty, "sample", "left_anti")
    here = letter(F.col("position"))
    snv = t.where("kind = 'SNV'").select("sample", "kind", "position", here.alias("reference"), F.array_sort(F.array_remove(X.iupac_bases(F.col("letter")), here)).alias("alternates"))
    ins = t.where("kind = 'INS'").groupBy("sample", "kind", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x.letter), "").alias("b"))
    ins = ins.select("sample", "kind", "position", here.alias("reference"), F.array(F.concat(here, "b")).alias("alternates"))
    w = Window.partitionBy("sample").orderBy("position")
    gone = t.where("kind = 'DEL'").select("sample", "kind", "position").withColumn("island", F.col("position") - F.row_number().over(w))
    gone = gone.groupBy("sample", "kind", "island").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    anchor = F.when(F.col("first") == 1, F.lit(length)).otherwise(F.col("first") - 1)
    gone = gone.select("sample", "kind", anchor.alias("position"), F.concat(letter(anchor), F.substr(F.lit(reference), F.col("first"), F.col("last") - F.col("first") + 1)).alias("reference"), F.array(letter(anchor)).alias("alternates"))
    return snv.unionByName(ins).unionByName(gone)


def reviewer_matches(truth: DataFrame, called: DataFrame) -> DataFrame:
    """(sample, kind, position, reference, alternates, alternate, status) of reviewer_events() against called events (sample,
    kind, position, reference, alternate): a reviewer's event meets the first call that it allows. A position has one
    reviewer's event of a kind and reference at most, so no call is wanted twice."""
    same = ["sample", "kind", "position", "reference"]
    allowed = truth.withColumn("alternate", F.explode("alternates")).join(called.select(*same, "alternate"), [*same, "alternate"])
    met = allowed.groupBy(*same, "alternates").agg(F.min("alternate").alias("alternate"))
    exact = truth.select(*same, "alternates").join(met, [*same, "alternates"], "left").withColumn("status", F.when(F.col("alternate").isNull(), "missing").otherwise("exact"))
    extra = called.select(*same, "alternate").join(met.select(*same, "alternate"), [*same, "alternate"], "left_anti")
    return exact.unionByName(extra.select(*same, F.lit(None).cast("array<string>").alias("alternates"), "alternate", F.lit("extra").alias("status")))


def readiness_grid(partitions: Sequence[str], differences: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for every partition and difference, zero where nothing was counted. The partitions are a short literal."""
    grid = differences.select(*keys).distinct().withColumn("partition", F.explode(F.lit(list(partitions))))
    return grid.join(counts, [*keys, "partition"], "left").fillna(0)


def partition_plan(rows: DataFrame, group: str, plan: dict[str, str]) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in plan.items() for x in kv])
    return rows.withColumn("partition", F.coalesce(F.try_element_at(known, F.col(group)), F.lit("unassigned")))


def leaks(rows: DataFrame, unit: str) -> DataFrame:
    """Units that occur both in development and in holdout."""
    return rows.groupBy(unit).agg(F.bool_or(F.col("partition") == "development").alias("d"), F.bool_or(F.col("partition") == "holdout").alias("h")).where("d AND h").select(unit)


def log_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """Fields of `... - event=name key=value` lines. Only what follows the first ` - ` is read. A key that a line repeats is a fault of that line; its first value stays."""
    said = F.when(F.instr(line, " - ") > 0, F.substr(F.col(line), F.instr(line, " - ") + 3))
    pairs = F.regexp_extract_all(said, F.lit(r'(\w+)=(?:"[^"]*"|\S+)'), F.lit(0))
    split = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.btrim(F.substr(x, F.instr(x, "=") + 1), F.lit('"')).alias("value")))
    rows = lines.withColumn("__split", split).withColumn("__keys", F.transform("__split", lambda x: x.key))
    fields = F.map_from_entries(F.filter("__split", lambda x, i: F.array_position(F.col("__keys"), x.key) == i + 1))
    rows = rows.withColumn("fields", fields).withColumn("fault", F.when(F.size(F.array_distinct("__keys")) < F.size("__keys"), "duplicate log field")).drop("__split", "__keys")
    return rows.withColumn("event", F.try_element_at("fields", F.lit("event"))).withColumn("level", F.regexp_extract(line, r"\| (\w+)\s*\|", 1))


def log_events(lines: DataFrame, line: str = "line", order: str = "line_no", keys: Sequence[str] = ("log",), width: int = 65_536) -> DataFrame:
    """log_fields() with the number of starts so far in the same log, `read_no`, which is summed in two levels."""
    return running(log_fields(lines, line), keys, order, width, sums={"read_no": F.coalesce((F.col("event") == "sample_read_started").cast("long"), F.lit(0).cast("long"))})
