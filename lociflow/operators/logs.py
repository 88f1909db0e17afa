"""Reads in a validation log: a state machine with the states idle and open, and the metrics of each read that it closes.

A start opens a read; what a read must hold counts only while it is open; the next completion or start ends it. Lines outside
an open read say nothing. A log's order is a running value (the latest start or completion before a line), so no log is
folded in one task: `windows.running` carries it from one bucket of lines to the next. The stream folds lines as they come,
with the open read as its state, and gives the same rows.

Nothing is thrown: a read carries the names of the rules that it breaks, in a fixed order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lociflow.functions import expressions as X
from lociflow.operators.research import log_fields
from lociflow.operators.windows import running
from lociflow.sources.shipping import ship

#: Events that a read's log must hold once, and those that bound it. Fixed values.
REQUIRED = ("basecalling_completed", "signal_processing_completed", "quality_control_completed", "alignment_completed", "warning_summary")
START, END, TRACE = "sample_read_started", "sample_read_completed", "trace_sha256"
#: Whole numbers of each event and the least that is allowed, and shares between 0 and 1. Fixed values.
NUMBERS = (("basecalling_completed", "calls", 1), ("signal_processing_completed", "profiled_loci", 0), ("signal_processing_completed", "noisy_calls", 0), ("quality_control_completed", "retained", 1), ("alignment_completed", "callable_columns", 1), ("alignment_completed", "mismatches", 0), ("alignment_completed", "gap_opens", 0), ("warning_summary", "excluded_variant_candidates", 0))
SHARES = (("quality_control_completed", "retained_fraction"), ("alignment_completed", "callable_identity"))
FIELDS = "map<string,string>"


def _said(event: str, key: str) -> Column:
    return F.try_element_at(F.col(event), F.lit(key))


def judged(reads: DataFrame) -> DataFrame:
    """Metrics and broken rules of reads (..., trace, ended_by, ended_trace, END's fields as `ended`, line_faults, repeated, known, and for
    each required event its fields and `n_<event>`)."""
    whole = {k: _said(e, k).try_cast("long") for e, k, _ in NUMBERS}
    share = {k: _said(e, k).try_cast("double") for e, k in SHARES}
    trim = _said("quality_control_completed", "trim")
    ends = [F.regexp_extract(F.coalesce(trim, F.lit("")), r"^(\d+)\.\.(\d+)$", i).try_cast("long") for i in (1, 2)]
    turned = F.lower(_said("alignment_completed", "orientation"))
    rows = reads.withColumns(whole | share | {"trim_start": ends[0], "trim_end": ends[1], "orientation": turned, "__last": F.lower(F.try_element_at("ended", F.lit("orientation")))})
    c, no = F.col, lambda x: ~F.coalesce(x, F.lit(False))
    closed = c("ended_by") == END
    held = lambda e: c(f"n_{e}") > 0
    rules = [
        ("start without a trace", c("trace").isNull()), ("unexpected trace", ~c("known")), ("repeated read", c("repeated")), ("read did not complete", no(closed)),
        ("completed by another trace", closed & ~c("ended_trace").eqNullSafe(c("trace"))), ("line with a repeated field", c("line_faults") > 0),
        *[(f"{e} is missing", closed & ~held(e)) for e in REQUIRED], *[(f"{e} is repeated", c(f"n_{e}") > 1) for e in REQUIRED],
        *[(f"{k} is no number from {least}", held(e) & no(c(k) >= least)) for e, k, least in NUMBERS], *[(f"{k} is no share", held(e) & no(c(k).between(0, 1))) for e, k in SHARES],
        ("trim has no bounds", held("quality_control_completed") & no(c("trim_end") > c("trim_start"))),
        ("trim and retained disagree", (c("trim_end") > c("calls")) | (c("retained") != c("trim_end") - c("trim_start"))),
        ("more loci than calls", (c("profiled_loci") > c("calls")) | (c("noisy_calls") > c("calls"))),
        ("alignment exceeds what was retained", (c("callable_columns") > c("retained")) | (c("mismatches") > c("callable_columns"))),
        ("unknown orientation", held("alignment_completed") & no(c("orientation").isin("forward", "reverse"))), ("orientations differ", closed & held("alignment_completed") & no(c("__last") == c("orientation"))),
    ]
    faults = X.flags(*[(name, F.coalesce(rule, F.lit(False))) for name, rule in rules])
    out = rows.withColumn("faults", faults).withColumn("complete", F.size("faults") == 0)
    return out.drop("__last", "ended", "ended_by", "ended_trace", "line_faults", "repeated", "known", *REQUIRED, *[f"n_{e}" for e in REQUIRED])


def _with_origin(reads: DataFrame, keys: Sequence[str], expected: DataFrame | None) -> DataFrame:
    """Whether a read's trace started before in its log, and whether it is one of the expected (keys, trace)."""
    before = Window.partitionBy(*keys, "trace").orderBy("start_line")
    reads = reads.withColumn("repeated", F.col("trace").isNotNull() & (F.row_number().over(before) > 1))
    if expected is None:
        return reads.withColumn("known", F.lit(True))
    known = expected.select(*keys, "trace").distinct().withColumn("known", F.lit(True))
    return reads.join(known, [*keys, "trace"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def read_records(lines: DataFrame, keys: Sequence[str] = ("log",), line: str = "line", order: str = "line_no", expected: DataFrame | None = None, width: int = 65_536) -> DataFrame:
    """A row for each start in a log (keys, start_line, end_line, trace, metrics, orientation, faults, complete)."""
    said = log_fields(lines, line).select(*keys, order, "event", "fields", "fault")
    bound = F.when(F.col("event").isin(START, END), F.struct(F.col(order).alias("line"), (F.col("event") == START).alias("opens")))
    told = running(said, keys, order, width, latest={"before": bound}, inclusive=False)
    opens, is_open = F.coalesce(F.col("event") == START, F.lit(False)), F.coalesce(F.col("before.opens"), F.lit(False))
    part = lambda cond, at, role: F.when(cond, F.struct(at.cast("long").alias("start_line"), F.lit(role).alias("role")))
    roles = F.filter(F.array(part(is_open, F.col("before.line"), "inside"), part(opens, F.col(order), "start")), lambda x: x.isNotNull())
    each = told.withColumn("__r", F.explode(roles)).select(*keys, "__r.*", order, "event", "fields", "fault")
    inside = F.col("role") == "inside"
    ends = inside & F.col("event").isin(START, END)
    first = lambda what, cond: F.min_by(what, F.when(cond, F.col(order)))
    held = [x for e in REQUIRED for x in (first("fields", inside & (F.col("event") == e)).alias(e), F.count_if(inside & (F.col("event") == e)).alias(f"n_{e}"))]
    trace = F.try_element_at("fields", F.lit(TRACE))
    reads = each.groupBy(*keys, "start_line").agg(first(trace, F.col("role") == "start").alias("trace"), F.min(F.when(ends, F.col(order))).cast("long").alias("end_line"), first("event", ends).alias("ended_by"), first(trace, ends).alias("ended_trace"), first("fields", ends).alias("ended"), F.count_if(F.col("fault").isNotNull() & ~(ends & (F.col("event") == START))).alias("line_faults"), *held)
    return judged(_with_origin(reads, keys, expected))


def missing_reads(records: DataFrame, expected: DataFrame, keys: Sequence[str] = ("log",)) -> DataFrame:
    """Expected (keys, trace) that no complete read of the log has."""
    return expected.select(*keys, "trace").distinct().join(records.where("complete").select(*keys, "trace"), [*keys, "trace"], "left_anti")


STATE = "read string"


def _ended(read: dict, event: str | None, fields: dict | None, line: int | None) -> dict:
    return read | {"end_line": line, "ended_by": event, "ended_trace": (fields or {}).get(TRACE), "ended": fields}


def fold(lines: Iterator[tuple[int, str | None, dict, str | None]], read: dict | None) -> tuple[list[dict], dict | None]:
    """Reads that lines (order, event, fields, fault) end, and the one that is still open."""
    out = []
    for order, event, fields, fault in lines:
        if read is not None:
            if event != START and fault:
                read["line_faults"] += 1
            if event in REQUIRED:
                read["n"][event] = read["n"].get(event, 0) + 1
                read["fields"].setdefault(event, fields)
        if event in (START, END):
            if read is not None:
                out.append(_ended(read, event, fields, order))
            read = {"start_line": order, "trace": fields.get(TRACE), "line_faults": int(fault is not None), "n": {}, "fields": {}} if event == START else None
    return out, read


def stream_records(lines: DataFrame, key: str = "log", line: str = "line", order: str = "line_no") -> DataFrame:
    """read_records() of a stream of lines that come in order within their log: a read is given when it ends. The state of a log
    is its open read. Whether a trace has started before is left to a batch over what was given."""
    ship(lines.sparkSession)
    said = log_fields(lines, line).select(F.col(key).cast("string").alias("log"), F.col(order).cast("long").alias("line_no"), "event", F.to_json("fields").alias("fields"), "fault")
    kinds = f"log string, start_line long, trace string, end_line long, ended_by string, ended_trace string, ended {FIELDS}, line_faults long, " + ", ".join(f"{e} {FIELDS}, n_{e} long" for e in REQUIRED)

    def each(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("line_no")
        read = json.loads(state.get[0]) if state.exists else None
        ended, read = fold(((int(r.line_no), r.event, json.loads(r.fields or "{}"), r.fault) for r in rows.itertuples()), read)
        if read is None:
            state.remove()
        else:
            state.update((json.dumps(read),))
        columns = [x.strip().split()[0] for x in kinds.split(", ")]
        flat = [{"log": name[0], **{k: v for k, v in x.items() if k not in ("n", "fields")}, **{e: x["fields"].get(e) for e in REQUIRED}, **{f"n_{e}": x["n"].get(e, 0) for e in REQUIRED}} for x in ended]
        yield pd.DataFrame(flat, columns=columns)

    reads = said.groupBy("log").applyInPandasWithState(each, kinds, STATE, "append", GroupStateTimeout.NoTimeout)
    return judged(reads.withColumn("repeated", F.lit(False)).withColumn("known", F.lit(True)))
