"""Driver queries of matching, logs, measurement rows, counters and phase evidence, added to the catalogue."""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import functions as F

from lociflow.operators import counters as K
from lociflow.operators import logs as L
from lociflow.operators import matching as M
from lociflow.operators import research as R
from lociflow.operators import samples as S
from lociflow.operators.held import held, shared_folder
from lociflow.operators.ranks import select_ranks
from lociflow.operators.recomputed import document_differences as differences
from lociflow.plans import bridges as B
from lociflow.plans.analysis import Tract
from lociflow.plans.analysis import phase_evidence as evidence
from lociflow.plans.catalog import query, rounded
from lociflow.sources import measurements as J
from lociflow.sources.corpus import ReferenceSequence

#: A reference with rows of one base, of two, and of three.
REPEATS = "ACCCCCTAGAGAGATCGTTTTACGACGACGTGCAATTGGCC"
SIZE, TURN = len(REPEATS), 20
#: The same circle, begun elsewhere, so that its seam lies inside.
TURNED = REPEATS[TURN:] + REPEATS[:TURN]

#: Of each order two events, written a few bases apart: deletions, insertions, a substitution against one with a base more. On
#: the line they begin within the first 30 bases, on the circle within the last 5.
EQUIVALENT_SQL = f"""WITH o AS (SELECT o_orderkey AS sample, o_custkey % 4 AS x, o_orderkey % 3 + 1 AS n, (o_custkey // 4) % 30 AS a, (o_orderkey // 32) % 4 AS b FROM orders),
e AS (SELECT sample, circle, x, n, p, p + CASE WHEN x < 2 THEN b ELSE 0 END AS q, s FROM (SELECT sample, false AS circle, x, n, a AS p, b, '{REPEATS}' AS s FROM o UNION ALL SELECT sample, true, x, n, 36 + a % 5 - 20, b, '{TURNED}' FROM o)),
t AS (SELECT sample, circle, CASE x WHEN 0 THEN substr(s, 1, p + 1) || substr(s, p + n + 2) WHEN 1 THEN substr(s, 1, p + 1) || substr(s, p + 2, n) || substr(s, p + 2) ELSE substr(s, 1, p) || 'G' || substr(s, p + 2) END AS truth,
CASE x WHEN 0 THEN substr(s, 1, q + 1) || substr(s, q + n + 2) WHEN 1 THEN substr(s, 1, q + 1) || substr(s, q + 2, n) || substr(s, q + 2) WHEN 2 THEN substr(s, 1, p) || 'G' || substr(s, p + 2) ELSE substr(s, 1, p) || 'T' || substr(s, p + 2) END AS called,
CASE WHEN x < 2 THEN p = q ELSE false END AS same FROM e)
SELECT sample, circle, CASE WHEN same THEN 'exact' WHEN truth = called THEN 'equivalent' ELSE 'missing' END AS status FROM t"""


@query(EQUIVALENT_SQL)
def equivalent_events(spark, d):
    """One event a side: status is `missing` where the two spell different sequences (then the call is extra)."""
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), (F.col("o_custkey") % 4).alias("x"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("n"), (F.floor(F.col("o_custkey") / 4) % 30).cast("int").alias("a"), (F.floor(F.col("o_orderkey") / 32) % 4).cast("int").alias("b"))
    out = []
    for circle, p in ((False, F.col("a")), (True, 36 + F.col("a") % 5)):
        part = lambda at, n: F.substr(F.lit(REPEATS + REPEATS), at + 1, n)
        event = lambda at, kind, known, new: F.struct(F.lit(kind).alias("kind"), (at + 1).alias("position"), known.alias("reference"), new.alias("alternate"))
        one, n = F.lit(1), F.col("n")

        def indel(at):
            taken, put = event(at, "DEL", part(at, n + 1), part(at, one)), event(at, "INS", part(at, one), part(at, n + 1))
            return F.when(F.col("x") == 0, taken).when(F.col("x") == 1, put)

        truth = F.coalesce(indel(p), event(p, "SNV", part(p, one), F.lit("G")))
        q = p + F.col("b")
        if circle:
            q = q % SIZE
        longer = event(p, "SNV", part(p, F.lit(2)), F.concat(F.when(F.col("x") == 2, "G").otherwise("T"), part(p + 1, one)))
        both = o.select("sample", truth.alias("t"), F.coalesce(indel(q), longer).alias("c"))
        t = both.select("sample", F.lit(0).alias("at"), "t.kind", "t.position", "t.reference", F.array("t.alternate").alias("alternates"))
        c = both.select("sample", F.lit(0).alias("at"), "c.*")
        out.append(M.compare(t, c, REPEATS, circle).where("status <> 'extra'").select("sample", F.lit(circle).alias("circle"), "status"))
    return out[0].unionByName(out[1])


#: Events of each order on a row of bases: one of two bases against two of one; two against two with other borders; five
#: against three; and two that spell something else. Each event is (side, first, bases).
CASES = {0: (("truth", 0, 2), ("called", 0, 1), ("called", 1, 1)), 1: (("truth", 0, 2), ("truth", 2, 1), ("called", 0, 1), ("called", 1, 2)), 2: (("truth", 0, 1), ("truth", 1, 2), ("truth", 3, 2), ("truth", 5, 2), ("truth", 7, 1), ("called", 0, 2), ("called", 2, 4), ("called", 6, 2)), 3: (("truth", 0, 2), ("called", 0, 1), ("called", 1, 1))}
BASES = ("ACGGTCATTGCAAGCTCCGATAGT" * 13)[:300]
RUN_ROWS = ", ".join(f"({case}, '{side}', {sum(s == side for s, _, _ in events[:i])}, {first}, {n})" for case, events in CASES.items() for i, (side, first, n) in enumerate(events))
RUN_SQL = f"""WITH g("case", side, "at", first, n) AS (VALUES {RUN_ROWS}), o AS (SELECT o_orderkey AS sample, o_custkey % 4 AS "case", CAST(o_custkey % 71 * 4 + 1 AS INT) AS p FROM orders),
e AS (SELECT sample, "case", side, "at", p + first AS position, substr('{BASES}', p + first, n) AS reference, translate(substr('{BASES}', p + first, n), 'ACGT', CASE WHEN "case" = 3 AND side = 'called' AND "at" = 1 THEN 'GTAC' ELSE 'CGTA' END) AS alternate, n FROM o JOIN g USING ("case"))"""


def _events(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), (F.col("o_custkey") % 4).cast("int").alias("case"), (F.col("o_custkey") % 71 * 4 + 1).cast("int").alias("p"))
    planned = F.create_map(*[x for case, events in CASES.items() for x in (F.lit(case), F.array(*[F.struct(F.lit(s).alias("side"), F.lit(sum(y == s for y, _, _ in events[:i])).alias("at"), F.lit(f).alias("first"), F.lit(n).alias("n")) for i, (s, f, n) in enumerate(events)]))])
    e = o.select("sample", "case", "p", F.explode(F.element_at(planned, F.col("case"))).alias("e")).select("sample", "case", "e.side", "e.at", (F.col("p") + F.col("e.first")).alias("position"), F.substr(F.lit(BASES), F.col("p") + F.col("e.first"), F.col("e.n")).alias("reference"), "e.n")
    odd = (F.col("case") == 3) & (F.col("side") == "called") & (F.col("at") == 1)
    e = e.withColumn("alternate", F.when(odd, F.translate("reference", "ACGT", "GTAC")).otherwise(F.translate("reference", "ACGT", "CGTA"))).withColumn("kind", F.when(F.col("n") == 1, "SNV").otherwise("MNV"))
    columns = ["sample", "at", "kind", "position", "reference"]
    return e, e.where("side = 'truth'").select(*columns, F.array("alternate").alias("alternates"), F.array(F.concat(F.col("position").cast("string"), "alternate")).alias("tokens")), e.where("side = 'called'").select(*columns, "alternate")


@query(RUN_SQL + """ SELECT sample, 1 AS "group", side, "at", position FROM e WHERE "case" <> 3""")
def haplotype_runs(spark, d):
    """Groups of 1:2, 2:2 and 5:3 events."""
    return M.run_events(_events(spark, d)[0].drop("case", "n", "kind"), BASES).select("sample", "group", "side", "at", "position")


@query(RUN_SQL + """, k AS (SELECT sample, "case", side, string_agg(CAST(position AS VARCHAR), ';' ORDER BY "at") AS positions, string_agg(CASE n WHEN 1 THEN 'SNV' ELSE 'MNV' END || ':' || position || ':' || reference || '>' || alternate, '|' ORDER BY "at") AS events, string_agg(position || alternate, '|' ORDER BY "at") AS tokens, CAST(count(*) AS INT) AS n FROM e WHERE NOT ("case" = 3) GROUP BY ALL),
one AS (SELECT sample, side, CAST(position AS VARCHAR) AS positions, CASE n WHEN 1 THEN 'SNV' ELSE 'MNV' END || ':' || position || ':' || reference || '>' || alternate AS events, position || alternate AS tokens FROM e WHERE "case" = 3)
SELECT t.sample, 'representation' AS difference, t.tokens AS truth_tokens, t.positions AS truth_positions, t.events AS truth_events, c.positions AS called_positions, c.events AS called_events, t.n AS truth_count, c.n AS called_count FROM k t JOIN k c ON t.sample = c.sample AND t.side = 'truth' AND c.side = 'called'
UNION ALL SELECT sample, CASE side WHEN 'truth' THEN 'missing' ELSE 'extra' END, CASE side WHEN 'truth' THEN tokens ELSE '' END, CASE side WHEN 'truth' THEN positions ELSE '' END, CASE side WHEN 'truth' THEN events ELSE '' END, CASE side WHEN 'called' THEN positions ELSE '' END, CASE side WHEN 'called' THEN events ELSE '' END, CAST(side = 'truth' AS INT), CAST(side = 'called' AS INT) FROM one""")
def match_differences(spark, d):
    _, truth, called = _events(spark, d)
    return M.difference_rows(M.held_matches(truth, called, BASES), truth, called)


@query(RUN_SQL + """, n AS (SELECT sample, any_value("case") AS x, count(*) FILTER (side = 'truth') AS t, count(*) FILTER (side = 'called') AS c FROM e GROUP BY sample)
SELECT sample, t AS truth_events, c AS called_events, CAST(x <> 3 AS BIGINT) AS matched_groups, CAST(x <> 3 AS BIGINT) AS representation_groups, CASE WHEN x <> 3 THEN t - 1 ELSE 0 END AS collapsed_truth_events, CASE WHEN x <> 3 THEN c - 1 ELSE 0 END AS collapsed_called_events, CASE WHEN x = 3 THEN t ELSE 0 END AS missing_groups, CASE WHEN x = 3 THEN c ELSE 0 END AS extra_groups, false AS exact_profile, CAST(x <> 3 AS INT)::DOUBLE AS precision, CAST(x <> 3 AS INT)::DOUBLE AS recall FROM n""")
def match_profiles(spark, d):
    _, truth, called = _events(spark, d)
    return M.profile_counts(M.compare(truth, called, BASES))


#: Events of a user as a log: a signup starts a read of a trace, a purchase completes one (of another trace for each fifth event),
#: the other three events are parts of it; each seventh lacks a number.
LOG_SQL = """WITH l AS (SELECT user_id, event_id AS line_no, CASE event_type WHEN 'signup' THEN 's' WHEN 'purchase' THEN 'e' ELSE ['b', 'g', 'q', 'a', 'w'][CAST(event_id % 5 AS INT) + 1] END AS k, event_id % 3 AS trace, event_id % 7 = 0 AS bare FROM events),
p AS (SELECT *, last_value(CASE WHEN k IN ('s', 'e') THEN line_no END IGNORE NULLS) OVER w AS opened, last_value(CASE WHEN k IN ('s', 'e') THEN k END IGNORE NULLS) OVER w AS prev FROM l WINDOW w AS (PARTITION BY user_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT user_id, opened AS start_line, line_no, k, trace, bare FROM p WHERE prev = 's'),
g AS (SELECT user_id, start_line, min(CASE WHEN k IN ('s', 'e') THEN line_no END) AS end_line, min_by(k, line_no) FILTER (k IN ('s', 'e')) AS ender, min_by(trace, line_no) FILTER (k IN ('s', 'e')) AS ended_trace, count(*) FILTER (k = 'b') AS b, count(*) FILTER (k = 'g') AS g, count(*) FILTER (k = 'q') AS q, count(*) FILTER (k = 'a') AS a, count(*) FILTER (k = 'w') AS w, min_by(bare, line_no) FILTER (k = 'b') AS bare FROM i GROUP BY ALL),
s AS (SELECT user_id, line_no AS start_line, trace, row_number() OVER (PARTITION BY user_id, trace ORDER BY line_no) > 1 AS repeated FROM l WHERE k = 's')
SELECT user_id, start_line, end_line, 't' || trace AS trace, CASE WHEN b > 0 AND NOT bare THEN 40 END::BIGINT AS calls, concat_ws(';', CASE WHEN repeated THEN 'repeated read' END, CASE WHEN coalesce(ender, '') <> 'e' THEN 'read did not complete' END, CASE WHEN ender = 'e' AND ended_trace <> trace THEN 'completed by another trace' END,
  CASE WHEN ender = 'e' AND b = 0 THEN 'basecalling_completed is missing' END, CASE WHEN ender = 'e' AND g = 0 THEN 'SECOND is missing' END, CASE WHEN ender = 'e' AND q = 0 THEN 'quality_control_completed is missing' END, CASE WHEN ender = 'e' AND a = 0 THEN 'alignment_completed is missing' END, CASE WHEN ender = 'e' AND w = 0 THEN 'warning_summary is missing' END,
  CASE WHEN b > 1 THEN 'basecalling_completed is repeated' END, CASE WHEN g > 1 THEN 'SECOND is repeated' END, CASE WHEN q > 1 THEN 'quality_control_completed is repeated' END, CASE WHEN a > 1 THEN 'alignment_completed is repeated' END, CASE WHEN w > 1 THEN 'warning_summary is repeated' END, CASE WHEN b > 0 AND bare THEN 'calls is no number from 1' END) AS faults
FROM s LEFT JOIN g USING (user_id, start_line)""".replace("SECOND", L.REQUIRED[1])


def log_lines(spark, d):
    """(user_id, line_no, line) of LOG_SQL's events."""
    e = B.table(spark, d, "events")
    k = (F.col("event_id") % 5).cast("int")
    said = [f"{L.REQUIRED[0]} calls=", f"{L.REQUIRED[1]} profiled_loci=12 noisy_calls=0", f"{L.REQUIRED[2]} trim=2..32 retained=30 retained_fraction=0.75", f"{L.REQUIRED[3]} orientation=Forward callable_columns=20 callable_identity=1.0 mismatches=0 gap_opens=0", f"{L.REQUIRED[4]} excluded_variant_candidates=0"]
    part = F.concat(F.get(F.lit(said), k), F.when((k == 0) & (F.col("event_id") % 7 != 0), "40").otherwise(F.lit("")))
    trace = F.concat(F.lit(" trace_sha256=t"), (F.col("event_id") % 3).cast("string"))
    body = F.when(F.col("event_type") == "signup", F.concat(F.lit(L.START), trace)).when(F.col("event_type") == "purchase", F.concat(F.lit(L.END), trace, F.lit(" orientation=forward"))).otherwise(part)
    return e.select("user_id", F.col("event_id").alias("line_no"), F.concat(F.lit("2024-01-01 00:00:00.000 | INFO     | x:1 - run_id=r event="), body).alias("line"))


@query(LOG_SQL)
def read_logs(spark, d):
    """Reads that a log opens and closes, with the rules that each breaks. Buckets of 64 lines, so that states cross them."""
    found = L.read_records(log_lines(spark, d), ["user_id"], width=64)
    return found.select("user_id", "start_line", "end_line", "trace", "calls", F.array_join("faults", ";").alias("faults"))


@query("""WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT g, max(CASE WHEN rn = greatest(1, CAST(ceil(0.05 * n) AS BIGINT)) THEN v END) AS p5, max(CASE WHEN rn = greatest(1, CAST(ceil(0.5 * n) AS BIGINT)) THEN v END) AS p50, max(CASE WHEN rn = greatest(1, CAST(ceil(0.99 * n) AS BIGINT)) THEN v END) AS p99 FROM r GROUP BY g""")
def selected_ranks(spark, d):
    """Ranks of three large groups by rounds of histograms."""
    li = B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"))
    return select_ranks(li, ["g"], "v", {"p5": 0.05, "p50": 0.5, "p99": 0.99})


#: Orders of a priority as measurement lines of a case; some break a rule.
LINES_SQL = """WITH o AS (SELECT o_orderpriority AS "case", o_orderkey % 50 AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS line_no FROM orders),
f AS (SELECT "case", arg_min(k = 6, line_no) FILTER (k NOT IN (1, 2)) AS odd FROM o GROUP BY ALL)
SELECT "case", line_no, CASE k WHEN 0 THEN 'position does not increase' WHEN 1 THEN 'no JSON object' WHEN 2 THEN 'empty row' WHEN 3 THEN 'read count differs' WHEN 4 THEN 'read repeated' WHEN 5 THEN 'unknown read' ELSE 'schema version' END AS rule FROM o WHERE k IN (0, 1, 2, 3, 4, 5, 7)
UNION ALL SELECT "case", line_no, 'identity changes' FROM o JOIN f USING ("case") WHERE k NOT IN (1, 2) AND (k = 6) <> odd UNION ALL SELECT "case", NULL, 'read without locus' FROM f"""


@query(LINES_SQL)
def measurement_rules(spark, d):
    """Lines that Spark has written, a file a case, read back with their numbers."""
    o, k = B.table(spark, d, "orders"), F.col("o_orderkey") % 50
    digest = lambda x: F.sha2(F.lit(x), 256)
    reads = F.when(k == 4, F.array(F.lit("r0"), F.lit("r0"))).when(k == 5, F.array(F.lit("r0"), F.lit("r9"))).otherwise(F.array(F.lit("r0"), F.lit("r1")))
    row = F.struct(
        F.when(k == 7, "other").otherwise(J.VERSION).alias("schema_version"), F.col("o_orderpriority").alias("sample_id"), F.when(k == 0, 0).otherwise(F.col("o_orderkey")).alias("position_1based"), F.lit("1").alias(J.IDENTITY[0]),
        digest("r").alias("reference_sha256"), F.when(k == 6, digest("d")).otherwise(digest("c")).alias("configuration_sha256"), F.when(k == 3, 3).otherwise(2).alias("reads"), F.transform(reads, lambda r: F.struct(r.alias("read_sha256"))).alias("observations"),
    )
    line = F.when(k == 1, "{").when(k == 2, "").otherwise(F.to_json(row))
    lines = o.select(F.col("o_orderpriority").alias("case"), "o_orderkey", line.alias("value")).repartition("case").sortWithinPartitions("case", "o_orderkey").drop("o_orderkey")
    folder = f"{shared_folder(spark)}/measurement-lines-{uuid.uuid4().hex}"
    lines.write.partitionBy("case").text(folder)
    rows = J.measurement_rows(J.numbered_lines(spark, folder), "case", width=256)
    expected = o.select(F.col("o_orderpriority").alias("case"), F.explode(F.lit(["r0", "r1", "r2"])).alias("read_sha256"))
    return J.row_faults(rows, expected).select("case", "line_no", "rule")


@query("""WITH t AS (SELECT CAST(o_orderkey // 100 AS VARCHAR) AS sample, o_orderkey % 100 + 1 AS p, o_custkey % 3 + 1 AS place FROM orders), g AS (SELECT sample, p, max(place) AS last, count(DISTINCT place) AS n, min(place) AS first FROM t GROUP BY ALL)
SELECT sample, CAST(p AS VARCHAR) || '.' || first || 'C' AS token, 'gap in inserted places' AS rule FROM g WHERE last <> n UNION ALL SELECT sample, CAST(p AS VARCHAR) || '.' || place || 'C', 'duplicate token' FROM t GROUP BY sample, p, place HAVING count(*) > 1""")
def insertion_gaps(spark, d):
    o = B.table(spark, d, "orders")
    place = F.concat((F.col("o_orderkey") % 100 + 1).cast("string"), F.lit("."), (F.col("o_custkey") % 3 + 1).cast("string"), F.lit("C"))
    t = o.select(F.floor(F.col("o_orderkey") / 100).cast("string").alias("sample"), place.alias("token"))
    return R.reviewer_faults(t, "sample", F.col("token"), "ACGT" * 30)


UNITS = ("cases", "fit_cases", "source_groups", "specimen_groups", "pcr_replicates", "sequencing_runs", "instruments", "reads", "phase_reads", "read_tracts")
UNIT_KEYS = ("partition", "holdout_group", "fit", "truth_class", "tract", "orientation", "amplicon", "interrupt")
UNIT_SQL = """WITH r AS (SELECT l_returnflag AS partition, l_linestatus AS holdout_group, l_partkey % 2 = 0 AS fit, l_linenumber % 2 AS truth_class, l_suppkey % 2 AS tract, l_partkey % 3 AS orientation, l_orderkey % 2 AS amplicon, CASE WHEN l_suppkey % 5 <> 0 THEN l_linenumber % 3 END AS interrupt, l_orderkey AS k, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, CAST(l_quantity AS INT) AS q FROM lineitem)
SELECT partition, holdout_group, fit, truth_class, tract, orientation, amplicon, interrupt, count(*) AS windows, CAST(sum(q) AS BIGINT) AS candidates, count(DISTINCT k) AS cases, count(DISTINCT CASE WHEN fit THEN k END) AS fit_cases, count(DISTINCT p) AS source_groups, count(DISTINCT CASE WHEN q > 25 THEN p END) AS specimen_groups, count(DISTINCT (p, s)) AS pcr_replicates,
count(DISTINCT s) AS sequencing_runs, count(DISTINCT q) AS instruments, count(DISTINCT (k, n)) AS reads, count(DISTINCT CASE WHEN q > 10 THEN (k, n) END) AS phase_reads, count(DISTINCT (k, tract)) AS read_tracts FROM r GROUP BY ALL"""


@query(UNIT_SQL)
def readiness_units(spark, d):
    """Twelve counters over eight keys."""
    li, c = B.table(spark, d, "lineitem"), F.col
    q = c("l_quantity").cast("int")
    rows = li.select(
        c("l_returnflag").alias("partition"), c("l_linestatus").alias("holdout_group"), (c("l_partkey") % 2 == 0).alias("fit"), (c("l_linenumber") % 2).alias("truth_class"), (c("l_suppkey") % 2).alias("tract"), (c("l_partkey") % 3).alias("orientation"),
        (c("l_orderkey") % 2).alias("amplicon"), F.when(c("l_suppkey") % 5 != 0, c("l_linenumber") % 3).alias("interrupt"), c("l_orderkey").alias("k"), c("l_partkey").alias("p"), c("l_suppkey").alias("s"), c("l_linenumber").alias("n"), q.alias("q"),
    )
    read = F.struct("k", "n")
    units = dict(zip(UNITS, (c("k"), F.when(c("fit"), c("k")), c("p"), F.when(c("q") > 25, c("p")), F.struct("p", "s"), c("s"), c("q"), read, F.when(c("q") > 10, read), F.struct("k", "tract")), strict=True))
    parts = dict.fromkeys(("cases", "fit_cases", "reads", "phase_reads", "read_tracts"), c("k")) | dict.fromkeys(("source_groups", "specimen_groups", "pcr_replicates"), c("p"))
    return K.distinct_units(rows, UNIT_KEYS, units, {"candidates": F.sum("q")}, parts).withColumnRenamed("rows", "windows")


@query(B.with_sql("observations") + """ SELECT sample, 'loci[' || position || '].topology.' || field AS path, stored, recomputed FROM (SELECT sample, position, count(*) AS n, count(*) FILTER (forward) AS f FROM observations GROUP BY ALL) t, LATERAL (VALUES ('reads', n + 1, n, position % 7 = 0), ('forward_reads', f - 1, f, position % 11 = 0)) v(field, stored, recomputed, planted) WHERE planted""")
def document_differences(spark, d):
    """Documents of samples with a read too much at each seventh place, and a forward read too few at each eleventh."""
    o = S.with_state(B.observations(spark, d))
    t = S.locus_topology(o, ["sample", "position"])
    t = t.withColumn("reads", F.col("reads") + (F.col("position") % 7 == 0).cast("int")).withColumn("forward_reads", F.col("forward_reads") - (F.col("position") % 11 == 0).cast("int"))
    topology = t.select("sample", "position", F.struct(*[x for x in t.columns if x not in ("sample", "position")]).alias("topology"))
    seen = o.groupBy("sample", "position").agg(F.collect_list(F.struct("read", "base", "reference", "forward")).alias("observations"))
    # a document of each 64 places: one of all places of a sample would be a row as large as the table
    loci = topology.join(seen, ["sample", "position"]).groupBy("sample", F.floor(F.col("position") / 64).alias("part"))
    documents = loci.agg(F.collect_list(F.struct("position", "topology", "observations")).alias("loci")).drop("part")
    return differences(documents)


COUNTER_SQL = B.with_sql("observations", "states") + """, l AS (SELECT sample, position, count(*) FILTER (held) AS n, count(*) FILTER (held AND forward) AS nf, count(*) FILTER (held AND NOT forward) AS nr, count(*) FILTER (forward) AS f, count(*) FILTER (NOT forward) AS r, count(*) FILTER (state = 'reference') AS ref, count(*) FILTER (state = 'alternate') AS alt, count(*) FILTER (state = 'unresolved') AS unr, count(*) FILTER (state = 'deletion') AS del FROM states GROUP BY ALL),
o AS (SELECT sample, count(*) FILTER (position % 11 = 0) AS noisy, count(*) FILTER (state <> 'deletion' AND held) AS eligible, count(*) FILTER (state <> 'deletion' AND NOT held) AS missing, count(*) FILTER (state = 'deletion') AS deletions, sum(CASE WHEN held THEN CAST(x0 > 0 AS INT) + CAST(x1 > 0 AS INT) + CAST(x2 > 0 AS INT) + CAST(x3 > 0 AS INT) ELSE 0 END) AS positive FROM states GROUP BY ALL)
SELECT l.sample, sum(n)::BIGINT AS profiled_locus_observations, sum(nf)::BIGINT AS profiled_locus_forward_reads, sum(nr)::BIGINT AS profiled_locus_reverse_reads, count(*) FILTER (n > 0) AS nucleotide_support_loci, count(*) FILTER (nf > 0 AND nr > 0) AS bidirectional_nucleotide_support_loci, round(sum(n), 4)::DOUBLE AS unweighted_nucleotide_profile_mass, count(*) FILTER (nf > 0) AS forward_profile_geometry_loci, sum(f)::BIGINT AS locus_forward_reads, sum(r)::BIGINT AS locus_reverse_reads,
sum(ref)::BIGINT AS locus_reference_reads, sum(alt)::BIGINT AS locus_alternate_reads, sum(unr)::BIGINT AS locus_unresolved_reads, sum(del)::BIGINT AS locus_deletion_reads, any_value(noisy) AS noisy_locus_observations, any_value(eligible) AS eligible_nucleotide_locus_observations, any_value(missing) AS missing_profile_locus_observations, any_value(deletions) AS deletion_event_locus_observations, any_value(positive)::BIGINT AS locus_positive_corrected_channels FROM l JOIN o USING (sample) GROUP BY l.sample"""


@query(COUNTER_SQL)
def sample_counters(spark, d):
    o = held(S.with_state(B.observations(spark, d)).withColumn("noisy", F.col("position") % 11 == 0).withColumn("corrected", F.col("weights")).withColumn("snrs", F.col("weights")))
    keys = ["sample", "position"]
    loci = S.locus_topology(o, keys).join(S.locus_support(o, keys), keys)
    found = K.sample_counters(loci, o, None, "sample")
    names = ("profiled_locus_observations", "profiled_locus_forward_reads", "profiled_locus_reverse_reads", "nucleotide_support_loci", "bidirectional_nucleotide_support_loci", "unweighted_nucleotide_profile_mass", "forward_profile_geometry_loci", *[f"locus_{x}_reads" for x in ("forward", "reverse", "reference", "alternate", "unresolved", "deletion")], "noisy_locus_observations", "eligible_nucleotide_locus_observations", "missing_profile_locus_observations", "deletion_event_locus_observations", "locus_positive_corrected_channels")
    return rounded(found.select("sample", *names), "unweighted_nucleotide_profile_mass", digits=4)


#: Users' events as calls on a circle of 320 with a tract of six; a window is 15 observations, each five.
TRACT = Tract("t", 300, 305, 302, "CCTCCC")
CIRCLE = ("ACGT" * 80)[:300] + TRACT.bases + ("ACGT" * 4)[:14]
PHASE_SQL = B.with_sql("series") + """, o AS (SELECT user_id, user_id % 2 = 1 AS reverse, i, CASE WHEN user_id % 2 = 1 THEN (640 + 330 - i) % 320 ELSE (i + 290) % 320 END AS position FROM series WHERE i < 320),
c AS (SELECT user_id, count(DISTINCT position) AS covered, max(i) AS latest FROM o WHERE position BETWEEN 300 AND 305 GROUP BY ALL),
p AS (SELECT o.user_id, count(*) FILTER (i > latest AND position NOT BETWEEN 300 AND 305 AND i % 9 <> 0) AS profiled FROM o JOIN c USING (user_id) GROUP BY ALL),
s AS (SELECT u.user_id, coalesce(covered, 0) AS covered, coalesce(profiled, 0) AS profiled FROM (SELECT DISTINCT user_id FROM o) u LEFT JOIN c USING (user_id) LEFT JOIN p USING (user_id))
SELECT user_id, CASE WHEN covered = 0 THEN 'no_tract_coverage' WHEN covered < 6 THEN 'incomplete_tract_coverage' WHEN profiled < 15 THEN 'no_complete_profile_window' ELSE 'measured' END AS status, CASE WHEN covered = 6 AND profiled >= 15 THEN (profiled - 15) // 5 + 1 ELSE 0 END AS windows FROM s"""


@query(PHASE_SQL)
def phase_evidence(spark, d):
    s = B.series(spark, d).where("i < 320")
    reverse = F.col("user_id") % 2 == 1
    position = F.when(reverse, (640 + 330 - F.col("i")) % 320).otherwise((F.col("i") + 290) % 320)
    name = [F.col("user_id").cast("string").alias("input_name"), F.lit("x").alias("input_sha256")]
    columns = s.select(*name, F.when(reverse, "reverse").otherwise("forward").alias("orientation"), position.alias("ref_pos0"), F.substr(F.lit(CIRCLE), (position + 1).cast("int"), F.lit(1)).alias("reference_base"), F.col("base").alias("query_base"), F.col("i").alias("call_index"))
    loci = s.where("i % 9 <> 0").select(*name, F.col("i").alias("call_index"), F.lit([0.25] * 4).alias("profile"))
    done = SimpleNamespace(columns=columns, loci=loci, alignments=columns.select("input_name", "input_sha256", F.lit(None).cast("string").alias("error_class")).distinct())
    found = evidence(done, ReferenceSequence("circle", CIRCLE, True), (TRACT,), size=15, keep=lambda df, name: held(df))
    windows = found["windows"].groupBy("input_name").agg(F.count("*").alias("windows"))
    return found["availability"].join(windows, "input_name", "left").select(F.col("input_name").cast("long").alias("user_id"), "status", F.coalesce("windows", F.lit(0)).alias("windows"))
