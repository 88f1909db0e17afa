"""Driver queries of the engine, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.operators import alignment as A
from lociflow.operators import calls as C
from lociflow.operators import matching as M
from lociflow.operators import phase as H
from lociflow.operators import research as R
from lociflow.operators import samples as S
from lociflow.operators import windows as W
from lociflow.operators.held import held
from lociflow.plans import bridges as B
from lociflow.sources import abif

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ID = ["user_id"]


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- bases and strings


@query(B.with_sql("sequences") + " SELECT doc_id, part, reverse(translate(bases, 'ACGT', 'TGCA')) AS reverse_complement FROM sequences")
def revcomp(spark, d):
    return B.sequences(spark, d).select("doc_id", "part", X.reverse_complement(F.col("bases")).alias("reverse_complement"))


#: Codes of two letters, in any order, and of one; other pairs are N.
CODES_SQL = "CASE WHEN a = b THEN a WHEN least(a, b) || greatest(a, b) = 'AC' THEN 'M' WHEN least(a, b) || greatest(a, b) = 'AG' THEN 'R' WHEN least(a, b) || greatest(a, b) = 'AT' THEN 'W' WHEN least(a, b) || greatest(a, b) = 'CG' THEN 'S' WHEN least(a, b) || greatest(a, b) = 'CT' THEN 'Y' ELSE 'K' END"


@query(f"""{B.with_sql("sequences")}, p AS (SELECT doc_id, substr(bases, i, 1) AS a, substr(bases, i + 1, 1) AS b FROM (SELECT doc_id, bases, unnest(range(1, length(bases))) AS i FROM sequences)) SELECT doc_id, {CODES_SQL} AS code, count(*) AS pairs FROM p GROUP BY ALL""")
def iupac_codes(spark, d):
    """Codes of all pairs of neighbours."""
    s = B.sequences(spark, d).where("length(bases) > 1")
    # a row for each pair of letters of a sequence, not for each pair of neighbours
    found = s.select("doc_id", X.neighbour_counts(F.col("bases")).alias("x")).select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.*").where("n > 0")
    return found.groupBy("doc_id", X.iupac_code(F.split("pair", "")).alias("code")).agg(F.sum("n").alias("pairs"))


@query("""WITH t(code, bases) AS (VALUES ('A','A'),('C','C'),('G','G'),('T','T'),('M','AC'),('R','AG'),('W','AT'),('S','CG'),('Y','CT'),('K','GT'),('V','ACG'),('H','ACT'),('D','AGT'),('B','CGT'),('N','ACGT')),
l AS (SELECT doc_id, upper(c) AS letter FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]')) AS c FROM documents)), n AS (SELECT doc_id, letter, count(*) AS n FROM l GROUP BY ALL) SELECT doc_id, letter, bases, n FROM n LEFT JOIN t ON letter = code""")
def iupac_expand(spark, d):
    """All letters of all texts, and what each stands for."""
    letters = B.table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), F.lit("[A-Z]"), F.lit(0))).alias("letter"))
    return letters.groupBy("doc_id", "letter").agg(F.count("*").alias("n")).withColumn("bases", F.array_join(X.iupac_bases(F.col("letter")), ""))


# --- traces


@query(B.with_sql("sequences") + " SELECT name AS input_name, 4 * length(bases) + 1 AS n_samples, length(bases) AS n_calls, bases AS vendor_primary, CAST(NULL AS VARCHAR) AS error_class FROM sequences")
def abif_roundtrip(spark, d):
    return abif.decode_traces(B.trace_files(spark, d)).select("input_name", F.size(F.col("channels")[0]).cast("long").alias("n_samples"), F.size("ploc").cast("long").alias("n_calls"), "vendor_primary", "error_class")


@query(B.with_sql("sequences") + """, t(entry, tag, number, element_type, element_size) AS (VALUES (0,'DATA',9,4,2),(1,'DATA',10,4,2),(2,'DATA',11,4,2),(3,'DATA',12,4,2),(4,'FWO_',1,2,1),(5,'PLOC',2,4,2),(6,'PBAS',2,2,1))
SELECT name AS input_name, entry, tag, number, element_type, element_size, CASE WHEN tag = 'DATA' THEN 4 * length(bases) + 1 WHEN tag = 'FWO_' THEN 4 ELSE length(bases) END AS element_count FROM sequences CROSS JOIN t""")
def abif_directory(spark, d):
    return abif.directory_entries(B.trace_files(spark, d)).drop("data_size", "data_offset")


@query(B.with_sql("sequences") + " SELECT name AS input_name, length(bases) AS n_calls, 4 * length(bases) + 1 AS n_samples, 4 AS min_spacing, 4.0::DOUBLE AS median_spacing, 4 AS max_spacing, 0 AS clipped_samples, false AS primary_length_differs FROM sequences WHERE length(bases) >= 2")
def abif_integrity(spark, d):
    return C.trace_integrity(abif.decode_traces(B.trace_files(spark, d))).drop("input_sha256", "quality_length_differs")


BASES_SQL = B.with_sql("sequences") + ", bases AS (SELECT doc_id, part, name, i - 1 AS call_index, substr(bases, i, 1) AS b, length(bases) AS n FROM (SELECT doc_id, part, name, bases, unnest(range(1, length(bases) + 1)) AS i FROM sequences WHERE length(bases) >= 2))"


@query(BASES_SQL + """ SELECT name AS input_name, call_index, 2 + 4 * call_index AS ploc, 4 * call_index AS w_start, 4 * call_index + 4 AS w_end, 2 + 4 * call_index AS primary_pos, b AS primary,
  CASE WHEN call_index <> 5 THEN b WHEN b = 'A' THEN 'A' WHEN b = 'C' THEN 'M' WHEN b = 'G' THEN 'R' ELSE 'W' END AS ambiguity, CASE WHEN call_index <> 5 OR b = 'A' THEN b ELSE b || 'A' END AS qualifying, true AS vendor_agrees FROM bases""")
def basecall(spark, d):
    names = ("call_index", "ploc", "w_start", "w_end", "primary_pos", "primary", "ambiguity", "qualifying", "vendor_agrees")
    found = C.call_bases(B.trace_files(spark, d), keys=("input_name",), columns=names)
    return found.withColumn("qualifying", F.array_join("qualifying", ""))


@query(BASES_SQL + """ SELECT name AS input_name, call_index, greatest(least(greatest(call_index - 4, 0), n - 10), 0) AS ctx_call_start, 2 + 4 * call_index AS event_position, round(CASE WHEN b = 'A' THEN 1.0 WHEN call_index = 5 THEN 400.0 / 1400.0 ELSE 0.0 END, 6)::DOUBLE AS weight_a FROM bases""")
def locus_profiles(spark, d):
    found = C.locus_evidence(B.trace_files(spark, d), keys=("input_name",), columns=("call_index", "ctx_call_start", "event_position", "profile"))
    return found.select("input_name", "call_index", "ctx_call_start", "event_position", F.round(F.col("profile")[0], 6).alias("weight_a"))


#: Ratios of height to noise of a run of ten calls: a channel's noise is 1 unless its steps spread, which they do where all ten
#: calls peak in it; the mixed call's second channel stands 400 high.
RUN_SQL = BASES_SQL + """, w AS (SELECT name, call_index, n, min(b) OVER v AS lo, max(b) OVER v AS hi, count(*) FILTER (b = 'A' OR call_index = 5) OVER v AS a, count(*) FILTER (call_index = 5 AND b <> 'A') OVER v AS mixed FROM bases WINDOW v AS (PARTITION BY name ORDER BY call_index ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
runs AS (SELECT name AS input_name, call_index AS w_start, call_index + 10 AS w_end, CASE WHEN lo = hi THEN round(0.67448975 * sqrt(2), 6) WHEN a = 10 AND call_index <= 5 THEN round(2.5 * 0.67448975 * sqrt(2), 6) ELSE 1000.0 END AS min_snr,
  CASE WHEN mixed = 0 THEN 0.0 WHEN a = 10 AND lo <> hi THEN round(0.67448975 * sqrt(2), 6) ELSE 400.0 END AS max_secondary_snr, lo = hi OR (a = 10 AND call_index <= 5) AS noisy FROM w WHERE call_index <= n - 10)"""


@query(RUN_SQL + " SELECT input_name, w_start, w_end, min_snr, max_secondary_snr, noisy FROM runs")
def call_windows(spark, d):
    return C.call_windows(B.trace_files(spark, d), keys=("input_name",)).select("input_name", "w_start", "w_end", "min_snr", "max_secondary_snr", "noisy")


def _reads(spark, d, edit) -> tuple[DataFrame, str]:
    """Reads cut from one reference at places that follow from their identifiers; `edit` changes their bases."""
    reference = "".join("ACGT"[(i * i * 7 + i * 3 + i // 5 + i // 17) % 4] for i in range(400))
    docs = B.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 300).alias("off"))
    # placing a read is heavy and its row small: deal the rows to all cores
    docs = docs.repartition(spark.sparkContext.defaultParallelism, "doc_id")
    reads = docs.select(F.col("doc_id").alias("read"), "off", F.substr(F.lit(reference), (F.col("off") + 1).cast("int"), F.lit(80)).alias("clean"))
    reads = reads.withColumn("query", edit(F.col("clean"), F.col("read")))
    one = lambda i: F.transform(F.lit([0, 1, 2, 3]), lambda k: (k == i).cast("double"))
    profiles = F.transform(F.split("query", ""), lambda b: F.when(X.canonical(b), one(F.instr(F.lit("ACGT"), b) - 1)))
    return reads.select("read", "off", "query", profiles.alias("profiles"), F.lit(0).alias("first_call")), reference


@query("SELECT doc_id AS read, CASE WHEN doc_id % 2 = 0 THEN 'forward' ELSE 'reverse' END AS orientation, doc_id % 300 AS start0, doc_id % 300 + 80 AS end0, 80 AS exact_matches, 0 AS mismatches, 0 AS gap_opens FROM documents")
def align_planted(spark, d):
    reads, reference = _reads(spark, d, lambda b, r: F.when(r % 2 == 0, b).otherwise(X.reverse_complement(b)))
    return A.align_reads(reads, reference).select("read", "orientation", "start0", "end0", "exact_matches", "mismatches", "gap_opens")


@query("SELECT doc_id AS read, (doc_id % 300 + 360) % 400 AS start0, (doc_id % 300 + 360) % 400 + 80 > 400 AS wraps_origin, 80 AS exact_matches FROM documents")
def align_circular(spark, d):
    reads, reference = _reads(spark, d, lambda b, r: b)
    return A.align_reads(reads, reference[40:] + reference[:40], circular=True).select("read", "start0", "wraps_origin", "exact_matches")


def full_reference(length: int = 16_569) -> str:
    """Bases of a linear congruential generator: as long as a mitochondrial genome, and without repeats of a read's length."""
    out, x = [], 12_345
    for _ in range(length):
        x = (x * 1_103_515_245 + 12_345) % 2**31
        out.append("ACGT"[x >> 16 & 3])
    return "".join(out)


@query("SELECT n_nationkey AS read, CASE WHEN n_nationkey % 2 = 0 THEN 'forward' ELSE 'reverse' END AS orientation, n_nationkey * 661 % 16569 AS start0, n_nationkey * 661 % 16569 + 700 > 16569 AS wraps_origin, 700 AS exact_matches FROM nation")
def align_full(spark, d):
    """Reads of 700 bases on a circle of 16,569, in either direction: the size that the latency gate is about."""
    bases = full_reference()
    nations = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("read")).repartition(spark.sparkContext.defaultParallelism, "read")
    clean = F.substr(F.lit(bases + bases), (F.col("read") * 661 % 16569 + 1).cast("int"), F.lit(700))
    reads = nations.withColumn("query", F.when(F.col("read") % 2 == 0, clean).otherwise(X.reverse_complement(clean)))
    one = lambda i: F.transform(F.lit([0, 1, 2, 3]), lambda k: (k == i).cast("double"))
    profiles = F.transform(F.split("query", ""), lambda b: one(F.instr(F.lit("ACGT"), b) - 1))
    placed = A.align_reads(reads.withColumn("profiles", profiles).withColumn("first_call", F.lit(0)), bases, circular=True)
    return placed.select("read", "orientation", "start0", "wraps_origin", "exact_matches")


@query("""SELECT doc_id AS read, 'SNV' AS kind, CAST(doc_id % 300 + 41 AS INT) AS position_1based, 1 AS n_supporting FROM documents""")
def variants_snv(spark, d):
    reads, reference = _reads(spark, d, lambda b, r: F.concat(F.substr(b, F.lit(1), F.lit(40)), F.translate(F.substr(b, F.lit(41), F.lit(1)), "ACGT", "CGTA"), F.substr(b, F.lit(42))))
    found = A.variants(A.alignment_columns(A.align_reads(reads, reference)), reference)
    return found.select("read", "kind", "position_1based", F.size("supporting").alias("n_supporting"))


#: The reference of _reads() and the event of each read, moved to the right as far as the bases allow: a deletion of three
#: bases behind the 40th, or an insertion of ACG there. Bases x and x + 3 of what follows (with ACG in front) are compared.
INDEL_SQL = """WITH r AS (SELECT string_agg(substr('ACGT', (i * i * 7 + i * 3 + i // 5 + i // 17) % 4 + 1, 1), '' ORDER BY i) AS ref FROM (SELECT unnest(range(0, 400)) AS i)),
t AS (SELECT doc_id AS read, doc_id % 2 = 0 AS del, CAST(doc_id % 300 + 40 AS INT) AS p, ref FROM documents, r), x AS (SELECT *, CASE WHEN del THEN substr(ref, p + 1) ELSE 'ACG' || substr(ref, p + 1) END AS s FROM t),
k AS (SELECT read, del, p, ref, s, min(CASE WHEN substr(s, CAST(j + 1 AS INT), 1) <> substr(s, CAST(j + 4 AS INT), 1) THEN j END) AS j FROM (SELECT *, unnest(range(0, 36)) AS j FROM x) GROUP BY ALL),
e AS (SELECT read, del, CAST(p + j AS INT) AS a, ref, substr(s, CAST(j + 1 AS INT), 3) AS b FROM k)"""


@query(INDEL_SQL + " SELECT read, CASE WHEN del THEN 'DEL' ELSE 'INS' END AS kind, a AS position_1based, CASE WHEN del THEN substr(ref, a, 1) || b ELSE substr(ref, a, 1) END AS reference, CASE WHEN del THEN substr(ref, a, 1) ELSE substr(ref, a, 1) || b END AS alternate, CASE WHEN del THEN 0 ELSE 3 END AS n_supporting, 2 AS n_flanking FROM e")
def variants_indel(spark, d):
    reads, reference = _reads(spark, d, _indel)
    return A.variants(A.alignment_columns(A.align_reads(reads, reference)), reference).select("read", "kind", "position_1based", "reference", "alternate", F.size("supporting").alias("n_supporting"), F.size("flanking").alias("n_flanking"))


def _indel(b, r):
    return F.when(r % 2 == 0, F.concat(F.substr(b, F.lit(1), F.lit(40)), F.substr(b, F.lit(44)))).otherwise(F.concat(F.substr(b, F.lit(1), F.lit(40)), F.lit("ACG"), F.substr(b, F.lit(41))))


@query(INDEL_SQL + " SELECT read, CASE WHEN del THEN 'DEL' ELSE 'INS' END AS kind, a AS position_1based, CASE WHEN del THEN 0 ELSE 3 END AS n_supporting, 0 AS reference_faults FROM e")
def variants_merged(spark, d):
    """Every event twice: equal ones become one, with each call once."""
    reads, reference = _reads(spark, d, _indel)
    found = A.variants(A.alignment_columns(A.align_reads(reads, reference)), reference)
    merged = held(A.merge_variants(found.withColumn("times", F.explode(F.lit([1, 2]))).drop("times")))  # two read it, and its reads are placed once
    faults = A.reference_faults(merged, reference).groupBy("read").agg(F.count("*").cast("int").alias("reference_faults"))
    return merged.join(faults, "read", "left").select("read", "kind", "position_1based", F.size("supporting").alias("n_supporting"), F.coalesce("reference_faults", F.lit(0)).alias("reference_faults"))


@query("""SELECT doc_id AS read, CASE WHEN doc_id % 300 + 41 BETWEEN 73 AND 340 THEN '' ELSE 'outside_configured_region' END || CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 300 + 41 BETWEEN 73 AND 340 THEN '' ELSE ';' END || 'peak_below_minimum' ELSE '' END AS reasons FROM documents""")
def variants_filtered(spark, d):
    reads, reference = _reads(spark, d, lambda b, r: F.concat(F.substr(b, F.lit(1), F.lit(40)), F.translate(F.substr(b, F.lit(41), F.lit(1)), "ACGT", "CGTA"), F.substr(b, F.lit(42))))
    found = held(A.variants(A.alignment_columns(A.align_reads(reads, reference)), reference))  # two read it, and its reads are placed once
    calls = found.select("read", F.explode("supporting").alias("call_index"), F.when(F.col("read") % 3 == 0, 100).otherwise(900).alias("highest_peak"), F.lit(50).alias("relative_quality"), F.lit(1).alias("n_qualifying"))
    return A.filter_variants(found, calls, [(73, 340)]).select("read", F.array_join("exclusion_reasons", ";").alias("reasons"))


# --- windows over one channel


@query(B.with_sql("series", "calls") + """, n AS (SELECT *, lag(ploc) OVER w AS p, lead(ploc) OVER w AS q FROM calls WINDOW w AS (PARTITION BY user_id ORDER BY call_index))
SELECT user_id, call_index, CASE WHEN p IS NULL THEN greatest(ploc - (q - ploc) // 2, 0) ELSE (p + ploc) // 2 END AS w_start, CASE WHEN q IS NULL THEN least(ploc + (ploc - p + 1) // 2, sample_count) ELSE (ploc + q) // 2 END AS w_end FROM n WHERE p IS NOT NULL OR q IS NOT NULL""")
def locus_windows(spark, d):
    return W.locus_windows(B.calls(spark, d), ID).select("user_id", "call_index", "w_start", "w_end")


@query(B.with_sql("series") + ", n AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM series WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, i, v FROM n WHERE v > 0 AND ((l <= v AND v > r) OR (l < v AND v >= r))")
def local_maxima(spark, d):
    return W.local_maxima(B.series(spark, d), ID, "i", "v").where("is_peak").select("user_id", "i", "v")


@query(B.with_sql("series") + """, n AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM series WINDOW w AS (PARTITION BY user_id ORDER BY i)), p AS (SELECT user_id, i // 16 AS locus, i, v FROM n WHERE v > 0 AND ((l <= v AND v > r) OR (l < v AND v >= r)))
SELECT user_id, locus, i AS event_position FROM p QUALIFY row_number() OVER (PARTITION BY user_id, locus ORDER BY abs(i - (locus * 16 + 8)), v DESC, i) = 1""")
def nearest_event(spark, d):
    peaks = W.local_maxima(B.series(spark, d), ID, "i", "v").where("is_peak").withColumn("locus", F.floor(F.col("i") / 16))
    return W.nearest_event(peaks, ["user_id", "locus"], F.col("locus") * 16 + 8, "i", "v")


@query(B.with_sql("series", "calls") + " SELECT user_id, call_index, least(greatest(call_index - 4, 0), greatest(count(*) OVER (PARTITION BY user_id) - 10, 0)) AS context_start FROM calls")
def context_windows(spark, d):
    return W.context_starts(B.calls(spark, d), ID, 10).select("user_id", "call_index", "context_start")


@query(B.with_sql("series") + " SELECT user_id, i, median(v) OVER w AS baseline FROM series WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) QUALIFY count(*) OVER w = 10")
def rolling_baseline(spark, d):
    return W.rolling_baseline(B.series(spark, d), ID, "i", "v", 10).select("user_id", "i", "baseline")


@query(B.with_sql("series") + """, g AS (SELECT user_id, i, v, v - lag(v) OVER (PARTITION BY user_id ORDER BY i) AS d FROM series), m AS (SELECT user_id, median(d) AS m FROM g GROUP BY ALL)
SELECT user_id, median(v) AS baseline, round(greatest(median(abs(d - m)) / (0.67448975 * sqrt(2)), 1.0), 6) AS noise FROM g JOIN m USING (user_id) GROUP BY ALL HAVING count(*) >= 2""")
def channel_noise(spark, d):
    packed = B.series(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x.v).alias("v")).where("size(v) >= 2")
    return rounded(W.baseline_noise(packed, ID, "v"), "noise")


@query(B.with_sql("series") + """, n AS (SELECT user_id, i AS s, v < 40 AS noisy, v FROM series), b AS (SELECT *, sum(CASE WHEN noisy AND coalesce(lag_noisy, false) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s) AS run FROM (SELECT *, lag(noisy) OVER (PARTITION BY user_id ORDER BY s) AS lag_noisy FROM n))
SELECT user_id, min(s) AS region_start, max(s) + 5 AS region_end, count(*) AS n_windows, min(v) AS min_snr FROM b WHERE noisy GROUP BY user_id, run HAVING count(*) >= 2""")
def noisy_regions(spark, d):
    w = B.series(spark, d).select("user_id", F.col("i").alias("w_start"), (F.col("i") + 5).alias("w_end"), (F.col("v") < 40).alias("noisy"), F.col("v").alias("min_snr"))
    return W.noisy_regions(w, ID, 2)


PENALTY_SQL = B.with_sql("series", "calls") + """, g AS (SELECT *, ploc - lag(ploc) OVER (PARTITION BY user_id ORDER BY call_index) AS gap FROM calls), mean AS (SELECT user_id, avg(gap) AS mean, count(*) AS n FROM g GROUP BY ALL),
penalties AS (SELECT a.user_id, a.call_index, count(*) FILTER (b.ambiguity = 'N') + coalesce(CAST(floor((abs(max(b.gap) FILTER (b.call_index > greatest(a.call_index - 5, 0)) - any_value(mean)) + abs(min(b.gap) FILTER (b.call_index > greatest(a.call_index - 5, 0)) - any_value(mean))) / 2) AS BIGINT), 0) AS penalty, any_value(n) AS n
FROM g a JOIN g b ON a.user_id = b.user_id AND b.call_index BETWEEN greatest(a.call_index - 5, 0) AND greatest(a.call_index - 5, 0) + 9 JOIN mean ON mean.user_id = a.user_id GROUP BY a.user_id, a.call_index)"""
BEST_SQL = PENALTY_SQL + """, sums AS (SELECT a.user_id, a.call_index AS s, sum(b.penalty) AS total, any_value(greatest(1, CAST(floor(a.n * 0.1) AS INT))) AS len FROM penalties a JOIN penalties b ON a.user_id = b.user_id AND b.call_index >= a.call_index AND b.call_index < a.call_index + greatest(1, CAST(floor(a.n * 0.1) AS INT)) GROUP BY a.user_id, a.call_index HAVING count(*) = any_value(greatest(1, CAST(floor(a.n * 0.1) AS INT)))),
best AS (SELECT user_id, s AS best_start, s + len AS best_end, total AS best_sum FROM sums QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY total, s) = 1)"""


def _penalties(spark, d):
    return W.penalties(B.calls(spark, d), ID, 10)


@query(PENALTY_SQL + " SELECT user_id, call_index, penalty FROM penalties")
def qc_penalty(spark, d):
    return _penalties(spark, d).select("user_id", "call_index", "penalty")


@query(BEST_SQL + " SELECT user_id, best_start, best_end, CAST(best_sum AS BIGINT) AS best_sum FROM best")
def qc_best_section(spark, d):
    return W.best_section(_penalties(spark, d), ID, 0.1).select("user_id", "best_start", "best_end", "best_sum")


@query(PENALTY_SQL + " SELECT user_id, call_index, CASE WHEN max(penalty) OVER (PARTITION BY user_id) <= 0 THEN 60 ELSE CAST(floor(60 * least(greatest(1 - penalty / max(penalty) OVER (PARTITION BY user_id), 0.0), 1.0)) AS INT) END AS relative_quality FROM penalties")
def qc_score(spark, d):
    return W.relative_quality(_penalties(spark, d), ID, 60).select("user_id", "call_index", "relative_quality")


@query(BEST_SQL + """, rolled AS (SELECT p.user_id, p.call_index AS i, sum(p.penalty) OVER (PARTITION BY p.user_id ORDER BY p.call_index ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s, p.n, b.* EXCLUDE (user_id) FROM penalties p JOIN best b USING (user_id))
SELECT user_id, coalesce(max(CASE WHEN i < best_start AND s > 1.2 * best_sum / (best_end - best_start) * 10 THEN least(i + 10, best_start) END), 0) AS trim_start, coalesce(min(CASE WHEN i >= best_end AND s > 1.2 * best_sum / (best_end - best_start) * 10 THEN i END), max(n)) AS trim_end FROM rolled GROUP BY user_id""")
def qc_trim(spark, d):
    p = _penalties(spark, d)
    return W.trim(p, W.best_section(p, ID, 0.1), ID, 10, 1.2, 20).select("user_id", "trim_start", "trim_end")


# --- intervals and reads


@query(B.with_sql("segments") + """, e AS (SELECT sample, seg_start AS pos, CAST(forward AS INT) AS f, CAST(NOT forward AS INT) AS r FROM segments UNION ALL SELECT sample, seg_end, -CAST(forward AS INT), -CAST(NOT forward AS INT) FROM segments), s AS (SELECT sample, pos, sum(f) AS f, sum(r) AS r FROM e GROUP BY ALL),
c AS (SELECT sample, pos AS start, lead(pos) OVER w AS "end", sum(f) OVER w AS f, sum(r) OVER w AS r FROM s WINDOW w AS (PARTITION BY sample ORDER BY pos)), k AS (SELECT * FROM c WHERE "end" IS NOT NULL AND f + r > 0),
i AS (SELECT *, sum(CASE WHEN pe = start AND pf = f AND pr = r THEN 0 ELSE 1 END) OVER (PARTITION BY sample ORDER BY start) AS g FROM (SELECT *, lag("end") OVER v AS pe, lag(f) OVER v AS pf, lag(r) OVER v AS pr FROM k WINDOW v AS (PARTITION BY sample ORDER BY start)))
SELECT sample, min(start) AS start, max("end") AS "end", CAST(f + r AS BIGINT) AS reads, CAST(f AS BIGINT) AS forward_reads, CAST(r AS BIGINT) AS reverse_reads FROM i GROUP BY sample, g, f, r""")
def coverage_depth(spark, d):
    return W.coverage_depth(B.segments(spark, d), ["sample"])


@query(B.with_sql("segments") + """, m AS (SELECT sample, read % 400 AS read, seg_start, seg_end, max(seg_end) OVER (PARTITION BY sample, read % 400 ORDER BY seg_start, seg_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM segments) SELECT sample, read, seg_start, seg_end, 'overlapping' AS fault FROM m WHERE seg_start < reach""")
def segment_check(spark, d):
    s = B.segments(spark, d).withColumn("read", F.col("read") % 400)
    return W.segment_faults(s, ["sample", "read"]).select("sample", "read", "seg_start", "seg_end", "fault")


@query(B.with_sql("observations") + """, p AS (SELECT a.sample, a.read AS left_read, b.read AS right_read, a.base AS x, b.base AS y FROM observations a JOIN observations b ON a.sample = b.sample AND a.position = b.position AND a.read < b.read),
g AS (SELECT sample, left_read, right_read, count(*) AS shared, count(*) FILTER (x IN ('A','C','G','T') AND y IN ('A','C','G','T')) AS comparable, count(*) FILTER (x IN ('A','C','G','T') AND x = y) AS agreements FROM p GROUP BY ALL)
SELECT *, comparable - agreements AS conflicts, round(agreements / nullif(comparable, 0), 6) AS agreement, concat_ws(';', CASE WHEN comparable < 25 THEN 'insufficient_comparable_bases' END, CASE WHEN coalesce(agreements / nullif(comparable, 0) < 0.5, true) THEN 'agreement_below_minimum' END) AS reasons, comparable >= 25 AND coalesce(agreements / nullif(comparable, 0) >= 0.5, false) AS eligible FROM g""")
def read_overlaps(spark, d):
    return rounded(S.overlaps(B.observations(spark, d), "sample", "read", "position", "base"), "agreement")


@query(B.with_sql("observations", "states") + " SELECT sample, position, read, state FROM states WHERE (sample, position) IN (SELECT (sample, position) FROM states WHERE state <> 'reference')")
def differential_loci(spark, d):
    return S.differential_loci(S.with_state(B.observations(spark, d)), "sample", "position").select("sample", "position", "read", "state")


@query(B.with_sql("observations", "states") + """ SELECT sample, position, count(*) AS reads, count(*) FILTER (forward) AS forward_reads, count(*) FILTER (NOT forward) AS reverse_reads, count(*) FILTER (state = 'reference') AS reference_reads, count(*) FILTER (state = 'alternate') AS alternate_reads, count(*) FILTER (state = 'deletion') AS deletion_reads,
count(*) FILTER (state = 'unresolved') AS unresolved_reads, count(*) FILTER (state = 'alternate' AND forward) AS alternate_forward, count(*) FILTER (state = 'alternate' AND NOT forward) AS alternate_reverse FROM states GROUP BY ALL""")
def locus_topology(spark, d):
    return S.locus_topology(S.with_state(B.observations(spark, d)), ["sample", "position"])


SUPPORT_SQL = B.with_sql("observations") + """, w AS (SELECT sample, position, forward, x0 / xs AS a, x1 / xs AS c, x2 / xs AS g, x3 / xs AS t FROM observations WHERE held),
m AS (SELECT sample, position, count(*) AS n, count(*) FILTER (forward) AS nf, avg(a) AS a, avg(c) AS c, avg(g) AS g, avg(t) AS t, avg(1 - a*a - c*c - g*g - t*t) AS within, avg(a) FILTER (forward) AS fa, avg(c) FILTER (forward) AS fc, avg(g) FILTER (forward) AS fg, avg(t) FILTER (forward) AS ft,
avg(a) FILTER (NOT forward) AS ra, avg(c) FILTER (NOT forward) AS rc, avg(g) FILTER (NOT forward) AS rg, avg(t) FILTER (NOT forward) AS rt FROM w GROUP BY ALL)"""


@query(SUPPORT_SQL + " SELECT sample, position, n AS total_contributors, nf AS forward_contributors, round(a, 6) AS mean_a, round(within, 6) AS within, round(1 - a*a - c*c - g*g - t*t, 6) AS total, round((abs(fa - ra) + abs(fc - rc) + abs(fg - rg) + abs(ft - rt)) / 2, 6) AS directional_distance FROM m")
def locus_support(spark, d):
    s = S.locus_support(B.observations(spark, d), ["sample", "position"]).where("total_contributors > 0")
    out = s.select("sample", "position", "total_contributors", "forward_contributors", F.col("total_mean")[0].alias("mean_a"), F.col("total_within").alias("within"), F.col("total_total").alias("total"), "directional_distance")
    return rounded(out, "mean_a", "within", "total", "directional_distance")


@query(SUPPORT_SQL + " SELECT sample, position, round(greatest(1 - a*a - c*c - g*g - t*t - within, 0), 5) AS between_reads FROM m")
def heterogeneity(spark, d):
    s = S.locus_support(B.observations(spark, d), ["sample", "position"]).where("total_contributors > 0")
    return s.select("sample", "position", F.round(F.greatest("total_between", F.lit(0.0)), 5).alias("between_reads"))


@query(B.with_sql("observations", "states") + """ SELECT sample, position, base AS alternate, count(*) AS reads, count(*) FILTER (forward) AS forward_reads, count(*) FILTER (NOT forward) AS reverse_reads, count(*) FILTER (held) AS eligible_reads, count(*) FILTER (held AND forward) AS eligible_forward, count(*) FILTER (held AND NOT forward) AS eligible_reverse, false AS repeated_read
FROM states WHERE state = 'alternate' GROUP BY ALL""")
def variant_topology(spark, d):
    found = S.with_state(B.observations(spark, d)).where("state = 'alternate'").select("sample", "position", F.col("base").alias("alternate"), "read", "forward", F.col("weights").isNotNull().alias("eligible"))
    return S.variant_topology(found, ["sample", "position", "alternate"])


REGIONS = [("hv1", 500, 900), ("hv2", 880, 1400), ("hv3", 4000, 4100)]


@query(B.with_sql("segments") + ", regions(region, a, b) AS (VALUES ('hv1', 500, 900), ('hv2', 880, 1400), ('hv3', 4000, 4100)) SELECT sample, region, count(*) AS reads FROM segments JOIN regions ON seg_start >= a AND seg_start < b GROUP BY ALL")
def region_membership(spark, d):
    regions = spark.createDataFrame(REGIONS, "region string, a long, b long")
    samples = B.segments(spark, d).withColumn("chromosome", F.lit(1))
    held = S.interval_join(samples, regions.withColumn("chromosome", F.lit(1)), ["chromosome"], "seg_start", "a", "b", 256)
    return held.groupBy("sample", "region").agg(F.count("*").alias("reads"))


# --- phase

MEMBER_SQL = B.with_sql("series", "phase") + """, h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY distance) AS rn, count(*) OVER (PARTITION BY user_id) AS n, list_value(x0 / xs, x1 / xs, x2 / xs, x3 / xs) AS w FROM phase WHERE held AND base <> 'N'),
k AS (SELECT user_id, unnest(range(0, CAST(floor((max(n) - 25) / 5.0) AS BIGINT) + 1)) AS win FROM h GROUP BY user_id HAVING max(n) >= 25), mem AS (SELECT h.*, k.win FROM h JOIN k ON h.user_id = k.user_id AND h.rn BETWEEN 5 * win + 1 AND 5 * win + 25)"""
CAND_SQL = MEMBER_SQL + """, o AS (SELECT * FROM (SELECT unnest(range(-5, 6)) AS off) WHERE off <> 0), cd AS (SELECT m.user_id, m.win, o.off, m.base, p.base AS sb, m.w[strpos('ACGT', m.base)] AS z, m.w[nullif(strpos('ACGT', p.base), 0)] AS s FROM mem m CROSS JOIN o LEFT JOIN phase p ON p.user_id = m.user_id AND p.distance = m.distance + o.off),
cand AS (SELECT user_id, win, off, count(*) FILTER (sb IS NOT NULL AND sb <> 'N' AND sb <> base) AS informative, avg(z) FILTER (sb <> 'N' AND sb <> base) AS z, avg(s) FILTER (sb <> 'N' AND sb <> base) AS s, avg(greatest(0.0, 1 - z - s)) FILTER (sb <> 'N' AND sb <> base) AS r FROM cd GROUP BY ALL)"""


@query(MEMBER_SQL + ' SELECT user_id, win AS "window", min(distance) AS first_distance, max(distance) AS last_distance, count(*) AS observations, round(avg(1 - list_max(w)), 6) AS mean_impurity, round(avg(w[strpos(\'ACGT\', base)]), 6) AS mean_zero_mass FROM mem GROUP BY ALL')
def phase_windows(spark, d):
    return rounded(H.windows(H.members(B.phase_observations(spark, d), ID), ID), "mean_impurity", "mean_zero_mass")


def _candidates(spark, d):
    o = B.phase_observations(spark, d)
    return H.candidates(H.members(o, ID), o, ID)


@query(CAND_SQL + ' SELECT user_id, win AS "window", off AS "offset", informative, round(z, 6) AS mean_zero, round(s, 6) AS mean_shifted, round(r, 6) AS mean_residual FROM cand')
def phase_candidates(spark, d):
    return rounded(_candidates(spark, d), "mean_zero", "mean_shifted", "mean_residual")


@query(B.with_sql("series", "phase") + """, a AS (SELECT user_id, count(*) FILTER (distance <= 6) AS covered, count(*) FILTER (distance <= 6 AND base <> 'N') AS called, count(*) FILTER (distance > 6 AND held AND base <> 'N') AS profiled FROM phase GROUP BY ALL)
SELECT *, CASE WHEN covered = 0 THEN 'no_tract_coverage' WHEN covered < 6 THEN 'incomplete_tract_coverage' WHEN called = 0 THEN 'no_call_backed_tract_span' WHEN profiled < 25 THEN 'no_complete_profile_window' ELSE 'measured' END AS status FROM a""")
def phase_availability(spark, d):
    o = B.phase_observations(spark, d)
    inside = o.where("distance <= 6").select("user_id", F.col("distance").alias("position"), F.when(X.canonical(F.col("base")), F.col("distance")).alias("call_index"))
    return H.availability(inside, o.where("distance > 6"), ID, 6)


@query(CAND_SQL + ', p AS (SELECT *, lead(win) OVER v AS nw, abs(lead(z) OVER v - z) AS dz, abs(lead(s) OVER v - s) AS ds FROM cand WINDOW v AS (PARTITION BY user_id, off ORDER BY win)) SELECT user_id, win AS "window", off AS "offset", nw AS next_window, round(dz, 6) AS mean_zero_change, round(ds, 6) AS mean_shifted_change FROM p WHERE nw IS NOT NULL')
def persistence(spark, d):
    p = H.persistence(_candidates(spark, d), ID).select("user_id", "window", "offset", "next_window", "mean_zero_change", "mean_shifted_change")
    return rounded(p, "mean_zero_change", "mean_shifted_change")


@query(CAND_SQL + ', e AS (SELECT user_id, win, min(s) AS lo, max(s) AS hi, max(s / nullif(s + r, 0)) AS sh FROM cand GROUP BY ALL) SELECT user_id, win AS "window", round(lo, 6) AS mean_shifted_min, round(hi, 6) AS mean_shifted_max, round(hi - lo, 6) AS mean_shifted_range, round(sh, 6) AS shifted_share_max FROM e')
def envelope(spark, d):
    e = H.envelope(_candidates(spark, d), ID).select("user_id", "window", "mean_shifted_min", "mean_shifted_max", "mean_shifted_range", "shifted_share_max")
    return rounded(e, "mean_shifted_min", "mean_shifted_max", "mean_shifted_range", "shifted_share_max")


@query(CAND_SQL + ' SELECT off AS "offset", count(*) AS windows, sum(informative)::BIGINT AS informative, round(avg(z), 6) AS mean_zero, round(avg(s), 6) AS mean_shifted FROM cand GROUP BY ALL')
def trajectory(spark, d):
    return rounded(H.trajectory(_candidates(spark, d)).drop("mean_residual"), "mean_zero", "mean_shifted")


@query(B.with_sql("series", "phase") + """, h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY distance) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM phase WHERE held AND base <> 'N'), grid AS (SELECT * FROM (VALUES (15), (25)) a(size), (VALUES (5), (10)) b(step)),
k AS (SELECT user_id, size, step, unnest(range(0, CAST(floor((max(n) - size) / step::DOUBLE) AS BIGINT) + 1)) AS win FROM h CROSS JOIN grid GROUP BY user_id, size, step HAVING max(n) >= size), most(most) AS (VALUES (2), (5)), off AS (SELECT unnest(range(-5, 6)) AS o)
SELECT size, step, most, count(*) AS candidates FROM k CROSS JOIN most JOIN off ON o <> 0 AND abs(o) <= most GROUP BY ALL""")
def sensitivity_grid(spark, d):
    found = H.sensitivity(B.phase_observations(spark, d), ID, (15, 25), (5, 10), (2, 5))
    return found.groupBy("size", "step", "most").agg(F.count("*").alias("candidates"))


# --- research


@query("SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def research_join(spark, d):
    joined = B.table(spark, d, "orders").join(B.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT g, max(n) AS n, 0::BIGINT AS missing, min(v) AS min, round(avg(v), 4) AS mean, max(CASE WHEN rn = greatest(1, CAST(ceil(0.5 * n) AS BIGINT)) THEN v END) AS p50, max(CASE WHEN rn = greatest(1, CAST(ceil(0.9 * n) AS BIGINT)) THEN v END) AS p90, max(CASE WHEN rn = greatest(1, CAST(ceil(0.95 * n) AS BIGINT)) THEN v END) AS p95,
max(CASE WHEN rn = greatest(1, CAST(ceil(0.99 * n) AS BIGINT)) THEN v END) AS p99, max(v) AS max FROM r GROUP BY g""")
def metric_summary(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("v"))
    return rounded(S.metric_summary(o, ["g"], "v"), "mean", digits=4)


@query("""SELECT o_orderpriority, o_orderstatus, CASE WHEN GROUPING(o_orderpriority) = 1 THEN 'overall' ELSE 'group' END AS scope, count(*) AS rows, count(o_totalprice) AS n, round(min(o_totalprice), 2) AS min, round(avg(o_totalprice), 4) AS mean, round(max(o_totalprice), 2) AS max, count(*) FILTER (o_custkey % 2 = 0) AS fit_rows, round(avg(o_totalprice) FILTER (o_custkey % 2 = 0), 4) AS fit_mean
FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority, o_orderstatus))""")
def grouping_summary(spark, d):
    o = B.table(spark, d, "orders").withColumn("fit", F.col("o_custkey") % 2 == 0)
    return rounded(R.grouping_summary(o, ["o_orderpriority", "o_orderstatus"], "o_totalprice", "fit"), "mean", "fit_mean", digits=4)


BOUNDS_SQL = """WITH e AS (SELECT event_id, event_type, user_id % 7 AS bucket, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, bucket ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type, bucket) AS n FROM e),
b AS (SELECT event_type, bucket, max(n) AS stratum_n, max(CASE WHEN rn = greatest(1, CAST(ceil(0.05 * n) AS BIGINT)) THEN value END) AS low, max(CASE WHEN rn = greatest(1, CAST(ceil(0.95 * n) AS BIGINT)) THEN value END) AS high FROM r GROUP BY ALL)"""


def _strata(spark, d):
    return B.table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 7).alias("bucket"), "value")


@query(BOUNDS_SQL + " SELECT * FROM b")
def strata_bounds(spark, d):
    return R.strata_bounds(_strata(spark, d), ["event_type", "bucket"], "value")


@query(BOUNDS_SQL + " SELECT event_id, CASE WHEN stratum_n < 20 THEN 'unbenchmarked' WHEN value <= low THEN 'low' WHEN value >= high THEN 'high' ELSE 'typical' END AS flag FROM e JOIN b USING (event_type, bucket)")
def tail_flags(spark, d):
    e = _strata(spark, d)
    return R.tail_flags(e, R.strata_bounds(e, ["event_type", "bucket"], "value"), ["event_type", "bucket"], "value").select("event_id", "flag")


@query(B.with_sql("observations", "states") + """, q AS (SELECT DISTINCT sample AS case_id, position FROM states WHERE state = 'alternate' AND forward), f AS (SELECT sample AS case_id, read FROM states GROUP BY ALL HAVING avg(CAST(state = 'unresolved' AS INT)) > 0.05)
SELECT 'locus' AS item, case_id, position, CAST(NULL AS BIGINT) AS read, 'mixed' AS reason, CAST(count(*) OVER (PARTITION BY position) AS INT) AS recurrence FROM q UNION ALL SELECT 'read', case_id, NULL, read, 'flagged', NULL FROM f""")
def curation_queue(spark, d):
    s = S.with_state(B.observations(spark, d))
    loci = s.where("state = 'alternate' AND forward").select(F.col("sample").alias("case_id"), "position").distinct().withColumn("reason", F.lit("mixed"))
    flagged = s.groupBy(F.col("sample").alias("case_id"), "read").agg(F.avg((F.col("state") == "unresolved").cast("int")).alias("x")).where("x > 0.05").select("case_id", "read", F.lit("flagged").alias("reason"))
    return R.curation_queue(loci, flagged)


@query(B.with_sql("series") + " SELECT user_id, count(DISTINCT v % 40) AS positions, min(i) AS first_call, max(i) AS last_call FROM series WHERE v % 40 BETWEEN 3 AND 8 GROUP BY ALL HAVING count(DISTINCT v % 40) = 6")
def crossing_reads(spark, d):
    o = B.series(spark, d).select("user_id", (F.col("v") % 40).alias("position"), F.col("i").alias("call_index"))
    return R.crossing_reads(o, ID, "position", 3, 8)


@query(B.with_sql("observations") + " SELECT sample, position, count(*) FILTER (forward) AS with_role, count(*) FILTER (NOT forward) AS without_role FROM observations GROUP BY ALL HAVING count(*) FILTER (forward) > 0 AND count(*) FILTER (NOT forward) > 0")
def orientation_controls(spark, d):
    return R.matched_groups(B.observations(spark, d), ["sample", "position"], "forward")


@query(B.with_sql("observations") + """, m AS (SELECT sample, read, position, x0 / xs AS a FROM observations WHERE held) SELECT m.sample, m.read, m.position, round(p.a, 6) AS previous_mass, round(n.a, 6) AS next_mass FROM m LEFT JOIN m p ON p.sample = m.sample AND p.read = m.read AND p.position = (m.position + 1999) % 2000 LEFT JOIN m n ON n.sample = m.sample AND n.read = m.read AND n.position = (m.position + 1) % 2000""")
def neighbour_mass(spark, d):
    m = B.observations(spark, d).where("weights IS NOT NULL").select("sample", "read", "position", F.col("weights")[0].alias("a"))
    return rounded(S.neighbour_mass(m, ["sample", "read"], "position", "a", 2000), "previous_mass", "next_mass")


PLAN = {"1-URGENT": "development", "2-HIGH": "development", "3-MEDIUM": "holdout", "5-LOW": "excluded"}


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'development' WHEN '2-HIGH' THEN 'development' WHEN '3-MEDIUM' THEN 'holdout' WHEN '5-LOW' THEN 'excluded' ELSE 'unassigned' END AS partition FROM orders")
def partition_plan(spark, d):
    return R.partition_plan(B.table(spark, d, "orders"), "o_orderpriority", PLAN).select("o_orderkey", "partition")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AND bool_or(o_orderpriority = '3-MEDIUM')")
def partition_leaks(spark, d):
    return R.leaks(R.partition_plan(B.table(spark, d, "orders"), "o_orderpriority", PLAN), "o_custkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS rows, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY ALL")
def readiness(spark, d):
    units = {"orders": ["l_orderkey"], "parts": ["l_partkey"], "suppliers": ["l_suppkey"], "pairs": ["l_partkey", "l_suppkey"]}
    return R.readiness_counts(B.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], units)


@query("""WITH l AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0), r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice + CASE WHEN o_orderkey % 13 = 0 THEN 0.5 ELSE 0 END END AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT count(*) FILTER (r.k IS NULL) AS left_only, count(*) FILTER (l.k IS NULL) AS right_only, count(*) FILTER (l.k IS NOT NULL AND r.k IS NOT NULL) AS matched, count(*) FILTER (l.k IS NOT NULL AND r.k IS NOT NULL AND r.v IS NULL) AS presence_differences, round(max(abs(l.v - r.v)), 6) AS max_delta, false AS holds FROM l FULL OUTER JOIN r ON l.k = r.k""")
def parity_diff(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    changed = o.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 11 != 0, F.col("v") + F.when(F.col("k") % 13 == 0, 0.5).otherwise(0.0)))
    return rounded(R.parity(o.where("k % 7 <> 0"), changed, ["k"], ["v"]), "max_delta")


MATCH_SQL = """WITH t AS (SELECT l_returnflag AS sample, l_partkey AS position, row_number() OVER (PARTITION BY l_returnflag, l_partkey) AS n FROM lineitem WHERE l_linenumber <= 4), c AS (SELECT l_returnflag AS sample, l_partkey AS position, row_number() OVER (PARTITION BY l_returnflag, l_partkey) AS n FROM lineitem WHERE l_linenumber >= 3),
m AS (SELECT coalesce(t.sample, c.sample) AS sample, coalesce(t.position, c.position) AS position, CASE WHEN t.n IS NULL THEN 'extra' WHEN c.n IS NULL THEN 'missing' ELSE 'exact' END AS status FROM t FULL OUTER JOIN c ON t.sample = c.sample AND t.position = c.position AND t.n = c.n)"""


def _matches(spark, d):
    li = B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_partkey").alias("position"), "l_linenumber")
    return R.exact_matches(li.where("l_linenumber <= 4"), li.where("l_linenumber >= 3"), ["sample", "position"])


@query(MATCH_SQL + " SELECT sample, position, status, count(*) AS n FROM m GROUP BY ALL")
def exact_match(spark, d):
    return _matches(spark, d).groupBy("sample", "position", "status").agg(F.count("*").alias("n"))


@query(MATCH_SQL + ", s AS (SELECT sample, count(*) FILTER (status = 'exact') AS tp, count(*) FILTER (status = 'extra') AS fp, count(*) FILTER (status = 'missing') AS fn FROM m GROUP BY ALL) SELECT sample, tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM s")
def profile_evaluation(spark, d):
    return rounded(R.precision_recall(_matches(spark, d), ["sample"]).drop("true_negatives", "specificity"), "precision", "recall")


@query(B.with_sql("segments") + ", p AS (SELECT sample, read, seg_start AS position FROM segments), i AS (SELECT * FROM segments) SELECT p.sample, p.read AS event, count(*) AS memberships FROM p JOIN i ON p.sample = i.sample AND p.position >= i.seg_start AND p.position < i.seg_end GROUP BY ALL")
def footprint_join(spark, d):
    s = B.segments(spark, d)
    points = s.select("sample", F.col("read").alias("event"), F.col("seg_start").alias("position"))
    held = S.interval_counts(points, s.select("sample", "seg_start", "seg_end"), ["sample"], "position", "seg_start", "seg_end")
    return held.where("held > 0").groupBy("sample", "event").agg(F.sum("held").alias("memberships"))


@query("""WITH c AS (SELECT c_mktsegment AS difference, o_orderpriority AS partition, count(*) AS observations FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT c_mktsegment AS difference FROM customer) CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NONE')) p(partition))
SELECT difference, partition, coalesce(observations, 0) AS observations FROM g LEFT JOIN c USING (difference, partition)""")
def readiness_grid(spark, d):
    joined = B.table(spark, d, "orders").join(B.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = joined.groupBy(F.col("c_mktsegment").alias("difference"), F.col("o_orderpriority").alias("partition")).agg(F.count("*").alias("observations"))
    return R.readiness_grid(["1-URGENT", "2-HIGH", "9-NONE"], B.table(spark, d, "customer").select(F.col("c_mktsegment").alias("difference")), counts, ["difference"])


TOKEN_SQL = """WITH t AS (SELECT CAST(o_orderkey // 300 AS VARCHAR) AS sample, o_orderkey % 300 + 1 AS p, o_custkey % 3 AS k FROM orders), r AS (SELECT repeat('ACGT', 80) AS ref), gone AS (SELECT sample, p, p - row_number() OVER (PARTITION BY sample ORDER BY p) AS island FROM t WHERE k = 2),
g AS (SELECT sample, min(p) AS a, max(p) AS b FROM gone GROUP BY sample, island), e AS (SELECT sample, 'SNV' AS kind, CAST(p AS INT) AS position, substr(ref, CAST(p AS INT), 1) AS reference, CASE substr(ref, CAST(p AS INT), 1) WHEN 'A' THEN 'G' WHEN 'G' THEN 'A' ELSE 'A,G' END AS alternates FROM t, r WHERE k = 0
UNION ALL SELECT sample, 'INS', CAST(p AS INT), substr(ref, CAST(p AS INT), 1), substr(ref, CAST(p AS INT), 1) || 'C' FROM t, r WHERE k = 1
UNION ALL SELECT sample, 'DEL', CAST(CASE WHEN a = 1 THEN 320 ELSE a - 1 END AS INT), substr(ref, CAST(CASE WHEN a = 1 THEN 320 ELSE a - 1 END AS INT), 1) || substr(ref, CAST(a AS INT), CAST(b - a + 1 AS INT)), substr(ref, CAST(CASE WHEN a = 1 THEN 320 ELSE a - 1 END AS INT), 1) FROM g, r)"""


def _tokens(spark, d):
    """A token of each order: samples are runs of 300 orders, each order has a position of its own."""
    p, k = (1 + F.col("o_orderkey") % 300).cast("string"), F.col("o_custkey") % 3
    token = F.when(k == 0, F.concat(p, F.lit("R"))).when(k == 1, F.concat(p, F.lit(".1C"))).otherwise(F.concat(p, F.lit("DEL")))
    return B.table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 300).cast("string").alias("sample"), token.alias("token"))


@query(TOKEN_SQL + " SELECT * FROM e")
def token_events(spark, d):
    events = R.reviewer_events(_tokens(spark, d), "sample", F.col("token"), "ACGT" * 80)
    return events.withColumn("alternates", F.array_join("alternates", ","))


@query("""WITH t AS (SELECT CAST(o_orderkey // 300 AS VARCHAR) AS sample, o_orderkey % 300 + 1 AS p, o_custkey % 3 AS k, CAST(o_orderkey % 300 + 1 AS VARCHAR) || CASE o_custkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN '.1C' ELSE 'DEL' END AS token FROM orders)
SELECT sample, token, 'duplicate token' AS rule FROM t WHERE p % 60 = 7 UNION ALL SELECT sample, token || '?', 'unsupported token' FROM t WHERE p % 50 = 9 UNION ALL SELECT sample, '9' || token, 'position outside the reference' FROM t WHERE p BETWEEN 100 AND 110""")
def token_faults(spark, d):
    """Some tokens repeated, some with a character too much, some beyond the reference."""
    t = _tokens(spark, d).withColumn("p", F.regexp_extract("token", "^([0-9]+)", 1).cast("int"))
    odd = t.where("p % 60 = 7").unionByName(t.where("p % 50 = 9").withColumn("token", F.concat("token", F.lit("?")))).unionByName(t.where("p BETWEEN 100 AND 110").withColumn("token", F.concat(F.lit("9"), "token")))
    return R.reviewer_faults(t.unionByName(odd), "sample", F.col("token"), "ACGT" * 80)


@query(TOKEN_SQL + """, a AS (SELECT sample, kind, position, reference, unnest(string_split(alternates, ',')) AS alternate FROM e), c AS (SELECT sample, kind, position, reference, max(alternate) AS alternate FROM a WHERE position % 5 <> 0 GROUP BY ALL UNION ALL SELECT DISTINCT sample, 'SNV', position, 'A', 'T' FROM e WHERE position % 11 = 0)
SELECT kind, status, count(*) AS n FROM (SELECT e.kind, CASE WHEN c.alternate IS NULL THEN 'missing' ELSE 'exact' END AS status FROM e LEFT JOIN c ON e.sample = c.sample AND e.kind = c.kind AND e.position = c.position AND e.reference = c.reference AND list_contains(string_split(e.alternates, ','), c.alternate)
UNION ALL SELECT c.kind, 'extra' FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.sample = c.sample AND a.kind = c.kind AND a.position = c.position AND a.reference = c.reference AND a.alternate = c.alternate)) GROUP BY ALL""")
def reviewer_match(spark, d):
    """A caller that leaves out each fifth position, takes the last base of an ambiguous one, and adds events of its own."""
    truth = held(R.reviewer_events(_tokens(spark, d), "sample", F.col("token"), "ACGT" * 80))  # four read it
    called = truth.where("position % 5 <> 0").select("sample", "kind", "position", "reference", F.array_max("alternates").alias("alternate"))
    own = truth.where("position % 11 = 0").select("sample", F.lit("SNV").alias("kind"), "position", F.lit("A").alias("reference"), F.lit("T").alias("alternate")).distinct()
    return R.reviewer_matches(truth, called.unionByName(own)).groupBy("kind", "status").agg(F.count("*").alias("n"))


#: Two events that spell what one does, as far apart as the order says; each seventh order has a truth event of another base.
@query("""WITH t AS (SELECT o_orderkey AS sample, CAST(o_custkey % 70 * 4 + 1 AS INT) AS p, o_orderkey % 7 = 0 AS odd FROM orders) SELECT sample, 1 AS "group", 'truth' AS side, i AS at, CAST(p + i AS INT) AS position FROM t, (VALUES (0), (1)) n(i) WHERE NOT odd UNION ALL SELECT sample, 1, 'called', 0, p FROM t WHERE NOT odd""")
def haplotype_match(spark, d):
    p, odd = (F.col("o_custkey") % 70 * 4 + 1).cast("int"), F.col("o_orderkey") % 7 == 0
    event = lambda side, at, p, ref, alt: F.struct(F.lit(side).alias("side"), F.lit(at).alias("at"), p.alias("position"), F.lit(ref).alias("reference"), alt.alias("alternate"))
    events = F.array(event("truth", 0, p, "A", F.lit("T")), event("truth", 1, p + 1, "C", F.when(odd, "A").otherwise("G")), event("called", 0, p, "AC", F.lit("TG")))
    table = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.explode(events).alias("e")).select("sample", "e.*")
    return M.run_events(table, "ACGT" * 75).select("sample", "group", "side", "at", "position")


@query("""WITH e AS (SELECT user_id, event_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events), r AS (SELECT *, sum(CAST(event_type = 'signup' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS read_no FROM e)
SELECT user_id, CAST(read_no AS BIGINT) AS read_no, count(*) FILTER (event_type = 'click') AS clicks, max(k) AS most FROM r WHERE read_no > 0 GROUP BY ALL""")
def log_events(spark, d):
    e = B.table(spark, d, "events")
    name = F.when(F.col("event_type") == "signup", "sample_read_started").otherwise(F.col("event_type"))
    line = F.concat(F.lit('2024-01-01 00:00:00.000 | INFO | pipeline:1 - run_id="a b" event='), name, F.lit(" warnings="), F.get_json_object("props", "$.k"))
    found = R.log_events(e.select("user_id", F.col("event_id").alias("line_no"), line.alias("line")), keys=["user_id"]).where("read_no > 0")
    return found.groupBy("user_id", "read_no").agg(F.count_if(F.col("event") == "click").alias("clicks"), F.max(F.try_element_at("fields", F.lit("warnings")).cast("int")).alias("most"))


@query("""WITH e AS (SELECT user_id, event_id % 4 AS f FROM events) SELECT user_id, count(*) FILTER (f = 3) AS faults, count(*) FILTER (f <> 2) AS events FROM e GROUP BY ALL""")
def log_faults(spark, d):
    """Lines that repeat a key, and lines with fields in front of the marker only."""
    f = F.col("event_id") % 4
    line = F.concat(F.when(f == 2, "event=x | INFO | run=1").otherwise("t | INFO | event=y - event=view a=1"), F.when(f == 3, " a=2").otherwise(""))
    found = R.log_events(B.table(spark, d, "events").select("user_id", F.col("event_id").alias("line_no"), line.alias("line")), keys=["user_id"])
    return found.groupBy("user_id").agg(F.count("fault").alias("faults"), F.count_if(F.col("event") == "view").alias("events"))


@query("SELECT o_orderkey, sha256(concat_ws(chr(0), o_orderpriority, CAST(o_custkey AS VARCHAR))) AS difference_id FROM orders")
def difference_ids(spark, d):
    return B.table(spark, d, "orders").select("o_orderkey", X.difference_id(F.col("o_orderpriority"), F.col("o_custkey").cast("string")).alias("difference_id"))


@query(B.with_sql("series", "phase") + ", w AS (SELECT user_id, distance, x0/xs AS a, x1/xs AS c, x2/xs AS g, x3/xs AS t FROM phase WHERE held) SELECT user_id, distance, round(1-a*a-c*c-g*g-t*t, 6) AS gini, round(1-greatest(a,c,g,t), 6) AS max_impurity, round((abs(a-t)+abs(c-g)+abs(g-c)+abs(t-a))/2, 6) AS strand_distance FROM w")
def profile_measures(spark, d):
    o, w = B.phase_observations(spark, d).where("weights IS NOT NULL"), F.col("weights")
    out = o.select("user_id", "distance", X.gini_impurity(w).alias("gini"), X.max_impurity(w).alias("max_impurity"), X.total_variation(w, X.strand_vector(w, F.lit(True))).alias("strand_distance"))
    return rounded(out, "gini", "max_impurity", "strand_distance")


@query(B.with_sql("segments") + " SELECT read, (seg_start - 3000 + 16569) % 16569 AS forward_distance, (3000 - seg_start + 16569) % 16569 AS reverse_distance FROM segments")
def circular_distance(spark, d):
    s, p = B.segments(spark, d), F.col("seg_start")
    return s.select("read", X.oriented_distance(p, F.lit(3000), F.lit(False), 16569).alias("forward_distance"), X.oriented_distance(p, F.lit(3000), F.lit(True), 16569).alias("reverse_distance"))


@query("SELECT event_id, CASE WHEN v < 0 THEN -floor(-v * 1e6 + 0.5) ELSE floor(v * 1e6 + 0.5) END / 1e6 AS metric FROM (SELECT event_id, (value - 50) / 7.0::DOUBLE AS v FROM events)")
def rounded_metric(spark, d):
    return B.table(spark, d, "events").select("event_id", X.round_metric((F.col("value") - 50) / 7.0).alias("metric"))


@query("SELECT o_orderpriority AS sample, o_orderkey AS read, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(CAST(o_orderkey AS VARCHAR))) - 1 AS read_index, false AS duplicate_content FROM orders")
def read_order(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderpriority").alias("sample"), F.col("o_orderkey").alias("read"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha"))
    return S.ordered_reads(o, "sample", "sha").select("sample", "read", F.col("read_index").cast("long").alias("read_index"), "duplicate_content")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
