"""Matching, logs, two-level aggregates, counters, sources and sinks against plain Python."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.operators import counters as K
from lociflow.operators import logs as L
from lociflow.operators import matching as M
from lociflow.operators import phase as H
from lociflow.operators import research as R
from lociflow.operators import samples as S
from lociflow.operators import windows as W
from lociflow.operators.ranks import grouped_ranks, select_ranks
from lociflow.operators.recomputed import document_differences
from lociflow.sinks import sets
from lociflow.sources import corpus, digests, measurements

# --- single events


def spelled(reference, events):
    out, at = [], 0
    for position, known, new in sorted(events):
        if position - 1 < at or reference[position - 1 : position - 1 + len(known)] != known:
            return None
        out += [reference[at : position - 1], new]
        at = position - 1 + len(known)
    return "".join([*out, reference[at:]])


def any_event(rng, reference):
    at = rng.randrange(len(reference))
    known = reference[at : at + rng.randint(1, 4)]
    return at + 1, known, "".join(rng.choice("AC") for _ in range(rng.randint(0, 4)))


def test_forms_are_equal_where_sequences_are():
    rng = random.Random(1)
    for _ in range(150):
        reference = "".join(rng.choice("AC") for _ in range(rng.randint(3, 14)))
        repeats, events = M.Repeats(reference), [any_event(rng, reference) for _ in range(10)]
        for a in events:
            for b in events:
                assert (spelled(reference, [a]) == spelled(reference, [b])) == (repeats.form(*a) == repeats.form(*b)), (reference, a, b)


def test_forms_on_a_circle():
    """What is equal on the line is equal on the circle, and what rolls over the seam is equal to what stands behind it."""
    rng = random.Random(2)
    for _ in range(100):
        reference = "".join(rng.choice("AC") for _ in range(rng.randint(6, 14)))
        n, turn = len(reference), rng.randrange(6)
        moved = reference[turn:] + reference[:turn]
        one, other = M.Repeats(reference, True), M.Repeats(moved, True)
        if any(reference == reference[k:] + reference[:k] for k in range(1, n)):
            continue  # a circle that repeats itself has no first place
        events = [e for e in (any_event(rng, reference) for _ in range(10)) if e[0] > turn]
        for a in events:
            for b in events:
                at = lambda e: (e[0] - turn, *e[1:])  # noqa: E731, B023
                assert (one.form(*a) == one.form(*b)) == (other.form(*at(a)) == other.form(*at(b)))
    ring = M.Repeats("AAGTCA", True)
    assert ring.form(6, "A", "") == ring.form(1, "A", "") == ring.form(2, "A", "") != ring.form(3, "G", "")
    assert ring.form(5, "C", "CA") == ring.form(2, "A", "AA") and ring.form(6, "AA", "A") == ring.form(1, "AA", "A")


def test_events_that_do_not_fit(spark):
    rows = spark.createDataFrame([(1, "AA", "A"), (2, "AA", "A"), (1, "C", "A"), (9, "A", "C"), (None, "A", "C"), (1, None, "C"), (1, "A", "A"), (3, "C", "C")], "position int, reference string, alternate string")
    forms = [r.form for r in M.with_form(rows, "AAC").collect()]
    assert forms[0] is not None and forms[1:6] == [None] * 5 and forms[6] == forms[7]
    with pytest.raises(ValueError):
        M.Repeats("A" * (M.MAX_REFERENCE + 1))


# --- runs


def plain_runs(reference, truth, called):
    def runs(events):
        known, out = {e[0]: e[1:] for e in events}, []
        for first in known:
            last, chosen = first, []
            while last in known:
                chosen.append(known[last])
                if (text := spelled(reference, chosen)) is not None:
                    out.append((first, last, text))
                last += 1
        return out

    pairs = [(a, b, c, d) for a, b, t in runs(truth) for c, d, u in runs(called) if t == u and (a < b or c < d)]
    least = [p for p in pairs if not any(o != p and p[0] <= o[0] and o[1] <= p[1] and p[2] <= o[2] and o[3] <= p[3] for o in pairs)]
    uses = Counter(x for a, b, c, d in least for x in [*(("t", i) for i in range(a, b + 1)), *(("c", i) for i in range(c, d + 1))])
    return [(list(range(a, b + 1)), list(range(c, d + 1))) for a, b, c, d in sorted(least) if all(uses["t", i] == 1 for i in range(a, b + 1)) and all(uses["c", i] == 1 for i in range(c, d + 1))]


def some_events(rng, reference):
    out, at = [], 0
    while at < len(reference) - 2:
        at += rng.randint(0, 3)
        known = reference[at : at + rng.randint(1, 3)]
        new = "".join(rng.choice("AC") for _ in range(rng.randint(0, 3)))
        if known and known != new:
            out.append((len(out), at + 1, known, new))
        at += max(1, len(known))
    return [e for e in out if rng.random() > 0.15]


def test_runs_against_spelled_sequences(spark):
    rng, found, cases = random.Random(3), 0, []
    for _ in range(2_000):
        reference = "".join(rng.choice("AC") for _ in range(rng.randint(6, 24)))
        truth, called = some_events(rng, reference), some_events(rng, reference)
        sums = M.prefix_sums(reference)
        want = plain_runs(reference, truth, called)
        assert M.equal_runs(M.Side(truth, reference, sums), M.Side(called, reference, sums)) == want
        found += len(want)
    assert found > 50
    reference = "ACCAACACCAACCCAACA"
    for sample in range(60):
        for side, events in (("truth", some_events(rng, reference)), ("called", some_events(rng, reference))):
            cases += [(sample, side, *e) for e in events]
    rows = spark.createDataFrame(cases, "sample int, side string, at int, position int, reference string, alternate string")
    got = sorted((r.sample, r.truth, r.called) for r in M.run_pairs(rows, reference).collect())
    sides = lambda s, side: [c[2:] for c in cases if c[0] == s and c[1] == side]
    assert got == sorted((s, t, c) for s in range(60) for t, c in plain_runs(reference, sides(s, "truth"), sides(s, "called")))


def test_two_thousand_events_take_a_short_time():
    rng = random.Random(4)
    reference = "".join(rng.choice("ACGT") for _ in range(16_500))
    other = dict(zip("ACGT", "GTAC", strict=True))
    truth, called = [], []
    for k in range(1_000):
        p = 2 + 7 * k
        x, y = reference[p - 1 : p + 1]
        truth += [(2 * k, p, x, other[x]), (2 * k + 1, p + 1, y, other[y])]
        called.append((k, p, x + y, other[x] + other[y]))
    began = time.process_time()
    sums = M.prefix_sums(reference)
    pairs = M.equal_runs(M.Side(truth, reference, sums), M.Side(called, reference, sums))
    assert pairs == [([2 * k, 2 * k + 1], [k]) for k in range(1_000)] and time.process_time() - began < 5


def test_compare_in_three_steps(spark):
    reference = "ACGTAAAACCGT"
    truth = [("s", 0, "SNV", 1, "A", ["C", "G"], ["1S"]), ("s", 1, "DEL", 5, "AA", ["A"], ["6DEL"]), ("s", 2, "SNV", 9, "C", ["T"], ["9T"]), ("s", 3, "SNV", 10, "C", ["A"], ["10A"]), ("s", 4, "SNV", 12, "T", ["G"], ["12G"])]
    called = [("s", 0, "SNV", 1, "A", "G"), ("s", 1, "DEL", 7, "AA", "A"), ("s", 2, "MNV", 9, "CC", "TA"), ("s", 3, "SNV", 11, "G", "C")]
    t = spark.createDataFrame(truth, "sample string, at int, kind string, position int, reference string, alternates array<string>, tokens array<string>")
    c = spark.createDataFrame(called, "sample string, at int, kind string, position int, reference string, alternate string")
    found = M.held_matches(t, c, reference)
    assert sorted((r.status, r.truth, r.called) for r in found.collect()) == [("equivalent", [1], [1]), ("exact", [0], [0]), ("extra", [], [3]), ("group", [2, 3], [2]), ("missing", [4], [])]
    rows = {(r.difference, r.truth_tokens, r.truth_positions, r.truth_events, r.called_positions, r.called_events, r.truth_count, r.called_count) for r in M.difference_rows(found, t, c).collect()}
    assert rows == {
        ("missing", "12G", "12", "SNV:12:T>G", "", "", 1, 0), ("extra", "", "", "", "11", "SNV:11:G>C", 0, 1), ("representation", "6DEL", "5", "DEL:5:AA>A", "7", "DEL:7:AA>A", 1, 1),
        ("representation", "9T|10A", "9;10", "SNV:9:C>T|SNV:10:C>A", "9", "MNV:9:CC>TA", 2, 1),
    }
    p = M.profile_counts(found).first()
    assert (p.truth_events, p.called_events, p.matched_groups, p.representation_groups, p.collapsed_truth_events, p.collapsed_called_events, p.missing_groups, p.extra_groups, p.exact_profile, p.precision, p.recall) == (5, 4, 3, 2, 1, 0, 1, 1, False, 0.75, 0.75)
    none = M.compare(t.where("false"), c.where("false"), reference)
    assert none.count() == 0


# --- logs

WHOLE = ["basecalling_completed calls=40", f"{L.REQUIRED[1]} profiled_loci=12 noisy_calls=0", "quality_control_completed trim=2..32 retained=30 retained_fraction=0.75", "alignment_completed orientation=Forward callable_columns=20 callable_identity=1.0 mismatches=0 gap_opens=0", "warning_summary excluded_variant_candidates=0"]


def log(spark, said, name="l", first=0):
    return spark.createDataFrame([(name, first + i, f"2024-01-01 00:00:00.000 | INFO     | x:1 - run_id=r event={s}" if s else "noise") for i, s in enumerate(said)], "log string, line_no long, line string")


SAID = [
    "basecalling_completed calls=1", "sample_read_completed trace_sha256=z", "sample_read_started trace_sha256=a", *WHOLE, "other x=1", "sample_read_completed trace_sha256=a orientation=forward", "warning_summary excluded_variant_candidates=9",
    "sample_read_started trace_sha256=b", *WHOLE[:4], "sample_read_started trace_sha256=c", *WHOLE, WHOLE[0], "sample_read_completed trace_sha256=d orientation=reverse", "sample_read_started trace_sha256=a", "basecalling_completed calls=x", *WHOLE[1:],
    "sample_read_completed trace_sha256=a orientation=forward", "sample_read_started trace_sha256=e", "", *WHOLE[:2], "quality_control_completed trim=5..70 retained=30 retained_fraction=1.5", *WHOLE[3:], "sample_read_completed trace_sha256=e orientation=forward", "sample_read_started",
]
FAULTS = [
    [], ["read did not complete"], ["completed by another trace", "basecalling_completed is repeated", "orientations differ"], ["repeated read", "calls is no number from 1"],
    ["retained_fraction is no share", "trim and retained disagree"], ["start without a trace", "unexpected trace", "read did not complete"],
]


@pytest.mark.parametrize("width", [3, 1_000])
def test_log_states(spark, width):
    expected = spark.createDataFrame([("l", t) for t in "abcef"], "log string, trace string")
    rows = L.read_records(log(spark, SAID), expected=expected, width=width).orderBy("start_line").collect()
    assert [r.faults for r in rows] == FAULTS and [r.trace for r in rows] == ["a", "b", "c", "a", "e", None]
    assert (rows[0].calls, rows[0].trim_start, rows[0].trim_end, rows[0].orientation, rows[0].callable_identity, rows[0].complete) == (40, 2, 32, "forward", 1.0, True)
    found = L.read_records(log(spark, SAID), expected=expected)
    assert {r.trace for r in L.missing_reads(found, expected).collect()} == {"b", "c", "e", "f"}
    assert L.read_records(log(spark, SAID).where("false")).count() == 0


def test_a_stream_of_lines_gives_the_same_reads(spark, tmp_path):
    lines = log(spark, SAID).unionByName(log(spark, SAID[2:12], "m"))
    for part, cond in enumerate(("line_no < 13", "line_no >= 13")):  # the second file goes on with an open read
        lines.where(cond).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{part}")
    read = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    L.stream_records(read).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.log, r.start_line): (r.trace, r.end_line, r.calls, r.faults) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.log, r.start_line): (r.trace, r.end_line, r.calls, [f for f in r.faults if f != "repeated read"]) for r in L.read_records(lines).collect() if r.end_line is not None}
    assert got == want and len(got) == 6


# --- two-level aggregates


def test_running_values(spark):
    rng = random.Random(5)
    data = [(k if k else None, i, rng.choice([None, 1, 2, -3])) for k in range(3) for i in rng.sample(range(-40, 200), 60)]
    rows = spark.createDataFrame(data, "k int, i long, v int")
    for inclusive in (True, False):
        got = W.running(rows, ["k"], "i", 7, sums={"s": F.col("v")}, latest={"last": F.col("v")}, inclusive=inclusive, following="next").collect()
        for k in (None, 1, 2):
            mine, total, last = sorted((i, v) for a, i, v in data if a == k), 0, None
            ours = {r.i: r for r in got if r.k == k}
            for at, (i, v) in enumerate(mine):
                before = (total, last)
                total, last = total + (v or 0), v if v is not None else last
                assert (ours[i].s, ours[i]["last"]) == ((total, last) if inclusive else before)
                assert ours[i]["next"] == (mine[at + 1][0] if at + 1 < len(mine) else None)


def test_coverage_across_buckets(spark):
    rng = random.Random(6)
    data = [("s", a := rng.randrange(100), a + rng.randint(1, 30), rng.random() < 0.5) for _ in range(40)]
    rows = spark.createDataFrame(data, "sample string, seg_start int, seg_end int, forward boolean")
    depth = [tuple(sum(a <= p < b and f == way for _, a, b, f in data) for way in (True, False)) for p in range(140)]
    want = [(p, d) for p, d in enumerate(depth) if sum(d)]
    for width in (3, 4_096):
        got = W.coverage_depth(rows, ["sample"], width=width).collect()
        assert sorted((p, (r.forward_reads, r.reverse_reads)) for r in got for p in range(r.start, r.end)) == want
        assert len(got) == sum(d != e and sum(d) > 0 for d, e in zip(depth, [(0, 0), *depth[:-1]], strict=True))


def test_overlaps_by_bitmaps(spark):
    rng = random.Random(7)
    data = [(s, r, p, rng.choice("ACGTN-")) for s in "xy" for r in range(5) for p in rng.sample(range(-70, 200), 90)]
    got = {(r.sample, r.left_read, r.right_read): (r.shared, r.comparable, r.agreements) for r in S.overlaps(spark.createDataFrame(data, "sample string, read int, position int, base string"), "sample", "read", "position", "base").collect()}
    base = {(s, r, p): b for s, r, p, b in data}
    want = {}
    for s in "xy":
        for a in range(5):
            for b in range(a + 1, 5):
                both = [(base[s, a, p], base[s, b, p]) for p in range(-70, 200) if (s, a, p) in base and (s, b, p) in base]
                known = [x for x in both if set(x) <= set("ACGT")]
                want[s, a, b] = (len(both), len(known), sum(x == y for x, y in known))
    assert got == want


@pytest.mark.parametrize("bins", [2, 1_024])
def test_ranks_of_one_group_of_all_rows(spark, bins):
    rng = random.Random(8)
    values = [rng.choice([0.0, 1.5, rng.gauss(0, 1), rng.gauss(0, 1e12), -1e308, 1e308, None]) for _ in range(900)] + [float("inf")] * 9 + [float("-inf")] * 30 + [float("nan")] * 9
    rows = spark.createDataFrame([(None, v) for v in values] + [(1, 2.0)], "g int, v double")
    shares = {"low": 0.01, "p7": 0.07, "half": 0.5, "p97": 0.97, "top": 1.0}
    want = {r.g: tuple(map(str, r[1:])) for r in rows.groupBy("g").agg(*[X.nearest_rank("v", p).alias(n) for n, p in shares.items()]).collect()}
    assert {r.g: tuple(map(str, r[1:])) for r in select_ranks(rows, ["g"], "v", shares, bins).collect()} == want
    both = grouped_ranks(rows, ["g"], [F.count("*").alias("n")], {n: ("v", p) for n, p in shares.items()}, limit=5).collect()
    assert {r.g: tuple(map(str, r[2:])) for r in both} == want and {r.g: r.n for r in both} == {None: 948, 1: 1}


def test_summaries_do_not_change_with_the_limit(spark):
    rows = spark.range(400).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).cast("double").alias("v"), (F.col("id") % 2 == 0).alias("f"))
    key = lambda r: str(r[0])
    for f in (lambda n: S.metric_summary(rows, ["g"], "v", n), lambda n: R.strata_bounds(rows, ["g"], "v", limit=n), lambda n: R.stratified_summary(rows, ["g"], "f", ["v"], n)):
        assert sorted(f(10).collect(), key=key) == sorted(f(10_000).collect(), key=key)


# --- counters


def test_units_by_bitmaps(spark):
    rows = spark.range(90_000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 > 0, F.col("id") % 70_001).alias("a"), F.concat(F.lit("x"), F.col("id") % 50).alias("b"), F.lit(None).cast("int").alias("c"))
    got = K.distinct_units(rows, ["g"], {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, {"s": F.sum("id")} if "id" in rows.columns else None)
    want = rows.groupBy("g").agg(F.count("*").alias("rows"), F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b"), F.count_distinct("c").alias("c"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_counters_along_a_write(spark, tmp_path):
    rows = [("s", r, p, "ACGTN-"[(r + p) % 6], "A", r % 2 == 0, None if p % 5 == 0 else [0.7, 0.1, 0.1, 0.1], p % 4 == 0) for r in range(4) for p in range(30)]
    o = S.with_state(spark.createDataFrame(rows, "sample string, read int, position int, base string, reference string, forward boolean, weights array<double>, noisy boolean")).withColumn("corrected", F.col("weights")).withColumn("snrs", F.col("weights"))
    keys = ["sample", "position"]
    loci = S.locus_topology(o, keys).join(S.locus_support(o, keys), keys)
    calls = o.select("sample", F.col("weights").alias("profile"), "noisy", "corrected", "snrs")
    whole = K.sample_counters(loci, o, calls, "sample").first().asDict()
    assert len(whole) == 31
    for name, table, counters in (("loci", loci, K.locus_counters()), ("seen", o, K.observation_counters()), ("calls", calls, K.call_counters())):
        frame, seen = K.counted(table, counters)
        frame.write.parquet(f"{tmp_path}/{name}")
        assert {n: pytest.approx(v) for n, v in seen.get.items()} == {n: whole[n] for n in counters}
    assert whole["locus_forward_reads"] == whole["locus_reverse_reads"] == 60 and whole["noisy_variant_calls"] == whole["noisy_locus_observations"] == 32


def test_document_differences(spark):
    seen = [(1, "A", "A", True), (2, "C", "A", False)]
    right = (2, 1, 1, 1, 1, 0, 0, 0, 1)
    schema = "sample string, loci array<struct<position:int, topology:struct<reads:int,forward_reads:int,reverse_reads:int,reference_reads:int,alternate_reads:int,deletion_reads:int,unresolved_reads:int,alternate_forward:int,alternate_reverse:int>, observations:array<struct<read:int,base:string,reference:string,forward:boolean>>>>"
    rows = spark.createDataFrame([("s", [(5, right, seen), (6, (3, *right[1:]), seen), (7, right, [])])], schema)
    got = {(r.path, r.stored, r.recomputed) for r in document_differences(rows).collect()}
    assert ("loci[6].topology.reads", 3, 2) in got and not any(p.startswith("loci[5]") for p, _, _ in got) and sum(p.startswith("loci[7]") for p, _, _ in got) == 9


# --- sources and sinks


def test_lines_keep_their_numbers_in_splits(spark, tmp_path):
    for name, n in (("a", 700), ("b", 1), ("c", 0)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(1, n + 1)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "256")
    try:
        rows = measurements.numbered_lines(spark, str(tmp_path)).collect()
        assert measurements.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 1
    finally:
        spark.conf.set(key, before)
    assert len(rows) == 701 and all(r.line == f"{r.file[-1]}{r.line_no}" for r in rows)


def test_digests_in_pieces(spark, tmp_path):
    data = b"a,b\n" + b"".join(b"%d,x\n" % i for i in range(5_000)) + b"\n\nlast,y"
    (tmp_path / "x.csv").write_bytes(data)
    (tmp_path / "e.csv").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("x.csv", "e.csv", "gone.csv")], "path string")
    for piece in (7, 1 << 20):  # a file is larger than a piece
        got = {r.path.rpartition("/")[2]: tuple(r)[1:] for r in digests.file_digests(files, piece=piece).collect()}
        assert got == {"x.csv": (hashlib.sha256(data).hexdigest(), len(data), 5_002, "a,b"), "e.csv": (hashlib.sha256(b"").hexdigest(), 0, 0, ""), "gone.csv": (None, None, None, None)}


def test_files_of_a_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ab1").write_bytes(b"trace")
    right = hashlib.sha256(b"trace").hexdigest()
    rows = spark.createDataFrame([("c1", "in/a.ab1", right), ("c2", "in/a.ab1", "0" * 64), ("c3", "in/b.ab1", right), ("c4", "../a.ab1", right), ("c5", "/etc/x", right), ("c6", None, right)], "validation_case_id string, trace_path string, trace_sha256 string")
    got = {r.validation_case_id: r.rule for r in digests.manifest_file_faults(rows, f"file://{tmp_path}").collect()}
    assert got == {"c2": "content differs", "c3": "file is missing", "c4": "path leaves the root", "c5": "path leaves the root", "c6": "path leaves the root"}


def test_a_set_appears_whole_or_not_at_all(spark, tmp_path):
    good, bad = spark.range(10), spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    place = f"file://{tmp_path}/case"
    with pytest.raises(Exception, match="no"):
        sets.publish_set({"one": good, "two": bad}, place)
    assert list(tmp_path.iterdir()) == []
    assert sets.publish_set({"one": good, "two": spark.range(0)}, place)["one"]["rows"] == 10
    assert {n: t.count() for n, t in sets.read_set(spark, place).items()} == {"one": 10, "two": 0}
    with pytest.raises(FileExistsError):
        sets.publish_set({"one": good}, place)
    (tmp_path / ".case-0123").mkdir()  # a driver died
    assert sets.clear_stages(spark, place) == 1 and [p.name for p in tmp_path.iterdir()] == ["case"]
    with pytest.raises(ValueError):
        sets.publish_set({"../x": good}, f"{place}2")


def test_a_driver_that_dies_in_between_leaves_no_set(spark, tmp_path, monkeypatch):
    """The process ends after the first table: nothing is cleared, and no reader sees a set."""
    seen = []

    def die(self, *args, **kwargs):
        seen.append(args)
        if len(seen) == 2:
            raise KeyboardInterrupt
        return save(self, *args, **kwargs)

    writer = type(spark.range(1).write)
    save = writer.save
    monkeypatch.setattr(writer, "save", die)
    with pytest.raises(KeyboardInterrupt):
        sets.publish_set({"one": spark.range(2), "two": spark.range(2)}, f"file://{tmp_path}/case")
    assert not (tmp_path / "case").exists()


def test_reviewer_tables_and_gaps(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("Sample ID\tBatch\tAnalyzed Range (Sequencher)\tVariants (Sequencher)\nx-AB1\t1\t-\t73G\nx-AB1\t1\t-\t\ny-AB1\t1\t-\t\nzz\t1\t-\t\n")
    rows = corpus.read_reviewer_rows(spark, str(tmp_path / "r.tsv"))
    assert {(r.rule, r.subject) for r in corpus.reviewer_table_faults(rows).collect()} == {("sample without a case", "zz"), ("sample repeated", "x-AB1"), ("case repeated", "AB1")}
    tokens = spark.createDataFrame([("a", "3.1C"), ("a", "3.2C"), ("b", "3.2C"), ("c", "3.1C"), ("c", "3.3C")], "sample string, token string")
    assert {(r["sample"], r.token, r.rule) for r in R.reviewer_faults(tokens, "sample", F.col("token"), "ACGTACGT").collect()} == {("b", "3.2C", "gap in inserted places"), ("c", "3.1C", "gap in inserted places")}
    assert {r["sample"] for r in R.reviewer_events(tokens, "sample", F.col("token"), "ACGTACGT").collect()} == {"a"}


# --- counts and grids without pairs


def test_interval_counts(spark):
    rng = random.Random(9)
    intervals = [(rng.choice([None, 1, 2]), a := rng.randrange(60), a + rng.randint(-2, 20)) for _ in range(50)]
    points = [(k, p, f"{k}-{p}") for k in (None, 1, 2, 3) for p in range(-2, 85, 3)] + [(1, None, "none"), (1, 4, "1-4 again")]
    i, p = spark.createDataFrame(intervals, "k int, a int, b int"), spark.createDataFrame(points, "k int, p int, name string")
    got = {r.name: r.held for r in S.interval_counts(p, i, ["k"], "p", "a", "b", width=7).collect()}
    assert got == {name: sum(k == x and q is not None and a <= q < b for x, a, b in intervals) for k, q, name in points}


def test_a_grid_point_is_the_candidates_of_its_parameters(spark):
    rng = random.Random(10)
    weights = lambda: [x / sum(w) for w in [[rng.random() for _ in range(4)]] for x in w]
    rows = [(k, d, rng.choice("ACGTN"), weights() if rng.random() < 0.9 else None) for k in (1, 2, 3) for d in range(1, 70 if k < 3 else 12)]
    o = spark.createDataFrame(rows, "k int, distance int, base string, weights array<double>")
    found = H.sensitivity(o, ["k"], (15, 25), (5, 10), (2, 5), width=8)
    key = lambda r: (r.k, r.window, r.offset)
    for size, step, most in ((15, 5, 2), (25, 10, 5)):
        want = sorted(H.candidates(H.members(o, ["k"], size, step), o, ["k"], most).collect(), key=key)
        got = sorted(found.where(f"size = {size} AND step = {step} AND most = {most}").collect(), key=key)
        assert [(*key(r), r.informative) for r in got] == [(*key(r), r.informative) for r in want] and want
        for g, w in zip(got, want, strict=True):
            for n in ("mean_zero", "mean_shifted", "mean_residual"):
                assert g[n] == (None if w[n] is None else pytest.approx(w[n], abs=1e-9))
