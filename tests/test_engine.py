"""Operators of the engine on small fixtures whose results are known."""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.functions.register import register
from lociflow.operators import alignment as A
from lociflow.operators import calls as C
from lociflow.operators import matching as M
from lociflow.operators import phase as H
from lociflow.operators import research as R
from lociflow.operators import samples as S
from lociflow.operators import windows as W
from lociflow.plans import analysis
from lociflow.sinks import publish
from lociflow.sources import abif, corpus, digests, settings
from lociflow.streaming.ingest import stream_calls

QUERY = "ACGTCAGTACGATCGTACCTGAGTACGA"
REFERENCE = "TTTT" + QUERY + "CCCC"
ONE = {b: [float(i == j) for j in range(4)] for i, b in enumerate("ACGT")}


def reverse_complement(s):
    return s.translate(A.COMPLEMENT)[::-1]


def traces(spark, *named):
    return abif.decode_traces(spark.createDataFrame([(n, bytearray(d)) for n, d in named], "path string, content binary"))


# --- traces


def test_decoding_keeps_channels_and_tells_faults(spark):
    good = abif.synthetic(QUERY, calls=QUERY, order="GTCA", qualities=bytes([40]) * len(QUERY))
    channels, ploc, calls, qualities = abif.decode(good)
    assert calls == QUERY and ploc.tolist() == [2 + 4 * i for i in range(28)] and qualities == bytes([40]) * 28
    assert [int(np.argmax([c[p] for c in channels])) for p in ploc] == ["ACGT".index(b) for b in QUERY]
    zero, two = [np.zeros(20, int)] * 4, np.array([2, 6])
    bad = {
        "empty": b"", "magic": b"ABIX" + good[4:], "short": good[:100], "order": abif.encode(zero, two, order="AACG"), "rising": abif.encode(zero, np.array([6, 2])), "outside": abif.encode(zero, np.array([2, 99])),
        "letters": abif.encode(zero, two, calls="AZ"), "lengths": abif.encode([np.zeros(20, int)] * 3 + [np.zeros(19, int)], two),
    }
    rows = {r.input_name: r for r in traces(spark, ("good", good), *bad.items()).collect()}
    assert rows["good"].error_class is None
    assert all(rows[n].error_class == "abif" and rows[n].channels is None for n in bad)


def test_duplicate_tags_are_refused():
    data = bytearray(abif.synthetic(QUERY, calls=QUERY))
    at = data.index(b"PBAS")
    data[at : at + 4], data[at + 4 : at + 8] = b"PLOC", (2).to_bytes(4, "big")
    with pytest.raises(abif.TraceError, match="duplicate PLOC.2"):
        abif.decode(bytes(data))


def test_calls_and_ambiguity(spark):
    def trace(*heights):
        channels = [np.zeros(13, int) for _ in range(4)]
        for p, hs in zip((2, 6, 10), heights, strict=True):
            for c, h in zip(channels, hs, strict=True):
                c[p] = h
        return abif.encode(channels, np.array([2, 6, 10]), calls="ACG")

    rows = C.call_bases(traces(spark, ("t", trace((100, 0, 0, 0), (100, 100, 0, 0), (100, 40, 0, 0))), ("u", trace((100, 50, 40, 0), (90, 80, 70, 60), (0, 0, 0, 0))))).orderBy("input_name", "call_index").collect()
    assert [(r.primary, r.ambiguity) for r in rows] == [("A", "A"), ("N", "N"), ("A", "M"), ("A", "N"), ("N", "N"), ("N", "N")]
    assert [r.vendor_agrees for r in rows[:3]] == [True, False, False] and rows[1].primary_pos is None
    assert [(r.w_start, r.w_end) for r in rows[:3]] == [(0, 4), (4, 8), (8, 12)]


def test_peaks_take_the_first_of_equals_or_fall_back(spark):
    channels = [np.array(x) for x in ([0, 1, 10, 4, 10, 3, 0], [0, 0, 3, 20, 5, 0, 0], [1, 2, 3, 30, 3, 2, 1], [0, 1, 2, 3, 4, 5, 6])]
    data = abif.encode(channels, np.array([1, 3, 5]))
    row = C.call_bases(traces(spark, ("t", data))).where("call_index = 1").first()
    assert [(p.position, p.height, p.source) for p in row.peaks] == [(2, 10, "local_maximum"), (3, 20, "local_maximum"), (3, 30, "local_maximum"), (3, 3, "ploc_fallback")]


def test_runs_of_a_clean_trace(spark):
    t = traces(spark, ("t", abif.synthetic(QUERY)))
    windows = C.call_windows(t).collect()
    assert len(windows) == 19 and all(r.min_snr == 1000 and not r.noisy for r in windows)
    loci = C.locus_evidence(t).orderBy("call_index").collect()
    assert [r.event_position for r in loci] == [2 + 4 * i for i in range(28)]
    assert all(r.profile == ONE[b] for r, b in zip(loci, QUERY, strict=True))
    assert [r.ctx_call_start for r in loci][:6] == [0, 0, 0, 0, 0, 1]
    flat = C.locus_evidence(traces(spark, ("z", abif.encode([np.zeros(20, int)] * 4, np.array([2, 6, 10]))))).collect()
    assert all(r.profile is None for r in flat)
    assert C.trace_integrity(t).first().median_spacing == 4


def test_noise(spark):
    rows = spark.createDataFrame([(1, [0, 2, 0, 2, 0]), (2, [5, 5, 5])], "k int, v array<int>")
    got = {r.k: r for r in W.baseline_noise(rows, ["k"], "v").collect()}
    assert got[1].baseline == 0 and got[1].noise == pytest.approx(2 / (0.67448975 * 2**0.5)) and got[2].noise == 1.0


# --- quality


def test_penalties_and_trim(spark):
    calls = spark.createDataFrame([(1, i, p, a) for i, (p, a) in enumerate(zip((0, 4, 8, 20), "AANA", strict=True))], "k int, call_index int, ploc int, ambiguity string")
    p = W.penalties(calls, ["k"], 3)
    assert [r.penalty for r in p.orderBy("call_index").collect()] == [3, 3, 5, 6]
    best = W.best_section(p, ["k"], 0.5).first()
    assert (best.best_start, best.best_end, best.best_sum) == (0, 2, 6)
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([9, 9, 1, 0, 0, 1, 8, 8])], "k int, call_index int, penalty int")
    section = spark.createDataFrame([(1, 3, 5, 1, 8)], "k int, best_start int, best_end int, best_sum int, n int")
    assert tuple(W.trim(rows, section, ["k"], 2, 3.0, 2).first())[1:] == (3, 5, True)
    assert [r.relative_quality for r in W.relative_quality(spark.createDataFrame([(1, 0, 0), (1, 1, 5)], "k int, call_index int, penalty int"), ["k"], 60).orderBy("call_index").collect()] == [60, 0]


def test_noisy_runs_merge(spark):
    rows = spark.createDataFrame([(1, 0, 5, True, 1.0), (1, 1, 6, True, 0.5), (1, 6, 11, True, 2.0), (1, 20, 25, False, 9.0), (1, 40, 45, True, 1.0)], "k int, w_start int, w_end int, noisy boolean, min_snr double")
    assert [tuple(r) for r in W.noisy_regions(rows, ["k"], 2).collect()] == [(1, 0, 11, 3, 0.5)]


# --- alignment


def brute_score(query, reference):
    scoring = A.Scoring()
    scores, codes = A.substitutions([ONE.get(c) for c in query], scoring), A.codes(reference)
    gap = lambda same: (scoring.gap_extension + (0 if same else scoring.gap_open)) * A.UNIT

    @lru_cache(None)
    def go(i, j, last):
        if i == len(query):
            return 0
        out = -(10**12)
        if j < len(reference):
            out = int(scores[i, codes[j]]) + go(i + 1, j + 1, 0)
            if last != 2 and i:
                out = max(out, gap(last == 1) + go(i, j + 1, 1))
        return max(out, gap(last == 2) + go(i + 1, j, 2)) if last != 1 else out

    return max(go(0, j, 0) for j in range(len(reference) + 1))


def test_scores_match_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        q, r = ("".join(rng.choice("ACGT") for _ in range(rng.randint(1, n))) for n in (6, 8))
        found = A.placements(q, [ONE[c] for c in q], r, A.Scoring())
        for p in found:
            assert p.score == brute_score(q, r) == A.total(p.columns, A.substitutions([ONE[c] for c in q], A.Scoring()), A.codes(r), A.Scoring())


@pytest.mark.parametrize(
    ("query", "reference", "start", "end", "score", "n"),
    [("ACGT", "TTACGTGG", 2, 6, 12, 1), ("ACGTT", "ACGT", 0, 4, -2, 1), ("AAA", "AAAAA", 0, 3, 9, 2)],
)
def test_placements(query, reference, start, end, score, n):
    found = A.placements(query, [ONE[c] for c in query], reference, A.Scoring())
    assert (found[0].start, found[0].end, found[0].score, len(found)) == (start, end, score * A.UNIT, n)


@pytest.mark.parametrize("read", ["GCCAAAGTT", "AACTTTGGC"])
def test_gaps_move_right_on_either_strand(read):
    row = A.align_read(read, [ONE[c] for c in read], 0, "GCCAAAAGTT", False, A.Scoring(least_callable=5))
    assert [c["ref_pos0"] for c in row[11] if c["query_base"] == "-"] == [6]


def test_errors_stay_in_their_row(spark):
    profiles = lambda s: [ONE[c] for c in s]
    reads = spark.createDataFrame([("ok", QUERY, profiles(QUERY), 0), ("two", "ACGT" * 6, profiles("ACGT" * 6), 0), ("short", "ACGTC", profiles("ACGTC"), 0)], "read string, query string, profiles array<array<double>>, first_call int")
    got = {r.read: r for r in A.align_reads(reads, REFERENCE).collect()}
    assert got["ok"].score == 3 * 28 * A.UNIT and got["short"].error_class == got["two"].error_class == "alignment" and got["short"].columns is None


def test_leading_events_of_a_linear_reference(spark):
    columns = [(1, i, q, r, None if q == "-" else i, None if r == "-" else i) for i, (q, r) in enumerate([("-", "A"), ("C", "C"), ("G", "G")])]
    columns += [(2, i, q, r, i, None if r == "-" else i - 1) for i, (q, r) in enumerate([("T", "-"), ("A", "A"), ("C", "C")])]
    rows = spark.createDataFrame(columns, "read int, col_idx int, query_base string, reference_base string, call_index int, ref_pos0 int")
    got = {r.read: (r.kind, r.position_1based, r.reference, r.alternate) for r in A.variants(rows, "ACG").collect()}
    assert got == {1: ("DEL", 1, "AC", "C"), 2: ("INS", 1, "A", "TA")}
    around = {r.read: (r.kind, r.position_1based, r.reference, r.alternate) for r in A.variants(rows, "ACG", circular=True).collect()}
    assert around == {1: ("DEL", 3, "GA", "G"), 2: ("INS", 3, "G", "GT")}


# --- whole analysis


@pytest.fixture(scope="module")
def pair(spark):
    changed = reverse_complement(QUERY)
    changed = changed[:10] + "A" + changed[11:]
    t = traces(spark, ("f.ab1", abif.synthetic(QUERY)), ("r.ab1", abif.synthetic(changed))).cache()
    s = settings.Settings(variant_calling=settings.VariantCalling(regions=((1, 40),)))
    done = analysis.analyze(t, corpus.ReferenceSequence("ref", REFERENCE, False), s)
    samples = spark.createDataFrame([("f.ab1", "s"), ("r.ab1", "s")], "input_name string, sample string")
    return done, analysis.sample_evidence(done, samples, s), changed


def test_two_reads_make_the_known_evidence(pair):
    done, evidence, changed = pair
    position = 4 + 27 - 10
    expected = complement = {"A": "T", "C": "G", "G": "C", "T": "A"}["A"]
    assert [tuple(r) for r in evidence["coverage"].collect()] == [("s", 4, 32, 2, 1, 1)]
    o = evidence["overlaps"].first()
    assert (o.shared, o.comparable, o.agreements, o.conflicts, o.eligible) == (28, 28, 27, 1, True)
    (t,) = evidence["topology"].collect()
    assert (t.position, t.reads, t.reference_reads, t.alternate_reads, t.alternate_reverse) == (position, 2, 1, 1, 1)
    (v,) = evidence["variants"].collect()
    assert (v.position_1based, v.kind, v.reference, v.alternate, v.eligible_reverse) == (position + 1, "SNV", REFERENCE[position], expected, 1)
    (u,) = evidence["support"].collect()
    assert u.directional_distance == 1 and u.total_within == 0 and u.total_between == pytest.approx(0.5)
    assert complement


def test_a_mixed_call_is_a_reason(spark):
    q = QUERY[:14] + ("T" if QUERY[14] != "T" else "A") + QUERY[15:]
    # mixed calls all along: no part of the read is better than another, so nothing is trimmed
    mixed = {i: ("C", 400) for i in range(0, 28, 2) if q[i] != "C"}
    t = traces(spark, ("m", abif.synthetic(q, secondary=mixed)))
    s = settings.Settings(variant_calling=settings.VariantCalling(regions=((1, 40),)))
    (v,) = analysis.analyze(t, corpus.ReferenceSequence("ref", REFERENCE, False), s).variants.collect()
    assert v.exclusion_reasons[-1] == "mixed_supporting_signal" and v.position_1based == 19


def test_documents(spark, pair, tmp_path):
    doc = publish.basecall_documents(pair[0].calls).where("input_name = 'f.ab1'").first()
    assert doc.primary_sequence == QUERY and doc.consistent and [c.call_index for c in doc["calls"]] == list(range(28))
    sample = publish.json_rows(publish.sample_documents("sample", **pair[1])).first().value
    assert json.loads(sample)["coverage"] == [{"start": 4, "end": 32, "reads": 2, "forward_reads": 1, "reverse_reads": 1}]


# --- relational operators


def test_coverage(spark):
    rows = spark.createDataFrame([("s", 0, 10, True), ("s", 5, 15, False), ("s", 15, 20, True)], "sample string, seg_start int, seg_end int, forward boolean")
    got = [tuple(r)[1:] for r in W.coverage_depth(rows, ["sample"]).orderBy("start").collect()]
    assert got == [(0, 5, 1, 1, 0), (5, 10, 2, 1, 1), (10, 15, 1, 0, 1), (15, 20, 1, 1, 0)]


def test_overlap_without_comparable_positions(spark):
    rows = spark.createDataFrame([("s", "a", 1, "N"), ("s", "b", 1, "A")], "sample string, read string, position int, base string")
    r = S.overlaps(rows, "sample", "read", "position", "base").first()
    assert r.agreement is None and not r.eligible and r.reasons == "insufficient_comparable_bases;agreement_below_minimum"


def test_heterogeneity(spark):
    rows = [(1, True, [0.5, 0.0, 0.5, 0.0]), (1, False, [0.5, 0.0, 0.5, 0.0]), (2, True, ONE["A"]), (2, False, ONE["G"])]
    got = {r.p: r for r in S.locus_support(spark.createDataFrame(rows, "p int, forward boolean, weights array<double>"), ["p"]).collect()}
    assert (got[1].total_within, got[1].total_between) == (0.5, 0) and (got[2].total_within, got[2].total_between) == (0, 0.5)


def test_interval_join_equals_a_nested_loop(spark):
    rng = random.Random(1)
    points = [(1, i, rng.randint(0, 500)) for i in range(80)]
    intervals = [(1, i, a := rng.randint(0, 480), a + rng.randint(0, 90)) for i in range(60)]
    got = S.interval_join(spark.createDataFrame(points, "k int, p int, x int"), spark.createDataFrame(intervals, "k int, i int, a int, b int"), ["k"], "x", "a", "b", 32)
    assert sorted((r.p, r.i) for r in got.collect()) == sorted((p, i) for _, p, x in points for _, i, a, b in intervals if a <= x < b)


def test_phase_mixture(spark):
    cycle = "ACGT" * 12
    weights = lambda i: [0.60 * (b == cycle[i]) + 0.35 * (b == cycle[i + 1]) + 0.05 * (b == cycle[i + 2]) for b in "ACGT"]
    rows = spark.createDataFrame([(1, i + 1, cycle[i], weights(i) if i < 25 else None) for i in range(30)], "k int, distance int, base string, weights array<double>")
    held = H.members(rows, ["k"])
    (w,) = H.windows(held, ["k"]).collect()
    assert (w.observations, w.first_distance, w.last_distance) == (25, 1, 25) and w.mean_zero_mass == pytest.approx(0.6) and w.mean_impurity == pytest.approx(0.4)
    c = {r.offset: r for r in H.candidates(held, rows, ["k"]).collect()}
    assert sorted(c) == [-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]
    assert (c[1].mean_shifted, c[1].mean_residual) == (pytest.approx(0.35), pytest.approx(0.05)) and (c[-1].mean_shifted, c[-1].mean_residual) == (pytest.approx(0.0), pytest.approx(0.4))
    assert c[4].informative == 0 and c[4].mean_shifted is None


def test_a_window_skips_loci_without_profile(spark):
    rows = spark.createDataFrame([(1, i, "A", None if i == 3 else ONE["A"]) for i in range(1, 7)], "k int, distance int, base string, weights array<double>")
    (w,) = H.windows(H.members(rows, ["k"], 5, 1), ["k"]).collect()
    assert (w.first_distance, w.last_distance, w.observations) == (1, 6, 5)


def test_small_strata_stay_unbenchmarked(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(3)] + [("b", float(i)) for i in range(40)], "s string, v double")
    flags = R.tail_flags(rows, R.strata_bounds(rows, ["s"], "v"), ["s"], "v").groupBy("s", "flag").count().collect()
    assert {(r.s, r.flag): r["count"] for r in flags} == {("a", "unbenchmarked"): 3, ("b", "low"): 2, ("b", "high"): 3, ("b", "typical"): 35}


def test_nearest_rank(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    assert rows.agg(X.nearest_rank("v", 0.07).alias("q")).first().q == 8.0


def test_reviewer_tokens(spark):
    good = [("s", t) for t in ("2Y", "4.1C", "4.2G", "1DEL", "2DEL", "7DEL", "3N", " 5r ")]
    bad = [("j", "junk"), ("j", "2T"), ("d", "1DEL"), ("d", "1DEL"), ("i", "4.1C"), ("i", "4.1G"), ("n", "2C"), ("o", "9T"), ("z", "99999999999T"), ("m", "2T"), ("m", "2Y")]
    tokens = spark.createDataFrame(good + bad, "sample string, token string")
    got = sorted((r.sample, r.kind, r.position, r.reference, r.alternates) for r in R.reviewer_events(tokens, "sample", F.col("token"), "ACGTACGT").collect())
    assert got == [("s", "DEL", 6, "CG", ["C"]), ("s", "DEL", 8, "TAC", ["T"]), ("s", "INS", 4, "T", ["TCG"]), ("s", "SNV", 2, "C", ["T"]), ("s", "SNV", 3, "G", ["A", "C", "T"]), ("s", "SNV", 5, "A", ["G"])]
    faults = {(r.sample, r.rule) for r in R.reviewer_faults(tokens, "sample", F.col("token"), "ACGTACGT").collect()}
    assert faults == {("j", "unsupported token"), ("d", "duplicate token"), ("i", "duplicate token"), ("m", "duplicate token"), ("n", "no difference from the reference"), ("o", "position outside the reference"), ("z", "position outside the reference")}


def test_any_base_of_an_ambiguous_token_matches(spark):
    tokens = spark.createDataFrame([("s", "3N"), ("s", "5R"), ("s", "7DEL")], "sample string, token string")
    truth = R.reviewer_events(tokens, "sample", F.col("token"), "ACGTACGT")
    called = spark.createDataFrame([("s", "SNV", 3, "G", "T"), ("s", "SNV", 3, "G", "C"), ("s", "SNV", 5, "A", "T")], "sample string, kind string, position int, reference string, alternate string")
    got = sorted((r.status, r.position, r.alternate or "") for r in R.reviewer_matches(truth, called).collect())
    assert got == [("exact", 3, "C"), ("extra", 3, "T"), ("extra", 5, "T"), ("missing", 5, ""), ("missing", 6, "")]


def test_haplotypes(spark):
    ref = "AACCGGTT"
    kind = "sample string, side string, at int, position int, reference string, alternate string"

    def groups(events):
        rows = M.run_events(spark.createDataFrame([("s", *e) for e in events], kind), ref).collect()
        return sorted((r.group, r.side, r["at"]) for r in rows)

    assert groups([("truth", 0, 2, "A", "G"), ("truth", 1, 3, "C", "T"), ("called", 0, 2, "AC", "GT"), ("truth", 2, 7, "T", "A")]) == [(1, "called", 0), (1, "truth", 0), (1, "truth", 1)]
    # not neighbours: a matched event lies between
    assert groups([("truth", 0, 2, "A", "G"), ("truth", 2, 3, "C", "T"), ("called", 0, 2, "AC", "GT")]) == []
    # five events against one, and one against one never is a group
    five = [("truth", i, 2 + i, ref[1 + i], "T" if ref[1 + i] != "T" else "A") for i in range(5)]
    assert groups([*five, ("called", 0, 2, ref[1:6], "".join(e[4] for e in five))]) == [(1, "called", 0), *((1, "truth", i) for i in range(5))]
    assert groups([("truth", 0, 1, "AA", "A"), ("called", 0, 2, "AC", "C")]) == []
    # two truth runs spell one called event: neither matches
    assert groups([("truth", 0, 2, "A", "G"), ("truth", 1, 3, "C", "T"), ("truth", 2, 2, "A", "G"), ("truth", 3, 3, "C", "T"), ("called", 0, 2, "AC", "GT")]) == []


def test_matches_are_one_to_one(spark):
    t, c = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    m = R.exact_matches(t, c, ["k"])
    assert sorted((r.k, r.status) for r in m.collect()) == [(1, "exact"), (1, "missing"), (2, "missing"), (3, "extra")]
    p = R.precision_recall(m.withColumn("s", F.lit(1)), ["s"]).first()
    assert (p.precision, p.recall, p.specificity) == (0.5, pytest.approx(1 / 3), None)


def test_parity(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    assert R.parity(a, a, ["k"], ["v"]).first().holds
    b = spark.createDataFrame([(1, 1.5), (2, 2.0), (4, 1.0)], "k int, v double")
    assert tuple(R.parity(a, b, ["k"], ["v"]).first()) == (1, 1, 2, 1, 0.5, False)


def test_log_fields(spark):
    lines = spark.createDataFrame([("l", i, f"t | INFO     | x:1 - run_id=r event={s}") for i, s in enumerate(["sample_read_started", 'warning_summary warnings=3 note="a b"', "sample_read_started"])], "log string, line_no int, line string")
    events = R.log_events(lines)
    assert events.where("event = 'warning_summary'").first().fields["note"] == "a b"
    assert [r.read_no for r in events.orderBy("line_no").collect()] == [1, 1, 2]


# --- sources and sinks


def toml(**changes):
    out = [f"schema_version = {changes.pop('schema_version', 5)}"]
    from dataclasses import fields

    for part in fields(settings.Settings):
        if part.name != "sha256":
            out.append(f"[{settings.SECTIONS.get(part.name, part.name)}]")
            for f in fields(type(part.default)):
                v = changes.pop(f.name, f.default)
                out.append(f"{f.name} = {json.dumps(v)}")
    return ("\n".join(out) + "\n" + "\n".join(f"{k} = {v}" for k, v in changes.items())).encode()


def test_settings():
    s = settings.parse(toml())
    assert s.alignment == settings.AlignmentSettings() and len(s.sha256) == 64 and s.variant_calling.regions[0] == (16024, 16365)
    for bad in ({"schema_version": 4}, {"extra": 1}, {"window_size_bases": 11}, {"trim_stringency": 9.5}, {"mismatch_score": 0}, {"relative_quality_threshold": 60}, {"topology": "knot"}, {"regions": []}):
        with pytest.raises(settings.SettingsError):
            settings.parse(toml(**bad))


def test_reference(spark, tmp_path):
    path = tmp_path / "r.fa"
    path.write_text(">chrM some words\nacgt\nNACG\n")
    r = corpus.read_reference(spark, str(path), circular=True)
    assert (r.name, r.bases) == ("chrM", "ACGTNACG") and corpus.reference_bases(spark, r).count() == 8
    path.write_text(">a\nAC\n>b\nGT\n")
    with pytest.raises(corpus.SourceError):
        corpus.read_reference(spark, str(path))


def test_manifest_rules(spark, tmp_path):
    def row(**x):
        return ",".join(str(x.get(c, "v")) for c in corpus.MANIFEST)

    path = tmp_path / "m.csv"
    path.write_text("\n".join([",".join(corpus.MANIFEST), row(validation_case_id="A", trace_sha256="1"), row(validation_case_id="A", trace_sha256="2", notes="x"), row(validation_case_id="B", trace_sha256="2", holdout_group="h"), "," * 21]) + "\n")
    m = corpus.read_manifest(spark, str(path))
    assert m.count() == 3 and corpus.select_cases(m, limit=1).count() == 2
    assert {r.rule for r in corpus.manifest_faults(m).collect()} == {"case metadata differ", "trace of several cases", "source group spans holdout groups"}


def test_artifacts(spark, tmp_path):
    import hashlib

    good, bad = b"a,b\n1,2\n", b"a,b\n1,2\n3,4\n"
    (tmp_path / "x.csv").write_bytes(good)
    (tmp_path / "y.csv").write_bytes(bad)
    index = spark.createDataFrame([("x.csv", hashlib.sha256(good).hexdigest(), 1, ["a", "b"]), ("y.csv", hashlib.sha256(good).hexdigest(), 1, ["a", "b"]), ("z.csv", "0", 0, ["a"])], "file string, sha256 string, rows long, columns array<string>")
    assert {(r.file, r.rule) for r in digests.artifact_faults(spark, str(tmp_path), index).collect()} == {("y.csv", "content differs"), ("z.csv", "missing")}
    windows = spark.createDataFrame([("w",), ("v",)], "window_id string")
    assert [r.window_id for r in corpus.curve_faults(windows, spark.createDataFrame([("w", -1), ("w", 1), ("v", 1)], "window_id string, offset int"), [-1, 1]).collect()] == ["v"]


def test_measurements(spark):
    loci = spark.createDataFrame([("c", 1, 5, 1, [("a",)]), ("c", 2, 5, 2, [("a",), ("a",)]), ("c", 3, 9, 1, [("x",)])], "case_id string, line int, position_1based int, reads int, observations array<struct<input_sha256:string>>")
    reads = spark.createDataFrame([("c", "a"), ("c", "b")], "case_id string, input_sha256 string")
    assert sorted(r.rule for r in corpus.measurement_faults(loci, reads).collect()) == ["positions do not increase", "read without locus", "unknown read"]


def test_publishing_never_replaces(spark, tmp_path):
    path = str(tmp_path / "d.json")
    publish.publish_document({"a": 1}, path)
    with pytest.raises(FileExistsError):
        publish.publish_document({"a": 2}, path)
    assert json.loads(open(path).read()) == {"a": 1} and len(list(tmp_path.iterdir())) == 1
    rows = spark.range(3)
    publish.publish_table(rows, str(tmp_path / "t"), ("id",))
    with pytest.raises(Exception, match="(?i)exists"):
        publish.publish_table(rows, str(tmp_path / "t"), ("id",))
    with pytest.raises(ValueError):
        publish.publish_table(rows, str(tmp_path / "u"), ("other",))


def test_analysis_documents(spark, tmp_path):
    """Every table written once gives what the lazy ones give, and the documents hold them together."""
    q = QUERY[:14] + ("T" if QUERY[14] != "T" else "A") + QUERY[15:]
    t = traces(spark, ("r", abif.synthetic(q)))
    s = settings.Settings(variant_calling=settings.VariantCalling(regions=((1, 40),)))
    reference = corpus.ReferenceSequence("ref", REFERENCE, False)
    lazy, kept = analysis.analyze(t, reference, s), analysis.analyze(t, reference, s, publish.staged(f"file://{tmp_path}/stages"))
    assert sorted(map(str, lazy.variants.collect())) == sorted(map(str, kept.variants.collect()))
    (d,) = publish.analysis_documents(kept, t, reference, s).collect()
    assert (d.schema_version, d.read.call_count, d.alignment.orientation, d.warnings.excluded_variant_candidates) == ("analysis/v7", 28, "forward", 0)
    assert [tuple(x) for x in d.alignment.reference_segments] == [(4, 32)] and d.provenance.reference.sha256 == reference.sha256
    (v,) = d.variants
    assert (v.position_1based, v.kind, v.alternate) == (19, "SNV", q[14]) and [(c.role, c.base, max(c.peaks)) for c in v.calls] == [("supporting", q[14], 1000)]
    assert A.reference_faults(kept.variants.withColumn("reasons", F.col("exclusion_reasons")), REFERENCE, keys=("input_name",)).count() == 0


def test_small_predicates(spark):
    rows = spark.createDataFrame([("a-1", 1.5, [0.25] * 4, "base"), ("_a", float("nan"), [0.5, 0.5, 0.5, 0.0], "deletion"), ("x" * 129, float("inf"), None, "base"), ("a\n", None, [1.0, 0.0, 0.0], "base")], "name string, v double, w array<double>, state string")
    got = rows.select(
        X.sample_name(F.col("name")), X.case_name(F.col("name")), X.finite(F.col("v")), X.valid_profile(F.col("w")), X.contribution(F.col("state"), F.col("w")), X.one_based(F.lit(4)), X.in_regions(F.lit(5), [(1, 2), (5, 9)]),
        *X.vector_columns("w", "mass"), X.vendor_quality_applies(F.lit(b"\x01\x02"), F.lit(1), F.col("name") == "a-1"), X.strand_base(F.lit("N"), F.lit(True)), X.strand_base(F.lit("A"), F.lit(True)),
    ).collect()
    assert [tuple(r)[:5] for r in got] == [(True, True, True, True, "eligible"), (False, False, False, False, "deletion_event"), (False, True, False, True, "missing_profile"), (False, False, True, False, "eligible")]
    assert tuple(got[0])[5:] == (5, True, 0.25, 0.25, 0.25, 0.25, True, "N", "T") and not got[1][11]


def test_audit_helpers(spark):
    from lociflow.operators import audit as U

    assert U.applicable(16_569, True, "x", "x") and not U.applicable(16_569, False, "x", "x") and not U.applicable(10, True, "x", "x")
    queue = spark.createDataFrame([("locus", "c", 5, None, "mixed", 2), ("locus", "c", 5, None, "edge", 2), ("read", "c", None, 7, "noisy", None)], "item string, case_id string, position long, read long, reason string, recurrence int")
    items = U.decisions_template(R.queue_items(queue)).orderBy("place").collect()
    assert [(r.item, r.reasons, r.place, r.decision) for r in items] == [("locus", "edge;mixed", 1, ""), ("read", "noisy", 2, "")] and items[0].item_id != items[1].item_id


def test_research_sources(spark, tmp_path):
    loci = spark.createDataFrame([("c", 3, "A", [([1.0, 0.0, 0.0, 0.0], "r")])], "case_id string, position_1based int, reference_base string, observations array<struct<weights:array<double>,read:string>>")
    assert corpus.research_observations(loci).first().asDict() == {"case_id": "c", "position_1based": 3, "reference_base": "A", "observation": 0, "read": "r", "weights_a": 1.0, "weights_c": 0.0, "weights_g": 0.0, "weights_t": 0.0}
    for name in ("x_s1_a.ab1", "x_s1_s2_b.ab1", "x_s3_c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted((r.sample, r.owners) for r in corpus.discover_traces(spark, str(tmp_path), ["s1", "s2", "s3"]).collect()) == [("s1", 1), ("s1", 2), ("s2", 2)]
    (tmp_path / "r.tsv").write_text("\ufeff" + "\t".join(corpus.REVIEWER) + "\nfoo_AB12\t1\t1-9\t73G, 310.1C\n", encoding="utf-8")
    assert sorted(tuple(r) for r in corpus.read_reviewer(spark, str(tmp_path / "r.tsv")).collect()) == [("AB12", "foo_AB12", "310.1C"), ("AB12", "foo_AB12", "73G")]
    (tmp_path / "s.json").write_text(json.dumps({"sample_id": "s", "variants": [{"position_1based": 5, "reference": "A", "alternate": "G", "kind": "SNV", "support_topology": {"eligible_reads": n}} for n in (0, 2)]}))
    assert [tuple(r) for r in corpus.sample_variants(spark, str(tmp_path / "s.json")).collect()] == [("s", 5, "A", "G", "SNV")]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert corpus.read_typed(spark, str(tmp_path / "t.csv"), "a int, b string").first().a == 1
    with pytest.raises(Exception):  # noqa: B017, PT011
        corpus.read_typed(spark, str(tmp_path / "t.csv"), "b string, a int").collect()
    digest = "0" * 64
    (tmp_path / "i.json").write_text(json.dumps({"schema_version": "v", "cases": [{"validation_case_id": c, "sample_evidence": "e", "reads": [{"read_sha256": d, "trace_path": "p"}]} for c, d in (("A", digest), ("B", digest), ("_", "1"))]}))
    assert sorted((r.rule, r.subject[:3]) for r in corpus.index_faults(corpus.read_index(spark, str(tmp_path / "i.json"))).collect()) == [("case name", "_"), ("evidence of several cases", "e"), ("read repeated", "000")]


def test_phase_artifacts(spark, tmp_path):
    import hashlib

    windows, candidates = spark.createDataFrame([("w", 1), ("v", 2)], "window_id string, n int"), spark.createDataFrame([("w", -1)], "window_id string, offset int")
    for name in ("one", "two"):
        index = publish.phase_artifact(windows, candidates, f"{tmp_path}/{name}").collect()
        assert sum(r.rows for r in index if r.file == "windows.csv") == 2
        for r in index:
            assert hashlib.sha256(open(f"{tmp_path}/{name}/{r.file}/{r.part}", "rb").read()).hexdigest() == r.sha256
    w, c = corpus.read_runtime(spark, [f"{tmp_path}/one", f"{tmp_path}/two"], "window_id string, n int", "window_id string, offset int")
    assert w.groupBy("artifact").count().count() == 2 and c.count() == 2


def test_differential_loci_modes(spark):
    rows = spark.createDataFrame([("s", 1, "reference"), ("s", 2, "alternate"), ("s", 2, "reference")], "sample string, position int, state string")
    assert S.differential_loci(rows, "sample", "position").count() == 2 and S.differential_loci(rows, "sample", "position", all_covered=True).count() == 3


def test_a_failed_trace_holds_its_sample_back(spark):
    rows = spark.createDataFrame([("s", None), ("s", "abif"), ("t", None)], "sample string, error_class string")
    assert [r.sample for r in publish.complete_samples(rows).collect()] == ["t"]


def test_log_lines_parse_again(spark, tmp_path):
    log = publish.EventLog(str(tmp_path / "l"), "r")
    log.write("sample_read_started", name="a b")
    rows = R.log_events(spark.read.text(str(tmp_path / "l")).select(F.lit("l").alias("log"), F.lit(1).alias("line_no"), F.col("value").alias("line")))
    assert rows.first().fields == {"run_id": "r", "event": "sample_read_started", "name": "a b"} and rows.first().level == "INFO"


def test_sql_names(spark):
    register(spark)
    r = spark.sql("SELECT reverse_complement('ACGTN') AS a, profile_impurity(array(0.5D, 0.5D, 0D, 0D)) AS b, profile_tv(array(1D, 0D), array(0D, 1D)) AS c, round_metric(0.1234565D) AS d").first()
    assert (r.a, r.b, r.c) == ("NACGT", 0.5, 1.0)
    data = spark.createDataFrame([(bytearray(abif.synthetic(QUERY)),)], "content binary")
    data.createOrReplaceTempView("trace_bytes")
    assert [r.tag for r in spark.sql("SELECT tag FROM trace_bytes, LATERAL abif_directory(content) ORDER BY entry").collect()] == ["DATA"] * 4 + ["FWO_", "PLOC"]
    bases = "".join("ACGT"[(i * i * 7 + i * 3 + i // 5 + i // 17) % 4] for i in range(200))
    spark.createDataFrame([(1, bases[40:100]), (2, None), (3, "A")], "read int, query string").createOrReplaceTempView("some_reads")
    rows = spark.sql(f"SELECT * FROM alignment_columns(TABLE(some_reads), '{bases}', true)").collect()
    assert {r.read for r in rows} == {"1"} and sorted((r.col_idx, r.query_base, r.reference_base, r.call_index, r.ref_pos0) for r in rows) == [(i, bases[40 + i], bases[40 + i], i, 40 + i) for i in range(60)]


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.ab1").write_bytes(abif.synthetic(QUERY))
    (source / "b.ab1").write_bytes(b"nothing")
    for _ in range(2):  # the second start finds nothing new
        q = stream_calls(spark, str(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/calls")).count() == 28 and spark.read.parquet(str(tmp_path / "out/errors")).count() == 1
