"""Faults of the fourth round's findings, each on rows that showed it."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.operators import audit as U
from lociflow.operators import calls as C
from lociflow.operators import matching as M
from lociflow.operators import windows as W
from lociflow.plans import audits, catalog  # noqa: F401, audits adds its queries to the catalogue
from lociflow.sources import abif


def _case(rng, reference, n):
    """Events one behind the other on either side, some of them the same bases otherwise split."""
    other, truth, called, p = dict(zip("ACGT", "GTAC", strict=True)), [], [], 1 + rng.randrange(4)
    for k in range(n):
        x, y = reference[p - 1], reference[p]
        truth += [(2 * k, p, x, other[x]), (2 * k + 1, p + 1, y, other[y])]
        called.append((k, p, x + y, other[x] + (other[y] if rng.random() < 0.7 else "")))
        p += 2 + rng.randrange(3)
    return truth, called


def test_samples_worked_on_together_have_the_runs_of_each_alone():
    rng = random.Random(7)
    reference = "".join(rng.choice("ACGT") for _ in range(60))
    sums = M.prefix_sums(reference)
    cases = [_case(rng, reference, rng.randrange(5)) for _ in range(200)]
    alone = [(s, t, c) for s, (truth, called) in enumerate(cases) for t, c in M.equal_runs(M.Side(truth, reference, sums), M.Side(called, reference, sums))]
    sides = [M.Side([r for case in cases for r in case[k]], reference, sums, [s for s, case in enumerate(cases) for _ in case[k]]) for k in (0, 1)]
    found = M._equal_runs(*sides)
    got = [(int(sides[0].sample[a]), sides[0].at[a : b + 1].tolist(), sides[1].at[c : d + 1].tolist()) for a, b, c, d in found.tolist()]
    assert got == alone and len(alone) > 100
    assert all(sides[0].sample[a] == sides[0].sample[b] == sides[1].sample[c] == sides[1].sample[d] for a, b, c, d in found.tolist())


def test_many_small_samples_take_a_short_time():
    rng = random.Random(8)
    reference = "".join(rng.choice("ACGT") for _ in range(300))
    sums = M.prefix_sums(reference)
    cases = [_case(rng, reference, 2) for _ in range(5_000)]
    began = time.process_time()
    sides = [M.Side([r for case in cases for r in case[k]], reference, sums, [s for s, case in enumerate(cases) for _ in case[k]]) for k in (0, 1)]
    assert len(M._equal_runs(*sides)) > 5_000
    # each sample alone took more than a millisecond
    assert time.process_time() - began < 3


def test_runs_are_found_once_for_both_sides(spark):
    rows = [(s, side, at, p, "ACGT"[(p - 1) % 4 :][:n], "CGTA"[(p - 1) % 4 :][:n]) for s in range(50) for side, at, p, n in (("truth", 0, 5, 2), ("called", 0, 5, 1), ("called", 1, 6, 1))]
    events = spark.createDataFrame(rows, "sample int, side string, at int, position int, reference string, alternate string")
    found = M.run_events(events, "ACGT" * 10)
    assert sorted((r.sample, r.group, r.side, r.at) for r in found.collect()) == sorted((s, 1, side, at) for s in range(50) for side, at in (("truth", 0), ("called", 0), ("called", 1)))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_numbers_of_pairs_begin_anew_in_each_sample(spark, monkeypatch):
    """Whatever samples are worked on together."""
    reference = "ACGTTGCA" * 5
    rows = [(s, side, k if side == "truth" else 2 * k + h, p + h, reference[p + h - 1 :][:n], reference[p + h - 1 :][:n].translate(str.maketrans("ACGT", "CGTA"))) for s in range(30) for k in range(s % 4) for p in (3 + 6 * k,) for side, h, n in (("truth", 0, 2), ("called", 0, 1), ("called", 1, 1))]
    events = spark.createDataFrame(rows, "sample int, side string, at int, position int, reference string, alternate string")
    want = sorted((s, k + 1, [k], [2 * k, 2 * k + 1]) for s in range(30) for k in range(s % 4))
    for runs in (1, 50, 10**9):
        monkeypatch.setattr(M, "RUNS", runs)
        assert sorted(tuple(r) for r in M.run_pairs(events, reference).collect()) == want


# --- traces


def _noisy_files(rng, n=40):
    """Traces of random samples with ties, of calls at uneven places, some of too few calls, one that is none, and one name twice."""
    files = []
    for k in range(n):
        samples, calls = int(rng.integers(40, 400)), int(rng.integers(1, 40))
        channels = rng.integers(-2, (4, 1000)[k % 2], (4, samples))
        if k % 3 == 0:
            channels[rng.random(channels.shape) < 0.8] = 0
        ploc = np.sort(rng.choice(samples, calls, replace=False))
        files.append((f"t{k}", abif.encode(list(channels), ploc, calls="".join(rng.choice(list("ACGTN"), max(1, calls - k % 4))))))
    return [*files, ("bad", b"none"), ("t1", files[5][1])]


def _same(left, right):
    assert left.columns == right.columns and sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_files_give_what_their_decoded_traces_give(spark):
    files = spark.createDataFrame([(n, bytearray(x)) for n, x in _noisy_files(np.random.default_rng(3))], "path string, content binary")
    traces = abif.decode_traces(files)
    for work in (C.call_bases, C.call_windows, C.locus_evidence, C.warning_counts):
        _same(work(files), work(traces))
    some = C.locus_evidence(files, keys=("input_name",), columns=("call_index", "profile"))
    _same(some, C.locus_evidence(traces).select("input_name", "call_index", "profile"))


def test_channels_of_files_are_decoded_where_they_are_read(spark):
    for name in ("basecall", "call_windows", "locus_profiles", "read_warnings"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        # the bridge's writer and one reader; nothing else leaves a worker
        assert plan.count("MapInArrow") == 2 and "channels" not in plan


def test_warnings_are_counted_in_their_trace(spark):
    traces = abif.decode_traces(spark.createDataFrame([(n, bytearray(x)) for n, x in _noisy_files(np.random.default_rng(4))[:-1]], "path string, content binary"))
    keys = ["input_name"]
    noisy = W.noisy_regions(C.call_windows(traces, keys=tuple(keys)), keys, 2).groupBy(*keys).agg(F.count("*").alias("noisy_regions"))
    calls = C.call_bases(traces, keys=tuple(keys)).groupBy(*keys)
    own = calls.agg(F.count_if(~X.canonical(F.col("ambiguity"))).alias("ambiguous_calls"), F.count_if(~F.col("vendor_agrees")).alias("vendor_disagreements"), F.count_if(F.col("primary_pos").isNull()).alias("calls_without_peak"))
    want = own.join(noisy, keys, "left").fillna(0)
    found = U.read_warnings(traces, keys)
    _same(found.drop("warnings"), want)
    assert found.where("noisy_regions > 0 AND ambiguous_calls > 0").count() > 5
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_ratios_are_rounded_as_expressions_are(spark):
    rng = np.random.default_rng(5)
    values = [*(rng.random(300) * 10.0 ** rng.integers(-7, 7, 300)), 0.0, 5e-7, 4.9999999999999994e-7, 1.5e-6, 2.5e-6, 0.4769362762044699, 1000.0, 2.9999995, 1e12]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", X.round_metric(F.col("v")).alias("r")).collect()
    assert C._round_metric(np.array([r.v for r in rows])).tolist() == [r.r for r in rows]


def test_traces_worked_on_together_give_the_rows_of_each_alone():
    some = []
    for _, data in _noisy_files(np.random.default_rng(6))[:-2]:
        channels, ploc, vendor, _ = abif.decode(data)
        if len(ploc) > 1:
            some.append((channels, ploc, vendor))
    called, evidence = list(C._chosen(C.CALL, None)), list(C._chosen(C.EVIDENCE, None))
    for work in (lambda t: C._called(t, 0.33, called), lambda t: C._evidence(t, 10, evidence), lambda t: [t.index[C._runs(t, 10)[0]], *C._runs(t, 10)[1:]]):
        alone = [[x.tolist() for x in work(C.Traces([one]))] for one in some]
        together = [x.tolist() for x in work(C.Traces(some))]
        assert together == [sum(parts, []) for parts in zip(*alone, strict=True)] and len(together[0]) > 300


def test_many_traces_take_a_short_time():
    rng = np.random.default_rng(7)
    some = [abif.decode(abif.synthetic("".join(rng.choice(list("ACGT"), 50))))[:3] for _ in range(2_000)]
    began = time.process_time()
    for at in range(0, len(some), 150):
        C._runs(C.Traces(some[at : at + 150]), 10)
    # each trace alone took half a millisecond or more for each of its four channels
    assert time.process_time() - began < 1.5
