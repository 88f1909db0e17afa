"""Faults that the third review found, each on rows that showed it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lociflow.operators import alignment as A
from lociflow.operators import calls as C
from lociflow.operators import phase as H
from lociflow.operators import samples as S
from lociflow.operators import windows as W
from lociflow.sources import abif


def test_a_place_beyond_the_circle_is_nobodys_neighbour(spark):
    rows = spark.createDataFrame([("s", 1, 9, 0.1), ("s", 1, 0, 0.2), ("s", 1, 15, 0.5), ("s", 1, 19, 0.7)], "sample string, read int, position int, a double")
    found = {r.position: (r.previous_mass, r.next_mass) for r in S.neighbour_mass(rows, ["sample", "read"], "position", "a", 10).collect()}
    # 15 looks at 4 and 6, 19 at 8 and 0; 0 looks at 9 alone, not at 19 too
    assert found == {9: (None, 0.2), 0: (0.1, None), 15: (None, None), 19: (None, 0.2)}


def test_a_window_of_just_the_limit_is_kept(spark):
    # the best section is one call of penalty 3, so the limit of ten calls is 1.2 * 3 * 10 = 36, and the calls after it have just that
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([3, 4, 4, 4, 4, 4, 4, 3, 3, 3, 3])], "k int, call_index int, penalty long")
    best = spark.createDataFrame([(1, 0, 1, 3, 11)], "k int, best_start int, best_end int, best_sum long, n long")
    assert W.trim(rows, best, ["k"], 10, 1.2, 1).first().trim_end == 11


def test_equal_reads_are_placed_once_a_task(spark, tmp_path):
    query = "ACGTCAGTACGATCGTACCTGAGTACGA"
    one = lambda b: [float(b == x) for x in "ACGT"]
    rows = [(i, query, [None if j == i % 2 else one(b) for j, b in enumerate(query)], i % 3) for i in range(12)]
    reads = spark.createDataFrame(rows, "read int, query string, profiles array<array<double>>, first_call int").coalesce(1)
    plain = {r[0]: A.align_read(r[1], r[2], r[3], "TTTT" + query + "CCCC", False, A.Scoring()) for r in rows}
    got = A.align_reads(reads, "TTTT" + query + "CCCC").collect()
    assert {r.read: [r.orientation, r.score, r.start0, [c.call_index for c in r["columns"]]] for r in got} == {k: [*p[:3], [c["call_index"] for c in p[11]]] for k, p in plain.items()}
    batch = pa.RecordBatch.from_pylist([{"q": q, "p": p, "f": f} for _, q, p, f in rows], pa.schema([("q", pa.string()), ("p", pa.list_(pa.list_(pa.float64()))), ("f", pa.int32())]))
    assert len(set(A.read_contents(*batch.columns))) == 6


def test_candidates_are_not_joined_by_distance(spark):
    weights = [0.5, 0.25, 0.125, 0.125]
    rows = [(1, i, "ACGT"[i * i % 3], None if i % 9 == 0 else weights) for i in range(1, 60) if i % 13] + [(1, 20, "T", None)]
    seen = spark.createDataFrame(rows, "k int, distance long, base string, weights array<double>")
    found = H.candidates(H.members(seen, ["k"], 25, 5), seen, ["k"], 2)
    members = [(r.window, r.distance, r.base) for r in H.members(seen, ["k"], 25, 5).collect()]
    want = {}
    for window, distance, base in members:
        for o in (-2, -1, 1, 2):
            there = [b for _, d, b, _ in rows if d == distance + o]
            want[window, o] = want.get((window, o), 0) + sum(b != base for b in there)
    assert {(r.window, r.offset): r.informative for r in found.collect()} == want
    # what is shuffled is a row an observation: no exchange lies above the rows of windows and offsets
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_vendor_letters_stay_with_their_trace(spark):
    files = spark.createDataFrame([("a", bytearray(abif.synthetic("ACGTACGT", calls="ACG"))), ("b", bytearray(abif.synthetic("ACGT")))], "path string, content binary")
    got = C.call_bases(abif.decode_traces(files), keys=("input_name",), columns=("call_index", "primary", "vendor_agrees"))
    assert got.columns == ["input_name", "call_index", "primary", "vendor_agrees"]
    assert sorted((r.input_name, r.call_index, r.vendor_agrees) for r in got.collect()) == [*(("a", i, True if i < 3 else None) for i in range(8)), *(("b", i, None) for i in range(4))]
    assert "vendor_primary" not in got._jdf.queryExecution().analyzed().toString().split("MapInArrow")[0]


def test_noise_of_flat_and_other_intervals(spark):
    rng = np.random.default_rng(3)
    channel = np.where(rng.random(400) < 0.7, 7, rng.integers(0, 50, 400)).astype(np.int32)
    starts = np.arange(0, 360, 3)
    ends = starts + rng.integers(2, 40, len(starts))
    base, sigma = C.noise(channel, starts, ends)
    for b, s, i, j in zip(base, sigma, starts, ends, strict=True):
        steps = np.diff(channel[i:j].astype(float))
        assert b == np.median(channel[i:j]) and s == max(np.median(np.abs(steps - np.median(steps))) / C.NOISE_SCALE, 1.0)
