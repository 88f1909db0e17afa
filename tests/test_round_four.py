"""Faults of the third review's second list, each on rows that showed it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociflow.functions import expressions as X
from lociflow.operators import calls as C
from lociflow.operators import counters as K
from lociflow.operators import matching as M
from lociflow.operators import ranks as N
from lociflow.operators import samples as S
from lociflow.plans import bridges as B
from lociflow.plans import catalog
from lociflow.sources import measurements


def test_units_of_one_part_meet_in_one_shuffle(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("h"), (F.col("id") % 901).alias("a"), (F.col("id") % 11).alias("b"))
    pair = F.struct("a", "b")
    units = {"a": F.col("a"), "some": F.when(F.col("b") > 4, F.col("a")), "pairs": pair, "b": F.col("b"), "none": F.lit(None).cast("int")}
    got = K.distinct_units(rows, ["g", "h"], units, {"s": F.sum("b")}, dict.fromkeys(("a", "some", "pairs"), F.col("a")))
    want = rows.groupBy("g", "h").agg(F.count("*").alias("rows"), F.sum("b").alias("s"), *[F.count_distinct(c).alias(n) for n, c in units.items()])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Expand" not in plan


def test_rows_of_large_groups_are_not_joined_by_group(spark):
    rows = spark.range(3_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 997).cast("double").alias("v"))
    got = N.grouped_ranks(rows, ["g"], [F.count("*").alias("n")], {"p50": ("v", 0.5), "p99": ("v", 0.99)}, limit=100)
    want = rows.groupBy("g").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("p50"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY v)").alias("p99"))
    assert sorted(got.collect()) == sorted(want.collect())
    names = N._sent(rows.select("g").distinct(), 2)
    assert "ResolvedHint" in names._jdf.queryExecution().analyzed().toString() and N._sent(rows, N.SENT + 1) is rows


def test_clipped_samples_are_counted_without_a_lambda(spark):
    channels = [[32767, 0, -32768], [1, 2, 3], [32767, 32767, 5], [0, 0, 0]]
    traces = spark.createDataFrame([("a", channels, [0, 2], "AC", None, None)], "input_name string, channels array<array<int>>, ploc array<int>, vendor_primary string, vendor_quality binary, error_class string")
    found = C.trace_integrity(traces, ("input_name",))
    assert found.first().clipped_samples == 4
    assert "aggregate(" not in found._jdf.queryExecution().analyzed().toString()


def test_neighbours_are_counted_in_their_sequence(spark):
    texts = ["ACGT", "AAAA", "CAAC", "TT", "GATTACAAGGGC", "A"]
    rows = spark.createDataFrame([(t,) for t in texts], "bases string")
    for r in rows.select("bases", X.neighbour_counts(F.col("bases")).alias("x")).collect():
        want = {}
        for i in range(len(r.bases) - 1):
            want[r.bases[i : i + 2]] = want.get(r.bases[i : i + 2], 0) + 1
        assert {x.pair: x.n for x in r.x if x.n} == want


def test_events_are_dealt_in_proportion_to_their_number(spark, monkeypatch):
    monkeypatch.setattr(M, "HELD_EVENTS", 50)
    rows = spark.range(300).select((F.col("id") % 90).alias("sample"), F.col("id").cast("int").alias("at"), F.lit("SNV").alias("kind"), (F.col("id") % 4 + 1).cast("int").alias("position"), F.lit("A").alias("reference"), F.when(F.col("id") % 5 == 0, "C").otherwise("G").alias("alternate"))
    truth, called = rows.where("id % 7 > 0").withColumn("alternates", F.array("alternate")).drop("alternate"), rows.where("id % 11 > 0")
    tasks = M.task_count(truth, called)
    assert tasks == -(-(257 + 272) // 50) > spark.sparkContext.defaultParallelism
    keys = ["position", "alternate"]
    found = M.paired(truth.withColumn("alternate", F.explode("alternates")), called, keys, tasks)
    # the place in the order of equal keys, by plain Python
    sides = [{}, {}]
    for i in range(300):
        key = (i % 90, i % 4 + 1, i % 5 == 0)
        for side, n in zip(sides, (7, 11), strict=True):
            if i % n:
                side.setdefault(key, []).append(i)
    want = sorted((k[0], a, b) for k in sides[0] for a, b in zip(sides[0][k], sides[1].get(k, []), strict=False))
    assert sorted(map(tuple, found.collect())) == want
    assert found.rdd.getNumPartitions() == tasks
    plan = M.compare(truth, called, "AAAA")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"RepartitionByExpression [sample#") == plan.count(f", {tasks}") > 0


def test_events_of_users_are_dealt_in_proportion_to_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "EVENTS", 100)
    kinds = F.element_at(F.array(*map(F.lit, ("click", "view", "signup", "purchase"))), (F.col("id") * 7 % 4 + 1).cast("int"))
    spark.range(2_000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 37).alias("user_id"), kinds.alias("event_type"), (F.col("id") % 91).cast("double").alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    found = catalog.queries()["persistence"](spark, str(tmp_path))
    assert found.count() > 0
    # all steps stay where the users were dealt to, so none of them grows with the table
    assert found.rdd.getNumPartitions() == 20 > spark.sparkContext.defaultParallelism


def test_measurement_lines_are_parsed_once(spark):
    line = '{"schema_version": "x", "sample_id": "c", "position_1based": "%d", "signal_version": "1", "reads": "1", "observations": [{"read_sha256": "r"}]}'
    lines = spark.createDataFrame([("f", "c", i, line % p) for i, p in enumerate((3, 5, 4), 1)] + [("f", "c", 4, "{")], "file string, sample string, line_no long, line string")
    rows = measurements.measurement_rows(lines, "sample")
    found = measurements.row_faults(rows, spark.createDataFrame([("c", "r")], "case string, read_sha256 string"), "x")
    assert sorted((r.line_no, r.rule) for r in found.collect() if r.rule in ("position does not increase", "no JSON object")) == [(3, "position does not increase"), (4, "no JSON object")]
    assert not any(f in found._jdf.queryExecution().optimizedPlan().toString().lower() for f in ("parse_json", "parsejson", "from_json", "jsontostructs"))
