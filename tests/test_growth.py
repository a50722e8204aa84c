"""Steps whose cost or result once depended on the size of groups or the order of rows."""

import os
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from spanloom.functions import stats
from spanloom.operators import joins, series, waves
from spanloom.plans import QUERIES, spans
from spanloom.streaming import twins


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_no_running_frame_reaches_to_the_end(spark):
    """Such a frame is scanned anew from every row, which made long series quadratic."""
    x = spark.range(400).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.lit(1.0).alias("v"))
    points = x.where("i % 100 = 50").select("k", F.col("i").alias("t"), (F.col("i") / 1000).alias("p"))
    got = waves.gated(x, points, ["k"], "v", 1.0)
    near = joins.nearest(x.select("k", F.col("i").alias("t")), points.select("k", "t"), ["k"])
    assert not any("unboundedfollowing" in plan(df) for df in (got, near))
    want = {i: 1 - min(max(i, 50), 350) / 1000 for i in range(400)}
    assert {r["i"]: r["gated"] for r in got.collect()} == pytest.approx(want)
    after = {i: next((t for t in (50, 150, 250, 350) if t > i), None) for i in range(400)}
    assert {r["t"]: r["after"] for r in near.collect()} == after


def test_a_grid_without_points_and_points_at_its_ends(spark):
    p = spark.createDataFrame([("a", 2, 5.0), ("a", 6, 9.0)], "k string, t long, v double")
    g = spark.createDataFrame([("a", 0), ("a", 2), ("a", 3), ("a", 6), ("a", 9), ("b", 1)], "k string, t long")
    got = {(r["k"], r["t"]): r["v"] for r in series.interpolated(p, g, ["k"]).collect()}
    assert got == {("a", 0): 5.0, ("a", 2): 5.0, ("a", 3): 6.0, ("a", 6): 9.0, ("a", 9): 9.0, ("b", 1): None}


def test_records_meet_one_candidate_of_a_kind(spark):
    many = spark.range(5000).select(F.col("id").alias("s"), (F.col("id") % 25).alias("n"))
    kinds = joins.alike(many, {"n": F.col("n"), "d": F.col("s") % 10}, "s")
    assert {(r["n"], r["d"]): r["s"] for r in kinds.collect()} == {(s % 25, s % 10): s for s in range(4999, -1, -1)}


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Means that are exactly the limits, of values in an order in which a running sum of doubles ends above or below them."""
    kinds = [(1, 13, (0.0,), (0.01, 0.03, 0.06, 0.08)), (2, 20, (0.0,), (0.01, 0.02, 0.03, 0.05, 0.07)), (3, 13, (0.01, 0.04, 0.07, 0.1), (0.04,)), (4, 13, (0.05,), (0.02, 0.02, 0.04, 0.05, 0.08))]
    rows = [(k, 1, d, t) for k, n, ds, ts in kinds for d, t in zip(sorted(ds * n * len(ts)), sorted(ts * n * len(ds)), strict=True)]
    folder = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_discount double, l_tax double").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_a_mean_at_the_limit_is_valid(spark, lines):
    assert {r["k"]: r["valid"] for r in QUERIES["checkpoint_validity"](spark, lines).collect()} == {1: True, 2: True, 3: True, 4: True}


def test_a_mean_is_plain_where_values_are_no_decimals(spark):
    rows = spark.createDataFrame([(1, 1e-20), (1, 3e-20), (2, float("nan")), (2, 1.0), (3, None), (3, 2.0), (4, 1e300), (5, None)], "k int, x double")
    got = {r["k"]: (r["m"], r["s"]) for r in rows.groupBy("k").agg(stats.steady_mean("x").alias("m"), stats.steady_sum("x").alias("s")).collect()}
    assert got[1] == pytest.approx((2e-20, 4e-20), rel=1e-9, abs=0) and got[2][0] != got[2][0] and got[3] == (2.0, 2.0) and got[4] == (1e300, 1e300) and got[5] == (None, None)


def test_a_mean_at_the_limit_is_no_stop(spark, lines):
    assert {r["k"]: r["reason"] for r in QUERIES["first_stop_condition"](spark, lines).collect()} == {}


def test_a_mean_at_the_guard_counts(spark, lines):
    assert {r["k"]: r["best"] for r in QUERIES["running_best_guarded"](spark, lines).collect() if r["k"] in (2, 3, 4)} == {2: 0.0, 3: -0.055, 4: -0.05}


def test_stops_and_bests_are_those_of_exact_means(spark, sf):
    """By whole hundredths and fractions in plain Python; where a mean is the limit itself the SQL goes by the order of its sums."""
    folder = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.1")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    sums = spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_suppkey", "l_linenumber").agg(cents("l_discount").alias("d"), cents("l_tax").alias("t"), F.count("*").alias("n")).collect()
    stops, bests, held, limits = {}, {}, {}, 0
    for k, step, d, t, n in sorted(sums):
        err, weak = Fraction(d, 100 * n), Fraction(t, 100 * n)
        limits += err == Fraction("0.055") or weak in (Fraction("0.036"), Fraction("0.042"))
        if err > Fraction("0.055") or weak < Fraction("0.036"):
            stops.setdefault(k, (step, "collapse" if err > Fraction("0.055") else "passthrough"))
        h = -int(err * 10**8 + Fraction(1, 2)) if weak <= Fraction("0.042") else None
        bests[k, step] = h is not None and (k not in held or h > held[k])
        if bests[k, step]:
            held[k] = h
    assert limits > 0
    assert {r["k"]: (r["step"], r["reason"]) for r in QUERIES["first_stop_condition"](spark, folder).collect()} == stops
    assert {(r["k"], r["step"]): r["improved"] for r in QUERIES["running_best_guarded"](spark, folder).collect()} == bests


def test_days_of_equal_load_lie_in_both_quartiles(spark, tmp_path):
    """Loads of 0.1, 0.2 and 0.3 in two orders are equal, so every day is at the quartiles."""
    orders = [(0.1, 0.2, 0.3), (0.3, 0.2, 0.1), (0.2, 0.3, 0.1), (0.1, 0.1, 0.4)]
    rows = [(3 * d + n, f"2024-01-0{d + 1} 0{n}:00:00", 7, "click", v, "{}") for d, vs in enumerate(orders) for n, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [(r["heavy"], r["quiet"]) for r in QUERIES["quartile_class_selectivity"](spark, str(tmp_path)).collect()] == [(0.2, 0.2)]


def test_a_gain_halfway_between_two_digits_goes_up(spark, sf):
    """Sums of gains as decimals in plain Python; of 1,500 users 14 have a mean halfway."""
    folder = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.1")
    gains = spans.envelope(spark, folder).groupBy("user_id").agg(F.collect_list("g").alias("g")).collect()
    mean = lambda g: sum(Decimal(f"{x:.12f}") for x in g) / 720
    want = {r["user_id"]: float(mean(r["g"]).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for r in gains}
    assert {r["user_id"]: r["mean_gain"] for r in QUERIES["gate_support"](spark, folder).collect()} == want


def test_ranks_take_one_shuffle_into_tasks_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(stats, "TASK", 100)
    rows = spark.range(2000).select((F.col("id") % 50).alias("k"), (F.col("id") % 7).alias("x"), (F.col("id") * 37 % 11).alias("y"))
    got = stats.correlated(rows, ["k"], "x", "y")
    assert plan(got).count("exchange hashpartitioning") == 1 and "hashpartitioning(k#" in plan(got) and ", 20)" in plan(got)
    assert got.count() == 50


@pytest.mark.parametrize("few, joins_seen", [(10_000, True), (0, False)])
def test_brackets_of_few_groups_are_broadcast(spark, monkeypatch, few, joins_seen):
    """Rows of three groups once met their brackets in three tasks."""
    monkeypatch.setattr(stats, "FEW", few)
    rows = spark.range(30_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 30_011).cast("double").alias("x"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = stats.exact_quantiles(rows, ["k"], "x", [0.25, 0.85])
        assert ("broadcasthashjoin" in plan(got)) == joins_seen
        want = rows.groupBy("k").agg(F.percentile("x", [0.25, 0.85]).alias("q"))
        assert {r["k"]: r["q"] for r in got.collect()} == {r["k"]: pytest.approx(r["q"]) for r in want.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_cap_is_found_without_a_buffer_of_a_group(spark, sf):
    assert "percentile(" not in plan(QUERIES["percentile_cap_filter"](spark, sf))


def test_an_onset_at_the_limit_is_not_over_it(spark):
    """Copies of a frame whose strength is the median and one MAD, 7 and 1, apart in the last digits as sums in other orders are."""
    noise = [-2e-15, 0.0, 2e-15, 4e-15]
    values = [x for n in noise for x in (7.0, 8.0 + n, 6.5, 7.5, 5.0, 9.0, 4.0)] + [7.0]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "k int, frame long, strength double")
    assert len({v for v in values if abs(v - 8.0) < 1e-9}) > 1
    got = {r["frame"]: r["strength"] for r in waves.onsets(rows, ["k"], 1.0, 1).collect()}
    assert got == {7 * n + 5: 9.0 for n in range(4)}


def test_a_stream_keeps_a_state_for_a_group_of_keys(spark, tmp_path):
    """Many more keys than groups, with and without a null key: calls into the state are by group, decisions by key."""
    rows = [(n, n % 400 if n % 401 else None, n * 60_000_000, float(n % 97)) for n in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t long, value double").withColumn("ts", F.timestamp_micros(F.col("t") + 1_700_000_000_000_000).cast("timestamp_ntz"))
    states = []
    where, schema = twins.staged(spark, df.drop("t"), 2)
    got = twins.run(spark, twins.refractory(twins.source(spark, where, schema), 500 * 60_000_000, 24 * 3_600_000), lambda p: states.append(p["stateOperators"][0]["numRowsTotal"]))
    last, want = {}, set()
    for n, u, t, _ in rows:
        if u not in last or t - last[u] >= 500 * 60_000_000:
            last[u] = t
            want.add((u, n))
    assert {(r["user_id"], r["event_id"]) for r in got.collect()} == want
    assert 0 < max(states) <= 10 * twins.GROUPS
