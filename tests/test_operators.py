"""Operators on literal cases and against brute force."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import scalars, stats
from spanloom.operators import corpus, gates, intervals, joins, kernels, ranking, series

K = ["k"]


def spans(spark, *rows):
    return spark.createDataFrame([("a", s, e) for s, e in rows], "k string, s long, e long")


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def points(spark, times, name="t"):
    return spark.createDataFrame([("a", t) for t in times], f"k string, {name} long")


def test_merge_joins_overlapping_touching_and_near_spans(spark):
    s = spans(spark, (0, 10), (10, 12), (11, 15), (20, 30), (22, 23))
    assert pairs(intervals.merged(s, K), "s", "e", "parts") == [(0, 15, 3), (20, 30, 2)]
    assert pairs(intervals.merged(s, K, 5), "s", "e", "parts") == [(0, 30, 5)]


def test_interval_algebra_matches_sets_of_points(spark):
    rng = random.Random(3)
    for _ in range(4):
        a = [(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 60) for _ in range(8))]
        b = [(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 60) for _ in range(8))]
        cells = lambda x: {i for s, e in x for i in range(s, e)}
        got = lambda df: {i for s, e in pairs(df, "s", "e") for i in range(s, e)}
        x, y = spans(spark, *a), spans(spark, *b)
        assert got(intervals.shared(x, y, K)) == cells(a) & cells(b)
        assert got(intervals.without(x, y, K)) == cells(a) - cells(b)


def test_circular_shift_keeps_the_measure(spark):
    s = spans(spark, (0, 10), (80, 100))
    assert pairs(intervals.shifted(s, 30, 100), "s", "e") == [(10, 30), (30, 40)]
    assert pairs(intervals.shifted(spans(spark, (90, 100)), 5, 100), "s", "e") == [(0, 5), (95, 100)]


def test_envelope_is_bounded_and_overlap_never_lowers_it(spark):
    one = {i: g for i, g in pairs(intervals.envelope(spans(spark, (0, 20)), K, 4, 6), "i", "g")}
    two = {i: g for i, g in pairs(intervals.envelope(spans(spark, (0, 20), (10, 40)), K, 4, 6), "i", "g")}
    assert all(0 <= g <= 1 for g in two.values()) and set(one) == set(range(20))
    assert all(two[i] >= g - 1e-12 for i, g in one.items()) and one[0] == 0 and one[10] == 1


def test_typed_spans_extend_only_within_reach(spark):
    rows = [("a", 0, "press"), ("a", 5, "release"), ("a", 50, "release"), ("a", 60, "press")]
    df = spark.createDataFrame(rows, "k string, t long, kind string")
    assert pairs(intervals.typed(df, K, "t", "kind", "release", 1, 2, 15), "s", "e") == [(-1, 7), (59, 62)]


def test_nearest_and_band_against_brute_force(spark):
    rng = random.Random(5)
    a, b = sorted(rng.sample(range(300), 25)), sorted(rng.sample(range(300), 20))
    got = dict(pairs(joins.nearest(points(spark, a), points(spark, b), K), "t", "distance"))
    assert got == {t: min(abs(t - x) for x in b) for t in a}
    band = pairs(joins.band(points(spark, a), points(spark, b), K, 7, 20), "t", "other")
    assert band == sorted((t, x) for t in a for x in b if t - 7 <= x <= t + 20)
    crowd = dict(pairs(joins.crowding(points(spark, a), K, 15), "t", "crowd"))
    assert crowd == {t: sum(0 < abs(t - x) < 15 for x in a) for t in a}


def test_within_is_false_without_any_right_row(spark):
    a = points(spark, [1, 2])
    assert joins.within(a, points(spark, []), K, 5).count() == 0
    assert joins.within(a, points(spark, []), K, 5, absent=True).count() == 2


@pytest.mark.parametrize(
    "p, o, tolerance, best, greedy",
    [([0.0, 0.04], [0.0, 0.08], 0.05, 2, 2), ([0.028, 0.0], [0.029, 0.031], 0.03, 2, 1), ([0.0, 0.02], [0.019], 0.02, 1, 1)],
)
def test_matching_literals(p, o, tolerance, best, greedy):
    tolerance += 1e-12
    assert len(kernels.optimal(np.sort(p), np.array(o), tolerance)) == best
    assert len(kernels.greedy_input(np.array(p), np.array(o), tolerance)) == greedy


def test_optimal_matching_against_all_assignments():
    rng = np.random.default_rng(7)
    for _ in range(60):
        p, o = np.sort(rng.integers(0, 30, rng.integers(1, 6))), np.sort(rng.integers(0, 30, rng.integers(1, 6)))
        small, large = (p, o) if len(p) <= len(o) else (o, p)
        best = min(
            (-sum(abs(a - large[j]) <= 5 for a, j in zip(small, q, strict=True)), sum(abs(a - large[j]) for a, j in zip(small, q, strict=True) if abs(a - large[j]) <= 5))
            for q in permutations(range(len(large)), len(small))
        )
        got = kernels.optimal(p, o, 5)
        assert (-len(got), sum(abs(p[a] - o[b]) for a, b in got)) == best
        for policy in kernels.POLICIES.values():
            found = policy(p, o, 5)
            assert len({a for a, _ in found}) == len({b for _, b in found}) == len(found) <= len(got)


def test_matched_cuts_series_without_losing_pairs(spark):
    m = kernels.matched(points(spark, [0, 100, 103, 500]), points(spark, [2, 101, 104, 900]), K, 5)
    assert pairs(m, "predicted", "actual") == [(0, 2), (100, 101), (103, 104)]


def test_chained_sessions_differ_from_refractory(spark):
    p = points(spark, [0, 40, 80, 120, 300])
    assert [t for t, first in pairs(series.sessions(p, K, 55), "t", "first") if first] == [0, 300]
    assert [t for (t,) in pairs(kernels.refractory(p, K, 55), "t")] == [0, 80, 300]


def test_suppression_and_separation(spark):
    df = spark.createDataFrame([("a", t, float(v)) for t, v in ((0, 1), (2, 5), (4, 3), (20, 2), (22, 2))], "k string, t long, v double")
    assert [t for (t,) in pairs(kernels.suppressed(df, K, 3, "v"), "t")] == [2, 20]
    assert [t for (t,) in pairs(kernels.min_separation(df, K, 3, "v"), "t")] == [2, 20]
    assert [t for (t,) in pairs(kernels.suppressed(df, K, 3, "v", quota=1), "t")] == [2]


def test_series_windows_on_edges(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 3.0, 3.0, 3.0, 1.0, 5.0])], "k string, i long, v double")
    assert pairs(series.local_maxima(df, K), "i", "v") == [(2, 3.0)]
    smooth = [round(v, 6) for _, v in pairs(series.moving_average(df, K, 3), "i", "smooth")]
    assert smooth == [1.0, 2.0, 3.0, 2.333333, 3.0, 2.0]
    runs = series.runs(df, K, F.col("v") >= 3)
    assert pairs(runs, "s", "e", "n") == [(1, 3, 3), (5, 5, 1)]
    assert pairs(series.histogram(df, K, 2, "i"), "cell", "n") == [(0, 2), (1, 2), (2, 2)]


def test_interpolation_and_lag(spark):
    p = spark.createDataFrame([("a", 0, 0.0), ("a", 10, 10.0)], "k string, t long, v double")
    g = spark.createDataFrame([("a", t) for t in (-5, 0, 4, 10, 12)], "k string, t long")
    assert pairs(series.interpolated(p, g, K), "t", "v") == [(-5, 0.0), (0, 0.0), (4, 4.0), (10, 10.0), (12, 10.0)]
    df = spark.createDataFrame([("a", i, int(i == 5), int(i == 7)) for i in range(12)], "k string, i long, a int, b int")
    assert pairs(series.lag_scan(df, K, "a", "b", 4), "lag", "dot") == [(2, 1)]


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(x), 2.0 * x + 1) for x in range(5)] + [("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0)], "k string, x double, y double")
    c = {r["k"]: r for r in stats.correlated(df, K, "x", "y").collect()}
    assert c["a"]["pearson"] == pytest.approx(1) and c["b"]["pearson"] is None and c["b"]["spearman"] is None
    fit = stats.line_fit(df.where("k = 'a'"), K, "x", "y").first()
    assert fit["slope"] == pytest.approx(2) and fit["largest"] == pytest.approx(0, abs=1e-9)
    loo = stats.leave_one_out(df.where("k = 'a'"), K, "x", "y").agg(F.max(F.abs("loo_residual"))).first()[0]
    assert loo == pytest.approx(0, abs=1e-9)
    x = spark.createDataFrame([("a", v) for v in (1.0, 1.1, 1.2, 5.0, 9.0)], "k string, x double")
    assert pairs(stats.consensus(x, K, "x", 0.3), "n", "offset") == [(3, 1.1)]
    assert pairs(stats.mad(x, K, "x"), "center", "spread")[0][0] == 1.2


def test_clock_map_recovers_drift(spark):
    df = spark.createDataFrame([("a", t, 0.013 + (1 + 70e-6) * t) for t in (0.5, 10.0, 20.0, 30.0)], "k string, x double, y double")
    fit = stats.line_fit(df, K, "x", "y").first()
    assert (fit["slope"] - 1) * 1e6 == pytest.approx(70, abs=1e-3) and fit["intercept"] == pytest.approx(0.013, abs=1e-9)


def test_decisions_never_take_null_as_true(spark):
    df = spark.createDataFrame([(True, True, False), (None, True, True), (True, False, True), (True, False, False)], "need boolean, strong boolean, weak boolean")
    assert [r[0] for r in df.select(gates.decision([F.col("need")], F.col("strong"), F.col("weak"))).collect()] == ["A", "D", "B", "C"]
    rules = {"low": ("x", ">=", 1.0), "high": ("x", "<=", 5.0)}
    x = spark.createDataFrame([(0.0,), (3.0,), (None,)], "x double")
    assert [list(r[0]) for r in x.select(gates.failures(rules)).collect()] == [["low"], [], ["low", "high"]]


def test_running_best_and_first_stop(spark):
    df = spark.createDataFrame([("a", 1, 5.0, True), ("a", 2, 9.0, False), ("a", 3, 7.0, True), ("a", 4, 6.0, True)], "k string, i int, v double, ok boolean")
    got = gates.running_best(df, K, "i", "v", F.col("ok")).orderBy("i").collect()
    assert [(r["best"], r["improved"]) for r in got] == [(5.0, True), (5.0, False), (7.0, True), (7.0, False)]
    assert pairs(gates.first_stop(df, K, "i", ("hot", F.col("v") > 8), ("off", ~F.col("ok"))), "i", "reason") == [(2, "hot")]


def test_splits_are_total_and_disjoint(spark):
    df = spark.range(40).withColumn("score", F.col("id") % 7)
    strata = [("a", F.lit(True), [F.desc("score"), F.col("id")], "TEST"), ("b", F.lit(True), [F.desc("score"), F.col("id")], "TEST"), ("c", F.col("id") < 10, [F.col("id")], "DEV")]
    out = ranking.stratified_split(df, "id", strata, ("DEV", 5), "TRAIN", 1)
    count = dict(pairs(out.groupBy("split").count(), "split", "count"))
    assert count == {"TEST": 2, "DEV": 6, "TRAIN": 32}


def test_privacy_and_labels(spark):
    df = spark.createDataFrame([(1, r"in C:\data\x and /home/u/a", None), (2, "clean", "/Users/k")], "id int, a string, b string")
    assert pairs(corpus.private_findings(df, "id", ["a", "b"]), "id", "found") == [(1, "/home/u/a"), (1, r"C:\data\x"), (2, "/Users/k")]
    assert corpus.public(df, ["id", "zzz"]).columns == ["id"]
    js = spark.createDataFrame([(1, '{"a": {"b": "x"}, "c": 3}'), (2, "broken")], "id int, j string")
    assert pairs(corpus.walked(js, "id", "j"), "path", "value") == [(["a", "b"], "x"), (["c"], "3")]
    tiers = spark.createDataFrame([(4.1, 0.4), (4.1, 0.35), (2.5, 1.0), (1.6, 1.0)], "r double, p double").select(scalars.confidence_tier("r", "p"))
    assert [r[0] for r in tiers.collect()] == ["strong", "present", "weak", "no_transient"]


def test_empty_inputs(spark):
    none = spans(spark)
    assert intervals.merged(none, K).count() == intervals.partitioned({"a": none, "b": none}, K).count() == 0
    assert kernels.matched(points(spark, []), points(spark, []), K, 5).count() == 0
    assert series.histogram(points(spark, []), K, 2).count() == 0
