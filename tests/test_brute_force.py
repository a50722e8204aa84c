"""Queries that SQL can't express, against plain versions over the driver's tables."""

import cmath
import itertools
import math
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import kernels
from spanloom.operators import signal as sg
from spanloom.plans import QUERIES
from spanloom.plans.tables import waves
from spanloom.sources import files
from spanloom.streaming import twins

HOUR = 3_600_000_000


def sides(spark, sf):
    p, o = defaultdict(list), defaultdict(list)
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).collect():
        if r["event_type"] in ("click", "purchase"):
            (p if r["event_type"] == "click" else o)[r["user_id"]].append(r["t"])
    return p, o


def cheapest(p, o, tolerance):
    """(pairs, least total) by shortest augmenting paths with Bellman-Ford."""
    n, m = len(p), len(o)
    match, total, pairs = {}, 0, 0
    while True:
        edges = []
        for i, x in enumerate(p):
            for j, y in enumerate(o):
                if abs(x - y) <= tolerance:
                    edges.append((n + j, i, -abs(x - y)) if match.get(j) == i else (i, n + j, abs(x - y)))
        taken = set(match.values())
        dist, prev = {i: 0 for i in range(n) if i not in taken}, {}
        for _ in range(n + m):
            moved = False
            for a, b, w in edges:
                if a in dist and dist[a] + w < dist.get(b, math.inf):
                    dist[b], prev[b], moved = dist[a] + w, a, True
            if not moved:
                break
        ends = [n + j for j in range(m) if j not in match and n + j in dist]
        if not ends:
            return pairs, total
        at = min(ends, key=dist.get)
        total, pairs = total + dist[at], pairs + 1
        while at in prev:
            a = prev[at]
            if a < n:
                match[at - n] = a
            at = a


def test_optimal_matching_on_the_tables(spark, sf):
    p, o = sides(spark, sf)
    want = {u: cheapest(sorted(p[u]), sorted(o[u]), 6 * HOUR) for u in p if o[u]}
    got = {r["user_id"]: (r["pairs"], r["total"]) for r in QUERIES["match_optimal"](spark, sf).collect()}
    assert got == {u: v for u, v in want.items() if v[0]}
    block = {r["hours"]: (r["hits"], r["n_pred"], r["n_label"]) for r in QUERIES["match_tolerance_block"](spark, sf).collect()}
    for hours in (1, 3, 6):
        hits = sum(cheapest(sorted(p[u]), sorted(o[u]), hours * HOUR)[0] for u in p)
        assert block[hours] == (hits, sum(map(len, p.values())), sum(map(len, o.values())))
    pairs = {r["user_id"]: (r["n_output"], r["coincidence"]) for r in QUERIES["onset_coincidence"](spark, sf).collect()}
    assert pairs == {u: (len(p[u]), cheapest(sorted(p[u]), sorted(o[u]), 3 * HOUR)[0]) for u in p if p[u]}


@pytest.mark.parametrize("seed", range(6))
def test_matching_kernels(seed):
    """Banded and windowed kernels against all orders of small cases, ties and copies included."""
    rng = np.random.default_rng(seed)
    for _ in range(60):
        p, o = (np.sort(rng.integers(0, 30, rng.integers(0, 6))) for _ in range(2))
        found = kernels.optimal(p, o, 5)
        best = (0, 0)
        for k in range(min(len(p), len(o)), 0, -1):
            costs = [
                sum(abs(int(p[i]) - int(o[j])) for i, j in zip(a, b, strict=True))
                for a in itertools.combinations(range(len(p)), k)
                for b in itertools.permutations(range(len(o)), k)
                if all(abs(int(p[i]) - int(o[j])) <= 5 for i, j in zip(a, b, strict=True))
            ]
            if costs:
                best = (k, min(costs))
                break
        assert (len(found), sum(abs(int(p[i]) - int(o[j])) for i, j in found)) == best
        o = np.sort(np.repeat(o, rng.integers(1, 4)))
        for x in p:
            assert kernels._nearest(o, x, 3) == np.argsort(np.abs(o - x), kind="stable")[:3].tolist()


def test_files_and_frames(spark, sf):
    held = {f: os.path.getsize(f"{sf}/{f}") for f in os.listdir(sf)}
    assert {r["name"]: r["bytes"] for r in QUERIES["file_catalog"](spark, sf).collect()} == held
    assert {r["category"] for r in QUERIES["file_catalog"](spark, sf).collect()} == {"table"}
    assert [r["name"] for r in QUERIES["latest_optional"](spark, sf).collect()] == ["orders.parquet"]
    rows = {r["frame"]: r for r in QUERIES["raw_frame_source"](spark, sf).collect()}
    assert sorted(rows) == list(range(spark.read.parquet(f"{sf}/embeddings.parquet").count())) and rows[0]["diff"] == 0 and all(0 <= rows[k]["warm"] <= 1 and 0 <= rows[k]["bright"] <= 255 for k in rows)
    files.register(spark)
    assert rows[0]["diff"] == 0.0


def test_exact_quantiles_of_large_and_small_groups(spark):
    from spanloom.functions import stats

    rng = np.random.default_rng(5)
    parts = {"big": np.round(rng.normal(size=5000), 2), "ties": rng.integers(0, 3, 3000).astype(float), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in parts.items() for v in vs] + [("few", None)], "k string, v double").repartition(5)
    points = (0.0, 0.1, 0.5, 0.9, 1.0)
    for accuracy in (100, 10_000):
        got = {r["k"]: r["q"] for r in stats.exact_quantiles(df, ["k"], "v", points, accuracy).collect()}
        assert set(got) == set(parts) and all(np.allclose(got[k], np.quantile(v, points)) for k, v in parts.items())


# Waveforms: every query on the tables against direct sums.


def bins(x, n=64, hop=16):
    """Frames of a reflected signal, bin by bin."""
    h = n // 2
    padded = np.concatenate([x[1 : h + 1][::-1], x, x[-h - 1 : -1][::-1]])
    window = np.array([0.5 - 0.5 * math.cos(2 * math.pi * k / n) for k in range(n)])
    turn = np.array([[cmath.exp(-2j * math.pi * b * k / n) for k in range(n)] for b in range(n // 2 + 1)])
    return np.array([turn @ (padded[a : a + n] * window) for a in range(0, len(padded) - n + 1, hop)])


def level(p):
    return 10 * math.log10(max(p, 1e-12))


@pytest.fixture(scope="module")
def wave(spark, sf):
    rows = waves(spark, sf).collect()
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    width = len(rows[0]["x"]) // 16
    assert sum(int(np.any(np.array(r["x"]).reshape(16, width) != 0, 1).sum()) for r in rows) == vectors  # every vector is used
    return {(r["label"], r["block"]): (np.array(r["x"], float), np.array(r["y"], float)) for r in rows}


def told(spark, sf, name):
    return {(r["label"], r["block"]): r for r in QUERIES[name](spark, sf).collect()}


def test_waveform_levels(spark, sf, wave):
    """The kernels that are left; the queries by time-frequency rows have SQL twins and tests of their own."""
    got = {n: told(spark, sf, n) for n in ("spectral_flux_onsets", "coherence_by_loudness", "wiener_gate", "comb_ripple")}
    assert all(len(g) == len(wave) for g in got.values())
    for k, (x, y) in wave.items():
        z, v = bins(x), bins(y)
        p = np.abs(z) ** 2
        db = np.maximum(20 * np.log10(np.abs(z) + 1e-12), -80)
        flux = [0.0] + [sum(max(b - a, 0) for a, b in zip(db[i - 1], db[i], strict=True)) for i in range(1, len(db))]
        assert got["spectral_flux_onsets"][k]["peak"] == pytest.approx(max(flux), rel=1e-6)
        g = np.maximum(1 - np.abs(v) ** 2 / np.maximum(np.abs(bins(x + y)) ** 2, 1e-12), 0.1)
        e = np.concatenate([g[:1], g, g[-1:]])
        assert got["wiener_gate"][k]["gain"] == pytest.approx(np.mean((e[:-2] + e[1:-1] + e[2:]) / 3), rel=1e-6)
        shifted = bins(x + 0.5 * np.roll(x, 7))
        ratio = [level(np.mean(p[:, b])) - level(np.mean(np.abs(shifted[:, b]) ** 2)) for b in range(33)]
        assert got["comb_ripple"][k]["ripple"] == pytest.approx(np.percentile(ratio, 95) - np.percentile(ratio, 5), abs=1e-6)


def test_waveform_delays_and_copies(spark, sf, wave):
    got = {n: told(spark, sf, n) for n in ("delay_estimates", "delayed_copy_check", "stereo_features", "sinc_warp", "friction_fidelity", "optimised_mask", "band_pass_envelope", "transient_fidelity", "augmentation_chain")}
    assert all(len(g) == len(wave) for g in got.values())
    for k, (x, y) in wave.items():
        n = len(x)
        cross = [sum(x[i] * y[i + lag] for i in range(max(0, -lag), min(n, n - lag))) for lag in range(-32, 33)]
        assert abs(got["delay_estimates"][k]["ncc"] - (int(np.argmax(cross)) - 32)) <= 0.5 + 1e-9
        a = x + 0.3 * np.roll(y, 5)
        values = {lag: float(np.dot(a, np.roll(y, lag))) for lag in range(-16, 17) if abs(lag) >= 2}
        assert got["delayed_copy_check"][k]["lag"] == max(values, key=lambda j: abs(values[j]))
        s = got["stereo_features"][k]
        assert s["level_db"] == pytest.approx(level(sum(x * x)) - level(sum(y * y)), abs=1e-6) and s["correlation"] == pytest.approx(sum(x * y) / math.sqrt(sum(x * x) * sum(y * y)), rel=1e-6)
        assert got["sinc_warp"][k]["error"] < 1e-9
        blocks = lambda w: [np.mean(np.abs(w[i : i + 8])) for i in range(0, n - 7, 8)]
        assert got["friction_fidelity"][k]["envelope_r"] == pytest.approx(np.corrcoef(blocks(x), blocks(x + 0.1 * y))[0, 1], rel=1e-6)
        m = got["optimised_mask"][k]
        assert 0 <= m["after"] <= m["before"]


def test_an_optimised_mask_reaches_an_exact_one():
    """Where a mask in [0, 1] gives the target without error, the optimiser comes near it from the bounded mask."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=512)
    mask, before, after = sg.optimised_mask(x + 0.1 * rng.normal(size=512), x, 60)
    assert after < before and mask.min() >= 0 and mask.max() <= 1


# Streams.


def test_interleaved_files_give_the_batch_answer(spark, tmp_path):
    """Files whose times overlap within the watermark, one step each."""
    rng = np.random.default_rng(2)
    start = 1_704_067_200_000_000
    rows = sorted({(int(start + t), i % 3) for i, t in enumerate(rng.integers(0, 40 * HOUR, 300))})
    events = [(n, t, u, float(rng.integers(0, 100))) for n, (t, u) in enumerate(rows)]
    deal = defaultdict(list)
    for n, t, u, v in events:
        deal[(t - start) // (10 * HOUR) + (n % 2 if (t - start) % (10 * HOUR) > 9.5 * HOUR else 0)].append((n, t, u, v))  # the last half hour of each file may come with the next
    schema = "event_id long, t long, user_id long, value double"
    shape = lambda df: df.withColumn("ts", F.timestamp_micros("t").cast("timestamp_ntz")).drop("t")
    for k in sorted(deal):
        shape(spark.createDataFrame(deal[k], schema)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    far = [(None, start + 90 * 24 * HOUR, None, None)]
    shape(spark.createDataFrame(far, schema)).coalesce(1).write.parquet(f"{tmp_path}/in/zz")
    source = lambda: twins.source(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in/0").schema)
    kept = {r["event_id"] for r in twins.run(spark, twins.refractory(source(), 2 * HOUR)).collect()}
    flags = {r["event_id"]: r["on"] for r in twins.run(spark, twins.hysteresis(source(), 60.0, 20.0, 2)).collect()}
    last, want, state, on = {}, set(), {}, {}
    for n, t, u, v in events:
        if u not in last or t - last[u] >= 2 * HOUR:
            last[u] = t
            want.add(n)
        up, quiet = state.get(u, (False, 0))
        quiet = 0 if not up or v >= 20 else quiet + 1
        up = quiet <= 2 if up else v >= 60
        state[u], on[n] = (up, quiet), up
    assert kept == want and flags == on
    windows = {r["w0"]: r["n"] for r in twins.run(spark, twins.tumbling(source(), "4 hours")).collect()}
    assert sum(windows.values()) == len(events)
