"""Waveform rows against numpy on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import ranges, series, waves
from spanloom.operators import signal as sg
from spanloom.operators import spectra as sp

K = ["label"]
SIZES = {"long": 900, "odd": 333, "short": 40}


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(11)
    out = {k: rng.normal(size=n) for k, n in SIZES.items()}
    return {k: (x, np.roll(x, 6) + 0.1 * rng.normal(size=x.size)) for k, x in out.items()}


@pytest.fixture(scope="module")
def rows(spark, arrays):
    data = [(k, i, float(a), float(b)) for k, (x, y) in arrays.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "label string, i long, a double, b double").repartition(5).cache()


def column(df, label, name, by="i"):
    return df.where(F.col("label") == label).orderBy(by).toPandas()[name].to_numpy()


@pytest.mark.parametrize("taps,first", [([0.5, -1.0, 0.25], 0), (waves.band(0.05, 0.2, 8), -8), ([0.0, 0.0, 2.0], 1)])
def test_filter_equals_convolution_across_blocks(rows, arrays, taps, first, monkeypatch):
    whole = ranges.around
    monkeypatch.setattr(ranges, "around", lambda *a, **k: whole(*a, **k, block=37))
    got = waves.filtered(rows, K, taps, "a", "out", first, shift="was")
    for label, (x, _) in arrays.items():
        padded = np.convolve(np.concatenate([np.zeros(40), x, np.zeros(40)]), taps)
        want = padded[40 - first : 40 - first + x.size]
        np.testing.assert_allclose(column(got, label, "out"), want, atol=1e-12)
        np.testing.assert_allclose(column(got, label, "was")[1:], padded[39 - first : 39 - first + x.size][1:], atol=1e-12)


def test_band_pass_keeps_its_band(spark):
    n = np.arange(600)
    data = [(f"{f}", int(i), float(np.sin(2 * np.pi * f * i))) for f in (0.1, 0.35) for i in n]
    got = waves.filtered(spark.createDataFrame(data, "label string, i long, a double"), K, waves.band(0.05, 0.2, 32), "a", "out", -32)
    inner, outer = (column(got, str(f), "out")[100:500] for f in (0.1, 0.35))
    assert np.abs(inner - np.sin(2 * np.pi * 0.1 * n[100:500])).max() < 0.02 and np.abs(outer).max() < 0.02


def test_delays(rows, arrays):
    got = {r["label"]: r for r in waves.delays(rows, K, "a", "b", 12).collect()}
    phase = {r["label"]: r for r in waves.phases(sp.transformed(rows, K, ["a", "b"]), K, "a", "b", 10).collect()}
    turned = {r["label"]: r for r in waves.delayed_copy(rows, K, "b", "a", 2, 16).collect()}
    for label, (x, y) in arrays.items():
        place, value = sg.delay(x, y, 12)
        assert got[label]["place"] == pytest.approx(place, abs=1e-9) and got[label]["ncc"] == pytest.approx(value, abs=1e-9)
        lag, value = sg.delayed_copy(y, x, 2, 16)
        assert turned[label]["lag"] == lag == 6 and turned[label]["value"] == pytest.approx(value, abs=1e-9)
    assert phase["long"]["lag"] == phase["odd"]["lag"] == 6


@pytest.mark.parametrize("block", [50, 1 << 16])
def test_warp_equals_windowed_sinc(rows, arrays, block):
    at = F.lit(-3.0) + F.lit(1.037) * F.col("i")
    got = waves.warped(rows, rows.select("label", F.col("i").alias("j"), at.alias("at")), K, "a", 8, block)
    for label, (x, _) in arrays.items():
        np.testing.assert_allclose(column(got, label, "value", "j"), sg.warp(x, -3.0 + 1.037 * np.arange(x.size), 8), atol=1e-9)


def test_onsets_equal_greedy_peaks(spark):
    rng = np.random.default_rng(3)
    v = np.abs(rng.normal(size=500)) + 9 * (rng.random(500) < 0.05)
    df = spark.createDataFrame([("x", int(i), float(s)) for i, s in enumerate(v)], "label string, frame long, strength double")
    got = [r["frame"] for r in waves.onsets(df, K, 2.0, 5).orderBy("frame").collect()]
    assert got == sg.onsets(v, 2.0, 5).tolist() and len(got) > 5


def test_transient_friction_stereo(rows, arrays):
    x, tf = rows, sp.transformed(rows, K, ["a", "b"]).cache()
    one, two = ({r["label"]: r for r in waves.transient(x, K, c).collect()} for c in "ab")
    rub = {r["label"]: r for r in waves.friction(x, tf, K, "b", "a").collect()}
    both = {r["label"]: r for r in waves.stereo(x, tf, K, "a", "b").collect()}
    for label, (p, q) in arrays.items():
        want = sg.transient(q, p)
        assert two[label]["rise"] - one[label]["rise"] == want["rise_error"] and two[label]["decay"] - one[label]["decay"] == want["decay_error"]
        assert two[label]["peak"] / one[label]["peak"] == pytest.approx(want["peak_ratio"], rel=1e-9)
        assert rub[label]["envelope_r"] == pytest.approx(sg.friction(q, p)["envelope_r"], abs=1e-9)
        assert both[label]["correlation"] == pytest.approx(sg.stereo(p, q)["correlation"], abs=1e-9)
        assert both[label]["level_db"] == pytest.approx(sg.stereo(p, q)["level_db"], abs=1e-9)


def test_gate_and_augmentation(rows, arrays):
    points = rows.where("i % 50 = 0").select("label", F.col("i").alias("t"), (F.abs("b") * 0.7).alias("p"))
    gate = waves.gated(rows, points, K, "a", 0.5)
    late = waves.augmented(rows, K, "a", F.lit(4), F.lit(6.0), F.lit(0.25), [1.0, 0.5])
    for label, (x, y) in arrays.items():
        at = np.arange(0, x.size, 50)
        p = np.clip(np.interp(np.arange(x.size), at, np.abs(y[at]) * 0.7), 0, 1)
        np.testing.assert_allclose(column(gate, label, "gated"), x * (1 - 0.5 * p), atol=1e-12)
        z = np.convolve(np.concatenate([np.zeros(4), x]) * 10 ** (6 / 20), [1.0, 0.5])[: x.size]
        np.testing.assert_allclose(column(late, label, "augmented"), z + 0.25 * (z - np.concatenate([[0.0], z[:-1]])), atol=1e-12)


def test_empty_and_silent(spark, rows):
    none = rows.limit(0)
    quiet = rows.select("label", "i", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    tf = sp.transformed(none, K, ["a", "b"])
    for df in (waves.filtered(none, K, [1.0], "a", "out"), waves.delays(none, K, "a", "b", 4), waves.transient(none, K, "a"), waves.comb_ripple(tf, K, "a", "b")):
        assert df.count() == 0
    assert {r["ncc"] for r in waves.delays(quiet, K, "a", "b", 4).collect()} == {None}
    assert {r["value"] for r in waves.delayed_copy(quiet, K, "a", "b", 1, 4).collect()} == {0.0}
    assert series.lag_sums(quiet, K, "a", "b", 2).count() == 15
