"""Time-frequency rows against numpy on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import signal as sg
from spanloom.operators import spectra as sp

SIZES = {"long": 700, "odd": 333, "edge": 17}


@pytest.fixture(scope="module")
def waves():
    rng = np.random.default_rng(7)
    return {k: (rng.normal(size=n), rng.normal(size=n)) for k, n in SIZES.items()}


@pytest.fixture(scope="module")
def rows(spark, waves):
    data = [(k, i, float(a), float(b)) for k, (x, y) in waves.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "label string, i long, a double, b double").repartition(3).withColumn("y", F.col("a") + 0.5 * F.col("b")).cache()


@pytest.fixture(scope="module")
def tf(rows):
    return sp.transformed(rows, ["label"], ["a", "b", "y"]).cache()


def matrix(df, label, column):
    got = df.where(F.col("label") == label).toPandas()
    out = np.full((got["frame"].max() + 1, got["bin"].max() + 1), np.nan, complex if f"{column}_re" in got else float)
    out[got["frame"], got["bin"]] = got[f"{column}_re"] + 1j * got[f"{column}_im"] if f"{column}_re" in got else got[column]
    return out


@pytest.mark.parametrize("label", SIZES)
def test_transform_equals_fft(tf, waves, label):
    for name, x in zip("ab", waves[label], strict=True):
        np.testing.assert_allclose(matrix(tf, label, name), sg.stft(x, 32, 8), atol=1e-9)


def test_round_trip(rows, tf, waves):
    back = sp.restored(tf, ["label"], ["a", "b"], sp.lengths(rows, ["label"])).toPandas()
    for label, (x, y) in waves.items():
        mine = back[back["label"] == label].sort_values("i")
        assert mine["i"].tolist() == list(range(len(x)))
        np.testing.assert_allclose(mine["a"], x, atol=1e-9)
        np.testing.assert_allclose(mine["b"], y, atol=1e-9)


def test_ridge_equals_numpy(tf, waves):
    got = sp.ridge(sp.earlier(tf, ["label"], "b", "c"), ["label"], "y", ["b", "c"]).toPandas()
    for label, (x, y) in waves.items():
        target, ref = sg.stft(x + 0.5 * y, 32, 8), sg.stft(y, 32, 8)
        back = np.concatenate([np.zeros((1, 17)), ref[:-1]])
        for r in got[got["label"] == label].itertuples():
            a = np.stack([ref[:, r.bin], back[:, r.bin]], 1)
            gram = a.conj().T @ a
            w = np.linalg.solve(gram + (1e-3 * np.trace(gram).real / 2 + sp.EPS) * np.eye(2), a.conj().T @ target[:, r.bin])
            np.testing.assert_allclose([r.w0_re + 1j * r.w0_im, r.w1_re + 1j * r.w1_im], w, atol=1e-9)
            left = target[:, r.bin] - a @ w
            np.testing.assert_allclose([r.before, r.after], [(np.abs(target[:, r.bin]) ** 2).sum(), (np.abs(left) ** 2).sum()], rtol=1e-7, atol=1e-9)


def test_masks_equal_numpy(tf, waves):
    perc, gain, mask = sp.percussive(tf, ["label"], "a"), sp.wiener(tf, ["label"], "y", "b"), sp.masked(tf, "y", "a")
    for label, (x, y) in waves.items():
        za, zb, zy = (sg.stft(s, 32, 8) for s in (x, y, x + 0.5 * y))
        np.testing.assert_allclose(matrix(perc, label, "mask"), sg.percussive_mask(za), atol=1e-9)
        g = np.maximum(1 - np.abs(zb) ** 2 / np.maximum(np.abs(zy) ** 2, 1e-12), 0.1)
        e = np.pad(g, ((1, 1), (0, 0)), mode="edge")
        np.testing.assert_allclose(matrix(gain, label, "gain"), (e[:-2] + e[1:-1] + e[2:]) / 3, atol=1e-9)
        ratio = za * zy.conj() / (np.abs(zy) ** 2 + 1e-12)
        np.testing.assert_allclose(matrix(mask, label, "ratio"), ratio, atol=1e-7)
        np.testing.assert_allclose(matrix(mask, label, "bounded"), np.clip(ratio.real, 0, 1), atol=1e-7)


def test_levels_equal_numpy(tf, waves):
    near = {r["label"]: r for r in sp.attenuation(tf, ["label"], "y", "a", "b").collect()}
    bins, flux = sp.coherence(tf, ["label"], "a", "y").toPandas(), sp.flux(tf, ["label"], "a").toPandas()
    for label, (x, y) in waves.items():
        za, zb, zy = (sg.stft(s, 32, 8) for s in (x, y, x + 0.5 * y))
        on = np.abs(zb) >= np.percentile(np.abs(zb), 75)
        change = [float(sg.db((np.abs(za) ** 2)[m].mean()) - sg.db((np.abs(zy) ** 2)[m].mean())) for m in (on, ~on)]
        np.testing.assert_allclose([near[label]["active_db"], near[label]["inactive_db"]], change, atol=1e-8)
        cross = np.abs((za * zy.conj()).mean(0)) ** 2 / np.maximum((np.abs(za) ** 2).mean(0) * (np.abs(zy) ** 2).mean(0), 1e-12)
        np.testing.assert_allclose(bins[bins["label"] == label].sort_values("bin")["coherence"], cross, atol=1e-9)
        level = np.maximum(20 * np.log10(np.abs(za) + 1e-12), -80)
        want = np.concatenate([[0.0], np.maximum(np.diff(level, axis=0), 0).sum(1)])
        np.testing.assert_allclose(flux[flux["label"] == label].sort_values("frame")["strength"], want, atol=1e-8)


@pytest.mark.parametrize("size", [50, 64])
def test_chunks(rows, waves, size):
    models = {"same": lambda x: x, "cumulative": lambda x: np.cumsum(x, axis=1)}
    for name, model in models.items():
        got = sp.chunked(rows, ["label"], size, model, "a").toPandas()
        for label, (x, _) in waves.items():
            out = got[got["label"] == label].sort_values("i")["out"].to_numpy()
            np.testing.assert_allclose(out, sg.chunked(x, lambda c, m=model: m(c[None])[0], size), atol=1e-9)
            covered = max(0, (len(x) - size) // (size // 2) * (size // 2) + size) if len(x) >= size else 0
            assert (out[covered:] == 0).all()
            if name == "same":
                np.testing.assert_allclose(out[:covered], x[:covered], atol=1e-9)


def test_nothing(spark, rows):
    none = rows.limit(0)
    tf = sp.transformed(none, ["label"], ["a", "b"])
    assert tf.count() == 0 and sp.restored(tf, ["label"], ["a"], sp.lengths(none, ["label"])).count() == 0
    assert sp.chunked(none, ["label"], 8, lambda x: x, "a").count() == 0
