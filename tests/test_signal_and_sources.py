import numpy as np
import pytest

from spanloom.operators import signal as sg
from spanloom.sources import files


def tone(f, n=1024):
    return np.sin(2 * np.pi * f * np.arange(n))


def test_stft_round_trip_and_bands():
    x = np.random.default_rng(1).normal(size=1000)
    assert np.abs(sg.istft(sg.stft(x), x.size) - x).max() < 1e-9
    assert sg.band_db(tone(0.25), 0.2, 0.3) > sg.band_db(tone(0.25), 0.35, 0.5) + 30


def test_delay_and_warp():
    x = np.random.default_rng(2).normal(size=512)
    y = np.concatenate([np.zeros(9), x])[:512]
    assert sg.delay(x, y, 32)[0] == pytest.approx(9, abs=0.05)
    assert sg.delay(x, y, 32, "phat")[0] == pytest.approx(9, abs=0.05)
    assert np.allclose(sg.warp(x, np.arange(50, 90) + 0.0), x[50:90])
    assert sg.delayed_copy(np.roll(x, 6), x, 2, 16)[0] == 6


def test_cancel_masks_and_chunks():
    rng = np.random.default_rng(3)
    s, n = tone(0.05), rng.normal(size=1024)
    assert np.mean((sg.cancel(s + n, [n])[64:-64] - s[64:-64]) ** 2) < 0.1 * np.mean(n**2)
    mask = sg.bounded_mask(s + n, s)
    assert mask.min() >= 0 and mask.max() <= 1
    assert np.abs(sg.istft(sg.complex_mask(s + n, s) * sg.stft(s + n), 1024) - s).max() < 1e-6
    assert sg.paths(mask, s, n)["residual"] < 1e-20
    assert np.allclose(sg.chunked(s, lambda c: c, 128)[128:-128], s[128:-128])


def test_percussive_mask_prefers_clicks():
    click = np.zeros(1024)
    click[512] = 1
    m = sg.percussive_mask(sg.stft(click + 0.01 * tone(0.2)))
    assert m[32].mean() > 0.9
    assert len(sg.onsets(sg.onset_strength(click + 1e-3 * np.random.default_rng(0).normal(size=1024)))) >= 1


def test_wav_bytes_and_errors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.5, -0.25])], "id long, x array<float>")
    wav = files.encoded_wav(df, "id", "x", 8000)
    bad = wav.selectExpr("id + 1 as id", "cast('nonsense' as binary) as wav")
    rows = {r["id"]: r for r in files.decoded_wav(wav.unionByName(bad), "id", "wav").collect()}
    assert rows[1]["samples"] == [0.0, 0.5, -0.25] and rows[1]["rate"] == 8000 and rows[1]["error"] is None
    assert rows[2]["samples"] is None and rows[2]["error"]


def test_raw_frames_from_a_file(spark, tmp_path):
    frames = np.zeros((3, 4, 5, 3), np.uint8)
    frames[1] = 100
    (tmp_path / "a.rgb").write_bytes(frames.tobytes())
    files.register(spark)
    df = spark.read.format("rawframes").option("path", str(tmp_path / "a.rgb")).option("width", "5").option("height", "4").load()
    assert [r["diff"] for r in df.orderBy("frame").collect()] == [0.0, 100.0, 100.0]


def test_catalog_reads_metadata_only(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "a.wav").write_bytes(b"xx")
    (tmp_path / "s1" / "b.txt").write_bytes(b"xyz")
    c = files.catalog(spark, str(tmp_path))
    assert {(r["name"], r["bytes"], r["category"]) for r in c.collect()} == {("a.wav", 2, "audio"), ("b.txt", 3, "text")}
    assert [r["session"] for r in files.sessions(c, ["wav"]).collect()] == ["s1"]
    assert "content" not in c.columns
