"""Least squares, clusters, lag scans, raw frames and carried frames against plain numpy and Python."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import stats
from spanloom.operators import series, signal
from spanloom.sources import files
from spanloom.streaming import twins


@pytest.mark.parametrize("p", [1, 2, 5, 7])
def test_least_squares(spark, p):
    rng = np.random.default_rng(p)
    data, groups = [], {}
    for k in ("a", "b"):
        x = rng.normal(size=(60, p)) * np.arange(1, p + 1)
        y = x @ rng.normal(size=p) + rng.normal(size=60)
        groups[k] = x, y
        data += [(k, float(b), *map(float, a)) for a, b in zip(x, y, strict=True)]
    names = [f"x{i}" for i in range(p)]
    data += [("a", None, *[1.0] * p), ("b", 1.0, *[None] * p)]  # rows with a null count for nothing
    data += [("same", 1.0, *[2.0] * p), ("same", 3.0, *[4.0] * p)] + [("none", 1.0, *[0.0] * p)]
    df = spark.createDataFrame(data, "k string, y double, " + ", ".join(f"{n} double" for n in names))
    got = {r["k"]: r for r in stats.least_squares(df, ["k"], "y", names).collect()}
    for k, (x, y) in groups.items():
        w = np.linalg.lstsq(x, y, rcond=None)[0]
        np.testing.assert_allclose(got[k]["weights"], w, rtol=1e-8)
        assert got[k]["unexplained"] == pytest.approx(((y - x @ w) ** 2).sum() / (y @ y), rel=1e-8)
        assert got[k]["condition"] == pytest.approx(np.linalg.cond(x.T @ x), rel=1e-8) and got[k]["n"] == 60
    assert got["none"]["weights"] is None and got["none"]["condition"] is None
    assert (got["same"]["weights"] is None) == (p > 1)  # equal columns are singular


def densest(xs, tolerance):
    xs = sorted(xs)
    best = max(((sum(low <= x <= low + tolerance for x in xs), -low) for low in set(xs)))
    inside = [x for x in xs if -best[1] <= x <= -best[1] + tolerance]
    return best[0], float(np.median(inside)), max(abs(x - np.median(inside)) for x in inside)


def test_consensus(spark):
    rng = np.random.default_rng(4)
    groups = {k: [float(round(x, 2)) for x in rng.normal(0, 3, n)] for k, n in (("a", 200), ("b", 3), ("c", 2), ("d", 40))}
    groups["e"] = [1.0] * 50 + [9.0, 9.5, None]
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, x double")
    got = {r["k"]: (r["n"], r["offset"], r["largest"]) for r in stats.consensus(df, ["k"], "x", 0.5).collect()}
    want = {k: densest([x for x in xs if x is not None], 0.5) for k, xs in groups.items()}
    assert got.keys() == {k for k, v in want.items() if v[0] >= 3}
    for k, v in got.items():
        assert v == pytest.approx(want[k])


def test_consensus_of_a_million_estimates(spark):
    """One group; the densest cluster holds most of it."""
    df = spark.range(1_000_000, numPartitions=8).select(F.lit("one").alias("k"), F.when(F.col("id") % 10 < 8, 5 + F.col("id") / 1e6).otherwise(F.col("id") * 1.0).alias("x"))
    r = stats.consensus(df, ["k"], "x", 1.0).first()
    assert r["n"] == 800_000 and r["offset"] == pytest.approx(5.5, abs=1e-3)


@pytest.mark.parametrize("kind", ["int", "double"])
def test_lag_scan_over_blocks(spark, kind):
    rng = np.random.default_rng(1)
    data, most = [], 6
    for k, n in (("a", 400), ("b", 30), ("c", 1)):
        for i in range(n):
            if rng.random() < 0.9:  # rows are missing, and values too
                data.append((k, i, None if rng.random() < 0.05 else int(rng.integers(0, 9)), int(rng.integers(0, 9))))
    df = spark.createDataFrame(data, "k string, i long, a int, b int").withColumns({c: F.col(c).cast(kind) for c in "ab"})
    want = {}
    for k in "abc":
        at = {i: (a, b) for kk, i, a, b in data if kk == k}
        sums = {}
        for lag in range(-most, most + 1):
            pairs = [(at[i - lag][0], b) for i, (_, b) in at.items() if i - lag in at and at[i - lag][0] is not None]
            if pairs:
                sums[lag] = (sum(x * y for x, y in pairs), len(pairs))
        best = min(sums, key=lambda g: (-sums[g][0], g))
        want[k] = (best, *sums[best])
    for block in (24, 100, 1 << 14):
        got = {r["k"]: (r["lag"], r["dot"], r["n"]) for r in series.lag_scan(df, ["k"], "a", "b", most, block).collect()}
        assert got == want


# --- raw frames


@pytest.fixture
def frames(tmp_path):
    rng = np.random.default_rng(6)
    return rng.integers(0, 256, (700, 2, 3, 3)).astype(np.uint8)


def features(frames):
    out, last = {}, None
    for n, f in enumerate(frames):
        out[n] = signal.frame_features(f, last)
        last = f.astype(float)
    return out


def reader(r, folder):
    return r.format("rawframes").option("path", str(folder)).option("width", "3").option("height", "2").load()


def agree(rows, want):
    assert sorted(r["frame"] for r in rows) == sorted(want)
    for r in rows:
        for c in ("warm", "white", "bright", "diff"):
            assert r[c] == pytest.approx(want[r["frame"]][c])


def test_frames_of_a_folder(spark, tmp_path, frames):
    files.register(spark)
    (tmp_path / "a").mkdir()
    for name, part in (("x0.raw", frames[:300]), ("x1.raw", frames[300:300]), ("x2.raw", frames[300:])):  # an empty file between
        (tmp_path / "a" / name).write_bytes(part.tobytes())
    (tmp_path / "a" / "_temporary-1").write_bytes(b"half")
    agree(reader(spark.read, tmp_path / "a").collect(), features(frames))
    (tmp_path / "none").mkdir()
    assert reader(spark.read, tmp_path / "none").count() == 0


def test_written_frames_come_back(spark, tmp_path, frames):
    files.register(spark)
    rows = [(int(n), f.ravel().astype(int).tolist()) for n, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "n long, px array<int>").repartition(5)
    files.write_raw_frames(df, "n", "px", str(tmp_path / "w"), 3)
    names = sorted(os.listdir(tmp_path / "w"))
    assert len(names) == 3 and b"".join((tmp_path / "w" / x).read_bytes() for x in names) == frames.tobytes()
    agree(reader(spark.read, tmp_path / "w").collect(), features(frames))


def test_frame_stream_restarts_without_repeats(spark, tmp_path, frames):
    files.register(spark)
    folder, seen = tmp_path / "s", []
    folder.mkdir()
    cuts = [0, 10, 290, 290, 700]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            (folder / f"p{k}.raw").write_bytes(frames[a:b].tobytes())
        sink = lambda batch, number: seen.extend(batch.collect())
        query = reader(spark.readStream, folder).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).start().awaitTermination()
        assert len(seen) == b
    agree(seen, features(frames))
    offsets = sorted(os.listdir(tmp_path / "state" / "offsets"), key=lambda x: (x.startswith("."), len(x), x))
    last = [x for x in offsets if x.isdigit()][-1]
    assert json.loads((tmp_path / "state" / "offsets" / last).read_text().splitlines()[-1]) == {"frame": 700}


# --- one carried frame


def test_state_is_bounded_by_the_watermark(spark, tmp_path):
    """Interleaved files: the changes equal a plain scan, and rows that the watermark has passed have left the state."""
    start, minute = 1_704_067_200, 60
    rng = np.random.default_rng(9)
    rows = [(n, n % 3, start + n * minute, [float(x) for x in rng.normal(size=4)]) for n in range(240)]
    deal = [[r for r in rows if (r[0] + (r[0] // 7) % 2 * 30) // 80 == k] for k in range(4)]
    schema = "event_id long, user_id long, s long, value array<double>"
    shape = lambda df: df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    far = [(None, None, start + 90 * 86400, None)]
    for k, part in enumerate([*deal, far]):
        if part:
            shape(spark.createDataFrame(part, schema)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
            time.sleep(1.1)  # files are taken by age
    stream = twins.source(spark, f"{tmp_path}/in", shape(spark.createDataFrame(far, schema)).schema)
    held = []
    got = {r["event_id"]: r["change"] for r in twins.run(spark, twins.frame_changes(stream, 600_000), held.append).collect()}
    last, want = {}, {}
    for n, u, _, v in rows:
        want[n] = 0.0 if u not in last else float(np.abs(np.array(v) - last[u]).mean())
        last[u] = np.array(v)
    assert got == pytest.approx(want)
    cells = [op["numRowsTotal"] for p in held for op in p["stateOperators"] if "ransformWithState" in op["operatorName"]]
    assert cells and max(cells) < 240 and cells[-1] <= 40


def test_one_gain_a_group(spark):
    from spanloom.operators import corpus

    df = spark.createDataFrame([("a", 1, 0.9, True), ("a", 2, 0.5, False), ("b", 3, 0.1, True), ("b", 4, 0.2, False), ("z", 5, 0.0, True)], "g string, item int, peak double, raw boolean")
    got = {r["item"]: (round(r["gain_db"], 3), round(r["level"], 4), r["clips"]) for r in corpus.levelled(df, "g", "peak", F.col("raw"), -6.0).collect()}
    assert got == {1: (-5.085, 0.5012, False), 2: (-5.085, 0.2784, False), 3: (0.0, 0.1, False), 4: (0.0, 0.2, False), 5: (0.0, 0.0, False)}
    loud = spark.createDataFrame([("a", 1, 0.4, True), ("a", 2, 1.5, False)], "g string, item int, peak double, raw boolean")
    assert [r["clips"] for r in corpus.levelled(loud, "g", "peak", F.col("raw"), -6.0, strict=False).orderBy("item").collect()] == [False, True]
    with pytest.raises(Exception, match="would clip group a"):
        corpus.levelled(loud, "g", "peak", F.col("raw"), -6.0).collect()


def test_siblings(spark):
    from spanloom.operators import joins

    df = spark.createDataFrame([("f", n) for n in (5, 1, 9, 3, 3)] + [("g", 7), (None, 8)], "f string, n int")
    got = {r["n_"]: (r["siblings"], r["n"]) for r in joins.siblings(df.withColumnRenamed("n", "n_"), ["f"], "n_", 2).collect()}
    assert got == {1: ([3, 5], 3), 3: ([1, 5, 9], 3), 5: ([1, 3, 9], 3), 9: ([3, 5], 3), 7: ([], 0), 8: ([], 0)}
