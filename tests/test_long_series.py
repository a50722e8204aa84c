"""Ranges with carried offsets against windows in one task; prefix joins and JSON walks against plain Python."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import corpus, intervals, joins, kernels, ranges
from spanloom.operators import series as so

PARTS = 64


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def rows_of(seed, keys):
    rng = random.Random(seed)
    return [(k, i, float(rng.choice([0, 5, 10, 21, 30, 55, 60, 70])) if rng.random() < 0.97 else None) for k, n in keys for i in range(n)]


@pytest.fixture(scope="module", params=[[("a", 4000)], [("a", 1), ("b", 1500), ("c", 3), (None, 700)]])
def long(request, spark):
    return spark.createDataFrame(rows_of(3, request.param), "k string, i long, v double").repartition(5).cache()


def test_ranges_are_even(spark):
    rows = spark.range(64_000).select(F.lit("only").alias("k"), F.col("id").alias("i"))
    sizes = sorted(r["count"] for r in ranges.ranged(rows, ["k", "i"], PARTS).groupBy("_range").count().collect())
    assert len(sizes) == PARTS and sizes[-1] <= 2 * sizes[PARTS // 2] and sum(sizes) == 64_000


def test_filling_tasks_are_even(spark):
    rows = ranges.ranged(spark.range(64_000).select(F.col("id").alias("i")), ["i"], PARTS)
    tasks = ranges.one_task_each(rows).groupBy(F.spark_partition_id()).count()
    sizes = sorted(r["count"] for r in tasks.collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and len(sizes) > PARTS // 2


def test_numbers(long):
    want = long.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("i")))
    assert tuples(ranges.numbered(long, ["i"], "n", ["k"], PARTS)) == tuples(want)
    whole = long.select("i", "k").withColumn("n", F.row_number().over(Window.orderBy("k", "i")))
    assert tuples(ranges.numbered(long.select("i", "k"), ["k", "i"], "n", parts=PARTS)) == tuples(whole)


@pytest.mark.parametrize("before", [False, True])
def test_running_aggregates(long, before):
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = long.select("k", "i", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("t"), F.last("v", ignorenulls=True).over(w).alias("l"))
    got = ranges.running(ranges.ranged(long, ["k", "i"], PARTS), ["k"], {"s": F.col("v")}, {"t": F.col("v")}, {"l": F.col("v")}, before)
    assert tuples(got.select("k", "i", "s", "t", "l")) == tuples(want)


def test_merged_spans(long):
    spans = long.select("k", (F.col("i") * 3).alias("s"), (F.col("i") * 3 + F.coalesce("v", F.lit(0)).cast("long") % 9).alias("e"))
    for gap in (0, 2):
        assert tuples(ranges.merged(spans, ["k"], gap, PARTS)) == tuples(intervals.merged(spans, ["k"], gap))
    one = spans.unionByName(spans.limit(1).select("k", F.lit(0).cast("long").alias("s"), F.lit(10**6).alias("e")))  # a span over all others
    assert tuples(ranges.merged(one, ["k"], 0, PARTS)) == tuples(intervals.merged(one, ["k"], 0))


def test_runs_and_ranks_and_places(long):
    assert tuples(ranges.runs(long, ["k"], F.col("v") > 20, "i", PARTS)) == tuples(so.runs(long, ["k"], F.col("v") > 20))
    w = Window.partitionBy("k")
    held = long.where("v is not null")
    rank = F.rank().over(w.orderBy("v")) + (F.count("*").over(Window.partitionBy("k", "v")) - 1) / 2
    assert tuples(ranges.average_ranks(long, ["k"], "v", parts=PARTS)) == tuples(held.select("k", "v", rank.alias("rank")).distinct())
    sized = long.select("k", "i", (F.col("i") % 5 + 1).alias("n"))
    want = kernels.placed(sized.where("k is not null"), ["k"], "n", 700, 2, "i")
    assert tuples(ranges.placed(sized.where("k is not null"), ["k"], "n", 700, 2, ["i"], PARTS)) == tuples(want)


def test_windows_in_blocks(long):
    w = Window.partitionBy("k").orderBy("i")
    want = long.select("k", "i", F.sum("v").over(w.rowsBetween(-7, 3)).alias("a"), F.lag("v", 5).over(w).alias("b"))
    got = ranges.around(long, ["k"], 7, 3, {"a": lambda x: F.sum("v").over(x.rowsBetween(-7, 3)), "b": lambda x: F.lag("v", 5).over(x)}, block=50)
    assert tuples(got.select("k", "i", "a", "b")) == tuples(want)


@pytest.mark.parametrize(("enter", "stay", "hold"), [(60, 20, 2), (30, 30, 0), (20, 60, 4), (1000, 5, 3)])
def test_hysteresis_by_transitions(long, enter, stay, hold):
    known = long.where("k is not null").fillna(float("nan"), ["v"])
    want = kernels.hysteresis(known, ["k"], enter, stay, hold, "v")
    assert tuples(ranges.hysteresis(known, ["k"], enter, stay, hold, "v", parts=PARTS).select("k", "i", "on")) == tuples(want.select("k", "i", "on"))


def test_transitions_carry_over_empty_progress(spark):
    """A state that no row of many ranges changes is still there at the end."""
    rows = spark.range(6400).select(F.col("id").alias("i"), F.when(F.col("id") == 3, 100.0).otherwise(50.0).alias("v"))
    got = ranges.hysteresis(rows, [], 100, 50, 1, "v", parts=PARTS).where("on").agg(F.count("*"), F.min("i")).first()
    assert tuple(got) == (6397, 3)


def test_nothing_to_scan(spark):
    none = spark.createDataFrame([], "k string, i long, v double")
    assert ranges.hysteresis(none, ["k"], 2, 1, 1, "v").count() == 0
    assert ranges.numbered(none, ["i"]).count() == 0 and ranges.merged(none.selectExpr("k", "i s", "i e"), ["k"]).count() == 0


# --- the longest shared folder path


def best(records, candidates, least, letters=2):
    out = []
    for key, dirs, word in records:
        found = None
        for name, own, stem in sorted(candidates):
            depth = 0
            while depth < min(len(dirs), len(own)) and dirs[depth] == own[depth]:
                depth += 1
            folder = own[-1] if own else ""
            if depth >= least:
                score = (depth, 2)
            elif word and len(word) >= letters and (word in stem or stem in word or word in folder):
                score = (depth, 1)
            else:
                continue
            if found is None or score > found[0]:
                found = (score, name)
        if found:
            out.append((key, found[1], *found[0]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_scored_prefix_match(spark, seed):
    rng = random.Random(seed)
    path = lambda: [rng.choice("abcd") for _ in range(rng.randrange(5))]
    text = lambda n: "".join(rng.choice("xyz") for _ in range(rng.randrange(n)))
    records = [(i, path(), text(7) if rng.random() < 0.9 else None) for i in range(60)]
    candidates = [(f"c{i:03d}", path() + ([text(6)] if rng.random() < 0.5 else []), text(6)) for i in range(rng.choice([3, 40]))]
    r = spark.createDataFrame(records, "id int, dirs array<string>, family string")
    c = spark.createDataFrame(candidates, "name string, dirs array<string>, stem string")
    for least in (2, 3):
        assert tuples(joins.scored_prefix_match(r, c, "id", "name", least=least)) == best(records, candidates, least)


def test_containing(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(40)] + ["é", "zz", ""]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(40)] + ["café", ""]
    got = joins.containing(spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame([(t,) for t in texts], "t string"), "w", "t")
    assert set(tuples(got)) == {(w, t) for w in words for t in texts if w and w in t}


# --- nested JSON


def leaves(x, path=()):
    if isinstance(x, dict):
        for k, v in x.items():
            yield from leaves(v, (*path, k))
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from leaves(v, (*path, f"[{i}]"))
    else:
        yield list(path), x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def grown(rng, depth):
    kind = rng.random()
    if depth and kind < 0.45:
        return {rng.choice(["a", "GPS_x", "b c", "é", "[0]"]) + str(i): grown(rng, depth - 1) for i in range(rng.randrange(4))}
    if depth and kind < 0.8:
        return [grown(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice(["text", "/home/u/x y", "C:\\a\\b", "", 7, -3, True, None, '{"no": "json"}'])


def test_walk_of_any_depth(spark):
    rng = random.Random(2)
    deep = "leaf"
    for i in range(30):
        deep = {"k": [deep]} if i % 2 else [deep, i]
    docs = [grown(rng, 6) for _ in range(60)] + [deep, "plain", 5, {}, [], [[[]]]]
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)] + [(900, "{broken"), (901, None), (902, "")]
    walk = corpus.walked(spark.createDataFrame(rows, "id int, j string"), "id", "j")
    want = sorted((i, p, v) for i, d in enumerate(docs) for p, v in leaves(d))
    assert sorted((r["id"], r["path"], r["value"]) for r in walk.collect()) == want
    tokens = ["gps", "serial"]
    found = defaultdict(int)
    for i, p, v in want:
        for m in __import__("re").findall(r"(?:[A-Za-z]:\\|/(?:home|Users|mnt)/)[^\s\"']*", v):
            found[i, "/".join(p), m] += 1
        if p and any(t in p[-1].lower() for t in tokens):
            found[i, "/".join(p), "private-key-name"] += 1
    got = defaultdict(int)
    for r in corpus.findings(walk, "id", tokens).collect():
        got[tuple(r)] += 1
    assert got == found and found
