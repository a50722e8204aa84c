"""Near copies, substrings and lines against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import WORD, classes, cut
from conftest import frame
from pyspark.sql import functions as F

from spanloom.llm import base, lines, neardup, substrings

def test_joined(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in neardup.joined(docs).collect()}
    assert got == classes(rows)


@pytest.mark.parametrize("block", [3, 256])
def test_joined_chains_of_edits(spark, monkeypatch, block):
    """A chain whose ends are far apart is one component; blocks of three make every kind of block pair."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(4)
    rows, w = [], [f"t{rng.randrange(10**6)}" for _ in range(100)]
    for i in range(30):
        rows.append((100 - i, " ".join(w)))
        w = list(w)
        w[rng.randrange(len(w))] = f"t{rng.randrange(10**6)}"
        if i % 4 == 0:
            w.append("more")
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in neardup.joined(frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_threshold_is_inclusive(spark):
    a = [f"a{i}" for i in range(11)]  # seven shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:10])), (3, " ".join(a + ["b", "c"])), (4, " ".join(a + ["b", "c", "d", "e"]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in neardup.joined(frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_one_of_each(docs, rows, empty, repeated):
    want = {i for i, (_, c, _) in classes(rows).items() if i == c}
    out = neardup.one_of_each(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want
    assert neardup.one_of_each(empty).count() == 0 and neardup.joined(empty).count() == 0
    ids = [r["doc_id"] for r in neardup.one_of_each(repeated).collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert neardup.joined(repeated).count() == 27


@pytest.mark.parametrize("percent, block, few", [(50, 2, 4), (50, 256, 1), (90, 5, 40)])
def test_any_threshold_and_block(spark, monkeypatch, percent, block, few):
    """Links hold at every threshold, block size and bound on short lists."""
    rng = random.Random(percent + block)
    base_words = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(50):
        w = list(base_words)[: rng.randrange(20, 61)]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(6)}"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "FEW", few)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in neardup.joined(frame(spark, rows), percent).collect()}
    assert got == classes(rows, percent)


def test_lists_over_partitions(spark):
    """A list gives the same pairs and clusters however it is cut; a list of a third of all rows lies in many partitions."""
    rng = random.Random(4)
    rows = [(t, n, g, 0, 1, 0) for g, (t, n) in enumerate((rng.randrange(30), rng.randrange(20, 40)) for _ in range(90))]
    rows += [(99, rng.randrange(20, 90), 1000 + g, 0, 1, 0) for g in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in neardup._LIST))
    part, shared = neardup._lists(75, 4)
    schema = "u long, v long, " + ", ".join(f"{c} long" for c in neardup._LIST)
    seen = []
    for parts in (1, 7, 40):
        dealt = df.repartitionByRange(parts, "token", "n", "gsig").sortWithinPartitions("token", "n", "gsig")
        found = dealt.mapInArrow(part, schema).cache()
        rest = found.where("u is null").groupBy("token").applyInArrow(shared, schema)
        both = found.where("u is not null").unionByName(rest)
        pairs = {tuple(r) for r in both.where("long = 0").select("u", "v").collect()}
        edges = both.where("long = 1").select("u", "v")
        seen.append((pairs, {r["node"]: r["component"] for r in base.components(edges).collect()}))
        sizes = [r[0] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
        assert parts == 1 or max(sizes) <= 3 * len(rows) / parts
    assert seen[0] == seen[1] == seen[2]
    by = defaultdict(list)
    for t, n, g, *_ in rows:
        by[t].append((n, g))
    want = {(min(x, y)[1], max(x, y)[1]) for m in by.values() if len(m) <= 4 for x in m for y in m if x < y and 100 * x[0] >= 75 * y[0] and x[0] >= -(-75 * (x[0] + y[0]) // 175)}
    assert {tuple(sorted(p)) for p in seen[0][0]} == {tuple(sorted(p)) for p in want}


def test_copies_without_doc_id_and_other_texts(spark):
    """Rows without doc_id link like any; a doc_id with two texts keeps both; columns clash with inner names."""
    text = " ".join(f"w{i}" for i in range(40))
    near = text + " tail"
    rows = [(None, text), (None, near), (5, "quite another text of more than five words"), (5, "a second text under the same number as before"), (5, near)]
    got = Counter((r["doc_id"], r["component_id"], r["n_links"]) for r in neardup.joined(frame(spark, rows)).collect())
    assert got == {(None, 5, 2): 2, (5, 5, 0): 2, (5, 5, 2): 1}
    df = frame(spark, rows + rows).withColumn("_key", F.lit("mine")).withColumn("_rows", F.lit("too"))
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns and {(r["_key"], r["_rows"]) for r in kept.collect()} == {("mine", "too")}
    assert sorted(r["text"] for r in kept.collect()) == sorted(t for i, t in rows if i)
    one = neardup.one_of_each(frame(spark, rows[:2]))
    assert [r["text"] for r in one.collect()] in ([text], [near])


def test_overlap_matrix():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(12)]
    got = neardup._overlaps(sets, np.arange(5), np.arange(5, 12), width=7)
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:5]]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, j) for j in range(101, 120)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in base.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 120)}
    assert base.components(spark.createDataFrame([], "u long, v long")).count() == 0
    far = {r["node"]: r["component"] for r in base.components(spark.createDataFrame(edges, "u long, v long"), small=0).collect()}
    assert far == got


def removed(rows, k):
    w = {n: WORD.findall(t or "") for n, (_, t) in enumerate(rows)}
    count = Counter(tuple(x[i : i + k]) for x in w.values() for i in range(len(x) - k + 1))
    out = []
    for n, (doc, _) in enumerate(rows):
        x = w[n]
        gone = {i + j for i in range(len(x) - k + 1) if count[tuple(x[i : i + k])] > 1 for j in range(k)}
        kept = " ".join(v for i, v in enumerate(x) if i not in gone)
        longest, size = 0, k
        while True:
            c = Counter(tuple(y[i : i + size]) for y in w.values() for i in range(len(y) - size + 1))
            if not any(c[tuple(x[i : i + size])] > 1 for i in range(len(x) - size + 1)):
                break
            longest, size = size, 2 * size
        out.append((doc, len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest(), longest))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [35, 4])
def test_substrings(docs, rows, k):
    got = substrings.deduplicated(docs, window=k)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["longest"]) for r in got.collect()), key=str) == removed(rows, k)


def test_substrings_edges(empty, repeated):
    assert substrings.deduplicated(empty).count() == 0
    got = [tuple(r)[:4] for r in substrings.deduplicated(repeated, keep_text=False).collect()]
    want = [tuple(x[:4]) for x in removed([(r["doc_id"], r["text"]) for r in repeated.collect()], 35)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("least", [25, 60, 1])
def test_lines(docs, rows, least):
    found = lines.deduplicated(docs, least)
    assert found.columns == [*docs.columns, "_n_lines", "_n_removed", "_kept"]
    assert {r["doc_id"]: (r["_n_lines"], r["_n_removed"], r["_kept"]) for r in found.collect()} == cut(rows, least)


def test_lines_of_any_mix(spark):
    """Short lines in runs, repeats inside a document and across, hot lines; recall of repeated lines of the least length is one."""
    rng = random.Random(8)
    pool = ["a", "bb", "c d", "a line of twenty-five cha", "some words that make a long line", "é" * 24, "é" * 25, "x y z"]
    rows = [(i, "\n".join(rng.choice(pool + [f"own {i} {k}"]) for k in range(rng.randrange(1, 14)))) for i in range(80)]
    found = lines.deduplicated(frame(spark, rows))
    got = {r["doc_id"]: (r["_n_lines"], r["_n_removed"], r["_kept"]) for r in found.collect()}
    assert got == cut(rows, 25)
    left = Counter(x for _, _, kept in got.values() for x in kept.split("\n") if len(x) >= 25)
    assert left and all(n == 1 for n in left.values())


def test_lines_edges(empty, repeated, spark):
    assert lines.deduplicated(empty).count() == 0
    by = defaultdict(set)
    for r in lines.deduplicated(repeated).collect():
        if r["doc_id"] is not None:
            by[r["doc_id"]].add((r["_n_lines"], r["_n_removed"], r["_kept"]))
    assert all(len(v) == 1 for v in by.values()) and len(by) == 12
    long = "a line that is long enough to go"
    twice = frame(spark, [(2, f"{long}\nx"), (1, f"q\n{long} "), (None, long), (1, long)]).withColumn("_kept", F.lit("mine"))
    got = lines.deduplicated(twice)
    assert got.columns == [*twice.columns, "_n_lines", "_n_removed", "_kept_"] and {r["_kept"] for r in got.collect()} == {"mine"}
    assert sorted((r["doc_id"] or 9, r["_kept_"]) for r in got.collect()) == [(1, long), (1, f"q\n{long} "), (2, "x"), (9, "")]


def test_a_passage_on_one_line_or_two(spark):
    """A passage of over 50 words that two texts share as one line, or as two, goes from the later one."""
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    one, two = say("a", 51), [say("b", 26), say("c", 25)]
    rows = [(1, f"x\n{one}\ny"), (2, f"p\n  {one}\t\nq"), (3, "\n".join(["r", *two, "s"])), (4, "\n".join(["t", *two, "u"])), (7, one), (8, f"{two[0]}\nz"), (9, f"{one}\nk"), (10, f"{one}\nk")]
    got = {r["doc_id"]: (r["_n_removed"], r["_kept"]) for r in lines.deduplicated(frame(spark, rows)).collect()}
    texts = dict(rows)
    assert {i: got[i] for i in (1, 3)} == {i: (0, texts[i]) for i in (1, 3)}
    assert (got[2], got[4], got[7], got[8], got[9], got[10]) == ((1, "p\nq"), (2, "t\nu"), (1, ""), (1, "z"), (1, "k"), (2, ""))


def test_shingle_sets_fold_case():
    a, b = neardup.shingle_sets(pa.array(["One TWO three Four fIVE six", "one two three four five six"]))[0]
    assert a.tolist() == b.tolist() and len(a) == 2


def test_written_tables_survive_their_source(spark):
    df = base.written(spark.range(10).withColumn("x", F.rand(1)))
    assert df.agg(F.sum("x")).first() == df.agg(F.sum("x")).first()
