"""Quality rules and decontamination against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import frame
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_base_counts(docs, rows):
    got = {r["doc_id"]: r for r in quality.measured(docs).collect()}
    for i, t in rows:
        r = got[i]
        want = base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_order_of_rules_never_changes_the_verdict(docs):
    names = list(quality.RULES)
    a = sorted(r["doc_id"] for r in quality.kept(docs, names).collect())
    b = sorted(r["doc_id"] for r in quality.kept(docs, names[::-1]).collect())
    c = sorted(r["doc_id"] for r in quality.measured(docs).where("kept").collect())
    assert a == b == c and quality.kept(docs, names).columns == docs.columns


def test_plan_puts_cheap_rejecting_rules_first(spark):
    rules = {"never": lambda f: f.n_words < 0, "often": lambda f: f.n_words < 10**9}
    docs = frame(spark, [(i, f"text number {i}") for i in range(50)])
    assert quality.plan(docs, rules) == ["often", "never"]


def slices(texts, size):
    """Features of slices of so many texts."""
    for lo in range(0, len(texts), size):
        parts = [(t or "").encode() for t in texts[lo : lo + size]]
        yield quality.Features(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]))


def test_cascade_computes_on_survivors_only():
    """Each rule reads the bytes of exactly those documents that all rules before it let through."""
    texts = [f"w{n:04d} " + "x" * (n % 7) for n in range(1000)]
    (f,) = slices(texts, 1000)
    seen = []

    def rule(k):
        def run(x):
            number = [int(x.buf[a + 1 : a + 5].tobytes()) for a in x.off[:-1]]
            seen.append(number)
            return np.array([n % 10 == k for n in number], bool)

        return run

    names = [f"r{k}" for k in range(10)]
    left = quality.cascade(f, names[:9], {n: rule(k) for k, n in enumerate(names)})
    assert [int(t[1:5]) for t, keep in zip(texts, left, strict=True) if keep] == list(range(9, 1000, 10))
    assert seen == [[n for n in range(1000) if n % 10 >= k] for k in range(9)]


@pytest.mark.parametrize("base", [True, False])
def test_registered_rules_compute_as_many_as_are_alive(base, monkeypatch):
    """Every document of sf0.1, after the base counts or without them: each count of a rule reads the bytes of the survivors, no more."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    order = ["symbols", "word_length", "capitals", "repeated_lines", "letters", "exclamation", "control_bytes"]
    order = order if base else ["few_words", "repeated_windows", *order]
    total, wordy, read, computed, alive = quality.Features.total, quality.Features.wordy, [], Counter(), Counter()
    monkeypatch.setattr(quality.Features, "total", lambda x, mark: (read.append(len(mark)), total(x, mark))[1])
    monkeypatch.setattr(quality.Features, "wordy", lambda x: (read.append(x.buf.size), wordy(x))[1])
    for f in slices(texts, 2000):
        left = np.arange(f.size)
        if base:
            _ = f.n_words, f.n_repeat_words, f.word_chars, f.n_symbols, f.n_dup_lines
            left = np.flatnonzero((f.n_words >= 10) & (5 * f.n_repeat_words <= f.n_words))
        sizes, start, reads = np.diff(f.off), left, []

        def counted(name):
            def run(x):
                read.clear()
                computed[name] += x.size
                out = quality.RULES[name](x)
                reads.append(list(read))
                return out

            return run

        got = quality.cascade(f.only(start), order, {n: counted(n) for n in order})
        for name, seen in zip(order, reads, strict=True):
            alive[name] += left.size
            assert set(seen) <= {int(sizes[left].sum())} and (seen or name not in ("capitals", "letters", "exclamation", "control_bytes"))
            left = left[~quality.RULES[name](f)[left]]
        assert (start[got] == left).all()
    assert computed == alive and alive["control_bytes"] < alive[order[0]] <= len(texts)


def test_cut_features_equal_fresh_ones(texts):
    """Words, lines and counts of some documents, cut from those of all or computed anew."""
    parts = [(t or "").encode() for t in texts]
    buf, off = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    rows = np.arange(0, len(parts), 3)
    f, want = quality.Features(buf, off), quality.Features(buf, off).only(rows)
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    for name in names:
        getattr(f, name)
    got = f.only(rows)
    assert set(names) <= set(got.__dict__) and not set(names) & set(want.__dict__)
    assert {"words", "_lines"} <= set(got._source.__dict__) and "words" not in want._source.__dict__
    assert all((getattr(got, n) == getattr(want, n)).all() for n in names) and (got.wordy() == want.wordy()).all()
    assert (got.words.start == want.words.start).all() and (got._lines[1] == want._lines[1]).all() and (got.words.hashes() == want.words.hashes()).all()


def test_sample_is_bounded_under_a_hot_text(spark, tmp_path):
    """A text that repeats in every row, and large partitions: a task measures its first rows alone."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("the very same hot text in every single row").alias("text")).repartition(3)
    log = spark.sparkContext.accumulator(0)
    rules = {"count": lambda f: (log.add(len(f.off) - 1), f.n_words < 0)[1]}
    assert quality.plan(docs, rules, sample_rows=50) == ["count"]
    assert 0 < log.value <= 150


def test_shared_features_are_charged_once(spark):
    """The rule that comes with its words for free goes before one that has to split them."""
    rules = {"few_words": lambda f: f.n_words < 10**6, "controls": lambda f: np.ones(len(f.off) - 1, bool)}
    docs = frame(spark, [(i, "some text here " * 400) for i in range(300)])
    assert quality.plan(docs, rules)[0] == "controls"


def test_junk_goes_and_clean_stays(spark):
    clean = " ".join(f"word{i}" for i in range(60)) + "."
    junk = ["%%% *** " * 30, "BUY NOW " + " ".join(f"W{i}X" for i in range(40)).upper(), "a b!! " * 2 + "c!! d!! e!! f!! g!! h!! i!! j!!", "short"]
    docs = frame(spark, [(1, clean), *[(i + 2, t) for i, t in enumerate(junk)]])
    assert [r["doc_id"] for r in quality.kept(docs).collect()] == [1]


def test_quality_edges(empty, repeated):
    assert quality.measured(empty).count() == quality.kept(empty).count() == 0
    assert quality.measured(repeated).count() == 27


NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(t):
    return NORMAL.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def hits(text, items):
    w, hit, owners = normal(text), set(), set()
    for item, t in items:
        v = normal(t)
        k = min(10, len(v))
        for j in range(max(1, len(v) - 9) if v else 0):
            part = v[j : j + k]
            for i in range(len(w) - k + 1):
                if w[i : i + k] == part:
                    hit |= set(range(i, i + k))
                    owners.add(str(item))
    return len(w), len(hit), sorted(owners)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, rows, block):
    short = [(i, " ".join((t or "").split(" ")[:150])) if t and len(t) > 3000 else (i, t) for i, t in rows]
    source = WORD.findall(rows[0][1])
    items = [(5, re.sub("[a-z]", lambda m: m[0].upper(), " ".join(source[:14]))), (17, " ".join(source[4:20])), (9, "One, two"), (3, None), (4, "..."), (9, "One, two"), (30, "absent words")]
    short.append((999, "ONE-TWO " + " ".join(source[3:13]) + " one; two!"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scanned(frame(spark, short), bench, block_bytes=block)
    got = {r["doc_id"]: r for r in found.collect()}
    for i, t in short:
        n, hit, owners = hits(t, items)
        assert (got[i]["_n_words"], got[i]["_n_hit"], got[i]["_items"]) == (n, hit, owners)
        inside = sum(len(normal(t[s["start"] : s["end"]])) for s in got[i]["_spans"])
        assert inside == hit
    assert got[999]["_n_hit"] == 14


def test_decontamination_keeps_letters_whole(spark):
    """Letters whose UTF-8 holds byte 0x85 or 0xA0."""
    words = "à Å хлеб Роза 老 中国 nb\u00a0sp voilà Århus Рим 全 tail".split(" ")
    items = [(1, " ".join(words)), (2, "voilà Århus"), (3, "Å")]
    rows = [(1, "intro " + " ".join(words) + " outro"), (2, "x " + " ".join(words[2:]) + " y"), (3, "a VOILà Århus b"), (4, "voil hus")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.scanned(frame(spark, rows), bench).collect()}
    for i, t in rows:
        assert (got[i]["_n_words"], got[i]["_n_hit"], got[i]["_items"]) == hits(t, items)
    assert got[1]["_n_hit"] == 12 and got[2]["_items"] == ["1", "2"]


def test_decontamination_edges(spark, docs, empty, repeated):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scanned(docs, none).where("_n_hit > 0").count() == 0
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.scanned(empty, bench).count() == 0
    odd = repeated.withColumn("_n_hit", F.lit("mine")).withColumn("_items", F.lit("too")).withColumn("_ranges", F.lit(1))
    for block in (1 << 20, 4):
        found = decontaminate.scanned(odd, bench, block_bytes=block)
        assert found.columns == [*odd.columns, "_n_words", "_n_hit_", "_spans", "_items_"] and found.count() == 27
        assert {(r["_n_hit"], r["_items"], r["_ranges"]) for r in found.collect()} == {("mine", "too", 1)}
    assert hashlib.sha256(b"").hexdigest()
