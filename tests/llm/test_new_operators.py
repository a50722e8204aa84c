"""Alignment of tokenizers, codes of vectors, mixing: against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import frame

from spanloom.llm import alignment, codes, mixing

PATHS = [public_tokenizers.path(x) for x in (alignment.A, alignment.B)]


def key(row):
    return tuple((x is not None, x) for x in row)


# --- op11


def byte_of():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}


def aligned(rows):
    """Whole texts through both tokenizers, all links one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok, table = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), byte_of()
    a_tok.encode_special_tokens = True
    docs, count = [], Counter()
    for doc, text in rows:
        groups = []
        a, b = (a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)) if text else ([], [])
        raw_a = [bytes(table[c] for c in a_tok.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_tok.id_to_piece(i)]]
        if text and b"".join(raw_a) == b"".join(raw_b) == f" {text}".encode():
            ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b)]
            lo = 0
            for hi in sorted(set(ends[0]) & set(ends[1])):
                groups.append(tuple(tuple(i for i, e in zip(ids, end, strict=True) if lo < e <= hi) for ids, end in zip((a, b), ends, strict=True)))
                lo = hi
        docs.append((doc, groups))
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    most = defaultdict(int)
    for (x, _), c in count.items():
        most[x] = max(most[x], c)
    for doc, groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        best, total = sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links)
        yield doc, *(sum(len(g[k]) for g in groups) for k in (0, 1)), len(groups), len(links), best, total, digest


ODD = [
    None, "", " ", "  a", "a  ", "\r\n x", "a\r\n\r\n b;\r c", "x▁y", "　a 　 b", "a\xa0\n\n b", "<|endoftext|> <s> </s>", "\x00 a\x1c b",
    "don't it's", "é é 你好 世界", "\n\n\na", "aaaa" * 300, "\t\ta b\t", "a b", "A\xa0\nB \xa0 c", "zz;\rz", "你好世界" * 500,
]


def strange(n=250, seed=5):
    rng = random.Random(seed)
    signs = " \n\t\r\xa0　aB1é'.;你\x85\x1c▁"
    return ["".join(rng.choice(signs[: rng.choice([5, 12, 18])]) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_alignment_is_that_of_whole_texts(spark, texts):
    rows = [(i, t) for i, t in enumerate([*ODD, *strange(), *texts[:45], *texts[3:6]])] + [(None, "no id"), (7, "again")]
    got = sorted((tuple(r) for r in alignment.linked(frame(spark, rows), *PATHS)[1].collect()), key=key)
    assert got == sorted(aligned(rows), key=key)


def test_alignment_over_many_chunks(spark, texts, monkeypatch):
    rows = [(i, t) for i, t in enumerate([*ODD, *texts[:30]])]
    tokens, lexicon, out = alignment.Tokens(*PATHS), None, []
    lexicon = alignment.Lexicon(tokens)
    for number, lo in enumerate(range(0, len(rows), 7)):  # chunks that share a lexicon give their own groups
        chunk = alignment.Chunk(number, lexicon)
        part = rows[lo : lo + 7]
        docs = chunk.add([i for i, _ in part], [t for _, t in part])
        group = next(iter(chunk.close()))
        held = {int(g) for row in docs.column("groups").to_pylist() for g in row}
        assert held == set(group.column("local").to_pylist())
        assert sum(group.column("docs").to_pylist()) == sum(map(len, docs.column("groups").to_pylist()))
        out += docs.column("n_links").to_pylist()
    assert out == [r[4] for r in aligned(rows)]


def test_segments_are_cut_where_no_token_crosses():
    tokens = alignment.Tokens(*PATHS)
    for text in [t for t in [*ODD, *strange(400, 9)] if t and "▁" not in t]:  # such texts have no tokens
        parts = alignment.segments(" " + text)
        assert "".join(parts) == " " + text
        a, b = tokens.encode(parts)
        assert sum(a, []) == tokens.a.encode(" " + text, add_special_tokens=False).ids
        assert sum(b, []) == tokens.b.encode(text)


def test_alignment_of_nothing(spark, empty):
    assert alignment.linked(empty, *PATHS)[1].count() == 0


def test_alignment_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.op11_alignment(spark, sf).collect())) == sorted(aligned(rows))


# --- op12


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def coded(rows):
    """The rounds in Python's integers."""
    inf = float("inf")
    rows = [(i, [math.floor(Fraction(x) * 4096) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and x == x and abs(x) != inf for x in v)]
    width = -(-max((len(v) for _, v, _ in rows), default=0) // 8)
    rows = sorted(((i, v + [0] * (8 * width - len(v)), label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[v[p * width : (p + 1) * width] for p in range(8)] for _, v, _ in rows]
    books = [[list(c[p]) for c in cut[:16]] for p in range(8)]
    find = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            members = defaultdict(list)
            for c in cut:
                members[find(c[p], books[p])[1]].append(c[p])
            for k, xs in members.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[find(c[p], books[p]) for p in range(8)] for c in cut]
    errors = Counter()
    for (_, _, label), f in zip(rows, found, strict=True):
        errors[label] += sum(d for d, _ in f)
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[label], digest) for (i, _, label), f in zip(rows, found, strict=True)]


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    base = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 24)], int(i) % 3) for i in rng.permutation(120)]
    odd = [(500, None, 1), (501, [1.0, None] * 12, 1), (502, [float("nan")] * 24, 1), (503, [float("inf")] * 24, 1), (504, base[0][1], None), (505, base[0][1], None), (None, base[1][1], 2), (506, base[2][1][:20], 2)]
    for rows in (base + odd, base[:5], base[:1] * 3, [(1, [], 1), (2, [], None)], [(i, [0.25] * 8, 0) for i in range(40)]):
        got = [tuple(r) for r in codes.compressed(vectors(spark, rows)).collect()]
        want = coded(rows)
        assert sorted(got, key=key) == sorted(want, key=key)


def test_codes_of_huge_components(spark):
    rows = [(i, [float(np.float32(x)) for x in (1e30 * (i % 3), -3e7 * i, i, 0.5, 1e9, -1e9, 0.1, i / 7)], i % 2) for i in range(30)]
    got, want = {r.vec_id: r.code for r in codes.compressed(vectors(spark, rows)).collect()}, {r[0]: r[1] for r in coded(rows)}
    assert got == want


def test_nearest_is_the_plain_minimum():
    rng = np.random.default_rng(1)
    for n, k, d, high in [(500, 16, 8, 3), (300, 16, 5, 10**6), (10, 1, 4, 9), (50, 7, 1, 2)]:
        rows, book = rng.integers(-high, high, (n, d)), rng.integers(-high, high, (k, d))
        gaps = ((rows[:, None] - book) ** 2).sum(2)
        at, gap = codes.nearest(rows, book)
        assert (at == gaps.argmin(1)).all() and (gap == gaps.min(1)).all()


def test_dimensions_go_by_variance():
    assert codes._dimension_order(np.array([[0, 5, 1], [1, -5, 1], [2, 0, 1]])) == [1, 0, 2]


def test_codes_of_nothing(spark):
    assert codes.compressed(vectors(spark, [])).count() == 0
    assert codes.compressed(vectors(spark, [(1, None, 1)])).count() == 0


def test_codes_equal_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.sql(codes.SQL)
    got = codes.op12_codes(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


# --- op13


def goals(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, stopped = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        free = [s for s in names if s not in stopped]
        left = Fraction(3, 2) * sum(sizes.values()) - sum(2 * sizes[s] for s in stopped)
        share = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if share * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: float(2 * sizes[s] if s in stopped else share * weight[s]) for s in names}
        stopped |= over


def held(rows, out):
    """All documents are there with their sizes and targets; what each source gives."""
    sizes, want, got = Counter(), Counter(), Counter()
    count = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    for _, t, s in rows:
        sizes[s] += count(t)
    goal = goals(sizes)
    source = {d: s for d, _, s in rows}
    for d, t, s in rows:
        want[d, count(t), sizes[s], round(goal[s], 6)] += 1
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in out) == want
    for r in out:
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 2 * r.size
        got[source[r.doc_id]] += r.taken
    return {s: (goal[s], got[s]) for s in sizes}


def mix(spark, rows, **more):
    return mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), **more).collect()


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([3, 8, 8, 50, 51, 400]), rng.choice(["b", "a", None, "é", "\U0001f600", "￿", "hot", "hot", "hot"])) for i in range(900)]
    out = mix(spark, rows)
    for goal, got in held(rows, out).values():
        assert abs(goal - got) <= 1
    again = mixing.mixed(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    other = mix(spark, rows, seed=99)
    assert sorted(map(tuple, out)) != sorted(map(tuple, other)) and held(rows, other).keys()


def test_mix_cuts_hot_lengths(spark):
    rows = [(i, "same text of five words", "one") for i in range(3000)] + [(5000 + i, "x y", "two") for i in range(10)]
    for goal, got in held(rows, mix(spark, rows)).values():
        assert abs(goal - got) <= 2.5


def test_mix_edges(spark):
    rows = [(1, "a b c", None), (2, None, None), (3, "x " * 50, "s"), (4, "x " * 50, "s"), (5, "", ""), (6, "y" * 10, "é"), (7, "y y", "é")]
    assert held(rows, mix(spark, rows))["s"][1] in (100, 150, 200)
    twice = rows + rows[2:4]
    assert len(mix(spark, twice)) == len(twice)
    assert mix(spark, []) == [] and mix(spark, [(1, None, "a")])[0].taken == 0


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_the_nearest_sum(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted(rng.sample(range(2, 40), 5)))
    left = np.array([rng.randrange(4) for _ in lengths])
    goal = rng.uniform(0, 60)
    sums = {0}
    for size, n in zip(lengths.tolist(), left.tolist(), strict=True):
        sums = {s + size * k for s in sums for k in range(n + 1)}
    got = mixing._nearest(lengths, left, goal)
    assert all(0 <= k <= left[lengths.tolist().index(size)] for size, k in got.items())
    assert abs(sum(size * k for size, k in got.items()) - goal) == min(abs(s - goal) for s in sums)


def test_fit_of_large_sources(monkeypatch):
    rng = np.random.default_rng(0)
    lengths, counts = np.arange(1, 3000, 7), rng.integers(1, 10**9, 429)
    words = int((lengths.astype(object) * counts).sum())
    for part in (0.1, 0.99, 1.4, 2.0):
        whole, extra = mixing.fitted(lengths, counts, float(int(words * part)))
        assert whole == int(part) and (extra >= 0).all() and (extra <= counts).all()
        assert abs(whole * words + int((lengths.astype(object) * extra).sum()) - int(words * part)) <= 1 + words / 2**52


def test_mix_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    for goal, got in held(rows, mixing.op13_mix(spark, sf).collect()).values():
        assert abs(goal - got) < 60

