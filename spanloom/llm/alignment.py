"""Which tokens of two tokenizers cover the same bytes, counted over a corpus (op11).

A text, with a space before it, is cut into *segments* at white space that
follows other characters: no token of either tokenizer crosses such a place, so
a segment's ids are the same wherever it stands, and a worker tokenizes each
distinct segment once (``MEMO`` of them, then it starts again).  Byte offsets
where tokens of both end cut a segment into *groups* (ids of A, ids of B).

Groups are interned: a *chunk* of documents gives its distinct groups with
their number of documents, and each document lists the groups it holds.  Every
distinct group is expanded into its id pairs once, times its documents; a pair
that one document holds in several groups would count several times there, and
what is too much is taken off by rows of their own.  Sums over pairs then go
back to the groups, from there to the chunks by the group key, and inside a
chunk to its documents.  No row is shuffled for each token, and a group that
stands in every document costs one row a chunk.

Group keys are the ids themselves, so nothing depends on hashes.

Edge cases: null and empty texts, and texts whose joined token bytes differ from
the text (U+2581 inside a text reads as a space), have no tokens and count for
nothing; repeated rows and rows without doc_id are documents of their own; an
empty table gives an empty result; other columns are ignored; texts are never
truncated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, written
from .packing import _visible_bytes, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct segments that a worker remembers, and bytes of texts in a chunk.
MEMO, CHUNK_BYTES = 400_000, 32 << 20
#: Documents whose segments are looked up together.
SLICE = 256

#: White space as the splitter of A knows it, but the carriage return, which tokens of B may hold behind other characters.
_SPACE = " \t\n\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Where a text holds carriage returns: before a single space between other characters.
_CAREFUL = re.compile(f"(?<=[^{_SPACE}\r])(?= [^{_SPACE}\r])")

_ROWS = pa.schema(
    [
        ("kind", pa.int8()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
        ("local", pa.int32()), ("key", pa.binary()), ("docs", pa.int64()), ("x", pa.int32()), ("y", pa.int32()),
    ]
)
_SQL_ROWS = (
    "kind tinyint, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "groups array<int>, times array<int>, local int, key binary, docs long, x int, y int"
)
_DOC, _GROUP, _TWICE = range(3)


def segments(text: str) -> list[str]:
    """A text that starts with a space, cut where no token of either tokenizer crosses."""
    return _CAREFUL.split(text) if "\r" in text else _SEGMENT.findall(text)


#: Stands between the ids of A and of B in a group's key, all of 32 bits.
_BAR = b"\xff\xff\xff\xff"


def _ids(key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of A and of B of a group."""
    ids = np.frombuffer(key, "<u4").astype(np.int64)
    at = int(np.argmax(ids == 0xFFFFFFFF))
    return ids[:at], ids[at + 1 :]


class _Column:
    """A numpy array that grows."""

    def __init__(self, kind: type = np.int64):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > self.data.size:
            self.data = np.resize(self.data, max(end, 2 * self.data.size))
        self.data[self.n : end] = values
        self.n = end

    def __getitem__(self, at):
        return self.data[: self.n][at]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[k] .. starts[k] + sizes[k] for every k, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if sizes.size else 0) + np.repeat(starts - ends + sizes, sizes)


class Tokens:
    """The two tokenizers, and the bytes that each id stands for."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: b for b, c in _visible_bytes().items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in xs]) for xs in (self.a_bytes, self.b_bytes))
        self.lead = self.b.encode("a")  # stands before each segment, so that B adds its space there

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]  # without offsets
        n = len(self.lead)
        b = [ids[n:] if ids[:n] == self.lead else [] for ids in self.b.encode(["a" + p for p in parts], num_threads=1)]
        return a, b


@lru_cache(1)
def _tokens(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


class Lexicon(dict):
    """Numbers of segments, and of the groups they consist of.

    A segment that is looked up for the first time gets the next number;
    ``settle`` then tokenizes all such segments together.
    """

    def __init__(self, tokens: Tokens):
        super().__init__()
        self.tokens, self.new, self.texts = tokens, [], []
        self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.first = (_Column() for _ in range(6))
        self.members = _Column()  # groups of segments, one after the other
        self.group, self.keys, self.group_links, self.group_texts = {}, [], [], []
        self.n_pairs, self.first_pair, self.pairs = _Column(), _Column(), _Column()  # distinct id pairs of groups

    def __missing__(self, segment: str) -> int:
        out = self[segment] = len(self)
        self.new.append(segment)
        return out

    def _group(self, key: bytes) -> int:
        """The number of a new group, which is expanded into its pairs."""
        number = self.group[key] = len(self.keys)
        a, b = _ids(key)
        self.keys.append(key)
        self.group_links.append(a.size * b.size)
        self.group_texts.append(",".join(map(str, a.tolist())) + "|" + ",".join(map(str, b.tolist())))
        codes = (np.unique(a)[:, None] * len(self.tokens.b_bytes) + np.unique(b)).ravel()
        self.first_pair.add([self.pairs.n])
        self.n_pairs.add([codes.size])
        self.pairs.add(codes)
        return number

    def _covering(self, parts: list[str], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether the bytes of a segment's tokens are the segment, for both tokenizers: all at once, or one by one where they are not."""
        t, raw = self.tokens, [p.encode() for p in parts]
        sizes, whole = list(map(len, raw)), b"".join(raw)

        def same(ids: list[list[int]], table: list[bytes], size: np.ndarray) -> bool:
            flat = list(chain.from_iterable(ids))
            ends = np.concatenate([[0], np.cumsum(size[flat])])[np.cumsum(list(map(len, ids)))]
            return b"".join(map(table.__getitem__, flat)) == whole and np.array_equal(ends, np.cumsum(sizes))

        if same(a, t.a_bytes, t.a_size) and same(b, t.b_bytes, t.b_size):
            return np.ones(len(parts), bool)
        joined = lambda ids, table: b"".join(map(table.__getitem__, ids))
        return np.array([joined(x, t.a_bytes) == r == joined(y, t.b_bytes) for r, x, y in zip(raw, a, b, strict=True)])

    def _numbers(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> np.ndarray:
        """The groups' numbers; those of one id on each side are looked up once for each distinct pair."""
        raw_a, raw_b, known = a.astype("<u4").tobytes(), b.astype("<u4").tobytes(), self.group
        out = np.empty(cut_a.size - 1, np.int64)
        plain = (np.diff(cut_a) == 1) & (np.diff(cut_b) == 1)
        pairs, first, inverse = np.unique(a[cut_a[:-1][plain]] * len(self.tokens.b_bytes) + b[cut_b[:-1][plain]], return_index=True, return_inverse=True)
        at = np.flatnonzero(plain)[first]
        number = np.empty(pairs.size, np.int64)
        for k, (i, j) in enumerate(zip(cut_a[at].tolist(), cut_b[at].tolist(), strict=True)):
            key = raw_a[4 * i : 4 * i + 4] + _BAR + raw_b[4 * j : 4 * j + 4]
            number[k] = known[key] if key in known else self._group(key)
        out[plain] = number[inverse]
        rest = np.flatnonzero(~plain)
        keys = [raw_a[4 * i : 4 * j] + _BAR + raw_b[4 * k : 4 * m] for i, j, k, m in zip(*(c.tolist() for c in (cut_a[rest], cut_a[rest + 1], cut_b[rest], cut_b[rest + 1])), strict=True)]
        out[rest] = [known[key] if key in known else self._group(key) for key in keys]
        return out

    def settle(self) -> None:
        """Tokenize the new segments."""
        new, self.new = self.new, []
        if not new:
            return
        t = self.tokens
        a, b = t.encode(new)
        good = self._covering(new, a, b)
        a, b = ([x if g else [] for x, g in zip(xs, good, strict=True)] if not good.all() else xs for xs in (a, b))
        n_a, n_b = (np.fromiter(map(len, xs), np.int64, len(xs)) for xs in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(xs), np.int64, n.sum()) for xs, n in ((a, n_a), (b, n_b)))
        end_a, end_b = np.cumsum(t.a_size[flat_a]), np.cumsum(t.b_size[flat_b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)  # every segment ends in both
        cut_a, cut_b = (np.concatenate([[0], np.searchsorted(e, both) + 1]) for e in (end_a, end_b))
        groups = self._numbers(flat_a, flat_b, cut_a, cut_b)
        tokens_before = np.concatenate([[0], np.cumsum(n_a)])
        at = np.searchsorted(cut_a, tokens_before)  # groups before each segment
        self.first.add(self.members.n + at[:-1])
        self.members.add(groups)
        links = np.concatenate([[0], np.cumsum(np.diff(cut_a) * np.diff(cut_b))])
        for column, values in ((self.good, good), (self.n_a, n_a), (self.n_b, n_b), (self.n_groups, np.diff(at)), (self.n_links, np.diff(links[at]))):
            column.add(values)
        text = list(map(self.group_texts.__getitem__, groups.tolist()))
        self.texts += [";".join(text[i:j]) for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROWS], schema=_ROWS)


class Chunk:
    """Documents whose groups are interned together."""

    def __init__(self, number: int, lexicon: Lexicon):
        self.number, self.lexicon, self.bytes, self.seen = number, lexicon, 0, len(lexicon)
        self.docs = np.zeros(0, np.int64)
        self.twice: list[np.ndarray] = []

    def full(self) -> bool:
        return self.bytes >= CHUNK_BYTES or len(self.lexicon) - self.seen >= MEMO

    def add(self, doc_ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        """A row for each document."""
        lex, parts = self.lexicon, [segments(f" {t}") if t else [] for t in texts]
        self.bytes += sum(map(len, filter(None, texts)))
        sizes = np.array([len(p) for p in parts])
        ids = np.fromiter(map(lex.__getitem__, chain.from_iterable(parts)), np.int64, sizes.sum())
        lex.settle()
        owner = np.repeat(np.arange(len(texts)), sizes)
        good = (sizes > 0) & (np.bincount(owner, lex.good[ids] == 0, len(texts)) == 0)
        columns = {"n_a": lex.n_a, "n_b": lex.n_b, "n_groups": lex.n_groups, "n_links": lex.n_links}
        totals = {c: np.where(good, np.bincount(owner, v[ids], len(texts)), 0).astype(np.int64) for c, v in columns.items()}  # exact: below 2**53
        names, strings = ids.tolist(), []
        for g, n, e in zip(good.tolist(), sizes.tolist(), np.cumsum(sizes).tolist(), strict=True):
            strings.append(hashlib.sha256(";".join(map(lex.texts.__getitem__, names[e - n : e])).encode()).hexdigest() if g else "")
        held = good[owner]
        ids, owner = ids[held], owner[held]
        n, many = lex.n_groups[ids], max(1, len(lex.keys))
        code, times = np.unique(np.repeat(owner, n) * many + lex.members[_spread(lex.first[ids], n)], return_counts=True)
        doc, group = np.divmod(code, many)
        seen = np.bincount(group, minlength=many)
        seen[: self.docs.size] += self.docs
        self.docs = seen
        n, wide = lex.n_pairs[group], len(lex.tokens.a_bytes) * len(lex.tokens.b_bytes)
        pair = np.sort(np.repeat(doc, n) * wide + lex.pairs[_spread(lex.first_pair[group], n)])
        self.twice.append(pair[1:][pair[1:] == pair[:-1]] % wide)
        count = np.bincount(doc, minlength=len(texts))
        fixed = {"kind": np.full(len(texts), _DOC), "chunk": np.full(len(texts), self.number), "doc_id": doc_ids, "groups_sha256": strings}
        return _batch(len(texts), **fixed, **totals, groups=_lists(group, count), times=_lists(times, count))

    def close(self) -> Iterator[pa.RecordBatch]:
        """Rows of the groups, and of the pairs that documents hold in more than one group."""
        at = np.flatnonzero(self.docs)
        yield _batch(at.size, kind=np.full(at.size, _GROUP), chunk=np.full(at.size, self.number), local=at, key=[self.lexicon.keys[g] for g in at], docs=self.docs[at])
        code, n = np.unique(np.concatenate([*self.twice, np.zeros(0, np.int64)]), return_counts=True)
        x, y = np.divmod(code, len(self.lexicon.tokens.b_bytes))
        yield _batch(code.size, kind=np.full(code.size, _TWICE), x=x, y=y, docs=-n)


def interned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents, of the groups of their chunks, and of pairs that count too often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = lexicon = None
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                if chunk is None or chunk.full():
                    if chunk is not None:
                        yield from chunk.close()
                    if lexicon is None or len(lexicon) >= MEMO:
                        lexicon = Lexicon(_tokens(a_path, b_path))
                    chunk = Chunk((part.column(2)[0].as_py() << 32) + (chunk.number % (1 << 32) + 1 if chunk else 0), lexicon)
                yield chunk.add(part.column(0), part.column(1).to_pylist())
        if chunk is not None:
            yield from chunk.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().cast("long").alias("_task"))
    return rows.mapInArrow(run, _SQL_ROWS)


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, x, y, links, docs) of distinct groups: each pair of distinct ids once, with how often it is linked in the group."""
    names = ["key", "x", "y", "links", "docs"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 1 << 12):
            keys, docs = (batch.slice(lo, 1 << 12).column(c) for c in (0, 1))
            where, xs, ys, ms = [], [], [], []
            for i, key in enumerate(keys.to_pylist()):
                (x, p), (y, q) = (np.unique(part, return_counts=True) for part in _ids(key))
                where.append(np.full(x.size * y.size, i))
                xs.append(np.repeat(x, y.size))
                ys.append(np.tile(y, x.size))
                ms.append(np.outer(p, q).ravel())
            at = np.concatenate(where)
            cols = [keys.take(pa.array(at)), *(pa.array(np.concatenate(v), k) for v, k in ((xs, pa.int32()), (ys, pa.int32()), (ms, pa.int64()))), docs.take(pa.array(at))]
            yield pa.RecordBatch.from_arrays(cols, names)


def _to_documents(docs: pa.Table, values: pa.Table) -> pa.Table:
    """Sums over a chunk's documents of what its groups are worth."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    local = values.column("place").to_numpy()
    sums = {}
    lists = docs.column("groups").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    group, times = lists.flatten().to_numpy(), docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    for name in ("n_best", "count_sum"):
        worth = np.zeros(local.max(initial=-1) + 1, np.int64)
        worth[local] = values.column(name).to_numpy()
        run = np.concatenate([[0], np.cumsum(worth[group] * times)])
        sums[name] = run[ends] - run[ends - sizes]
    return pa.Table.from_arrays([pa.array(sums[n]) if n in sums else docs.column(n) for n in names], names)


def linked(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Id pairs (x, y, count of documents, whether it is its x's highest), and a row of sums for each document."""
    rows = written(interned(docs, a_path, b_path), "interned")
    local = rows.where(F.col("kind") == _GROUP).select("chunk", "local", "key", "docs")
    groups = local.groupBy("key").agg(F.sum("docs").alias("docs"))
    links = written(groups.mapInArrow(_expanded, "key binary, x int, y int, links long, docs long"), "links")
    twice = rows.where(F.col("kind") == _TWICE).select("x", "y", "docs")
    pairs = links.select("x", "y", "docs").unionByName(twice).groupBy("x", "y").agg(F.sum("docs").alias("count"))
    best = pairs.groupBy("x").agg(F.max("count").alias("_best"))
    pairs = written(pairs.join(best, "x").select("x", "y", "count", (F.col("count") == F.col("_best")).alias("best")), "pairs")
    worth = links.join(pairs, ["x", "y"]).groupBy("key").agg(
        F.sum(F.col("links") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum")
    )
    values = local.join(worth, "key").select(F.col("chunk").alias("of"), F.col("local").alias("place"), "n_best", "count_sum")
    out = (
        rows.where(F.col("kind") == _DOC)
        .groupBy("chunk")
        .cogroup(values.groupBy("of"))
        .applyInArrow(
            _to_documents, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        )
    )
    return pairs, out


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), tokenizer_path(A), tokenizer_path(B))[1]
