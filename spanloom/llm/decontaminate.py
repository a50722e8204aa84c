"""Benchmark decontamination with one Aho-Corasick automaton (op1).

Test questions and answers are normalised to words (A-Z lower-cased; digits,
a-z and everything outside ASCII are word characters) and cut into windows of
ten words; a shorter item is one window.  Each document is normalised the same
way, scanned once, and every match is mapped back to the characters of the
original text.

The automaton's size is checked.  One block of up to ``BLOCK_BYTES`` of benchmark
is one scan and no shuffle.  A larger benchmark is dealt by hash into blocks:
each is a scan of its own with one automaton, which is dropped before the next,
and leaves the word ranges and items of the documents it hits in a written
table.  These meet their texts once, at the end, by (doc_id, hash of the text).

Edge cases: null and empty texts have no words and no hits; items without
words have no window; repeated items each count; with an empty benchmark
nothing is hit; an empty table gives an empty result; other columns are kept,
and a name that the documents have already gets underscores at its end, as by
:func:`base.free`.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .base import free, table, written

WINDOW = 10
#: Most bytes of benchmark text in one automaton (its windows take about ten times as many nodes).
BLOCK_BYTES = 1 << 20

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b in _SEPARATORS else b for b in range(256)
)
_WORD = np.array([_FOLD[b] != 32 for b in range(256)])


def normalised(text: bytes) -> tuple[str, int]:
    """`` w1 w2 … wn `` with one character a byte, and n."""
    words = text.translate(_FOLD).split()
    return (" " + b" ".join(words).decode("latin-1") + " ") if words else "", len(words)


def patterns(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[str, tuple[int, list[str]]]:
    """Window -> (its words, ids of the items that hold it)."""
    found: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        line, n = normalised((text or "").encode())
        words = line[1:-1].split(" ")  # str.split() would also cut at bytes 0x85 and 0xA0 inside letters
        for i in range(max(1, n - window + 1) if n else 0):
            part = words[i : i + window]
            owners = found.setdefault(f" {' '.join(part)} ", (len(part), []))[1]
            if not owners or owners[-1] != str(item):
                owners.append(str(item))
    return found


class Scanner:
    """The automaton of one block, built once a task."""

    def __init__(self, found: dict[str, tuple[int, list[str]]]):
        self.automaton = ahocorasick.Automaton()
        for key, value in found.items():
            self.automaton.add_word(key, value)
        if found:
            self.automaton.make_automaton()

    def hits(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Words of a text, word ranges (first, past the last) of the matches, and the items matched."""
        line, n = normalised(text)
        ends, sizes, items = [], [], set()
        if n and len(self.automaton):
            for end, (size, owners) in self.automaton.iter(line):
                ends.append(end)
                sizes.append(size)
                items.update(owners)
        if not ends:
            return n, _NONE, items
        stop = np.searchsorted(np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32), ends)
        return n, np.unique(np.stack([stop - sizes, stop], 1), axis=0), items


_ADDED = ["_n_words", "_n_hit", "_spans", "_items"]


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` and ``_n_words``, ``_n_hit``, ``_spans`` (merged, code points of the original) and ``_items``.

    ``_n_hit`` counts the words in the spans.
    """
    spark, names = docs.sparkSession, docs.columns
    bench = benchmark.select(F.col("item_id"), "text")
    size = bench.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added, kinds = [free(docs, c) for c in _ADDED], [T.LongType(), T.LongType(), span, T.ArrayType(T.StringType())]
    schema = T.StructType([*docs.schema, *[T.StructField(c, t) for c, t in zip(added, kinds, strict=True)]])

    def shared(part: DataFrame):
        return spark.sparkContext.broadcast(patterns([(r[0], r[1]) for r in part.collect()], window))

    if blocks == 1:
        found = shared(bench)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(found.value)
            for batch in batches:
                for lo, hi, buf, off in tk.text_slices(batch.column("text")):
                    hits = [scanner.hits(buf[off[i] : off[i + 1]].tobytes()) for i in range(hi - lo)]
                    yield _told(batch.slice(lo, hi - lo), names, added, buf, off, hits)

        return docs.mapInArrow(whole, schema)

    key, digest, ranges = free(docs, "_key"), free(docs, "_digest"), free(docs, "_ranges")
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest: F.xxhash64("text")})
    hits = None
    for k in range(blocks):
        found = shared(bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k))

        def part(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(found.value)
            for batch in batches:
                rows = []
                for lo, hi, buf, off in tk.text_slices(batch.column("text")):
                    for i in range(hi - lo):
                        _, runs, items = scanner.hits(buf[off[i] : off[i + 1]].tobytes())
                        if len(runs):
                            rows.append((batch.column(key)[lo + i].as_py(), batch.column(digest)[lo + i].as_py(), runs.tolist(), sorted(items)))
                kinds = [pa.string(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, digest, "runs", "items"])

        one = written(keyed.select(key, digest, "text").mapInArrow(part, f"`{key}` string, `{digest}` long, runs array<array<long>>, items array<string>"), "hits")
        found.destroy()
        hits = one if hits is None else hits.unionByName(one)
    merged = hits.groupBy(key, digest).agg(F.struct(F.flatten(F.collect_set("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")).alias(ranges))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in tk.text_slices(batch.column("text")):
                mine = batch.column(ranges).slice(lo, hi - lo).to_pylist()
                words = [normalised(buf[off[i] : off[i + 1]].tobytes())[1] for i in range(hi - lo)]
                hits = [(n, np.array(x["runs"], np.int64), set(x["items"])) if x else (n, _NONE, set()) for n, x in zip(words, mine, strict=True)]
                yield _told(batch.slice(lo, hi - lo), names, added, buf, off, hits)

    return keyed.join(written(merged, "hits"), [key, digest], "left").select(*names, ranges).mapInArrow(close, schema)


_NONE = np.zeros((0, 2), np.int64)


def _told(batch: pa.RecordBatch, names: list[str], added: list[str], buf: np.ndarray, off: np.ndarray, hits: list[tuple[int, np.ndarray, set[str]]]) -> pa.RecordBatch:
    """The rows with the words hit, merged, and where they lie in the text."""
    n_hit, spans = [], []
    for i, (n, runs, _) in enumerate(hits):
        if not len(runs):
            n_hit.append(0)
            spans.append([])
            continue
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, runs[:, 0], 1)
        np.add.at(marks, runs[:, 1], -1)
        hit = np.cumsum(marks)[:n] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
        n_hit.append(int(hit.sum()))
        spans.append(_original(buf[off[i] : off[i + 1]].tobytes(), edge.reshape(-1, 2)))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    words, items = [n for n, _, _ in hits], [sorted(x) for _, _, x in hits]
    new = [pa.array(words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *new], [*names, *added])


def _original(text: bytes, runs: np.ndarray) -> list[dict[str, int]]:
    """Word ranges as code point ranges of the text they came from."""
    buf = np.frombuffer(text, np.uint8)
    words = tk.Words(buf, np.array([0, buf.size]), _WORD)
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return [{"start": int(chars[words.start[a]]), "end": int(chars[words.end[b - 1]])} for a, b in runs]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )


#: Windows as word lists on both sides, joined by equality.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (
    SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)),
k AS (SELECT item_id, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM k),
s AS (SELECT DISTINCT size FROM p),
e AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d, s WHERE len(w) >= size),
m AS (SELECT e.doc_id, e.i, e.size, p.item_id FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM e) e JOIN p USING (size, win)),
h AS (SELECT doc_id, count(DISTINCT i + x) AS n_hit FROM (SELECT doc_id, i, unnest(range(size)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
