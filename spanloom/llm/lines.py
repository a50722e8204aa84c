"""Line dedup by winnowing (op5).

A document is the sequence of its lines that hold a word, each trimmed of
blanks.  A run is one or more lines in a row with ``MIN_CHARS`` characters or
more.  A line goes if it lies in a run that occurs earlier, in the order of
(doc_id, line); the first place of each run stays.

1. From every line the shortest run to the right and the shortest to the left
   are windows.  The smallest line hash in a window is its fingerprint, so two
   places that share a run share a fingerprint in it.  A window that repeats
   inside its document is found there and travels no further.
2. Places of a fingerprint that occurs once are dropped; positions of the others
   are joined with the number of their fingerprint.
3. At a repeated fingerprint, matches are extended both ways: every window that
   chose it, from those that end at it to those that start at it, is compared
   with the first place of its own.  Overlapping windows that match are one run,
   as long as the match goes: each part of ``MIN_CHARS`` of it is such a window.
4. The lines of later runs go.

No pairs are made: a place is compared with the first of its window only, by a
partial minimum of one integer.  Fingerprints and windows with over a 4096th of
all places are 4096 at most and are broadcast, so none of them is a hot key.
The texts meet their runs in a sort-merge join at every size.

Edge cases: null and empty texts have no line; a row without doc_id comes after
all others, in the order of a hash of its text (doc_ids are taken to be below
2**62); rows of one doc_id do not delete each other's lines, and rows that repeat
a doc_id and its text get the same result; an empty table gives an empty
result; other columns are kept by :func:`deduplicated`, whose own columns take
names that are free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .base import fewer, free, release, spread, table, written

#: Fewest characters (code points of trimmed lines) of a run.
MIN_CHARS = 25

_LINE = tk.lut(b"\n")
#: Columns that :func:`deduplicated` adds.
ADDED = ["_n_lines", "_n_removed", "_kept"]
_MARK = pa.schema(
    [
        ("_key", pa.int64()), ("_hash", pa.int64()), ("print", pa.int64()),
        ("at", pa.list_(pa.int32())), ("size", pa.list_(pa.int32())), ("window", pa.list_(pa.int64())),
    ]
)


def lines_of(buf: np.ndarray, off: np.ndarray) -> tuple[tk.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a slice, which of them hold a word, and the trimmed start and end of these."""
    lines, words = tk.Words(buf, off, _LINE), tk.Words(buf, off)
    first = np.searchsorted(words.start, lines.start)
    after = np.searchsorted(words.start, lines.end)
    full = after > first
    return lines, full, words.start[first[full]], words.end[after[full] - 1]


def shortest_runs(doc: np.ndarray, chars: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and lines of the shortest runs to the right and to the left of every line, each once."""
    total, at = np.concatenate([[0], np.cumsum(chars)]), np.arange(chars.size)
    end = np.searchsorted(total, total[:-1] + least)  # past the last line of the run from each line
    some = np.flatnonzero(end <= chars.size)
    right = some[doc[end[some] - 1] == doc[some]]
    begin = np.searchsorted(total, total[1:] - least, "right") - 1
    some = np.flatnonzero(begin >= 0)
    left = some[doc[begin[some]] == doc[some]]
    first, size = np.concatenate([right, begin[left]]), np.concatenate([end[right] - right, at[left] - begin[left] + 1])
    _, one = np.unique(first * np.int64(least + 1) + size, return_index=True)
    return first[one], size[one]


def _anchors(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    for lo, _, buf, off in tk.text_slices(batch.column("_text")):
        lines, full, start, end = lines_of(buf, off)
        if not start.size:
            continue
        doc = lines.doc[full]
        h = tk.span_hashes(buf, start, end)
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        first, size = shortest_runs(doc, points[end] - points[start], least)
        window, prints, place = np.zeros(first.size, np.uint64), np.zeros(first.size, np.uint64), np.zeros(first.size, np.int64)
        for k in np.unique(size):
            mine = np.flatnonzero(size == k)
            at = first[mine]
            window[mine] = tk.mix(tk.windows(h, int(k))[at] + np.uint64(k))
            best = np.argmin(np.stack([h[at + i] for i in range(k)]), 0)
            place[mine], prints[mine] = at + best, h[at + best]
        bound = np.searchsorted(doc, np.arange(len(off)))
        who = doc[first]
        order = np.lexsort((first, window, who))
        later = np.zeros(first.size, bool)
        later[order[1:]] = (window[order[1:]] == window[order[:-1]]) & (who[order[1:]] == who[order[:-1]])
        owner, number = pa.array(who + lo), (first - bound[who]).astype(np.int32)

        def rows(mine: np.ndarray, cut: np.ndarray, prints: pa.Array, owner=owner, number=number, size=size, window=window) -> pa.RecordBatch:
            """A row for the windows ``mine[cut[i]]`` to ``mine[cut[i + 1]]``."""
            offsets, one = pa.array(np.append(cut, mine.size).astype(np.int32)), owner.take(pa.array(mine[cut]))
            listed = [pa.ListArray.from_arrays(offsets, pa.array(x[mine])) for x in (number, size.astype(np.int32), window.view(np.int64))]
            return pa.RecordBatch.from_arrays([batch.column("_key").take(one), batch.column("_hash").take(one), prints, *listed], schema=_MARK)

        mine = np.flatnonzero(later)
        if mine.size:  # repeats inside the document: no fingerprint
            cut = np.flatnonzero(np.diff(who[mine], prepend=-1))
            yield rows(mine, cut, pa.nulls(cut.size, pa.int64()))
        mine = np.flatnonzero(~later)
        if mine.size:
            mine = mine[np.lexsort((first[mine], place[mine]))]
            cut = np.flatnonzero(np.diff(place[mine], prepend=-1))
            yield rows(mine, cut, pa.array(prints[mine[cut]].view(np.int64)))


def repeated_runs(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """_key, _hash and the windows (at, size) that occur earlier, of documents that have any."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _anchors(batch, least)

    schema = "_key long, _hash long, print long, at array<int>, size array<int>, window array<long>"
    marks = written(docs.mapInArrow(emit, schema), "fingerprints")
    often = written(marks.where("print is not null").groupBy("print").agg(F.count("*").alias("n")).where("n > 1"), "prints")
    each = F.explode(F.arrays_zip("at", "size", "window")).alias("w")
    held = spread(marks.where("print is not null"), often, ["print"], "n")
    places = written(held.select("_key", "_hash", each).select("_key", "_hash", "w.at", "w.size", "w.window"), "windows")
    first = written(places.groupBy("window").agg(F.min("_key").alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    later = spread(places, first, ["window"], "n").where("_key > first").select("_key", "_hash", "at", "size")
    within = marks.where("print is null").select("_key", "_hash", each).select("_key", "_hash", "w.at", "w.size")
    out = later.unionByName(within).groupBy("_key", "_hash").agg(F.collect_set(F.struct("at", "size")).alias("_starts"))
    out = written(out, "runs")
    release(marks, places)
    return out


def deduplicated(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs``, and _n_lines, _n_removed and _kept, the text without later repeated runs.

    A name that ``docs`` has already gets underscores at its end, as by :func:`base.free`.
    """
    digest = F.xxhash64("text")
    key = F.coalesce(F.col("doc_id").cast("long"), digest.bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 62)))
    runs = repeated_runs(docs.select(key.alias("_key"), digest.alias("_hash"), F.col("text").alias("_text")), least)
    added, kinds = [free(docs, c) for c in ADDED], [T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*docs.schema, *[T.StructField(c, t) for c, t in zip(added, kinds, strict=True)]])
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in tk.text_slices(batch.column("text")):
                yield _cut(batch.slice(lo, hi - lo), names, added, starts, buf, off)

    k, h, starts = free(docs, "_key"), free(docs, "_hash"), free(docs, "_starts")
    runs = runs.select(F.col("_key").alias(k), F.col("_hash").alias(h), F.col("_starts").alias(starts))
    paired = docs.withColumns({k: key, h: digest}).join(runs.hint("merge"), [k, h], "left").select(*names, starts)
    return fewer(paired).mapInArrow(cut, schema)


def _cut(batch: pa.RecordBatch, names: list[str], added: list[str], column: str, buf: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    lines, full, *_ = lines_of(buf, off)
    count = np.bincount(lines.doc[full], minlength=len(off) - 1)
    starts = batch.column(column)
    removed, kept = np.zeros(len(off) - 1, np.int64), []
    for i, text in enumerate(batch.column("text")):
        text = text.as_py()
        if starts[i].is_valid:
            gone = {x["at"] + k for x in starts[i].as_py() for k in range(x["size"])}
            removed[i] = len(gone)
            out, at = [], 0
            for line in text.split("\n"):
                some = bool(line.strip(" \t\n\v\f\r"))
                if not (some and at in gone):
                    out.append(line)
                at += some
            text = "\n".join(out)
        kept.append(text)
    arrays = [batch.column(c) for c in names]
    return pa.RecordBatch.from_arrays(
        [*arrays, pa.array(count.astype(np.int64)), pa.array(removed), pa.array(kept, pa.string())], [*names, *added]
    )


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.coalesce("_kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


#: Shortest runs to the right and to the left of every line, compared with their first place in the order of (doc_id, line).
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, k, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS has FROM (SELECT doc_id, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))),
f AS (SELECT doc_id, k, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM l WHERE has),
c AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM f),
a AS (SELECT doc_id, list(line ORDER BY i) AS ls, list(upto ORDER BY i) AS us FROM c GROUP BY doc_id),
w AS (SELECT c.doc_id, c.i, x.n, a.ls[c.i:c.i + x.n - 1] AS win, a.us[c.i + x.n - 1] AS b, c.upto - length(c.line) AS s, c.upto AS s1, coalesce(a.us[c.i + x.n - 2], 0) AS b1
  FROM c JOIN a USING (doc_id), range(1, 26) AS x(n) WHERE c.i + x.n - 1 <= len(a.ls)),
r AS (SELECT doc_id, i, n, win FROM w WHERE b - s >= 25 AND (n = 1 OR b1 - s < 25 OR b - s1 < 25)),
m AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM r),
g AS (SELECT DISTINCT doc_id, i + x AS i FROM (SELECT doc_id, i, unnest(range(n)) AS x FROM m WHERE nth > 1)),
z AS (SELECT l.doc_id, l.k, l.line, g.i IS NOT NULL AS gone, l.has FROM l LEFT JOIN f USING (doc_id, k) LEFT JOIN g ON g.doc_id = f.doc_id AND g.i = f.i)
SELECT doc_id, count(*) FILTER (has)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM z GROUP BY doc_id
"""
