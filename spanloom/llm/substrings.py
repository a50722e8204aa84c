"""Substring dedup by level-wise doubling (op4).

The first level is the length that is asked for: it counts every window of 35
words in the corpus, and what goes is decided there.  A word covered by a
window whose sequence also starts elsewhere, in the same document or another,
is removed.  Only windows repeated at one length are extended to twice that
length: the window at i survives to 2L if those at i and i + L were repeated,
and is counted again.  Levels go on until none survive; they tell how long a
document's repeats are (``longest``) without another look at the texts.

Edge cases: null, empty and shorter texts have no window and lose nothing;
repeated rows are copies of each other, so their windows repeat; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .base import chunk_of, fewer, table, text_bytes, written
from .census import Deal, answered, concatenated

WINDOW = 35

_ROW = pa.schema(
    [
        ("chunk", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()), ("kept", pa.string()), ("at", pa.binary()), ("keys", pa.binary()),
    ]
)
_LEVEL = pa.schema([("chunk", pa.int64()), ("row", pa.int64()), ("at", pa.binary()), ("keys", pa.binary())])


def _spark(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _doubled(at: np.ndarray, key: np.ndarray, length: int) -> tuple[bytes, bytes]:
    """Windows of twice the length whose two halves are both among the repeated ones."""
    place = np.searchsorted(at, at + length)
    place[place == at.size] = 0
    both = at[place] == at + length if at.size else np.zeros(0, bool)
    a, b, c = tk.LANES[1]
    twice = key[both] * a ^ (key[place[both]] + c) * b
    return at[both].astype(np.uint32).tobytes(), tk.mix(twice).tobytes()


def deduplicated(docs: DataFrame, window: int = WINDOW, keep_text: bool = True, levels: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (if ``keep_text``) and longest (0 where nothing repeats)."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = text_bytes(docs)
    deal = Deal.of(size, size / 6, least)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", chunk_of(deal.chunks, "doc_id", "text"))

    def hashes(t: pa.Table):
        keys, routes, parts = [], [], []
        for lo, hi, buf, off in tk.text_slices(t.column("text")):
            w = tk.Words(buf, off)
            h, ok = w.hashes(), np.flatnonzero(w.valid(window))
            keys.append(tk.windows(h, window)[ok])
            routes.append(tk.windows(h, window, 1)[ok])
            parts.append((lo, w, ok))
        return concatenated(keys), concatenated(routes), parts

    def finish(t: pa.Table, key: np.ndarray, count: np.ndarray, parts: list) -> pa.Table:
        chunk, ids, out, done = t.column("chunk")[0].as_py(), t.column("doc_id").to_pylist(), [], 0
        for lo, w, ok in parts:
            again = count[done : done + ok.size] > 1
            hit = np.zeros(w.start.size, bool)
            hit[ok[again]] = True
            gone, mine = tk.covered(hit, window), key[done : done + ok.size][again]
            starts, bounds = ok[again], np.searchsorted(ok[again], w.woff)
            done += ok.size
            raw = w.buf.tobytes()
            for i in range(len(w.count)):
                words = raw[w.off[i] : w.off[i + 1]].split()
                lost = gone[w.woff[i] : w.woff[i + 1]]
                n_lost = int(lost.sum())
                text = b" ".join(compress(words, ~lost) if n_lost else words)
                a, b = bounds[i], bounds[i + 1]
                state = _doubled(starts[a:b] - w.woff[i], mine[a:b], window) if n_lost and levels else (None, None)
                out.append((chunk, (chunk << 24) | (lo + i), ids[lo + i], len(words), n_lost, hashlib.sha256(text).hexdigest(), text.decode() if keep_text else None, *state))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ROW, strict=True)], schema=_ROW)

    first = written(answered(rows, deal, hashes, finish, _spark(_ROW)), "windows")
    found = [first.where("n_removed > 0").select("row", F.lit(window).cast("long").alias("longest"))]
    state, length = first.where("length(at) > 0").select("chunk", "row", "at", "keys"), window
    while levels:
        weight = state.agg(F.sum(F.length("keys").cast("long"))).first()[0] or 0
        if not weight:
            break
        length *= 2
        state = written(_level(state, length, weight, least), "level")
        found.append(state.select("row", F.lit(length).cast("long").alias("longest")))
        state = state.where("length(at) > 0")
    longest = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.max("longest").alias("longest"))
    out = first.join(longest, "row", "left").withColumn("longest", F.coalesce("longest", F.lit(0).cast("long")))
    return fewer(out).select("doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text, "longest")


def _level(state: DataFrame, length: int, weight: int, least: int) -> DataFrame:
    """Rows with a repeated window of ``length`` words, and their windows of twice that."""
    deal = Deal.of(weight, weight / 8, least)

    def hashes(t: pa.Table):
        keys = concatenated([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("keys")])
        return keys, tk.mix(keys ^ tk.LANES[1][2]), None

    def finish(t: pa.Table, key: np.ndarray, count: np.ndarray, _: None) -> pa.Table:
        out, done = [], 0
        for chunk, row, blob in zip(t.column("chunk").to_pylist(), t.column("row").to_pylist(), t.column("at"), strict=True):
            at = np.frombuffer(blob.as_buffer(), np.uint32).astype(np.int64)
            again = count[done : done + at.size] > 1
            mine = key[done : done + at.size][again]
            done += at.size
            if mine.size:
                out.append((chunk, row, *_doubled(at[again], mine, length)))
        cols = zip(*out, strict=True) if out else [[]] * len(_LEVEL)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LEVEL, strict=True)], schema=_LEVEL)

    rows = state.select(chunk_of(deal.chunks, "row"), "row", "at", "keys")
    return answered(rows, deal, hashes, finish, _spark(_LEVEL))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), keep_text=False)


def _sql(last: int = WINDOW << 9) -> str:
    """Windows as joined words, counted over the corpus; each level extends the repeated windows of the one before."""
    head = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x35 AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r35 AS MATERIALIZED (SELECT doc_id, i FROM x35 WHERE win IN (SELECT win FROM x35 GROUP BY win HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM r35, range(35) AS y(k)),
k AS (SELECT o.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY o.i) AS t FROM (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)) o ANTI JOIN g USING (doc_id, i) GROUP BY o.doc_id)"""
    parts, length = ["SELECT doc_id, 35 AS size FROM r35"], WINDOW
    while length < last:
        a, length = length, 2 * length
        head += f""",
x{length} AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + {length - 1}], ' ')) AS win FROM r{a} p JOIN (SELECT doc_id, i - {a} AS i FROM r{a}) USING (doc_id, i) JOIN d USING (doc_id)),
r{length} AS MATERIALIZED (SELECT doc_id, i FROM x{length} WHERE win IN (SELECT win FROM x{length} GROUP BY win HAVING count(*) > 1))"""
        parts.append(f"SELECT doc_id, {length} FROM r{length}")
    return head + f""",
m AS (SELECT doc_id, max(size) AS longest FROM ({" UNION ALL ".join(parts)}) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256, coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""


SQL = _sql()
