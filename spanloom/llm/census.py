"""How often each 64-bit key occurs in a corpus, answered to every place that holds it.

Keys are never shuffled as rows.  Documents are dealt into *chunks* by a hash
of their content; a chunk sorts its distinct keys into *buckets* by a second,
independent hash and sends one packed blob to each (8 bytes a distinct key and a
byte for its count; counts over 254, up to 2**32 - 1, are listed behind).  A bucket
adds up the counts and answers each chunk with one count a key, packed alike, in
the chunk's own order; the chunk is then dealt
out again, recomputes its keys and reads the answers beside them.

A key that occurs everywhere costs one entry a chunk, so no key is hot.  A
chunk's content depends on its rows alone, not on the file splits, so a lost
task gives the same blobs again.  Two keys meet only in the same bucket, so
their effective width is 64 bits plus the logarithm of the bucket count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import ordered, written

#: Chunk and bucket sizes grow with the square root of the corpus, within these bounds.
CHUNK_BYTES = (4 << 20, 128 << 20)
BUCKET_BYTES = (16 << 20, 128 << 20)

Hashes = Callable[[pa.Table], tuple[np.ndarray, np.ndarray, object]]
Finish = Callable[[pa.Table, np.ndarray, np.ndarray, object], pa.Table]


@dataclass(frozen=True)
class Deal:
    chunks: int
    buckets: int

    @classmethod
    def of(cls, text_bytes: int, keys: float, least: int) -> Deal:
        """For so many bytes of rows with about so many keys."""
        size = min(max(CHUNK_BYTES[0], text_bytes >> 14), CHUNK_BYTES[1])
        room = min(max(BUCKET_BYTES[0], int(keys * 8) >> 17), BUCKET_BYTES[1])
        return cls(max(1, -(-text_bytes // size)), max(1, least, int(keys * 8) // room))


def _segments(route: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by bucket, and where each bucket starts in it."""
    bucket = (route % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def packed(counts: np.ndarray) -> bytes:
    """A byte a count; those over 254 are 255 there and follow behind with their places."""
    many = np.flatnonzero(counts > 254)
    behind = np.stack([many, np.minimum(counts[many], (1 << 32) - 1)], 1).astype(np.uint32)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + behind.tobytes()


def unpacked(blob: bytes, n: int) -> np.ndarray:
    """``n`` packed counts."""
    out = np.frombuffer(blob, np.uint8, n).astype(np.uint32)
    behind = np.frombuffer(blob[n:], np.uint32).reshape(-1, 2)
    out[behind[:, 0]] = behind[:, 1]
    return out


def answered(rows: DataFrame, deal: Deal, hashes: Hashes, finish: Finish, schema: str) -> DataFrame:
    """``finish(rows of a chunk, keys, count of each key, context)`` for every chunk of ``rows`` (column ``chunk``).

    ``hashes`` gives a chunk's keys, a second hash that routes each, and a
    context for ``finish``; it sees the rows in an order set by their values.
    """
    buckets = deal.buckets

    def emit(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        key, route, _ = hashes(ordered(table))
        order, bound = _segments(route, buckets)
        out: dict[str, list] = {"bucket": [], "keys": [], "counts": []}
        for b in np.flatnonzero(np.diff(bound)):
            one, n = np.unique(key[order[bound[b] : bound[b + 1]]], return_counts=True)
            out["bucket"].append(int(b))
            out["keys"].append(one.tobytes())
            out["counts"].append(packed(n))
        kinds = {"bucket": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
        cols = [pa.array([chunk] * len(out["bucket"]), pa.int64()), *[pa.array(out[c], kinds[c]) for c in kinds]]
        return pa.Table.from_arrays(cols, ["chunk", *kinds])

    def tally(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
        keys = np.concatenate(blobs)
        counts = np.concatenate([unpacked(x.as_py(), k.size) for x, k in zip(table.column("counts"), blobs, strict=True)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.minimum(np.add.reduceat(counts[order].astype(np.int64), first), (1 << 32) - 1)
        answer = np.empty(keys.size, np.uint32)
        answer[order] = np.repeat(total, np.diff(np.append(first, keys.size)))
        ends = np.cumsum([x.size for x in blobs])
        parts = [packed(answer[e - x.size : e]) for e, x in zip(ends, blobs, strict=True)]
        return pa.Table.from_arrays(
            [table.column("chunk"), table.column("bucket"), pa.array(parts, pa.binary())], ["chunk", "bucket", "answer"]
        )

    def close(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = ordered(table)
        key, route, context = hashes(table)
        order, bound = _segments(route, buckets)
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("answer"), strict=True))
        count = np.zeros(key.size, np.uint32)
        for b in np.flatnonzero(np.diff(bound)):
            at = order[bound[b] : bound[b + 1]]
            one, inverse = np.unique(key[at], return_inverse=True)
            count[at] = unpacked(got[int(b)].as_py(), one.size)[inverse]
        return finish(table, key, count, context)

    asked = rows.groupBy("chunk").applyInArrow(emit, "chunk long, bucket int, keys binary, counts binary")
    answers = written(asked.groupBy("bucket").applyInArrow(tally, "chunk long, bucket int, answer binary"), "answers")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(close, schema)


def concatenated(parts: list[np.ndarray], kind: type = np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)

