"""Product-quantised codes of vectors, exactly in integers (op12).

Components become floor(4096 * x), vectors are cut into 8 parts, and each part
position has a codebook of 16 entries that starts from the vectors of the
smallest ids and is moved by six rounds of assigning and averaging.

The nearest entry is found by partial distances.  Dimensions of a part go by
descending variance of the codebook, so that distances tell early; entries are
tried one after the other, and a mask over a block of vectors drops an entry as
soon as its distance so far strictly exceeds the vector's best complete one.
An entry that reaches the end with an equal distance loses to the lower index,
so nothing depends on the order of the search.

A task adds up the members of each entry over its rows and sends 16 rows a
component, whatever it has read; the codebooks, 16 vectors, are all that the
driver holds.  Vectors are read anew in each round and never shuffled.

Edge cases: a vector that is null or holds null or non-finite components is
dropped; shorter vectors, and lengths that are not a multiple of 8, are filled
with zeros at the end to the longest length; with fewer than 16 vectors the
codebooks have as many entries; rows without vec_id start no codebook before
the others have; of equal ids the smaller vector comes first; repeated rows
count each; integers over 63 bits are Python's, and an error that a long can't
hold is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import spread, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors searched together.
BLOCK = 4096


def _most(width: int) -> float:
    """Components under this have squared distances under 2**62, and sums over a block too."""
    return min(1 << 28, (1 << 30) / max(1, width) ** 0.5)


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of a list column, a row a vector of ``width`` components; Python's integers where 63 bits don't hold their distances."""
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    sizes = np.diff(vectors.offsets.to_numpy())
    big = bool(flat.size) and np.abs(flat).max() * SCALE >= _most(width)
    if big:
        out = np.full((len(vectors), width), 0, object)
        values = [(n * SCALE) // d for n, d in map(float.as_integer_ratio, flat.tolist())]
    else:
        out, values = np.zeros((len(vectors), width), np.int64), np.floor(flat * SCALE).astype(np.int64)
    if flat.size:
        out[np.repeat(np.arange(len(vectors)), sizes), np.concatenate([np.arange(n) for n in sizes])] = values
    return out


def _dimension_order(book: np.ndarray) -> list[int]:
    """Dimensions by descending variance over the entries, in whole numbers; equal ones as they come."""
    variance = [len(book) * sum(x * x for x in column) - sum(column) ** 2 for column in book.T.tolist()]
    return sorted(range(len(variance)), key=lambda d: -variance[d])


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row by partial distances, the lower index of equals, and its squared distance."""
    order = _dimension_order(book)
    guess = np.zeros(len(rows), np.int64)
    if order and len(book) > 1:  # what is nearest in the first dimension is tried first, so that little stays in the search
        line = np.argsort(book[:, order[0]], kind="stable")
        sorted_at = book[line, order[0]]
        guess = line[np.searchsorted((sorted_at[1:] + sorted_at[:-1]) // 2, rows[:, order[0]])]
    at = guess.copy()
    gap = rows - book[guess]
    best = (gap * gap).sum(1) if order else np.zeros(len(rows), rows.dtype)
    for entry in range(len(book)):
        alive = np.flatnonzero(guess != entry)
        so_far = np.zeros(alive.size, rows.dtype)
        for d in order:
            gap = rows[alive, d] - book[entry, d]
            so_far = so_far + gap * gap
            kept = so_far <= best[alive]  # an equal one may still win by its index
            alive, so_far = alive[kept], so_far[kept]
            if not alive.size:
                break
        better = (so_far < best[alive]) | (entry < at[alive])
        at[alive[better]], best[alive[better]] = entry, so_far[better]
    return at, best


def searched(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of rows and their squared distances, a column a part."""
    step = books.shape[2]
    found = [
        [nearest(rows[lo : lo + BLOCK, p * step : (p + 1) * step], books[p]) for p in range(PARTS)] for lo in range(0, len(rows), BLOCK)
    ]
    return tuple(np.concatenate([np.stack([f[k] for f in block], 1) for block in found]) for k in (0, 1))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            yield part, integers(pa.concat_arrays([part.column(0)]), width)


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there, and whose components are all finite numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return df.where(F.col(vector).isNotNull() & ~F.exists(vector, odd))


def _start(rows: DataFrame, width: int) -> np.ndarray:
    """Codebooks of the vectors of the smallest ids: a list of parts of entries."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    whole = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), width)
    return np.stack(np.split(whole, PARTS, axis=1))


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the floor of the mean of its parts; entries without any stay."""
    width, step = books.shape[0] * books.shape[2], books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((books.shape[1], width), object), np.zeros((books.shape[1], PARTS), np.int64)
        for _, block in _blocks(batches, width):
            at, _ = searched(block, books)
            for p in range(PARTS):
                for e in np.unique(at[:, p]):
                    mine = block[at[:, p] == e, p * step : (p + 1) * step]
                    total[e, p * step : (p + 1) * step] += mine.sum(0).astype(object)
                    count[e, p] += len(mine)
        e, c = (x.ravel() for x in np.indices(total.shape))
        n = count[e, c // step] if step else count[:0, 0]
        held = n > 0
        cols = [pa.array(e[held], pa.int32()), pa.array(c[held], pa.int32()), pa.array(n[held], pa.int64())]
        cols.append(pa.array([Decimal(int(x)) for x in total[e[held], c[held]]], pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays(cols, ["entry", "component", "n", "total"])

    parts = rows.select("embedding").mapInArrow(sums, "entry int, component int, n long, total decimal(38,0)")
    out = books.copy()
    for r in parts.groupBy("entry", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # 16 rows a component at most
        value = int(r["total"]) // r["n"]
        if out.dtype != object and abs(value) >= _most(width):
            out = out.astype(object)
        out[r["component"] // step, r["entry"], r["component"] % step] = value
    return out


def trained(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place in the part) of usable rows."""
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    books = _start(rows, -(-longest // PARTS) * PARTS)
    for _ in range(rounds if books.shape[1] else 0):
        books = _moved(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of usable rows."""
    width = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _blocks(batches, width):
            at, gap = searched(block, books)
            code = ["".join(map("{:02x}".format, row)) for row in at.tolist()]
            error = [x if x < 1 << 63 else None for x in map(int, gap.sum(1))]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(code), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("embedding", "vec_id", "label").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(df: DataFrame) -> DataFrame:
    """Codes of ``df`` (vec_id, embedding, label), their errors, the errors of their labels and the digest of the codebooks."""
    rows = usable(df).select("vec_id", "embedding", "label")
    books = trained(rows)
    out = written(encoded(rows, books) if books.shape[1] else encoded(rows.limit(0), books), "codes")
    keyed = out.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0).cast(dict(out.dtypes)["label"]))})
    sums = keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    both = spread(keyed, sums, ["_none", "_label"], "_n")
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds as tables that follow one another."""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, label, [floor(x::DOUBLE * 4096)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "w AS MATERIALIZED (SELECT vec_id, label, part, list_slice(q, 1 + part * len(q) // 8, (part + 1) * len(q) // 8) AS q FROM v, range(8) t(part))",
        "b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, q FROM w QUALIFY entry < 16)",
    ]
    for k in range(7):
        steps.append(
            f"""d{k} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := d, e := entry)) AS m FROM (SELECT w.vec_id, w.part, b.entry,
  list_sum(list_transform(list_zip(w.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM w JOIN b{k} b USING (part)) GROUP BY 1, 2)"""
        )
        if k < 6:
            steps.append(
                f"""s{k} AS MATERIALIZED (SELECT part, entry, place, ((s - ((s % n) + n) % n) / n)::BIGINT AS x FROM (SELECT part, m.e AS entry, place,
  sum(q[place])::BIGINT AS s, count(*) AS n FROM d{k} JOIN w USING (vec_id, part), range(1, len(q) + 1) t(place) GROUP BY ALL))"""
            )
            steps.append(
                f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.q, b{k}.q) AS q FROM b{k} LEFT JOIN "
                f"(SELECT part, entry, list(x ORDER BY place) AS q FROM s{k} GROUP BY ALL) n USING (part, entry))"
            )
    steps.append("c AS (SELECT vec_id, string_agg(lpad(to_hex(m.e), 2, '0'), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM d6 GROUP BY 1)")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 "
        "FROM c JOIN v USING (vec_id), h"
    )


SQL = _sql()
