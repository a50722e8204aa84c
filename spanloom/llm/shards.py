"""Shards of near equal bytes by sampled splitters (op10, DataFrame functions only).

Records are ordered by (hash of the text, doc_id), so equal texts lie together.

1. Each record draws itself into the sample with a probability proportional to
   its size; the draw is a hash of its key, so it is the same in every run.
2. Quantiles of the sample are the splitters of R ranges, R at most
   ``MAX_RANGES``.  Hot texts, whose copies exceed ``TOGETHER`` of a shard, are
   known from exact sums (fewer than shards / ``TOGETHER`` of them); any other
   splitter moves to the start of its text, so that only hot texts are cut.
3. Exact bytes of each range are counted; a range of over twice its share is
   sampled again by itself and subdivided, which splits a hot text by doc_id,
   until none is left that can be split (rows that repeat doc_id and text, or one
   row of that size, can't; what remains after ``ROUNDS`` is warned of, and
   costs one task a longer sort, not the result).
4. A record's place in bytes is its range's offset plus the running sum inside
   the range; the shard is that place in sixteenths of the total.  Texts that are
   not hot go where their first copy goes, all of them.

The driver sees splitters, one row of sums a range and about ``DRAWS`` sampled keys
a range: ``MAX_RANGES`` at first, and as many again for each round at most; and the hashes of hot texts.  Ranges are sorted side by side, never a shard as a whole.

Edge cases: a null text has no bytes, so size 1; a row without doc_id orders
first; repeated rows take neighbouring slots in any order; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import warnings
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import table, written

SHARDS = 16
#: Ranges, about so many bytes each, and sampled keys for each.
RANGE_BYTES, MAX_RANGES, DRAWS = 4 << 20, 4096, 64
#: Copies of a text stay together up to this part of a shard's bytes.
TOGETHER = 1 / 64
_LEAF = 64
#: The key of a row without doc_id, which is the start of its text.
_FIRST = -(1 << 63)
#: Rounds of subdividing.
ROUNDS = 8

Key = tuple[int, int]


def _below(key: Column, splitters: list[Key]) -> Column:
    """How many splitters are at most ``key``: two short scans of sorted literals."""
    if not splitters:
        return F.lit(0)

    def literal(keys: list[Key]) -> Column:
        return F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.lit(d).cast("long").alias("d")) for h, d in keys])

    def count(keys: Column) -> Column:
        return F.aggregate(keys, F.lit(0), lambda n, x: n + (x <= key).cast("int"))

    leaves = [splitters[i : i + _LEAF] for i in range(0, len(splitters), _LEAF)]
    if len(leaves) == 1:
        return count(literal(leaves[0]))
    leaf = F.greatest(count(literal([x[0] for x in leaves])) - 1, F.lit(0))
    return leaf * _LEAF + count(F.element_at(F.array(*[literal(x) for x in leaves]), leaf + 1))


def _drawn(rows: DataFrame, share: Column, seed: int) -> list[Key]:
    """Keys whose draw falls below their size's share; the expected number is set by the caller."""
    draw = F.pmod(F.xxhash64("h", "d", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return [tuple(r["key"]) for r in rows.where(draw < share).select("key").collect()]


def _quantiles(keys: list[Key], pieces: int, hot: set[int]) -> list[Key]:
    """Splitters between equal parts of the sample; inside a text only where it is hot."""
    keys = sorted(keys)
    found = [keys[len(keys) * i // pieces] for i in range(1, pieces)] if keys else []
    return sorted({(h, d if h in hot else _FIRST) for h, d in found})


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every record."""
    text = F.coalesce("text", F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "keys",
    )
    rows = rows.withColumn("d", F.coalesce("doc_id", F.lit(_FIRST))).withColumn("key", F.struct("h", "d"))
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    pieces = min(MAX_RANGES, max(4 * shards, -(-total // RANGE_BYTES)))
    share, limit = total / pieces, total / shards * TOGETHER
    heavy = rows.groupBy("h").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") > F.lit(limit)) & (F.col("n") > 1))
    hot = {r["h"] for r in heavy.select("h").collect()}
    splitters = _quantiles(_drawn(rows, F.col("size") * F.lit(DRAWS / share), 1), pieces, hot)
    for seed in range(2, ROUNDS + 3):
        placed = rows.withColumn("range", _below(F.col("key"), splitters))
        sums = {r["range"]: (r["b"], r["n"]) for r in placed.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
        over = {k: int(b / share) + 1 for k, (b, n) in sums.items() if b > max(2 * share, share + limit) and n > 1}
        if not over or seed == ROUNDS + 2:
            break
        fresh: dict[int, list[Key]] = {k: [] for k in over}
        for key in _drawn(placed.where(F.col("range").isin(list(over))), F.col("size") * F.lit(DRAWS / share), seed):
            fresh[bisect_right(splitters, key)].append(key)
        more = {x for k, keys in fresh.items() for x in _quantiles(keys, over[k], hot)}
        if more <= set(splitters):
            break
        splitters = sorted(more | set(splitters))
    if over:
        warnings.warn(f"{len(over)} of {len(sums)} ranges hold over twice their share of bytes and can't be split", stacklevel=2)
    names = sorted(sums)
    offset = dict(zip(names, accumulate([0] + [sums[k][0] for k in names])))
    ranks = dict(zip(names, accumulate([0] + [sums[k][1] for k in names])))
    cells = [F.struct(F.lit(k).alias("range"), F.lit(offset[k]).cast("long").alias("offset"), F.lit(ranks[k]).cast("long").alias("ranked")) for k in names]
    base = docs.sparkSession.range(1).select(F.inline(F.array(*cells)))
    order = Window.partitionBy("range").orderBy("h", "size", "text_crc32", "d")
    alike = Window.partitionBy("range", "h", "size", "text_crc32")
    spot = (
        placed.withColumn("place", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("nth", F.row_number().over(order))
        .withColumns({"lead": F.min("place").over(alike), "copies": F.sum("size").over(alike)})
        .join(F.broadcast(base), "range")
        .withColumn("at", F.col("offset") + F.when(F.col("copies") <= F.lit(limit), F.col("lead")).otherwise(F.col("place")))
    )
    spot = written(
        spot.select(
            "doc_id", "size", "text_crc32",
            F.least(F.floor(F.col("at") * F.lit(shards) / F.lit(total)).cast("int"), F.lit(shards - 1)).alias("shard"),
            (F.col("ranked") + F.col("nth") - 1).alias("rank"),
        ),
        "shards",
    )
    first = {r["shard"]: r["a"] for r in spot.groupBy("shard").agg(F.min("rank").alias("a")).collect()}
    starts = F.create_map(*[x for k, a in first.items() for x in (F.lit(k), F.lit(a).cast("long"))])
    return spot.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - starts[F.col("shard")]).alias("slot"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
