"""Mixing sources to target weights, document by document (op13).

Sources by code point, null last, weigh 3, 1, 2 in turn and share ``SHARE``
times all words.  A target stops at ``MOST`` times its source's words; what is
over goes to the others by weight until none is above.  The common share a
weight is found in rounds: each adds up two whole numbers over the sources that
are not at their stop.

A source is taken whole as often as its target allows.  What is left, the
budget, is fitted by a subset sum: documents are counted by their exact length;
of each length the budget's share is taken, rounded down; single documents of
the longest lengths follow while over ``FIT`` words are missing; and a bounded
knapsack over the lengths that are left finds the sum nearest to what is still
missing.  Which documents of a length are taken is decided by a seeded hash.

One task fits one source, from one row a length; a source of n words has at
most sqrt(2 n) lengths.  Documents of a length are cut at the right place by
counts of hash ranges, small against all rows; only the range in which the cut
falls is sorted.

Edge cases: null and empty texts have no words and are not taken; documents
without source are a source; repeated rows count each, and equal hashes are
equal rows, of which any may be taken; a source without words has the target
0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from .base import spread, table, written

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), Fraction(3, 2), 2, 13
#: Words that the knapsack fits, unless a single document is longer; ranges of hashes over all rows.
FIT, RANGES = 1 << 16, 4096
WORD = r"[^\x20\x09-\x0D]+"
_WHOLE = "decimal(38,0)"


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size) with their weights and targets."""
    placed = numbered(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = written(placed.withColumn("weight", weight), "sources")
    size, one = F.col("source_size").cast(_WHOLE), F.lit(1).cast(_WHOLE)
    total = int(rows.agg(F.sum(size)).first()[0] or 0)
    share, free = Fraction(0), Fraction(0)  # words for each unit of weight
    while True:
        over = MOST * size * F.lit(share.denominator).cast(_WHOLE) < F.col("weight").cast(_WHOLE) * F.lit(share.numerator).cast(_WHOLE)
        stopped, weights = rows.agg(F.sum(F.when(over, size)), F.sum(F.when(~over, F.col("weight").cast(_WHOLE) * one))).first()
        free = SHARE * total - MOST * int(stopped or 0)
        now = free / int(weights) if weights else share
        if now <= share:
            break
        share = now
    exact = F.col("weight").cast("double") * share.numerator / share.denominator
    return rows.select("source", "source_size", F.when(over, F.col("source_size").cast("double") * MOST).otherwise(exact).alias("target"))


def _nearest(lengths: np.ndarray, left: np.ndarray, goal: float) -> dict[int, int]:
    """How many of each length to take so that their sum is nearest to ``goal``, the smaller sum of two: a bounded knapsack.

    Counts are cut into powers of two; for each sum it is kept which piece
    reached it first, so a sum is followed back through pieces that get fewer.
    """
    room = 2 * int(np.ceil(goal))  # a sum over the goal is of use only if it is as near as 0
    fits = (lengths > 0) & (lengths <= room) & (left > 0)
    pieces: list[tuple[int, int]] = []
    for size, n in sorted(zip(lengths[fits].tolist(), left[fits].tolist(), strict=True), reverse=True):
        n, p = min(n, room // size), 1
        while n:
            pieces.append((size, min(p, n)))
            n, p = n - min(p, n), 2 * p
    by = np.full(room + 1, -1, np.int64)
    by[0] = len(pieces)
    low, high = int(np.floor(goal)), int(np.ceil(goal))
    for k, (size, p) in enumerate(pieces):
        step = size * p
        if step > room:
            continue
        to = by[step:]
        to[(by[: room + 1 - step] >= 0) & (to < 0)] = k
        if by[low] >= 0 and (low == goal or by[high] >= 0):
            break
    sums = np.flatnonzero(by >= 0)
    at = int(sums[np.argmin(np.abs(sums - goal))])
    taken: dict[int, int] = {}
    while at:
        size, p = pieces[by[at]]
        taken[size] = taken.get(size, 0) + p
        at -= size * p
    return taken


def fitted(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """How often all documents are taken, and how many of each length are taken once more."""
    extra = np.zeros(len(lengths), np.int64)
    words = int((lengths.astype(object) * counts).sum()) if len(lengths) else 0
    if not words:
        return 0, extra
    budget = Fraction(target)
    whole = int(budget // words)
    budget -= whole * words
    extra[:] = [int(n * budget // words) if a else 0 for a, n in zip(lengths.tolist(), counts.tolist(), strict=True)]
    missing = budget - sum(int(a) * int(b) for a, b in zip(lengths.tolist(), extra.tolist(), strict=True))
    for k in np.argsort(-lengths, kind="stable").tolist():
        if missing <= FIT:
            break
        if lengths[k] <= missing and extra[k] < counts[k]:
            extra[k] += 1
            missing -= int(lengths[k])
    place = {n: k for k, n in enumerate(lengths.tolist())}
    for n, more in _nearest(lengths, counts - extra, float(missing)).items():
        extra[place[n]] += more
    return whole, extra


def _fit(group: pa.Table) -> pa.Table:
    """A source's lengths with what is taken of them."""
    group = group.sort_by("size")
    size, n = (group.column(c).to_numpy() for c in ("size", "n"))
    whole, extra = fitted(size, n, group.column("target")[0].as_py())
    out = group.select(["source", "size", "n", "source_size", "target"])
    return out.append_column("whole", pa.array(np.full(len(size), whole), pa.int64())).append_column("extra", pa.array(extra, pa.int64()))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = written(docs.select("doc_id", "source", size.alias("size"), draw.alias("_draw")), "sizes")
    counts = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    sized = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(sized)
    lengths = counts.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    plan = lengths.groupBy("source").applyInArrow(_fit, "source string, size long, n long, source_size long, target double, whole long, extra long")
    total = rows.count()
    flat = ["_named", "_source", "size"]  # keys without nulls
    named = lambda df: df.withColumns({"_named": F.col("source").isNotNull(), "_source": F.coalesce("source", F.lit(""))})
    pieces = F.ceil(F.col("n") * RANGES / max(1, total)).cast("long")
    plan = written(named(plan).drop("source").withColumn("_pieces", pieces), "plan")
    unit = F.shiftrightunsigned("_draw", 11) / float(1 << 53)
    placed = spread(named(rows).drop("source"), plan, flat, "n").withColumn("_piece", F.floor(unit * F.col("_pieces")))
    placed = written(placed, "placed")
    part = placed.where("extra > 0 and extra < n").groupBy(*flat, "_piece").agg(F.count("*").alias("_in"), F.first("extra").alias("_extra"))
    upto = Window.partitionBy(*flat).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_in").over(upto), F.lit(0))
    cut = part.withColumn("_before", before).where("_before < _extra and _before + _in > _extra").select(*flat, F.col("_piece").alias("_cut"), (F.col("_extra") - F.col("_before")).alias("_left"))
    last = part.withColumn("_before", before).where("_before + _in <= _extra").groupBy(*flat).agg(F.max("_piece").alias("_whole_to"))
    edges = plan.select(*flat, "n").join(last, flat, "left").join(cut, flat, "left").where("_whole_to is not null or _cut is not null")
    edges = written(edges, "edges")
    known = placed.where("extra > 0 and extra < n").drop("n")
    decided = spread(known, edges, flat, "n")
    inside = decided.where("_piece <=> _cut")
    nth = F.row_number().over(Window.partitionBy(*flat).orderBy("_draw"))
    more = inside.withColumn("_more", (nth <= F.col("_left")).cast("long"))
    rest = decided.where("not (_piece <=> _cut)").withColumn("_more", F.coalesce(F.col("_piece") <= F.col("_whole_to"), F.lit(False)).cast("long"))
    plain = placed.where("not (extra > 0 and extra < n)").withColumn("_more", (F.col("extra") > 0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", ((F.col("whole") + F.col("_more")) * F.col("size")).alias("taken")]
    return plain.select(*columns).unionByName(more.select(*columns)).unionByName(rest.select(*columns))


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
