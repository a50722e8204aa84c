"""Ordered choices: top k, quotas, representatives, deterministic draws and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from .ranges import numbered

Keys = Sequence[str]


def top(df: DataFrame, keys: Keys, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each stratum, and their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def deduplicated(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return top(df, keys, order, 1).drop("rank")


def representatives(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """Worst, median and best row of each group by one order; a row that is several keeps the first name."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"_n": F.row_number().over(w.orderBy(*order)) - 1, "_c": F.count("*").over(w)})
    role = F.when(F.col("_n") == 0, "worst").when(F.col("_n") == F.floor(F.col("_c") / 2), "median").when(F.col("_n") == F.col("_c") - 1, "best")
    return ranked.withColumn("role", role).where("role is not null").drop("_n", "_c")


def pareto(df: DataFrame, keys: Keys, low: str, high: str) -> DataFrame:
    """Rows that no row of the group beats on both: ``low`` the smaller, ``high`` the larger the better."""
    w = Window.partitionBy(*keys).orderBy(low, F.desc(high)).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(high).over(w)
    return df.where(F.col(low).isNotNull() & F.col(high).isNotNull()).withColumn("_b", best).where(F.col("_b").isNull() | (F.col(high) > F.col("_b"))).drop("_b")


def drawn(weights: dict[str, float], seed: int, *keys: str) -> Column:
    """A category by cumulative weight of a hash-uniform: the same for the same key on any cluster."""
    total, u = sum(weights.values()), uniform(seed, *keys)
    edges, upto = [], 0.0
    for name, w in weights.items():
        upto += w / total
        edges.append((upto, name))
    out = F.lit(edges[-1][1])
    for edge, name in reversed(edges[:-1]):
        out = F.when(u < edge, name).otherwise(out)
    return out


def stable_ids(df: DataFrame, order: Sequence[Column], pattern: str = "recording_%04d", out: str = "stable_id") -> DataFrame:
    """Numbered names in a natural order, whose ranges are numbered at the same time."""
    rows = numbered(df, order, "_number")
    return rows.withColumn(out, F.format_string(pattern, F.col("_number"))).drop("_number")


def stratified_split(df: DataFrame, key: str, strata: Sequence[tuple[str, Column, Sequence[Column], str]], fill: tuple[str, int], rest: str, seed: int) -> DataFrame:
    """Assign each row once: for each stratum in turn its top free row, then a seeded fill, the rest to ``rest``.

    ``strata``: (name, condition, order, split).  A stratum takes its first
    row that no earlier stratum took: as strata take one each, that is among
    its first len(strata) rows, so each stratum sends that many candidates and
    one small fold settles them.
    """
    n = len(strata)
    cands = None
    for i, (_, condition, order, _) in enumerate(strata):
        part = top(df.where(condition).withColumn("_s", F.lit(i)), ["_s"], order, n).select(key, "_s", "rank")
        cands = part if cands is None else cands.unionByName(part)
    taken: dict = {}
    for row in sorted(cands.collect(), key=lambda x: (x["_s"], x["rank"])):  # at most n * n rows
        if row["_s"] not in taken.values() and row[key] not in taken:
            taken[row[key]] = row["_s"]
    pick = F.lit(None).cast("string")
    for value, i in taken.items():
        pick = F.when(F.col(key) == F.lit(value), strata[i][3]).otherwise(pick)
    out = df.withColumn("split", pick)
    free = out.where("split is null").select(key, uniform(seed, key).alias("_u")).orderBy("_u", key).limit(fill[1]).select(key, F.lit(fill[0]).alias("_f"))
    return out.join(free, key, "left").withColumn("split", F.coalesce("split", "_f", F.lit(rest))).drop("_f")
