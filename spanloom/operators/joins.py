"""Joins by time: nearest, within a tolerance, inside a window; and joins that choose or compare.

Nearest neighbours come from two windows over the union of both sides, and
band joins from an equality on time cells, so neither becomes a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def nearest(left: DataFrame, right: DataFrame, keys: Keys, t: str = "t", tolerance: int | float | None = None) -> DataFrame:
    """``left`` with ``before`` and ``after``, the nearest right times at or before and after, ``lag`` (signed, the earlier on ties) and ``distance``."""
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(*keys, F.col(t), F.lit(0).alias("_side")), allowMissingColumns=True)
    mark = F.when(F.col("_side") == 0, F.col(t))
    upto = lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # "after" runs backwards: a frame that reaches to the end would be scanned anew from every row
    before = F.last(mark, ignorenulls=True).over(upto(F.asc(t), F.asc("_side")))
    after = F.last(mark, ignorenulls=True).over(upto(F.desc(t), F.desc("_side")))
    out = both.withColumns({"before": before, "after": after}).where("_side = 1").drop("_side")
    back, ahead = F.col(t) - F.col("before"), F.col("after") - F.col(t)
    lag = F.when(F.col("after").isNull() | (back <= ahead), -back).otherwise(ahead)
    out = out.withColumn("lag", lag).withColumn("distance", F.abs("lag"))
    if tolerance is not None:
        far = F.col("distance") > tolerance
        out = out.withColumns({"lag": F.when(~far, F.col("lag")), "distance": F.when(~far, F.col("distance"))})
    return out


def within(left: DataFrame, right: DataFrame, keys: Keys, tolerance: int | float, t: str = "t", strict: bool = False, absent: bool = False) -> DataFrame:
    """Left rows with a right time within the tolerance, or, if ``absent``, without one."""
    d = F.col("distance")
    hit = F.coalesce(d < tolerance if strict else d <= tolerance, F.lit(False))
    return nearest(left, right, keys, t).where(~hit if absent else hit).select(*left.columns)


def band(left: DataFrame, right: DataFrame, keys: Keys, before: int, after: int, t: str = "t", name: str = "other") -> DataFrame:
    """Pairs with left - before <= right <= left + after: each side is in cells as wide as the band, the left in up to two."""
    width = max(1, before + after)
    a = left.withColumn("_cell", F.explode(F.sequence(F.floor((F.col(t) - before) / width), F.floor((F.col(t) + after) / width))))
    b = right.withColumnRenamed(t, name).withColumn("_cell", F.floor(F.col(name) / width))
    return a.join(b, [*keys, "_cell"]).where((F.col(name) >= F.col(t) - before) & (F.col(name) <= F.col(t) + after)).drop("_cell")


def crowding(points: DataFrame, keys: Keys, reach: int, t: str = "t") -> DataFrame:
    """Adds how many other points of the key lie strictly within ``reach`` and not at the same time."""
    w = Window.partitionBy(*keys).orderBy(t)
    return points.withColumn("crowd", F.count("*").over(w.rangeBetween(-(reach - 1), reach - 1)) - F.count("*").over(w.rangeBetween(0, 0)))


def tags(windows: DataFrame, events: DataFrame, keys: Keys, width: int, kind: str, t: str = "t") -> DataFrame:
    """Sorted kinds of the events in each window [w0, w0 + width)."""
    a = windows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("w0") / width), F.floor((F.col("w0") + width - 1) / width))))
    b = events.select(*keys, t, kind, F.floor(F.col(t) / width).alias("_cell"))
    hit = a.join(b, [*keys, "_cell"]).where((F.col(t) >= F.col("w0")) & (F.col(t) < F.col("w0") + width))
    return hit.groupBy(*windows.columns).agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"), F.count("*").alias("n"))


def best_match(pairs: DataFrame, left: Keys, order: Sequence[Column]) -> DataFrame:
    """The first of each left row's candidates in an explicit order."""
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*left).orderBy(*order))).where("_n = 1").drop("_n")


def alike(candidates: DataFrame, kinds: dict[str, Column], name: str) -> DataFrame:
    """(kinds, name): the first name of the candidates that the named expressions, all that a rule looks at, can't tell apart."""
    return candidates.groupBy(*[c.alias(k) for k, c in kinds.items()]).agg(F.min(name).alias(name))


def deepest_prefix(records: DataFrame, candidates: DataFrame, keys: Keys, name: str, dirs: str = "dirs", least: int = 2, by: Keys = ()) -> DataFrame:
    """(keys, name, depth): the candidate, equal in ``by``, whose folders share the most leading segments with a record's, at least ``least``; the first name of equals.

    Candidates are collapsed to the first name under each prefix, so a record
    meets one row for each of its prefixes, however many candidates lie there.
    """

    def prefixes(df: DataFrame, *more: str) -> DataFrame:
        deep = df.where(F.size(dirs) >= least).select(*more, *by, dirs, F.explode(F.sequence(F.lit(least), F.size(dirs))).alias("depth"))
        return deep.select(*more, *by, "depth", F.slice(dirs, F.lit(1), F.col("depth")).alias("_p"))

    first = prefixes(candidates, name).groupBy(*by, "_p").agg(F.min(name).alias(name))
    met = prefixes(records, *[k for k in keys if k not in by]).join(first, [*by, "_p"])
    return met.groupBy(*keys).agg(F.max_by(F.struct("depth", name), "depth").alias("_m")).select(*keys, F.col(f"_m.{name}").alias(name), F.col("_m.depth").alias("depth"))


def _grams(text: str, sizes: Sequence[int]) -> Column:
    """Distinct substrings of some lengths."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, sizes)))


def containing(needles: DataFrame, texts: DataFrame, needle: str, text: str, size: int = 3) -> DataFrame:
    """Distinct pairs (needle, text) in which the text contains the needle; empty needles are left out.

    Every gram of a needle stands in a text that contains it, so a needle meets
    only the texts that hold its rarest gram (of ``size`` characters, or all of
    a shorter needle), and the pairs are then compared.
    """
    texts = texts.select(text).where(F.length(text) > 0).distinct().withColumn("_g", F.explode(_grams(text, range(1, size + 1))))
    often = texts.groupBy("_g").agg(F.count("*").alias("_n"))
    own = needles.select(needle).where(F.length(needle) > 0).distinct()
    parts = F.when(F.length(needle) < size, F.array(needle)).otherwise(_grams(needle, [size]))
    counted = own.withColumn("_g", F.explode(parts)).join(often, "_g", "left")
    rarest = counted.groupBy(needle).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_m")).where("_m.n > 0")
    return rarest.select(needle, F.col("_m._g").alias("_g")).join(texts, "_g").where(F.contains(text, F.col(needle))).select(needle, text)


def scored_prefix_match(records: DataFrame, candidates: DataFrame, key: str, name: str, dirs: str = "dirs", word: str = "family", stem: str = "stem", least: int = 2, letters: int = 2) -> DataFrame:
    """(key, name, depth, rule): each record's best candidate, by shared leading folders, then rule, then name.

    Rule 2: at least ``least`` folders are shared.  Rule 1: fewer are, but the
    record's ``word`` (of ``letters`` at least) lies in the candidate's ``stem``
    or last folder, or the stem in the word; an empty stem lies in any word.
    Records without a candidate are left out.  Only records that rule 2 leaves
    are matched by name, as distinct (word, leading folders) against distinct
    (names, leading folders).
    """
    near = deepest_prefix(records, candidates, [key], name, dirs, least).withColumn("rule", F.lit(2))
    rest = records.where(F.length(word) >= letters).join(near.select(key), key, "left_anti").select(key, F.slice(dirs, 1, least - 1).alias("_to"), word)
    folder = F.coalesce(F.try_element_at(dirs, F.lit(-1)), F.lit(""))
    sites = candidates.groupBy(F.slice(dirs, 1, least - 1).alias("_to"), F.coalesce(stem, F.lit("")).alias("_stem"), folder.alias("_folder")).agg(F.min(name).alias(name))
    words, ask = rest.select(word).distinct(), rest.select("_to", word).distinct()
    by_stem, by_folder = (containing(words, sites, word, c).join(sites, c) for c in ("_stem", "_folder"))
    inside = containing(sites, words, "_stem", word).join(sites, "_stem")
    pairs = by_stem.unionByName(by_folder, allowMissingColumns=True).unionByName(inside, allowMissingColumns=True).groupBy(word, "_to").agg(F.min(name).alias(name))
    called = deepest_prefix(ask, pairs, ["_to", word], name, "_to", 0, [word])
    unnamed = deepest_prefix(ask, sites.where("_stem = ''"), ["_to", word], name, "_to", 0)
    best = called.unionByName(unnamed).groupBy("_to", word).agg(F.min(F.struct((-F.col("depth")).alias("d"), name)).alias("_m"))
    named = rest.join(best, ["_to", word]).select(key, F.col(f"_m.{name}").alias(name), (-F.col("_m.d")).alias("depth"), F.lit(1).alias("rule"))
    return near.unionByName(named)


def first_of(right: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in order: a lookup side whose matches are unique."""
    return best_match(right, keys, order)


def catalog_diff(a: DataFrame, b: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """key and status: missing, extra, size, hash or same."""
    x = a.select(key, F.col(size).alias("_sa"), F.col(digest).alias("_ha"), F.lit(True).alias("_a"))
    y = b.select(key, F.col(size).alias("_sb"), F.col(digest).alias("_hb"), F.lit(True).alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "missing")
        .when(F.col("_a").isNull(), "extra")
        .when(~F.col("_sa").eqNullSafe(F.col("_sb")), "size")
        .when(~F.col("_ha").eqNullSafe(F.col("_hb")), "hash")
        .otherwise("same")
    )
    return x.join(y, key, "full_outer").select(key, status.alias("status"))


def grid(spark, **axes: Sequence) -> DataFrame:
    """All combinations of short parameter lists, exploded from one row of literals."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def complete(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Rows of either side without a partner: a positional join is sound if there are none."""
    a = left.join(right, list(keys), "left_anti").select(*keys, F.lit("left").alias("side"))
    return a.unionByName(right.join(left, list(keys), "left_anti").select(*keys, F.lit("right").alias("side")))


def siblings(df: DataFrame, family: Keys, key: str, near: int) -> DataFrame:
    """(key, siblings, n): up to ``near`` members of a row's family on either side of it in order of ``key``, and how many there are in all.

    A window of bounded width in one sort a family; no pair of members is made.
    """
    order, whole = Window.partitionBy(*family).orderBy(key), Window.partitionBy(*family)
    around = F.array_sort(F.concat(F.collect_list(key).over(order.rowsBetween(-near, -1)), F.collect_list(key).over(order.rowsBetween(1, near))))
    return df.select(*family, key).distinct().select(key, around.alias("siblings"), (F.count("*").over(whole) - 1).alias("n"))
