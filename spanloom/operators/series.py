"""Operators on series (keys, i, v): windows keyed by the series; :mod:`ranges` has those for one series that no task should sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def _order(keys: Keys, i: str = "i"):
    return Window.partitionBy(*keys).orderBy(i)


def moving_average(df: DataFrame, keys: Keys, k: int, v: str = "v", out: str = "smooth") -> DataFrame:
    """Centred mean of odd width ``k`` with zeros beyond the ends: the divisor is always k."""
    h = (k - 1) // 2
    return df.withColumn(out, F.sum(v).over(_order(keys).rowsBetween(-h, h)) / k)


def novelty(df: DataFrame, keys: Keys, lag: int, v: str = "smooth", out: str = "rise") -> DataFrame:
    """Positive change over ``lag`` rows, 0 for the first ones."""
    return df.withColumn(out, F.coalesce(F.greatest(F.col(v) - F.lag(v, lag).over(_order(keys)), F.lit(0.0)), F.lit(0.0)))


def fused(df: DataFrame, keys: Keys, channel: str, weights: dict[str, float], v: str = "rise", point: float = 0.995, cap: float = 2.5) -> DataFrame:
    """Weighted sum over channels of each channel's values, scaled by its high percentile in the series and capped."""
    scale = df.groupBy(*keys, channel).agg(F.percentile(v, point).alias("_p"))
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col(channel) == name, F.lit(w)).otherwise(weight)
    part = weight * F.least(F.col(v) / (F.col("_p") + 1e-9), F.lit(cap))
    return df.join(scale, [*keys, channel]).groupBy(*keys, "i").agg(F.sum(part).alias("score"))


def local_threshold(df: DataFrame, keys: Keys, half: int, over: float, least: float, v: str = "v") -> DataFrame:
    """Adds ``above``: v over its centred mean by ``over`` and over ``least``; ends are repeated to fill the mean's window."""
    order = _order(keys)
    whole = Window.partitionBy(*keys)
    place, n = F.row_number().over(order), F.count("*").over(whole)
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(v).over(full), F.last(v).over(full)
    left, right = F.greatest(half + 1 - place, F.lit(0)), F.greatest(place + half - n, F.lit(0))
    mean = (F.sum(v).over(order.rowsBetween(-half, half)) + left * first + right * last) / (2 * half + 1)
    return df.withColumn("local_mean", mean).withColumn("above", (F.col(v) > F.col("local_mean") + over) & (F.col(v) > least))


def sessions(df: DataFrame, keys: Keys, gap: int | float, t: str = "t", tie: Sequence[str] = ()) -> DataFrame:
    """Adds ``session`` and ``first``: a row starts one if the previous row, kept or not, is more than ``gap`` earlier."""
    order = Window.partitionBy(*keys).orderBy(t, *tie)
    new = F.coalesce(F.col(t) - F.lag(t).over(order) > gap, F.lit(True))
    return df.withColumn("first", new).withColumn("session", F.sum(F.col("first").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def runs(df: DataFrame, keys: Keys, flag: Column, i: str = "i") -> DataFrame:
    """Runs of consecutive rows for which ``flag`` holds: first and last index, length."""
    held = df.withColumn("_n", F.row_number().over(_order(keys, i))).where(flag)
    held = held.withColumn("_g", F.col("_n") - F.row_number().over(_order(keys, i)))
    return held.groupBy(*keys, "_g").agg(F.min(i).alias("s"), F.max(i).alias("e"), F.count("*").alias("n")).drop("_g")


def joined_runs(spans: DataFrame, keys: Keys, gap: int | float, least: int | float) -> DataFrame:
    """Spans at most ``gap`` apart joined; those of at least ``least`` kept."""
    from .intervals import merged

    return merged(spans, keys, gap).where(F.col("e") - F.col("s") >= least)


def local_maxima(df: DataFrame, keys: Keys, v: str = "v", i: str = "i") -> DataFrame:
    """Strict local maxima; of a flat top the middle (left of two); the ends never count."""
    order = _order(keys, i)
    new = F.coalesce(F.col(v) != F.lag(v).over(order), F.lit(True)).cast("int")
    flat = df.withColumn("_new", new).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    tops = flat.groupBy(*keys, "_g").agg(F.min(i).alias("_a"), F.max(i).alias("_b"), F.first(v).alias(v))
    by = Window.partitionBy(*keys).orderBy("_g")
    tops = tops.withColumns({"_l": F.lag(v).over(by), "_r": F.lead(v).over(by)})
    return tops.where((F.col("_l") < F.col(v)) & (F.col("_r") < F.col(v))).select(*keys, F.floor((F.col("_a") + F.col("_b")) / 2).alias(i), v)


def prominence(df: DataFrame, keys: Keys, valley: int, v: str = "v") -> DataFrame:
    """Height over the higher of the lowest values within ``valley`` rows on either side."""
    order = _order(keys)
    left, right = F.min(v).over(order.rowsBetween(-valley, 0)), F.min(v).over(order.rowsBetween(0, valley))
    return df.withColumn("prominence", F.col(v) - F.greatest(left, right))


def around(df: DataFrame, keys: Keys, half: int, v: str = "v") -> DataFrame:
    """Largest value within ``half`` rows."""
    return df.withColumn("peak", F.max(v).over(_order(keys).rowsBetween(-half, half)))


def echo(df: DataFrame, keys: Keys, back: int, v: str = "v") -> DataFrame:
    """Largest earlier value within ``back`` rows, how far back it is (the first of equals), and its ratio to the value."""
    order = _order(keys).rowsBetween(-back, -1)
    far = F.max(F.struct(v, (-F.col("i")).alias("n"))).over(order)
    out = df.withColumn("_m", far)
    return out.withColumns({"trail": F.col(f"_m.{v}"), "back": F.col("i") + F.col("_m.n"), "echo": F.col(f"_m.{v}") / F.greatest(F.col(v), F.lit(1e-9))}).drop("_m")


def frame_levels(df: DataFrame, keys: Keys, n: int, v: str = "v") -> DataFrame:
    """Root mean square of blocks of ``n`` rows; a block that is not full is dropped."""
    return (
        df.groupBy(*keys, F.floor(F.col("i") / n).alias("frame")).agg(F.sqrt(F.avg(F.col(v) * F.col(v))).alias("rms"), F.count("*").alias("_n")).where(F.col("_n") == n).drop("_n")
    )


def overlapping_levels(df: DataFrame, keys: Keys, width: int, step: int, v: str = "v") -> DataFrame:
    """Root mean square of ``width`` rows from every ``step``-th one, as far as they are full."""
    order = _order(keys).rowsBetween(0, width - 1)
    full = df.withColumns({"rms": F.sqrt(F.avg(F.col(v) * F.col(v)).over(order)), "_n": F.count("*").over(order)})
    return full.where((F.col("_n") == width) & (F.col("i") % step == 0)).select(*keys, "i", "rms")


def sliding(df: DataFrame, keys: Keys, width: int, step: int, t: str = "t") -> DataFrame:
    """A row for each window [w0, w0 + width), w0 a multiple of ``step``, that a row falls in."""
    last = F.floor(F.col(t) / step)
    return df.withColumn("w0", F.explode(F.transform(F.sequence(F.floor((F.col(t) - width) / step) + 1, last), lambda n: n * step)))


def best_window(mask: DataFrame, keys: Keys, width: int, step: int, v: str = "m") -> DataFrame:
    """Start of the window of ``width`` rows, at multiples of ``step``, with the most coverage; the first of equals."""
    order = _order(keys).rowsBetween(0, width - 1)
    full = mask.withColumns({"cover": F.avg(v).over(order), "_n": F.count("*").over(order)}).where((F.col("_n") == width) & (F.col("i") % step == 0))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cover"), "i"))
    return full.withColumn("_k", nth).where("_k = 1").select(*keys, "i", "cover")


def locked_average(df: DataFrame, events: DataFrame, keys: Keys, half: int, v: str = "v") -> DataFrame:
    """Mean of the series at each offset within ``half`` rows of the events that lie that far from both ends.

    Each distinct event asks for its 2 ``half`` + 1 rows by their index, so the
    work follows the events, not the rows of the series.
    """
    marks = events.groupBy(*keys, "i").agg(F.count("*").alias("_e"))
    asked = marks.select(*keys, "_e", F.col("i").alias("_at"), F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("offset")).withColumn("i", F.col("_at") + F.col("offset"))
    found = asked.join(df.select(*keys, "i", F.col(v).alias("v")), [*keys, "i"]).groupBy(*keys, "_at", "_e").agg(F.collect_list(F.struct("offset", "v")).alias("_w"))
    each = found.where(F.size("_w") == 2 * half + 1).select("_e", F.explode("_w").alias("w")).select("w.offset", "_e", "w.v")
    return each.groupBy("offset").agg((F.sum(F.col("v") * F.col("_e")) / F.sum("_e")).alias("mean"), F.sum("_e").alias("n"))


def lag_scan(df: DataFrame, keys: Keys, a: str, b: str, most: int, block: int = 1 << 14) -> DataFrame:
    """Lag of b, within ``most`` rows, with the largest sum of products; the first lag of equals."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("dot"), "lag"))
    return lag_sums(df, keys, a, b, most, block).withColumn("_k", nth).where("_k = 1").drop("_k")


def lag_sums(df: DataFrame, keys: Keys, a: str, b: str, most: int, block: int = 1 << 14) -> DataFrame:
    """(keys, lag, dot, n): sum of products of a and what b has ``lag`` rows later, and how many there are, for every lag within ``most`` rows.

    Rows lie in blocks of their index, with ``a`` of the ``most`` rows on either
    side as well; a block gives one array of 2 ``most`` + 1 partial sums, and the
    arrays are added up.  What is shuffled is the rows once and an array a block.
    """
    block = max(block, 4 * most)
    kinds = dict(df.dtypes)
    whole = all(kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in (a, b))
    kind, dtype = ("bigint", np.int64) if whole else ("double", np.float64)
    cells = F.sequence(F.floor((F.col("i") - most) / block), F.floor((F.col("i") + most) / block))
    rows = df.select(*keys, "i", F.col(a).cast(kind).alias("_a"), F.col(b).cast(kind).alias("_b"), F.explode(cells).alias("_block"))
    blocks = rows.groupBy(*keys, "_block").agg(F.collect_list(F.struct("i", F.col("_a").isNotNull().alias("x"), F.coalesce("_a", F.lit(0)).alias("_a"), F.col("_b").isNotNull().alias("y"), F.coalesce("_b", F.lit(0)).alias("_b"))).alias("_s"))
    blocks = blocks.select(*keys, "_block", *[F.col(f"_s.{c}").alias(c) for c in ("i", "x", "_a", "y", "_b")])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dots, counts = [], []
            for at, i, x, va, y, vb in zip(pdf["_block"], *(pdf[c] for c in ("i", "x", "_a", "y", "_b")), strict=True):
                place = np.asarray(i, np.int64) - (at * block - most)
                dense = np.zeros((4, block + 2 * most), dtype)
                for line, values in zip(dense, (va, x, vb, y), strict=True):
                    line[place] = np.asarray(values, dtype)
                own = dense[2:, most : most + block]
                parts = [dense[:2, most - lag : most - lag + block] for lag in range(-most, most + 1)]
                dots.append([p[0] @ own[0] for p in parts])
                counts.append([int(p[1] @ own[1]) for p in parts])
            yield pdf[list(keys)].assign(_dot=dots, _n=counts)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"_dot array<{kind}>", "_n array<bigint>"])
    each = blocks.mapInPandas(sums, schema).select(*keys, F.posexplode(F.arrays_zip("_dot", "_n")).alias("_l", "_p"))
    return each.groupBy(*keys, (F.col("_l") - most).alias("lag")).agg(F.sum("_p._dot").alias("dot"), F.sum("_p._n").alias("n")).where("n > 0")


def vote(peaks: DataFrame, keys: Keys, channel: str, reach: int, least: int, gap: int) -> DataFrame:
    """Frames that ``least`` channels vote for, each peak for those within ``reach``; runs with holes of at most ``gap`` as one, from its first frame."""
    votes = peaks.select(*keys, channel, F.explode(F.sequence(F.col("i") - reach, F.col("i") + reach)).alias("i"))
    won = votes.groupBy(*keys, "i").agg(F.count_distinct(channel).alias("votes")).where(F.col("votes") >= least)
    grouped = sessions(won, keys, gap, "i")
    return grouped.groupBy(*keys, "session").agg(F.min("i").alias("i"), F.max("i").alias("last"), F.max("votes").alias("votes")).drop("session")


def histogram(df: DataFrame, keys: Keys, width: int, t: str = "t") -> DataFrame:
    """Rows in each cell of ``width`` between a key's first and last, empty cells as 0."""
    counts = df.groupBy(*keys, F.floor(F.col(t) / width).alias("cell")).agg(F.count("*").alias("n"))
    frame = counts.groupBy(*keys).agg(F.explode(F.sequence(F.min("cell"), F.max("cell"))).alias("cell"))
    return frame.join(counts, [*keys, "cell"], "left").fillna(0, ["n"])


def interpolated(points: DataFrame, grid: DataFrame, keys: Keys, t: str = "t", v: str = "v") -> DataFrame:
    """Values on the grid by straight lines between the points around; the end value beyond the ends.

    Each point carries the next one, so one running window finds both; a frame
    that reaches to the end would be scanned anew from every row.
    """
    own = F.struct(F.col(t).alias("t"), F.col(v).alias("v"))
    marks = points.select(*keys, t, own.alias("_a"), F.lead(own).over(_order(keys, t)).alias("_b"), F.lit(0).alias("_side"))
    first = points.groupBy(*keys).agg(F.min_by(own, t).alias("_b")).withColumns({t: F.lit(None).cast(points.schema[t].dataType), "_a": F.lit(None).cast(marks.schema["_a"].dataType), "_side": F.lit(0)})
    near = F.when(F.col("_side") == 0, F.struct("_a", "_b"))
    both = marks.unionByName(first).withColumn("_p", near).drop("_a", "_b").unionByName(grid.select(*keys, t, F.lit(1).alias("_side")), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(t), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_p", F.last("_p", ignorenulls=True).over(order)).where("_side = 1")
    p, q = F.col("_p._a"), F.col("_p._b")
    value = F.when(p.isNull(), q["v"]).when(q.isNull() | (q["t"] == p["t"]), p["v"])
    return out.select(*keys, t, value.otherwise(p["v"] + (F.col(t) - p["t"]) / (q["t"] - p["t"]) * (q["v"] - p["v"])).alias(v))
