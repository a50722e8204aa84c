"""Waveforms as rows (keys, i, values): filters, delays, warps, envelopes and comparisons without arrays of whole series.

Filters and warps are windows of bounded reach over blocks of rows that hold
their neighbours' edges (:func:`ranges.around`), delays are sums of products by
lag over the same kind of blocks, and comparisons are groups.  A series may be
longer than any array; what a task holds is a block.

Series are dense (every index from 0 to its end once) and without nulls, unless a
function says otherwise; empty tables give empty results, and other columns pass
through filters and are left out elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import kernels, ranges, series
from . import spectra as sp

Keys = Sequence[str]


def smoothing(n: int) -> list[float]:
    """Hann weights of ``n`` samples that add up to 1."""
    w = [0.5 - 0.5 * math.cos(2 * math.pi * (k + 1) / (n + 1)) for k in range(n)]
    return [x / sum(w) for x in w]


def band(low: float, high: float, half: int) -> list[float]:
    """Symmetric band pass of 2 ``half`` + 1 taps: a difference of windowed sinc low passes, limits in cycles a sample."""

    def tap(k: int) -> float:
        ideal = 2 * (high - low) if k == 0 else (math.sin(2 * math.pi * high * k) - math.sin(2 * math.pi * low * k)) / (math.pi * k)
        return ideal * (0.5 + 0.5 * math.cos(math.pi * k / (half + 1)))

    return [tap(k) for k in range(-half, half + 1)]


def filtered(df: DataFrame, keys: Keys, taps: Sequence[float], v: str | Column, out: str, first: int = 0, i: str = "i", shift: str | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``taps[k]`` times the value ``first + k`` rows before, 0 beyond the ends.

    With ``shift``, the filtered value of the row before goes into that column.
    A symmetric filter with ``first`` = -half has no phase.
    """
    value = F.col(v) if isinstance(v, str) else v

    def column(gap: int):
        def make(window):
            parts = [F.lit(float(t)) * F.lag("_v", first + k + gap, 0.0).over(window) for k, t in enumerate(taps) if t]
            return sum(parts[1:], parts[0]) if parts else F.lit(0.0)

        return make

    columns = {out: column(0)} | ({shift: column(1)} if shift else {})
    before, after = max(0, first + len(taps)), max(0, -first)
    return ranges.around(df.withColumn("_v", value.cast("double")), keys, before, after, columns, i).drop("_v")


def envelope(df: DataFrame, keys: Keys, v: str, n: int = 9, out: str = "envelope") -> DataFrame:
    """Adds the magnitude, smoothed by ``n`` Hann weights."""
    return filtered(df, keys, smoothing(n), F.abs(v), out, -(n // 2))


def _refined(sums: DataFrame, keys: Keys, score: Column) -> DataFrame:
    """(keys, lag, place, dot): the lag of the largest score, the first of equals, and its place by the parabola through its neighbours."""
    order = Window.partitionBy(*keys).orderBy("lag")
    c, near = F.col, sums.withColumn("_s", score).withColumns({"_l": F.lag("_s").over(order), "_r": F.lead("_s").over(order)})
    bend = c("_l") - 2 * c("_s") + c("_r")
    place = F.when(bend.isNull() | (bend == 0), c("lag").cast("double")).otherwise(c("lag") + 0.5 * (c("_l") - c("_r")) / bend)
    best = F.max_by(F.struct("lag", place.alias("place"), "dot"), F.struct("_s", -c("lag"))).alias("_b")
    return near.groupBy(*keys).agg(best).select(*keys, "_b.*")


def delays(df: DataFrame, keys: Keys, a: str, b: str, most: int) -> DataFrame:
    """(keys, lag, place, ncc): delay of b behind a within ``most`` samples by normalised cross-correlation; a silent series has a null ``ncc``."""
    best = _refined(series.lag_sums(df, keys, a, b, most), keys, F.col("dot"))
    norm = F.sqrt(F.sum(F.col(a) * F.col(a)) * F.sum(F.col(b) * F.col(b)))
    both = best.join(df.groupBy(*keys).agg(norm.alias("_n")), list(keys))
    return both.select(*keys, "lag", "place", (F.col("dot") / F.when(F.col("_n") > 0, F.col("_n"))).alias("ncc"))


def phases(tf: DataFrame, keys: Keys, a: str, b: str, most: int, n: int = 32) -> DataFrame:
    """(keys, lag, place, dot): delay by the phase of the cross spectrum summed over frames; every bin counts alike.

    A key has ``n`` / 2 + 1 bins and 2 ``most`` + 1 lags, whatever its length.
    """
    c = F.col
    cross = tf.groupBy(*keys, "bin").agg(
        F.sum(c(f"{a}_re") * c(f"{b}_re") + c(f"{a}_im") * c(f"{b}_im")).alias("re"), F.sum(c(f"{a}_re") * c(f"{b}_im") - c(f"{a}_im") * c(f"{b}_re")).alias("im")
    )
    size = F.sqrt(c("re") ** 2 + c("im") ** 2) + sp.EPS
    angle, twice = 2 * F.pi() * c("bin") * c("lag") / n, F.when(c("bin").isin(0, n // 2), 1.0).otherwise(2.0) / n
    lags = cross.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    return _refined(lags.groupBy(*keys, "lag").agg(F.sum(twice * (c("re") * F.cos(angle) - c("im") * F.sin(angle)) / size).alias("dot")), keys, c("dot"))


def delayed_copy(df: DataFrame, keys: Keys, v: str, ref: str, low: int, high: int) -> DataFrame:
    """(keys, lag, value): circular lag with ``low`` <= |lag| <= ``high`` of the reference's largest correlation by magnitude, the first of equals.

    The last ``high`` samples of the reference stand before its first and the first
    ones after its last, so a series shorter than that wraps once only.
    """
    c, none = F.col, F.lit(None).cast("double")
    long = df.join(sp.lengths(df, keys), list(keys)).select(*keys, "i", c(ref).cast("double").alias("a"), c(v).cast("double").alias("b"), "_len")
    turned = [long.where(f"i < {high}").withColumn("i", c("i") + c("_len")), long.where(c("i") >= c("_len") - high).withColumn("i", c("i") - c("_len"))]
    rows = long
    for part in turned:
        rows = rows.unionByName(part.withColumn("b", none))
    sums = series.lag_sums(rows, keys, "a", "b", high).where(F.abs("lag") >= low)
    best = sums.groupBy(*keys).agg(F.max_by(F.struct("lag", "dot"), F.struct(F.abs("dot"), -c("lag"))).alias("_b"))
    norm = F.sqrt(F.sum(c(v) * c(v)) * F.sum(c(ref) * c(ref))) + sp.EPS
    return best.join(df.groupBy(*keys).agg(norm.alias("_n")), list(keys)).select(*keys, "_b.lag", (c("_b.dot") / c("_n")).alias("value"))


def warped(df: DataFrame, places: DataFrame, keys: Keys, v: str, taps: int = 16, block: int = 1 << 16) -> DataFrame:
    """(keys, j, at, value): the series at the fractional ``places`` (keys, j, at) by a windowed sinc of 2 ``taps`` samples; 0 beyond the ends.

    Samples and places share one sort by position, in blocks that hold
    ``taps`` samples of their neighbours; a place without a series is 0.
    """
    c, none = F.col, F.lit(None)
    samples = df.select(*keys, none.cast("bigint").alias("j"), c("i").cast("double").alias("at"), c(v).cast("double").alias("_v"), F.lit(True).alias("_s"))
    copies = F.sequence(F.floor((c("at") - taps) / block), F.floor((c("at") + taps) / block))
    asked = places.select(*keys, c("j").cast("bigint").alias("j"), c("at").cast("double").alias("at"), none.cast("double").alias("_v"), F.lit(False).alias("_s"))
    both = samples.withColumn("_block", F.explode(copies)).unionByName(asked.withColumn("_block", F.floor(c("at") / block)))
    near = Window.partitionBy(*keys, "_block").orderBy("at").rangeBetween(-taps, taps)
    found = both.withColumn("_near", F.collect_list(F.when(c("_s"), F.struct(c("at").alias("i"), c("_v").alias("v")))).over(near)).where(~c("_s"))

    def weighted(x: Column) -> Column:
        d = c("at") - x["i"]
        sinc = F.when(d == 0, 1.0).otherwise(F.sin(F.pi() * d) / (F.pi() * d))
        return x["v"] * sinc * (0.5 + 0.5 * F.cos(F.pi() * d / taps))

    return found.select(*keys, "j", "at", F.aggregate(F.transform("_near", weighted), F.lit(0.0), lambda s, x: s + x).alias("value"))


def onsets(strength: DataFrame, keys: Keys, k: float = 4.0, distance: int = 4) -> DataFrame:
    """(keys, frame, strength): local maxima over median + ``k`` MAD, the higher first, ``distance`` frames apart.

    Strengths are sums in any order: copies of a frame differ in their last digits.
    A frame is over the limit by 10^-9 at least, so that one at the limit is not over it.
    """
    middle = stats.exact_quantiles(strength, keys, "strength", [0.5]).select(*keys, F.col("q")[0].alias("_m"))
    away = strength.join(middle, list(keys)).withColumn("_d", F.abs(F.col("strength") - F.col("_m")))
    spread = stats.exact_quantiles(away, keys, "_d", [0.5]).select(*keys, F.col("q")[0].alias("_w"))
    tops = series.local_maxima(strength, keys, "strength", "frame").join(middle, list(keys)).join(spread, list(keys))
    tops = tops.where(F.col("strength") - (F.col("_m") + k * F.col("_w")) >= 1e-9).select(*keys, "frame", "strength")
    return kernels.suppressed(tops, keys, distance, "strength", "frame")


def stereo(df: DataFrame, tf: DataFrame, keys: Keys, a: str, b: str, most: int = 8, n: int = 32) -> DataFrame:
    """(keys, level_db, correlation, phase, delay) of two channels: samples give levels, the cross spectrum phase and delay."""
    c = F.col
    aa, bb, ab = (F.sum(c(x) * c(y)) for x, y in ((a, a), (b, b), (a, b)))
    norm = F.sqrt(aa * bb)
    levels = df.groupBy(*keys).agg((sp.db(aa) - sp.db(bb)).alias("level_db"), F.when(norm > 0, ab / norm).otherwise(0.0).alias("correlation"))
    re, im = F.sum(c(f"{a}_re") * c(f"{b}_re") + c(f"{a}_im") * c(f"{b}_im")), F.sum(c(f"{a}_im") * c(f"{b}_re") - c(f"{a}_re") * c(f"{b}_im"))
    phase = tf.groupBy(*keys).agg(F.atan2(im, re).alias("phase"))
    return levels.join(phase, list(keys)).join(phases(tf, keys, a, b, most, n).select(*keys, F.col("place").alias("delay")), list(keys))


def transient(df: DataFrame, keys: Keys, v: str, decay_db: float = -20.0) -> DataFrame:
    """(keys, peak, rise, decay): samples from a tenth of the envelope's peak up to it, and from it down to ``decay_db``; to the ends where it never gets there."""
    c = F.col
    e = envelope(df.select(*keys, "i", v), keys, v).select(*keys, "i", "envelope")
    top = e.groupBy(*keys).agg(F.max_by(F.struct("i", "envelope"), F.struct("envelope", -c("i"))).alias("_t"), (F.max("i") + 1).alias("_len"))
    both = e.join(top.select(*keys, c("_t.i").alias("_at"), c("_t.envelope").alias("peak"), "_len"), list(keys))
    low = F.max(F.when((c("i") <= c("_at")) & (c("envelope") <= 0.1 * c("peak")), c("i")))
    down = F.min(F.when((c("i") >= c("_at")) & (c("envelope") <= c("peak") * 10 ** (decay_db / 20)), c("i")))
    got = both.groupBy(*keys, "_at", "peak", "_len").agg(low.alias("_low"), down.alias("_down"))
    return got.select(*keys, "peak", (c("_at") - F.coalesce("_low", F.lit(0))).alias("rise"), (F.coalesce("_down", "_len") - c("_at")).alias("decay"))


def friction(df: DataFrame, tf: DataFrame, keys: Keys, est: str, ref: str, hop: int = 8) -> DataFrame:
    """(keys, envelope_r, log_distance): correlation of mean magnitudes of whole blocks of ``hop``, and the mean difference of log magnitudes of cells."""
    blocks = df.groupBy(*keys, F.floor(F.col("i") / hop).alias("_k")).agg(F.avg(F.abs(ref)).alias("_a"), F.avg(F.abs(est)).alias("_b"), F.count("*").alias("_n"))
    r = blocks.where(F.col("_n") == hop).groupBy(*keys).agg(F.corr("_a", "_b").alias("envelope_r"))
    log = lambda x: F.log(F.sqrt(sp.power(x)) + sp.EPS)
    distance = tf.groupBy(*keys).agg(F.avg(F.abs(log(ref) - log(est))).alias("log_distance"))
    return distance.join(r, list(keys), "left").select(*keys, "envelope_r", "log_distance")


def coherence_by_loudness(df: DataFrame, keys: Keys, a: str, b: str, block: int = 128, n: int = 32, hop: int = 8) -> DataFrame:
    """(keys, loud, low, mid, blocks): mean coherence of bins up to a quarter and above, over whole blocks in which b is louder than its median block, and the others."""
    c = F.col
    cut = df.withColumns({"_block": F.floor(c("i") / block), "i": c("i") % block})
    each = [*keys, "_block"]
    level = cut.groupBy(*each).agg(sp.db(F.avg(c(b) * c(b))).alias("_db"), F.count("*").alias("_n")).where(c("_n") == block).drop("_n")
    found = sp.coherence(sp.transformed(cut, each, [a, b], n, hop), each, a, b)
    bins = found.groupBy(*each).agg(F.avg(F.when(c("bin").between(1, n // 4 - 1), c("coherence"))).alias("low"), F.avg(F.when(c("bin") >= n // 4, c("coherence"))).alias("mid"))
    limit = stats.exact_quantiles(level, keys, "_db", [0.5]).select(*keys, c("q")[0].alias("_q"))
    rows = bins.join(level, each).join(limit, list(keys)).withColumn("loud", c("_db") > c("_q"))
    return rows.groupBy(*keys, "loud").agg(F.avg("low").alias("low"), F.avg("mid").alias("mid"), F.count("*").alias("blocks"))


def comb_ripple(tf: DataFrame, keys: Keys, a: str, b: str) -> DataFrame:
    """(keys, ripple): 95th less 5th percentile over bins of the level ratio in dB; a key has as many values as bins."""
    ratio = tf.groupBy(*keys, "bin").agg((sp.db(F.avg(sp.power(a))) - sp.db(F.avg(sp.power(b)))).alias("_r"))
    return ratio.groupBy(*keys).agg((F.percentile("_r", 0.95) - F.percentile("_r", 0.05)).alias("ripple"))


def gated(df: DataFrame, speech: DataFrame, keys: Keys, v: str, depth: float, out: str = "gated") -> DataFrame:
    """Adds ``out``: the value, turned down by ``depth`` times the probability (``t``, ``p``) of speech, straight lines between the points; without points it is left."""
    grid = series.interpolated(speech.select(*keys, "t", F.col("p").alias("_p0")), df.select(*keys, F.col("i").cast(speech.schema["t"].dataType).alias("t")), keys, "t", "_p0")
    held = F.least(F.greatest(F.coalesce("_p0", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return df.join(grid.withColumnRenamed("t", "i"), [*keys, "i"], "left").withColumn(out, F.col(v) * (1 - depth * held)).drop("_p0")


def augmented(df: DataFrame, keys: Keys, v: str, delay: Column, gain_db: Column, tilt: Column, response: Sequence[float], out: str = "augmented") -> DataFrame:
    """Adds ``out``: the series ``delay`` samples later, ``gain_db`` louder, with ``tilt`` times its first difference added, through a response; its length stays.

    Delay, gain and tilt are columns that are the same in every row of a series,
    such as draws from its key; samples before the delay are 0.
    """
    c = F.col
    moved = df.select(*keys, (c("i") + delay).alias("i"), (c(v) * F.pow(F.lit(10.0), gain_db / 20)).alias("_x"), tilt.alias("_t"))
    heard = filtered(moved, keys, response, "_x", "_y", shift="_z")
    value = (c("_y") + c("_t") * (c("_y") - c("_z"))).alias(out)
    return df.join(heard.select(*keys, "i", value), [*keys, "i"], "left").fillna(0.0, [out])
