"""Time-frequency rows (keys, frame, bin, re, im) of long series, made and undone by joins with a small table of cosines.

A sample goes to the frames that cover it, meets the ``n`` / 2 + 1 bins of a
broadcast table whose size depends on the frame alone, and sums of products are
the transform: partial sums are made where the samples are, so what is shuffled
is a row a frame and bin, not a row a sample.  Masks, filters and levels are
then columns, windows and groups over these rows, and a series may be longer
than any array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats

Keys = Sequence[str]
EPS = 1e-12


def db(power: Column) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(EPS)))


def power(c: str) -> Column:
    """Squared magnitude of the complex column ``c``: its parts are ``c_re`` and ``c_im``."""
    return F.col(f"{c}_re") * F.col(f"{c}_re") + F.col(f"{c}_im") * F.col(f"{c}_im")


def lengths(df: DataFrame, keys: Keys, i: str = "i") -> DataFrame:
    return df.groupBy(*keys).agg((F.max(i) + 1).alias("_len"))


def framed(df: DataFrame, keys: Keys, n: int, hop: int, columns: Sequence[str], i: str = "i") -> DataFrame:
    """(keys, frame, k, columns): each sample in the frames of ``n`` that cover it, centred on multiples of ``hop``.

    A series is reflected at its ends; one too short for that meets silence.
    """
    half, at, long = n // 2, F.col(i), F.col("_len")
    places = F.array(
        at + half, F.when(at.between(1, half), half - at), F.when(at.between(long - 1 - half, long - 2), half + 2 * (long - 1) - at)
    )
    padded = df.join(lengths(df, keys, i), list(keys)).select(*keys, *columns, "_len", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("_p"))
    first, last = F.greatest(F.lit(0), F.ceil((F.col("_p") - n + 1) / hop)), F.least(F.floor(F.col("_p") / hop), F.floor(long / hop))
    frames = padded.where(first <= last).withColumn("frame", F.explode(F.sequence(first, last)))
    return frames.select(*keys, "frame", (F.col("_p") - F.col("frame") * hop).alias("k"), *columns)


def basis(spark: SparkSession, n: int) -> DataFrame:
    """(k, bin, c, s, w): cosine and sine times the periodic Hann window w; n * (n / 2 + 1) rows."""
    k, b = F.col("id") % n, F.floor(F.col("id") / n)
    angle, w = 2 * F.pi() * k * b / n, 0.5 - 0.5 * F.cos(2 * F.pi() * k / n)
    return spark.range(n * (n // 2 + 1), numPartitions=1).select(k.alias("k"), b.alias("bin"), (F.cos(angle) * w).alias("c"), (F.sin(angle) * w).alias("s"), w.alias("w"))


def transformed(df: DataFrame, keys: Keys, columns: Sequence[str], n: int = 32, hop: int = 8, i: str = "i") -> DataFrame:
    """(keys, frame, bin, re and im of each column)."""
    met = framed(df, keys, n, hop, columns, i).join(F.broadcast(basis(df.sparkSession, n)), "k")
    sums = [x for c in columns for x in (F.sum(F.col(c) * F.col("c")).alias(f"{c}_re"), (-F.sum(F.col(c) * F.col("s"))).alias(f"{c}_im"))]
    return met.groupBy(*keys, "frame", "bin").agg(*sums)


def restored(tf: DataFrame, keys: Keys, columns: Sequence[str], long: DataFrame, n: int = 32, hop: int = 8) -> DataFrame:
    """(keys, i, columns): frames turned back, windowed again and added up, over the sum of squared windows."""
    twice = F.when(F.col("bin").isin(0, n // 2), 1.0).otherwise(2.0) / n
    met = tf.join(F.broadcast(basis(tf.sparkSession, n)), "bin").withColumn("i", F.col("frame") * hop + F.col("k") - n // 2)
    weight = F.greatest(F.sum(F.when(F.col("bin") == 0, F.col("w") * F.col("w"))), F.lit(EPS))
    sums = [(F.sum(twice * (F.col(f"{c}_re") * F.col("c") - F.col(f"{c}_im") * F.col("s"))) / weight).alias(c) for c in columns]
    return met.groupBy(*keys, "i").agg(*sums).join(long, list(keys)).where("i >= 0 and i < _len").drop("_len")


def ridge(tf: DataFrame, keys: Keys, target: str, refs: Sequence[str], share: float = 1e-3) -> DataFrame:
    """(keys, bin, w0_re, w0_im, w1_re, w1_im, before, after): the ridge regression of a bin on two references.

    The Gram matrix of two complex columns and its right side are sums over the
    frames of a bin; the 2 x 2 system is solved by column arithmetic, and the
    energy that is left follows from the same sums.
    """
    a, b = refs
    dot = lambda x, y: (F.sum(F.col(f"{x}_re") * F.col(f"{y}_re") + F.col(f"{x}_im") * F.col(f"{y}_im")), F.sum(F.col(f"{x}_re") * F.col(f"{y}_im") - F.col(f"{x}_im") * F.col(f"{y}_re")))  # noqa: E731  conj(x) * y
    (aa, _), (bb, _), (ab_r, ab_i), (at_r, at_i), (bt_r, bt_i), (tt, _) = dot(a, a), dot(b, b), dot(a, b), dot(a, target), dot(b, target), dot(target, target)
    named = {"aa": aa, "bb": bb, "ab_r": ab_r, "ab_i": ab_i, "at_r": at_r, "at_i": at_i, "bt_r": bt_r, "bt_i": bt_i, "before": tt}
    g = tf.groupBy(*keys, "bin").agg(*[v.alias(k) for k, v in named.items()])
    c = F.col
    g = g.withColumn("_l", share * (c("aa") + c("bb")) / 2 + EPS).withColumns({"_a": c("aa") + c("_l"), "_b": c("bb") + c("_l")})
    g = g.withColumn("_d", c("_a") * c("_b") - c("ab_r") * c("ab_r") - c("ab_i") * c("ab_i"))
    g = g.withColumns({
        "w0_re": (c("_b") * c("at_r") - (c("ab_r") * c("bt_r") - c("ab_i") * c("bt_i"))) / c("_d"),
        "w0_im": (c("_b") * c("at_i") - (c("ab_r") * c("bt_i") + c("ab_i") * c("bt_r"))) / c("_d"),
        "w1_re": (c("_a") * c("bt_r") - (c("ab_r") * c("at_r") + c("ab_i") * c("at_i"))) / c("_d"),
        "w1_im": (c("_a") * c("bt_i") - (c("ab_r") * c("at_i") - c("ab_i") * c("at_r"))) / c("_d"),
    })
    crossed = c("w0_re") * c("at_r") + c("w0_im") * c("at_i") + c("w1_re") * c("bt_r") + c("w1_im") * c("bt_i")
    mixed_re, mixed_im = c("w0_re") * c("w1_re") + c("w0_im") * c("w1_im"), c("w0_re") * c("w1_im") - c("w0_im") * c("w1_re")
    square = c("aa") * (c("w0_re") ** 2 + c("w0_im") ** 2) + c("bb") * (c("w1_re") ** 2 + c("w1_im") ** 2) + 2 * (mixed_re * c("ab_r") - mixed_im * c("ab_i"))
    return g.withColumn("after", c("before") - 2 * crossed + square).select(*keys, "bin", "w0_re", "w0_im", "w1_re", "w1_im", "before", "after")


def earlier(tf: DataFrame, keys: Keys, column: str, out: str, frames: int = 1) -> DataFrame:
    """Adds the bin's value ``frames`` frames before as ``out``, 0 in the first ones; frames meet by equality, not by a window over the series."""
    back = tf.select(*keys, (F.col("frame") + frames).alias("frame"), "bin", F.col(f"{column}_re").alias(f"{out}_re"), F.col(f"{column}_im").alias(f"{out}_im"))
    return tf.join(back, [*keys, "frame", "bin"], "left").fillna(0.0, [f"{out}_re", f"{out}_im"])


def _middle(order: Window, by: Column, half: int) -> Column:
    """Median of 2 ``half`` + 1 rows; the row at an end stands for those beyond it."""
    near = F.collect_list(by).over(order.rowsBetween(-half, half))
    left, right = F.count(by).over(order.rowsBetween(-half, -1)), F.count(by).over(order.rowsBetween(1, half))
    ends = [F.array_repeat(F.element_at(near, 1), half - left.cast("int")), F.array_repeat(F.element_at(near, -1), half - right.cast("int"))]
    return F.element_at(F.array_sort(F.concat(ends[0], near, ends[1])), half + 1)


def percussive(tf: DataFrame, keys: Keys, column: str, width: int = 7, power_: float = 2.0) -> DataFrame:
    """Adds ``mask``: the median along bins (percussive) against the median along frames (harmonic), as shares of their powers."""
    half, m = width // 2, F.sqrt(power(column))
    frames, bins = Window.partitionBy(*keys, "bin").orderBy("frame"), Window.partitionBy(*keys, "frame").orderBy("bin")
    rows = tf.withColumn("_m", m).withColumn("harmonic", _middle(frames, F.col("_m"), half)).withColumn("percussive", _middle(bins, F.col("_m"), half))
    p, h = F.col("percussive") ** power_, F.col("harmonic") ** power_
    return rows.withColumn("mask", p / (p + h + EPS)).drop("_m")


def wiener(tf: DataFrame, keys: Keys, mix: str, noise: str, floor: float = 0.1) -> DataFrame:
    """Adds ``gain``: one minus the noise's share of the power, at least ``floor``, the mean over three frames; ends stand for what is beyond them."""
    raw = F.greatest(1 - power(noise) / F.greatest(power(mix), F.lit(EPS)), F.lit(floor))
    order = Window.partitionBy(*keys, "bin").orderBy("frame")
    rows = tf.withColumn("_g", raw)
    return rows.withColumn("gain", (F.coalesce(F.lag("_g").over(order), "_g") + F.col("_g") + F.coalesce(F.lead("_g").over(order), "_g")) / 3).drop("_g")


def masked(tf: DataFrame, mix: str, target: str) -> DataFrame:
    """Adds the complex ratio of target and mix (``ratio_re``, ``ratio_im``), and its real part cut to [0, 1] (``bounded``)."""
    c, p = F.col, power(mix) + EPS
    re = (c(f"{target}_re") * c(f"{mix}_re") + c(f"{target}_im") * c(f"{mix}_im")) / p
    im = (c(f"{target}_im") * c(f"{mix}_re") - c(f"{target}_re") * c(f"{mix}_im")) / p
    return tf.withColumns({"ratio_re": re, "ratio_im": im, "bounded": F.least(F.greatest(re, F.lit(0.0)), F.lit(1.0))})


def attenuation(tf: DataFrame, keys: Keys, raw: str, out: str, ref: str, point: float = 0.75) -> DataFrame:
    """(keys, active_db, inactive_db): level change where the reference is at or over its percentile, and elsewhere."""
    rows = tf.withColumn("_r", F.sqrt(power(ref)))
    limit = stats.exact_quantiles(rows, keys, "_r", [point]).select(*keys, F.col("q")[0].alias("_q"))
    on = F.col("_r") >= F.col("_q")
    change = lambda m: db(F.avg(F.when(m, power(out)))) - db(F.avg(F.when(m, power(raw))))
    return rows.join(limit, list(keys)).groupBy(*keys).agg(change(on).alias("active_db"), change(~on).alias("inactive_db"))


def coherence(tf: DataFrame, keys: Keys, a: str, b: str) -> DataFrame:
    """(keys, bin, coherence): squared magnitude of the mean cross spectrum over the product of mean powers."""
    c = F.col
    re, im = F.avg(c(f"{a}_re") * c(f"{b}_re") + c(f"{a}_im") * c(f"{b}_im")), F.avg(c(f"{a}_im") * c(f"{b}_re") - c(f"{a}_re") * c(f"{b}_im"))
    return tf.groupBy(*keys, "bin").agg(((re * re + im * im) / F.greatest(F.avg(power(a)) * F.avg(power(b)), F.lit(EPS))).alias("coherence"))


def flux(tf: DataFrame, keys: Keys, column: str, floor_db: float = -80.0) -> DataFrame:
    """(keys, frame, strength): positive change of each bin's level since the frame before, summed over bins; 0 in the first frame."""
    level = F.greatest(20 * F.log10(F.sqrt(power(column)) + EPS), F.lit(floor_db))
    rows = tf.select(*keys, "frame", "bin", level.alias("_db"))
    back = rows.select(*keys, (F.col("frame") + 1).alias("frame"), "bin", F.col("_db").alias("_was"))
    rise = F.coalesce(F.greatest(F.col("_db") - F.col("_was"), F.lit(0.0)), F.lit(0.0))
    return rows.join(back, [*keys, "frame", "bin"], "left").groupBy(*keys, "frame").agg(F.sum(rise).alias("strength"))


def chunked(df: DataFrame, keys: Keys, size: int, model: Callable[[np.ndarray], np.ndarray], v: str = "v", i: str = "i", out: str = "out") -> DataFrame:
    """Adds ``out``: ``model`` on half-overlapping chunks of ``size`` samples, joined by Hann weights; what no full chunk covers is 0.

    ``model`` takes and gives a matrix, a row a chunk, as many as an Arrow batch
    holds.  Chunks are cut from rows and put together by sample, so a series is
    never held whole; a chunk is the largest group.
    """
    half = size // 2
    last = F.floor(F.col(i) / half)
    cells = df.select(*keys, i, v, F.explode(F.filter(F.array(last - 1, last), lambda a: a >= 0)).alias("chunk")).where(F.col(i) < F.col("chunk") * half + size)
    chunks = cells.groupBy(*keys, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct(i, v))), lambda x: x[v].cast("double")).alias("x")).where(F.size("x") == size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(x=list(np.asarray(model(np.stack(pdf["x"].to_numpy())), float)))

    done = chunks.mapInPandas(run, chunks.schema)
    weight = 0.5 - 0.5 * F.cos(2 * F.pi() * F.col("_k") / size) + 1e-6
    samples = done.select(*keys, "chunk", F.posexplode("x").alias("_k", "_y")).select(*keys, (F.col("chunk") * half + F.col("_k")).alias(i), "_y", weight.alias("_w"))
    joined = samples.groupBy(*keys, i).agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias(out))
    return df.join(joined, [*keys, i], "left").fillna(0.0, [out])
