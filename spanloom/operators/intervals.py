"""Interval algebra on half-open spans (keys, s, e).

Everything is one sort per key: islands come from a running maximum of ends,
intersections and partitions from a sweep over the boundaries of both sides,
so no interval is compared with every other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def spans_of(points: DataFrame, t: str, before: int | float, after: int | float, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """A span around each point, clipped to [low, high]."""
    s, e = F.col(t) - before, F.col(t) + after
    s = F.greatest(s, low) if low is not None else s
    e = F.least(e, high) if high is not None else e
    return points.withColumns({"s": s, "e": e})


def islands(spans: DataFrame, keys: Keys, gap: int | float = 0) -> DataFrame:
    """Adds ``island``: spans that overlap, touch, or lie at most ``gap`` apart share one."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("s") > reach + gap), 1).otherwise(0)
    return spans.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged(spans: DataFrame, keys: Keys, gap: int | float = 0) -> DataFrame:
    """Disjoint spans and how many spans each was made of."""
    return islands(spans, keys, gap).groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("parts")).drop("island")


def dwell(spans: DataFrame, keys: Keys) -> DataFrame:
    """Count, total, median, 90th percentile and longest of each key's spans."""
    length = F.col("e") - F.col("s")
    return spans.groupBy(*keys).agg(
        F.count("*").alias("n_spans"), F.sum(length).alias("total"), F.median(length).alias("median"), F.percentile(length, 0.9).alias("p90"), F.max(length).alias("longest")
    )


def partitioned(sides: dict[str, DataFrame], keys: Keys) -> DataFrame:
    """Elementary pieces (keys, s, e) between the boundaries of all sides, with the depth of each side there.

    A sweep: starts add one, ends take one away, running sums tell what covers
    the piece up to the next boundary.
    """
    names = list(sides)
    edges = None
    for name, df in sides.items():
        for column, sign in (("s", 1), ("e", -1)):
            part = df.select(*keys, F.col(column).alias("at"), *[F.lit(sign if n == name else 0).alias(f"d_{n}") for n in names])
            edges = part if edges is None else edges.unionByName(part)
    steps = edges.groupBy(*keys, "at").agg(*[F.sum(f"d_{n}").alias(f"d_{n}") for n in names])
    order = Window.partitionBy(*keys).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    out = steps.select(*keys, F.col("at").alias("s"), F.lead("at").over(order).alias("e"), *[F.sum(f"d_{n}").over(upto).alias(n) for n in names])
    return out.where("e is not null and e > s")


def shared(a: DataFrame, b: DataFrame, keys: Keys) -> DataFrame:
    """Pieces that both sides cover."""
    return partitioned({"a": a, "b": b}, keys).where("a > 0 and b > 0").drop("a", "b")


def without(a: DataFrame, b: DataFrame, keys: Keys) -> DataFrame:
    """Pieces of ``a`` that ``b`` doesn't cover."""
    return partitioned({"a": a, "b": b}, keys).where("a > 0 and b = 0").drop("a", "b")


def measure(spans: DataFrame, keys: Keys, name: str = "total") -> DataFrame:
    return spans.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias(name))


def last_start(points: DataFrame, spans: DataFrame, keys: Keys, t: str = "t") -> DataFrame:
    """Points with ``s`` and ``e`` of the last span of their key that starts at or before them (disjoint spans)."""
    names = points.columns
    both = points.select(*names, F.lit(None).alias("_span"), F.lit(1).alias("_side"), F.col(t).alias("_at")).unionByName(
        spans.select(*keys, F.struct("s", "e").alias("_span"), F.lit(0).alias("_side"), F.col("s").alias("_at")), allowMissingColumns=True
    )
    order = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_span", F.last("_span", ignorenulls=True).over(order)).where("_side = 1").select(*names, F.col("_span.s").alias("s"), F.col("_span.e").alias("e"))


def inside(points: DataFrame, spans: DataFrame, keys: Keys, t: str = "t", closed: bool = True) -> DataFrame:
    """Adds ``inside``: whether a span covers the point, and ``edge``: its distance to that span's nearer end."""
    found = last_start(points, merged(spans, keys), keys, t)
    hit = F.col(t) <= F.col("e") if closed else F.col(t) < F.col("e")
    return found.withColumns({"inside": F.coalesce(hit, F.lit(False)), "edge": F.when(hit, F.least(F.col(t) - F.col("s"), F.col("e") - F.col(t)))}).drop("s", "e")


def clipped(spans: DataFrame, segments: DataFrame, keys: Keys, width: int, least: int | float = 0) -> DataFrame:
    """Spans cut to segments [a, a + width) that start at multiples of ``width``, in segment time, if at least ``least`` long."""
    parts = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))
    cut = parts.join(segments, [*keys, "cell"])
    cut = cut.withColumns({"s": F.greatest(F.col("s") - F.col("cell") * width, F.lit(0)), "e": F.least(F.col("e") - F.col("cell") * width, F.lit(width))})
    return cut.where(F.col("e") - F.col("s") >= least)


def shifted(spans: DataFrame, by: int, length: int) -> DataFrame:
    """A circular shift within [0, length); a span over the end is split in two."""
    moved = spans.withColumns({"s": F.pmod(F.col("s") + by, F.lit(length)), "_n": F.col("e") - F.col("s")}).withColumn("e", F.col("s") + F.col("_n"))
    pieces = F.when(
        F.col("e") > length,
        F.array(F.struct("s", F.lit(length).cast("bigint").alias("e")), F.struct(F.lit(0).cast("bigint").alias("s"), (F.col("e") - length).alias("e"))),
    ).otherwise(F.array(F.struct("s", "e")))
    return moved.withColumn("_p", F.explode(pieces)).withColumns({"s": F.col("_p.s"), "e": F.col("_p.e")}).drop("_p", "_n")


def envelope(spans: DataFrame, keys: Keys, attack: int, release: int) -> DataFrame:
    """Gain (keys, i, g) on the frames of spans [s, e): raised-cosine attack and release, the larger of spans that meet.

    Ramps of a span shorter than a ramp are as long as the span.
    """
    frames = spans.withColumn("i", F.explode(F.sequence(F.col("s"), F.col("e") - 1)))
    n, j, back = F.col("e") - F.col("s"), F.col("i") - F.col("s"), F.col("e") - 1 - F.col("i")

    def ramp(place: Column, length: int) -> Column:
        m = F.least(F.lit(length), n)
        return F.when((place < m) & (m > 1), 0.5 - 0.5 * F.cos(F.pi() * place / (m - 1))).otherwise(1.0)

    return frames.withColumn("g", F.least(ramp(j, attack), ramp(back, release))).groupBy(*keys, "i").agg(F.max("g").alias("g"))


def typed(events: DataFrame, keys: Keys, t: str, kind: str, release: str, before: int, after: int, join: int) -> DataFrame:
    """Spans of the events that are no releases; a release within ``join`` of the last such event extends its span, others are skipped.

    The last non-release event before a release decides, so no fold is needed.
    """
    order = Window.partitionBy(*keys).orderBy(t, kind).rowsBetween(Window.unboundedPreceding, 0)
    base = F.last(F.when(F.col(kind) != release, F.col(t)), ignorenulls=True).over(order)
    rows = events.withColumn("_base", base).where((F.col(kind) != release) | (F.col(t) - F.col("_base") <= join))
    spans = rows.groupBy(*keys, "_base").agg(F.max(t).alias("_end"))
    return spans.select(*keys, (F.col("_base") - before).alias("s"), (F.col("_end") + after).alias("e"))


def adaptive(series: DataFrame, peaks: DataFrame, keys: Keys, back: int, ahead: int, low: float, fall: float, v: str = "v") -> DataFrame:
    """Spans shaped by the data: from the last row at or under ``low`` of the peak, at most ``back`` rows before it, to the
    first row at or under ``fall`` of the largest value up to ``ahead`` rows after it; the reach's end where there is none.

    What lies around a peak is a range window in one sort of the series.
    """
    order = Window.partitionBy(*keys).orderBy("i")
    marks = peaks.select(*keys, "i").withColumn("_peak", F.lit(True)).distinct()
    pairs = lambda a, b: F.collect_list(F.struct("i", F.col(v).alias("v"))).over(order.rangeBetween(a, b))
    rows = series.select(*keys, "i", v).join(marks, [*keys, "i"], "left")
    near = rows.withColumns({"_b": pairs(-back, -1), "_f": pairs(0, ahead), "_top": F.max(v).over(order.rangeBetween(0, ahead))}).where("_peak")
    start = F.array_max(F.transform(F.filter("_b", lambda x: x["v"] <= low * F.col(v)), lambda x: x["i"]))
    end = F.array_min(F.transform(F.filter("_f", lambda x: x["v"] <= fall * F.col("_top")), lambda x: x["i"]))
    return near.select(*keys, F.coalesce(start, F.col("i") - back).alias("s"), F.coalesce(end, F.col("i") + ahead).alias("e"))


def dynamics(series: DataFrame, events: DataFrame, keys: Keys, half: int, raw: str, out: str, missed: float = 0.1) -> DataFrame:
    """Peaks of both signals around each event, their ratio, its absolute log, and whether the event is all but gone."""
    around = Window.partitionBy(*keys).orderBy("i").rangeBetween(-half, half)
    marks = events.select(*keys, "i").withColumn("_e", F.lit(True)).distinct()
    rows = series.select(*keys, "i", raw, out).join(marks, [*keys, "i"], "left")
    near = rows.withColumns({"raw_peak": F.max(raw).over(around), "out_peak": F.max(out).over(around)}).where("_e")
    top = near.select(*keys, F.col("i").alias("event"), "raw_peak", "out_peak")
    ratio = F.col("out_peak") / F.greatest(F.col("raw_peak"), F.lit(1e-9))
    return top.withColumn("ratio", ratio).withColumns({"log_error": F.abs(F.ln(F.greatest("ratio", F.lit(1e-9)))), "missed": F.col("ratio") < missed})
