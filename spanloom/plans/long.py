"""One series over the whole table: what a window without a key would sort in one task, by ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import ranges
from .base import EV, HOUR, events, load, query, r

_ONE = EV + ", ser AS (SELECT event_id, t, value AS v, row_number() OVER (ORDER BY t, event_id) - 1 AS i FROM ev)"


def one_series(spark, sf):
    """All events in time order as one dense series."""
    rows = events(spark, sf).select("event_id", "t", F.col("value").alias("v"))
    return ranges.numbered(rows, ["t", "event_id"], "i").withColumn("i", F.col("i") - 1)


@query(
    "long_novelty",
    _ONE + """, sm AS (SELECT *, sum(v) OVER (ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9 AS smooth FROM ser)
SELECT i, round(smooth, 6) AS smooth, round(coalesce(greatest(smooth - lag(smooth, 5) OVER (ORDER BY i), 0), 0), 6) AS rise FROM sm""",
)
def long_novelty(spark, sf):
    """Smoothed values and their rise, in blocks that know their neighbours' edges."""
    rows = ranges.around(one_series(spark, sf), [], 4, 4, {"smooth": lambda w: F.sum("v").over(w.rowsBetween(-4, 4)) / 9})
    rows = ranges.around(rows, [], 5, 0, {"_back": lambda w: F.lag("smooth", 5).over(w)})
    return rows.select("i", r("smooth").alias("smooth"), r(F.coalesce(F.greatest(F.col("smooth") - F.col("_back"), F.lit(0.0)), F.lit(0.0))).alias("rise"))


@query(
    "long_span_merge",
    EV + f""", sp AS (SELECT t - {HOUR // 60} AS s, t + {HOUR // 12} AS e FROM ev), c AS (SELECT s, e, CASE WHEN s > max(e) OVER w THEN 1 ELSE 0 END AS fresh FROM sp
WINDOW w AS (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT s, e, sum(fresh) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM c)
SELECT min(s) AS s, max(e) AS e, count(*) AS parts FROM g GROUP BY g""",
)
def long_span_merge(spark, sf):
    return ranges.merged(iv.spans_of(events(spark, sf), "t", HOUR // 60, HOUR // 12), [])


@query("long_runs", _ONE + ", h AS (SELECT i, sum(CASE WHEN v >= 30 THEN 0 ELSE 1 END) OVER (ORDER BY i) AS g, v >= 30 AS held FROM ser) SELECT min(i) AS s, max(i) AS e, count(*) AS n FROM h WHERE held GROUP BY g")
def long_runs(spark, sf):
    return ranges.runs(one_series(spark, sf), [], F.col("v") >= 30)


@query(
    "long_hysteresis",
    _ONE.replace("WITH", "WITH RECURSIVE") + """, h AS (SELECT i, v >= 60 AS st, 0 AS quiet FROM ser WHERE i = 0 UNION ALL SELECT s.i, CASE WHEN h.st THEN (CASE WHEN s.v >= 20 THEN 0 ELSE h.quiet + 1 END) <= 2 ELSE s.v >= 60 END,
CASE WHEN h.st AND s.v < 20 THEN h.quiet + 1 ELSE 0 END FROM h JOIN ser s ON s.i = h.i + 1) SELECT i, st AS on_ FROM h""",
)
def long_hysteresis(spark, sf):
    return ranges.hysteresis(one_series(spark, sf).select("i", "v"), [], 60, 20, 2, "v").select("i", F.col("on").alias("on_"))


@query(
    "long_first_fit",
    EV + """, s AS (SELECT event_id, t, 1 + event_id % 7 AS n FROM ev), c AS (SELECT *, coalesce(sum(n + 2) OVER (ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM s)
SELECT event_id, place FROM c WHERE place + n <= (SELECT 3 * count(*) FROM ev)""",
)
def long_first_fit(spark, sf):
    """Events one after the other, two apart, on a canvas of three places for each event."""
    rows = events(spark, sf).select("event_id", "t", (1 + F.col("event_id") % 7).alias("n"))
    return ranges.placed(rows, [], "n", 3 * rows.count(), 2, ["t", "event_id"]).select("event_id", F.col("at").alias("place"))


@query(
    "long_spearman",
    """WITH r AS (SELECT l_linenumber % 2 AS side, l_quantity, l_extendedprice, rank() OVER a + (count(*) OVER (PARTITION BY l_linenumber % 2, l_quantity) - 1) / 2.0 AS x,
rank() OVER b + (count(*) OVER (PARTITION BY l_linenumber % 2, l_extendedprice) - 1) / 2.0 AS y FROM lineitem WINDOW a AS (PARTITION BY l_linenumber % 2 ORDER BY l_quantity), b AS (PARTITION BY l_linenumber % 2 ORDER BY l_extendedprice))
SELECT side, round(corr(x, y), 6) AS rho, count(*) AS n FROM r GROUP BY side""",
)
def long_spearman(spark, sf):
    """Rank correlation of two keys over all lines: equal values are counted, then ranked by running sums."""
    rows = load(spark, sf, "lineitem").select((F.col("l_linenumber") % 2).alias("side"), "l_quantity", "l_extendedprice")
    for v, out in (("l_quantity", "x"), ("l_extendedprice", "y")):
        rows = rows.join(ranges.average_ranks(rows, ["side"], v, out), ["side", v])
    return rows.groupBy("side").agg(r(F.corr("x", "y")).alias("rho"), F.count("*").alias("n"))
