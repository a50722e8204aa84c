"""Series queries: a user's events in time order are the rows i of a series with value v."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, kernels
from ..operators import series as so
from .base import EV, HOUR, SER, events, query, r, series

U = ["user_id"]
W = "WINDOW w AS (PARTITION BY user_id ORDER BY i)"
_SM = "sm AS (SELECT *, sum(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM ser)"
_RI = "ri AS (SELECT *, coalesce(greatest(smooth - lag(smooth, 3) OVER (PARTITION BY user_id ORDER BY i), 0), 0) AS rise FROM sm)"


@query("moving_avg_zero_pad", f"{SER}, {_SM} SELECT user_id, i, round(smooth, 6) AS smooth FROM sm")
def moving_avg_zero_pad(spark, sf):
    return so.moving_average(series(spark, sf), U, 5).select("user_id", "i", r("smooth").alias("smooth"))


def rise(spark, sf):
    return so.novelty(so.moving_average(series(spark, sf), U, 5), U, 3)


@query("novelty_rise", f"{SER}, {_SM}, {_RI} SELECT user_id, i, round(rise, 6) AS rise FROM ri")
def novelty_rise(spark, sf):
    return rise(spark, sf).select("user_id", "i", r("rise").alias("rise"))


_WEIGHTS = {"click": 1.0, "view": 0.5, "purchase": 0.8}
_FU = f"""ch AS (SELECT user_id, event_type, t // {24 * HOUR} AS i, max(value) AS v FROM ev GROUP BY ALL), pc AS (SELECT user_id, event_type, quantile_cont(v, 0.995) AS p FROM ch GROUP BY ALL),
fu AS (SELECT user_id, i, sum(CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 0.5::DOUBLE WHEN 'purchase' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END * least(v / (p + 1e-9::DOUBLE), 2.5::DOUBLE)) AS score FROM ch JOIN pc USING (user_id, event_type) GROUP BY user_id, i)"""


def fused(spark, sf):
    daily = events(spark, sf).groupBy("user_id", "event_type", F.floor(F.col("t") / (24 * HOUR)).alias("i")).agg(F.max("value").alias("v"))
    return so.fused(daily, U, "event_type", _WEIGHTS, "v")


@query("fused_score", f"{EV}, {_FU} SELECT user_id, i, round(score, 6) AS score FROM fu")
def fused_score(spark, sf):
    return fused(spark, sf).select("user_id", "i", r("score").alias("score"))


@query(
    "local_adaptive_threshold",
    f"""{SER}, a AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, first_value(v) OVER w AS f, last_value(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
sum(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS s FROM ser {W}), m AS (SELECT *, (s + greatest(15 - i, 0) * f + greatest(i + 16 - n, 0) * l) / 31 AS mean FROM a)
SELECT user_id, i, round(mean, 6) AS local_mean FROM m WHERE v > mean + 45 AND v > 60""",
)
def local_adaptive_threshold(spark, sf):
    return so.local_threshold(series(spark, sf), U, 15, 45, 60).where("above").select("user_id", "i", r("local_mean").alias("local_mean"))


@query(
    "sessionize_chained_gap",
    f"""{EV}, f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {4 * HOUR} THEN 0 ELSE 1 END AS nw FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, session::BIGINT AS session, min(t) AS start, count(*) AS n, max(t) - min(t) AS length FROM s GROUP BY user_id, session""",
)
def sessionize_chained_gap(spark, sf):
    s = so.sessions(events(spark, sf), U, 4 * HOUR, "t", ["event_id"])
    return s.groupBy("user_id", "session").agg(F.min("t").alias("start"), F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("length"))


@query(
    "burst_islands",
    f"{SER}, h AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM ser WHERE v > 40) SELECT user_id, min(i) AS s, max(i) AS e, count(*) AS n FROM h GROUP BY user_id, g",
)
def burst_islands(spark, sf):
    return so.runs(series(spark, sf), U, F.col("v") > 40)


@query(
    "min_len_islands",
    f"""{EV}, h AS (SELECT user_id, t AS s, t + {2 * HOUR} AS e FROM ev), a AS (SELECT *, CASE WHEN s > max(e) OVER w + {2 * HOUR} OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM h WINDOW w AS (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM a), m AS (SELECT user_id, min(s) AS s, max(e) AS e FROM b GROUP BY user_id, g) SELECT user_id, s, e FROM m WHERE e - s >= {6 * HOUR}""",
)
def min_len_islands(spark, sf):
    spans = events(spark, sf).select("user_id", F.col("t").alias("s"), (F.col("t") + 2 * HOUR).alias("e"))
    return so.joined_runs(spans, U, 2 * HOUR, 6 * HOUR).select("user_id", "s", "e")


_MX = f"""g AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS nw FROM ser {W}), k AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM g),
tp AS (SELECT user_id, grp, min(i) AS a, max(i) AS b, any_value(v) AS v FROM k GROUP BY user_id, grp), nb AS (SELECT *, lag(v) OVER x AS l, lead(v) OVER x AS rr FROM tp WINDOW x AS (PARTITION BY user_id ORDER BY grp)),
mx AS (SELECT user_id, (a + b) // 2 AS i, v FROM nb WHERE l < v AND rr < v)"""


@query("local_maxima", f"{SER}, {_MX} SELECT user_id, i, v FROM mx")
def local_maxima(spark, sf):
    return so.local_maxima(series(spark, sf), U)


@query(
    "local_prominence",
    f"{SER} SELECT user_id, i, round(v - greatest(min(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), min(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)), 6) AS prominence FROM ser",
)
def local_prominence(spark, sf):
    return so.prominence(series(spark, sf), U, 9).select("user_id", "i", r("prominence").alias("prominence"))


@query("neighbour_max", f"{SER} SELECT user_id, i, max(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS peak FROM ser")
def neighbour_max(spark, sf):
    return so.around(series(spark, sf), U, 4).select("user_id", "i", "peak")


@query(
    "refine_peak",
    f"""{SER}, c AS (SELECT user_id, event_id, t, v FROM ser WHERE event_type = 'click'), p AS (SELECT c.event_id, s.v, s.t - c.t AS d, abs(s.t - c.t) AS a, s.i FROM c JOIN ser s ON s.user_id = c.user_id AND s.t BETWEEN c.t - {24 * HOUR} AND c.t + {24 * HOUR})
SELECT event_id, arg_max(d, v) FILTER (a <= {4 * HOUR}) AS shift, max(v) FILTER (a <= {4 * HOUR}) AS peak, round(median(v) FILTER (a > {6 * HOUR}), 6) AS floor_ FROM p GROUP BY event_id""",
)
def refine_peak(spark, sf):
    s = series(spark, sf)
    c = s.where("event_type = 'click'").select("user_id", "event_id", "t")
    near = joins.band(c, s.select("user_id", "t", "v", "i"), U, 24 * HOUR, 24 * HOUR)
    d = F.col("other") - F.col("t")
    close = F.abs(d) <= 4 * HOUR
    best = F.max(F.when(close, F.struct("v", (-F.col("i")).alias("n"), d.alias("d"))))
    return near.groupBy("event_id").agg(best["d"].alias("shift"), best["v"].alias("peak"), r(F.median(F.when(F.abs(d) > 6 * HOUR, F.col("v")))).alias("floor_"))


@query("previous_next_gap", f"{EV} SELECT user_id, event_id, t - lag(t) OVER w AS prev_gap, lead(t) OVER w - t AS next_gap FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)")
def previous_next_gap(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    return events(spark, sf).select("user_id", "event_id", (F.col("t") - F.lag("t").over(w)).alias("prev_gap"), (F.lead("t").over(w) - F.col("t")).alias("next_gap"))


@query(
    "trailing_echo_ratio",
    f"{SER}, m AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS trail FROM ser) SELECT user_id, i, trail, round(trail / greatest(v, 1e-9), 4) AS echo FROM m",
)
def trailing_echo_ratio(spark, sf):
    return so.echo(series(spark, sf), U, 8).select("user_id", "i", "trail", r("echo", 4).alias("echo"))


@query("frame_rms", f"{SER} SELECT user_id, i // 5 AS frame, round(sqrt(avg(v * v)), 6) AS rms FROM ser GROUP BY user_id, i // 5 HAVING count(*) = 5")
def frame_rms(spark, sf):
    return so.frame_levels(series(spark, sf), U, 5).select("user_id", "frame", r("rms").alias("rms"))


@query(
    "overlapping_frame_rms",
    f"{SER}, a AS (SELECT user_id, i, sqrt(avg(v * v) OVER x) AS rms, count(*) OVER x AS n FROM ser WINDOW x AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT user_id, i, round(rms, 5) AS rms FROM a WHERE n = 8 AND i % 3 = 0",
)
def overlapping_frame_rms(spark, sf):
    return so.overlapping_levels(series(spark, sf), U, 8, 3).select("user_id", "i", r("rms", 5).alias("rms"))


@query(
    "attenuation_episodes",
    f"""{SER}, a AS (SELECT user_id, i, avg(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m, quantile_cont(v, 0.25) OVER (PARTITION BY user_id) AS q FROM ser), b AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM a WHERE m < q * 1.5)
SELECT user_id, min(i) AS s, max(i) AS e, count(*) AS n FROM b GROUP BY user_id, g HAVING count(*) >= 3""",
)
def attenuation_episodes(spark, sf):
    s = series(spark, sf)
    q = s.groupBy("user_id").agg(F.percentile("v", 0.25).alias("q"))
    level = s.withColumn("m", F.avg("v").over(Window.partitionBy("user_id").orderBy("i").rowsBetween(-2, 2))).join(q, "user_id")
    return so.runs(level, U, F.col("m") < F.col("q") * 1.5).where("n >= 3")


@query(
    "sliding_window_rate",
    f"{EV}, x AS (SELECT user_id, value, unnest(range((t - {8 * HOUR}) // {2 * HOUR} + 1, t // {2 * HOUR} + 1)) * {2 * HOUR} AS w0 FROM ev) SELECT user_id, w0, count(*) AS n, round(avg(value), 5) AS mean FROM x GROUP BY user_id, w0",
)
def sliding_window_rate(spark, sf):
    return so.sliding(events(spark, sf), U, 8 * HOUR, 2 * HOUR).groupBy("user_id", "w0").agg(F.count("*").alias("n"), r(F.avg("value"), 5).alias("mean"))


@query(
    "best_window",
    f"""{SER}, m AS (SELECT user_id, i, avg(CASE WHEN v > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER x AS cover, count(*) OVER x AS n FROM ser WINDOW x AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT user_id, i, round(cover, 6) AS cover FROM m WHERE n = 10 AND i % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cover DESC, i) = 1""",
)
def best_window(spark, sf):
    m = series(spark, sf).withColumn("m", F.when(F.col("v") > 30, 1.0).otherwise(0.0))
    return so.best_window(m, U, 10, 2).select("user_id", "i", r("cover").alias("cover"))


@query(
    "event_locked_average",
    f"""{SER}, c AS (SELECT user_id, i AS e FROM ser WHERE event_type = 'purchase'), n AS (SELECT user_id, count(*) AS n FROM ser GROUP BY 1)
SELECT s.i - c.e AS offset_, round(avg(s.v), 6) AS mean, count(*) AS n FROM c JOIN n USING (user_id) JOIN ser s ON s.user_id = c.user_id AND s.i BETWEEN c.e - 6 AND c.e + 6 WHERE c.e >= 6 AND c.e + 6 < n.n GROUP BY 1""",
)
def event_locked_average(spark, sf):
    s = series(spark, sf)
    return so.locked_average(s, s.where("event_type = 'purchase'"), U, 6).select(F.col("offset").cast("bigint").alias("offset_"), r("mean").alias("mean"), "n")


@query(
    "nearest_peak_offset",
    f"""{SER}, {_MX}, c AS (SELECT user_id, i FROM ser WHERE event_type = 'click'), q AS (SELECT user_id, i FROM mx WHERE v >= 60), n AS (SELECT c.user_id, c.i, b.i AS bi, a.i AS ai FROM c ASOF LEFT JOIN q b ON c.user_id = b.user_id AND c.i >= b.i ASOF LEFT JOIN q a ON c.user_id = a.user_id AND c.i <= a.i),
d AS (SELECT user_id, CASE WHEN ai IS NULL OR (bi IS NOT NULL AND i - bi <= ai - i) THEN bi - i ELSE ai - i END AS lag FROM n)
SELECT user_id, count(*) FILTER (coalesce(abs(lag) <= 5, false)) AS heard, count(*) - count(*) FILTER (coalesce(abs(lag) <= 5, false)) AS silent, median(CASE WHEN abs(lag) <= 5 THEN lag END::DOUBLE) AS lead FROM d GROUP BY user_id""",
)
def nearest_peak_offset(spark, sf):
    s = series(spark, sf)
    near = joins.nearest(s.where("event_type = 'click'").select("user_id", "i"), so.local_maxima(s, U).where("v >= 60").select("user_id", "i"), U, "i", 5)
    return near.groupBy("user_id").agg(F.count("lag").alias("heard"), (F.count("*") - F.count("lag")).alias("silent"), F.median("lag").alias("lead"))


_LS = f"ls AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY d) - 1 AS i, a, b FROM (SELECT user_id, t // {24 * HOUR} AS d, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type <> 'click') AS b FROM ev GROUP BY ALL))"


@query(
    "lag_scan_corr",
    f"{EV}, {_LS}, p AS (SELECT y.user_id, l AS lag, sum(x.a * y.b)::BIGINT AS dot, count(*) AS n FROM ls y, (SELECT unnest(range(-4, 5)) AS l) JOIN ls x ON x.user_id = y.user_id AND x.i = y.i - l GROUP BY ALL) SELECT user_id, lag, dot, n FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY dot DESC, lag) = 1",
)
def lag_scan_corr(spark, sf):
    click = F.col("event_type") == "click"
    daily = events(spark, sf).groupBy("user_id", F.floor(F.col("t") / (24 * HOUR)).alias("d")).agg(F.count_if(click).alias("a"), F.count_if(~click).alias("b"))
    s = daily.withColumn("i", (F.row_number().over(Window.partitionBy("user_id").orderBy("d")) - 1).cast("bigint"))
    return so.lag_scan(s, U, "a", "b", 4).select("user_id", F.col("lag").cast("bigint").alias("lag"), "dot", "n")


@query(
    "k_of_n_vote",
    f"""{EV}, p AS (SELECT DISTINCT user_id, event_type, t // {HOUR} AS i FROM ev), v AS (SELECT user_id, i + x AS i, count(DISTINCT event_type) AS votes FROM p, (SELECT unnest(range(-3, 4)) AS x) GROUP BY ALL HAVING count(DISTINCT event_type) >= 3),
f AS (SELECT *, CASE WHEN i - lag(i) OVER w <= 2 THEN 0 ELSE 1 END AS nw FROM v WINDOW w AS (PARTITION BY user_id ORDER BY i)), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT user_id, min(i) AS i, max(i) AS last, max(votes) AS votes FROM g GROUP BY user_id, g""",
)
def k_of_n_vote(spark, sf):
    p = events(spark, sf).select("user_id", "event_type", F.floor(F.col("t") / HOUR).alias("i")).distinct()
    return so.vote(p, U, "event_type", 3, 3, 2)


@query(
    "zero_filled_histogram",
    f"{EV}, c AS (SELECT user_id, t // {24 * HOUR} AS cell, count(*) AS n FROM ev GROUP BY ALL), g AS (SELECT user_id, unnest(range(min(cell), max(cell) + 1)) AS cell FROM c GROUP BY user_id) SELECT user_id, cell, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (user_id, cell)",
)
def zero_filled_histogram(spark, sf):
    return so.histogram(events(spark, sf), U, 24 * HOUR)


@query(
    "density_outlier_bins",
    f"""{EV}, c AS (SELECT user_id, t // {24 * HOUR} AS cell, count(*) AS n FROM ev GROUP BY ALL), g AS (SELECT user_id, unnest(range(min(cell), max(cell) + 1)) AS cell FROM c GROUP BY user_id), h AS (SELECT user_id, cell, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (user_id, cell)),
m AS (SELECT user_id, median(n::DOUBLE) AS md FROM h GROUP BY 1), d AS (SELECT user_id, md, median(abs(n - md)) AS mad FROM h JOIN m USING (user_id) GROUP BY ALL) SELECT user_id, cell, n FROM h JOIN d USING (user_id) WHERE n > md + 4 * mad""",
)
def density_outlier_bins(spark, sf):
    from ..functions import stats

    h = so.histogram(events(spark, sf), U, 24 * HOUR)
    return h.join(stats.mad(h, U, "n").select("user_id", "limit"), "user_id").where("n > limit").select("user_id", "cell", "n")


@query(
    "linear_interpolation",
    f"""{EV}, p AS (SELECT user_id, t, max(value) AS v FROM ev WHERE event_type = 'view' GROUP BY ALL), g AS (SELECT DISTINCT user_id, t // {24 * HOUR} * {24 * HOUR} AS t FROM ev),
n AS (SELECT g.user_id, g.t, a.t AS ta, a.v AS va, b.t AS tb, b.v AS vb FROM g ASOF LEFT JOIN p a ON g.user_id = a.user_id AND g.t >= a.t ASOF LEFT JOIN p b ON g.user_id = b.user_id AND g.t <= b.t)
SELECT user_id, t, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va ELSE va + (t - ta) / (tb - ta)::DOUBLE * (vb - va) END, 4) AS v FROM n""",
)
def linear_interpolation(spark, sf):
    e = events(spark, sf)
    p = e.where("event_type = 'view'").groupBy("user_id", "t").agg(F.max("value").alias("v"))
    g = e.select("user_id", (F.floor(F.col("t") / (24 * HOUR)) * (24 * HOUR)).alias("t")).distinct()
    return so.interpolated(p, g, U).select("user_id", "t", r("v", 4).alias("v"))


_REC = """RECURSIVE_ AS (SELECT user_id, i, t, event_id, true AS keep, t AS last FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.t, n.event_id, n.t - r.last >= {gap}, CASE WHEN n.t - r.last >= {gap} THEN n.t ELSE r.last END FROM RECURSIVE_ r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)"""


@query(
    "refractory_events",
    EV.replace("WITH", "WITH RECURSIVE") + ", n AS (SELECT user_id, t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev), " + _REC.replace("RECURSIVE_", "rr").format(gap=6 * HOUR) + " SELECT user_id, event_id FROM rr WHERE keep",
)
def refractory_events(spark, sf):
    return kernels.refractory(events(spark, sf).select("user_id", "t", "event_id"), U, 6 * HOUR, "t", ["event_id"]).select("user_id", "event_id")


@query(
    "rising_edges_refractory",
    SER.replace("WITH", "WITH RECURSIVE") + f""", d AS (SELECT user_id, i, v, v - lag(v) OVER (PARTITION BY user_id ORDER BY i) AS rise FROM ser), c AS (SELECT user_id, i AS t, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM d WHERE v >= 40 AND rise >= 10),
rr AS (SELECT user_id, k, t, true AS keep, t AS last FROM c WHERE k = 1 UNION ALL SELECT c.user_id, c.k, c.t, c.t - rr.last >= 4, CASE WHEN c.t - rr.last >= 4 THEN c.t ELSE rr.last END FROM rr JOIN c ON c.user_id = rr.user_id AND c.k = rr.k + 1) SELECT user_id, t AS i FROM rr WHERE keep""",
)
def rising_edges_refractory(spark, sf):
    return kernels.rising_edges(series(spark, sf).select("user_id", "i", "v"), U, 40, 10, 4, "v").select("user_id", "i")


@query(
    "hysteresis_mask",
    SER.replace("WITH", "WITH RECURSIVE") + """, h AS (SELECT user_id, i, v, v >= 60 AS st, 0 AS quiet FROM ser WHERE i = 0 UNION ALL SELECT s.user_id, s.i, s.v, CASE WHEN h.st THEN (CASE WHEN s.v >= 20 THEN 0 ELSE h.quiet + 1 END) <= 2 ELSE s.v >= 60 END, CASE WHEN h.st AND s.v < 20 THEN h.quiet + 1 ELSE 0 END FROM h JOIN ser s ON s.user_id = h.user_id AND s.i = h.i + 1)
SELECT user_id, i, st AS on_ FROM h""",
)
def hysteresis_mask(spark, sf):
    return kernels.hysteresis(series(spark, sf).select("user_id", "i", "v"), U, 60, 20, 2, "v").select("user_id", "i", F.col("on").alias("on_"))


@query(
    "min_separation_dedup",
    SER.replace("WITH", "WITH RECURSIVE") + """, c AS (SELECT user_id, i AS t, v, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM ser WHERE v >= 25),
rr AS (SELECT user_id, k, t AS lt, v AS lv, 1 AS slot FROM c WHERE k = 1 UNION ALL SELECT c.user_id, c.k, CASE WHEN c.t - rr.lt < 4 AND c.v <= rr.lv THEN rr.lt ELSE c.t END, CASE WHEN c.t - rr.lt < 4 AND c.v <= rr.lv THEN rr.lv ELSE c.v END, CASE WHEN c.t - rr.lt < 4 THEN rr.slot ELSE rr.slot + 1 END FROM rr JOIN c ON c.user_id = rr.user_id AND c.k = rr.k + 1)
SELECT user_id, lt AS i FROM rr QUALIFY row_number() OVER (PARTITION BY user_id, slot ORDER BY k DESC) = 1""",
)
def min_separation_dedup(spark, sf):
    return kernels.min_separation(series(spark, sf).where("v >= 25").select("user_id", "i", "v"), U, 4, "v", "i").select("user_id", "i")


#: Highest first, none closer than {reach} to one taken, at most {quota}: a fold over the rank with the taken places as state.
_NMS = """c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, place, id) AS k FROM ({rows})), rr AS (SELECT user_id, k, [place] AS taken, [id] AS ids FROM c WHERE k = 1
UNION ALL SELECT user_id, k, CASE WHEN ok THEN list_append(taken, place) ELSE taken END, CASE WHEN ok THEN list_append(ids, id) ELSE ids END
FROM (SELECT c.user_id, c.k, c.place, c.id, taken, ids, len(taken) < {quota} AND len(list_filter(taken, lambda y: abs(y - c.place) < {reach})) = 0 AS ok FROM rr JOIN c ON c.user_id = rr.user_id AND c.k = rr.k + 1)),
z AS (SELECT user_id, unnest(ids) AS id FROM (SELECT user_id, ids FROM rr QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1))"""


@query("nms_quota", SER.replace("WITH", "WITH RECURSIVE") + ", " + _NMS.format(rows="SELECT user_id, v, t AS place, event_id AS id FROM ser", quota=10, reach=6 * HOUR) + " SELECT user_id, id AS event_id FROM z")
def nms_quota(spark, sf):
    """Highest events first, six hours apart, at most ten a user."""
    return kernels.suppressed(series(spark, sf).select("user_id", "event_id", "t", "v"), U, 6 * HOUR, "v", "t", ["event_id"], quota=10).select("user_id", "event_id")


@query(
    "peaks_with_distance",
    SER.replace("WITH", "WITH RECURSIVE")
    + ", f AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM ser), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY i) AS g FROM f), "
    + "u AS (SELECT user_id, v, (a + b) // 2 AS place, lag(v) OVER w AS l, lead(v) OVER w AS r FROM (SELECT user_id, g, min(i) AS a, max(i) AS b, any_value(v) AS v FROM g GROUP BY ALL) WINDOW w AS (PARTITION BY user_id ORDER BY g)), "
    + _NMS.format(rows="SELECT user_id, v, place, place AS id FROM u WHERE l < v AND r < v AND v >= 30", quota=1000000, reach=5)
    + " SELECT user_id, i, v FROM z JOIN ser USING (user_id) WHERE i = id",
)
def peaks_with_distance(spark, sf):
    return kernels.peaks(series(spark, sf).select("user_id", "i", "v"), U, 5, 30.0)


@query(
    "first_fit_placement",
    EV + f""", s AS (SELECT user_id, event_id, t, 1 + event_id % 7 AS n FROM ev), c AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM s) SELECT user_id, event_id, place FROM c WHERE place + n <= 100""",
)
def first_fit_placement(spark, sf):
    s = events(spark, sf).select("user_id", "event_id", "t", (1 + F.col("event_id") % 7).alias("n"))
    return kernels.placed(s, U, "n", 100, 1, "t").select("user_id", "event_id", F.col("at").alias("place"))
