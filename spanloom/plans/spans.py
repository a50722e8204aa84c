"""Interval queries: events padded to spans, in integer microseconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from .base import EV, HOUR, MONTH, SER, events, load, query, r, series

U = ["user_id"]
#: Padded, merged spans of one event type in SQL.
_PAD = "SELECT user_id, t - {a} AS s, t + {b} AS e FROM ev WHERE event_type = '{k}'"


def _merge(name: str, body: str, gap: int = 0) -> str:
    return f"""{name}_i AS (SELECT *, CASE WHEN s > max(e) OVER w + {gap} OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM ({body}) WINDOW w AS (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}_i),
{name} AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS parts FROM {name}_g GROUP BY user_id, g)"""


def _pad(kind: str, a: int = 1, b: int = 8) -> str:
    return _PAD.format(a=a * HOUR, b=b * HOUR, k=kind)


def padded(spark, sf, kind: str | None, a: int = 1, b: int = 8):
    df = events(spark, sf, *([kind] if kind else []))
    return iv.spans_of(df, "t", a * HOUR, b * HOUR).select("user_id", "s", "e")


ALL = f"SELECT user_id, t - {HOUR} AS s, t + {8 * HOUR} AS e FROM ev"


@query(
    "span_merge_stats",
    f"""{EV}, {_merge("m", ALL)}
SELECT user_id, count(*) AS n_spans, sum(e - s)::BIGINT AS total, median((e - s)::DOUBLE) AS median, quantile_cont((e - s)::DOUBLE, 0.9) AS p90, max(e - s) AS longest FROM m GROUP BY user_id""",
)
def span_merge_stats(spark, sf):
    return iv.dwell(iv.merged(padded(spark, sf, None), U), U)


@query(
    "span_bridge",
    f"""{EV}, {_merge("m", ALL)}, {_merge("b", "SELECT user_id, s, e FROM m", 4 * HOUR)}
SELECT user_id, count(*) AS n_spans, sum(parts - 1)::BIGINT AS bridges, sum(e - s)::BIGINT AS total FROM b GROUP BY user_id""",
)
def span_bridge(spark, sf):
    m = iv.merged(padded(spark, sf, None), U).drop("parts")
    return iv.merged(m, U, 4 * HOUR).groupBy("user_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("parts") - 1).alias("bridges"), F.sum(F.col("e") - F.col("s")).alias("total"))


def _sweep(**sides: str) -> str:
    names = list(sides)
    edges = " UNION ALL ".join(
        f"SELECT user_id, {c} AS spot, " + ", ".join(f"{sign if n == m else 0} AS d_{m}" for m in names) + f" FROM ({body})" for n, body in sides.items() for c, sign in (("s", 1), ("e", -1))
    )
    sums = ", ".join(f"sum(sum(d_{n})) OVER w AS {n}" for n in names)
    return f"""edge AS ({edges}), piece AS (SELECT user_id, spot AS s, lead(spot) OVER (PARTITION BY user_id ORDER BY spot) AS e, {sums} FROM edge GROUP BY user_id, spot WINDOW w AS (PARTITION BY user_id ORDER BY spot ROWS UNBOUNDED PRECEDING))"""


@query(
    "span_partition_seconds",
    f"""{EV}, {_sweep(allowed=_pad("purchase"), rest=_pad("view"), whole="SELECT DISTINCT user_id, epoch_us(TIMESTAMP '2024-01-01') AS s, epoch_us(TIMESTAMP '2024-01-31') AS e FROM ev")}
SELECT user_id, coalesce(sum(e - s) FILTER (allowed > 0), 0)::BIGINT AS allowed, coalesce(sum(e - s) FILTER (rest > 0), 0)::BIGINT AS rest,
coalesce(sum(e - s) FILTER (allowed > 0 AND rest > 0), 0)::BIGINT AS contested, coalesce(sum(e - s) FILTER (whole > 0 AND allowed = 0 AND rest = 0), 0)::BIGINT AS unlabelled
FROM piece WHERE e > s GROUP BY user_id""",
)
def span_partition_seconds(spark, sf):
    start = 1_704_067_200_000_000
    whole = events(spark, sf).select("user_id").distinct().select("user_id", F.lit(start).alias("s"), F.lit(start + MONTH).alias("e"))
    p = iv.partitioned({"allowed": padded(spark, sf, "purchase"), "rest": padded(spark, sf, "view"), "whole": whole}, U)
    n, total = F.col("e") - F.col("s"), lambda c: F.coalesce(F.sum(F.when(c, F.col("e") - F.col("s"))), F.lit(0))
    a, b = F.col("allowed") > 0, F.col("rest") > 0
    return p.groupBy("user_id").agg(total(a).alias("allowed"), total(b).alias("rest"), total(a & b).alias("contested"), total((F.col("whole") > 0) & ~a & ~b).alias("unlabelled"))


@query(
    "span_overlap_ratio",
    f"""{EV}, {_sweep(a=_pad("click"), b=_pad("purchase", 2, 2))}
SELECT user_id, coalesce(sum(e - s) FILTER (a > 0), 0)::BIGINT AS open, coalesce(sum(e - s) FILTER (a > 0 AND b > 0), 0)::BIGINT AS useful,
round(coalesce(coalesce(sum(e - s) FILTER (a > 0 AND b > 0), 0) / nullif(sum(e - s) FILTER (a > 0), 0), 0), 6) AS ratio FROM piece WHERE e > s GROUP BY user_id""",
)
def span_overlap_ratio(spark, sf):
    p = iv.partitioned({"a": padded(spark, sf, "click"), "b": padded(spark, sf, "purchase", 2, 2)}, U)
    n = F.col("e") - F.col("s")
    out = p.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(F.col("a") > 0, n)), F.lit(0)).alias("open"), F.coalesce(F.sum(F.when((F.col("a") > 0) & (F.col("b") > 0), n)), F.lit(0)).alias("useful")
    )
    return out.withColumn("ratio", r(F.coalesce(F.col("useful") / F.when(F.col("open") > 0, F.col("open")), F.lit(0.0))))


@query(
    "span_uncovered_seconds",
    f"""{EV}, {_sweep(a=_pad("signup"), b=_pad("error"))} SELECT user_id, sum(e - s)::BIGINT AS uncovered, count(*) AS pieces FROM piece WHERE e > s AND a > 0 AND b = 0 GROUP BY user_id""",
)
def span_uncovered_seconds(spark, sf):
    d = iv.without(padded(spark, sf, "signup"), padded(spark, sf, "error"), U)
    return d.groupBy("user_id").agg(F.sum(F.col("e") - F.col("s")).alias("uncovered"), F.count("*").alias("pieces"))


@query(
    "span_intersection",
    f"""{EV}, {_sweep(a=_pad("signup"), b=_pad("error"))} SELECT user_id, sum(e - s)::BIGINT AS shared FROM piece WHERE e > s AND a > 0 AND b > 0 GROUP BY user_id""",
)
def span_intersection(spark, sf):
    return iv.measure(iv.shared(padded(spark, sf, "signup"), padded(spark, sf, "error"), U), U, "shared")


@query(
    "span_circular_shift_control",
    f"""{EV}, p AS (SELECT user_id, ((t - epoch_us(TIMESTAMP '2024-01-01')) + {MONTH // 2}) % {MONTH} AS s FROM ev WHERE event_type = 'click'),
q AS (SELECT user_id, s, least(s + {3 * HOUR}, {MONTH}) AS e FROM p UNION ALL SELECT user_id, 0, s + {3 * HOUR} - {MONTH} FROM p WHERE s + {3 * HOUR} > {MONTH}),
{_merge("m", "SELECT user_id, s, e FROM q")} SELECT user_id, count(*) AS n_spans, sum(e - s)::BIGINT AS total FROM m GROUP BY user_id""",
)
def span_circular_shift_control(spark, sf):
    rel = events(spark, sf, "click").select("user_id", (F.col("t") - 1_704_067_200_000_000).alias("s"))
    moved = iv.shifted(rel.withColumn("e", F.col("s") + 3 * HOUR), MONTH // 2, MONTH)
    return iv.merged(moved, U).groupBy("user_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("e") - F.col("s")).alias("total"))


@query(
    "span_clip_to_segments",
    f"""{EV}, s AS (SELECT user_id, t AS s, t + {30 * HOUR} AS e FROM ev WHERE event_type = 'purchase'),
c AS (SELECT user_id, s, e, unnest(range(s // {24 * HOUR}, (e - 1) // {24 * HOUR} + 1)) AS cell FROM s),
k AS (SELECT DISTINCT user_id, t // {24 * HOUR} AS cell FROM ev WHERE event_type = 'view'),
x AS (SELECT c.user_id, c.cell, greatest(s - c.cell * {24 * HOUR}, 0) AS s, least(e - c.cell * {24 * HOUR}, {24 * HOUR}) AS e FROM c JOIN k USING (user_id, cell))
SELECT user_id, cell, count(*) AS n, sum(e - s)::BIGINT AS total FROM x WHERE e - s >= {HOUR} GROUP BY user_id, cell""",
)
def span_clip_to_segments(spark, sf):
    day = 24 * HOUR
    spans = events(spark, sf, "purchase").select("user_id", F.col("t").alias("s"), (F.col("t") + 30 * HOUR).alias("e"))
    segments = events(spark, sf, "view").select("user_id", F.floor(F.col("t") / day).alias("cell")).distinct()
    return iv.clipped(spans, segments, U, day, HOUR).groupBy("user_id", "cell").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("total"))


@query(
    "point_in_span",
    f"""{EV}, {_merge("m", _pad("click"))}, p AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'error')
SELECT p.user_id, p.event_id, p.t, coalesce(p.t <= q.e, false) AS inside, CASE WHEN p.t <= q.e THEN least(p.t - q.s, q.e - p.t) END AS edge FROM p ASOF LEFT JOIN m q ON p.user_id = q.user_id AND p.t >= q.s""",
)
def point_in_span(spark, sf):
    pts = events(spark, sf, "error").select("user_id", "event_id", "t")
    return iv.inside(pts, padded(spark, sf, "click"), U)


@query(
    "span_coverage_fraction",
    f"""{EV}, {_merge("m", _pad("click"))}, p AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'error')
SELECT p.user_id, count(*) AS n, count(*) FILTER (p.t <= q.e) AS covered, round(avg(CASE WHEN coalesce(p.t <= q.e, false) THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS fraction FROM p ASOF LEFT JOIN m q ON p.user_id = q.user_id AND p.t >= q.s GROUP BY p.user_id""",
)
def span_coverage_fraction(spark, sf):
    hit = F.col("inside").cast("int")
    return point_in_span(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(hit).alias("covered"), r(F.avg(hit.cast("double"))).alias("fraction"))


@query(
    "false_windows",
    f"""{EV}, {_merge("m", _pad("click"))}, c AS (SELECT user_id, s, e, (s + e) // 2 AS t FROM m)
SELECT user_id, s, e FROM c WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = c.user_id AND event_type = 'purchase' AND abs(ev.t - c.t) <= {6 * HOUR})""",
)
def false_windows(spark, sf):
    from ..operators import joins

    c = iv.merged(padded(spark, sf, "click"), U).drop("parts").withColumn("t", F.expr("(s + e) div 2"))
    return joins.within(c, events(spark, sf, "purchase").select("user_id", "t"), U, 6 * HOUR, absent=True).drop("t")


@query(
    "lost_windows",
    f"""{EV}, {_merge("a", _pad("click"))}, {_merge("m", _pad("view"))}, p AS (SELECT user_id, s, e, (s + e) // 2 AS t FROM a)
SELECT p.user_id, p.s, p.e FROM p ASOF LEFT JOIN m q ON p.user_id = q.user_id AND p.t >= q.s WHERE NOT coalesce(p.t <= q.e, false)""",
)
def lost_windows(spark, sf):
    a = iv.merged(padded(spark, sf, "click"), U).select("user_id", F.col("s").alias("_s"), F.col("e").alias("_e"), F.expr("(s + e) div 2").alias("t"))
    return iv.inside(a, padded(spark, sf, "view"), U).where(~F.col("inside")).select("user_id", F.col("_s").alias("s"), F.col("_e").alias("e"))


@query(
    "hole_seconds",
    f"""{EV}, {_sweep(a=_pad("purchase", 24, 24), b=_pad("click", 3, 3))}, h AS (SELECT user_id, s, e FROM piece WHERE e > s AND a > 0 AND b = 0), {_merge("m", "SELECT * FROM h")}
SELECT user_id, sum(e - s)::BIGINT AS hole, max(e - s) AS longest FROM m GROUP BY user_id""",
)
def hole_seconds(spark, sf):
    holes = iv.merged(iv.without(padded(spark, sf, "purchase", 24, 24), padded(spark, sf, "click", 3, 3), U), U)
    return holes.groupBy("user_id").agg(F.sum(F.col("e") - F.col("s")).alias("hole"), F.max(F.col("e") - F.col("s")).alias("longest"))


_FRAMES = f"f AS (SELECT user_id, t // {HOUR} AS s, t // {HOUR} + 2 + event_id % 9 AS e FROM ev WHERE event_type = 'click')"
_ENV = f"""{_FRAMES}, fi AS (SELECT user_id, s, e, unnest(range(s, e)) AS i FROM f),
r AS (SELECT *, least(3, e - s) AS a, least(5, e - s) AS b FROM fi),
env AS (SELECT user_id, i, max(least(CASE WHEN i - s < a AND a > 1 THEN 0.5 - 0.5 * cos(pi() * (i - s) / (a - 1)) ELSE 1.0 END, CASE WHEN e - 1 - i < b AND b > 1 THEN 0.5 - 0.5 * cos(pi() * (e - 1 - i) / (b - 1)) ELSE 1.0 END)) AS g FROM r GROUP BY user_id, i)"""


def envelope(spark, sf):
    f = events(spark, sf, "click").withColumn("s", F.floor(F.col("t") / HOUR)).withColumn("e", F.col("s") + 2 + F.col("event_id") % 9)
    return iv.envelope(f.select("user_id", "s", "e"), U, 3, 5)


@query("envelope_frames", f"{EV}, {_ENV} SELECT user_id, i, round(g, 6) AS g FROM env")
def envelope_frames(spark, sf):
    return envelope(spark, sf).select("user_id", "i", r("g").alias("g"))


@query(
    "gate_support",
    f"""{EV}, {_ENV}, n AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM env WHERE g > 0), l AS (SELECT user_id, max(c) AS longest FROM (SELECT user_id, k, count(*) AS c FROM n GROUP BY user_id, k) GROUP BY user_id)
SELECT env.user_id, round(sum(g) / 720, 4) AS mean_gain, round(count(*) FILTER (g > 0) / 720, 6) AS open, round(count(*) FILTER (g >= 0.5) / 720, 6) AS half_open, any_value(longest) AS longest FROM env JOIN l USING (user_id) GROUP BY env.user_id""",
)
def gate_support(spark, sf):
    """Gains are added as decimals: rises and falls then make whole sums, whatever the order of frames, and a mean halfway between two digits is rounded as such."""
    from pyspark.sql import Window

    env = envelope(spark, sf)
    held = env.where("g > 0").withColumn("k", F.col("i") - F.row_number().over(Window.partitionBy("user_id").orderBy("i")))
    longest = held.groupBy("user_id", "k").count().groupBy("user_id").agg(F.max("count").alias("longest"))
    stats = env.groupBy("user_id").agg(
        r(F.sum(F.col("g").cast("decimal(18, 12)")).cast("double") / 720, 4).alias("mean_gain"), r(F.count_if(F.col("g") > 0) / 720).alias("open"), r(F.count_if(F.col("g") >= 0.5) / 720).alias("half_open")
    )
    return stats.join(longest, "user_id")


@query(
    "contact_support",
    f"""{EV}, {_ENV}, p AS (SELECT user_id, event_id, t // {HOUR} AS i FROM ev WHERE event_type = 'purchase')
SELECT p.user_id, p.event_id, round(coalesce(max(g) FILTER (env.i = p.i), 0), 6) AS at_event, round(coalesce(max(g) FILTER (abs(env.i - p.i) <= 2), 0), 6) AS near, round(coalesce(max(g), 0), 6) AS wide
FROM p LEFT JOIN env ON env.user_id = p.user_id AND env.i BETWEEN p.i - 5 AND p.i + 5 GROUP BY p.user_id, p.event_id""",
)
def contact_support(spark, sf):
    p = events(spark, sf, "purchase").select("user_id", "event_id", F.floor(F.col("t") / HOUR).alias("at"))
    near = p.withColumn("i", F.explode(F.sequence(F.col("at") - 5, F.col("at") + 5))).join(envelope(spark, sf), ["user_id", "i"], "left")
    top = lambda reach: r(F.coalesce(F.max(F.when(F.abs(F.col("i") - F.col("at")) <= reach, F.col("g"))), F.lit(0.0)))
    return near.groupBy("user_id", "event_id").agg(top(0).alias("at_event"), top(2).alias("near"), top(5).alias("wide"))


@query(
    "exposure_partition",
    f"""{EV}, {_ENV}, k AS (SELECT user_id, i, g, EXISTS (SELECT 1 FROM ev p WHERE p.user_id = env.user_id AND p.event_type = 'purchase' AND p.t // {HOUR} BETWEEN env.i - 4 AND env.i + 4) AS allowed,
EXISTS (SELECT 1 FROM ev p WHERE p.user_id = env.user_id AND p.event_type = 'view' AND p.t // {HOUR} BETWEEN env.i - 4 AND env.i + 4) AS rest FROM env)
SELECT CASE WHEN allowed THEN 'allowed' WHEN rest THEN 'rest' ELSE 'unlabelled' END AS part, count(*) FILTER (g > 0) AS open_frames, count(*) FILTER (g >= 0.5) AS half_frames, round(avg(g), 6) AS mean_gain FROM k GROUP BY 1""",
)
def exposure_partition(spark, sf):
    def mask(kind):
        at = events(spark, sf, kind).select("user_id", F.floor(F.col("t") / HOUR).alias("f"))
        return at.select("user_id", F.explode(F.sequence(F.col("f") - 4, F.col("f") + 4)).alias("i")).distinct().withColumn(kind, F.lit(True))

    k = envelope(spark, sf).join(mask("purchase"), ["user_id", "i"], "left").join(mask("view"), ["user_id", "i"], "left")
    part = F.when(F.col("purchase"), "allowed").when(F.col("view"), "rest").otherwise("unlabelled")
    return k.groupBy(part.alias("part")).agg(F.count_if(F.col("g") > 0).alias("open_frames"), F.count_if(F.col("g") >= 0.5).alias("half_frames"), r(F.avg("g")).alias("mean_gain"))


@query(
    "burst_region_coverage",
    f"""{EV}, b AS (SELECT DISTINCT user_id, unnest(range(t // {HOUR}, t // {HOUR} + 4)) AS i, 1 AS x FROM ev WHERE event_type = 'click'), g AS (SELECT DISTINCT user_id, unnest(range(t // {HOUR} - 1, t // {HOUR} + 3)) AS i, 1 AS y FROM ev WHERE event_type = 'view')
SELECT user_id, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS covered, count(*) FILTER (y IS NULL) AS false_frames, count(*) FILTER (x IS NULL) AS missed_frames FROM b FULL JOIN g USING (user_id, i) GROUP BY user_id""",
)
def burst_region_coverage(spark, sf):
    def frames(kind, low, high, name):
        at = events(spark, sf, kind).select("user_id", F.floor(F.col("t") / HOUR).alias("f"))
        return at.select("user_id", F.explode(F.sequence(F.col("f") + low, F.col("f") + high)).alias("i")).distinct().withColumn(name, F.lit(1))

    m = frames("click", 0, 3, "x").join(frames("view", -1, 2, "y"), ["user_id", "i"], "full_outer")
    return m.groupBy("user_id").agg(
        F.count_if((F.col("x") == 1) & (F.col("y") == 1)).alias("covered"), F.count_if(F.col("y").isNull()).alias("false_frames"), F.count_if(F.col("x").isNull()).alias("missed_frames")
    )


@query(
    "typed_spans",
    f"""{EV}, b AS (SELECT user_id, event_type, t, max(CASE WHEN event_type <> 'view' THEN t END) OVER (PARTITION BY user_id ORDER BY t, event_type ROWS UNBOUNDED PRECEDING) AS base FROM ev WHERE event_type IN ('click', 'view'))
SELECT user_id, base - {HOUR} AS s, max(t) + {2 * HOUR} AS e FROM b WHERE base IS NOT NULL AND (event_type <> 'view' OR t - base <= {6 * HOUR}) GROUP BY user_id, base""",
)
def typed_spans(spark, sf):
    return iv.typed(events(spark, sf, "click", "view"), U, "t", "event_type", "view", HOUR, 2 * HOUR, 6 * HOUR)


@query(
    "order_ship_dwell",
    """WITH s AS (SELECT o_orderpriority AS p, date_diff('day', o_orderdate, l_shipdate) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate)
SELECT p AS priority, count(*) AS n_spans, sum(d)::BIGINT AS total, median(d::DOUBLE) AS median, quantile_cont(d::DOUBLE, 0.9) AS p90, max(d) AS longest FROM s GROUP BY p""",
)
def order_ship_dwell(spark, sf):
    o, l = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    j = o.join(l, o.o_orderkey == l.l_orderkey).where("l_shipdate > o_orderdate")
    spans = j.select(F.col("o_orderpriority").alias("priority"), F.lit(0).cast("bigint").alias("s"), F.datediff("l_shipdate", "o_orderdate").cast("bigint").alias("e"))
    return iv.dwell(spans, ["priority"])


_AD = """c AS (SELECT user_id, i AS p, v AS a FROM ser WHERE event_type = 'click' AND v >= 20), n AS (SELECT c.user_id, c.p, c.a, s.i, s.v, max(s.v) FILTER (s.i >= c.p) OVER (PARTITION BY c.user_id, c.p) AS top FROM c JOIN ser s ON s.user_id = c.user_id AND s.i BETWEEN c.p - 5 AND c.p + 8),
ad AS (SELECT user_id, coalesce(max(i) FILTER (i < p AND v <= 0.18 * a), p - 5) AS s, coalesce(min(i) FILTER (i >= p AND v <= 0.3 * top), p + 8) AS e FROM n GROUP BY user_id, p)"""


@query("adaptive_spans", f"{SER}, {_AD}, {_merge('m', 'SELECT user_id, s, e FROM ad')} SELECT user_id, s, e, parts FROM m")
def adaptive_spans(spark, sf):
    s = series(spark, sf)
    peaks = s.where("event_type = 'click' and v >= 20")
    return iv.merged(iv.adaptive(s, peaks, U, 5, 8, 0.18, 0.3), U)


@query(
    "event_dynamics",
    f"""{SER}, sm AS (SELECT *, sum(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS o FROM ser), p AS (SELECT c.user_id, c.i AS event, max(s.v) AS raw_peak, max(s.o) AS out_peak FROM sm c JOIN sm s ON s.user_id = c.user_id AND s.i BETWEEN c.i - 2 AND c.i + 2 WHERE c.event_type = 'purchase' GROUP BY c.user_id, c.i)
SELECT user_id, event, raw_peak, round(out_peak / greatest(raw_peak, 1e-9), 5) AS ratio, round(abs(ln(out_peak / greatest(raw_peak, 1e-9))), 5) AS log_error, out_peak / greatest(raw_peak, 1e-9) < 0.5 AS missed FROM p""",
)
def event_dynamics(spark, sf):
    from ..operators.series import moving_average

    s = moving_average(series(spark, sf), U, 3, out="o")
    d = iv.dynamics(s, s.where("event_type = 'purchase'"), U, 2, "v", "o", 0.5)
    return d.select("user_id", "event", "raw_peak", r("ratio", 5).alias("ratio"), r("log_error", 5).alias("log_error"), "missed")
