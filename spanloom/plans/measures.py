"""Grouped statistics and vector measures."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import stats
from ..operators import ranges
from .base import EV, HOUR, events, load, query, r

LI = "lineitem"


@query("quantile_table", "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM lineitem GROUP BY l_returnflag")
def quantile_table(spark, sf):
    q = stats.exact_quantiles(load(spark, sf, LI), ["l_returnflag"], "l_extendedprice", (0.1, 0.25, 0.5, 0.75, 0.9))
    return q.select("l_returnflag", *[r(F.col("q")[i], 4).alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))])


@query("summary_struct", "SELECT l_shipmode_ AS k, round(median(l_quantity), 4) AS median, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS n FROM (SELECT l_linenumber AS l_shipmode_, l_quantity FROM lineitem) GROUP BY 1")
def summary_struct(spark, sf):
    s = stats.summary(load(spark, sf, LI).withColumnRenamed("l_linenumber", "k"), ["k"], "l_quantity")
    return s.select("k", r("median", 4).alias("median"), r("mean", 4).alias("mean"), "low", "high", "n")


@query("median_of_finite", "SELECT user_id, round(median(CASE WHEN value < 3 THEN NULL WHEN value > 90 THEN NULL ELSE value END), 4) AS median FROM events GROUP BY user_id")
def median_of_finite(spark, sf):
    odd = F.when(F.col("value") < 3, F.lit(float("nan"))).when(F.col("value") > 90, F.lit(float("inf"))).otherwise(F.col("value"))
    return events(spark, sf).withColumn("x", odd).groupBy("user_id").agg(r(F.median(stats.finite("x")), 4).alias("median"))


@query(
    "two_level_medians",
    "SELECT 'variant' AS grp, l_returnflag AS variant, NULL AS level, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 2 UNION ALL SELECT 'level', l_returnflag, l_linenumber, round(median(l_extendedprice), 4) FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY 2, 3",
)
def two_level_medians(spark, sf):
    li = load(spark, sf, LI)
    a = li.groupBy(F.col("l_returnflag").alias("variant")).agg(r(F.median("l_extendedprice"), 4).alias("median"))
    b = li.where("l_linenumber in (1, 2, 3)").groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("level")).agg(r(F.median("l_extendedprice"), 4).alias("median"))
    return a.select(F.lit("variant").alias("grp"), "variant", F.lit(None).cast("int").alias("level"), "median").unionByName(b.select(F.lit("level").alias("grp"), "variant", "level", "median"))


@query("max_share", "WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, sum(n)::BIGINT AS total, count(*) AS users, round(max(n) / sum(n), 6) AS share FROM c GROUP BY event_type")
def max_share(spark, sf):
    c = events(spark, sf).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return c.groupBy("event_type").agg(F.sum("n").alias("total"), F.count("*").alias("users"), r(F.max("n") / F.sum("n")).alias("share"))


_REASONS = "array_to_string(list_filter([CASE WHEN l_quantity < 5 THEN 'few' END, CASE WHEN l_discount > 0.08 THEN 'cheap' END, CASE WHEN l_tax > 0.06 THEN 'taxed' END], lambda x: x IS NOT NULL), ',')"


def _reasons():
    return sc.reasons(("few", F.col("l_quantity") < 5), ("cheap", F.col("l_discount") > 0.08), ("taxed", F.col("l_tax") > 0.06))


@query("reason_codes", f"SELECT l_orderkey, l_linenumber, l_partkey, {_REASONS} AS reasons FROM lineitem")
def reason_codes(spark, sf):
    return load(spark, sf, LI).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(_reasons(), ",").alias("reasons"))


@query("reason_histogram", f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(z, ',')) AS reason FROM (SELECT {_REASONS} AS z FROM lineitem) WHERE z <> '') GROUP BY reason")
def reason_histogram(spark, sf):
    return load(spark, sf, LI).select(F.explode(_reasons()).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("group_rate", "SELECT l_returnflag, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate, count(*) AS n FROM lineitem GROUP BY 1")
def group_rate(spark, sf):
    return load(spark, sf, LI).groupBy("l_returnflag").agg(r(F.avg((F.col("l_discount") > 0.05).cast("double"))).alias("rate"), F.count("*").alias("n"))


@query("level_stats", "SELECT user_id, round(20 * log10(sqrt(avg(value * value)) + 1e-12), 5) AS rms_db, max(abs(value)) AS peak, round(avg(CASE WHEN value >= 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS clipped, round(avg(value), 5) AS offset_ FROM events GROUP BY user_id")
def level_stats(spark, sf):
    v = F.col("value")
    return events(spark, sf).groupBy("user_id").agg(
        r(sc.amplitude_db(F.sqrt(F.avg(v * v))), 5).alias("rms_db"), F.max(F.abs(v)).alias("peak"), r(F.avg((v >= 100).cast("double"))).alias("clipped"), r(F.avg(v), 5).alias("offset_")
    )


@query("db_and_gain", "SELECT event_id, round(20 * log10(value + 1e-12), 6) AS amplitude, round(10 * log10(greatest(value, 1e-12)), 6) AS power, round(10 * log10(value + 1e-12), 6) AS power_sum, round(10 * log10(greatest(value - 20, 1e-300)), 6) AS power_deep, round(pow(10.0, (value - 40) / 200), 6) AS gain FROM events")
def db_and_gain(spark, sf):
    return events(spark, sf).select(
        "event_id", r(sc.amplitude_db("value")).alias("amplitude"), r(sc.power_db("value")).alias("power"), r(sc.power_db("value", additive=True)).alias("power_sum"), r(sc.power_db(F.col("value") - 20, 1e-300)).alias("power_deep"), r(sc.gain((F.col("value") - 40) / 10)).alias("gain")
    )


@query("time_base_and_index", f"{EV} SELECT event_id, trunc(value * 60.04)::BIGINT AS truncated, round_even(value * 60.04, 0)::BIGINT AS rounded, round(value - (0.25 + 0.001 * value), 6) AS ref_t, least(greatest(value - 10, 0), 50) AS bounded, printf('%d:%02d', floor(value / 60)::INT, floor(value - 60 * floor(value / 60))::INT) AS clock FROM ev")
def time_base_and_index(spark, sf):
    v = F.col("value")
    return events(spark, sf).select(
        "event_id",
        sc.index_truncated(v, 60.04).alias("truncated"),
        sc.index_rounded(v, 60.04).alias("rounded"),
        r(sc.reference_time(v, F.lit(0.25), F.lit(0.001))).alias("ref_t"),
        sc.clamp(v - 10, 0.0, 50.0).alias("bounded"),
        sc.minutes_seconds(v).alias("clock"),
    )


_PAIRS = "WITH d AS (SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem)"


@query("pearson_guarded", f"{_PAIRS} SELECT k, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 5) END AS pearson, count(*) AS n FROM d GROUP BY k")
def pearson_guarded(spark, sf):
    return _corr(spark, sf).select("k", r("pearson", 5).alias("pearson"), "n")


def _corr(spark, sf):
    d = load(spark, sf, LI).select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return stats.correlated(d, ["k"], "x", "y")


@query(
    "spearman_avg_rank",
    f"{_PAIRS}, q AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0 AS ry FROM d) SELECT k, CASE WHEN count(*) >= 3 THEN round(corr(rx::DOUBLE, ry::DOUBLE), 5) END AS spearman FROM q GROUP BY k",
)
def spearman_avg_rank(spark, sf):
    return _corr(spark, sf).select("k", r("spearman", 5).alias("spearman"))


@query("mad_outliers", "WITH m AS (SELECT user_id, median(value) AS c FROM events GROUP BY 1), s AS (SELECT user_id, c, median(abs(value - c)) AS d FROM events JOIN m USING (user_id) GROUP BY ALL) SELECT event_id, round(c + 4 * d, 5) AS lim FROM events JOIN s USING (user_id) WHERE value > c + 4 * d")
def mad_outliers(spark, sf):
    e = events(spark, sf)
    return e.join(stats.mad(e, ["user_id"], "value"), "user_id").where("value > `limit`").select("event_id", r("limit", 5).alias("lim"))


@query("percentile_cap_filter", "WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.85) AS cap FROM lineitem GROUP BY 1) SELECT l_returnflag, count(*) AS kept, max(l_extendedprice) AS top FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice <= cap GROUP BY 1")
def percentile_cap_filter(spark, sf):
    li = load(spark, sf, LI)
    cap = stats.exact_quantiles(li, ["l_returnflag"], "l_extendedprice", [0.85]).select("l_returnflag", F.col("q")[0].alias("cap"))
    return li.join(F.broadcast(cap), "l_returnflag").where("l_extendedprice <= cap").groupBy("l_returnflag").agg(F.count("*").alias("kept"), F.max("l_extendedprice").alias("top"))


@query("verdict_counts", "WITH c AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS n FROM orders GROUP BY 1) SELECT total, count(*) AS customers, count(*) FILTER (2 * n >= total) AS insufficient FROM c GROUP BY total")
def verdict_counts(spark, sf):
    c = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("n"))
    return c.groupBy("total").agg(F.count("*").alias("customers"), F.count_if(2 * F.col("n") >= F.col("total")).alias("insufficient"))


@query("wilson_interval", "WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error')::DOUBLE AS k, count(*)::DOUBLE AS n FROM events GROUP BY 1), p AS (SELECT *, k / n AS p, 1.96::DOUBLE AS z FROM c) SELECT user_id, round((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS high FROM p")
def wilson_interval(spark, sf):
    c = events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return c.select("user_id", r(low).alias("low"), r(high).alias("high"))


@query("ls_gain", "SELECT l_suppkey AS k, round(sum(l_extendedprice * l_quantity) / sum(l_quantity * l_quantity), 5) AS gain, round(pow(sum(l_extendedprice * l_quantity), 2) / (sum(l_quantity * l_quantity) * sum(l_extendedprice * l_extendedprice)), 6) AS share FROM lineitem GROUP BY 1")
def ls_gain(spark, sf):
    g = stats.residual_gain(load(spark, sf, LI).withColumnRenamed("l_suppkey", "k"), ["k"], "l_extendedprice", "l_quantity")
    return g.select("k", r("gain", 5).alias("gain"), r("share").alias("share"))


_CLOCK = f"{EV}, c AS (SELECT user_id, event_id, (t - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE AS x, (t - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE * 1.00007 + 0.013 + (event_id % 17 - 8) / 1000.0::DOUBLE AS y FROM ev)"


def _clock(spark, sf):
    x = (F.col("t") - 1_704_067_200_000_000) / F.lit(3.6e9)
    return events(spark, sf).select("user_id", "event_id", x.alias("x")).withColumn("y", F.col("x") * 1.00007 + 0.013 + (F.col("event_id") % 17 - 8) / F.lit(1000.0))


@query(
    "clock_map_fit",
    f"{_CLOCK}, f AS (SELECT user_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM c GROUP BY 1) SELECT user_id, round(a, 5) AS intercept, round((b - 1) * 1e6, 1) AS drift_ppm, round(sqrt(avg(pow(y - (a + b * x), 2))), 6) AS rms, round(max(abs(y - (a + b * x))), 6) AS largest FROM c JOIN f USING (user_id) GROUP BY user_id, a, b",
)
def clock_map_fit(spark, sf):
    fit = stats.line_fit(_clock(spark, sf), ["user_id"], "x", "y")
    return fit.select("user_id", r("intercept", 5).alias("intercept"), r((F.col("slope") - 1) * 1e6, 1).alias("drift_ppm"), r("rms").alias("rms"), r("largest").alias("largest"))


@query(
    "clock_map_leave_one_out",
    f"""{_CLOCK}, g AS (SELECT user_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM c GROUP BY 1),
l AS (SELECT c.user_id, event_id, x, y, n - 1 AS m, sx - x AS a, sy - y AS b, sxx - x * x AS aa, sxy - x * y AS ab FROM c JOIN g USING (user_id)), s AS (SELECT *, (m * ab - a * b) / (m * aa - a * a) AS k FROM l)
SELECT event_id, round(y - ((b - k * a) / m + k * x), 4) + 0.0 AS residual FROM s""",
)
def clock_map_leave_one_out(spark, sf):
    return stats.leave_one_out(_clock(spark, sf), ["user_id"], "x", "y").select("event_id", (r("loo_residual", 4) + 0.0).alias("residual"))


@query(
    "two_regressor_fit",
    "WITH m AS (SELECT l_suppkey AS k, sum(l_quantity * l_quantity) AS aa, sum(l_tax * l_tax) AS bb, sum(l_quantity * l_tax) AS ab, sum(l_quantity * l_extendedprice) AS ay, sum(l_tax * l_extendedprice) AS by_ FROM lineitem GROUP BY 1) SELECT k, round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 3) AS weight_a, round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 2) AS weight_b FROM m",
)
def two_regressor_fit(spark, sf):
    f = stats.two_regressors(load(spark, sf, LI).withColumnRenamed("l_suppkey", "k"), ["k"], "l_extendedprice", "l_quantity", "l_tax")
    return f.select("k", r("weight_a", 3).alias("weight_a"), r("weight_b", 2).alias("weight_b"))


_FIVE = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "one"]


def _five_sql() -> str:
    """Gauss-Jordan elimination, a table a step."""
    v = [*_FIVE, "l_extendedprice"]
    sums = ", ".join(f"sum({a} * {b}) AS a{i}{j}" for i, a in enumerate(v[:5]) for j, b in enumerate(v))
    steps = [f"m0 AS (SELECT k, {sums}, sum(l_extendedprice * l_extendedprice) AS yy, count(*) AS n FROM (SELECT l_suppkey AS k, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax, l_linenumber::DOUBLE AS l_linenumber, 1.0::DOUBLE AS one, l_extendedprice::DOUBLE AS l_extendedprice FROM lineitem) GROUP BY k)"]
    for p in range(5):
        cells = ", ".join(f"a{p}{j} / a{p}{p} AS a{i}{j}" if i == p else f"a{i}{j} - a{i}{p} * a{p}{j} / a{p}{p} AS a{i}{j}" for i in range(5) for j in range(6))
        steps.append(f"m{p + 1} AS (SELECT k, {cells} FROM m{p})")
    weights = ", ".join(f"round(m5.a{i}5, {d}) AS w{i}" for i, d in enumerate((3, 1, 1, 2, 1)))
    left = " - ".join(["yy", *(f"m5.a{i}5 * m0.a{i}5" for i in range(5))])
    return f"WITH {', '.join(steps)} SELECT k, n, {weights}, round(({left}) / yy, 6) AS unexplained FROM m5 JOIN m0 USING (k)"


@query("five_regressor_fit", _five_sql())
def five_regressor_fit(spark, sf):
    """Each supplier's prices on quantity, discount, tax, line number and a constant."""
    rows = load(spark, sf, LI).select(F.col("l_suppkey").alias("k"), F.lit(1.0).alias("one"), *[c for c in _FIVE if c != "one"], "l_extendedprice")
    f = stats.least_squares(rows, ["k"], "l_extendedprice", _FIVE)
    return f.select("k", "n", *[r(F.col("weights")[i], d).alias(f"w{i}") for i, d in enumerate((3, 1, 1, 2, 1))], r("unexplained").alias("unexplained"))


@query(
    "consensus_offset",
    """WITH p AS (SELECT user_id, value AS v FROM events), c AS (SELECT a.user_id, a.v AS low, count(*) AS n, list(b.v ORDER BY b.v) AS vs FROM (SELECT DISTINCT user_id, v FROM p) a JOIN p b ON a.user_id = b.user_id AND b.v BETWEEN a.v AND a.v + 2 GROUP BY a.user_id, a.v),
d AS (SELECT * FROM (SELECT user_id, low, n, vs FROM c) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, low) = 1) SELECT user_id, n, round(list_median(vs), 4) AS offset_ FROM d WHERE n >= 3""".replace("list_median(vs)", "list_aggregate(vs, 'median')"),
)
def consensus_offset(spark, sf):
    distinct = events(spark, sf).select("user_id", "value")
    c = stats.consensus(distinct, ["user_id"], "value", 2.0)
    return c.select("user_id", F.col("n").cast("bigint").alias("n"), r("offset", 4).alias("offset_"))


@query("cross_tab", "SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def cross_tab(spark, sf):
    return load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query("tier_confusion", "WITH t AS (SELECT event_id, CASE WHEN value / 20 > 4 AND event_id % 10 / 10.0 > 0.35 THEN 'strong' WHEN value / 20 > 2.5 THEN 'present' WHEN value / 20 > 1.6 THEN 'weak' ELSE 'no_transient' END AS tier, event_type = 'purchase' AS hit FROM events) SELECT tier, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp FROM t GROUP BY tier")
def tier_confusion(spark, sf):
    tier = sc.confidence_tier(F.col("value") / 20, F.col("event_id") % 10 / 10)
    hit = F.col("event_type") == "purchase"
    return events(spark, sf).groupBy(tier.alias("tier")).agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"))


@query("label_agreement", "SELECT quality, toxic, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY ALL")
def label_agreement(spark, sf):
    l = load(spark, sf, "labels")
    total = l.count()
    return l.groupBy("quality", "toxic").agg(F.count("*").alias("n")).withColumn("share", r(F.col("n") / total))


@query("mean_per_method", "SELECT l_returnflag AS method, l_linestatus AS k, round(avg(l_discount), 6) AS mean, count(*) FILTER (l_discount >= 0.06) AS over FROM lineitem GROUP BY ALL".replace(" AS over", " AS over_"))
def mean_per_method(spark, sf):
    return load(spark, sf, LI).groupBy(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("k")).agg(r(F.avg("l_discount")).alias("mean"), F.count_if(F.col("l_discount") >= 0.06).alias("over_"))


@query(
    "quartile_class_selectivity",
    f"""{EV}, f AS (SELECT user_id, t // {24 * HOUR} AS d, sum(value) AS load, median(value) AS level FROM ev GROUP BY ALL), q AS (SELECT user_id, quantile_cont(load, 0.75) AS hi, quantile_cont(load, 0.25) AS lo FROM f GROUP BY 1)
SELECT user_id, round(median(level) FILTER (load >= hi), 4) AS heavy, round(median(level) FILTER (load <= lo), 4) AS quiet, round(median(level) FILTER (load >= hi) - median(level) FILTER (load <= lo), 4) AS selectivity FROM f JOIN q USING (user_id) GROUP BY user_id""",
)
def quartile_class_selectivity(spark, sf):
    """Days are written once and their loads don't depend on the order of rows, so a load that is the quartile is compared with itself."""
    f = events(spark, sf).groupBy("user_id", F.floor(F.col("t") / (24 * HOUR)).alias("d")).agg(stats.steady_sum("value").alias("load"), F.median("value").alias("level"))
    f = ranges.stored(f, "days")
    q = f.groupBy("user_id").agg(F.percentile("load", 0.75).alias("hi"), F.percentile("load", 0.25).alias("lo"))
    heavy, quiet = F.median(F.when(F.col("load") >= F.col("hi"), F.col("level"))), F.median(F.when(F.col("load") <= F.col("lo"), F.col("level")))
    return f.join(q, "user_id").groupBy("user_id").agg(r(heavy, 4).alias("heavy"), r(quiet, 4).alias("quiet"), r(heavy - quiet, 4).alias("selectivity"))


@query("energy_regression", "SELECT l_suppkey AS k, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 5) AS r2 FROM lineitem GROUP BY 1")
def energy_regression(spark, sf):
    x = ("l_extendedprice", "l_quantity")
    return load(spark, sf, LI).groupBy(F.col("l_suppkey").alias("k")).agg(r(F.regr_slope(*x), 4).alias("slope"), r(F.regr_intercept(*x), 2).alias("intercept"), r(F.regr_r2(*x), 5).alias("r2"))


@query("yield_table", f"{EV} SELECT event_type AS kind, count(*) AS events, count(DISTINCT user_id) AS recordings, round(sum(value), 2) AS seconds FROM ev GROUP BY 1")
def yield_table(spark, sf):
    return events(spark, sf).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("recordings"), r(F.sum("value"), 2).alias("seconds"))


@query("cube_report", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity)::BIGINT AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_report(spark, sf):
    """Beyond the inventory: all grouping sets of two keys."""
    return load(spark, sf, LI).select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity").cube("flag", "status").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("qty"))


# Vectors: an embedding stands for a waveform, its successor in the label for the estimate.

_VEC = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), w AS (SELECT vec_id, a, lead(a) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM v), p AS (SELECT * FROM w WHERE b IS NOT NULL)"
_DOT = "list_dot_product"


def vectors(spark, sf):
    v = load(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    return v.withColumn("b", F.lead("a").over(Window.partitionBy("label").orderBy("vec_id"))).where("b is not null")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sum(a):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


@query("array_rms_db", f"{_VEC} SELECT vec_id, round(20 * log10(sqrt({_DOT}(a, a) / len(a)) + 1e-12), 5) AS rms_db, round(list_max(list_transform(a, lambda x: abs(x))), 6) AS peak FROM v")
def array_rms_db(spark, sf):
    v = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return v.select("vec_id", r(sc.amplitude_db(F.sqrt(_dot("a", "a") / F.size("a"))), 5).alias("rms_db"), r(F.array_max(F.transform("a", F.abs))).alias("peak"))


@query(
    "centred_cosine",
    f"{_VEC}, c AS (SELECT vec_id, list_transform(a, lambda x: x - list_sum(a) / len(a)) AS a, list_transform(b, lambda x: x - list_sum(b) / len(b)) AS b FROM p) SELECT vec_id, round(CASE WHEN {_DOT}(a, a) > 0 AND {_DOT}(b, b) > 0 THEN {_DOT}(a, b) / sqrt({_DOT}(a, a) * {_DOT}(b, b)) ELSE 0 END, 5) AS cosine FROM c",
)
def centred_cosine(spark, sf):
    p = vectors(spark, sf)
    for c in ("a", "b"):
        p = p.withColumn("m", _sum(c) / F.size(c)).withColumn(c, F.transform(c, lambda x: x - F.col("m")))
    norm = _dot("a", "a") * _dot("b", "b")
    return p.select("vec_id", r(F.when(norm > 0, _dot("a", "b") / F.sqrt(norm)).otherwise(0.0), 5).alias("cosine"))


@query(
    "separation_metrics",
    f"""{_VEC}, d AS (SELECT vec_id, {_DOT}(a, a) AS ss, {_DOT}(b, b) AS ee, {_DOT}(a, b) AS se FROM p), x AS (SELECT *, ss + ee - 2 * se AS err, se / greatest(ss, 1e-12) AS g FROM d)
SELECT vec_id, round(10 * log10(greatest(ss, 1e-12) / greatest(err, 1e-12)), 4) AS snr_db, round(10 * log10(greatest(err, 1e-12) / greatest(ss, 1e-12)), 4) AS nmse_db, round(10 * log10((g * g * ss + 1e-8) / (greatest(ee - 2 * g * se + g * g * ss, 0) + 1e-8)), 4) AS si_sdr_db, round(g, 5) AS projection FROM x""",
)
def separation_metrics(spark, sf):
    d = vectors(spark, sf).select("vec_id", _dot("a", "a").alias("ss"), _dot("b", "b").alias("ee"), _dot("a", "b").alias("se"))
    d = d.withColumns({"err": F.col("ss") + F.col("ee") - 2 * F.col("se"), "g": F.col("se") / F.greatest(F.col("ss"), F.lit(1e-12))})
    db = lambda a, b: r(10 * F.log10(a / b), 4)
    ss, err, g = F.greatest("ss", F.lit(1e-12)), F.greatest("err", F.lit(1e-12)), F.col("g")
    rest = F.greatest(F.col("ee") - 2 * g * F.col("se") + g * g * F.col("ss"), F.lit(0.0)) + 1e-8
    return d.select("vec_id", db(ss, err).alias("snr_db"), db(err, ss).alias("nmse_db"), db(g * g * F.col("ss") + 1e-8, rest).alias("si_sdr_db"), r("g", 5).alias("projection"))


@query("spectral_flatness", f"{_VEC}, q AS (SELECT vec_id, list_transform(a, lambda x: x * x + 1e-9) AS p FROM v) SELECT vec_id, round(exp(list_sum(list_transform(p, lambda x: ln(x))) / len(p)) / (list_sum(p) / len(p)), 5) AS flatness FROM q")
def spectral_flatness(spark, sf):
    v = load(spark, sf, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x + 1e-9).alias("p"))
    return v.select("vec_id", r(F.exp(_sum(F.transform("p", lambda x: F.log(x))) / F.size("p")) / (_sum("p") / F.size("p")), 5).alias("flatness"))


@query("band_retention_db", f"{_VEC}, e AS (SELECT vec_id, {_DOT}(a[9:24], a[9:24]) AS x, {_DOT}(b[9:24], b[9:24]) AS y FROM p) SELECT vec_id, round(10 * log10(greatest(x, 1e-12)), 4) AS band_db, round(10 * log10(greatest(y, 1e-12)) - 10 * log10(greatest(x, 1e-12)), 4) AS retention_db FROM e")
def band_retention_db(spark, sf):
    e = vectors(spark, sf).select("vec_id", F.slice("a", 9, 16).alias("a"), F.slice("b", 9, 16).alias("b"))
    x, y = sc.power_db(_dot("a", "a")), sc.power_db(_dot("b", "b"))
    return e.select("vec_id", r(x, 4).alias("band_db"), r(y - x, 4).alias("retention_db"))


@query("mixture_sum_identity", f"{_VEC}, g AS (SELECT vec_id, a, b, sqrt({_DOT}(a, a) / greatest({_DOT}(b, b), 1e-12)) * pow(10.0, -10 / 20.0) AS g FROM p), y AS (SELECT vec_id, g, a, b, list_transform(list_zip(a, b), lambda z: z[1] + g * z[2]) AS y FROM g) SELECT vec_id, round(g, 5) AS gain, round({_DOT}(y, y), 5) AS energy FROM y")
def mixture_sum_identity(spark, sf):
    g = vectors(spark, sf).withColumn("g", F.sqrt(_dot("a", "a") / F.greatest(_dot("b", "b"), F.lit(1e-12))) * F.lit(math.pow(10, -0.5)))
    y = g.withColumn("y", F.zip_with("a", "b", lambda s, n: s + F.col("g") * n))
    return y.select("vec_id", r("g", 5).alias("gain"), r(_dot("y", "y"), 5).alias("energy"))
