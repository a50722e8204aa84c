"""Gates, verdicts, quotas and picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import stats
from ..operators import gates, joins, ranking
from .base import EV, HOUR, events, load, query, r

U = ["user_id"]


@query("contact_filter", "WITH e AS (SELECT *, CASE WHEN value < 5 THEN 'rejected' WHEN value > 100 THEN 'ok' END AS status FROM events) SELECT event_id FROM e WHERE event_type IN ('click', 'view', 'purchase') AND (status IS NULL OR status <> 'rejected')")
def contact_filter(spark, sf):
    status = F.when(F.col("value") < 5, "rejected").when(F.col("value") > 100, "ok")
    e = events(spark, sf).withColumn("status", status)
    return e.where(F.col("event_type").isin("click", "view", "purchase") & ~F.col("status").eqNullSafe("rejected")).select("event_id")


_LINE = "SELECT l_orderkey, l_linenumber, l_partkey, "
RULES = {"qty": ("l_quantity", ">=", 5.0), "discount": ("l_discount", "<=", 0.08), "tax": ("l_tax", "<=", 0.06), "price": ("l_extendedprice", ">", 2000.0)}


@query("acceptance_gate", _LINE + "l_quantity >= 5 AND l_discount <= 0.08 AND l_tax <= 0.06 AND l_extendedprice > 2000 AS ok FROM lineitem")
def acceptance_gate(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", gates.accepted(list(RULES.values())).alias("ok"))


@query(
    "qc_verdict",
    _LINE + "CASE WHEN l_quantity < 5 OR l_extendedprice <= 2000 THEN 'FAIL' WHEN l_discount > 0.08 OR l_tax > 0.06 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM lineitem",
)
def qc_verdict(spark, sf):
    fail, flag = gates.failures({k: RULES[k] for k in ("qty", "price")}), gates.failures({k: RULES[k] for k in ("discount", "tax")})
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", gates.verdict(fail, flag).alias("verdict"))


@query(
    "gate_cascade",
    f"""{EV}, n AS (SELECT e.*, EXISTS (SELECT 1 FROM ev p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND abs(p.t - e.t) <= {6 * HOUR}) AS near FROM ev e WHERE event_type = 'click')
SELECT event_id, CASE WHEN value > 60 THEN 'keep_strong' WHEN value < 5 THEN 'keep_closed' WHEN value > 30 THEN 'open_prominent' WHEN near THEN 'open_near' ELSE 'drop_weak' END AS gate, value >= 5 AND (value > 30 OR near) OR value < 5 AS kept, value > 30 OR (value >= 5 AND near) AS opens FROM n""",
)
def gate_cascade(spark, sf):
    return _cascade(spark, sf).select("event_id", "gate", "kept", "opens")


def _cascade(spark, sf):
    near = joins.nearest(events(spark, sf, "click"), events(spark, sf, "purchase").select("user_id", "t"), U, tolerance=6 * HOUR)
    v = F.col("value")
    g = gates.cascade(
        ("keep_strong", v > 60, True, True),
        ("keep_closed", v < 5, True, False),
        ("open_prominent", v > 30, True, True),
        ("open_near", F.col("distance").isNotNull(), True, True),
        ("drop_weak", F.lit(True), False, False),
    )
    return near.withColumn("_g", g).select("user_id", "event_id", "_g.*")


@query(
    "gate_tallies",
    f"""{EV}, n AS (SELECT e.*, EXISTS (SELECT 1 FROM ev p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND abs(p.t - e.t) <= {6 * HOUR}) AS near FROM ev e WHERE event_type = 'click')
SELECT user_id, count(*) FILTER (value > 60 OR value < 5) AS n_keep_, count(*) FILTER (value BETWEEN 5 AND 60 AND (value > 30 OR near)) AS n_open_, count(*) FILTER (value >= 5 AND value <= 30 AND NOT near) AS n_drop_, count(*) AS n FROM n GROUP BY user_id""",
)
def gate_tallies(spark, sf):
    return gates.tallies(_cascade(spark, sf), U, "gate", ["keep_", "open_", "drop_"])


@query(
    "completion_gate",
    EV.replace("WITH", "WITH RECURSIVE") + f""", c AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM ev v WHERE event_type = 'view'
  AND EXISTS (SELECT 1 FROM ev s WHERE s.user_id = v.user_id AND s.event_type = 'click' AND abs(s.t - v.t) <= {12 * HOUR}) AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.user_id = v.user_id AND o.event_type = 'purchase' AND abs(o.t - v.t) < {3 * HOUR})),
rr AS (SELECT user_id, k, event_id, true AS keep, t AS last FROM c WHERE k = 1 UNION ALL SELECT c.user_id, c.k, c.event_id, c.t - rr.last >= {3 * HOUR}, CASE WHEN c.t - rr.last >= {3 * HOUR} THEN c.t ELSE rr.last END FROM rr JOIN c ON c.user_id = rr.user_id AND c.k = rr.k + 1) SELECT user_id, event_id FROM rr WHERE keep""",
)
def completion_gate(spark, sf):
    """Views inside click spans, three hours from purchases and from views added before."""
    spans = events(spark, sf, "click").select("user_id", (F.col("t") - 12 * HOUR).alias("s"), (F.col("t") + 12 * HOUR).alias("e"))
    views = events(spark, sf, "view").select("user_id", "event_id", "t")
    return gates.completed(views, spans, events(spark, sf, "purchase").select("user_id", "t"), U, 3 * HOUR, "t", ["event_id"]).select("user_id", "event_id")


@query("corpus_gate", "WITH b AS (SELECT event_type, user_id, sum(value) AS a FROM events GROUP BY ALL) SELECT event_type, round(sum(a), 2) AS total, count(*) AS groups, round(max(a) / sum(a), 6) AS share, sum(a) >= 1000 AND count(*) >= 100 AND max(a) / sum(a) <= 0.02 AS passed FROM b GROUP BY event_type")
def corpus_gate(spark, sf):
    g = gates.corpus_gate(events(spark, sf), ["event_type"], "user_id", "value", 1000, 100, 0.02)
    return g.select("event_type", r("total", 2).alias("total"), "groups", r("share").alias("share"), "passed")


@query("data_gate", "WITH s AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN 'test' WHEN o_custkey % 10 = 1 THEN 'dev' ELSE 'train' END AS split, o_custkey, o_orderkey FROM orders) SELECT split, count(*) AS n, count(DISTINCT o_custkey) AS groups, count(*) >= 1000 AND count(DISTINCT o_custkey) >= 100 AS minimum, count(*) >= 5000 AS preferred FROM s GROUP BY split")
def data_gate(spark, sf):
    k = F.col("o_custkey") % 10
    s = load(spark, sf, "orders").withColumn("split", F.when(k == 0, "test").when(k == 1, "dev").otherwise("train"))
    out = s.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"))
    return out.withColumns({"minimum": (F.col("n") >= 1000) & (F.col("groups") >= 100), "preferred": F.col("n") >= 5000})


_CKPT = "c AS (SELECT l_suppkey AS k, l_linenumber AS step, avg(l_discount) AS err, avg(l_tax) AS weak, count(*) AS n FROM lineitem GROUP BY ALL)"


def checkpoints(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("step")).agg(stats.steady_mean("l_discount").alias("err"), stats.steady_mean("l_tax").alias("weak"), F.count("*").alias("n"))


@query("checkpoint_validity", f"WITH {_CKPT}, b AS (SELECT avg(l_discount) AS err FROM lineitem) SELECT k, step, c.err <= 1.05 * b.err AS no_regression, n >= 50 AND weak <= 0.045 AS valid FROM c, b")
def checkpoint_validity(spark, sf):
    base = load(spark, sf, "lineitem").agg(stats.steady_mean("l_discount").alias("err"))
    c = gates.no_regression(checkpoints(spark, sf), base, "err", 1.05)
    return c.select("k", "step", "no_regression", gates.accepted([("n", ">=", 50), ("weak", "<=", 0.045)]).alias("valid"))


@query(
    "decision_rules",
    "WITH c AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) AS n, avg(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END) AS p FROM orders GROUP BY 1) SELECT k, CASE WHEN NOT coalesce(n >= 3 AND p > 100000, false) THEN 'D' WHEN 2 * f >= n THEN 'A' WHEN 4 * o >= n THEN 'B' ELSE 'C' END AS outcome FROM c",
)
def decision_rules(spark, sf):
    s = F.col("o_orderstatus")
    c = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o"), F.count("*").alias("n"), F.avg(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))).alias("p")
    )
    return c.select("k", gates.decision([F.col("n") >= 3, F.col("p") > 100000], 2 * F.col("f") >= F.col("n"), 4 * F.col("o") >= F.col("n")).alias("outcome"))


@query(
    "running_best_guarded",
    f"WITH {_CKPT}, g AS (SELECT *, CASE WHEN weak <= 0.042 THEN round(-err, 8) END AS h FROM c) SELECT k, step, round(max(h) OVER (PARTITION BY k ORDER BY step ROWS UNBOUNDED PRECEDING), 6) AS best, coalesce(h > max(h) OVER (PARTITION BY k ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h IS NOT NULL) AS improved FROM g",
)
def running_best_guarded(spark, sf):
    c = checkpoints(spark, sf).withColumn("score", F.round(-F.col("err"), 8))
    return gates.running_best(c, ["k"], "step", "score", F.col("weak") <= 0.042).select("k", "step", r("best").alias("best"), "improved")


@query("first_stop_condition", f"WITH {_CKPT}, s AS (SELECT k, step, CASE WHEN err > 0.055 THEN 'collapse' WHEN weak < 0.036 THEN 'passthrough' END AS reason FROM c) SELECT k, step, reason FROM s WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY step) = 1")
def first_stop_condition(spark, sf):
    return gates.first_stop(checkpoints(spark, sf), ["k"], "step", ("collapse", F.col("err") > 0.055), ("passthrough", F.col("weak") < 0.036))


@query("select_best_candidate", f"WITH {_CKPT} SELECT k, step FROM c WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(err, 8), step) = 1")
def select_best_candidate(spark, sf):
    c = checkpoints(spark, sf).where("n >= 20").withColumn("score", F.round("err", 8))
    return ranking.deduplicated(c, ["k"], [F.col("score"), F.col("step")]).select("k", "step")


@query("impact_kind", "SELECT event_id, CASE WHEN value >= 120 THEN 'strong_impact' WHEN value >= 60 THEN 'impact' ELSE 'weak_contact' END AS kind FROM events WHERE value >= 30")
def impact_kind(spark, sf):
    return events(spark, sf).select("event_id", sc.banded(F.col("value") / 10, sc.IMPACT_BANDS).alias("kind")).where("kind is not null")


@query("nuisance_class", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'speech' WHEN o_totalprice > 250000 AND o_orderstatus = 'F' THEN 'mixed' WHEN o_orderstatus = 'O' THEN 'onset' ELSE 'quiet' END AS cls FROM orders")
def nuisance_class(spark, sf):
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    return load(spark, sf, "orders").select("o_orderkey", F.when(p > 400000, "speech").when((p > 250000) & (s == "F"), "mixed").when(s == "O", "onset").otherwise("quiet").alias("cls"))


@query(
    "channel_pair_verdict",
    f"""{EV}, d AS (SELECT user_id, t // {24 * HOUR} AS d, event_type, count(*) AS n FROM ev GROUP BY ALL), p AS (SELECT a.user_id, b.event_type AS other, CASE WHEN stddev_pop(a.n) > 0 AND stddev_pop(b.n) > 0 THEN corr(a.n::DOUBLE, b.n::DOUBLE) END AS c, abs(avg(a.n) - avg(b.n)) AS g FROM d a JOIN d b ON a.user_id = b.user_id AND a.d = b.d AND a.event_type = 'click' AND b.event_type IN ('view', 'error') GROUP BY ALL),
v AS (SELECT user_id, CASE WHEN round(c, 6) >= 0.5 AND round(g, 6) <= 0.5 THEN 'DUPLICATE' WHEN round(c, 6) >= 0.1 THEN 'PARTIAL' ELSE 'INDEPENDENT' END AS v FROM p) SELECT user_id, 'MULTI_' || string_agg(DISTINCT v, '_' ORDER BY v) AS verdict FROM v GROUP BY user_id""",
)
def channel_pair_verdict(spark, sf):
    d = events(spark, sf).groupBy("user_id", F.floor(F.col("t") / (24 * HOUR)).alias("d"), "event_type").agg(F.count("*").alias("n"))
    b = d.where("event_type in ('view', 'error')").select("user_id", "d", F.col("event_type").alias("other"), F.col("n").alias("m"))
    p = d.where("event_type = 'click'").join(b, ["user_id", "d"]).groupBy("user_id", "other").agg(F.round(stats.correlation("n", "m"), 6).alias("c"), F.round(F.abs(F.avg("n") - F.avg("m")), 6).alias("g"))
    v = F.when((F.col("c") >= 0.5) & (F.col("g") <= 0.5), "DUPLICATE").when(F.col("c") >= 0.1, "PARTIAL").otherwise("INDEPENDENT")
    return p.groupBy("user_id").agg(F.concat(F.lit("MULTI_"), F.array_join(F.array_sort(F.collect_set(v)), "_")).alias("verdict"))


@query("interaction_labels", "WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b, max(value) AS m, count(*) AS n FROM events GROUP BY 1) SELECT user_id, array_to_string(list_sort(list_filter([CASE WHEN a > b THEN 'clicker' END, CASE WHEN b >= a THEN 'viewer' END, CASE WHEN m > 200 THEN 'loud' END, CASE WHEN n > 66 THEN 'busy' END], lambda x: x IS NOT NULL)), ',') AS labels FROM c")
def interaction_labels(spark, sf):
    k = F.col("event_type")
    c = events(spark, sf).groupBy("user_id").agg(F.count_if(k == "click").alias("a"), F.count_if(k == "view").alias("b"), F.max("value").alias("m"), F.count("*").alias("n"))
    found = sc.labels(("clicker", F.col("a") > F.col("b")), ("viewer", F.col("b") >= F.col("a")), ("loud", F.col("m") > 200), ("busy", F.col("n") > 66))
    return c.select("user_id", F.array_join(found, ",").alias("labels"))


# Orders, quotas, picks.


@query("multi_key_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus = 'F' DESC, o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 100")
def multi_key_sort(spark, sf):
    o = load(spark, sf, "orders").orderBy(F.desc(F.col("o_orderstatus") == "F"), "o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(100)
    from pyspark.sql import Window

    w = Window.orderBy(F.desc(F.col("o_orderstatus") == "F"), "o_orderpriority", F.desc("o_totalprice"), "o_orderkey")
    return o.select("o_orderkey", F.row_number().over(w).cast("bigint").alias("place"))  # 100 rows: the report's length


@query("top_k_per_stratum", "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5")
def top_k_per_stratum(spark, sf):
    t = ranking.top(load(spark, sf, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    return t.select("o_orderpriority", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("quota_per_class", f"{EV} SELECT event_type, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY user_id % 3, t, event_id) <= 20")
def quota_per_class(spark, sf):
    order = [F.col("user_id") % 3, F.col("t"), F.col("event_id")]
    return ranking.top(events(spark, sf), ["event_type"], order, 20).select("event_type", "event_id")


@query("dedup_by_rounded_key", f"{EV} SELECT user_id, t // {12 * HOUR} AS cell, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, t // {12 * HOUR} ORDER BY t, event_id) = 1")
def dedup_by_rounded_key(spark, sf):
    e = events(spark, sf).withColumn("cell", F.floor(F.col("t") / (12 * HOUR)))
    return ranking.deduplicated(e, ["user_id", "cell"], [F.col("t"), F.col("event_id")]).select("user_id", "cell", "event_id")


_GRID = "g AS (SELECT a AS lim, b AS gap, count(*) FILTER (value >= a AND event_type = 'click') AS closed, count(*) FILTER (value < a AND event_type = 'purchase' AND event_id % 5 < b) AS lost FROM events, (SELECT unnest([10, 20, 40, 80]) AS a), (SELECT unnest([1, 2, 3]) AS b) GROUP BY ALL)"


def _grid(spark, sf):
    e = events(spark, sf)
    for name, values in (("lim", (10, 20, 40, 80)), ("gap", (1, 2, 3))):
        e = e.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    k = F.col("event_type")
    return e.groupBy("lim", "gap").agg(
        F.count_if((F.col("value") >= F.col("lim")) & (k == "click")).alias("closed"), F.count_if((F.col("value") < F.col("lim")) & (k == "purchase") & (F.col("event_id") % 5 < F.col("gap"))).alias("lost")
    )


@query("grid_search_order", f"WITH {_GRID} SELECT lim, gap, closed, lost, row_number() OVER (ORDER BY lost, closed DESC, lim, gap) AS place FROM g")
def grid_search_order(spark, sf):
    from pyspark.sql import Window

    w = Window.orderBy("lost", F.desc("closed"), "lim", "gap")  # twelve rows
    return _grid(spark, sf).withColumn("place", F.row_number().over(w).cast("bigint"))


@query("grid_search_pareto", f"WITH {_GRID} SELECT lim, gap, closed, lost FROM g QUALIFY max(closed) OVER (ORDER BY lost, closed DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL OR closed > max(closed) OVER (ORDER BY lost, closed DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def grid_search_pareto(spark, sf):
    return ranking.pareto(_grid(spark, sf).withColumn("_all", F.lit(0)), ["_all"], "lost", "closed").drop("_all")


@query("worst_median_best", "WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)) SELECT o_custkey, o_orderkey, CASE WHEN n = 0 THEN 'worst' WHEN n = c // 2 THEN 'median' ELSE 'best' END AS role FROM n WHERE n = 0 OR n = c // 2 OR n = c - 1")
def worst_median_best(spark, sf):
    return ranking.representatives(load(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "role")


@query(
    "candidate_window_search",
    f"""{EV}, g AS (SELECT user_id, d, unnest(range((t - d * {24 * HOUR}) // {24 * HOUR} + 1, t // {24 * HOUR} + 1)) AS start, value FROM ev, (SELECT unnest([2, 4]) AS d)), s AS (SELECT user_id, d, start, count(*) AS n, round(least(count(*), 12) * 1.0 + least(sum(value), 300) / 100.0, 4) AS score FROM g GROUP BY ALL)
SELECT user_id, d, start, n, score FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, d, start) <= 10""",
)
def candidate_window_search(spark, sf):
    day = 24 * HOUR
    e = events(spark, sf).withColumn("d", F.explode(F.array(F.lit(2), F.lit(4))))
    g = e.withColumn("start", F.explode(F.sequence(F.floor((F.col("t") - F.col("d") * day) / day) + 1, F.floor(F.col("t") / day))))
    score = F.round(F.least(F.count("*"), F.lit(12)) * 1.0 + F.least(F.sum("value"), F.lit(300)) / 100.0, 4)
    s = g.groupBy("user_id", "d", "start").agg(F.count("*").alias("n"), score.alias("score"))
    return ranking.top(s, U, [F.desc("score"), F.col("d"), F.col("start")], 10).drop("rank")


@query("weighted_rank", f"{EV} SELECT event_type, event_id, round(0.7 * value + 0.3 * (event_id % 100), 4) AS score FROM ev QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(0.7 * value + 0.3 * (event_id % 100), 4) DESC, event_id) <= 25")
def weighted_rank(spark, sf):
    s = events(spark, sf).withColumn("score", F.round(0.7 * F.col("value") + 0.3 * (F.col("event_id") % 100), 4))
    return ranking.top(s, ["event_type"], [F.desc("score"), F.col("event_id")], 25).select("event_type", "event_id", "score")


@query("used_confidence_filter", "WITH t AS (SELECT event_id, CASE WHEN value < 2 THEN NULL WHEN value < 10 THEN 'no_transient' WHEN value > 150 THEN 'out_of_range' WHEN value < 30 THEN 'weak' ELSE 'strong' END AS c FROM events) SELECT event_id, c FROM t WHERE c IN ('weak', 'present', 'strong')")
def used_confidence_filter(spark, sf):
    v = F.col("value")
    c = F.when(v < 2, None).when(v < 10, "no_transient").when(v > 150, "out_of_range").when(v < 30, "weak").otherwise("strong")
    return events(spark, sf).select("event_id", c.alias("c")).where(F.col("c").isin("weak", "present", "strong"))
