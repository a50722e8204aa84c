"""Time joins and one-to-one matching: clicks are predictions, purchases labels, hours stand for milliseconds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import stats
from ..operators import joins, kernels
from .base import EV, HOUR, events, load, query, r

U = ["user_id"]
_P = "p AS (SELECT user_id, event_id, t, value FROM ev WHERE event_type = 'click'), o AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'purchase')"
_NEAR = """n AS (SELECT p.user_id, p.event_id, p.t, p.value, b.t AS bt, a.t AS at_ FROM p ASOF LEFT JOIN o b ON p.user_id = b.user_id AND p.t >= b.t ASOF LEFT JOIN o a ON p.user_id = a.user_id AND p.t <= a.t),
d AS (SELECT *, CASE WHEN at_ IS NULL OR (bt IS NOT NULL AND t - bt <= at_ - t) THEN bt - t ELSE at_ - t END AS lag FROM n)"""


def sides(spark, sf):
    e = events(spark, sf, "click", "purchase")
    p = e.where("event_type = 'click'").select("user_id", "event_id", "t", "value")
    return p, e.where("event_type = 'purchase'").select("user_id", "event_id", "t")


@query("nearest_event", f"{EV}, {_P}, {_NEAR} SELECT user_id, event_id, lag, abs(lag) AS distance FROM d")
def nearest_event(spark, sf):
    p, o = sides(spark, sf)
    return joins.nearest(p, o, U).select("user_id", "event_id", "lag", "distance")


@query("nearest_event_tolerance", f"{EV}, {_P}, {_NEAR} SELECT user_id, event_id, CASE WHEN abs(lag) <= {6 * HOUR} THEN abs(lag) END AS distance FROM d")
def nearest_event_tolerance(spark, sf):
    p, o = sides(spark, sf)
    return joins.nearest(p, o, U, tolerance=6 * HOUR).select("user_id", "event_id", "distance")


@query("within_tolerance_semi", f"{EV}, {_P} SELECT user_id, event_id FROM p WHERE EXISTS (SELECT 1 FROM o WHERE o.user_id = p.user_id AND abs(o.t - p.t) <= {3 * HOUR})")
def within_tolerance_semi(spark, sf):
    p, o = sides(spark, sf)
    return joins.within(p, o, U, 3 * HOUR).select("user_id", "event_id")


@query("within_tolerance_anti", f"{EV}, {_P} SELECT user_id, event_id FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = p.user_id AND abs(o.t - p.t) < {3 * HOUR})")
def within_tolerance_anti(spark, sf):
    p, o = sides(spark, sf)
    return joins.within(p, o, U, 3 * HOUR, strict=True, absent=True).select("user_id", "event_id")


@query(
    "unexplained_triple_anti",
    f"{EV}, {_P} SELECT user_id, event_id FROM p WHERE "
    + " AND ".join(f"NOT EXISTS (SELECT 1 FROM ev q WHERE q.event_type = '{k}' AND q.user_id = p.user_id AND abs(q.t - p.t) <= {h * HOUR})" for k, h in (("purchase", 6), ("view", 4), ("signup", 2))),
)
def unexplained_triple_anti(spark, sf):
    out = sides(spark, sf)[0]
    for kind, hours in (("purchase", 6), ("view", 4), ("signup", 2)):
        out = joins.within(out, events(spark, sf, kind).select("user_id", "t"), U, hours * HOUR, absent=True)
    return out.select("user_id", "event_id")


@query("crowding_count", f"{EV} SELECT a.user_id, a.event_id, count(b.event_id) AS crowd FROM ev a LEFT JOIN ev b ON a.user_id = b.user_id AND abs(a.t - b.t) < {8 * HOUR} AND a.t <> b.t GROUP BY a.user_id, a.event_id")
def crowding_count(spark, sf):
    return joins.crowding(events(spark, sf), U, 8 * HOUR).select("user_id", "event_id", "crowd")


@query(
    "band_join_pairs",
    f"{EV}, {_P} SELECT p.user_id, p.event_id, o.event_id AS label_id, o.t - p.t AS lag FROM p JOIN o ON p.user_id = o.user_id AND o.t BETWEEN p.t - {2 * HOUR} AND p.t + {6 * HOUR}",
)
def band_join_pairs(spark, sf):
    p, o = sides(spark, sf)
    return joins.band(p, o.withColumnRenamed("event_id", "label_id"), U, 2 * HOUR, 6 * HOUR).select("user_id", "event_id", "label_id", (F.col("other") - F.col("t")).alias("lag"))


@query(
    "event_in_window_tags",
    f"{EV}, w AS (SELECT DISTINCT user_id, t // {12 * HOUR} * {12 * HOUR} + {6 * HOUR} AS w0 FROM ev) SELECT w.user_id, w.w0, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(*) AS n FROM w JOIN ev ON ev.user_id = w.user_id AND t >= w0 AND t < w0 + {24 * HOUR} GROUP BY w.user_id, w.w0",
)
def event_in_window_tags(spark, sf):
    e = events(spark, sf)
    w = e.select("user_id", (F.floor(F.col("t") / (12 * HOUR)) * (12 * HOUR) + 6 * HOUR).alias("w0")).distinct()
    return joins.tags(w, e.select("user_id", "t", "event_type"), U, 24 * HOUR, "event_type")


@query(
    "signed_lag_share",
    f"{EV}, {_P}, {_NEAR}, l AS (SELECT unnest([1, 3, 6, 24]) AS hours) SELECT hours, count(lag) AS n, count(*) FILTER (abs(lag) <= hours * {HOUR}) AS hit, round(count(*) FILTER (abs(lag) <= hours * {HOUR}) / count(lag), 6) AS share FROM d, l WHERE lag IS NOT NULL GROUP BY hours",
)
def signed_lag_share(spark, sf):
    p, o = sides(spark, sf)
    near = joins.nearest(p, o, U).where("lag is not null").withColumn("hours", F.explode(F.array(*[F.lit(h) for h in (1, 3, 6, 24)])))
    hit = F.count_if(F.abs("lag") <= F.col("hours") * HOUR)
    return near.groupBy("hours").agg(F.count("lag").alias("n"), hit.alias("hit"), r(hit / F.count("lag")).alias("share"))


@query("lookup_first", "SELECT o_orderkey, l.l_partkey AS first_part FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1) l ON l_orderkey = o_orderkey")
def lookup_first(spark, sf):
    first = joins.first_of(load(spark, sf, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")])
    o = load(spark, sf, "orders")
    return o.join(first, o.o_orderkey == first.l_orderkey, "left").select("o_orderkey", F.col("l_partkey").alias("first_part"))


_SIDE = "SELECT o_custkey, count(*) AS n, sha256(string_agg(o_orderpriority, chr(10) ORDER BY o_orderpriority)) AS h FROM orders WHERE o_orderstatus = '{}' GROUP BY 1"


@query(
    "catalog_diff",
    f"""WITH a AS ({_SIDE.format("F")}), b AS ({_SIDE.format("O")}) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey,
CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' WHEN a.n <> b.n THEN 'size' WHEN a.h <> b.h THEN 'hash' ELSE 'same' END AS status FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""",
)
def catalog_diff(spark, sf):
    """A customer's finished orders against the open ones, as two catalogues."""
    o = load(spark, sf, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias("n"), sc.assignment_hash(F.collect_list("o_orderpriority")).alias("h"))
    return joins.catalog_diff(side("F"), side("O"), "o_custkey", "n", "h")


@query(
    "best_prefix_match",
    """WITH a AS (SELECT p_partkey, p_type, p_brand, p_size FROM part), s AS (SELECT s_suppkey, s_nationkey FROM supplier),
c AS (SELECT p_partkey, s_suppkey, CASE WHEN s_nationkey % 5 = p_size % 5 THEN 2 ELSE 1 END AS k, CASE WHEN s_suppkey % 10 = p_partkey % 10 THEN 1 ELSE 0 END AS rule FROM a JOIN s ON s_nationkey = p_size % 25)
SELECT p_partkey, s_suppkey, k, rule FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k DESC, rule DESC, s_suppkey) = 1""",
)
def best_prefix_match(spark, sf):
    """The rules see a supplier's nation and last digit alone, so a part meets the first supplier of each such kind, however many there are."""
    p = load(spark, sf, "part").withColumn("_k", F.col("p_size") % 25)
    s = joins.alike(load(spark, sf, "supplier"), {"s_nationkey": F.col("s_nationkey"), "_digit": F.col("s_suppkey") % 10}, "s_suppkey")
    pairs = p.join(s, p["_k"] == s.s_nationkey).select(
        "p_partkey",
        "s_suppkey",
        F.when(F.col("s_nationkey") % 5 == F.col("p_size") % 5, 2).otherwise(1).alias("k"),
        F.when(F.col("_digit") == F.col("p_partkey") % 10, 1).otherwise(0).alias("rule"),
    )
    return joins.best_match(pairs, ["p_partkey"], [F.desc("k"), F.desc("rule"), F.col("s_suppkey")])


_SITES = r"""d AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]+)', 1) AS host, string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/')[2] AS lang FROM pages),
s AS (SELECT page_id, url, string_split(host, '.')[-1] AS tld, lang, CASE WHEN len(string_split(host, '.')) > 3 THEN string_split(host, '.')[1] ELSE '-' END AS front, string_split(host, '.')[-3] AS label FROM d),
t AS (SELECT page_id, url, [tld, lang, front] AS dirs, label, substr(label, 1, 5) AS family FROM s),
c AS (SELECT url, dirs, label AS stem FROM t WHERE url LIKE 'http:%'), q AS (SELECT page_id, dirs, family FROM t WHERE url LIKE 'https:%')"""


def sites(spark, sf):
    """Pages as files of folders (top domain, language, front), named by the site's label."""
    host = F.split(F.regexp_extract("url", r"://([^/?#]+)", 1), r"\.")
    lang = F.get(F.split(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""), "/"), 1)
    front = F.when(F.size(host) > 3, F.get(host, 0)).otherwise("-")
    label = F.try_element_at(host, F.lit(-3))
    return load(spark, sf, "pages").select("page_id", "url", F.array(F.element_at(host, -1), lang, front).alias("dirs"), label.alias("stem"), F.substring(label, 1, 5).alias("family"))


@query(
    "longest_prefix_match",
    f"""WITH {_SITES}, p AS (SELECT q.page_id, c.url, CASE WHEN q.dirs[1] <> c.dirs[1] THEN 0 WHEN q.dirs[2] <> c.dirs[2] THEN 1 WHEN q.dirs[3] <> c.dirs[3] THEN 2 ELSE 3 END AS depth,
length(q.family) >= 2 AND (contains(c.stem, q.family) OR contains(q.family, c.stem) OR contains(c.dirs[3], q.family)) AS called FROM q, c),
r AS (SELECT page_id, url, depth, CASE WHEN depth >= 3 THEN 2 WHEN called THEN 1 END AS rule FROM p)
SELECT page_id, url AS reference, depth, rule FROM r WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY depth DESC, rule DESC, url) = 1""",
)
def longest_prefix_match(spark, sf):
    """Each secure page's best plain page: the longest shared folder path, else a name match, else none."""
    pages = sites(spark, sf)
    records = pages.where(F.col("url").startswith("https:")).select("page_id", "dirs", "family")
    candidates = pages.where(F.col("url").startswith("http:")).select(F.col("url").alias("reference"), "dirs", "stem")
    return joins.scored_prefix_match(records, candidates, "page_id", "reference", least=3)


@query(
    "family_siblings",
    """WITH d AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, length(html) AS n FROM pages), f AS (SELECT page_id, regexp_replace(host, '^(www|m)\\.', '') AS fam, host FROM d)
SELECT a.page_id, a.fam AS family, count(b.page_id) AS siblings, count(DISTINCT b.host) FILTER (b.host <> a.host) AS other_hosts FROM f a LEFT JOIN f b ON a.fam = b.fam AND a.page_id <> b.page_id GROUP BY a.page_id, a.fam, a.host""",
)
def family_siblings(spark, sf):
    # counts of the family and of its hosts, joined back: no pair of siblings is made
    host = F.regexp_extract("url", r"://([^/]+)", 1)
    f = load(spark, sf, "pages").select("page_id", host.alias("host"), F.regexp_replace(host, r"^(www|m)\.", "").alias("family"))
    by = f.groupBy("family").agg(F.count("*").alias("_n"), F.count_distinct("host").alias("_h"))
    return f.join(by, "family").select("page_id", "family", (F.col("_n") - 1).alias("siblings"), (F.col("_h") - 1).alias("other_hosts"))


@query("parameter_grid", "SELECT a AS enter, b AS stay, c AS hold, d AS gap FROM (SELECT unnest([0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS a), (SELECT unnest([0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS b), (SELECT unnest([2, 4]) AS c), (SELECT unnest([3, 5, 7]) AS d)")
def parameter_grid(spark, sf):
    return joins.grid(spark, enter=[0.5, 0.6, 0.7, 0.8], stay=[0.2, 0.3, 0.4, 0.5], hold=[2, 4], gap=[3, 5, 7])


@query(
    "view_pairs_within_group",
    "WITH v AS (SELECT l_partkey, l_returnflag AS v, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL) SELECT a.l_partkey, a.v AS v1, b.v AS v2, abs(a.q - b.q) AS gap FROM v a JOIN v b ON a.l_partkey = b.l_partkey AND a.v < b.v",
)
def view_pairs_within_group(spark, sf):
    v = load(spark, sf, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("v")).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    b = v.select("l_partkey", F.col("v").alias("v2"), F.col("q").alias("q2"))
    return v.join(b, "l_partkey").where("v < v2").select("l_partkey", F.col("v").alias("v1"), "v2", F.abs(F.col("q") - F.col("q2")).alias("gap"))


@query(
    "beats_all_baselines",
    "WITH q AS (SELECT l_partkey AS k, l_returnflag AS m, max(l_extendedprice) AS x FROM lineitem GROUP BY ALL) SELECT k, bool_and(x >= y + 1000) AS beats, round(min(x - y), 2) AS margin FROM (SELECT q.k, q.x, b.x AS y FROM q JOIN q b ON q.k = b.k WHERE q.m = 'R' AND b.m <> 'R') GROUP BY k",
)
def beats_all_baselines(spark, sf):
    q = load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("m")).agg(F.max("l_extendedprice").alias("x"))
    both = q.where("m = 'R'").select("k", "x").join(q.where("m <> 'R'").select("k", F.col("x").alias("y")), "k")
    return both.groupBy("k").agg(F.every(F.col("x") >= F.col("y") + 1000).alias("beats"), F.round(F.min(F.col("x") - F.col("y")), 2).alias("margin"))


@query(
    "composite_key_join",
    f"{EV}, a AS (SELECT user_id, t // {HOUR} AS c, event_id FROM ev WHERE event_type = 'click'), b AS (SELECT user_id, t // {HOUR} AS c, max(value) AS v FROM ev WHERE event_type = 'view' GROUP BY ALL) SELECT event_id, round(v, 2) AS v FROM a JOIN b USING (user_id, c)",
)
def composite_key_join(spark, sf):
    cell = F.floor(F.col("t") / HOUR).alias("c")
    b = events(spark, sf, "view").groupBy("user_id", cell).agg(F.max("value").alias("v"))
    return events(spark, sf, "click").select("user_id", cell, "event_id").join(b, ["user_id", "c"]).select("event_id", F.round("v", 2).alias("v"))


@query(
    "zone_join",
    f"{EV}, b AS (SELECT DISTINCT user_id, t // {HOUR} + x AS i FROM ev, range(4) AS y(x) WHERE event_type = 'view') SELECT e.event_id, CASE WHEN b.i IS NULL THEN 'sparse' ELSE 'dense' END AS zone FROM ev e LEFT JOIN b ON b.user_id = e.user_id AND b.i = e.t // {HOUR} WHERE event_type = 'click'",
)
def zone_join(spark, sf):
    return _zoned(spark, sf).select("event_id", "zone")


def _zoned(spark, sf):
    hour = F.floor(F.col("t") / HOUR)
    dense = events(spark, sf, "view").select("user_id", F.explode(F.sequence(hour, hour + 3)).alias("i")).distinct().withColumn("_z", F.lit("dense"))
    clicks = events(spark, sf, "click").withColumn("i", hour)
    return clicks.join(dense, ["user_id", "i"], "left").withColumn("zone", F.coalesce("_z", F.lit("sparse")))


@query(
    "positional_join_complete",
    """WITH a AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), b AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders WHERE o_orderstatus <> 'P')
SELECT o_custkey, i, 'left' AS side FROM a ANTI JOIN b USING (o_custkey, i) UNION ALL SELECT o_custkey, i, 'right' FROM b ANTI JOIN a USING (o_custkey, i)""",
)
def positional_join_complete(spark, sf):
    o = load(spark, sf, "orders")
    nth = lambda *order: F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)).cast("bigint").alias("i")
    return joins.complete(o.select("o_custkey", nth("o_orderkey")), o.where("o_orderstatus <> 'P'").select("o_custkey", nth("o_orderdate", "o_orderkey")), ["o_custkey", "i"])


_M = """h AS (SELECT p.user_id, count(*) AS hits FROM p WHERE EXISTS (SELECT 1 FROM o WHERE o.user_id = p.user_id AND abs(o.t - p.t) <= {tol}) GROUP BY 1)"""


@query(
    "prf_by_group",
    f"""{EV}, {_P}, {_M.format(tol=3 * HOUR)}, c AS (SELECT user_id, (SELECT count(*) FROM p WHERE p.user_id = u.user_id) AS np, (SELECT count(*) FROM o WHERE o.user_id = u.user_id) AS no FROM (SELECT DISTINCT user_id FROM ev WHERE event_type IN ('click', 'purchase')) u),
x AS (SELECT c.user_id, coalesce(hits, 0) AS hits, np AS n_pred, no AS n_label, coalesce(hits, 0) / greatest(np, 1) AS p, coalesce(hits, 0) / greatest(no, 1) AS r FROM c LEFT JOIN h USING (user_id))
SELECT user_id, hits, n_pred, n_label, round(p, 6) AS p, round(r, 6) AS r, round(2 * p * r / greatest(p + r, 1e-9), 6) AS f1 FROM x""",
)
def prf_by_group(spark, sf):
    p, o = sides(spark, sf)
    hits = joins.within(p, o, U, 3 * HOUR).groupBy("user_id").agg(F.count("*").alias("hits"))
    n = p.groupBy("user_id").agg(F.count("*").alias("n_pred")).join(o.groupBy("user_id").agg(F.count("*").alias("n_label")), "user_id", "full_outer")
    out = stats.precision_recall(n.join(hits, "user_id", "left").fillna(0, ["hits", "n_pred", "n_label"]), "hits", "n_pred", "n_label")
    return out.select("user_id", "hits", "n_pred", "n_label", r("p").alias("p"), r("r").alias("r"), r("f1").alias("f1"))


@query(
    "prf_by_zone",
    f"""{EV}, {_P}, b AS (SELECT DISTINCT user_id, t // {HOUR} + x AS i FROM ev, range(4) AS y(x) WHERE event_type = 'view'),
z AS (SELECT e.event_type, e.user_id, e.t, CASE WHEN b.i IS NULL THEN 'sparse' ELSE 'dense' END AS zone FROM ev e LEFT JOIN b ON b.user_id = e.user_id AND b.i = e.t // {HOUR} WHERE event_type IN ('click', 'purchase')),
a AS (SELECT zone, count(*) AS n_pred, count(*) FILTER (EXISTS (SELECT 1 FROM o WHERE o.user_id = z.user_id AND abs(o.t - z.t) <= {3 * HOUR})) AS hits FROM z WHERE event_type = 'click' GROUP BY zone), l AS (SELECT zone, count(*) AS n_label FROM z WHERE event_type = 'purchase' GROUP BY zone)
SELECT zone, hits, n_pred, n_label, round(hits / greatest(n_pred, 1), 6) AS p, round(hits / greatest(n_label, 1), 6) AS r FROM a FULL JOIN l USING (zone)""",
)
def prf_by_zone(spark, sf):
    hour = F.floor(F.col("t") / HOUR)
    dense = events(spark, sf, "view").select("user_id", F.explode(F.sequence(hour, hour + 3)).alias("i")).distinct().withColumn("_z", F.lit("dense"))
    zone = lambda df: df.withColumn("i", hour).join(dense, ["user_id", "i"], "left").withColumn("zone", F.coalesce("_z", F.lit("sparse"))).drop("_z", "i")
    p, o = sides(spark, sf)
    near = joins.nearest(zone(p), o.select("user_id", "t"), U, tolerance=3 * HOUR)
    a = near.groupBy("zone").agg(F.count("*").alias("n_pred"), F.count("distance").alias("hits"))
    both = a.join(zone(o).groupBy("zone").agg(F.count("*").alias("n_label")), "zone", "full_outer").fillna(0)
    out = stats.precision_recall(both, "hits", "n_pred", "n_label")
    return out.select("zone", "hits", "n_pred", "n_label", r("p").alias("p"), r("r").alias("r"))


@query(
    "error_near_negatives",
    f"""{EV}, {_P}, x AS (SELECT p.event_id, EXISTS (SELECT 1 FROM o WHERE o.user_id = p.user_id AND abs(o.t - p.t) <= {6 * HOUR}) AS tp, EXISTS (SELECT 1 FROM ev q WHERE q.event_type = 'error' AND q.user_id = p.user_id AND abs(q.t - p.t) <= {6 * HOUR}) AS near_negative FROM p)
SELECT tp, near_negative, count(*) AS n FROM x GROUP BY ALL""",
)
def error_near_negatives(spark, sf):
    p, o = sides(spark, sf)
    a = joins.nearest(p, o.select("user_id", "t"), U, tolerance=6 * HOUR).select(*p.columns, F.col("distance").isNotNull().alias("tp"))
    b = joins.nearest(a, events(spark, sf, "error").select("user_id", "t"), U, tolerance=6 * HOUR)
    return b.groupBy("tp", F.col("distance").isNotNull().alias("near_negative")).agg(F.count("*").alias("n"))


_TOL = 6 * HOUR
_REC = EV.replace("WITH", "WITH RECURSIVE") + f", {_P}"
#: {{a}} in time order takes, of its {{near}} nearest {{b}}, the nearest that is free: a fold with the taken places as state.
_TURNS = """, ls AS (SELECT user_id, list(t ORDER BY t) AS ls FROM {b} GROUP BY 1), q AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM {a} JOIN ls USING (user_id)),
rr AS (SELECT DISTINCT user_id, 0::BIGINT AS k, []::BIGINT[] AS used, []::BIGINT[][] AS pairs FROM q
UNION ALL SELECT user_id, k, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, CASE WHEN j IS NULL THEN pairs ELSE list_append(pairs, [t, x]) END FROM (SELECT *, ls[j] AS x FROM (
  SELECT rr.user_id, q.k, q.t, used, pairs, ls, list_filter(list_sort(list_transform(range(1, len(ls) + 1), lambda j: [abs(ls[j] - q.t), j]))[1:{near}], lambda y: y[1] <= {tol} AND NOT list_contains(used, y[2]))[1][2] AS j
  FROM rr JOIN q ON q.user_id = rr.user_id AND q.k = rr.k + 1 JOIN ls ON ls.user_id = rr.user_id))),
z AS (SELECT user_id, unnest(pairs) AS pair FROM (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1))"""
_SUMMED = " SELECT user_id, count(*) AS pairs, sum(abs(pair[1] - pair[2]))::BIGINT AS total FROM z GROUP BY 1"
_MATCH_SQL = {
    "greedy_input": _REC + _TURNS.format(a="p", b="o", near=4, tol=_TOL) + _SUMMED,
    "greedy_retry": _REC + _TURNS.format(a="p", b="o", near=4, tol=_TOL) + _SUMMED,  # if the nearest is out of reach, so are the others
    "greedy_global": _REC + f""", a AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM p), b AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS j FROM o),
c AS (SELECT user_id, i, j, abs(a.t - b.t) AS d, row_number() OVER (PARTITION BY user_id ORDER BY abs(a.t - b.t), i, j) AS k FROM a JOIN b USING (user_id) WHERE abs(a.t - b.t) <= {_TOL}),
rr AS (SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS x, []::BIGINT[] AS y, 0::BIGINT AS pairs, 0::BIGINT AS total FROM (SELECT DISTINCT user_id FROM c)
UNION ALL SELECT user_id, k, CASE WHEN ok THEN list_append(x, i) ELSE x END, CASE WHEN ok THEN list_append(y, j) ELSE y END, pairs + ok::BIGINT, total + CASE WHEN ok THEN d ELSE 0 END
FROM (SELECT rr.user_id, c.k, x, y, pairs, total, i, j, d, NOT list_contains(x, i) AND NOT list_contains(y, j) AS ok FROM rr JOIN c ON c.user_id = rr.user_id AND c.k = rr.k + 1))
SELECT user_id, pairs, total FROM rr QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""",
    # a table over prefixes, one row a prediction: a pair is worth 10^15, its distance is taken off; within a row the minimum is carried on
    "optimal": _REC + f""", ls AS (SELECT user_id, list(t ORDER BY t) AS ls FROM o GROUP BY 1), q AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM p JOIN ls USING (user_id)),
rr AS (SELECT user_id, 0::BIGINT AS k, list_prepend(0::BIGINT, list_transform(ls, lambda x: 0::BIGINT)) AS r FROM ls
UNION ALL SELECT rr.user_id, q.k, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(ls) + 1), lambda b: [least(r[b + 1], CASE WHEN abs(q.t - ls[b]) <= {_TOL} THEN r[b] - 1000000000000000 + abs(q.t - ls[b]) ELSE r[b + 1] END)])), lambda acc, x: list_append(acc, least(acc[-1], x[1])))
FROM rr JOIN q ON q.user_id = rr.user_id AND q.k = rr.k + 1 JOIN ls ON ls.user_id = rr.user_id),
v AS (SELECT user_id, r[-1] AS v, ceil(-r[-1] / 1e15)::BIGINT AS pairs FROM rr QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1)
SELECT user_id, pairs, (v + pairs * 1000000000000000)::BIGINT AS total FROM v WHERE pairs > 0""",
}


def _matches(policy: str):
    def run(spark, sf):
        p, o = sides(spark, sf)
        m = kernels.matched(p.select("user_id", "t"), o.select("user_id", "t"), U, _TOL, policy)
        return m.groupBy("user_id").agg(F.count("*").alias("pairs"), F.sum(F.abs(F.col("predicted") - F.col("actual"))).alias("total"))

    return run


for _policy, _sql in _MATCH_SQL.items():
    query(f"match_{_policy}", _sql)(_matches(_policy))


@query("match_label_major", _REC + _TURNS.format(a="o", b="p", near=5, tol=_TOL) + " SELECT user_id, pair[1] AS actual, pair[2] AS predicted, pair[2] - pair[1] AS lag FROM z")
def match_label_major(spark, sf):
    """Labels in turn take predictions; the signed lag is positive where the prediction is late."""
    p, o = sides(spark, sf)
    m = kernels.matched(p.select("user_id", "t"), o.select("user_id", "t"), U, _TOL, "label_major")
    return m.select("user_id", "actual", "predicted", (F.col("predicted") - F.col("actual")).alias("lag"))


def _optimal_sql(hours: int, kept: str) -> str:
    """The table of ``optimal`` whose cells also list what is ``kept`` of their pairs: ``v{hours}`` (user_id, kept)."""
    cell = "{'v': 0::BIGINT, 'd': []::BIGINT[]}"
    pair = f"CASE WHEN abs(q.t - ls[b]) <= {hours * HOUR} AND r[b].v - 1000000000000000 + abs(q.t - ls[b]) < r[b + 1].v THEN {{'v': r[b].v - 1000000000000000 + abs(q.t - ls[b]), 'd': list_append(r[b].d, {kept})}} ELSE r[b + 1] END"
    return f"""rr{hours} AS (SELECT user_id, 0::BIGINT AS k, list_prepend({cell}, list_transform(ls, lambda x: {cell})) AS r FROM ls
UNION ALL SELECT rr.user_id, q.k, list_reduce(list_prepend([{cell}], list_transform(range(1, len(ls) + 1), lambda b: [{pair}])), lambda acc, x: list_append(acc, CASE WHEN acc[-1].v <= x[1].v THEN acc[-1] ELSE x[1] END))
FROM rr{hours} rr JOIN q ON q.user_id = rr.user_id AND q.k = rr.k + 1 JOIN ls ON ls.user_id = rr.user_id),
v{hours} AS (SELECT user_id, unnest(r[-1].d) AS kept FROM (SELECT * FROM rr{hours} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1))"""


_LISTS = "ls AS (SELECT user_id, list(t ORDER BY t) AS ls FROM o GROUP BY 1), q AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM p JOIN ls USING (user_id))"


@query(
    "match_tolerance_block",
    f"""{_REC}, {_LISTS}, {", ".join(_optimal_sql(h, "abs(q.t - ls[b])") for h in (1, 3, 6))}, d AS ({" UNION ALL ".join(f"SELECT {h} AS hours, kept FROM v{h}" for h in (1, 3, 6))}),
m AS (SELECT hours, count(*) AS hits, median(kept)::DOUBLE AS median, quantile_cont(kept::DOUBLE, 0.95) AS p95 FROM d GROUP BY hours), n AS (SELECT (SELECT count(*) FROM p) AS n_pred, (SELECT count(*) FROM o) AS n_label)
SELECT hours, hits, median, round(p95, 3) AS p95, n_pred, n_label, round(hits / n_pred, 6) AS p, round(hits / n_label, 6) AS r, round(2.0 * hits / (n_pred + n_label), 6) AS f1 FROM m, n""",
)
def match_tolerance_block(spark, sf):
    """Optimal matches at three tolerances: counts, precision, recall, F1, median and 95th percentile of the error."""
    p, o = sides(spark, sf)
    n, m = p.agg(F.count("*").alias("n_pred")), o.agg(F.count("*").alias("n_label"))
    out = None
    for hours in (1, 3, 6):
        pairs = kernels.matched(p.select("user_id", "t"), o.select("user_id", "t"), U, hours * HOUR)
        d = F.abs(F.col("predicted") - F.col("actual"))
        row = pairs.agg(F.lit(hours).alias("hours"), F.count("*").alias("hits"), F.median(d).alias("median"), r(F.percentile(d, 0.95), 3).alias("p95"))
        out = row if out is None else out.unionByName(row)
    out = out.join(F.broadcast(n.join(m)))  # one row of counts
    out = stats.precision_recall(out, "hits", "n_pred", "n_label")
    return out.withColumns({c: r(c) for c in ("p", "r", "f1")})


@query(
    "onset_coincidence",
    f"""{_REC}, {_LISTS}, {_optimal_sql(3, "ls[b]")}, g AS (SELECT user_id, t // {6 * HOUR} AS i, coalesce(sum(value) FILTER (event_type = 'view'), 0) AS bass, coalesce(sum(value) FILTER (event_type = 'error'), 0) AS mid, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS hi FROM ev GROUP BY ALL),
c AS (SELECT user_id, count(*) AS coincidence, count(*) FILTER (coalesce(bass, 0) >= 1.5 * (coalesce(mid, 0) + coalesce(hi, 0))) AS lowband FROM (SELECT user_id, (kept + {3 * HOUR}) // {6 * HOUR} AS i FROM v3) LEFT JOIN g USING (user_id, i) GROUP BY user_id)
SELECT user_id, count(*) AS n_output, coalesce(any_value(coincidence), 0) AS coincidence, coalesce(any_value(lowband), 0) AS lowband FROM p LEFT JOIN c USING (user_id) GROUP BY user_id""",
)
def onset_coincidence(spark, sf):
    """Clicks matched one to one with purchases; a purchase is low where views outweigh errors and clicks in its six hours."""
    p, o = sides(spark, sf)
    band = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0))
    bands = events(spark, sf).groupBy("user_id", F.floor(F.col("t") / (6 * HOUR)).alias("i")).agg(band("view").alias("bass"), band("error").alias("mid"), band("click").alias("hi"))
    return kernels.coincidence(p, o, bands, U, 3 * HOUR, 6 * HOUR, "bass", ["mid", "hi"])


@query(
    "sibling_lists",
    """WITH f AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^/]+)', 1), '^(www|m)\\.', '') AS family FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY page_id) AS k, count(*) OVER (PARTITION BY family) - 1 AS n FROM f)
SELECT a.page_id, coalesce(list(b.page_id ORDER BY b.page_id) FILTER (b.page_id IS NOT NULL), []) AS siblings, any_value(a.n) AS n FROM n a LEFT JOIN n b ON b.family = a.family AND b.k <> a.k AND abs(b.k - a.k) <= 3 GROUP BY a.page_id""",
)
def sibling_lists(spark, sf):
    """Each page's nearest siblings of its site, three on either side."""
    host = F.regexp_extract("url", r"://([^/]+)", 1)
    rows = load(spark, sf, "pages").select("page_id", F.regexp_replace(host, r"^(www|m)\.", "").alias("family"))
    return joins.siblings(rows, ["family"], "page_id", 3)
