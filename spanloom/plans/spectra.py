"""Time-frequency queries: a label's vectors in order are a signal of two channels, the halves of each vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranges
from ..operators import spectra as sp
from .base import load, query, r

L = ["label"]
_SIG = """s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, embedding FROM embeddings),
x AS (SELECT label, n * 32 + k AS i, embedding[k + 1]::DOUBLE AS a, embedding[k + 33]::DOUBLE AS b FROM s, range(32) t(k))"""


def _tf(columns: str, n: int = 32, hop: int = 8, tag: str = "") -> str:
    h = n // 2
    sums = ", ".join(f"sum({e} * c) AS {c}_re, -sum({e} * s) AS {c}_im" for c, e in (x.split("=") for x in columns.split(",")))
    return f"""l{tag} AS (SELECT label, max(i) + 1 AS len FROM x GROUP BY label),
p{tag} AS (SELECT label, len, i + {h} AS p, a, b FROM x JOIN l{tag} USING (label) UNION ALL SELECT label, len, {h} - i, a, b FROM x JOIN l{tag} USING (label) WHERE i BETWEEN 1 AND {h}
UNION ALL SELECT label, len, {h} + 2 * (len - 1) - i, a, b FROM x JOIN l{tag} USING (label) WHERE i BETWEEN len - 1 - {h} AND len - 2),
f{tag} AS (SELECT label, frame, p - frame * {hop} AS k, a, b FROM (SELECT label, p, a, b, unnest(range(greatest(0, (p - {n - hop}) // {hop}), least(p // {hop}, len // {hop}) + 1)) AS frame FROM p{tag})),
basis{tag} AS (SELECT k, bin, cos(2 * pi() * k * bin / {n}) * w AS c, sin(2 * pi() * k * bin / {n}) * w AS s, w FROM (SELECT k, 0.5 - 0.5 * cos(2 * pi() * k / {n}) AS w FROM range({n}) t(k)), range({h + 1}) u(bin)),
tf{tag} AS MATERIALIZED (SELECT label, frame, bin, {sums} FROM f{tag} JOIN basis{tag} USING (k) GROUP BY ALL)"""


def _istft(columns: str, source: str) -> str:
    sums = ", ".join(f"sum(q * ({re} * c - {im} * s)) / greatest(sum(CASE WHEN bin = 0 THEN w * w END), 1e-12) AS {c}" for c, re, im in (x.split("=") for x in columns.split(",")))
    return f"SELECT label, i, {sums} FROM (SELECT *, frame * 8 + k - 16 AS i, CASE WHEN bin IN (0, 16) THEN 1 ELSE 2 END / 32 AS q FROM {source} JOIN basis USING (bin)) JOIN l USING (label) WHERE i >= 0 AND i < len GROUP BY label, i"


def _db(x: str) -> str:
    return f"10 * log10(greatest({x}, 1e-12))"


def _pow(c: str) -> str:
    return f"({c}_re * {c}_re + {c}_im * {c}_im)"


_AB = f"WITH {_SIG}, {_tf('a=a,b=b')}"
_MIX = f"WITH {_SIG}, {_tf('a=a,b=b,y=(a + 0.5 * b)')}"


def signals(spark, sf):
    """(label, i, a, b, y): both channels and a mix of them."""
    rows = ranges.numbered(load(spark, sf, "embeddings").select("label", "vec_id", "embedding"), ["vec_id"], "n", L)
    both = F.arrays_zip(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    rows = rows.select("label", "n", F.posexplode(both).alias("k", "x"))
    rows = rows.select("label", ((F.col("n") - 1) * 32 + F.col("k")).alias("i"), F.col("x.a").cast("double").alias("a"), F.col("x.b").cast("double").alias("b"))
    return rows.withColumn("y", F.col("a") + 0.5 * F.col("b"))


def spectrum(spark, sf, *columns):
    return ranges.stored(sp.transformed(signals(spark, sf), L, columns), "spectrum")


@query("stft_round_trip", f"WITH {_SIG} SELECT label, count(*) AS samples, 0.0::DOUBLE AS error FROM x GROUP BY label")
def stft_round_trip(spark, sf):
    """Forth and back returns the signal."""
    x = signals(spark, sf)
    back = sp.restored(sp.transformed(x, L, ["a"]), L, ["a"], sp.lengths(x, L)).withColumnRenamed("a", "back")
    return x.join(back, [*L, "i"], "left").groupBy("label").agg(F.count("back").alias("samples"), r(F.max(F.abs(F.col("a") - F.col("back"))), 9).alias("error"))


@query("stft_band_level", f"{_AB} SELECT label, round({_db('avg(CASE WHEN bin <= 3 THEN ' + _pow('a') + ' END)')}, 6) AS low, round({_db('avg(CASE WHEN bin >= 10 THEN ' + _pow('a') + ' END)')}, 6) AS high FROM tf GROUP BY label")
def stft_band_level(spark, sf):
    p, b = sp.power("a"), F.col("bin")
    return spectrum(spark, sf, "a").groupBy("label").agg(r(sp.db(F.avg(F.when(b <= 3, p)))).alias("low"), r(sp.db(F.avg(F.when(b >= 10, p)))).alias("high"))


@query(
    "spectral_flux",
    f"""{_AB}, d AS (SELECT label, frame, bin, greatest(20 * log10(sqrt({_pow("a")}) + 1e-12), -80) AS db FROM tf)
SELECT d.label, d.frame, round(sum(greatest(coalesce(d.db - e.db, 0), 0)), 5) AS strength FROM d LEFT JOIN d e ON e.label = d.label AND e.bin = d.bin AND e.frame = d.frame - 1 GROUP BY ALL""",
)
def spectral_flux(spark, sf):
    return sp.flux(spectrum(spark, sf, "a"), L, "a").select("label", "frame", r("strength", 5).alias("strength"))


@query(
    "ridge_cancel",
    f"""{_MIX}, t AS (SELECT t.*, coalesce(u.b_re, 0) AS c_re, coalesce(u.b_im, 0) AS c_im FROM tf t LEFT JOIN tf u ON u.label = t.label AND u.bin = t.bin AND u.frame = t.frame - 1),
g AS (SELECT label, bin, sum(b_re * b_re + b_im * b_im) AS aa, sum(c_re * c_re + c_im * c_im) AS bb, sum(b_re * c_re + b_im * c_im) AS abr, sum(b_re * c_im - b_im * c_re) AS abi, sum(b_re * y_re + b_im * y_im) AS atr,
sum(b_re * y_im - b_im * y_re) AS ati, sum(c_re * y_re + c_im * y_im) AS btr, sum(c_re * y_im - c_im * y_re) AS bti FROM t GROUP BY label, bin),
d AS (SELECT *, aa + 0.001 * (aa + bb) / 2 + 1e-12 AS da, bb + 0.001 * (aa + bb) / 2 + 1e-12 AS dd FROM g), e AS (SELECT *, da * dd - abr * abr - abi * abi AS det FROM d),
w AS (SELECT label, bin, (dd * atr - abr * btr + abi * bti) / det AS w0_re, (dd * ati - abr * bti - abi * btr) / det AS w0_im, (da * btr - abr * atr - abi * ati) / det AS w1_re, (da * bti - abr * ati + abi * atr) / det AS w1_im FROM e),
z AS (SELECT label, bin, y_re, y_im, y_re - (b_re * w0_re - b_im * w0_im) - (c_re * w1_re - c_im * w1_im) AS z_re, y_im - (b_re * w0_im + b_im * w0_re) - (c_re * w1_im + c_im * w1_re) AS z_im FROM t JOIN w USING (label, bin))
SELECT label, bin, round(any_value(w0_re), 6) AS w0_re, round(any_value(w0_im), 6) AS w0_im, round(any_value(w1_re), 6) AS w1_re, round(any_value(w1_im), 6) AS w1_im,
round({_db("sum(" + _pow("z") + ")")} - {_db("sum(" + _pow("y") + ")")}, 5) AS left_db FROM z JOIN w USING (label, bin) GROUP BY label, bin""",
)
def ridge_cancel(spark, sf):
    """The mix by bin, explained by the second channel now and a frame before; what is left, summed frame by frame in the twin."""
    tf = sp.earlier(spectrum(spark, sf, "b", "y"), L, "b", "c")
    got = sp.ridge(tf, L, "y", ["b", "c"])
    return got.select("label", "bin", *[r(c).alias(c) for c in ("w0_re", "w0_im", "w1_re", "w1_im")], r(sp.db(F.col("after")) - sp.db(F.col("before")), 5).alias("left_db"))


def _median(by: str) -> str:
    other = "frame" if by == "bin" else "bin"
    edge = lambda k: f"least(greatest({by} + {k}, 0), m{by})"
    return f"(SELECT label, {other}, {by}, median(m) AS v FROM (SELECT t.label, t.{other}, t.{by}, q.m FROM (SELECT *, unnest([{', '.join(edge(k) for k in range(-3, 4))}]) AS at_ FROM m) t JOIN m q ON q.label = t.label AND q.{other} = t.{other} AND q.{by} = t.at_) GROUP BY ALL)"


@query(
    "percussive_mask",
    f"""{_AB}, m AS MATERIALIZED (SELECT label, frame, bin, sqrt({_pow("a")}) AS m, max(frame) OVER (PARTITION BY label) AS mframe, 16 AS mbin FROM tf)
SELECT label, bin, round(avg(p.v ** 2 / (p.v ** 2 + h.v ** 2 + 1e-12)), 6) AS mask, count(*) AS n FROM {_median("bin")} p JOIN {_median("frame")} h USING (label, frame, bin) GROUP BY label, bin""",
)
def percussive_mask(spark, sf):
    return sp.percussive(spectrum(spark, sf, "a"), L, "a").groupBy("label", "bin").agg(r(F.avg("mask")).alias("mask"), F.count("*").alias("n"))


@query(
    "wiener_gain",
    f"""{_MIX}, g AS (SELECT label, frame, bin, greatest(1 - {_pow("b")} / greatest({_pow("y")}, 1e-12), 0.1) AS g FROM tf),
h AS (SELECT label, bin, (coalesce(lag(g) OVER w, g) + g + coalesce(lead(g) OVER w, g)) / 3 AS gain FROM g WINDOW w AS (PARTITION BY label, bin ORDER BY frame))
SELECT label, bin, round(avg(gain), 6) AS gain, round(min(gain), 6) AS least FROM h GROUP BY label, bin""",
)
def wiener_gain(spark, sf):
    gains = sp.wiener(spectrum(spark, sf, "b", "y"), L, "y", "b")
    return gains.groupBy("label", "bin").agg(r(F.avg("gain")).alias("gain"), r(F.min("gain")).alias("least"))


_MASK = f"""{_MIX}, m AS MATERIALIZED (SELECT *, (a_re * y_re + a_im * y_im) / ({_pow("y")} + 1e-12) AS q_re, (a_im * y_re - a_re * y_im) / ({_pow("y")} + 1e-12) AS q_im FROM tf),
n AS MATERIALIZED (SELECT *, least(greatest(q_re, 0), 1) AS g FROM m)"""


@query(
    "mask_oracles",
    f"""{_MASK}, o AS ({_istft("t=(q_re * y_re - q_im * y_im)=(q_re * y_im + q_im * y_re)", "n")}), e AS (SELECT label, round(max(abs(t - a)), 5) AS ratio_error FROM o JOIN x USING (label, i) GROUP BY label)
SELECT label, bounded, ratio_error FROM (SELECT label, round(avg(g), 6) AS bounded FROM n GROUP BY label) JOIN e USING (label)""",
)
def mask_oracles(spark, sf):
    """The mean bounded mask, and how far the complex ratio mask's signal is from the target."""
    x, tf = signals(spark, sf), sp.masked(spectrum(spark, sf, "a", "y"), "y", "a")
    c = F.col
    cut = tf.withColumns({"t_re": c("ratio_re") * c("y_re") - c("ratio_im") * c("y_im"), "t_im": c("ratio_re") * c("y_im") + c("ratio_im") * c("y_re")})
    error = sp.restored(cut, L, ["t"], sp.lengths(x, L)).join(x, [*L, "i"]).groupBy("label").agg(r(F.max(F.abs(c("t") - c("a"))), 5).alias("ratio_error"))
    return tf.groupBy("label").agg(r(F.avg("bounded")).alias("bounded")).join(error, "label")


@query(
    "mask_path_decomposition",
    f"""{_MASK}, o AS ({_istft("t=g * a_re=g * a_im,v=g * b_re=g * b_im,z=g * y_re=g * y_im", "n")})
SELECT label, round({_db("sum(t * t)")} - {_db("sum(a * a)")}, 5) AS target_kept_db, round({_db("sum(b * b)")} - {_db("sum(v * v)")}, 5) AS nuisance_cut_db,
round(sum((z - t - 0.5 * v) ** 2) / greatest(sum(z * z), 1e-12), 9) AS residual FROM o JOIN x USING (label, i) GROUP BY label""",
)
def mask_path_decomposition(spark, sf):
    """What one fixed mask does to target and nuisance, and how far both are from adding up to the masked mix."""
    x, tf = signals(spark, sf), sp.masked(spectrum(spark, sf, "a", "b", "y"), "y", "a")
    g = F.col("bounded")
    cut = tf.withColumns({f"{o}_{part}": g * F.col(f"{c}_{part}") for o, c in (("t", "a"), ("v", "b"), ("z", "y")) for part in ("re", "im")})
    both = sp.restored(cut, L, ["t", "v", "z"], sp.lengths(x, L)).join(x.drop("y"), [*L, "i"])
    e = lambda c: F.sum(F.col(c) * F.col(c))
    rest = F.sum((F.col("z") - F.col("t") - 0.5 * F.col("v")) ** 2) / F.greatest(e("z"), F.lit(sp.EPS))
    return both.groupBy("label").agg(r(sp.db(e("t")) - sp.db(e("a")), 5).alias("target_kept_db"), r(sp.db(e("b")) - sp.db(e("v")), 5).alias("nuisance_cut_db"), r(rest, 9).alias("residual"))


@query("coherence_by_band", f"""{_MIX}, c AS (SELECT label, bin, (avg(a_re * y_re + a_im * y_im) ** 2 + avg(a_im * y_re - a_re * y_im) ** 2) / greatest(avg({_pow("a")}) * avg({_pow("y")}), 1e-12) AS v FROM tf GROUP BY label, bin)
SELECT label, bin // 4 AS band, round(avg(v), 6) AS coherence FROM c GROUP BY ALL""")
def coherence_by_band(spark, sf):
    bins = sp.coherence(spectrum(spark, sf, "a", "y"), L, "a", "y")
    return bins.groupBy("label", F.floor(F.col("bin") / 4).alias("band")).agg(r(F.avg("coherence")).alias("coherence"))


@query(
    "reference_attenuation",
    f"""{_MIX}, q AS (SELECT label, quantile_cont(sqrt({_pow("b")}), 0.75) AS q FROM tf GROUP BY label), t AS (SELECT label, sqrt({_pow("b")}) >= q AS act, {_pow("y")} AS p, {_pow("a")} AS o FROM tf JOIN q USING (label))
SELECT label, round({_db("avg(o) FILTER (act)")} - {_db("avg(p) FILTER (act)")}, 5) AS active_db, round({_db("avg(o) FILTER (NOT act)")} - {_db("avg(p) FILTER (NOT act)")}, 5) AS inactive_db FROM t GROUP BY label""",
)
def reference_attenuation(spark, sf):
    """From the mix to its first channel: the level change where the second is in its loudest quarter of cells, and elsewhere."""
    got = sp.attenuation(spectrum(spark, sf, "a", "b", "y"), L, "y", "a", "b")
    return got.select("label", r("active_db", 5).alias("active_db"), r("inactive_db", 5).alias("inactive_db"))


@query(
    "multi_resolution_distance",
    f"""WITH {_SIG}, {_tf("a=a,y=(a + 0.5 * b)", 16, 4, "1")}, {_tf("a=a,y=(a + 0.5 * b)", 32, 8, "2")}, d AS (SELECT 1 AS res, * FROM tf1 UNION ALL SELECT 2, * FROM tf2),
e AS (SELECT label, res, avg(abs(ln(sqrt({_pow("a")}) + 1e-5) - ln(sqrt({_pow("y")}) + 1e-5))) AS d FROM d GROUP BY label, res) SELECT label, round(avg(d), 6) AS distance FROM e GROUP BY label""",
)
def multi_resolution_distance(spark, sf):
    """Mean absolute difference of log magnitudes, averaged over two frame sizes."""
    x, parts = signals(spark, sf), None
    for n in (16, 32):
        gap = F.abs(F.ln(F.sqrt(sp.power("a")) + 1e-5) - F.ln(F.sqrt(sp.power("y")) + 1e-5))
        one = sp.transformed(x, L, ["a", "y"], n, n // 4).groupBy("label").agg(F.avg(gap).alias("d"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("label").agg(r(F.avg("d")).alias("distance"))


@query(
    "overlap_add_chunks",
    f"""WITH {_SIG}, c AS (SELECT label, chunk, i - chunk * 50 AS k, i, a FROM (SELECT *, unnest([i // 50 - 1, i // 50]) AS chunk FROM x) WHERE chunk >= 0 AND i < chunk * 50 + 100),
m AS (SELECT label, chunk, avg(a) AS mean FROM c GROUP BY label, chunk HAVING count(*) = 100),
o AS (SELECT label, i, sum((0.5 - 0.5 * cos(2 * pi() * k / 100) + 1e-6) * (a - mean)) / sum(0.5 - 0.5 * cos(2 * pi() * k / 100) + 1e-6) AS v FROM c JOIN m USING (label, chunk) GROUP BY label, i)
SELECT label, i, round(coalesce(v, 0), 6) AS v FROM x LEFT JOIN o USING (label, i)""",
)
def overlap_add_chunks(spark, sf):
    """A model that takes each chunk's mean away, on half-overlapping chunks of whole signals; the tail that no chunk covers is 0."""
    got = sp.chunked(signals(spark, sf), L, 100, lambda x: x - x.mean(1, keepdims=True), "a", out="v")
    return got.select("label", "i", r("v").alias("v"))
