"""Waveform queries over the signals of :mod:`.spectra`: filters, delays, warps, onsets and fidelity as rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import ranges, waves
from ..operators import spectra as sp
from .base import query, r, uniform_sql
from .series import _NMS
from .spectra import _AB, _SIG, L, _db, _pow, _tf, signals, spectrum

BAND = waves.band(0.05, 0.2, 16)
SMOOTH = waves.smoothing(9)
#: A decaying response of nine samples.
RESPONSE = [1.0] + [0.2 * (-1) ** k * math.exp(-k / 2) for k in range(1, 9)]


def _fir(source: str, v: str, taps: list[float], first: int = 0) -> str:
    """The filtered value at every sample of ``source`` (label, i): a join with the taps."""
    cells = ", ".join(f"({first + k}, {t!r}::DOUBLE)" for k, t in enumerate(taps))
    return f"SELECT s.label, s.i, coalesce(sum(q.{v} * t.tap), 0) AS v FROM {source} s CROSS JOIN (VALUES {cells}) t(k, tap) LEFT JOIN {source} q ON q.label = s.label AND q.i = s.i - t.k GROUP BY ALL"


@query(
    "band_pass_envelope",
    f"WITH {_SIG}, p AS ({_fir('x', 'a', BAND, -16)}), m AS (SELECT label, i, abs(v) AS v FROM p), e AS ({_fir('m', 'v', SMOOTH, -4)}) SELECT label, round(max(v), 6) AS peak, round(avg(v), 6) AS mean, count(*) AS samples FROM e GROUP BY label",
)
def band_pass_envelope(spark, sf):
    """A symmetric band pass has no phase; its magnitude is smoothed by Hann weights."""
    passed = waves.filtered(signals(spark, sf), L, BAND, "a", "band", -16)
    return waves.envelope(passed, L, "band").groupBy("label").agg(r(F.max("envelope")).alias("peak"), r(F.avg("envelope")).alias("mean"), F.count("*").alias("samples"))


def _moved(spark, sf):
    """The first channel, and the second with the first five samples later in it."""
    return waves.filtered(signals(spark, sf), L, [0.0] * 5 + [0.8], "a", "z").withColumn("z", F.col("z") + 0.3 * F.col("b"))


_MOVED = f"{_SIG}, z AS (SELECT x.*, coalesce(0.8 * q.a, 0) + 0.3 * x.b AS z FROM x LEFT JOIN x q ON q.label = x.label AND q.i = x.i - 5)"
_BEST = """n AS (SELECT *, lag(dot) OVER w AS l, lead(dot) OVER w AS h FROM d WINDOW w AS (PARTITION BY label ORDER BY lag)),
best AS (SELECT label, lag, dot, CASE WHEN l IS NULL OR h IS NULL OR l - 2 * dot + h = 0 THEN lag ELSE lag + 0.5 * (l - h) / (l - 2 * dot + h) END AS place FROM n QUALIFY row_number() OVER (PARTITION BY label ORDER BY dot DESC, lag) = 1)"""


@query(
    "delay_estimates",
    f"WITH {_MOVED}, d AS (SELECT p.label, k AS lag, sum(p.a * q.z) AS dot FROM z p, range(-32, 33) t(k), z q WHERE q.label = p.label AND q.i = p.i + k GROUP BY ALL), {_BEST} SELECT label, lag::BIGINT AS lag, round(place, 6) AS place, round(dot / sqrt(aa * zz), 6) AS ncc FROM best JOIN (SELECT label, sum(a * a) AS aa, sum(z * z) AS zz FROM z GROUP BY label) USING (label)",
)
def delay_estimates(spark, sf):
    return waves.delays(_moved(spark, sf), L, "a", "z", 32).select("label", F.col("lag").cast("bigint").alias("lag"), r("place").alias("place"), r("ncc").alias("ncc"))


_CROSS = "c AS (SELECT label, bin, sum({a}_re * {b}_re + {a}_im * {b}_im) AS re, sum({a}_re * {b}_im - {a}_im * {b}_re) AS im FROM tf GROUP BY label, bin), d AS (SELECT label, k AS lag, sum(CASE WHEN bin IN (0, 16) THEN 1 ELSE 2 END / 32 * (re * cos(2 * pi() * bin * k / 32) - im * sin(2 * pi() * bin * k / 32)) / (sqrt(re * re + im * im) + 1e-12)) AS dot FROM c, range(-8, 9) t(k) GROUP BY ALL)"


@query(
    "phase_delays",
    f"WITH {_MOVED}, {_tf('a=a,b=b').replace('FROM x', 'FROM y')}, {_CROSS.format(a='a', b='b')}, {_BEST} SELECT label, lag::BIGINT AS lag, round(place, 5) AS place FROM best".replace("l AS (", "y AS (SELECT label, i, a, z AS b FROM z), l AS (", 1),
)
def phase_delays(spark, sf):
    """The same delay by phase alone, from the cross spectrum summed over frames."""
    tf = ranges.stored(sp.transformed(_moved(spark, sf), L, ["a", "z"]), "spectrum")
    return waves.phases(tf, L, "a", "z", 8).select("label", F.col("lag").cast("bigint").alias("lag"), r("place", 5).alias("place"))


@query(
    "delayed_copy_check",
    f"WITH {_MOVED}, n AS (SELECT label, max(i) + 1 AS len, sqrt(sum(a * a) * sum(z * z)) + 1e-12 AS norm FROM z GROUP BY label), d AS (SELECT p.label, k AS lag, sum(p.a * q.z) AS dot FROM z p JOIN n USING (label), range(-16, 17) t(k), z q WHERE abs(k) >= 2 AND q.label = p.label AND q.i = (p.i + k + len) % len GROUP BY ALL) SELECT label, lag::BIGINT AS lag, round(dot / norm, 6) AS value FROM d JOIN n USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY abs(dot) DESC, lag) = 1",
)
def delayed_copy_check(spark, sf):
    """A copy of the first channel in the other, by circular lags of 2 to 16 samples both ways."""
    return waves.delayed_copy(_moved(spark, sf), L, "z", "a", 2, 16).select("label", F.col("lag").cast("bigint").alias("lag"), r("value").alias("value"))


@query(
    "sinc_warp",
    f"""WITH {_SIG}, p AS (SELECT label, i AS j, 0.3::DOUBLE + 0.99::DOUBLE * i AS y FROM x), k AS (SELECT label, j, y, unnest(range(floor(y)::BIGINT - 15, floor(y)::BIGINT + 17)) AS i FROM p),
w AS (SELECT label, j, x.a * CASE WHEN y = i THEN 1 ELSE sin(pi() * (y - i)) / (pi() * (y - i)) END * (0.5 + 0.5 * cos(pi() * (y - i) / 16)) AS v FROM k JOIN x USING (label, i)), o AS (SELECT label, j, sum(v) AS value FROM w GROUP BY ALL)
SELECT label, j // 100 AS part, count(*) AS n, round(sum(value * value), 5) AS energy, round(sum(value * j) / 100, 4) AS moment FROM o GROUP BY ALL""",
)
def sinc_warp(spark, sf):
    """The first channel read 1 percent slower from 0.3 samples on; sums of each hundred output samples."""
    x = signals(spark, sf)
    places = x.select("label", F.col("i").alias("j"), (F.lit(0.3) + F.lit(0.99) * F.col("i")).alias("at"))
    got = waves.warped(x, places, L, "a").withColumn("part", F.floor(F.col("j") / 100))
    return got.groupBy("label", "part").agg(F.count("*").alias("n"), r(F.sum(F.col("value") ** 2), 5).alias("energy"), r(F.sum(F.col("value") * F.col("j")) / 100, 4).alias("moment"))


_FLUX = f"d AS (SELECT label, frame, bin, greatest(20 * log10(sqrt({_pow('a')}) + 1e-12), -80) AS db FROM tf), f0 AS (SELECT d.label, d.frame, sum(greatest(coalesce(d.db - e.db, 0), 0)) AS v FROM d LEFT JOIN d e ON e.label = d.label AND e.bin = d.bin AND e.frame = d.frame - 1 GROUP BY ALL)"


@query(
    "spectral_flux_onsets",
    _AB.replace("WITH", "WITH RECURSIVE", 1)
    + f", {_FLUX}, m AS (SELECT label, median(v) AS mid FROM f0 GROUP BY label), w AS (SELECT label, median(abs(v - mid)) AS mad FROM f0 JOIN m USING (label) GROUP BY label), q AS (SELECT *, lag(v) OVER o AS before, lead(v) OVER o AS after FROM f0 WINDOW o AS (PARTITION BY label ORDER BY frame)), "
    + _NMS.format(rows="SELECT label AS user_id, v, frame AS place, frame AS id FROM q JOIN m USING (label) JOIN w USING (label) WHERE v > before AND v > after AND v > mid + mad", quota=10**9, reach=4)
    + " SELECT user_id AS label, id AS frame FROM z",
)
def spectral_flux_onsets(spark, sf):
    """Peaks of the flux over the median and one MAD, the higher first, four frames apart."""
    strength = ranges.stored(sp.flux(spectrum(spark, sf, "a"), L, "a"), "flux")
    return waves.onsets(strength, L, 1.0, 4).select("label", F.col("frame").cast("bigint").alias("frame"))


@query(
    "stereo_features",
    f"{_AB}, {_CROSS.format(a='a', b='b')}, {_BEST}, v AS (SELECT label, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM x GROUP BY label), h AS (SELECT label, atan2(-sum(im), sum(re)) AS phase FROM c GROUP BY label) SELECT label, round({_db('aa')} - {_db('bb')}, 6) AS level_db, round(ab / sqrt(aa * bb), 6) AS correlation, round(phase, 6) AS phase, round(place, 5) AS delay FROM v JOIN h USING (label) JOIN best USING (label)",
)
def stereo_features(spark, sf):
    x, tf = signals(spark, sf), spectrum(spark, sf, "a", "b")
    got = waves.stereo(x, tf, L, "a", "b")
    return got.select("label", *[r(c).alias(c) for c in ("level_db", "correlation", "phase")], r("delay", 5).alias("delay"))


@query(
    "transient_fidelity",
    f"""WITH {_SIG}, ma AS (SELECT label, i, abs(a) AS v FROM x), my AS (SELECT label, i, abs(a + 0.5 * b) AS v FROM x), ea AS ({_fir("ma", "v", SMOOTH, -4)}), ey AS ({_fir("my", "v", SMOOTH, -4)}),
e AS (SELECT 'a' AS c, * FROM ea UNION ALL SELECT 'y', * FROM ey), t AS (SELECT c, label, i AS at_, v AS peak, max(i) OVER (PARTITION BY c, label) + 1 AS len FROM e QUALIFY row_number() OVER (PARTITION BY c, label ORDER BY v DESC, i) = 1),
g AS (SELECT c, label, peak, at_ - coalesce(max(i) FILTER (i <= at_ AND v <= 0.1 * peak), 0) AS rise, coalesce(min(i) FILTER (i >= at_ AND v <= peak * 0.1), any_value(len)) - at_ AS decay FROM e JOIN t USING (c, label) GROUP BY c, label, peak, at_)
SELECT y.label, y.rise - a.rise AS rise_error, y.decay - a.decay AS decay_error, round(y.peak / a.peak, 6) AS peak_ratio FROM g y JOIN g a ON a.label = y.label AND a.c = 'a' AND y.c = 'y'""",
)
def transient_fidelity(spark, sf):
    """Rise and decay around the loudest place of the mix against those of its first channel."""
    x = signals(spark, sf)
    a, y = waves.transient(x, L, "a"), waves.transient(x, L, "y")
    both = y.alias("y").join(a.alias("a"), "label")
    return both.select("label", F.expr("y.rise - a.rise").alias("rise_error"), F.expr("y.decay - a.decay").alias("decay_error"), r(F.expr("y.peak / a.peak")).alias("peak_ratio"))


@query(
    "friction_fidelity",
    f"WITH {_SIG}, {_tf('a=a,y=(a + 0.5 * b)')}, k AS (SELECT label, i // 8 AS k, avg(abs(a)) AS p, avg(abs(a + 0.5 * b)) AS q FROM x GROUP BY ALL HAVING count(*) = 8), c AS (SELECT label, corr(p, q) AS r FROM k GROUP BY label), d AS (SELECT label, avg(abs(ln(sqrt({_pow('a')}) + 1e-12) - ln(sqrt({_pow('y')}) + 1e-12))) AS d FROM tf GROUP BY label) SELECT label, round(r, 6) AS envelope_r, round(d, 6) AS log_distance FROM d LEFT JOIN c USING (label)",
)
def friction_fidelity(spark, sf):
    got = waves.friction(signals(spark, sf), spectrum(spark, sf, "a", "y"), L, "y", "a")
    return got.select("label", r("envelope_r").alias("envelope_r"), r("log_distance").alias("log_distance"))


_BLOCKS = _SIG.replace("x AS (", "x0 AS (") + ", x AS (SELECT label * 1000000 + i // 128 AS label, i % 128 AS i, a, b FROM x0)"


@query(
    "coherence_by_loudness",
    f"""WITH {_BLOCKS}, {_tf("a=a,b=b")}, v AS (SELECT label, {_db("avg(b * b)")} AS db FROM x GROUP BY label HAVING count(*) = 128), q AS (SELECT label // 1000000 AS label, median(db) AS q FROM v GROUP BY 1),
c AS (SELECT label, bin, (avg(a_re * b_re + a_im * b_im) ** 2 + avg(a_im * b_re - a_re * b_im) ** 2) / greatest(avg({_pow("a")}) * avg({_pow("b")}), 1e-12) AS c FROM tf GROUP BY label, bin),
g AS (SELECT label, avg(c) FILTER (bin BETWEEN 1 AND 7) AS low, avg(c) FILTER (bin >= 8) AS mid FROM c GROUP BY label)
SELECT q.label::INT AS label, db > q AS loud, round(avg(low), 6) AS low, round(avg(mid), 6) AS mid, count(*) AS blocks FROM g JOIN v USING (label) JOIN q ON q.label = g.label // 1000000 GROUP BY ALL""",
)
def coherence_by_loudness(spark, sf):
    got = waves.coherence_by_loudness(signals(spark, sf), L, "a", "b")
    return got.select("label", "loud", r("low").alias("low"), r("mid").alias("mid"), "blocks")


@query(
    "comb_ripple",
    f"WITH {_SIG.replace('x AS (', 'x0 AS (')}, x AS (SELECT p.label, p.i, p.a, p.a + 0.5 * coalesce(q.a, 0) AS b FROM x0 p LEFT JOIN x0 q ON q.label = p.label AND q.i = p.i - 7), {_tf('a=a,b=b')}, v AS (SELECT label, bin, {_db('avg(' + _pow('b') + ')')} - {_db('avg(' + _pow('a') + ')')} AS v FROM tf GROUP BY label, bin) SELECT label, round(quantile_cont(v, 0.95) - quantile_cont(v, 0.05), 6) AS ripple FROM v GROUP BY label",
)
def comb_ripple(spark, sf):
    """The ripple that a copy seven samples later leaves in the levels of bins."""
    x = waves.filtered(signals(spark, sf), L, [1.0] + [0.0] * 6 + [0.5], "a", "z")
    tf = ranges.stored(sp.transformed(x, L, ["a", "z"]), "spectrum")
    return waves.comb_ripple(tf, L, "z", "a").select("label", r("ripple").alias("ripple"))


@query(
    "wiener_gate",
    f"WITH {_SIG}, n AS (SELECT label, max(i) AS last FROM x GROUP BY label), p AS (SELECT label, i, a, CASE WHEN last >= i // 100 * 100 + 100 THEN i // 100 * 100 + 100 ELSE i // 100 * 100 END AS hi, i // 100 * 100 AS lo FROM x JOIN n USING (label)), v AS (SELECT label, i, abs(b) * 2 AS v FROM x WHERE i % 100 = 0), g AS (SELECT p.label, p.a * (1 - 0.5 * least(greatest(CASE WHEN hi = lo THEN u.v ELSE u.v + (p.i - lo) / (hi - lo) * (w.v - u.v) END, 0), 1)) AS g FROM p JOIN v u ON u.label = p.label AND u.i = lo JOIN v w ON w.label = p.label AND w.i = hi) SELECT label, round(sum(g * g), 5) AS energy, count(*) AS samples FROM g GROUP BY label",
)
def wiener_gate(spark, sf):
    """The first channel turned down by half where a probability, known at every hundredth sample, is high."""
    x = signals(spark, sf)
    speech = x.where("i % 100 = 0").select("label", F.col("i").alias("t"), (F.abs("b") * 2).alias("p"))
    return waves.gated(x, speech, L, "a", 0.5).groupBy("label").agg(r(F.sum(F.col("gated") ** 2), 5).alias("energy"), F.count("*").alias("samples"))


@query(
    "augmentation_chain",
    f"""WITH {_SIG}, n AS (SELECT label, max(i) + 1 AS len FROM x GROUP BY label), u AS (SELECT label, floor(8 * {uniform_sql(1, "label")})::BIGINT AS d, 12 * {uniform_sql(2, "label")} - 6 AS g, {uniform_sql(3, "label")} - 0.5 AS t FROM n),
m AS (SELECT label, i + d AS i, a * 10 ** (g / 20) AS v FROM x JOIN u USING (label)), y AS ({_fir("m", "v", RESPONSE)}),
o AS (SELECT y.label, y.i, y.v + t * (y.v - coalesce(q.v, 0)) AS v FROM y JOIN u USING (label) JOIN n USING (label) LEFT JOIN y q ON q.label = y.label AND q.i = y.i - 1 WHERE y.i < len)
SELECT o.label, any_value(len) AS samples, round({_db("sum(v * v) / any_value(len)")}, 5) AS level_db FROM o JOIN n USING (label) GROUP BY o.label""",
)
def augmentation_chain(spark, sf):
    """Delay, gain and tilt drawn from a hash of the label, then a short decaying response."""
    u = [sc.uniform(k, "label") for k in (1, 2, 3)]
    got = waves.augmented(signals(spark, sf), L, "a", F.floor(8 * u[0]), 12 * u[1] - 6, u[2] - 0.5, RESPONSE)
    return got.groupBy("label").agg(F.count("*").alias("samples"), r(sp.db(F.avg(F.col("augmented") ** 2)), 5).alias("level_db"))
