"""Grouped robust statistics: every one is a partial aggregate or a window keyed by the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def precision_recall(df: DataFrame, hits: str, predicted: str, actual: str) -> DataFrame:
    """Adds p, r and f1; empty sides give 0."""
    p = F.col(hits) / F.greatest(F.col(predicted), F.lit(1))
    r = F.col(hits) / F.greatest(F.col(actual), F.lit(1))
    return df.withColumns({"p": p, "r": r}).withColumn("f1", 2 * F.col("p") * F.col("r") / F.greatest(F.col("p") + F.col("r"), F.lit(1e-9)))


def finite(x: str) -> Column:
    """The value, or null if it is NaN or infinite."""
    c = F.col(x)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def _decimal(x: str) -> tuple[Column, Column]:
    """The value as a decimal, and whether every value of the group is one of up to 14 digits behind the point."""
    d = F.expr(f"try_cast(`{x}` AS DECIMAL(24, 14))")
    return d, F.bool_and(F.coalesce(d.cast("double") == F.col(x), F.col(x).isNull()))


def steady_sum(x: str) -> Column:
    """The sum of doubles, the same in any order of rows and without rounding where all are decimals; a plain sum otherwise."""
    d, whole = _decimal(x)
    return F.coalesce(F.when(whole, F.try_sum(d).cast("double")), F.sum(x))


def steady_mean(x: str) -> Column:
    """The mean of doubles like :func:`steady_sum`: means that are equal as numbers compare equal."""
    d, whole = _decimal(x)
    return F.coalesce(F.when(whole, F.try_avg(d).cast("double")), F.avg(x))


def quantiles(x: str, points: Sequence[float]) -> Column:
    """Exact percentiles with linear interpolation, as an array."""
    return F.percentile(x, list(points))


#: Groups whose brackets are broadcast to their rows; more are joined, and are smaller.
FEW = 10_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], x: str, points: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """keys and ``q``, the same percentiles, for groups of any size.

    A sketch brackets each of them; rows below a bracket are counted and only the
    rows inside, about four in ``accuracy``, are sorted, or all rows of a group of
    ``accuracy`` rows at most.
    """
    wide = [min(max(p + d * 2 / accuracy, 0.0), 1.0) for p in points for d in (-1, 1)]
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"))
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_x", wide, accuracy).alias("_s"), F.min("_x").alias("_l"), F.max("_x").alias("_h"), F.count("*").alias("_n"))
    small = F.col("_n") <= accuracy  # a bracket of less than a rank on either side
    cells = [
        F.struct(
            F.lit(j).alias("j"),
            F.when(small | F.lit(wide[2 * j] == 0), F.col("_l")).otherwise(F.col("_s")[2 * j]).alias("low"),
            F.when(small | F.lit(wide[2 * j + 1] == 1), F.col("_h")).otherwise(F.col("_s")[2 * j + 1]).alias("high"),
            (F.lit(float(p)) * (F.col("_n") - 1)).alias("rank"),
        )
        for j, p in enumerate(points)
    ]
    brackets = stored(sketch.select(*keys, F.array(*cells).alias("_c")), "brackets")
    if brackets.count() <= FEW:  # else rows would meet them in a task a group
        brackets = F.broadcast(brackets)
    both = rows.join(brackets, list(keys))
    below = both.groupBy(*keys).agg(*[F.count_if(F.col("_x") < F.col("_c")[j]["low"]).alias(f"_b{j}") for j in range(len(points))])
    inside = both.select(*keys, "_x", F.explode(F.filter("_c", lambda c: F.col("_x").between(c["low"], c["high"]))).alias("c")).select(*keys, "_x", "c.j", "c.rank")
    inside = inside.join(below.select(*keys, F.array(*[f"_b{j}" for j in range(len(points))]).alias("_b")), list(keys))
    at = F.row_number().over(Window.partitionBy(*keys, "j").orderBy("_x")) - 1 + F.col("_b")[F.col("j")]
    low, high = F.floor("rank"), F.ceil("rank")
    picked = inside.withColumn("_at", at).where((F.col("_at") == low) | (F.col("_at") == high)).groupBy(*keys, "j", "rank")
    value = picked.agg(F.min("_x").alias("a"), F.max("_x").alias("b")).withColumn("v", F.col("a") + (F.col("rank") - F.floor("rank")) * (F.col("b") - F.col("a")))
    return value.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("q"))


def summary(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.median(x).alias("median"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n"))


def mad(df: DataFrame, keys: Sequence[str], x: str, k: float = 4.0) -> DataFrame:
    """Keys, center, spread (MAD) and limit = center + k * spread."""
    center = df.groupBy(*keys).agg(F.median(x).alias("center"))
    off = df.join(center, list(keys)).withColumn("_off", F.abs(F.col(x) - F.col("center")))
    return off.groupBy(*keys, "center").agg(F.median("_off").alias("spread")).withColumn("limit", F.col("center") + k * F.col("spread"))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of a group, null without spread on either side."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


#: Rows that a task sorts, as far as groups let it.
TASK = 1 << 20


def correlated(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Pearson and, on average ranks, Spearman; null under ``least`` rows or without spread.

    One shuffle by the keys, into as many tasks as the rows call for.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    least_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = pairs.repartition(max(least_parts, -(-pairs.count() // TASK)), *keys)
    for c, name in ((x, "_rx"), (y, "_ry")):
        upto = Window.partitionBy(*keys).orderBy(c)
        ranked = ranked.withColumn(name, (F.rank().over(upto) + F.count("*").over(upto)) / 2)  # the first and the last rank of equal values
    safe = lambda a, b: F.when(F.count("*") >= least, correlation(a, b))
    return ranked.groupBy(*keys).agg(safe(x, y).alias("pearson"), safe("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


def line_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r2 and the residuals' rms and largest size of y on x."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    off = df.join(fit, list(keys)).withColumn("_off", F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x)))
    return off.groupBy(*keys, "slope", "intercept", "r2").agg(
        F.sqrt(F.avg(F.col("_off") * F.col("_off"))).alias("rms"), F.max(F.abs("_off")).alias("largest"), F.count("*").alias("n")
    )


def leave_one_out(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Each row's residual against the line through all other rows of its group, from the group's sums."""
    w = Window.partitionBy(*keys)
    sums = {"_n": F.count("*"), "_x": F.sum(x), "_y": F.sum(y), "_xx": F.sum(F.col(x) * F.col(x)), "_xy": F.sum(F.col(x) * F.col(y))}
    out = df.withColumns({k: v.over(w) for k, v in sums.items()})
    n, a, b = F.col("_n") - 1, F.col("_x") - F.col(x), F.col("_y") - F.col(y)
    aa, ab = F.col("_xx") - F.col(x) * F.col(x), F.col("_xy") - F.col(x) * F.col(y)
    below = n * aa - a * a
    slope = F.when((n >= 2) & (below > 0), (n * ab - a * b) / below)
    return out.withColumn("loo_slope", slope).withColumn("loo_residual", F.col(y) - ((b - F.col("loo_slope") * a) / n + F.col("loo_slope") * F.col(x))).drop(*sums)


def two_regressors(df: DataFrame, keys: Sequence[str], y: str, a: str, b: str) -> DataFrame:
    """Least squares of y on a and b without intercept, from sums, with the normal matrix's condition number."""
    s = lambda p, q: F.sum(F.col(p) * F.col(q))
    m = df.groupBy(*keys).agg(s(a, a).alias("aa"), s(b, b).alias("bb"), s(a, b).alias("ab"), s(a, y).alias("ay"), s(b, y).alias("by"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    half, root = (F.col("aa") + F.col("bb")) / 2, F.sqrt(F.pow((F.col("aa") - F.col("bb")) / 2, F.lit(2.0)) + F.col("ab") * F.col("ab"))
    return m.select(
        *keys,
        F.when(det != 0, (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det).alias("weight_a"),
        F.when(det != 0, (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det).alias("weight_b"),
        F.when(half - root > 0, F.sqrt((half + root) / (half - root))).alias("condition"),
    )


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a proportion; null for no trials."""
    p = hits / F.when(n > 0, n)
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def least_squares(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], sweeps: int = 12) -> DataFrame:
    """(keys, weights, unexplained, condition, n): y on any number of regressors without intercept.

    One pass adds up the Gram matrix, which merges like any sum.  It is solved
    by elimination over one array a group; ``unexplained`` is the share of y's
    energy that is left, and the Gram matrix's condition number comes from its
    eigenvalues after ``sweeps`` Jacobi sweeps.  A group whose matrix is
    singular, to a part in 10^11 of a pivot, has no weights and no condition.
    """
    p, v = len(xs), [F.col(c).cast("double") for c in (*xs, y)]
    whole = df.where(F.array_contains(F.transform(F.array(*v), lambda x: x.isNull()), True).eqNullSafe(False))
    sums = [F.sum(v[i] * v[j]).alias(f"_g{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]
    g = whole.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    at = lambda i, j: F.col(f"_g{min(i, j)}_{max(i, j)}")
    wide = p + 1
    cell = lambda m, i, j, width: F.element_at(m, (i * width + j + 1).cast("int"))

    def eliminate(m: Column, k: Column) -> Column:
        pivot = cell(m, k, k, wide)
        pivot = F.when(pivot > 1e-11 * F.element_at(F.col("_diagonal"), (k + 1).cast("int")), pivot)

        def one(x: Column, place: Column) -> Column:
            i, j = F.floor(place / wide), place % wide
            return F.when(i == k, x / pivot).otherwise(x - cell(m, i, k, wide) * cell(m, k, j, wide) / pivot)

        return F.transform(m, one)

    steps = F.sequence(F.lit(0).cast("long"), F.lit(p - 1).cast("long"))
    g = g.withColumn("_diagonal", F.array(*[at(i, i) for i in range(p)])).withColumn("_m", F.array(*[at(i, j) for i in range(p) for j in range(wide)]))
    g = g.withColumn("_solved", F.aggregate(steps, F.col("_m"), eliminate))
    weights = F.array(*[F.element_at("_solved", i * wide + p + 1) for i in range(p)])
    known = F.element_at("_solved", p * wide).isNotNull()
    explained = F.lit(0.0)
    for i in range(p):
        explained = explained + F.element_at("weights", i + 1) * at(i, p)
    out = g.withColumn("weights", F.when(known, weights)).withColumn("unexplained", F.when(at(p, p) > 0, 1 - explained / at(p, p)))
    eigen = _eigenvalues(F.array(*[at(i, j) for i in range(p) for j in range(p)]), p, sweeps)
    out = out.withColumn("_e", F.when(known, F.array_sort(F.transform(eigen, F.abs))))
    return out.select(*keys, "weights", "unexplained", F.when(F.col("_e")[0] > 0, F.element_at("_e", -1) / F.col("_e")[0]).alias("condition"), "n")


def _eigenvalues(matrix: Column, p: int, sweeps: int) -> Column:
    """Eigenvalues of a symmetric p x p matrix, one array, by cyclic Jacobi rotations: angle, rows, columns in turn."""
    if p == 1:
        return matrix
    pairs = [(a, b) for a in range(p) for b in range(a + 1, p)]
    first, second = F.array(*[F.lit(a).cast("long") for a, _ in pairs]), F.array(*[F.lit(b).cast("long") for _, b in pairs])
    cell = lambda m, i, j: F.element_at(m, (i * p + j + 1).cast("int"))

    def step(state: Column, t: Column) -> Column:
        turn, phase = F.floor(t / 3) % len(pairs), t % 3
        a, b = F.element_at(first, (turn + 1).cast("int")), F.element_at(second, (turn + 1).cast("int"))
        m, c, s = state["m"], state["c"], state["s"]
        off = cell(m, a, b)
        tau = (cell(m, b, b) - cell(m, a, a)) / (2 * F.when(off != 0, off))
        tan = F.coalesce(F.when(tau < 0, -1.0).otherwise(1.0) / (F.abs(tau) + F.sqrt(1 + tau * tau)), F.lit(0.0))
        cos = 1 / F.sqrt(1 + tan * tan)

        def rows(x: Column, place: Column) -> Column:
            i, j = F.floor(place / p), place % p
            return F.when(i == a, c * cell(m, a, j) - s * cell(m, b, j)).when(i == b, s * cell(m, a, j) + c * cell(m, b, j)).otherwise(x)

        def columns(x: Column, place: Column) -> Column:
            i, j = F.floor(place / p), place % p
            return F.when(j == a, c * cell(m, i, a) - s * cell(m, i, b)).when(j == b, s * cell(m, i, a) + c * cell(m, i, b)).otherwise(x)

        moved = F.when(phase == 1, F.transform(m, rows)).when(phase == 2, F.transform(m, columns)).otherwise(m)
        return F.struct(moved.alias("m"), F.when(phase == 0, cos).otherwise(c).alias("c"), F.when(phase == 0, tan * cos).otherwise(s).alias("s"))

    steps = F.sequence(F.lit(0).cast("long"), F.lit(3 * sweeps * len(pairs) - 1).cast("long"))
    start = F.struct(matrix.alias("m"), F.lit(1.0).alias("c"), F.lit(0.0).alias("s"))
    done = F.aggregate(steps, start, step, lambda state: state["m"])
    return F.transform(F.sequence(F.lit(1), F.lit(p)), lambda i: F.element_at(done, ((i - 1) * (p + 1) + 1).cast("int")))


def consensus(df: DataFrame, keys: Sequence[str], x: str, tolerance: float, least: int = 3) -> DataFrame:
    """The densest cluster [low, low + tolerance] of a group's estimates (the lowest of equals): median, size, largest residual.

    Values are counted, and so is what lies up to each value and up to each
    value plus the tolerance, by one running sum over both: the difference is
    the cluster's size.  Only the winner's values are then gathered.
    """
    values = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("_low")).agg(F.count("*").alias("_c"))
    both = values.select(*keys, "_low", "_c", F.col("_low").cast("double").alias("_at"), F.lit(0).alias("_end")).unionByName(
        values.select(*keys, "_low", F.lit(0).cast("long").alias("_c"), (F.col("_low") + float(tolerance)).cast("double").alias("_at"), F.lit(1).alias("_end"))
    )
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_at", "_end").rowsBetween(Window.unboundedPreceding, 0))
    ends = both.withColumn("_u", upto - F.col("_c")).groupBy(*keys, "_low").agg((F.max(F.when(F.col("_end") == 1, F.col("_u"))) - F.max(F.when(F.col("_end") == 0, F.col("_u")))).alias("n"))
    best = ends.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("_low")).alias("_m"))).alias("_b")).where(F.col("_b.n") >= least)
    best = best.select(*keys, F.col("_b.n").alias("n"), (-F.col("_b._m")).alias("_from"))
    inside = df.join(best, list(keys)).where(F.col(x).between(F.col("_from"), F.col("_from") + float(tolerance)))
    middle = exact_quantiles(inside, keys, x, [0.5]).select(*keys, F.col("q")[0].alias("offset"))
    reach = inside.groupBy(*keys, "n").agg(F.min(x).alias("_l"), F.max(x).alias("_h")).join(middle, list(keys))
    return reach.select(*keys, "n", "offset", F.greatest(F.col("_h") - F.col("offset"), F.col("offset") - F.col("_l")).alias("largest"))


def residual_gain(df: DataFrame, keys: Sequence[str], x: str, r: str) -> DataFrame:
    """Least-squares gain of reference r in x, and the share of x's energy it explains."""
    xr, rr, xx = F.sum(F.col(x) * F.col(r)), F.sum(F.col(r) * F.col(r)), F.sum(F.col(x) * F.col(x))
    return df.groupBy(*keys).agg((xr / F.when(rr > 0, rr)).alias("gain"), F.when((rr > 0) & (xx > 0), xr * xr / (rr * xx)).alias("share"))
