"""Gates, verdicts and choices: declared thresholds in, booleans, reasons and picks out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One comparison: column, operator, limit.
Rule = tuple[str, str, float]

_TESTS = {
    "<=": lambda c, x: c <= x,
    "<": lambda c, x: c < x,
    ">=": lambda c, x: c >= x,
    ">": lambda c, x: c > x,
    "==": lambda c, x: c == x,
}


def test(rule: Rule) -> Column:
    """A rule as a boolean; a null measure fails it."""
    name, op, limit = rule
    return F.coalesce(_TESTS[op](F.col(name), F.lit(limit)), F.lit(False))


def accepted(rules: Sequence[Rule]) -> Column:
    return reduce(lambda a, b: a & b, [test(x) for x in rules])


def failures(rules: dict[str, Rule]) -> Column:
    """Codes of the rules that fail, in declared order."""
    return F.array_compact(F.array(*[F.when(~test(rule), F.lit(code)) for code, rule in rules.items()]))


def verdict(reasons: Column, flags: Column) -> Column:
    """FAIL with a reason, REVIEW with a flag, else PASS."""
    return F.when(F.size(reasons) > 0, "FAIL").when(F.size(flags) > 0, "REVIEW").otherwise("PASS")


def cascade(*steps: tuple[str, Column, bool, bool]) -> Column:
    """The first step whose condition holds, as (gate, kept, opens); null conditions don't hold."""
    out = F.struct(F.lit("none").alias("gate"), F.lit(False).alias("kept"), F.lit(False).alias("opens"))
    for code, condition, kept, opens in reversed(steps):
        pick = F.struct(F.lit(code).alias("gate"), F.lit(kept).alias("kept"), F.lit(opens).alias("opens"))
        out = F.when(F.coalesce(condition, F.lit(False)), pick).otherwise(out)
    return out


def completed(candidates: DataFrame, spans: DataFrame, existing: DataFrame, keys: Sequence[str], gap: int, t: str = "t", tie: Sequence[str] = ()) -> DataFrame:
    """Candidates inside a span, ``gap`` from every existing event and from every one added before."""
    from . import intervals, joins, kernels

    held = intervals.inside(candidates, spans, keys, t).where("inside").drop("inside", "edge")
    apart = joins.within(held, existing, keys, gap, t, strict=True, absent=True)
    return kernels.added(apart, keys, gap, t, tie)


def corpus_gate(df: DataFrame, keys: Sequence[str], group: str, amount: str, least: float, groups: int, share: float) -> DataFrame:
    """Totals of a corpus and whether amount, group count and the largest group's share all pass."""
    by = df.groupBy(*keys, group).agg(F.sum(amount).alias("_a"))
    out = by.groupBy(*keys).agg(F.sum("_a").alias("total"), F.count("*").alias("groups"), (F.max("_a") / F.sum("_a")).alias("share"))
    return out.withColumn("passed", (F.col("total") >= least) & (F.col("groups") >= groups) & (F.col("share") <= share))


def no_regression(df: DataFrame, baseline: DataFrame, metric: str, factor: float) -> DataFrame:
    """Adds whether the metric stays within ``factor`` times the single baseline row's."""
    base = baseline.select(F.col(metric).alias("_base"))
    return df.join(F.broadcast(base.limit(1))).withColumn("no_regression", F.coalesce(F.col(metric) <= factor * F.col("_base"), F.lit(False))).drop("_base")


def decision(required: Sequence[Column], strong: Column, weak: Column) -> Column:
    """A if all required truths and the strong criterion hold, B with the weak one, C without either, D if a required truth is missing or false."""
    sure = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in required])
    return F.when(~sure, "D").when(F.coalesce(strong, F.lit(False)), "A").when(F.coalesce(weak, F.lit(False)), "B").otherwise("C")


def running_best(df: DataFrame, keys: Sequence[str], order: str, score: str, guard: Column) -> DataFrame:
    """Adds the best guarded score so far and whether this row set it."""
    w = Window.partitionBy(*keys).orderBy(order)
    held = F.when(F.coalesce(guard, F.lit(False)), F.col(score))
    out = df.withColumn("best", F.max(held).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.max(held).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("improved", F.coalesce(held > before, held.isNotNull()))


def first_stop(df: DataFrame, keys: Sequence[str], order: str, *stops: tuple[str, Column]) -> DataFrame:
    """The first row, in order, at which a stop condition holds, and the first such condition."""
    why = F.coalesce(*[F.when(c, F.lit(code)) for code, c in stops])
    rows = df.withColumn("reason", why).where("reason is not null")
    return rows.groupBy(*keys).agg(F.min(F.struct(order, "reason")).alias("_x")).select(*keys, F.col(f"_x.{order}").alias(order), F.col("_x.reason").alias("reason"))


def tallies(df: DataFrame, keys: Sequence[str], code: str, prefixes: Sequence[str]) -> DataFrame:
    """Rows whose code starts with each prefix."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(code).startswith(p)).alias(f"n_{p}") for p in prefixes], F.count("*").alias("n"))
