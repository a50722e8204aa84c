"""One long order over many tasks: row numbers and running aggregates whose offsets are carried from range to range.

A window over one key sorts all its rows in one task.  Here rows are cut into
ranges of their order, each about as large as the others whatever the keys, a
window runs inside a range, and what a range adds up to is carried to the next
ones: one small row for each range and key that meet, so at most as many rows
as there are ranges and keys together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.scratch import shared, stored

Keys = Sequence[str]

#: A row's number inside its range takes these bits of Spark's increasing ids.
_BITS = 33


def ranged(df: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """``df`` cut into ranges of ``order``; adds ``_range`` and ``_place``, the row's place in it.

    Ranges come from a sample that another run would draw anew, so the table is
    written to the shared folder once and read from there.  Rows that are equal
    in ``order`` lie in one range: end it with columns that tell them apart.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.select("*", F.shiftright("_id", _BITS).alias("_range"), F.col("_id").bitwiseAND((1 << _BITS) - 1).alias("_place")).drop("_id")
    path = shared(spark, "ranges")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[str | Column], out: str = "number", keys: Keys = (), parts: int | None = None) -> DataFrame:
    """Adds the row's number from 1 on in ``order``, or in its key's rows if ``keys`` are given (then the order inside a key)."""
    rows = ranged(df, [*keys, *order], parts)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    whole = rows.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_before") + F.col("_place") + 1).drop("_before", "_range", "_place")
    if not keys:
        return whole
    first = whole.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(out).alias("_first"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return whole.join(first, same).select(*df.columns, (F.col(out) - F.col("_first") + 1).alias(out))


def running(rows: DataFrame, keys: Keys, sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: bool = False) -> DataFrame:
    """Adds running sums, maxima and last values that are not null over the rows of a key, in the order of :func:`ranged`, to the row, or ``before`` it.

    Inside a range this is a window of the range and key.  Ranges of a key are
    carried over by a window with a row a range.
    """
    kinds = {"s": sums or {}, "t": tops or {}, "l": lasts or {}}
    fold = {"s": F.sum, "t": F.max, "l": lambda x: F.last(x, ignorenulls=True)}
    values = {f"_{k}_{n}": c for k, named in kinds.items() for n, c in named.items()}
    rows = rows.withColumns(values)
    inside = Window.partitionBy("_range", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    local, total, carried, final = [], [], [], {}
    for k, named in kinds.items():
        for n in named:
            c = f"_{k}_{n}"
            local.append(fold[k](c).over(inside).alias(f"{c}_in"))
            total.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_place"))).alias(c) if k == "l" else fold[k](c).alias(c))
            carried.append(fold[k](c).over(ranges).alias(f"{c}_to"))
            a, b = F.col(f"{c}_in"), F.col(f"{c}_to")
            final[n] = F.coalesce(a, b) if k == "l" else F.greatest(a, b) if k == "t" else F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    ends = rows.groupBy("_range", *keys).agg(*total)
    carry = ends.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *carried)
    carry = carry.where(F.coalesce(*[F.col(f"{c}_to").cast("string") for c in values], F.lit(None)).isNotNull())  # keys that run on from an earlier range: one a range
    own = rows.select("*", *local)
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    spare = [c for c in own.columns if c in values or c.removesuffix("_in") in values]
    return own.join(F.broadcast(carry), same, "left").withColumns(final).drop(*spare, *carry.columns)


def merged(spans: DataFrame, keys: Keys, gap: int | float = 0, parts: int | None = None) -> DataFrame:
    """Disjoint spans (keys, s, e, parts) like :func:`intervals.merged`, for keys whose spans no single task should sort."""
    reach = running(ranged(spans.select(*keys, "s", "e"), [*keys, "s", "e"], parts), keys, tops={"_reach": F.col("e")}, before=True)
    new = stored(reach.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("s") > F.col("_reach") + gap), 1).otherwise(0)))
    islands = running(new, keys, sums={"_island": F.col("_new")})
    return islands.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("parts")).drop("_island")


def runs(df: DataFrame, keys: Keys, flag: Column, i: str = "i", parts: int | None = None) -> DataFrame:
    """Runs of consecutive rows for which ``flag`` holds: first and last index, length.  Rows of a run have as many other rows before them."""
    held = F.coalesce(flag, F.lit(False))
    rows = running(ranged(df.select(*keys, i, held.alias("_held")), [*keys, i], parts), keys, sums={"_others": (~F.col("_held")).cast("long")})
    return rows.where("_held").groupBy(*keys, "_others").agg(F.min(i).alias("s"), F.max(i).alias("e"), F.count("*").alias("n")).drop("_others")


def average_ranks(df: DataFrame, keys: Keys, v: str, out: str = "rank", parts: int | None = None) -> DataFrame:
    """(keys, v, out): the average rank of each distinct value among its key's rows; equal values are counted before anything is sorted."""
    counts = df.where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count("*").alias("_n"))
    rows = running(ranged(counts, [*keys, v], parts), keys, sums={"_upto": F.col("_n")})
    return rows.select(*keys, v, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))


def placed(df: DataFrame, keys: Keys, length: str, limit: int | float, gap: int | float, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Rows one after the other, ``gap`` apart, with their start ``at``, as far as they end within ``limit``."""
    rows = running(ranged(df, [*keys, *order], parts), keys, sums={"at": F.col(length) + gap}, before=True)
    start = F.coalesce("at", F.lit(0))
    return rows.withColumn("at", start).where(F.col("at") + F.col(length) <= limit).drop("_range", "_place")


def around(df: DataFrame, keys: Keys, before: int, after: int, columns: dict[str, Callable[[WindowSpec], Column]], i: str = "i", block: int = 1 << 16) -> DataFrame:
    """Windows of rows near each row of dense series: ``columns`` make each a column from a window in index order.

    A series is cut into blocks of ``block`` rows; rows within ``before`` or
    ``after`` rows of a block are copied to it, so that a window that looks no
    farther finds what it would find in the whole series.
    """
    copies = F.sequence(F.floor((F.col(i) - after) / block), F.floor((F.col(i) + before) / block))
    rows = df.withColumn("_block", F.explode(copies))
    window = Window.partitionBy(*keys, "_block").orderBy(i)
    rows = rows.withColumns({name: make(window) for name, make in columns.items()})
    return rows.where(F.col("_block") == F.floor(F.col(i) / block)).drop("_block")


#: (state, value of a row) -> state after the row; states are 0, 1, ... a small number.
Step = Callable[[int, float], int]


def one_task_each(rows: DataFrame) -> DataFrame:
    """Each range in order in a task of its own, as far as range partitioning by its number can."""
    parts = rows.agg(F.max("_range")).first()[0]
    return rows.repartitionByRange((parts or 0) + 1, "_range").sortWithinPartitions("_range", "_place")


def _pieces(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    """Where rows of one range and key start and end in a batch."""
    a, b = pdf["_range"].to_numpy(), pdf["_key"].to_numpy()
    starts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist()] if len(pdf) else []
    return list(zip(starts, [*starts[1:], len(pdf)], strict=True))


def _moved(step: Step, slots: list[int], to: list[int], values: list[float]) -> tuple[list[int], list[int]]:
    """Follow all entry states at once; those that have met go on as one.  ``to`` is each entry state's place in ``slots``."""
    for n, v in enumerate(values):
        slots = [step(s, v) for s in slots]
        if len(slots) > len(set(slots)):
            kept = sorted(set(slots))
            to, slots = [kept.index(slots[k]) for k in to], kept
        if len(slots) == 1:
            state = slots[0]
            for v in values[n + 1 :]:
                state = step(state, v)
            return [state], to
    return slots, to


def scanned(df: DataFrame, keys: Keys, order: Sequence[str], v: str, step: Step, states: int, out: str = "state", parts: int | None = None) -> DataFrame:
    """Adds the state after each row of a rule of few states that starts a key in state 0, for keys of any length.

    A parallel scan.  Each range of rows gives the transition of its last key:
    the state at its end for every state that its rows may start from.  One such
    row a range is folded in order, which tells the state at which each range
    starts, and then all ranges are filled at the same time.
    """
    name = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = ranged(df.withColumn("_key", name), [*keys, *order], parts)

    def transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, found = None, []  # [range, first key, last key, slots, to]
        for pdf in batches:
            for a, b in _pieces(pdf):
                at, key = pdf["_range"].iat[a], pdf["_key"].iat[a]
                if now is None or now[0] != at:
                    found += [now] if now else []
                    now = [at, key, key, list(range(states)), list(range(states))]
                elif now[2] != key:
                    now[2:] = [key, list(range(states)), list(range(states))]
                now[3:] = _moved(step, now[3], now[4], pdf[v].iloc[a:b].tolist())
        found += [now] if now else []
        if found:
            yield pd.DataFrame({"_range": [x[0] for x in found], "first": [x[1] for x in found], "last": [x[2] for x in found], "ends": [[x[3][k] for k in x[4]] for x in found]})

    maps = one_task_each(rows.select("_range", "_place", "_key", v)).mapInPandas(transitions, "_range long, first string, last string, ends array<int>")
    entry, state, before = {}, 0, None
    for m in maps.orderBy("_range").collect():  # a row for each range
        entry[m["_range"]] = state if m["first"] == before else 0
        state = m["ends"][entry[m["_range"]] if m["first"] == m["last"] else 0]
        before = m["last"]

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = key = None
        now = 0
        for pdf in batches:
            got: list[int] = []
            for a, b in _pieces(pdf):
                here, mine = pdf["_range"].iat[a], pdf["_key"].iat[a]
                if here != at:
                    now = entry[here]
                elif mine != key:
                    now = 0
                at, key = here, mine
                for value in pdf[v].iloc[a:b].tolist():
                    now = step(now, value)
                    got.append(now)
            yield pdf.drop(columns=["_range", "_place", "_key"]).assign(**{out: np.array(got, np.int32)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` int"])
    return one_task_each(rows).mapInPandas(filled, schema)


def hysteresis(df: DataFrame, keys: Keys, enter: float, stay: float, hold: int, v: str = "score", i: str = "i", parts: int | None = None) -> DataFrame:
    """Adds ``on`` as :func:`kernels.hysteresis` does: state 0 is off, n + 1 is on after n quiet rows."""

    def step(state: int, value: float) -> int:
        if not state:
            return int(value >= enter)
        quiet = 0 if value >= stay else state
        return quiet + 1 if quiet <= hold else 0

    return scanned(df, keys, [i], v, step, hold + 2, "_state", parts).withColumn("on", F.col("_state") > 0).drop("_state")
