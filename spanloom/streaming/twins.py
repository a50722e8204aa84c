"""Structured Streaming twins of sessions, windows and the sequential rules.

Late rows wait for a watermark.  Aggregates come out when the watermark has
passed them and leave the state.  The sequential rules keep rows back until the
watermark has passed them, so files whose times interleave give what the batch
rules give; a key's state is its last decision and the rows still open.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import shared

LATE = "1 hour"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, folder: str, schema, watermark: str = LATE) -> DataFrame:
    """The parquet files of a folder and those below, oldest first and one a step, as a stream of rows with an event time ``at``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark)


def staged(spark: SparkSession, rows: DataFrame, files: int) -> tuple[str, object]:
    """Rows with a time ``ts`` laid out as a stream would deliver it: ``files`` files one after the other in time, and a last row far ahead that moves the watermark."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    out = shared(spark, "replay")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        low = high = 0
    edges = [low + (high - low) * k // files for k in range(1, files)]
    for k, (a, b) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        part = rows.where((at >= a if a is not None else F.lit(True)) & (at < b if b is not None else F.lit(True)))
        part.repartition(1).write.parquet(f"{out}/{k:03d}")  # cut out by many tasks, written by one
    far = (F.timestamp_micros(F.lit(high)) + F.expr("interval 1000 days")).cast(rows.schema["ts"].dataType)
    last = spark.range(1).select(*[far.alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    last.coalesce(1).write.parquet(f"{out}/{files:03d}")
    return out, rows.schema


def run(spark: SparkSession, stream: DataFrame, told: Callable[[dict], object] | None = None) -> DataFrame:
    """Run a streaming plan until its files are used up, and read what it wrote; ``told`` gets the progress of each step."""
    out = shared(spark, "stream")
    schema = stream.schema

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/{number}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # state with maps and timers
    try:
        query = stream.writeStream.outputMode("append").foreachBatch(sink)
        query = query.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    for progress in query.recentProgress if told else []:
        told(json.loads(progress.json) if hasattr(progress, "json") else progress)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/data")


def replayed(spark: SparkSession, folder: str, plan: Callable[[DataFrame], DataFrame], name: str = "events.parquet", files: int = 3, rows: DataFrame | None = None) -> DataFrame:
    """A streaming plan over a table, or ``rows`` made from one, delivered in several files with a watermark."""
    where, schema = staged(spark, spark.read.parquet(f"{folder}/{name}") if rows is None else rows, files)
    return run(spark, plan(source(spark, where, schema)))


def _micros(c) -> F.Column:
    return F.unix_micros(c)


#: Number of rows that only move the watermark; a filter on them would be pushed below it.
_NONE = -(1 << 63)


def sessions(rows: DataFrame, gap: str) -> DataFrame:
    """A user's events closer than ``gap`` in one session."""
    g = rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("event_id").alias("n"))
    return g.where("n > 0").select("user_id", _micros(F.col("w.start")).alias("start"), "n")


def sliding(rows: DataFrame, width: str, step: str) -> DataFrame:
    g = rows.groupBy(F.window("at", width, step).alias("w")).agg(F.count("event_id").alias("n"))
    return g.where("n > 0").select(_micros(F.col("w.start")).alias("w0"), "n")


def tumbling(rows: DataFrame, width: str) -> DataFrame:
    g = rows.groupBy(F.window("at", width).alias("w")).agg(F.count("event_id").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.where("n > 0").select(_micros(F.col("w.start")).alias("w0"), "n", "total")


#: Open rows are kept by cells of this many milliseconds, unless a rule is given another: its rows come out that much later at most.
CELL = 3_600_000


#: Keys are dealt by hash into so many groups, each with one state: calls into the state don't grow with the keys.
GROUPS = 128


class _Rule(StatefulProcessor):
    """A sequential rule over the keys of one group: the value state is each key's last decision, the map state the open rows by cells of time.

    Rows are added to their cells and to no other; a cell's timer fires when the
    watermark has passed its end, and then its rows are decided in order, key by
    key, and leave the state; Spark fires timers by time.  So a batch touches the
    cells that it adds to and those that end, and the state holds no row that is
    older than the watermark by more than a cell.
    """

    def __init__(self, step, fresh: tuple, out: str, state: str, value: str, cell: int):
        self.step, self.fresh, self.names = step, fresh, [c.split()[0].strip("`") for c in out.split(", ")]
        parts = [c.split(" ", 1) for c in state.split(", ")]
        self.state, self.value, self.cell = ", ".join(["users array<long>", *(f"`{n}` array<{kind}>" for n, kind in parts)]), value, cell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.decision = handle.getValueState("decision", self.state)
        self.cells = handle.getMapState("open", "cell long", f"users array<long>, t array<long>, ids array<long>, v array<{self.value}>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        new: dict[int, tuple[list, list, list, list]] = {}
        for pdf in rows:
            for user, t, number, value in zip(pdf["user_id"].tolist(), pdf["t"].tolist(), pdf["event_id"].tolist(), pdf["value"].tolist(), strict=True):
                if number != _NONE:
                    plain = value.tolist() if isinstance(value, np.ndarray) else value
                    for held, x in zip(new.setdefault(t // (1000 * self.cell), ([], [], [], [])), (user, t, number, plain), strict=True):
                        held.append(x)
        for cell, held in new.items():
            if self.cells.containsKey((cell,)):
                held = tuple(list(old) + more for old, more in zip(self.cells.getValue((cell,)), held, strict=True))
            else:
                self.handle.registerTimer((cell + 1) * self.cell)
            self.cells.updateValue((cell,), held)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        cell = expiredTimerInfo.getExpiryTimeInMs() // self.cell - 1
        users, t, ids, values = self.cells.getValue((cell,))
        before = self.decision.get()
        last = dict(zip(before[0], zip(*before[1:], strict=True), strict=True)) if before else {}
        out = []
        for n in sorted(range(len(t)), key=lambda n: (t[n], ids[n])):
            state, row = self.step(last.get(users[n], self.fresh), t[n], values[n])
            last[users[n]] = state
            if row is not None:
                out.append((users[n] if users[n] != _NONE else None, ids[n], *row))
        self.decision.update((list(last), *(list(x) for x in zip(*last.values(), strict=True))))
        self.cells.removeKey((cell,))
        if out:
            yield pd.DataFrame({name: pd.Series(x, dtype="Int64" if name == "user_id" else None) for name, x in zip(self.names, zip(*out, strict=True), strict=True)})

    def close(self) -> None:
        pass


def _folded(rows: DataFrame, step: Callable[[tuple, int, object], tuple[tuple, tuple | None]], fresh: tuple, out: str, state_schema: str, value: str = "double", cell: int = CELL) -> DataFrame:
    """``step(state, t, value)`` -> (state, what comes out behind the event's number, or None), user by user in order, for rows that the watermark has passed."""
    number, user = (F.coalesce(F.col(c).cast("long"), F.lit(_NONE)) for c in ("event_id", "user_id"))
    timed = rows.select(F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).alias("_group"), user.alias("user_id"), number.alias("event_id"), F.col("value").cast(value).alias("value"), "at", _micros(F.col("at")).alias("t"))
    out = f"user_id long, event_id long, {out}"
    return timed.groupBy("_group").transformWithStateInPandas(_Rule(step, fresh, out, state_schema, value, cell), out, "Append", "EventTime")


def refractory(rows: DataFrame, gap: int, cell: int = CELL) -> DataFrame:
    """Events at least ``gap`` microseconds after the last one kept; the state is its time."""

    def step(state: tuple, t: int, value: float) -> tuple[tuple, tuple | None]:
        (last,) = state
        return ((int(t),), (t,)) if last is None or t - last >= gap else (state, None)

    return _folded(rows, step, (None,), "t long", "last long", cell=cell)


def hysteresis(rows: DataFrame, enter: float, stay: float, hold: int, cell: int = CELL) -> DataFrame:
    """On and off of a hysteresis with hold; the state is (on, quiet rows)."""

    def step(state: tuple, t: int, value: float) -> tuple[tuple, tuple | None]:
        on, quiet = state
        value = float("nan") if value is None else value
        if not on:
            on, quiet = bool(value >= enter), 0
        else:
            quiet = 0 if value >= stay else int(quiet) + 1
            on = quiet <= hold
        return (on, quiet), (on,)

    return _folded(rows, step, (False, 0), "on boolean", "on boolean, quiet long", cell=cell)


def frame_changes(rows: DataFrame, cell: int = CELL) -> DataFrame:
    """Mean absolute change of each frame (``value``, an array) since its key's frame before, which is all that the state carries; 0 for the first."""

    def step(state: tuple, t: int, value) -> tuple[tuple, tuple | None]:
        (last,), now = state, np.asarray(value, float)
        change = 0.0 if last is None else float(np.abs(now - np.asarray(last, float)).mean())
        return (now.tolist(),), (change,)

    return _folded(rows, step, (None,), "change double", "last array<double>", "array<double>", cell)
