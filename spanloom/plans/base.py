"""Table loaders, the query registry, and the SQL heads that both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000
MONTH = 30 * 24 * HOUR

#: Events with integer microseconds since 1970; series number rows of a user in time order.
EV = "WITH ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS t FROM events)"
SER = EV + ", ser AS (SELECT user_id, event_id, event_type, t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM ev)"


def uniform_sql(seed: int, *keys: str) -> str:
    """The SQL twin of :func:`functions.scalars.uniform`."""
    return f"(('0x' || md5(concat_ws(':', '{seed}', {', '.join(keys)}))[1:10])::BIGINT / 1099511627776.0)"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def events(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    df = load(spark, sf, "events")
    if kinds:
        df = df.where(F.col("event_type").isin(*kinds))
    return df.select("event_id", "user_id", "event_type", "value", "props", F.expr(MICROS).alias("t"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1
    return events(spark, sf).select("user_id", "event_id", "event_type", "t", F.col("value").alias("v"), nth.cast("bigint").alias("i"))


def r(x, n: int = 6):
    """Round for output only, half away from zero on both engines."""
    return F.round(x if not isinstance(x, str) else F.col(x), n)
