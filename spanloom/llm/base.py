"""Table access, shared scratch tables and connected components used by the operators here."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all run on one machine."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def fewer(df: DataFrame) -> DataFrame:
    """Four partitions a core or a quarter of the shuffle's, whichever is more: a cluster's worth of tasks, and no more files than that."""
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark, df = df.sparkSession, fewer(df)
    path = f"{scratch(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # what this write has shuffled goes when it is done
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanloom_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads, and let Spark drop finished shuffles."""
    for df in tables:
        path = getattr(df, "_spanloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


#: Most keys that are broadcast for having many rows.
HEAVY = 4096


def spread(rows: DataFrame, found: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``found``, which has one row a key and how many of ``rows`` it meets.

    Keys of over one part in ``HEAVY`` of the rows are ``HEAVY`` at most, and
    are broadcast; no other key has more rows than that in one task.
    """
    many = max(1000, (found.agg(F.sum(weight)).first()[0] or 0) // HEAVY)
    heavy, rest = found.where(F.col(weight) > many), found.where(F.col(weight) <= many)
    if heavy.isEmpty():
        return rows.join(rest, keys)
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(rest, keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(light)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column and 64 for each row, so that empty texts count: one native scan that shuffles one number a task."""
    return docs.agg(F.sum(F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 64)).first()[0] or 0


def map_texts(
    docs: DataFrame, fn: Callable[[pa.RecordBatch, int, int, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, column: str = "text"
) -> DataFrame:
    """Apply ``fn(batch, lo, hi, bytes, offsets)`` to slices of each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in tk.text_slices(batch.column(column)):
                yield fn(batch, lo, hi, buf, off)

    return docs.mapInArrow(run, schema)


#: Edges that one task takes: 32 MB.
EDGES = 1 << 21


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of one task: labels sink to the smaller end and are followed to their roots."""
    t = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    node, at = np.unique(np.concatenate([t.column(c).to_numpy() for c in "ab"]), return_inverse=True)
    a, b, label = at[: t.num_rows], at[t.num_rows :], np.arange(node.size)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], ["node", "component"])


def components(edges: DataFrame, u: str = "u", v: str = "v", most: int = 60, small: int = EDGES) -> DataFrame:
    """(node, component) of the nodes on edges; the component is its smallest node.

    Up to ``small`` edges are one task's work.  Beyond that, large-star and
    small-star steps alternate until no edge changes; each step is written to
    the shared folder.  Minima are partial aggregates, written before they join
    back, so that the join of a hub's edges is one of two sorted shuffles, which
    adaptive execution splits.
    """
    now = written(
        edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a > b").distinct(), "edges"
    )
    if now.count() <= small:
        return now.repartition(1).mapInArrow(_united, "node long, component long")

    def hang(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        low = written(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "minima")
        return pairs.join(low, "a"), low

    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung, first = hang(both)
        large = written(hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        hung, low = hang(large)
        some = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = written(some.where("a > b").distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        release(now, first, large, low)
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def ordered(table: pa.Table) -> pa.Table:
    """Rows in an order that depends on their values alone."""
    return table.sort_by([(c, "ascending") for c in table.column_names if not pa.types.is_nested(table.schema.field(c).type)])


def chunk_of(chunks: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(chunks)).alias("chunk")
