"""Sources, sinks, waveform kernels and streaming twins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import signal as sg
from ..sources import files
from ..sources.scratch import shared
from ..streaming import twins
from .base import EV, HOUR, events, load, query, r

# Sixteen embeddings of a label in order are one waveform, the label's next sixteen its estimate; the last
# waveform of a label is filled with silence, and its estimate is the label's first.


def waves(spark, sf):
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = load(spark, sf, "embeddings").select("label", F.floor(n / 16).alias("block"), "vec_id", "embedding")
    w = rows.groupBy("label", "block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))
    silence = F.array_repeat(F.lit(0.0).cast("float"), (16 - F.size("x")) * F.size(F.col("x")[0]["embedding"]))
    w = w.select("label", "block", F.concat(F.flatten(F.transform("x", lambda v: v["embedding"])), silence).alias("x"))
    order = Window.partitionBy("label").orderBy("block")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return w.withColumn("y", F.coalesce(F.lead("x").over(order), F.first("x").over(whole)))


def _kernel(name, fn, schema, columns=("x", "y")):
    def run(spark, sf):
        return sg.mapped(waves(spark, sf), fn, f"label int, block long, {schema}", ["label", "block"], list(columns))

    query(name)(run)


_kernel("optimised_mask", lambda x, y: dict(zip(("before", "after"), sg.optimised_mask(x + y, x, 12)[1:], strict=True)), "before double, after double")


# Sources and sinks.


def _folder(spark):
    return shared(spark, "tables")


@query("json_round_trip", f"{EV} SELECT event_id, user_id, event_type, value FROM ev")
def json_round_trip(spark, sf):
    df = events(spark, sf).select("event_id", "user_id", "event_type", "value")
    return files.read_json(spark, files.write_json(df, _folder(spark)), df.schema)


@query("csv_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_round_trip(spark, sf):
    df = load(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = _folder(spark)
    df.write.csv(path, header=True)
    return files.read_csv(spark, path, df.schema)


@query("public_private_sink", "SELECT 'public' AS sink, count(*) AS n, 3 AS columns FROM documents UNION ALL SELECT 'private', count(*), 5 FROM documents")
def public_private_sink(spark, sf):
    folder = _folder(spark)
    files.write_both(load(spark, sf, "documents"), folder, ["doc_id", "lang", "n_chars"])
    out = None
    for name in ("public", "private"):
        df = spark.read.parquet(f"{folder}/{name}")
        row = df.agg(F.lit(name).alias("sink"), F.count("*").alias("n"), F.lit(len(df.columns)).alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


@query("series_archive", "SELECT label, count(*) AS n, len(any_value(embedding)) AS width FROM embeddings GROUP BY label")
def series_archive(spark, sf):
    df = load(spark, sf, "embeddings")
    back = files.read_series(spark, files.write_series(df, _folder(spark), "label"))
    return back.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("bigint").alias("width"))


@query("file_catalog")
def file_catalog(spark, sf):
    """Files of the table folder with size and category; contents are not read."""
    return files.catalog(spark, sf).select("name", "bytes", "category")


@query("session_scan", "SELECT 'session=' || n_regionkey AS session, 1::BIGINT AS files FROM nation GROUP BY 1")
def session_scan(spark, sf):
    """Sessions of a two-level tree and their files of an allowed kind; a second kind beside them is left out."""
    folder = _folder(spark)
    tree = load(spark, sf, "nation").select(F.col("n_regionkey").alias("session"), F.col("n_name").alias("line")).coalesce(1)
    tree.write.partitionBy("session").csv(folder)
    tree.write.mode("append").partitionBy("session").json(folder)
    return files.sessions(files.catalog(spark, folder), ["csv"]).groupBy("session").agg(F.count("*").alias("files"))


@query("excluded_walk", "SELECT 'kept' AS folder, count(DISTINCT n_regionkey) AS files, true AS sized FROM nation")
def excluded_walk(spark, sf):
    """Path and size of all files but those of an excluded folder."""
    folder = _folder(spark)
    tree = load(spark, sf, "nation").select(F.col("n_regionkey").alias("session"), F.col("n_name").alias("line")).coalesce(1)
    for name in ("kept", "private"):
        tree.write.partitionBy("session").csv(f"{folder}/{name}")
    found = files.catalog(spark, folder, glob="*.csv", excluded=("private",))
    return found.groupBy(F.element_at(F.split("path", "/"), -3).alias("folder")).agg(F.count("*").alias("files"), (F.min("bytes") > 0).alias("sized"))


def _tree(spark, sf):
    """Suppliers by nation in two kinds of files, and notes by region in a third."""
    folder = _folder(spark)
    rows = load(spark, sf, "supplier").select(F.format_string("n%02d", F.col("s_nationkey").cast("int")).alias("part"), F.col("s_name").alias("line")).coalesce(1)
    rows.write.partitionBy("part").json(f"{folder}/a")
    rows.write.partitionBy("part").text(f"{folder}/b")
    load(spark, sf, "nation").select(F.col("n_regionkey").alias("part"), F.col("n_name").alias("line")).coalesce(1).write.partitionBy("part").orc(f"{folder}/c")
    return files.catalog(spark, folder)


_FOLDERS = "WITH s AS (SELECT DISTINCT s_nationkey AS n FROM supplier)"


@query("tree_catalog", f"{_FOLDERS} SELECT 'table' AS category, count(*) AS files, count(*) AS folders, true AS sized FROM s UNION ALL SELECT 'text', count(*), count(*), true FROM s UNION ALL SELECT 'other', count(DISTINCT n_regionkey), count(DISTINCT n_regionkey), true FROM nation")
def tree_catalog(spark, sf):
    """Categories of the files of a tree that is written from tables, by their extensions alone."""
    found = _tree(spark, sf).groupBy("category")
    return found.agg(F.count("*").alias("files"), F.count_distinct(F.element_at(F.split("path", "/"), -2)).alias("folders"), (F.min("bytes") > 0).alias("sized"))


@query("latest_of_tree", f"{_FOLDERS} SELECT 'part=n' || lpad(max(n)::VARCHAR, 2, '0') AS name, 'there' AS state FROM s WHERE n % 100 < 20 HAVING count(*) > 0")
def latest_of_tree(spark, sf):
    """The last folder of a name pattern, and no row for a pattern that none has."""
    folders = _tree(spark, sf).withColumn("name", F.element_at(F.split("path", "/"), -2))
    there = files.latest(folders, r"^part=n[01]\d$").withColumn("state", F.lit("there"))
    return there.unionByName(files.latest(folders, r"^part=zz").withColumn("state", F.lit("missing")))


@query("latest_optional")
def latest_optional(spark, sf):
    return files.latest(files.catalog(spark, sf), r"orders|lineitem")


@query("inventory_with_errors", "SELECT event_id, json_extract_string(CASE WHEN event_id % 10 = 4 THEN NULL ELSE props END, '$.k')::BIGINT AS k, CASE WHEN event_id % 10 = 4 THEN 'unreadable' END AS error FROM events")
def inventory_with_errors(spark, sf):
    text = F.when(F.expr("event_id % 10 = 4"), F.lit("{broken")).otherwise(F.col("props"))
    return files.parsed(load(spark, sf, "events").select("event_id", text.alias("props")), "props", "k bigint").select("event_id", "k", "error")


@query("media_probe", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 48000 ELSE 32000 END AS rate, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS channels FROM events")
def media_probe(spark, sf):
    e = F.col("event_id")
    first = F.format_string("Stream #0: Audio: pcm, %d Hz, %s", F.when(e % 3 == 0, 48000).otherwise(0), F.when(e % 2 == 0, "stereo").otherwise("mono"))
    second = F.format_string('{"sample_rate": %d}', F.when(e % 3 == 0, 44100).otherwise(32000))
    return files.probed(load(spark, sf, "events").select("event_id", first.alias("log"), second.alias("probe")), "event_id", "log", "probe")


@query("report_rows", "SELECT printf('| %s | %d | %.2f |', l_returnflag, count(*), round(avg(l_quantity), 2)) AS line FROM lineitem GROUP BY l_returnflag")
def report_rows(spark, sf):
    g = load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 2).alias("mean"))
    return files.report(g, "| %s | %d | %.2f |", ["l_returnflag", "n", "mean"])


@query("wav_round_trip", "SELECT count(*) AS n, true AS same FROM (SELECT vec_id FROM embeddings)")
def wav_round_trip(spark, sf):
    x = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("samples"))
    back = files.decoded_wav(files.encoded_wav(x, "vec_id", "samples", 8000), "vec_id", "wav")
    both = x.join(back.withColumnRenamed("samples", "again"), "vec_id")
    far = F.aggregate(F.zip_with("samples", "again", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda m, d: F.greatest(m, d))
    return both.agg(F.count("*").alias("n"), (F.max(far) < 1e-6).alias("same"))


# Vectors as frames of 11 by 2 RGB pixels: 64 bytes of components and two of zeros.
_PIXELS = """WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS frame, list_concat([least(greatest(floor((x::DOUBLE + 1) * 127.5), 0), 255) FOR x IN embedding], [0.0, 0.0]) AS b FROM embeddings),
c AS (SELECT frame, p, b[3 * p + 1] AS r, b[3 * p + 2] AS g, b[3 * p + 3] AS b FROM e, range(22) AS x(p))"""
_FRAMES = f"""{_PIXELS}, d AS (SELECT a.frame, avg((abs(a.r - z.r) + abs(a.g - z.g) + abs(a.b - z.b)) / 3.0) AS diff FROM c a JOIN c z ON z.frame = a.frame - 1 AND z.p = a.p GROUP BY 1)
SELECT frame, round(avg((r > 1.2 * b AND r > 80)::INT), 6) AS warm, round(avg((least(r, g, b) > 180 AND greatest(r, g, b) - least(r, g, b) < 30)::INT), 6) AS white, round(avg((r + g + b) / 3.0), 6) AS bright, round(coalesce(any_value(diff), 0.0), 6) AS diff FROM c LEFT JOIN d USING (frame) GROUP BY frame"""


def _pixels(rows):
    byte = lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int")
    return rows.select("vec_id", F.concat(F.transform("embedding", byte), F.array(F.lit(0), F.lit(0))).alias("pixels"))


def _frames(reader, folder):
    return reader.format("rawframes").option("path", folder).option("width", "11").option("height", "2").load()


def _features(df):
    return df.select("frame", *[r(c).alias(c) for c in ("warm", "white", "bright", "diff")])


@query("raw_frame_source", _FRAMES)
def raw_frame_source(spark, sf):
    """The Python data source of raw frames over files of all vectors."""
    files.register(spark)
    folder = _folder(spark)
    files.write_raw_frames(_pixels(load(spark, sf, "embeddings")), "vec_id", "pixels", folder, 4)
    return _features(_frames(spark.read, folder))


@query("raw_frame_stream", _FRAMES)
def raw_frame_stream(spark, sf):
    """The same frames as a stream that is stopped and started again as files are added: nothing repeats, nothing is lost."""
    files.register(spark)
    folder, out = _folder(spark), shared(spark, "frames")
    rows = _pixels(load(spark, sf, "embeddings"))
    half = rows.agg(F.expr("percentile_approx(vec_id, 0.5)")).first()[0]
    for name, part in (("a", rows.where(F.col("vec_id") <= half)), ("b", rows.where(F.col("vec_id") > half))):
        place = f"{folder}-{name}"
        files.write_raw_frames(part, "vec_id", "pixels", place, 2)
        files.move_behind(place, folder, name)
        stream = _frames(spark.readStream, folder)
        sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/data/{number}")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return _features(spark.read.option("recursiveFileLookup", True).parquet(f"{out}/data"))


@query("table_partitions_pruned", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity < 10 GROUP BY 1")
def table_partitions_pruned(spark, sf):
    df = load(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz'1998-01-01' and l_quantity < 10")
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"))


# Streaming twins: the events table replayed as a stream until it is used up.


@query("stream_sessions", f"""{EV}, f AS (SELECT *, CASE WHEN t - lag(t) OVER w < {4 * HOUR} THEN 0 ELSE 1 END AS nw FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, min(t) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark, sf):
    return twins.replayed(spark, sf, lambda s: twins.sessions(s, "4 hours"))


@query("stream_sliding", f"{EV}, x AS (SELECT unnest(range((t - {8 * HOUR}) // {2 * HOUR} + 1, t // {2 * HOUR} + 1)) * {2 * HOUR} AS w0 FROM ev) SELECT w0, count(*) AS n FROM x GROUP BY w0")
def stream_sliding(spark, sf):
    return twins.replayed(spark, sf, lambda s: twins.sliding(s, "8 hours", "2 hours"))


@query("stream_tumbling", f"{EV} SELECT t // {24 * HOUR} * {24 * HOUR} AS w0, count(*) AS n, round(sum(value), 2) AS total FROM ev GROUP BY 1")
def stream_tumbling(spark, sf):
    return twins.replayed(spark, sf, lambda s: twins.tumbling(s, "24 hours"))


#: Open rows of a day lie together in the state: the files cover a month.
DAY = 24 * 3_600_000

_TURN = EV.replace("WITH", "WITH RECURSIVE") + ", n AS (SELECT user_id, t, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev), "


@query(
    "stream_refractory",
    _TURN + f"""rr AS (SELECT user_id, i, t, event_id, true AS keep, t AS last FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.t, n.event_id, n.t - rr.last >= {6 * HOUR}, CASE WHEN n.t - rr.last >= {6 * HOUR} THEN n.t ELSE rr.last END FROM rr JOIN n ON n.user_id = rr.user_id AND n.i = rr.i + 1)
SELECT user_id, event_id, t FROM rr WHERE keep""",
)
def stream_refractory(spark, sf):
    """Events kept by a stateful refractory rule, one state a user."""
    return twins.replayed(spark, sf, lambda s: twins.refractory(s, 6 * HOUR, DAY))


@query(
    "stream_hysteresis",
    _TURN + """h AS (SELECT user_id, i, event_id, value >= 60 AS st, 0 AS quiet FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.event_id, CASE WHEN h.st THEN (CASE WHEN n.value >= 20 THEN 0 ELSE h.quiet + 1 END) <= 2 ELSE n.value >= 60 END, CASE WHEN h.st AND n.value < 20 THEN h.quiet + 1 ELSE 0 END FROM h JOIN n ON n.user_id = h.user_id AND n.i = h.i + 1)
SELECT user_id, event_id, st AS on_ FROM h""",
)
def stream_hysteresis(spark, sf):
    return twins.replayed(spark, sf, lambda s: twins.hysteresis(s, 60.0, 20.0, 2, DAY)).withColumnRenamed("on", "on_")


@query(
    "stream_frame_scan",
    """WITH d AS (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
SELECT label, vec_id, round(coalesce(list_avg(list_transform(list_zip(e, p), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 0), 6) AS change FROM d""",
)
def stream_frame_scan(spark, sf):
    """Vectors as frames of their label's film, a minute apart: the change since the frame before, with that one frame as state."""
    rows = load(spark, sf, "embeddings").select(F.col("label").cast("long").alias("user_id"), F.col("vec_id").alias("event_id"), F.col("embedding").alias("value"), F.timestamp_seconds(1_000_000_000 + F.col("vec_id") * 60).alias("ts"))
    got = twins.replayed(spark, sf, lambda s: twins.frame_changes(s, DAY), rows=rows)
    return got.select(F.col("user_id").cast("int").alias("label"), F.col("event_id").alias("vec_id"), r("change").alias("change"))
