"""Files in and out: fixed schemas, metadata scans that read no content, errors as rows."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.ranges import one_task_each, ranged

#: Extensions of each category.
CATEGORIES = {
    "audio": ["wav", "flac", "mp3"],
    "video": ["mp4", "mov", "mkv"],
    "table": ["parquet", "csv", "json"],
    "text": ["md", "txt"],
}


def read_json(spark: SparkSession, path: str, schema, whole: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").json(path)
    return path


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows with a header; an empty cell is null."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_series(df: DataFrame, path: str, by: str) -> str:
    """A columnar archive of arrays, a folder for each value of ``by``."""
    df.write.partitionBy(by).parquet(path)
    return path


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def category(name) -> F.Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("other")
    for label, exts in reversed(list(CATEGORIES.items())):
        out = F.when(ext.isin(exts), label).otherwise(out)
    return out


def catalog(spark: SparkSession, folder: str, glob: str | None = None, excluded: Sequence[str] = (".git", "__pycache__")) -> DataFrame:
    """path, name, bytes, modified and category of all files under a folder; ``content`` is pruned, so nothing is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    if excluded:
        df = df.where(~F.col("path").rlike("/(?:" + "|".join(x.replace(".", r"\.") for x in excluded) + ")/"))
    return df.select("path", name.alias("name"), "bytes", "modified", category(name).alias("category"))


def sessions(catalogue: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Files two levels down with an allowed extension, and their session folder."""
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    return catalogue.where(ext.isin(list(allowed))).withColumn("session", F.element_at(F.split("path", "/"), -2))


def latest(catalogue: DataFrame, pattern: str) -> DataFrame:
    """The last path, in name order, that matches; no row if none does."""
    return catalogue.where(F.col("name").rlike(pattern)).agg(F.max("name").alias("name")).where("name is not null")


def write_both(df: DataFrame, folder: str, public: Sequence[str]) -> None:
    """The same rows twice: all columns, and the public ones."""
    df.write.parquet(f"{folder}/private")
    df.select(*public).write.parquet(f"{folder}/public")


def parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Fields of a JSON column; what can't be read becomes a row with an error."""
    both = df.withColumn("_p", F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return both.select("*", "_p.*").withColumn("error", F.when(F.col("_bad").isNotNull(), "unreadable")).drop("_p", "_bad")


def probed(df: DataFrame, key: str, log: str, probe: str) -> DataFrame:
    """Rate and channels from a tool's log, a second probe's JSON where the log has none or 0."""
    rate = F.nullif(F.regexp_extract(log, r"(\d+) Hz", 1).cast("int"), F.lit(0))
    other = F.get_json_object(probe, "$.sample_rate").cast("int")
    channels = F.when(F.col(log).contains("stereo"), 2).when(F.col(log).contains("mono"), 1)
    return df.select(key, F.coalesce(rate, other).alias("rate"), channels.alias("channels"))


def report(df: DataFrame, pattern: str, columns: Sequence[str]) -> DataFrame:
    return df.select(F.format_string(pattern, *columns).alias("line"))


def _wav(samples: np.ndarray, rate: int) -> bytes:
    data = samples.astype("<f4").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 3, 1, rate, 4 * rate, 4, 32, b"data", len(data))
    return head + data


def _samples(blob: bytes) -> tuple[np.ndarray, int, int]:
    """Samples (frames, channels), rate and channels of PCM or float WAV bytes."""
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, channels, rate, bits = 12, 1, 1, 0, 16
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack("<I", blob[at + 4 : at + 8])[0]
        body = blob[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data":
            if kind == 3:
                x = np.frombuffer(body, f"<f{bits // 8}").astype(np.float32)
            else:
                x = np.frombuffer(body, {16: "<i2", 32: "<i4"}[bits]).astype(np.float32) / (1 << bits - 1)
            return x.reshape(-1, channels), rate, channels
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def encoded_wav(df: DataFrame, key: str, samples: str, rate: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "wav": [_wav(np.asarray(x), rate) for x in pdf[samples]]})

    return df.select(key, samples).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, wav binary")


def decoded_wav(df: DataFrame, key: str, blob: str) -> DataFrame:
    """First channel, rate, channels, and an error instead where a file can't be decoded."""

    def one(b: bytes) -> tuple:
        try:
            x, rate, channels = _samples(bytes(b))
            return x[:, 0].tolist(), rate, channels, None
        except (ValueError, KeyError, struct.error) as e:
            return None, None, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(b) for b in pdf[blob]]
            yield pd.DataFrame({key: pdf[key].to_numpy(), **{c: [x[i] for x in rows] for i, c in enumerate(("samples", "rate", "channels", "error"))}})

    return df.select(key, blob).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, samples array<float>, rate int, channels int, error string")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


def write_raw_frames(df: DataFrame, order: str, pixels: str, folder: str, parts: int) -> None:
    """Frames, arrays of bytes as numbers, in ``order`` into the raw files of a folder; their names sort like their frames.

    Each range of the order is one file, written under a temporary name and
    moved when it is whole, so a task that runs again leaves no half file.
    """
    rows = ranged(df.select(order, pixels), [order], parts)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = name = temporary = None
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        count = 0
        for pdf in batches:
            for at, frame in zip(pdf["_range"], pdf[pixels], strict=True):
                if name != f"{root}/frames-{at:05d}.raw":
                    if out is not None:
                        out.close()
                        store.move(temporary, name)
                    name, temporary = f"{root}/frames-{at:05d}.raw", f"{root}/_temporary-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                out.write(np.asarray(frame, np.uint8).tobytes())
                count += 1
        if out is not None:
            out.close()
            store.move(temporary, name)
        yield pd.DataFrame({"n": [count]})

    one_task_each(rows).mapInPandas(write, "n long").agg(F.sum("n")).collect()


def move_behind(source: str, folder: str, prefix: str) -> None:
    """Add the whole raw files of one folder to another, behind those there if ``prefix`` sorts so."""
    from pyarrow import fs

    (store, root), (_, to) = _store(source), _store(folder)
    store.create_dir(to, recursive=True)
    for x in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda x: x.path):
        if x.path.endswith(".raw"):
            store.move(x.path, f"{to}/{prefix}-{x.base_name}")


class RawFrames(DataSource):
    """Fixed-size RGB frames of raw files as feature rows, in batches or as a stream: options path (a file, or a folder of .raw files), width, height."""

    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> str:
        return "frame long, warm double, white double, bright double, diff double"

    def reader(self, schema) -> DataSourceReader:
        return _RawReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return _RawStream(self.options)


class _Frames:
    """The frames of a file or folder, numbered over its files in order of their names."""

    BLOCK = 256

    def __init__(self, options):
        self.w, self.h = int(options.get("width", 8)), int(options.get("height", 8))
        self.path, self.size = options["path"], self.w * self.h * 3

    def files(self) -> list[tuple[str, int]]:
        """Paths, and how many whole frames each has."""
        from pyarrow import fs

        store, root = _store(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = sorted((x for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.path.endswith(".raw")), key=lambda x: x.path)
        return [(x.path, x.size // self.size) for x in found]

    def ranges(self, start: int, end: int) -> list[InputPartition]:
        """Partitions of at most ``BLOCK`` frames: (file, first frame there, frames, number of the first, file and place of the frame before)."""
        out, at, before = [], 0, None
        for path, count in self.files():
            for a in range(0, count, self.BLOCK):
                low, high = max(a, start - at), min(a + self.BLOCK, count, end - at)
                if low < high:
                    last = (path, low - 1) if low else before
                    out.append(InputPartition((path, low, high - low, at + low, last)))
            if count:
                before = (path, count - 1)
            at += count
        return out

    def rows(self, partition: InputPartition) -> Iterator[tuple]:
        """A frame before the range, if there is one, is all that is carried into it."""
        from ..operators.signal import frame_features

        path, low, count, number, last = partition.value
        store, _ = _store(self.path)

        def frame(file, place: int) -> np.ndarray:
            file.seek(place * self.size)
            return np.frombuffer(file.read(self.size), np.uint8).reshape(self.h, self.w, 3)

        previous = None
        if last:
            with store.open_input_file(last[0]) as file:
                previous = frame(file, last[1]).astype(float)
        with store.open_input_file(path) as file:
            for k in range(count):
                now = frame(file, low + k)
                row = frame_features(now, previous)
                previous = now.astype(float)
                yield (number + k, row["warm"], row["white"], row["bright"], row["diff"])


class _RawReader(DataSourceReader):
    def __init__(self, options):
        self.frames = _Frames(options)

    def partitions(self):
        return self.frames.ranges(0, sum(n for _, n in self.frames.files())) or [InputPartition(None)]

    def read(self, partition):
        return self.frames.rows(partition) if partition.value else iter(())


class _RawStream(DataSourceStreamReader):
    """Offsets are numbers of frames: files are only ever added behind the others, and whole."""

    def __init__(self, options):
        self.frames = _Frames(options)

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"frame": 0}

    def latestOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"frame": sum(n for _, n in self.frames.files())}

    def partitions(self, start: dict, end: dict):
        return self.frames.ranges(start["frame"], end["frame"])

    def read(self, partition):
        return self.frames.rows(partition)

    def commit(self, end: dict) -> None:
        """Files stay: another query may read them."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawFrames)
