"""Corpus governance: duplicates, leakage, privacy projections and scans, manifests, blinding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..sources.scratch import shared


def duplicates(df: DataFrame, size: str, content: Column, out: str = "digest") -> DataFrame:
    """Rows whose size another row has, with digest and copies: only those are hashed."""
    sizes = df.groupBy(size).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    hashed = df.join(sizes, size, "left_semi").withColumn(out, F.sha2(content.cast("binary"), 256))
    copies = hashed.groupBy(out).agg(F.count("*").alias("copies"))
    return hashed.join(copies, out)


def holdout(df: DataFrame, group: str, split: str, train: str = "TRAIN", test: str = "TEST") -> DataFrame:
    """Adds ``note``: test rows whose group also trains are excluded."""
    trained = df.where(F.col(split) == train).select(group).distinct().withColumn("_t", F.lit(True))
    leak = (F.col(split) == test) & F.coalesce("_t", F.lit(False))
    return df.join(trained, group, "left").withColumn("note", F.when(leak, "group_in_train").otherwise("")).drop("_t")


def leakage(banks: DataFrame, recipes: DataFrame, key: str, split: str) -> DataFrame:
    """Recipe rows whose source isn't in the bank of their split."""
    return recipes.join(banks.select(key, split).distinct(), [key, split], "left_anti")


def public(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """The allowed columns that are there, in the allow-list's order."""
    return df.select(*[c for c in allowed if c in df.columns])


def private_findings(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A row for each absolute path in the text columns."""
    leaves = F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.coalesce(c, F.lit("")) for c in columns]))).alias("path", "value")
    return df.select(key, leaves).select(key, "path", F.explode(sc.private_paths("value")).alias("found"))


def walked(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value) of every leaf of JSON documents, through objects and lists of any depth.

    ``path`` lists the key names, and ``[i]`` for the places of lists; strings
    come as they are, other leaves as JSON.  Each step opens the containers that
    are left by one lateral ``variant_explode``, and is written, so a document
    is parsed once and opened a level at a time.  Empty containers have no
    leaf; texts that are no JSON are left out.
    """
    spark = df.sparkSession
    level = df.select(F.col(key).alias("_id"), F.array().cast("array<string>").alias("path"), F.try_parse_json(json).alias("_v")).where("_v is not null")
    out = None
    while True:
        kind = F.schema_of_variant("_v")
        rows = level.withColumns({"_open": kind.startswith("OBJECT") | kind.startswith("ARRAY"), "_text": kind == "STRING"})
        place = shared(spark, "walk")
        rows.write.parquet(place)
        rows = spark.read.schema(rows.schema).parquet(place)
        value = F.when(F.col("_text"), F.try_variant_get("_v", "$", "string")).otherwise(F.to_json("_v"))
        leaf = rows.where("not _open").select(F.col("_id").alias(key), "path", value.alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        nested = rows.where("_open").select("_id", F.col("path").alias("_path"), "_v")
        if nested.isEmpty():
            return out
        opened = nested.alias("w").lateralJoin(spark.tvf.variant_explode(F.col("w._v").outer()))
        name = F.coalesce(F.col("key"), F.concat(F.lit("["), F.col("pos"), F.lit("]")))
        level = opened.select("_id", F.array_append("_path", name).alias("path"), F.col("value").alias("_v"))


def findings(leaves: DataFrame, key: str, tokens: Sequence[str]) -> DataFrame:
    """(key, field, match) of walked leaves: each absolute path in a value, and ``private-key-name`` where the last key name holds a token."""
    field, last = F.array_join("path", "/"), F.lower(F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("")))
    found = leaves.select(key, field.alias("field"), F.explode(sc.private_paths("value")).alias("match"))
    named = F.lit(False)
    for token in tokens:
        named |= F.contains(last, F.lit(token.lower()))
    return found.unionByName(leaves.where(named).select(key, field.alias("field"), F.lit("private-key-name").alias("match")))


def manifest(df: DataFrame, key: str, content: Column) -> DataFrame:
    return df.select(key, F.sha2(content.cast("binary"), 256).alias("sha256"), F.octet_length(content.cast("string")).alias("bytes"))


def blinded(df: DataFrame, group: str, item: str, seed: int, pattern: str = "item_%03d") -> DataFrame:
    """Items of each group in hash order under new names, and the hash of the group's whole assignment."""
    order = Window.partitionBy(group).orderBy(sc.uniform(seed, group, item), item)
    out = df.withColumn("blind", F.format_string(pattern, F.row_number().over(order)))
    pairs = out.groupBy(group).agg(sc.assignment_hash(F.collect_list(F.concat_ws("=", "blind", F.col(item).cast("string")))).alias("assignment"))
    return out.join(pairs, group)


def levelled(df: DataFrame, group: str, peak: str, source: Column, target_db: float, strict: bool = True) -> DataFrame:
    """One gain a group, ``gain_db``, from its ``source`` item's peak, never over 0 dB, and each item's ``level`` under it.

    If an item would clip, the job is ended: items must not be mended one by
    one.  Without ``strict`` such items are marked in ``clips`` only.
    """
    limit = 10 ** (target_db / 20)
    own = df.where(source).groupBy(group).agg(F.max(peak).alias("_raw"))
    rows = df.join(own, group).withColumn("_g", F.when(F.col("_raw") > 0, F.least(F.lit(1.0), limit / F.col("_raw"))).otherwise(1.0))
    rows = rows.withColumns({"gain_db": 20 * F.log10("_g"), "level": F.col(peak) * F.col("_g")}).withColumn("clips", F.col("level") > 1 + 1e-6)
    if strict:
        rows = rows.withColumn("clips", F.when(F.col("clips"), F.raise_error(F.concat(F.lit("the common gain would clip group "), F.col(group).cast("string"))).cast("boolean")).otherwise(F.lit(False)))
    return rows.drop("_raw", "_g")


def windows_bank(events: DataFrame, key: str, t: str, kind: str, width: int, per: int, first: int, jitter: int, seed: int) -> DataFrame:
    """Window starts of each recording (key, w0), at most ``per``, by declared preference.

    First windows around the ``first`` earliest events of each kind, where they lie
    inside the recording; then an even grid for the slots that are left, jittered by
    hash.  Starts are clamped to the recording, one stays in each half width, and
    the first ``per`` of these are taken.
    """
    end = events.groupBy(key).agg(F.greatest(F.max(t) - width, F.lit(0)).alias("_end"))
    nth = F.row_number().over(Window.partitionBy(key, kind).orderBy(t))
    seek = events.select(key, kind, t).distinct().withColumn("_n", nth).where(F.col("_n") <= first).join(end, key)
    seek = seek.select(key, "_end", F.col(kind).alias("_k"), "_n", (F.col(t) - width // 2).alias("w0")).where((F.col("w0") >= 0) & (F.col("w0") <= F.col("_end")))
    slots = end.join(seek.groupBy(key).agg(F.count("*").alias("_s")), key, "left").withColumn("_m", F.lit(per) - F.coalesce("_s", F.lit(0)))
    grid = slots.where("_m > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))))
    shift = F.floor((sc.uniform(seed, key, "_n") - 0.5) * 2 * jitter).cast("bigint")
    grid = grid.select(key, "_end", F.lit("~").alias("_k"), "_n", (F.expr("_end * _n div (_m + 1)") + shift).alias("w0"))
    rows = seek.unionByName(grid).withColumn("w0", F.least(F.greatest("w0", F.lit(0)), "_end").cast("bigint"))
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key, F.floor(F.col("w0") / (width // 2))).orderBy("_k", "_n"))).where("_r = 1")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_k", "_n"))).where(F.col("_r") <= per).select(key, "w0")


def region(df: DataFrame, spans: DataFrame, key: str, length: str, want: int, seed: str) -> DataFrame:
    """Adds ``start``, ``end`` and ``origin``: the first declared span (key, s, e) that is long enough, else a seeded place, else the whole."""
    declared = spans.where(F.col("e") - F.col("s") >= want).groupBy(key).agg(F.min("s").alias("_s"))
    drawn = F.when(F.col(length) > want, F.pmod(F.col(seed) * 37, F.col(length) - want)).otherwise(F.lit(0))
    start = F.coalesce("_s", drawn).cast("bigint")
    end = F.when(F.col("_s").isNotNull() | (F.col(length) > want), start + want).otherwise(F.col(length))
    origin = F.when(F.col("_s").isNotNull(), "declared").otherwise("unverified")
    return df.join(declared, key, "left").withColumns({"start": start, "end": end.cast("bigint"), "origin": origin}).drop("_s")


def refused(df: DataFrame, path: Column, folders: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Adds ``refusal``: why a path may not be used (inside a listed folder, or a listed word in its file name), or null."""
    name = F.lower(F.substring_index(path, "/", -1))
    inside = [F.when(path.startswith(f.rstrip("/") + "/"), F.lit(f"folder {f}")) for f in folders]
    called = [F.when(F.contains(name, F.lit(n.lower())), F.lit(f"name {n}")) for n in names]
    return df.withColumn("refusal", F.coalesce(*inside, *called))


def lint(lines: DataFrame, doc: str, n: str, text: str) -> DataFrame:
    """Errors of Markdown lines: heading levels that jump, table rows whose width differs from the row above."""
    order = Window.partitionBy(doc).orderBy(n)
    level = F.length(F.regexp_extract(text, r"^(#+) ", 1))
    cells = F.when(F.col(text).startswith("|"), F.size(F.split(text, r"\|")))
    heads = lines.withColumn("_h", F.when(level > 0, level)).where("_h is not null")
    jump = heads.withColumn("_p", F.lag("_h").over(order)).where(F.col("_h") > F.coalesce("_p", F.lit(0)) + 1).select(doc, n, F.lit("heading_jump").alias("error"))
    width = lines.withColumn("_c", cells).withColumn("_p", F.lag("_c").over(order)).where("_c is not null and _p is not null and _c <> _p")
    return jump.unionByName(width.select(doc, n, F.lit("table_width").alias("error")))


#: Local Markdown links, and links to the own site in HTML.
MARKDOWN_LINK, HTML_LINK = r"\[[^\]]*\]\(([^)#:]+)\)", r'href="/([^"#?]+)'


def broken_links(lines: DataFrame, names: DataFrame, doc: str, n: str, text: str, name: str, pattern: str = MARKDOWN_LINK) -> DataFrame:
    """Local links of texts whose target is no known name, once for each time."""
    links = lines.select(doc, n, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("target"))
    return links.join(names.select(F.col(name).alias("target")).distinct(), "target", "left_anti").select(doc, n, "target")


def missing(names: DataFrame, required: DataFrame, name: str) -> DataFrame:
    """Required file names that are not there."""
    return required.select(name).distinct().join(names.select(name), name, "left_anti")


def receipts(files: DataFrame, recorded: DataFrame, name: str, digest: str) -> DataFrame:
    """Recorded files whose digest is another now, or that are gone: (name, state)."""
    now = files.select(name, F.col(digest).alias("_now"))
    state = F.when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col(digest), "changed")
    return recorded.join(now, name, "left").withColumn("state", state).where("state is not null").select(name, "state")
